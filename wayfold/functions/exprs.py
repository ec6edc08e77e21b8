"""Column expressions as SQL text: time, geohash, keyed hashes, plane geometry.

The text uses only what Spark SQL and DuckDB share (but for the keyed hash), so that an oracle can be
written with the same functions. Plain decimals are written with an exponent, which makes them doubles.
"""

from __future__ import annotations

#: The geohash alphabet; kilometres of a degree of latitude and, at the equator, of longitude.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
KM_LAT, KM_LON = "110.574e0", "111.320e0"
#: Night, evening and work hours, local time.
NIGHT_HOURS, EVENING_HOURS, WORK_HOURS = tuple(range(6)), (20, 21, 22, 23, 0, 1, 2, 3, 4, 5), tuple(range(10, 16))


def floor_div(x: str, n: int) -> str:
    return f"CAST(floor(({x}) / {n}) AS BIGINT)"


def pmod(x: str, n: str) -> str:
    return f"(((({x}) % {n}) + {n}) % {n})"


def hour_index(utc: str = "utc_epoch") -> str:
    """Hours since 1970, rounded down also before it."""
    return floor_div(utc, 3600)


LOCAL = "(utc_epoch + tz_offset_s)"
LOCAL_HOUR = pmod(floor_div(LOCAL, 3600), "24")
LOCAL_DAY = floor_div(LOCAL, 86400)


def weekday(day: str) -> str:
    """Monday is 0."""
    return pmod(f"({day}) + 3", "7")


def among(x: str, values: tuple) -> str:
    return f"({x}) IN ({', '.join(map(str, values))})"


def bits(precision: int) -> tuple[int, int]:
    """Bits of longitude and latitude in a geohash of so many characters."""
    return -(-5 * precision // 2), 5 * precision // 2


def cell(lat: str, lon: str, precision: int) -> tuple[str, str]:
    """Column and row of a position's cell; a cell has its south and west edges."""
    nx, ny = bits(precision)
    x = f"least(CAST(floor((({lon}) + 180e0) * {2**nx}e0 / 360e0) AS BIGINT), {2**nx - 1})"
    y = f"least(CAST(floor((({lat}) + 90e0) * {2**ny}e0 / 180e0) AS BIGINT), {2**ny - 1})"
    return x, y


def _woven(three: int, two: int) -> str:
    """The character of five bits, three of one number and two of the other in turn."""
    bits_ = (three >> 2 & 1, two >> 1 & 1, three >> 1 & 1, two & 1, three & 1)
    return ALPHABET[int("".join(map(str, bits_)), 2)]


#: The alphabet by three bits of the number that begins a character, then two bits of the other.
_WOVEN = "".join(_woven(three, two) for three in range(8) for two in range(4))


def geohash_of_cell(x: str, y: str, precision: int) -> str:
    """The characters: five bits each, of column and row in turn, high bits first. A character takes three
    bits of one and two of the other, and finds them in a table woven for that."""
    left = dict(zip("xy", bits(precision), strict=True))
    names, chars = {"x": x, "y": y}, []
    for c in range(precision):
        first, other = ("x", "y") if c % 2 == 0 else ("y", "x")
        left[first], left[other] = left[first] - 3, left[other] - 2
        chars.append(f"substr('{_WOVEN}', CAST((({names[first]} >> {left[first]}) & 7) * 4 + (({names[other]} >> {left[other]}) & 3) + 1 AS INT), 1)")
    return f"concat({', '.join(chars)})"


def centre(x: str, y: str, precision: int) -> tuple[str, str]:
    """Latitude and longitude of a cell's middle."""
    nx, ny = bits(precision)
    return f"(({y}) + 0.5e0) * 180e0 / {2**ny}e0 - 90e0", f"(({x}) + 0.5e0) * 360e0 / {2**nx}e0 - 180e0"


def keyed_hash(message: str, salt: bytes, engine: str = "spark") -> str:
    """The first 16 bytes, as hex, of HMAC-SHA256 over an ASCII message."""
    if len(salt) != 32:
        raise ValueError("the salt must have 32 bytes")
    inner, outer = (bytes(b ^ p for b in salt.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))
    if engine == "spark":
        return f"substr(sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode({message}, 'UTF-8')), 256))), 256), 1, 32)"
    return f"substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message})))), 1, 32)"


def plane(lat: str, lon: str, lat0: str, lon0: str) -> tuple[str, str]:
    """Kilometres east and north of an origin, the shorter way round the globe."""
    turned = pmod(f"({lon}) - ({lon0}) + 180e0", "360e0")
    return f"(({turned} - 180e0) * {KM_LON} * cos(radians({lat0})))", f"((({lat}) - ({lat0})) * {KM_LAT})"


def distance(lat: str, lon: str, lat0: str, lon0: str) -> str:
    x, y = plane(lat, lon, lat0, lon0)
    return f"sqrt({x} * {x} + {y} * {y})"


def covers(lat: str, lon: str, home: tuple[str, str], work: tuple[str, str], km: str) -> str:
    """Whether a position is within km of the segment from home to work, on the plane around home; of
    home alone where work is null."""
    px, py = plane(lat, lon, *home)
    wx, wy = plane(*work, *home)
    wx, wy = f"coalesce({wx}, 0e0)", f"coalesce({wy}, 0e0)"
    along = f"greatest(0e0, least(1e0, coalesce(({px} * {wx} + {py} * {wy}) / nullif({wx} * {wx} + {wy} * {wy}, 0e0), 0e0)))"
    dx, dy = f"({px} - {along} * {wx})", f"({py} - {along} * {wy})"
    return f"(sqrt({dx} * {dx} + {dy} * {dy}) <= {km})"


def away(in_a: str, in_b: str, shared: str) -> str:
    """With a shared home outside both partners' areas; with two homes outside either."""
    return f"CASE WHEN {shared} THEN NOT ({in_a} OR {in_b}) ELSE NOT ({in_a} AND {in_b}) END"
