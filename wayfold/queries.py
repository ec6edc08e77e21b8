"""All queries of the co-presence engine by name, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import exprs as E
from wayfold.operators import anchors, cells, clean, homes, presence, score, trips
from wayfold.plans import pipeline
from wayfold.sources import photos as source

KEY = ("couple_id", "geohash", "hour_index")
COMPASS = ("couple_id", "person", "asset_id")
#: The queries' salt is public, so that their SQL can hash too. Real runs take a secret one (`sources.files.salt`).
PUBLIC_SALT = bytes(range(32))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, bucket, match blind, sessionize, and count both partners' photos in each session's window."""
    photos = pipeline.cleaned(spark, sf_dir)
    keys = trips.sessionize(presence.matched_keys(photos, PUBLIC_SALT))
    spans = keys.groupBy("couple_id", "session").agg(F.min("hour_index").alias("first_hour"), F.max("hour_index").alias("last_hour"), F.count("*").alias("keys"))
    spans = trips.windows(spans.withColumns({"head": F.lit(0), "tail": F.lit(0)}))
    return trips.backfill(spans, photos).select("couple_id", "session", "start_utc", "end_utc", "keys", "photo_count_a", "photo_count_b")


def _anchored(photos: DataFrame) -> DataFrame:
    """Placed photos beside their couple's anchors."""
    pairs = anchors.couples(anchors.infer_anchors(photos))
    return photos.filter("lat IS NOT NULL AND lon IS NOT NULL").join(pairs, "couple_id")


def _is_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _anchored(pipeline.cleaned(spark, sf_dir))
    bits = anchors.with_distances(at, "lat", "lon").withColumns({f"in_{p}": F.col(f"km_{p}") <= 5.0 for p in "ab"})
    return bits.select(*COMPASS, "in_a", "in_b", "shared_home", F.expr(E.away("in_a", "in_b", "shared_home")).alias("away"))


def _to_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = E.plane("lat", "lon", "37.76e0", "-122.44e0")
    return source.photos(spark, sf_dir).filter("lat IS NOT NULL").select(*COMPASS, F.round(F.expr(x), 6).alias("east_km"), F.round(F.expr(y), 6).alias("north_km"))


def _local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.photos(spark, sf_dir).select(*COMPASS, F.expr(E.hour_index()).alias("hour_index"), F.expr(E.LOCAL_HOUR).alias("local_hour"), F.expr(E.LOCAL_DAY).alias("local_day"), F.expr(E.weekday(E.LOCAL_DAY)).alias("weekday"))


def _infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.infer_anchors(pipeline.cleaned(spark, sf_dir)).select("couple_id", "person", "home_geohash7", "work_geohash7", "home_days", "work_days", "weak")


def _matched(spark: SparkSession, sf_dir: str, person: str) -> DataFrame:
    photos = pipeline.cleaned(spark, sf_dir)
    keys = presence.matched_keys(photos, PUBLIC_SALT)
    return presence.matched_photos(photos.filter(F.col("person") == person), keys, person == "a")


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = pipeline.cleaned(spark, sf_dir)
    a, b = (presence.hashes(photos, p, PUBLIC_SALT).select("couple_id", "hash") for p in "ab")
    return presence.match(a, b)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.labels(source.photos(spark, sf_dir))


def _trips(spark: SparkSession, sf_dir: str, past_homes: bool = False) -> DataFrame:
    """By the anchors alone, as SQL can tell; `trips_with_history` also looks for past homes."""
    return pipeline.trips_of(pipeline.cleaned(spark, sf_dir), PUBLIC_SALT, past_homes=past_homes)


def _era_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of windows of ten days, three days apart, as the tables cover a month."""
    return homes.era_votes(pipeline.cleaned(spark, sf_dir), 10, 3).select("couple_id", "person", "centre", "geohash", "days")


def _eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = pipeline.cleaned(spark, sf_dir)
    return homes.home_eras(photos, anchors.infer_anchors(photos)).select("couple_id", "person", "since_utc", "inferred", "nights")


def _tail_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.tail_hours(_trips(spark, sf_dir), score.label_spans(_labelled(spark, sf_dir)))


def _sweep(spark: SparkSession, sf_dir: str, past_homes: bool = False) -> DataFrame:
    """All points of the grid."""
    points = [r.asDict() | {"past_homes": past_homes} for r in score.grid(spark).collect()]
    return pipeline.sweep(pipeline.cleaned(spark, sf_dir), _labelled(spark, sf_dir), PUBLIC_SALT, points)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    raw, tidy = source.photos, pipeline.cleaned
    return {
        "flagship": flagship,
        "ingest_summary": lambda s, d: clean.ingest_summary(raw(s, d)),
        "drop_screenshots": lambda s, d: clean.drop_screenshots(raw(s, d)).select(*COMPASS),
        "drop_missing_timestamp": lambda s, d: clean.drop_missing_timestamp(raw(s, d)).select(*COMPASS),
        "collapse_bursts": lambda s, d: clean.collapse_bursts(raw(s, d)).select(*COMPASS),
        "filter_stats": lambda s, d: clean.filter_stats(raw(s, d)),
        **{f"bucket_keys_p{p}": lambda s, d, p=p: cells.own_keys(tidy(s, d), False, p).select(*KEY) for p in (5, 6, 7)},
        "expand_keys": lambda s, d: cells.own_keys(tidy(s, d).filter("person = 'a'"), True).select(*KEY),
        "salted_hashes": lambda s, d: cells.salted(cells.own_keys(tidy(s, d), False), PUBLIC_SALT).select("couple_id", "hash"),
        "match_hashes": _match,
        "matched_keys": lambda s, d: presence.matched_keys(tidy(s, d), PUBLIC_SALT).select(*KEY),
        "matched_photos_a": lambda s, d: _matched(s, d, "a"),
        "matched_photos_b": lambda s, d: _matched(s, d, "b"),
        "to_km": _to_km,
        "local_time": _local_time,
        "infer_anchors": _infer,
        "is_away": _is_away,
        "sessionize": lambda s, d: trips.sessionize(presence.matched_keys(tidy(s, d), PUBLIC_SALT)).select(*KEY, "session"),
        "coverage": lambda s, d: score.coverage(tidy(s, d)),
        "coverage_by_year": lambda s, d: score.coverage_by_year(tidy(s, d)),
        "in_labels": lambda s, d: score.in_labels(tidy(s, d), source.labels(raw(s, d))).select(*COMPASS),
        "grid": lambda s, d: score.grid(s),
        "without_home": lambda s, d: anchors.without_home(tidy(s, d), anchors.infer_anchors(tidy(s, d))),
        "era_votes": _era_votes,
        "home_eras": _eras,
        "trips": _trips,
        "evaluate": lambda s, d: score.evaluate(_trips(s, d), _labelled(s, d)),
        "hand_check": lambda s, d: score.hand_check(_trips(s, d), _labelled(s, d)),
        "tail_hours": _tail_hours,
        "sweep": _sweep,
        "trips_with_history": lambda s, d: _trips(s, d, True),
        "sweep_with_history": lambda s, d: _sweep(s, d, True),
    }


def oracle_sql() -> dict[str, str]:
    view = source.photo_view(source.DUCKDB_EPOCH)
    tidy = """tidy AS (SELECT * EXCLUDE (r) FROM (SELECT *, CASE WHEN burst_id IS NULL THEN 1 ELSE row_number() OVER
  (PARTITION BY couple_id, person, burst_id ORDER BY is_burst_pick DESC, utc_epoch, asset_id) END AS r FROM photos
  WHERE NOT is_screenshot AND utc_epoch IS NOT NULL) WHERE r = 1)"""
    compass, start = ", ".join(COMPASS), f"WITH {view}, {tidy}"

    def keyed(p: int) -> str:
        x, y = E.cell("lat", "lon", p)
        return f"""placed AS (SELECT *, {x} AS x, {y} AS y, {E.hour_index()} AS hour_index FROM tidy WHERE lat IS NOT NULL AND lon IS NOT NULL),
own AS (SELECT DISTINCT couple_id, person, x, y, hour_index, {E.geohash_of_cell('x', 'y', p)} AS geohash FROM placed)"""

    nx, ny = E.bits(6)
    wide = f"""wide AS (SELECT DISTINCT couple_id, person, {E.pmod('x + dx', str(2**nx))} AS x, y + dy AS y, hour_index + dh AS hour_index FROM own,
  (VALUES (-1), (0), (1)) i(dx), (VALUES (-1), (0), (1)) j(dy), (VALUES (-1), (0), (1)) k(dh) WHERE y + dy BETWEEN 0 AND {2**ny - 1}),
wide_a AS (SELECT couple_id, x, y, hour_index, {E.geohash_of_cell('x', 'y', 6)} AS geohash FROM wide WHERE person = 'a'),
both_ AS (SELECT a.* FROM wide_a a WHERE EXISTS (SELECT 1 FROM own b WHERE b.person = 'b' AND b.couple_id = a.couple_id AND b.x = a.x AND b.y = a.y AND b.hour_index = a.hour_index))"""
    sessions = """marked AS (SELECT *, CASE WHEN hour_index - lag(hour_index) OVER (PARTITION BY couple_id ORDER BY hour_index, geohash) > 6 THEN 1 ELSE 0 END AS fresh FROM both_),
sess AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY couple_id ORDER BY hour_index, geohash) AS BIGINT) AS session FROM marked)"""
    vx, vy = E.cell("lat", "lon", 7)
    votes = f"""voting AS (SELECT t.*, {E.LOCAL_HOUR} AS lh2, {E.LOCAL_DAY} AS ld2, {vx} AS vx, {vy} AS vy FROM tidy t
  JOIN (SELECT couple_id, person, max(utc_epoch) AS now FROM tidy GROUP BY ALL) n USING (couple_id, person)
  WHERE lat IS NOT NULL AND lon IS NOT NULL AND tz_offset_s IS NOT NULL AND utc_epoch BETWEEN now - 7776000 AND now),
cells_ AS (SELECT couple_id, person, k, vx, vy, {E.geohash_of_cell('vx', 'vy', 7)} AS gh, count(DISTINCT ld2) AS days, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon
  FROM (SELECT *, 'home' AS k FROM voting WHERE {E.among('lh2', E.NIGHT_HOURS)} UNION ALL SELECT *, 'work' FROM voting WHERE {E.among('lh2', E.WORK_HOURS)} AND {E.weekday('ld2')} < 5) GROUP BY ALL),
won AS (SELECT * FROM cells_ QUALIFY row_number() OVER (PARTITION BY couple_id, person, k ORDER BY days DESC, n DESC, gh) = 1),
anchor AS (SELECT h.couple_id, h.person, h.gh AS home_gh, h.lat AS home_lat, h.lon AS home_lon, h.days AS home_days, w.gh AS work_gh, w.lat AS work_lat, w.lon AS work_lon, coalesce(w.days, 0) AS work_days
  FROM won h LEFT JOIN won w ON w.couple_id = h.couple_id AND w.person = h.person AND w.k = 'work' WHERE h.k = 'home')"""
    pair = "pair AS (SELECT a.couple_id, " + ", ".join(f"{p}.{k}_{c} AS {p}_{k}_{c}" for p in "ab" for k in ("home", "work") for c in ("lat", "lon")) + " FROM anchor a JOIN anchor b ON a.couple_id = b.couple_id AND a.person = 'a' AND b.person = 'b')"
    near = E.distance("b_home_lat", "b_home_lon", "a_home_lat", "a_home_lon")
    x, y = E.plane("lat", "lon", "37.76e0", "-122.44e0")
    days = "label_days AS (SELECT DISTINCT couple_id, ld AS day FROM photos WHERE ph < 3), spans AS (SELECT couple_id, min(day) AS lo, max(day) AS hi FROM (SELECT couple_id, ld AS day, ld - ph AS block FROM photos WHERE ph < 3) GROUP BY couple_id, block)"
    gps = "lat IS NOT NULL AND lon IS NOT NULL"
    grid = []
    for p in [score.DEFAULTS, *({**score.DEFAULTS, k: v} for k, vs in score.AXES.items() for v in vs), *({**score.DEFAULTS, "city_km": c, "max_silence_hours": m} for c in score.AXES["city_km"] for m in score.AXES["max_silence_hours"])]:
        if p not in grid:
            grid.append(p)
    points = ", ".join(f"({k}, {', '.join(f'{v}e0' if isinstance(v, float) else str(v) for v in p.values())})" for k, p in enumerate(grid))
    def tripping(p: dict) -> str:
        """CTEs up to kept_, the trips of one point of the grid: written from the rules, with lists for the photos of a gap
        and a recursive step for each session."""
        precision = p["geohash_precision"]
        mx, my = E.bits(precision)
        lat0, lon0 = E.centre("x", "y", precision)
        city = {q: anchors.inside("lat", "lon", q, f"{p['city_km']:g}e0") for q in "ab"}
        return f"""{keyed(precision)},
wide AS (SELECT DISTINCT couple_id, {E.pmod('x + dx', str(2**mx))} AS x, y + dy AS y, hour_index + dh AS hour_index FROM own,
  (VALUES (-1), (0), (1)) i(dx), (VALUES (-1), (0), (1)) j(dy), (VALUES (-1), (0), (1)) k(dh) WHERE person = 'a' AND y + dy BETWEEN 0 AND {2**my - 1}),
both_ AS (SELECT a.couple_id, a.hour_index, {E.geohash_of_cell('a.x', 'a.y', precision)} AS geohash, {lat0.replace('(x)', '(a.x)').replace('(y)', '(a.y)')} AS lat, {lon0.replace('(x)', '(a.x)').replace('(y)', '(a.y)')} AS lon FROM wide a
  WHERE EXISTS (SELECT 1 FROM own b WHERE b.person = 'b' AND b.couple_id = a.couple_id AND b.x = a.x AND b.y = a.y AND b.hour_index = a.hour_index)), {votes}, {pair},
bits_ AS (SELECT k.*, {near} < 1e0 AS shared, {anchors.inside('lat', 'lon', 'a', '5e0')} AS ba, {anchors.inside('lat', 'lon', 'b', '5e0')} AS bb, {city['a']} AS ca, {city['b']} AS cb FROM both_ k JOIN pair USING (couple_id)),
away_ AS (SELECT *, {E.away('ca', 'cb', 'shared')} AS oot FROM bits_ WHERE {E.away('ba', 'bb', 'shared')}),
marked AS (SELECT *, CASE WHEN hour_index - lag(hour_index) OVER (PARTITION BY couple_id ORDER BY hour_index, geohash) > {p['gap_hours']} THEN 1 ELSE 0 END AS fresh FROM away_),
sess AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY couple_id ORDER BY hour_index, geohash) AS BIGINT) AS session FROM marked),
s_ AS (SELECT couple_id, session, min(hour_index) AS f, max(hour_index) AS l, bool_or(oot) AS town, bool_or(oot AND ca) AS ta, bool_or(oot AND cb) AS tb FROM sess GROUP BY ALL),
g_ AS (SELECT *, (lag(l) OVER w + 1) * 3600 AS lo, f * 3600 AS hi, lag(town) OVER w AS before FROM s_ WINDOW w AS (PARTITION BY couple_id ORDER BY session)),
seen AS (SELECT couple_id, person, utc_epoch AS u, CASE WHEN person = 'a' THEN {city['a']} ELSE {city['b']} END AS home FROM tidy JOIN pair USING (couple_id) WHERE lat IS NOT NULL AND lon IS NOT NULL),
who AS (SELECT DISTINCT couple_id, session, lo, hi, person FROM g_, (VALUES ('a'), ('b')) v(person) WHERE lo IS NOT NULL),
idle AS (SELECT w.couple_id, w.session, w.person, coalesce(bool_or(home), false) AS home, list_sort(list_concat([any_value(w.lo), any_value(w.hi)], list(u) FILTER (u IS NOT NULL))) AS t
  FROM who w LEFT JOIN seen p ON p.couple_id = w.couple_id AND p.person = w.person AND u >= lo AND u < hi GROUP BY ALL),
calm AS (SELECT couple_id, session, bool_or(list_max(list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i])) <= {p['max_silence_hours'] * 3600}) AS steady,
  bool_or(home AND person = 'a') AS ha, bool_or(home AND person = 'b') AS hb FROM idle GROUP BY ALL),
row_ AS (SELECT g_.*, steady, ha, hb FROM g_ LEFT JOIN calm USING (couple_id, session)),
fold_(couple_id, session, trip, ta, tb) AS (SELECT couple_id, session, session, ta, tb FROM row_ WHERE session = 0
  UNION ALL SELECT r.couple_id, r.session, CASE WHEN j THEN o.trip ELSE r.session END, r.ta OR (j AND o.ta), r.tb OR (j AND o.tb)
  FROM fold_ o JOIN row_ r ON r.couple_id = o.couple_id AND r.session = o.session + 1, LATERAL (SELECT r.town AND r.before AND r.steady AND NOT (r.ha AND NOT (r.ta OR o.ta)) AND NOT (r.hb AND NOT (r.tb OR o.tb)) AS j) x),
trip_ AS (SELECT couple_id, trip, min(f) AS f, max(l) AS l, count(*) AS n, min_by(s.town, session) AS first_town, max_by(s.town, session) AS last_town, bool_or(s.ta) AS ta, bool_or(s.tb) AS tb
  FROM fold_ JOIN s_ s USING (couple_id, session) GROUP BY ALL),
next_ AS (SELECT *, lead(f) OVER (PARTITION BY couple_id ORDER BY trip) - 6 AS lim FROM trip_),
after_ AS (SELECT t.couple_id, t.trip, t.l, lim, person, u, home AND NOT (CASE WHEN person = 'a' THEN ta ELSE tb END) AS back, home, CAST(floor(u / 3600) AS BIGINT) AS h FROM next_ t JOIN seen p ON p.couple_id = t.couple_id AND u >= (l + 1) * 3600 WHERE last_town AND {p['tail_gap_hours']} > 0),
cut_ AS (SELECT *, least(min(CASE WHEN back THEN h END) OVER (PARTITION BY couple_id, trip), lim) AS stop FROM after_),
step_ AS (SELECT *, u - lag(u, 1, (l + 1) * 3600) OVER (PARTITION BY couple_id, trip, person ORDER BY u) > {p['tail_gap_hours'] * 3600} OR coalesce(h >= stop, false) AS bad FROM cut_ WHERE NOT home),
run_ AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY couple_id, trip, person ORDER BY u) AS k FROM step_),
tail_ AS (SELECT couple_id, trip, max(h) AS reached FROM run_ WHERE k = 0 GROUP BY ALL),
end_ AS (SELECT t.*, greatest(l, coalesce(reached, l)) AS e FROM next_ t LEFT JOIN tail_ USING (couple_id, trip)),
prev_ AS (SELECT *, lag(e) OVER (PARTITION BY couple_id ORDER BY trip) + 6 AS low FROM end_),
ahead_ AS (SELECT t.couple_id, t.trip, t.f, low, person, u, home AND NOT (CASE WHEN person = 'a' THEN ta ELSE tb END) AS back, home, CAST(floor(u / 3600) AS BIGINT) AS h FROM prev_ t JOIN seen p ON p.couple_id = t.couple_id AND u < f * 3600 WHERE first_town AND {p['tail_gap_hours']} > 0),
cut2_ AS (SELECT *, greatest(max(CASE WHEN back THEN h END) OVER (PARTITION BY couple_id, trip), low) AS stop FROM ahead_),
step2_ AS (SELECT *, lag(u, 1, f * 3600) OVER (PARTITION BY couple_id, trip, person ORDER BY u DESC) - u > {p['tail_gap_hours'] * 3600} OR coalesce(h <= stop, false) AS bad FROM cut2_ WHERE NOT home),
run2_ AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY couple_id, trip, person ORDER BY u DESC) AS k FROM step2_),
head_ AS (SELECT couple_id, trip, min(h) AS reached FROM run2_ WHERE k = 0 GROUP BY ALL),
span_ AS (SELECT t.couple_id, t.trip, f, l, n, f - least(f, coalesce(reached, f)) AS head, e - l AS tail, (least(f, coalesce(reached, f)) - 3) * 3600 AS start_utc, (e + 4) * 3600 AS end_utc FROM prev_ t LEFT JOIN head_ USING (couple_id, trip)),
count_ AS (SELECT s.couple_id, s.trip, count(*) FILTER (p.person = 'a') AS na, count(*) FILTER (p.person = 'b') AS nb FROM span_ s LEFT JOIN tidy p ON p.couple_id = s.couple_id AND p.utc_epoch >= start_utc AND p.utc_epoch < end_utc GROUP BY ALL),
kept_ AS (SELECT s.*, CAST(na AS INTEGER) AS na, CAST(nb AS INTEGER) AS nb FROM span_ s JOIN count_ USING (couple_id, trip) WHERE na + nb >= {p['min_photos']})"""

    recursive = start.replace("WITH ", "WITH RECURSIVE ", 1)
    told = """mine AS (SELECT k.*, z.shared, z.ca, z.cb, z.oot, z.geohash, z.hour_index FROM kept_ k JOIN away_ z ON z.couple_id = k.couple_id AND z.hour_index BETWEEN f AND l),
cell_ AS (SELECT couple_id, trip, geohash, count(*) FILTER (oot) AS no, min(hour_index) FILTER (oot) AS fo, count(*) AS na2, min(hour_index) AS fa FROM mine GROUP BY ALL),
rep_ AS (SELECT couple_id, trip, geohash FROM cell_ QUALIFY row_number() OVER (PARTITION BY couple_id, trip ORDER BY no = 0, CASE WHEN no > 0 THEN -no ELSE -na2 END, coalesce(fo, fa), geohash) = 1),
why_ AS (SELECT couple_id, trip, CAST(count(*) AS INTEGER) AS keys, bool_or(shared) AS shared, bool_or(NOT ca AND NOT cb) AS o, bool_or(ca AND NOT cb) AS a, bool_or(cb AND NOT ca) AS b, bool_or(ca AND cb) AS ab FROM mine GROUP BY ALL)"""
    label = "label_ AS (SELECT row_number() OVER (ORDER BY couple_id, lo) AS id, couple_id, lo * 86400 AS lo, (hi + 1) * 86400 AS hi FROM spans)"
    hours_ = """hour_ AS (SELECT couple_id, unnest(list_concat(list_transform(range(0, head), lambda i: start_utc + 10800 + i * 3600), list_transform(range(0, tail), lambda i: end_utc - 10800 - (tail - i) * 3600))) AS t FROM kept_),
in_ AS (SELECT couple_id, t AS hour_utc, EXISTS (SELECT 1 FROM label_ WHERE label_.couple_id = hour_.couple_id AND t >= lo AND t < hi) AS inside FROM hour_)"""
    met = "met_ AS (SELECT k.couple_id, k.trip, id FROM kept_ k JOIN label_ b ON b.couple_id = k.couple_id AND start_utc < hi AND lo < end_utc)"
    measures = """(SELECT count(*) FROM kept_) AS trips, (SELECT count(*) FROM label_) AS labeled, tp AS true_positives, (SELECT count(*) FROM kept_) - tp AS false_positives, (SELECT count(*) FROM label_) - found AS false_negatives,
  splits, merges, (SELECT count(*) FROM in_ WHERE inside) AS tail_hours_in, (SELECT count(*) FROM in_ WHERE NOT inside) AS tail_hours_out,
  coalesce(round(tp / nullif((SELECT count(*) FROM kept_), 0), 6), 0e0) AS precision, coalesce(round(found / nullif((SELECT count(*) FROM label_), 0), 6), 0e0) AS recall
  FROM (SELECT count(*) AS tp, count(*) FILTER (n > 1) AS merges FROM (SELECT count(*) AS n FROM met_ GROUP BY couple_id, trip)), (SELECT count(*) AS found, count(*) FILTER (n > 1) AS splits FROM (SELECT count(*) AS n FROM met_ GROUP BY id))"""
    base = f"{recursive}, {tripping(score.DEFAULTS)}"
    points_ = " UNION ALL ".join(f"SELECT * FROM ({recursive}, {tripping(p)}, {days}, {label}, {hours_}, {met} SELECT CAST({k} AS INTEGER) AS point, {measures})" for k, p in enumerate(grid))
    part = votes.split("cells_ AS")[0].replace("AND utc_epoch BETWEEN now - 7776000 AND now", "").replace("SELECT t.*,", "SELECT t.*, now,")
    return {
        "match_hashes": f"""{start}, {keyed(6)}, {wide} SELECT DISTINCT couple_id, {E.keyed_hash("concat(geohash, '|', CAST(hour_index AS STRING))", PUBLIC_SALT, 'duckdb')} AS hash FROM both_""",
        "without_home": f"{start}, {votes} SELECT DISTINCT couple_id, person FROM tidy t WHERE NOT EXISTS (SELECT 1 FROM anchor h WHERE h.couple_id = t.couple_id AND h.person = t.person)",
        "era_votes": f"""{start}, {part} c AS (SELECT v.*, now - k * 259200 AS centre FROM voting v, range(0, 40) r(k) WHERE {E.among('lh2', E.EVENING_HOURS)} AND utc_epoch BETWEEN now - k * 259200 - 432000 AND now - k * 259200 + 432000),
n AS (SELECT couple_id, person, centre, {E.geohash_of_cell('vx', 'vy', 7)} AS geohash, count(DISTINCT ld2) AS days, count(*) AS n FROM c GROUP BY ALL)
SELECT couple_id, person, centre, geohash, days FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY couple_id, person, centre ORDER BY days DESC, n DESC, geohash) = 1) WHERE days >= 5""",
        "trips": f"""{base}, {told}
SELECT k.couple_id, start_utc, end_utc, keys AS matched_bucket_count, na AS photo_count_a, nb AS photo_count_b, geohash AS representative_geohash6,
  CASE WHEN shared THEN 'shared home: ' ELSE 'different homes: ' END || concat_ws(' + ', CASE WHEN o THEN 'out of town' END, CASE WHEN shared AND (a OR b OR ab) THEN 'in town' END,
  CASE WHEN NOT shared AND a THEN 'in a''s city' END, CASE WHEN NOT shared AND b THEN 'in b''s city' END, CASE WHEN NOT shared AND ab THEN 'in town' END) || ', ' || n || CASE WHEN n = 1 THEN ' session' ELSE ' sessions' END AS away_reason,
  'trip' AS kind, CAST(head AS INTEGER) AS tail_hours_before, CAST(tail AS INTEGER) AS tail_hours_after FROM kept_ k JOIN rep_ USING (couple_id, trip) JOIN why_ USING (couple_id, trip)""",
        "evaluate": f"{base}, {days}, {label}, {hours_}, {met} SELECT {measures}",
        "tail_hours": f"{base}, {days}, {label}, {hours_} SELECT * FROM in_",
        "sweep": points_,
        "flagship": f"""{start}, {keyed(6)}, {wide}, {sessions},
w AS (SELECT couple_id, session, (min(hour_index) - 3) * 3600 AS start_utc, (max(hour_index) + 4) * 3600 AS end_utc, count(*) AS keys FROM sess GROUP BY couple_id, session)
SELECT w.couple_id, session, start_utc, end_utc, keys, count(CASE WHEN p.person = 'a' THEN 1 END) AS photo_count_a, count(CASE WHEN p.person = 'b' THEN 1 END) AS photo_count_b
FROM w LEFT JOIN tidy p ON p.couple_id = w.couple_id AND p.utc_epoch >= start_utc AND p.utc_epoch < end_utc GROUP BY ALL""",
        "ingest_summary": f"WITH {view} SELECT couple_id, person, count(*) AS n, min(utc_epoch) AS first_utc, max(utc_epoch) AS last_utc, count(*) - count(utc_epoch) AS no_time, count(*) FILTER (lat IS NULL OR lon IS NULL) AS no_gps FROM photos GROUP BY ALL",
        "drop_screenshots": f"WITH {view} SELECT {compass} FROM photos WHERE NOT is_screenshot",
        "drop_missing_timestamp": f"WITH {view} SELECT {compass} FROM photos WHERE utc_epoch IS NOT NULL",
        "collapse_bursts": f"WITH {view} SELECT {compass} FROM photos QUALIFY burst_id IS NULL OR row_number() OVER (PARTITION BY couple_id, person, burst_id ORDER BY is_burst_pick DESC, utc_epoch NULLS LAST, asset_id) = 1",
        "filter_stats": f"""{start} SELECT 'screenshots' AS rule, count(*) FILTER (is_screenshot) AS dropped FROM photos
UNION ALL SELECT 'missing_timestamp', count(*) FILTER (NOT is_screenshot AND utc_epoch IS NULL) FROM photos
UNION ALL SELECT 'bursts', (SELECT count(*) FROM photos WHERE NOT is_screenshot AND utc_epoch IS NOT NULL) - (SELECT count(*) FROM tidy)""",
        **{f"bucket_keys_p{p}": f"{start}, {keyed(p)} SELECT DISTINCT couple_id, geohash, hour_index FROM own" for p in (5, 6, 7)},
        "expand_keys": f"{start}, {keyed(6)}, {wide} SELECT couple_id, geohash, hour_index FROM wide_a",
        "salted_hashes": f"""{start}, {keyed(6)}, u AS (SELECT DISTINCT couple_id, geohash, hour_index FROM own)
SELECT couple_id, {E.keyed_hash("concat(geohash, '|', CAST(hour_index AS STRING))", PUBLIC_SALT, 'duckdb')} AS hash FROM u""",
        "matched_keys": f"{start}, {keyed(6)}, {wide} SELECT couple_id, geohash, hour_index FROM both_",
        "matched_photos_a": f"""{start}, {keyed(6)}, {wide} SELECT {compass} FROM placed p WHERE person = 'a' AND EXISTS (SELECT 1 FROM both_ k WHERE k.couple_id = p.couple_id
  AND abs(k.hour_index - p.hour_index) <= 1 AND abs(k.y - p.y) <= 1 AND {E.pmod('k.x - p.x + 1', str(2**nx))} <= 2)""",
        "matched_photos_b": f"{start}, {keyed(6)}, {wide} SELECT {compass} FROM placed p WHERE person = 'b' AND EXISTS (SELECT 1 FROM both_ k WHERE k.couple_id = p.couple_id AND k.hour_index = p.hour_index AND k.x = p.x AND k.y = p.y)",
        "to_km": f"WITH {view} SELECT {compass}, round({x}, 6) AS east_km, round({y}, 6) AS north_km FROM photos WHERE lat IS NOT NULL",
        "local_time": f"WITH {view} SELECT {compass}, {E.hour_index()} AS hour_index, {E.LOCAL_HOUR} AS local_hour, {E.LOCAL_DAY} AS local_day, {E.weekday(E.LOCAL_DAY)} AS weekday FROM photos",
        "infer_anchors": f"{start}, {votes} SELECT couple_id, person, home_gh AS home_geohash7, work_gh AS work_geohash7, home_days, work_days, home_days < 5 OR work_days < 5 AS weak FROM anchor",
        "is_away": f"""{start}, {votes}, {pair}, bits AS (SELECT p.couple_id, p.person, p.asset_id, {anchors.inside('lat', 'lon', 'a', '5e0')} AS in_a, {anchors.inside('lat', 'lon', 'b', '5e0')} AS in_b, {near} < 1e0 AS shared_home
  FROM tidy p JOIN pair USING (couple_id) WHERE lat IS NOT NULL AND lon IS NOT NULL) SELECT *, {E.away('in_a', 'in_b', 'shared_home')} AS away FROM bits""",
        "sessionize": f"{start}, {keyed(6)}, {wide}, {sessions} SELECT couple_id, geohash, hour_index, session FROM sess",
        "coverage": f"""{start} SELECT count(*) AS total, count(*) FILTER ({gps}) AS with_gps, count(camera_make) AS camera_total, count(*) FILTER (camera_make IS NOT NULL AND {gps}) AS camera_gps,
  count(*) - count(camera_make) AS imported_total, count(*) FILTER (camera_make IS NULL AND {gps}) AS imported_gps FROM tidy""",
        "coverage_by_year": f"{start} SELECT CAST(year(make_timestamp(utc_epoch * 1000000)) AS INTEGER) AS year, count(*) AS total, count(*) FILTER ({gps}) AS with_gps FROM tidy GROUP BY ALL",
        "in_labels": f"{start}, {days} SELECT {compass} FROM tidy t WHERE EXISTS (SELECT 1 FROM spans s WHERE s.couple_id = t.couple_id AND t.utc_epoch >= s.lo * 86400 AND t.utc_epoch < (s.hi + 1) * 86400)",
        "grid": f"SELECT CAST(a AS INTEGER) AS point, CAST(b AS INTEGER) AS gap_hours, CAST(c AS INTEGER) AS geohash_precision, CAST(d AS INTEGER) AS min_photos, CAST(e AS DOUBLE) AS city_km, CAST(f AS INTEGER) AS max_silence_hours, CAST(g AS INTEGER) AS tail_gap_hours, true AS past_homes FROM (VALUES {points}) t(a, b, c, d, e, f, g)",
    }
