"""Blind matching of two partners' hashes, and the way back to keys and photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import exprs as E
from wayfold.operators.cells import CELL, PRECISION, named, neighbourhood, own_cells, salted, with_cell


def match(hashes_a: DataFrame, hashes_b: DataFrame) -> DataFrame:
    """Hashes that both partners of a couple have; both inputs hold (couple_id, hash) and nothing else."""
    for side in (hashes_a, hashes_b):
        if set(side.columns) != {"couple_id", "hash"}:
            raise ValueError("matching sees couple_id and hash alone")
    return hashes_a.join(hashes_b, ["couple_id", "hash"], "left_semi").distinct()


def hashes(photos: DataFrame, person: str, salt: bytes, precision: int = PRECISION) -> DataFrame:
    """(couple_id, x, y, hour_index, geohash, hash) of one partner's keys; a's are widened by their neighbourhood."""
    return salted(named(own_cells(photos.filter(F.col("person") == person), person == "a", precision), precision), salt)


def matched_keys(photos: DataFrame, salt: bytes, precision: int = PRECISION) -> DataFrame:
    """Partner a's keys, widened, that b has too: a's hashes that are among b's, and on a's side the keys that
    they stand for. Nothing of b's but hashes is looked at, and a's keys are made once."""
    theirs = hashes(photos, "b", salt, precision).select("couple_id", "hash")
    return hashes(photos, "a", salt, precision).join(theirs, ["couple_id", "hash"], "left_semi").select("couple_id", "x", "y", "geohash", "hour_index").distinct()


def matched_within(photos: DataFrame, salt: bytes, precision: int, matched: DataFrame, coarser: int) -> DataFrame:
    """The same as `matched_keys`, if those of a coarser precision are known: a key that matches lies in a coarser one
    that does, as cells are halved exactly. Only keys there, of either partner, are hashed."""
    (fx, fy), (cx, cy) = E.bits(precision), E.bits(coarser)
    inside = {"tx": F.shiftright(F.pmod("x", F.lit(2**fx)), fx - cx), "ty": F.shiftright("y", fy - cy)}
    targets = matched.select("couple_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("hour_index").alias("th")).distinct()
    own = lambda p: own_cells(photos.filter(F.col("person") == p), False, precision)
    theirs = own("b").withColumns(inside).withColumn("th", F.col("hour_index")).join(targets, ["couple_id", "tx", "ty", "th"], "left_semi")
    theirs = salted(named(theirs, precision), salt).select("couple_id", "hash")
    # Seen from a target, the coarser cells and hours whose keys reach it.
    steps = lambda name: F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias(name)
    reach = targets.select("*", steps("dx")).select("*", steps("dy")).select("*", steps("dh"))
    reach = reach.select("couple_id", "tx", "ty", "th", F.pmod(F.col("tx") + F.col("dx"), F.lit(2**cx)).alias("px"), (F.col("ty") + F.col("dy")).alias("py"), (F.col("th") + F.col("dh")).alias("hour_index"))
    mine = own("a").withColumns(inside).withColumnsRenamed({"tx": "px", "ty": "py"}).join(reach.distinct(), ["couple_id", "px", "py", "hour_index"])
    mine = mine.select("couple_id", "x", "y", "tx", "ty", F.col("th").alias("hour_index"), steps("dx")).select("*", steps("dy"))
    mine = mine.withColumns({"x": F.pmod(F.col("x") + F.col("dx"), F.lit(2**fx)), "y": F.col("y") + F.col("dy")})
    mine = mine.filter((F.col("y").between(0, 2**fy - 1)) & (inside["tx"] == F.col("tx")) & (inside["ty"] == F.col("ty"))).select(*CELL).distinct()
    mine = salted(named(mine, precision), salt)
    return mine.join(theirs, ["couple_id", "hash"], "left_semi").select("couple_id", "x", "y", "geohash", "hour_index").distinct()


def matched_photos(photos: DataFrame, keys: DataFrame, expanded: bool) -> DataFrame:
    """Photos whose cell, or with `expanded` whose neighbourhood, holds a matched key; each once. The few matched keys
    are widened, not the photos: a neighbourhood is the same seen from either side."""
    cells = keys.select(*CELL)
    wide = neighbourhood(cells).distinct() if expanded else cells.distinct()
    return with_cell(photos).join(wide, list(CELL), "left_semi").select("couple_id", "person", "asset_id")
