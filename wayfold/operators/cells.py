"""Cells of place and hour: keys, their neighbourhoods, and their salted hashes.

Keys are numbers (column and row of the cell, hour) until a name is needed: the hashed message and the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import exprs as E

#: Fixed value: cells of place are geohashes of six characters unless told otherwise.
PRECISION = 6
CELL = ("couple_id", "x", "y", "hour_index")


def with_cell(df: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Adds x, y and hour_index; drops rows without position or time."""
    x, y = E.cell("lat", "lon", precision)
    placed = df.filter("lat IS NOT NULL AND lon IS NOT NULL AND utc_epoch IS NOT NULL")
    return placed.withColumns({"x": F.expr(x), "y": F.expr(y), "hour_index": F.expr(E.hour_index())})


def named(keys: DataFrame, precision: int = PRECISION) -> DataFrame:
    return keys.withColumn("geohash", F.expr(E.geohash_of_cell("x", "y", precision)))


def neighbourhood(keys: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Each key's cell and its eight neighbours (fewer at a pole) in the hours before, of and after it."""
    nx, ny = E.bits(precision)
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dh).alias("dh")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dh in (-1, 0, 1)])
    out = keys.select("*", F.explode(near).alias("_d")).filter(f"y + _d.dy BETWEEN 0 AND {2**ny - 1}")
    moved = {"x": F.pmod(F.col("x") + F.col("_d.dx"), F.lit(2**nx)), "y": F.col("y") + F.col("_d.dy"), "hour_index": F.col("hour_index") + F.col("_d.dh")}
    return out.withColumns(moved).drop("_d")


def own_cells(photos: DataFrame, expanded: bool, precision: int = PRECISION) -> DataFrame:
    """(couple_id, x, y, hour_index); distinct before it is expanded, and not again after."""
    keys = with_cell(photos, precision).select(*CELL).distinct()
    return neighbourhood(keys, precision) if expanded else keys


def own_keys(photos: DataFrame, expanded: bool, precision: int = PRECISION) -> DataFrame:
    """(couple_id, x, y, geohash, hour_index) distinct."""
    keys = own_cells(photos, expanded, precision)
    return named(keys.distinct() if expanded else keys, precision).select("couple_id", "x", "y", "geohash", "hour_index")


def salted(keys: DataFrame, salt: bytes) -> DataFrame:
    """Adds `hash`, the only thing of a key that may leave its owner. The salt is both partners' secret: whoever
    has it can enumerate the keys."""
    return keys.withColumn("hash", F.expr(E.keyed_hash("concat(geohash, '|', CAST(hour_index AS STRING))", salt)))
