"""The pipeline from photos to scored trips, for all couples at once."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import exprs as E
from wayfold.functions.tables import Steps
from wayfold.operators import anchors, clean, homes, presence, score, trips
from wayfold.operators.trips import Knobs
from wayfold.sources import photos as source


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(source.photos(spark, sf_dir))


def centred(keys: DataFrame, precision: int) -> DataFrame:
    """Keys with the middle of their own cell, by which they are judged."""
    lat, lon = E.centre("x", "y", precision)
    return keys.withColumns({"c_lat": F.expr(lat), "c_lon": F.expr(lon)}).drop("x", "y")


def settings_of(photos: DataFrame, found: DataFrame, past_homes: bool, steps: Steps) -> DataFrame:
    """Both partners' homes over time, from anchors (see `homes.settings`); without past homes, one setting. Settings read
    eras three times, so these are a step."""
    pairs = anchors.couples(found)
    return homes.settings(steps.write(homes.home_eras(photos, found), "eras"), pairs) if past_homes else homes.always(pairs)


def trips_of(photos: DataFrame, salt: bytes, precision: int = 6, knobs: Knobs = Knobs(), past_homes: bool = True, found: DataFrame | None = None) -> DataFrame:
    """Trips and old-home days of all couples. found: anchors, if they are not to be inferred; with a column
    `shared_home` (null: by distance) to override whether partners share a home."""
    knobs.check()
    steps = Steps(photos.sparkSession)
    photos = steps.write(photos, "photos")  # read by anchors, keys, gaps and back-filling
    found = steps.write(anchors.infer_anchors(photos) if found is None else found, "anchors")
    keys = centred(presence.matched_keys(photos, salt, precision), precision)
    return trips.assemble(photos, keys, settings_of(photos, found, past_homes, steps), knobs)


def sweep(photos: DataFrame, labels: DataFrame, salt: bytes, points: list[dict], found: DataFrame | None = None) -> DataFrame:
    """One row of scores for each point; a point is a row of `score.grid`. All points are one query: keys are matched once
    for each precision, the finer ones within the coarser, and judged once for each precision and city; from there on
    `point` is a key beside the couple. Points that differ in min_photos alone are assembled once. Old-home days, cells and
    reasons are not scored, and so not made."""
    for p in points:
        Knobs(**{f.name: p[f.name] for f in fields(Knobs) if f.name in p}).check()
    spark, steps = photos.sparkSession, Steps(photos.sparkSession)
    photos, labels = steps.write(photos, "photos"), steps.write(labels, "labels")
    found = steps.write(anchors.infer_anchors(photos) if found is None else found, "anchors")
    precisions = sorted({p["geohash_precision"] for p in points})
    matched = {}
    for k, p in enumerate(precisions):
        coarser = precisions[k - 1]
        matched[p] = steps.write(presence.matched_within(photos, salt, p, matched[coarser], coarser) if k else presence.matched_keys(photos, salt, p), f"matched{p}")
    keys = reduce(DataFrame.union, [centred(matched[p], p).withColumn("geohash_precision", F.lit(p)) for p in precisions])
    rows = lambda ps: spark.createDataFrame([tuple(p[c] for c in score.POINT) for p in ps], score.POINT_SCHEMA)
    # For all but min_photos the first of the points, with the least min_photos.
    alike: dict[tuple, list[dict]] = {}
    for p in points:
        alike.setdefault(tuple(p[c] for c in score.POINT if c not in ("point", "min_photos")), []).append(p)
    grid = rows([{**ps[0], "min_photos": min(p["min_photos"] for p in ps)} for ps in alike.values()])
    each = spark.createDataFrame([(ps[0]["point"], p["point"], p["min_photos"]) for ps in alike.values() for p in ps], "point int, own int, least int")
    parts = []
    for past in sorted({p["past_homes"] for p in points}):
        mine = grid.filter(F.col("past_homes") == past).drop("past_homes")
        areas = spark.createDataFrame(sorted({(p["geohash_precision"], float(p["city_km"])) for p in points if p["past_homes"] == past}), "geohash_precision int, city_km double")
        settings = steps.write(settings_of(photos, found, past, steps), f"settings{past}")
        judged = steps.write(trips.judged(keys.join(F.broadcast(areas), "geohash_precision"), settings, old_homes=False), f"judged{past}")
        dealt = judged.join(F.broadcast(mine), ["geohash_precision", "city_km"]).drop("geohash_precision")
        parts.append(trips.assemble(photos, dealt, settings, by=("point", "couple_id"), for_scores=True))
    found_ = steps.write(reduce(DataFrame.union, parts), "found")
    scored = found_.join(F.broadcast(each), "point").filter("photo_count_a + photo_count_b >= least").drop("point", "least").withColumnRenamed("own", "point")
    return score.evaluate_points(scored, labels, rows(points))
