"""Geohashes against a bisecting encoder."""

import random

from pyspark.sql import functions as F

from wayfold.functions import exprs as E


def bisected(lat, lon, precision):
    ranges, bits = {0: [-180, 180], 1: [-90, 90]}, []
    for k in range(5 * precision):
        r, v = ranges[k % 2], (lon, lat)[k % 2]
        middle = sum(r) / 2
        bits.append(v >= middle)
        r[0 if v >= middle else 1] = middle
    return "".join(E.ALPHABET[sum(b << (4 - j) for j, b in enumerate(bits[i : i + 5]))] for i in range(0, len(bits), 5))


def test_against_bisection(spark):
    rng = random.Random(1)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    df = spark.createDataFrame(places, "lat double, lon double")
    for p in (5, 6, 7):
        x, y = E.cell("lat", "lon", p)
        rows = df.withColumns({"x": F.expr(x), "y": F.expr(y)}).withColumn("g", F.expr(E.geohash_of_cell("x", "y", p))).collect()
        assert all(r.g == bisected(r.lat, r.lon, p) for r in rows)
