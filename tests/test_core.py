"""Known answers of the scalar expressions, rules at their boundaries, and queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold import queries
from wayfold.functions import exprs as E
from wayfold.operators import clean, presence, trips

SF = "/root/testdata/sf0.001"


def one(spark, text):
    return spark.range(1).select(F.expr(text).alias("v")).first().v


def test_known_hashes(spark):
    salt = bytes(range(32))
    assert one(spark, E.keyed_hash("'9q8yyk|495475'", salt)) == "51b474d370b9cd457d09cc95d334098d"
    assert one(spark, E.keyed_hash("'9q8yyk|-1'", salt)) == "5319a57ce6b91f855f0ff47accfee37a"
    with pytest.raises(ValueError):
        E.keyed_hash("'x'", b"short")


def test_floors_before_1970(spark):
    assert one(spark, E.hour_index("-1")) == -1 and one(spark, E.weekday("0")) == 3


def test_geohash_corners(spark):
    for lat, lon, want in (("37.76e0", "-122.44e0", "9q8yvc"), ("90e0", "180e0", "zzzzzz"), ("-90e0", "-180e0", "000000")):
        x, y = E.cell(lat, lon, 6)
        assert one(spark, E.geohash_of_cell(x, y, 6))[:4] == want[:4]


def test_session_gap(spark):
    for hours, n in (((10, 16), 1), ((10, 17), 2)):
        keys = spark.createDataFrame([(1, "9q8yyk", h) for h in hours], "couple_id long, geohash string, hour_index long")
        assert trips.sessionize(keys).select("session").distinct().count() == n


def test_matching_is_blind(spark):
    bad = spark.createDataFrame([(1, "x", 2.0)], "couple_id long, hash string, lat double")
    with pytest.raises(ValueError):
        presence.match(bad, bad)


def test_first_rule_counts_once(spark):
    rows = [(1, "a", "1", None, True, None, False), (1, "a", "2", None, False, "b", True), (1, "a", "3", 5, False, "b", False), (1, "a", "4", 4, False, "b", False)]
    df = spark.createDataFrame(rows, "couple_id long, person string, asset_id string, utc_epoch long, is_screenshot boolean, burst_id string, is_burst_pick boolean")
    assert {r.rule: r.dropped for r in clean.filter_stats(df).collect()} == {"screenshots": 1, "missing_timestamp": 1, "bursts": 1}
    assert [r.asset_id for r in clean.clean(df).collect()] == ["4"]


def test_reach_must_fit_gap(spark):
    with pytest.raises(ValueError):
        trips.Knobs(gap_hours=4, reach_hours=3).check()


@pytest.mark.parametrize("name", ["filter_stats", "bucket_keys_p6", "salted_hashes", "sessionize", "infer_anchors", "in_labels", "grid"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in want.fetchall()]
    assert sorted(map(str, rows)) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
