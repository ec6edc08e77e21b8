"""Filters and burst collapsing, with the count of what each rule dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULES = ("screenshots", "missing_timestamp", "bursts")
OWNER = ("couple_id", "person")


def drop_screenshots(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_screenshot"))


def drop_missing_timestamp(df: DataFrame) -> DataFrame:
    return df.filter(F.col("utc_epoch").isNotNull())


def _rank(*keys: str) -> F.Column:
    """A burst member's place among its burst: its pick, then the earliest, then the smallest id. A photo without a
    burst is one of its own, so that such photos never meet in one window partition."""
    alone = F.when(F.col("burst_id").isNull(), F.col("asset_id"))
    w = Window.partitionBy(*OWNER, "burst_id", alone, *keys).orderBy(F.desc("is_burst_pick"), F.asc_nulls_last("utc_epoch"), "asset_id")
    return F.when(F.col("burst_id").isNotNull(), F.row_number().over(w)).otherwise(1)


def with_rule(df: DataFrame) -> DataFrame:
    """Adds `rule`, the first that drops the row, or null. Bursts are ranked among what the earlier rules leave."""
    early = F.when(F.col("is_screenshot"), RULES[0]).when(F.col("utc_epoch").isNull(), RULES[1])
    marked = df.withColumn("_early", early).withColumn("_rank", _rank("_early"))
    return marked.withColumn("rule", F.coalesce("_early", F.when(F.col("_rank") > 1, RULES[2]))).drop("_early", "_rank")


def collapse_bursts(df: DataFrame) -> DataFrame:
    return df.withColumn("_rank", _rank()).filter("_rank = 1").drop("_rank")


def clean(df: DataFrame) -> DataFrame:
    kept = df.filter("NOT is_screenshot AND utc_epoch IS NOT NULL")  # the first two rules, as far down as the scan
    return collapse_bursts(kept)


def filter_stats(df: DataFrame) -> DataFrame:
    """(rule, dropped) for every rule, zeros included."""
    rules = df.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    counts = with_rule(df).filter("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"))
    return rules.join(counts, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("dropped"))


def ingest_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(*OWNER).agg(
        F.count("*").alias("n"), F.min("utc_epoch").alias("first_utc"), F.max("utc_epoch").alias("last_utc"),
        F.count_if(F.col("utc_epoch").isNull()).alias("no_time"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("no_gps"),
    )
