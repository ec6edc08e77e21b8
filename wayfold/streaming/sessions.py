"""Sessions of located hours over a stream of photos; the same boundaries as the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.trips import GAP_HOURS


def stream_sessions(photos: DataFrame, gap_hours: int = GAP_HOURS, late: str = "2 hours") -> DataFrame:
    """(couple_id, first_hour, last_hour, photos): hours whose difference is at most gap_hours share a
    session. photos: a streaming or static frame with couple_id and utc_epoch. State is one open session
    per couple, dropped when the watermark passes it."""
    hour = F.timestamp_seconds(F.floor(F.col("utc_epoch") / 3600) * 3600)
    timed = photos.filter("utc_epoch IS NOT NULL").select("couple_id", hour.alias("hour")).withWatermark("hour", late)
    # A gap of one second more than gap_hours merges hours that far apart, and none farther.
    session = F.session_window("hour", f"{gap_hours * 3600 + 1} seconds")
    found = timed.groupBy("couple_id", session.alias("s")).agg(F.max("hour").alias("last"), F.count("*").alias("photos"))
    to_hour = lambda c: (F.unix_seconds(c) / 3600).cast("long")
    return found.select("couple_id", to_hour(F.col("s.start")).alias("first_hour"), to_hour(F.col("last")).alias("last_hour"), "photos")
