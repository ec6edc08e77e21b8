"""Library rows to photos: what an exporter of a photo library does to the rows that the library hands it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.sources.photos import PHOTO_SCHEMA

#: The type of a screen's picture, and what an offset from UTC can be.
SCREEN_TYPE, MOST_OFFSET_S, OFFSET_STEP_S = "public.png", 14 * 3600, 900


def from_library(rows: DataFrame) -> DataFrame:
    """Photos from rows of (uuid, date, tz_offset_s, lat, lon, screenshot, uti, hidden, shared, burst, burst_selected,
    burst_members, camera_make, camera_model, width, height). Hidden and shared ones are left out; a PNG without a camera's
    make counts as a screenshot; a burst is named by its smallest member. `date` is a timestamp."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    members = F.array_append(F.coalesce("burst_members", F.array().cast("array<string>")), F.col("uuid"))
    values = {
        "asset_id": F.col("uuid"), "utc_epoch": F.floor(F.col("date").cast("double")), "is_screenshot": F.coalesce("screenshot", F.lit(False)) | ((F.col("uti") == SCREEN_TYPE) & blank("camera_make").isNull()),
        "burst_id": F.when(F.col("burst"), F.array_min(members)), "is_burst_pick": F.coalesce("burst_selected", F.lit(False)), "camera_make": blank("camera_make"), "camera_model": blank("camera_model"),
    }
    kept = rows.filter(~F.coalesce("hidden", F.lit(False)) & ~F.coalesce("shared", F.lit(False)))
    return kept.select(*[F.coalesce(values[f.name], F.lit(False)).alias(f.name) if f.name == "is_screenshot" else values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PHOTO_SCHEMA])


def as_exported(photos: DataFrame, own_offset: str = "own_offset_s", phone_offset: str = "phone_offset_s") -> DataFrame:
    """Positions that cannot be are none, both coordinates or neither; a photo's own offset holds if it is one that zones
    have, else the phone's; without a time there is none."""
    there = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    own = F.when((F.abs(own_offset) <= MOST_OFFSET_S) & (F.col(own_offset) % OFFSET_STEP_S == 0), F.col(own_offset))
    offset = F.when(F.col("utc_epoch").isNotNull(), F.coalesce(own, F.col(phone_offset))).cast("int")
    return photos.withColumns({"lat": F.when(there, F.col("lat")), "lon": F.when(there, F.col("lon")), "tz_offset_s": offset})
