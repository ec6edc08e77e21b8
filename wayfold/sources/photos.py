"""Photo metadata: the pinned schema, CSV and Parquet edges, labels, and the photo view over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a photo file, in order.
PHOTO_SCHEMA = T.StructType([
    T.StructField("asset_id", T.StringType()), T.StructField("utc_epoch", T.LongType()), T.StructField("tz_offset_s", T.IntegerType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("is_screenshot", T.BooleanType()),
    T.StructField("burst_id", T.StringType()), T.StructField("is_burst_pick", T.BooleanType()), T.StructField("camera_make", T.StringType()),
    T.StructField("camera_model", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
])
LABEL_COLUMNS = ("label", "start_date", "end_date", "place")


def check_header(df: DataFrame, columns: tuple[str, ...] = tuple(PHOTO_SCHEMA.names)) -> None:
    found = tuple(c.strip() for c in df.columns)
    if found != columns:
        raise ValueError(f"expected columns {columns}, found {found}")


def _typed(field: T.StructField) -> F.Column:
    raw = F.nullif(F.col(field.name), F.lit(""))  # text cells keep their blanks
    if isinstance(field.dataType, T.BooleanType):
        low = F.lower(F.coalesce(F.nullif(F.trim(F.col(field.name)), F.lit("")), F.lit("0")))
        bad = F.raise_error(F.concat(F.lit(f"bad boolean in {field.name}: "), low)).cast("boolean")
        return F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False).otherwise(bad)
    if field.name == "asset_id":
        return F.when(raw.isNull(), F.raise_error(F.lit("empty asset_id"))).otherwise(raw)
    return raw if isinstance(field.dataType, T.StringType) else F.trim(raw).cast(field.dataType)


def read_photos_csv(spark: SparkSession, path: str) -> DataFrame:
    """A photo CSV: header pinned, empty is null, a bad cell or a short row fails the read."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=False)
    check_header(raw)
    return raw.select(*[_typed(f).alias(f.name) for f in PHOTO_SCHEMA])


def format_photos(df: DataFrame) -> DataFrame:
    """Text cells as in the file: positions with six decimals, booleans as 1 or 0, null as empty."""
    def cell(f: T.StructField) -> F.Column:
        if isinstance(f.dataType, T.DoubleType):
            text = F.format_string("%.6f", F.col(f.name))
        else:
            text = F.col(f.name).cast("int").cast("string") if isinstance(f.dataType, T.BooleanType) else F.col(f.name).cast("string")
        return F.when(F.col(f.name).isNull(), "").otherwise(text).alias(f.name)

    return df.select(*[cell(f) for f in PHOTO_SCHEMA])


def write_photos_csv(df: DataFrame, path: str) -> None:
    format_photos(df).write.csv(path, header=True, emptyValue="", quote='"', escape='"')


def read_photos_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    check_header(df)
    return df.select(*[(F.nanvl(F.col(f.name), F.lit(None).cast("double")) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).cast(f.dataType)).alias(f.name) for f in PHOTO_SCHEMA])


def write_photos_parquet(df: DataFrame, path: str) -> None:
    """The pinned columns and types, in order."""
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PHOTO_SCHEMA]).write.parquet(path)


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    check_header(raw, LABEL_COLUMNS)
    day = lambda c: F.to_date(F.trim(c), "yyyy-MM-dd")
    out = raw.select(F.trim("label").alias("label"), day("start_date").alias("start_date"), day("end_date").alias("end_date"), F.trim("place").alias("place"))
    order = F.when(F.col("end_date") < F.col("start_date"), F.raise_error(F.lit("a label ends before it starts")).cast("date")).otherwise(F.col("end_date"))
    return out.withColumn("end_date", order)


def photo_view(epoch: str) -> str:
    """SQL that reads `events` as photos of couples: users 2k and 2k + 1 are partners a and b, every third
    couple has two homes, three days in ten are away. epoch: the engine's expression for whole seconds."""
    return f"""e AS (SELECT event_id, user_id, event_type, {epoch} AS u, CAST(floor(user_id / 2) AS BIGINT) AS couple_id,
  CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS person FROM events),
d AS (SELECT *, CAST(floor((u - 25200) / 86400) AS BIGINT) AS ld, CAST(floor((u - 25200) / 3600) AS BIGINT) % 24 AS lh FROM e),
p AS (SELECT *, (ld + 3 * couple_id) % 10 AS ph, (event_id % 5 - 2) * 2e-4 AS j,
  37.76e0 + (couple_id % 5) * 2e-2 + CASE WHEN couple_id % 3 = 0 AND person = 'b' THEN 5e-1 ELSE 0e0 END AS hlat FROM d),
q AS (SELECT *, CASE WHEN ph IN (0, 1, 2) THEN 39.1e0 + (couple_id % 4) * 3e-1
    WHEN lh BETWEEN 10 AND 15 AND (ld + 3) % 7 < 5 THEN hlat + 3e-2 ELSE hlat END + j AS lat0,
  CASE WHEN ph IN (0, 1, 2) THEN -120.03e0 WHEN lh BETWEEN 10 AND 15 AND (ld + 3) % 7 < 5 THEN -122.4e0 ELSE -122.44e0 END - j AS lon0 FROM p),
photos AS (SELECT couple_id, person, concat('E-', lpad(CAST(event_id AS STRING), 9, '0')) AS asset_id,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE u END AS utc_epoch,
  CASE WHEN event_id % 89 = 0 OR event_id % 97 = 0 THEN NULL ELSE -25200 END AS tz_offset_s,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE lat0 END AS lat, CASE WHEN event_id % 13 = 0 THEN NULL ELSE lon0 END AS lon,
  event_id % 41 = 0 AS is_screenshot,
  CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN concat('b-', CAST(user_id AS STRING), '-', CAST(ld AS STRING)) END AS burst_id,
  event_id % 6 = 0 AS is_burst_pick, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'Apple' END AS camera_make,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'iPhone 15' END AS camera_model, 4032 AS width, 3024 AS height, ld, ph FROM q)"""


SPARK_EPOCH = "unix_seconds(CAST(ts AS TIMESTAMP))"
DUCKDB_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photo view, with the local day and phase (ld, ph) that labels are made from."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(f"WITH {photo_view(SPARK_EPOCH)} SELECT * FROM photos".replace("FROM events)", "FROM {events})"), events=events)


def labels(photos_: DataFrame) -> DataFrame:
    """One label per couple and away block: (couple_id, label, start_date, end_date), from local days."""
    block = F.col("ld") - F.col("ph")
    days = photos_.filter("ph < 3").groupBy("couple_id", block.alias("block")).agg(F.min("ld").alias("lo"), F.max("ld").alias("hi"))
    return days.select("couple_id", F.concat(F.lit("away "), F.col("block").cast("string")).alias("label"), F.date_from_unix_date(F.col("lo").cast("int")).alias("start_date"), F.date_from_unix_date(F.col("hi").cast("int")).alias("end_date"))
