"""What the operators of this subpackage share: table reading, shared scratch tables, batch walking."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at a time inside one Arrow batch, so that Python objects stay few whatever the batch.
SLICE_ROWS = 512
#: Bytes of text handled at a time; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20
KEPT = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.
    Where neither is set, a local session (tests, one machine) has one made for it; a cluster is refused, since
    executors would not see the driver's folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wayfold-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Rows of an id and a few numbers that may go to every task, after they have been counted.
BROADCAST_ROWS = 200_000


def small(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has been found to have few."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


class Scratch:
    """Parquet tables in the shared folder that cut lineage; `drop` frees those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.made, self.count = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", {}, 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}-{name}"
        df.write.parquet(path)
        self.made.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            for path in self.made.get(name, []):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            self.made[name] = []
        gc.collect()  # queries that have ended hold shuffle files until they are collected
        jvm.System.gc()

    def drop_older(self, name: str) -> None:
        """Drops all but the newest table of this name."""
        newest = self.made[name][-1]
        self.made[name] = self.made[name][:-1]
        self.drop(name)
        self.made[name] = [newest]


def parts_of(spark: SparkSession) -> int:
    """Partitions for rows that Python or an expansion makes heavy: the shuffle's number, and at least
    four for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Python is handed at most so many rows at a time: for rows of many kilobytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keep_freed() -> None:
    """Lets this process keep up to `KEPT` bytes that it has freed for what it allocates next, where the C library is glibc.
    Arrays of a few megabytes would else be mapped anew, and their pages cleared, each time that one is made."""
    with suppress(OSError, AttributeError):
        adjust = ctypes.CDLL(None).mallopt
        adjust(-3, KEPT // 2)  # M_MMAP_THRESHOLD
        adjust(-1, KEPT)  # M_TRIM_THRESHOLD


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under names that cannot clash; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in pieces of few rows and bytes, each with its texts as UTF-8 bytes, null as empty."""
    column = pa.compute.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()), b"")
    lengths = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        stop, total = start, 0
        while stop < batch.num_rows and stop - start < SLICE_ROWS and (total == 0 or total + lengths[stop] <= SLICE_BYTES):
            total += int(lengths[stop])
            stop += 1
        yield batch.slice(start, stop - start), column.slice(start, stop - start).to_pylist()
        start = stop


def words(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space (\\x20, \\x09-\\x0D)."""
    return text.lower().split()


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the labelled operators."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
