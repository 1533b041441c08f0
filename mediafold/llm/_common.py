"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs on one machine."""
    where = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="mediafold-")
        spark.conf.set(CHECKPOINT_DIR, where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage is cut and no executor is needed for it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(work: Work) -> Work:
    """work for mapInArrow that gives unused memory back when a task ends: the Python worker lives on beside the next stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """What runs within sends Python workers ``rows`` rows at a time, or fewer if the session does so already: of whole texts, both sides hold some batches."""
    now = spark.conf.get(BATCH_ROWS)
    if not 0 < int(now) <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, now)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def marked(rows: DataFrame, key: str, some: DataFrame, name: str) -> DataFrame:
    """rows with a column ``name`` that is true for each row whose integer key is among those of some (one column, none null), and for a few others.

    The keys are bits of a bitmap of 2^25 bits, whatever their number, so 4 MB are broadcast at most. With far more keys than bits all
    rows are marked; what follows must be right then too, and only moves more.
    """
    part, bit, bits = (free_name(rows, x) for x in ("part", "bit", "bits"))

    def place(column: Column) -> tuple[Column, Column]:
        h = F.xxhash64(column.cast("long"))
        return F.pmod(h, F.lit(1024)).alias(part), F.pmod(F.shiftright(h, 10), F.lit(32768)).alias(bit)

    maps = some.select(*place(some[some.columns[0]])).groupBy(part).agg(F.bitmap_construct_agg(bit).alias(bits))
    found = rows.select("*", *place(F.col(f"`{key}`"))).join(F.broadcast(maps), part, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    return found.withColumn(name, F.coalesce(there, F.lit(False))).drop(part, bit, bits)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows without those whose integer key is in gone (one column of that name). Only rows that may be in it are shuffled."""
    maybe = free_name(rows, "maybe")
    found = marked(rows, key, gone, maybe)
    rest = found.filter(F.col(maybe)).drop(maybe).join(gone.hint("merge"), key, "left_anti")
    return found.filter(~F.col(maybe)).drop(maybe).unionByName(rest.select(*(F.col(f"`{c}`") for c in rows.columns)))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int, share: int = 1000) -> DataFrame:
    """rows with the columns of their group (groups: one row per value of keys, size_col its number of rows).

    A group with over 1/share of all rows would fill one task, so these, fewer than ``share`` by their definition, are
    broadcast; all other groups are joined by a shuffle. Keys are never null.
    """
    large = groups.filter(F.col(size_col) * share > max(total, share))
    small = groups.filter(F.col(size_col) * share <= max(total, share))
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(large), keys).unionByName(rest.join(small, keys))
