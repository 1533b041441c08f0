"""Vectors kept under the key of what they were made from, so nothing is computed twice.

A store is a folder of Parquet folders, each written once beside and renamed to its place, so readers see whole ones only. An entry is a key and the vector's numbers
as little-endian 32-bit floats. An entry counts only if it has as many bytes as the dimension asks for; others are computed again, and
what is found twice is the same by its key. A store that can't be written is no failure: the vectors are computed and handed on.

Defined cases: a null key has no vector; rows of equal keys share one computation; a store that isn't there is empty; a compute function that leaves a key out, or gives it a null or another length, leaves
it without a vector; an empty table computes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediafold.scratch import new_path

ENTRY = "key string, data binary"


@F.pandas_udf(T.BinaryType())
def _bytes_of(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def packed_floats(vector: Column) -> Column:
    """Numbers as little-endian 32-bit floats, one after the other; a null vector, or one with a null, is null."""
    return F.when(F.forall(vector, lambda x: x.isNotNull()), _bytes_of(vector.cast("array<float>")))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked_floats(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def content_key(model: Column, *contents: Column) -> Column:
    """16 hexadecimal digits that the model's name and the contents, in this order, decide; null if any of them is."""
    return F.left(F.sha2(F.concat(model, *(F.concat(c.cast("string"), F.lit("\0")) for c in contents)), 256), F.lit(16))


class VectorCache:
    def __init__(self, spark, path: str, dim: int) -> None:
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim

    def _folders(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(str(s.getPath()) for s in fs.listStatus(p) if not s.getPath().getName().startswith("_")) if fs.exists(p) else []

    def entries(self) -> DataFrame:
        """key and data of the whole entries, one a key."""
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*folders).filter(F.octet_length("data") == 4 * self.dim).groupBy("key").agg(F.min("data").alias("data"))

    def keep(self, made: DataFrame) -> bool:
        """Writes entries beside and renames the folder; whether that could be done."""
        name = uuid.uuid4().hex
        try:
            made.select("key", "data").write.parquet(f"{self.path}/_{name}")
            jvm = self.spark._jvm.org.apache.hadoop.fs
            beside, final = jvm.Path(f"{self.path}/_{name}"), jvm.Path(f"{self.path}/{name}")
            return beside.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(beside, final)
        except (PySparkException, Py4JJavaError):
            return False

    def vectors(self, rows: DataFrame, key_col: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows with vector (array<float>) and hit, whether it was there before. compute: of rows with distinct keys, those missing, a table of key and vector."""
        known = self.entries()
        missing = rows.filter(F.col(key_col).isNotNull()).join(known.select(F.col("key").alias(key_col)), key_col, "left_anti").dropDuplicates([key_col])
        made = compute(missing).select(F.col("key").cast("string").alias("key"), packed_floats(F.col("vector")).alias("data")).filter(F.octet_length("data") == 4 * self.dim)
        path = new_path(self.spark, "computed")
        made.write.parquet(path)  # computed once, whether it can be kept or not
        made = self.spark.read.schema(ENTRY).parquet(path)
        if not made.isEmpty():
            self.keep(made)
        all_ = known.withColumn("hit", F.lit(True)).unionByName(made.withColumn("hit", F.lit(False))).withColumnRenamed("key", key_col)
        return rows.join(all_, key_col, "left").withColumn("vector", unpacked_floats("data")).withColumn("hit", F.coalesce("hit", F.lit(False))).select(*(F.col(f"`{c}`") for c in rows.columns), "vector", "hit")


def by_batches(embed: Callable[[list[bytes]], np.ndarray], content_col: str, key_col: str) -> Callable[[DataFrame], DataFrame]:
    """A compute function from one that turns contents into a matrix, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.asarray(embed(batch.column(1).to_pylist()), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(matrix), pa.list_(pa.float32()))], ["key", "vector"])

    return lambda rows: rows.select(F.col(key_col).cast("string").alias("key"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, "key string, vector array<float>")
