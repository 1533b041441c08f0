"""Directory trees as DataFrames.

``walk`` keeps what a directory has: hidden files, files of no bytes, names with a leading underscore; links below the roots are left out,
a root that is a link is followed. The driver lists names only; headers, sizes and hashes are read by the tasks. For trees in
an object store use ``stored_files``, which reads by Spark's own reader.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.functions.sniff import HEADER_BYTES, kind_of, mime_of

BLOCK = 1 << 20


class InputError(RuntimeError):
    """A path that can't be listed, or no file at all."""


def walk(roots: Iterable[str]) -> list[str]:
    """All regular files below the roots, in path order; a root given twice counts twice."""
    found: list[str] = []
    for root in roots:
        try:
            kind = os.stat(root).st_mode
            todo = [root] if stat.S_ISDIR(kind) else []
            if stat.S_ISREG(kind):
                found.append(root)
            while todo:
                with os.scandir(todo.pop()) as entries:
                    for e in entries:
                        if e.is_symlink():
                            continue
                        if e.is_dir(follow_symlinks=False):
                            todo.append(e.path)
                        elif e.is_file(follow_symlinks=False):
                            found.append(e.path)
        except OSError as e:
            raise InputError(f"{root}: {e.strerror}") from e
    return sorted(found, key=lambda p: p.split("/"))


def _facts(with_hash: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                header = size = mtime = digest = error = None
                try:
                    with open(path, "rb") as f:
                        header = f.read(32)  # unreadable: of no known kind, so left out
                        s = os.stat(path)
                        size, mtime = s.st_size, max(0, int(s.st_mtime))
                        if with_hash and header:
                            h = hashlib.sha256(header)
                            while block := f.read(BLOCK):
                                h.update(block)
                            digest = h.hexdigest()
                except OSError as e:
                    if header is not None:
                        error = f"{path}: {e.strerror}"
                rows.append((path, header, size, mtime, digest, error))
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["path", "header", "bytes", "mtime", "sha256", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return run


def local_files(spark: SparkSession, paths: list[str], tasks: int | None = None, with_hash: bool = True) -> DataFrame:
    """path, header (32 bytes; null if unreadable), bytes, mtime, sha256 and error of files that all executors can open."""
    tasks = tasks or max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    return rows.mapInArrow(_facts(with_hash), "path string, header binary, bytes long, mtime long, sha256 string, error string")


def stored_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The same from any store that Spark reads; hidden and empty files are not seen. Rows are at most 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.substring("content", 1, 32).alias("header"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("mtime"),
        F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("error"), "content",
    )


def with_kind(files: DataFrame) -> DataFrame:
    """files with mime and type; those of no known kind are left out."""
    files = files.withColumn("mime", mime_of(F.substring("header", 1, HEADER_BYTES)))
    return files.filter("mime IS NOT NULL").withColumn("type", kind_of(F.col("mime")))


def skipped(files: DataFrame) -> DataFrame:
    return files.filter(mime_of(F.col("header")).isNull()).select("path")
