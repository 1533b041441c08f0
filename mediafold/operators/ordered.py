"""One ordered document out of many rows, without a task that holds them all.

The blocks are made once, into a table, and sorted by range into parts, where each row gets its place and its size. Each part's number of rows and of bytes are added up over the parts before it, in groups of
``BASE`` parts, groups of groups and so on; within a part a running sum gives each row's own. So every row knows its position in the
whole and the byte at which its piece begins, and any task can write it there. Only the pieces themselves need the blocks again: positions, offsets and lengths come from the sizes. A piece is the block with what goes before it: an opening bracket
or a separator; the last piece has the closing bracket too.

Defined cases: rows of equal keys are in the order of their blocks, equal ones side by side; a null block has no piece and no position; null keys come first; no rows
give the two brackets alone.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediafold.scratch import drop_written, written

BASE = 1024


@dataclass(frozen=True)
class Frame:
    """What stands before the first block, between two and after the last one."""

    head: str = ""
    separator: str = ""
    tail: str = ""


# How blocks of each kind are joined.
FRAMES = {"json": Frame("[\n", ",\n", "\n]"), "markdown": Frame(), "text": Frame("", "\n\n", "")}


def totals_before(parts: DataFrame, n_parts: int, values: list[str], base: int = BASE) -> DataFrame:
    """part and, for each value, ``<value>_before``: its sum over the parts of smaller numbers. parts: one row per part 0 ... n_parts - 1, or less."""
    group = F.expr(f"part div {base}")
    own = Window.partitionBy("_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = parts.withColumn("_group", group).select("part", "_group", *(F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"{v}_before") for v in values))
    if n_parts <= base:
        return within.drop("_group")
    groups = parts.groupBy(group.alias("part")).agg(*(F.sum(v).alias(v) for v in values))
    above = totals_before(groups, -(-n_parts // base), values, base).select(F.col("part").alias("_group"), *(F.col(f"{v}_before").alias(f"_{v}") for v in values))
    return within.join(above, "_group").select("part", *((F.col(f"{v}_before") + F.col(f"_{v}")).alias(f"{v}_before") for v in values))


def sorted_parts(blocks: DataFrame, key: list[Column], block_col: str, parts: int) -> DataFrame:
    """blocks with ``_part``, ``_at`` (the place in the part) and ``_size`` (bytes), as a table: the rows of a part are all before those of the next, and equal rows may be in several."""
    made = written(blocks, "blocks")  # the search for the parts' bounds reads all rows once before they are sorted
    order = [*key, F.col(block_col), F.col("_id")]
    rows = made.filter(F.col(block_col).isNotNull()).withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.drop("_id").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), "_size": F.octet_length(block_col).cast("long")})
    out = written(rows, "parts")
    drop_written(made)
    return out


def laid_out(blocks: DataFrame, key: list[Column], block_col: str = "block", frame: Frame = Frame(), parts: int | None = None) -> DataFrame:
    """blocks with position (from 0), offset and length (bytes) and piece, the text that stands there."""
    parts = parts or max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = sorted_parts(blocks, key, block_col, parts)
    head, gap, tail = (len(x.encode()) for x in (frame.head, frame.separator, frame.tail))
    size = F.col("_size") + gap
    by_part = rows.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    by_part = written(by_part, "part-totals")  # a row a part
    total = by_part.agg(F.sum("n")).first()[0] or 0
    before = totals_before(by_part, parts, ["n", "bytes"]).withColumnRenamed("part", "_part")
    earlier = F.coalesce(F.sum(size).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.select("*", earlier.alias("_bytes")).join(before.hint("merge"), "_part")
    position = (F.col("n_before") + F.col("_at")).cast("long")
    first, last = position == 0, position == total - 1
    offset = F.when(first, F.lit(0)).otherwise(F.col("bytes_before") + F.col("_bytes") + head - gap).cast("long")
    length = (F.col("_size") + F.when(first, F.lit(head)).otherwise(F.lit(gap)) + F.when(last, F.lit(tail)).otherwise(F.lit(0))).cast("long")
    piece = F.concat(F.when(first, F.lit(frame.head)).otherwise(F.lit(frame.separator)), F.col(block_col), F.when(last, F.lit(frame.tail)).otherwise(F.lit("")))
    return out.select(*(F.col(f"`{c}`") for c in blocks.columns), position.alias("position"), offset.alias("offset"), length.alias("length"), piece.alias("piece"))


def _write_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "r+b", buffering=0) as f:
            for batch in batches:
                for offset, piece in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    n += os.pwrite(f.fileno(), piece, offset)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["written"])

    return run


def write_document(laid: DataFrame, path: str, frame: Frame = Frame()) -> int:
    """Writes the pieces into one file, each task its own rows at their own bytes; the number of bytes.

    The file is on a file system that all executors mount (``file:`` or a plain path). A task that runs again writes the same bytes to the same place.
    """
    path = urlparse(path).path
    beside = f"{path}.part"
    empty = (frame.head.strip() + frame.tail.strip()).encode()
    with open(beside, "wb"):
        pass
    n = laid.select("offset", "piece").mapInArrow(_write_pieces(beside), "written long").groupBy().agg(F.sum("written")).first()[0]
    if not n:
        with open(beside, "wb") as f:
            n = f.write(empty)
    os.replace(beside, path)
    return n
