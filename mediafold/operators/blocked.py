"""Zero-shot tags for vocabularies of any size: blocks of labels against blocks of rows, as matrix products.

A vocabulary that doesn't fit into one broadcast row is dealt out to cells, and so are the rows. A cell has one part of each: its labels come first
and make a matrix, then its rows come, some at a time, and meet the labels block by block. Of a cell each row keeps its ``k`` best labels; what the cells found is merged by
row, which is exact: the best ``k`` of all are among the best of their cells, and so are the best and the second best score that the gate needs.
The products are of single precision and choose candidates, with a margin for rounding: those that may be among the best ``k`` of the blocks so far. Their scores are then summed in
double precision in one fixed order, so the sizes and places of blocks and cells change nothing.

Rows are repeated once a part of the labels and labels once a part of the rows. A cell is a task. A part of the labels has at most ``CELL_BYTES`` as a matrix and one of the rows
``CELL_ROWS``; only where these would make fewer cells than tasks can run, they are smaller. So b parts of labels and a of rows make a x b tasks, and the copies, a + b times a table, stay few
beside the a x b products. Blocks are what one product takes at most.

Defined cases: a vector without a direction has no ranking (null), one of another length than the labels' an empty one; ties are in label order; equal rows are ranked each for itself;
without labels every ranking is empty; labels without a vector, shorter than the longest or whose vector has no direction are left out; other columns of the rows are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafold.operators.vocabulary import norm
from mediafold.operators.zeroshot import SMALLEST, Gate, accepted, valid_norm

LABEL_BLOCK = 4096
ROW_BLOCK = 1024
CELL_BYTES = 32 << 20
CELL_ROWS = 65_536
LEAST = 4096  # labels or rows of a part, where parts are made smaller for more tasks

FOUND = "row long, payload {payload}, ranking array<struct<negative:double,rank:long>>"


def _vectors(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the column's vectors and which rows have one of the dimension; the others are zero."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    lengths = np.nan_to_num(np.asarray(lengths, float), nan=-1).astype(np.int64)
    dim = int(lengths.max(initial=0)) if dim is None else dim
    fine = lengths == dim
    out = np.zeros((len(column), dim))
    if dim and fine.any():
        out[fine] = column.filter(pa.array(fine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out, fine


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length 1 and which have a direction; the squares are summed in one fixed order."""
    with np.errstate(all="ignore"):
        n = np.sqrt(np.cumsum(vectors * vectors, axis=1)[:, -1]) if vectors.shape[1] else np.zeros(len(vectors))
        fine = (n >= SMALLEST) & (n < np.inf)
        return np.where(fine[:, None], vectors / n[:, None], 0.0), fine


def _first(row: np.ndarray, k: int) -> np.ndarray:
    """Which places are among the first k of their row; row: in ascending order."""
    return np.arange(len(row)) - np.searchsorted(row, row) < k


def _best(x: np.ndarray, labels: np.ndarray, single: np.ndarray, k: int, label_block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of x the k best labels, or all if there are fewer: (row, label, score), by row, best first, ties by label. single: labels in single precision.

    A score in single precision is off by less than half the margin, so a label whose score is less than the k-th best by the margin isn't among the best.
    """
    x32, margin = x.astype(np.float32), np.float32((x.shape[1] + 8) * 2.0**-22)
    top = np.full((len(x), k), -np.inf, np.float32)  # the k best scores of each row so far, the least first
    seen = []
    for at in range(0, len(labels), label_block):
        s = x32 @ single[at : at + label_block].T
        if at == 0 and s.shape[1] > k:
            top = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k :]
            top.sort(axis=1)
        place = np.flatnonzero(s >= (top[:, :1] - margin))
        if not len(place):
            continue
        row, score = place // s.shape[1], s.ravel()[place]
        seen.append((row, place % s.shape[1] + at, score))
        if at or s.shape[1] <= k:
            order = np.lexsort((-score, row))
            row, score = row[order], score[order]
            few = _first(row, k)
            row, score = row[few], score[few]
            found = np.unique(row)
            more = np.full((len(found), k), -np.inf, np.float32)
            more[np.searchsorted(found, row), np.arange(len(row)) - np.searchsorted(row, row)] = score
            top[found] = np.sort(np.concatenate([top[found], more], axis=1), axis=1)[:, -k:]
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, label, score = (np.concatenate(c) for c in zip(*seen, strict=True))
    near = score >= top[row, 0] - margin
    row, label = row[near], label[near]
    exact = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        exact[at : at + (1 << 16)] = np.cumsum(x[row[at : at + (1 << 16)]] * labels[label[at : at + (1 << 16)]], axis=1)[:, -1]
    order = np.lexsort((label, -exact, row))
    row, label, exact = row[order], label[order], exact[order]
    few = _first(row, k)
    return row[few], label[few], exact[few]


def _cells(k: int, label_block: int, row_block: int):
    kind = pa.struct([("negative", pa.float64()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, ranks, matrix = None, [], [], None
        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])])) if len(cells) else []
            for begin, end in zip(edges, [*edges[1:], len(cells)], strict=True):
                if cells[begin] != cell:
                    cell, parts, ranks, matrix = cells[begin], [], [], None
                if kinds[begin] == 0:
                    part = batch.slice(begin, end - begin)
                    parts.append(part.column(4))
                    ranks.append(part.column(2).to_numpy())
                    continue
                if matrix is None:
                    matrix = _units(_vectors(pa.concat_arrays(parts))[0])[0] if parts else np.zeros((0, 0))
                    single, places = matrix.astype(np.float32), np.concatenate(ranks) if ranks else np.zeros(0, np.int64)
                    parts = []
                for at in range(begin, end, row_block):
                    part = batch.slice(at, min(row_block, end - at))
                    x, fine = _vectors(part.column(4), matrix.shape[1] if len(matrix) else None)
                    x, valid = _units(x)
                    fine &= valid
                    row, label, score = _best(x, matrix, single, k, label_block)
                    row, label, score = row[fine[row]], label[fine[row]], score[fine[row]]
                    offsets = pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32())
                    found = pa.StructArray.from_arrays([pa.array(-score), pa.array(places[label])], fields=list(kind))
                    yield pa.RecordBatch.from_arrays([part.column(3), part.column(5), pa.ListArray.from_arrays(offsets, found)], ["row", "payload", "ranking"])

    return run


def _parts(n_rows: int, n_labels: int, dim: int, tasks: int, cell_rows: int, cell_bytes: int, least: int) -> tuple[int, int]:
    """Parts of the rows and of the labels."""
    a, b = max(1, -(-n_rows // cell_rows)), max(1, -(-n_labels * dim * 8 // cell_bytes))
    more = max(1.0, tasks / (a * b)) ** 0.5
    return max(a, min(round(a * more), -(-n_rows // least))), max(b, min(round(b * more), -(-n_labels // least)))


def ranked_blocks(
    rows: DataFrame, vocab: DataFrame, k: int, vec_col: str = "embedding", label_col: str = "lid", label_vec_col: str = "vec", label_block: int = LABEL_BLOCK, row_block: int = ROW_BLOCK,
    cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES, least: int = LEAST,
) -> DataFrame:
    """rows with ranking: the k best labels as array<struct<s, lid>>, best first. A label is a whole number, its place in the list, each once."""
    single = {"array<float>"} >= {rows.schema[vec_col].dataType.simpleString(), vocab.schema[label_vec_col].dataType.simpleString()}
    kept = lambda vec: F.col(vec).cast("array<float>" if single else "array<double>")
    fine = lambda vec: vec.isNotNull() & valid_norm(norm(vec))
    labels = vocab.select(F.col(label_col).alias("lid"), F.col(label_vec_col).alias("v")).filter(fine(F.col("v")))
    longest = labels.agg(F.max(F.size("v"))).first()[0] or 0
    labels = labels.filter(F.size("v") == longest).select("lid", kept("v").alias("vec"))
    n_labels, n_rows = labels.count(), rows.count()
    row_parts, label_parts = _parts(n_rows, n_labels, longest, 3 * rows.sparkSession.sparkContext.defaultParallelism, cell_rows, cell_bytes, least)
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())  # in one place only: what follows is grouped, not joined with the rows again
    cells = numbered.select(F.explode(F.sequence(F.lit(0), F.lit(label_parts - 1))).alias("b"), "*")
    payload = F.when(F.col("b") == 0, F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
    asked = cells.select("b", F.pmod(F.xxhash64("_row"), F.lit(row_parts)).alias("a"), F.col("_row").alias("row"), payload.alias("payload"), kept(vec_col).alias("vec"))
    offered = labels.select(F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1))).alias("a"), F.pmod(F.xxhash64("lid"), F.lit(label_parts)).alias("b"), F.col("lid").cast("long").alias("rank"), "vec")
    cell = (F.col("a") * label_parts + F.col("b")).cast("long").alias("cell")
    null, kind = F.lit(None).cast("long"), asked.schema["payload"].dataType
    stream = offered.select(cell, F.lit(0).alias("kind"), "rank", null.alias("row"), "vec", F.lit(None).cast(kind).alias("payload"))
    stream = stream.unionByName(asked.select(cell, F.lit(1).alias("kind"), null.alias("rank"), "row", "vec", "payload"))
    stream = stream.repartitionById(row_parts * label_parts, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind", "rank")
    found = stream.mapInArrow(_cells(k, label_block, row_block), FOUND.format(payload=kind.simpleString()))
    best = found.groupBy("row").agg(F.first("payload", True).alias("payload"), F.flatten(F.collect_list("ranking")).alias("all"))  # k of each part of the labels
    best = best.select("payload.*", F.slice(F.sort_array("all"), 1, k).alias("_best"))
    named = F.transform("_best", lambda x: F.struct((-x["negative"]).alias("s"), x["rank"].cast(vocab.schema[label_col].dataType).alias("lid")))
    return best.withColumn("ranking", F.when(fine(F.col(vec_col)), named)).drop("_best")


def zero_shot_blocks(rows: DataFrame, vocab: DataFrame, gate: Gate, vec_col: str = "embedding", label_block: int = LABEL_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """What ``zero_shot`` gives, for any number of labels: rows with tags (array<struct<s, lid>>, null where the gate is shut) and confidence."""
    out = ranked_blocks(rows, vocab, max(2, gate.k), vec_col, label_block=label_block, row_block=row_block)
    out = out.withColumn("top", F.get("ranking", F.lit(0))["s"]).withColumn("second", F.coalesce(F.get("ranking", F.lit(1))["s"], F.lit(0.0)))
    kept = F.filter(F.slice("ranking", 1, gate.k), lambda x: x["s"] >= F.col("top") * gate.rel)
    return out.withColumn("tags", F.when(accepted(gate), kept)).withColumn("confidence", F.when(accepted(gate), F.col("top"))).drop("ranking", "top", "second")
