"""Zero-shot tags: cosine against a label matrix, a two-tier confidence gate and relative top-k.

Each row is scored against the whole vocabulary where it stands: the label matrix, at most MOST_LABELS rows, is one array that
goes to every task, and sorting, gate and cut are array functions. So nothing is shuffled, however many rows there are.
``zero_shot`` stays in the JVM; ``zero_shot_arrow`` does the same with one matrix product a batch, for long vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafold.operators.vocabulary import MOST_LABELS, norm

SMALLEST = 2.2250738585072014e-308  # of the normal numbers


@dataclass(frozen=True)
class Gate:
    """Tagged if the best score is hi or more, or lo or more with the margin over the second best; then at most k labels of rel times the best or more."""

    hi: float
    lo: float
    margin: float
    k: int
    rel: float


# The presets.
IMAGE = Gate(0.160, 0.105, 0.012, 3, 0.80)
AUDIO = Gate(0.30, 0.15, 0.08, 6, 0.75)
HYBRID = Gate(0.30, 0.15, 0.08, 3, 0.80)
LOOSE = Gate(0.0, 0.0, 0.0, 6, 0.4)


def with_vocabulary(rows: DataFrame, vocab: DataFrame, label_col: str = "lid", vec_col: str = "vec") -> DataFrame:
    """rows with ``vocab``: an array of (lid, vec) in label order."""
    entries = vocab.select(F.struct(F.col(label_col).alias("lid"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec")).alias("e"))
    count = entries.limit(MOST_LABELS + 1).count()
    if count > MOST_LABELS:
        raise ValueError(f"a vocabulary has at most {MOST_LABELS} labels")
    one = entries.agg(F.sort_array(F.collect_list("e")).alias("vocab"))  # of one row
    return rows.join(F.broadcast(one), F.lit(True))


def valid_norm(n: Column) -> Column:
    return (n >= SMALLEST) & ~F.isnan(n) & (n < float("inf"))


def ranked(vec: Column, vocab: Column) -> Column:
    """(s, lid) of all labels, best first, ties in label order; null for a vector without a direction."""
    double = F.transform(vec, lambda x: x.cast("double"))
    n = norm(vec)

    def score(e: Column) -> Column:
        return F.aggregate(F.zip_with(double, e["vec"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / n

    scores = F.array_sort(F.transform(vocab, lambda e: F.struct((-score(e)).alias("negative"), e["lid"].alias("lid"))))
    return F.when(valid_norm(n), F.transform(scores, lambda x: F.struct((-x["negative"]).alias("s"), x["lid"].alias("lid"))))


def scored(rows: DataFrame, vocab: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """rows with ``ranking``, ``top`` and ``second``."""
    out = with_vocabulary(rows, vocab).withColumn("ranking", ranked(F.col(vec_col), F.col("vocab"))).drop("vocab")
    return out.withColumn("top", F.col("ranking")[0]["s"]).withColumn("second", F.coalesce(F.get("ranking", F.lit(1))["s"], F.lit(0.0)))


def accepted(gate: Gate) -> Column:
    return (F.col("top") >= gate.hi) | ((F.col("top") >= gate.lo) & (F.col("top") - F.col("second") >= gate.margin))


def shown_scores(ranking: Column, names: Callable[[Column], Column], n: int = 6) -> Column:
    """The best labels with their scores, for a look at a gate: "label=0.123 ..."."""
    return F.array_join(F.transform(F.slice(ranking, 1, n), lambda r: F.concat(names(r["lid"]), F.lit("="), F.format_string("%.3f", r["s"]))), " ")


def zero_shot(rows: DataFrame, vocab: DataFrame, gate: Gate, vec_col: str = "embedding") -> DataFrame:
    """rows with ``tags``: array<struct<s, lid>>, best first, null where the gate is shut; and ``confidence``, the best score."""
    out = scored(rows, vocab, vec_col)
    kept = F.filter(F.slice("ranking", 1, gate.k), lambda x: x["s"] >= F.col("top") * gate.rel)
    out = out.withColumn("tags", F.when(accepted(gate), kept)).withColumn("confidence", F.when(accepted(gate), F.col("top")))
    return out.drop("ranking", "top", "second")


def zero_shot_arrow(rows: DataFrame, labels: list, matrix: np.ndarray, gate: Gate, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """``id_col`` and tags, by a matrix product a batch. labels: of the matrix' rows, which are unit vectors."""
    if len(labels) > MOST_LABELS:
        raise ValueError(f"a vocabulary has at most {MOST_LABELS} labels")
    vocab = np.asarray(matrix, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = []
            vecs = [np.array(v, np.float64) if v is not None else np.zeros(vocab.shape[1]) for v in batch.column(1).to_pylist()]
            e = np.stack(vecs) if vecs else np.zeros((0, vocab.shape[1]))
            with np.errstate(all="ignore"):
                n = np.sqrt((e * e).sum(axis=1))
                s = e @ vocab.T / n[:, None]
            order = np.argsort(-s, axis=1, kind="stable")
            for length, row, o in zip(n, s, order, strict=True):
                top, second = row[o[0]], row[o[1]] if len(o) > 1 else 0.0
                fine = SMALLEST <= length < np.inf and (top >= gate.hi or (top >= gate.lo and top - second >= gate.margin))
                tags.append([{"s": float(row[k]), "lid": labels[k]} for k in o[: gate.k] if row[k] >= top * gate.rel] if fine else None)
            kind = pa.list_(pa.struct([("s", pa.float64()), ("lid", pa.infer_type(labels))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tags, kind)], ["id", "tags"])

    lid = {int: "long", str: "string"}[type(labels[0])]
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(vec_col)).mapInArrow(run, f"id {kind}, tags array<struct<s:double,lid:{lid}>>").withColumnRenamed("id", id_col)
