"""Label lists and label matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_LABELS = 4096


def parse_labels(inline: str | None = None, text: str | None = None) -> list[str] | None:
    """Labels from a comma-separated list or from a file's text (a label a line, # starts a comment); None if neither is given."""
    if inline is not None and text is not None:
        raise ValueError("give labels or a label file, not both")
    if inline is None and text is None:
        return None
    parts = inline.split(",") if inline is not None else [line.split("#", 1)[0] for line in text.splitlines()]
    labels = [p.strip() for p in parts if p.strip()]
    if not labels:
        raise ValueError("the label list is empty")
    if len(labels) == 1:
        raise ValueError("need at least 2 labels to tell apart")
    return labels


def split_labels(inline: Column) -> Column:
    """parse_labels for a column of comma-separated lists, without its errors."""
    return F.filter(F.transform(F.split(inline, ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def cache_key(model: str, labels: Sequence[str]) -> str:
    """The name under which a model's vectors of these labels, in this order, are kept."""
    return hashlib.sha256(model.encode() + b"".join(x.encode() + b"\0" for x in labels)).hexdigest()[:16]


def cache_key_column(model: Column, labels: Column) -> Column:
    joined = F.concat(model, F.array_join(labels, "\0"), F.when(F.size(labels) > 0, F.lit("\0")).otherwise(""))
    return F.left(F.sha2(joined, 256), F.lit(16))


def norm(vec: Column) -> Column:
    """Length of a vector, in double precision."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(vec: Column) -> Column:
    """The vector of length 1; a vector of length 0 is unchanged."""
    n = norm(vec)
    return F.when(n > 0, F.transform(vec, lambda x: x.cast("double") / n)).otherwise(F.transform(vec, lambda x: x.cast("double")))


def centred(vocab: DataFrame, label_col: str = "lid", vec_col: str = "vec") -> DataFrame:
    """Unit vectors, less their mean over all labels, made unit again. vocab is a label matrix: at most MOST_LABELS rows."""
    rows = vocab.select(label_col, F.posexplode(unit(F.col(vec_col))).alias("i", "x"))
    rows = rows.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("i")))
    vecs = rows.groupBy(label_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(vec_col))
    return vecs.select(label_col, unit(F.col(vec_col)).alias(vec_col))


def first_vectors(embeddings: DataFrame) -> DataFrame:
    """A vocabulary from labelled vectors: for each label the vector of the smallest id. lid, vec."""
    return embeddings.filter("label IS NOT NULL").groupBy(F.col("label").alias("lid")).agg(F.min_by("embedding", "vec_id").alias("vec"))
