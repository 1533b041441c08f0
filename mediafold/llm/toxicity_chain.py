"""Toxicity by a classifier chain: linear models over hashed words, each given the probabilities of the categories before it.

A text's features are which words (runs of letters, lower case) it has, and for each beginning of ``PREFIXES`` letters whether as many different
words as each of ``LEVELS`` have it, so an inflected vocabulary counts for more than a chance word. A category's model
is a logistic regression on these features, each scaled by its log-count ratio in the training rows, and on the probabilities of the earlier
categories. For training these come from models fitted without the row's own fold, so a later model sees the earlier ones as
they are on unseen texts; for scoring from the models fitted on all folds.

The models are fitted on at most ``TRAIN_ROWS`` labelled rows, those of the smallest hashes of their ids, a documented bound. All folds
are fitted at once, each as one group of that bounded size. The weights, ``FEATURES`` numbers a category, go to the tasks that
score; scoring shuffles nothing.

Defined cases: a null or empty text has no features and gets the prior's probabilities; rows with a null label are left out for that category; null
ids have no labels; of several labels of one id each counts, with the least of the id's texts; a category without labels, or with one kind of label only, has a model
without weights, whose prior counts half a bad row and nine and a half good rows more, so nothing is rejected without evidence; repeated rows
are scored alike; an empty table gives an empty result; ``keep_clean`` passes all columns on, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.llm._common import frugal, materialise, table

FEATURES = 1 << 18
PREFIXES = (4, 5)
LEVELS = (1, 2, 3, 4, 6)
TRAIN_ROWS = 4096
FOLDS = 3
STEPS = 30
L2 = 1.0
THRESHOLD = 0.1  # toxic texts are rare, and a word that only they have says much
ROWS = 128
AT_ONCE = 1 << 20
MEMO = 100_000  # words; about 25 MB
_WORD = re.compile(r"[^\W\d_]+")


class _Codes(dict):
    """Words to the packed codes of the word (even) and of its beginnings (odd); bounded."""

    def __missing__(self, word: str) -> bytes:
        codes = [zlib.crc32(word.encode()) & ~1, *(zlib.crc32(word[:n].encode()) | 1 for n in PREFIXES if len(word) >= n)]
        packed = np.array(codes, "<u4").tobytes()
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 40:
            self[word] = packed
        return packed


_memo = _Codes()


def _numbers(codes: np.ndarray, level: int) -> np.ndarray:
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xC2B2AE3D27D4EB4F % (1 << 64))
    return mixed >> np.uint64(64 - (FEATURES.bit_length() - 1))


def _groups(texts: Sequence[str | None]) -> Iterator[Sequence[str | None]]:
    """The texts in order, some at once: ROWS at most, and of AT_ONCE letters at most unless a single one is longer."""
    begin = size = 0
    for end, text in enumerate(texts):
        size += len(text or "")
        if end > begin and (end - begin == ROWS or size > AT_ONCE):
            yield texts[begin:end]
            begin, size = end, len(text or "")
    if begin < len(texts):
        yield texts[begin:]


def _owned_features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the texts' features, in order and once for each text, and which text each is of."""
    packed = [b"".join(map(_memo.__getitem__, set(_WORD.findall((t or "").lower())))) for t in texts]
    codes = np.frombuffer(b"".join(packed), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(p) // 4 for p in packed])
    first, words = _distinct(owner << np.uint64(32) | codes)
    codes, owner = first & np.uint64(0xFFFFFFFF), first >> np.uint64(32) << np.uint64(32)
    beginning = (codes & np.uint64(1)).astype(bool)
    found = [owner[~beginning] | _numbers(codes[~beginning], 0)]
    codes, owner, words = codes[beginning], owner[beginning], words[beginning]
    for n in LEVELS:
        enough = words >= n
        codes, owner, words = codes[enough], owner[enough], words[enough]
        found.append(owner | _numbers(codes, n))
    both = _distinct(np.concatenate(found))[0]
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int32), (both >> np.uint64(32)).astype(np.int64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different values and how often each is there."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return x[at], np.diff(at, append=len(x))


def features(text: str | None) -> np.ndarray:
    """Sorted numbers of a text's features."""
    return _owned_features([text])[0]


def minimised(f, x: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS with a backtracking line search; f gives the value and the gradient."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -slope, []
        for s, y in reversed(past):
            alphas.append(s @ d / (s @ y))
            d = d - alphas[-1] * y
        if past:
            s, y = past[-1]
            d = d * (s @ y / (y @ y))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        rate, descent = 1.0 if past else 1 / max(1.0, float(np.sqrt(slope @ slope))), slope @ d
        while True:
            new, new_slope = f(x + rate * d)
            if new <= value + 1e-4 * rate * descent or rate < 1e-9:
                break
            rate /= 2
        s, y = rate * d, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y)]
        done = value - new < 1e-4 * abs(value)
        x, value, slope = x + s, new, new_slope
        if done:
            break
    return x


class Linear:
    """weights of the features, weights of the earlier categories' probabilities, and the intercept, as one array of float32."""

    @staticmethod
    def fit(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> np.ndarray:
        k, positive = earlier.shape[1], int(y.sum())
        out = np.zeros(FEATURES + k + 1)
        out[-1] = np.log((positive + 0.5) / (len(y) - positive + 9.5))
        if not 0 < positive < len(y):
            return out.astype(np.float32)
        sizes = np.array([len(r) for r in rows])
        at, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        df = np.bincount(at, minlength=FEATURES)
        good = np.bincount(at, weights=y[owner], minlength=FEATURES)
        ratio = np.log((good + 1) / (positive + 1)) - np.log((df - good + 1) / (len(y) - positive + 1))
        use = np.flatnonzero(df >= 2)
        name = np.full(FEATURES, -1)
        name[use] = np.arange(len(use))
        col = name[at]
        col, owner = col[col >= 0], owner[col >= 0]
        scale = ratio[use]

        def f(x: np.ndarray) -> tuple[float, np.ndarray]:
            w, v, b = x[: len(use)], x[len(use) : -1], x[-1]
            z = np.bincount(owner, weights=(w * scale)[col], minlength=len(y)) + earlier @ v + b
            p = 0.5 + 0.5 * np.tanh(z / 2)
            g = p - y
            value = np.logaddexp(0, z).sum() - y @ z + L2 / 2 * (w @ w + v @ v)
            return value, np.concatenate([np.bincount(col, weights=g[owner], minlength=len(use)) * scale + L2 * w, earlier.T @ g + L2 * v, [g.sum()]])

        x = minimised(f, np.concatenate([np.zeros(len(use) + k), out[-1:]]), STEPS)
        out[use] = x[: len(use)] * scale
        out[FEATURES:] = x[len(use) :]
        return out.astype(np.float32)

    @staticmethod
    def log_odds(weights: np.ndarray, row: np.ndarray, earlier: Sequence[float]) -> float:
        return float(weights[row].sum(dtype=np.float64) + np.dot(weights[FEATURES:-1], earlier) + weights[-1])

    @staticmethod
    def probability(weights: np.ndarray, row: np.ndarray, earlier: Sequence[float]) -> float:
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, Linear.log_odds(weights, row, earlier)))))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            found = [(numbers, np.bincount(owner, minlength=len(texts))) for texts in _groups(part.column(2).to_pylist()) for numbers, owner in [_owned_features(texts)]]
            ends = np.concatenate([[0], np.cumsum(np.concatenate([sizes for _, sizes in found]))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([numbers for numbers, _ in found])))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["fold", "labels", "features"])


def _columns(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features, labels (NaN where null) and earlier probabilities."""
    labels = np.array([[np.nan if x is None else x for x in r] for r in rows["labels"].to_pylist()], float)
    return [np.array(r, np.int64) for r in rows["features"].to_pylist()], labels, np.array(rows["earlier"].to_pylist(), float).reshape(len(labels), -1)


def _fit(k: int):
    def run(rows: pa.Table) -> pa.Table:
        found, labels, earlier = _columns(rows)
        own = np.flatnonzero(~np.isnan(labels[:, k]))
        weights = Linear.fit([found[i] for i in own], earlier[own], labels[own, k])
        return pa.table({"without": rows["without"][:1], "weights": pa.array([weights.tobytes()], pa.binary())})

    return run


def _out_of_fold(rows: pa.Table, model: pa.Table) -> pa.Table:
    found, _, earlier = _columns(rows)
    weights = np.frombuffer(model["weights"][0].as_py(), np.float32)
    more = [[*o, Linear.probability(weights, r, o)] for r, o in zip(found, earlier, strict=True)]
    return rows.select(["fold", "labels", "features"]).append_column("earlier", pa.array(more, pa.list_(pa.float64())))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, folds: int = FOLDS) -> list[np.ndarray]:
    """The weights of each category, in the order of the chain. categories: by name, a column over labels: 1, 0 or null."""
    kinds = [c.cast("int") for c in categories.values()]
    known = labels.filter(labels[id_col].isNotNull()).select(labels[id_col].alias("id"), F.array(*kinds).alias("labels"))
    known = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id", F.to_json("labels")).limit(train_rows).withColumn("copy", F.monotonically_increasing_id())
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(known), "id")  # of train_rows at most
    # an id may have any number of rows: one text for each label row stays
    rows = rows.groupBy("h", "id", "labels", "copy").agg(F.min("text").alias("text"))
    rows = rows.select(F.pmod("h", F.lit(folds)).cast("int").alias("fold"), "labels", "text")
    schema = "fold int, labels array<int>, features array<int>"
    rows = materialise(rows.mapInArrow(frugal(_featured), schema).withColumn("earlier", F.array().cast("array<double>")), "chain-0")
    models = []
    for k in range(len(categories)):
        # each group lacks one fold; the group numbered ``folds`` has all
        groups = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("without")).filter("without <> fold")
        fitted = materialise(groups.groupBy("without").applyInArrow(_fit(k), "without int, weights binary"), f"model-{k}")
        whole = fitted.filter(F.col("without") == folds).first()
        if whole is None:
            models.append(Linear.fit([], np.zeros((0, k)), np.zeros(0)))
            continue
        models.append(np.frombuffer(whole["weights"], np.float32))
        by_fold = rows.groupBy("fold").cogroup(fitted.filter(F.col("without") < folds).withColumnRenamed("without", "fold").groupBy("fold"))
        if k + 1 < len(categories):
            rows = materialise(by_fold.applyInArrow(lambda a, b: _out_of_fold(a, b) if a.num_rows else a, f"{schema}, earlier array<double>"), f"chain-{k + 1}")
    return models


def probabilities(models: Sequence[np.ndarray], texts: Sequence[str | None]) -> np.ndarray:
    """A row for each text, a column for each category."""
    done = []
    for some in _groups(texts):
        numbers, owner = _owned_features(some)
        p = np.zeros((len(some), len(models)))
        for k, weights in enumerate(models):
            z = np.bincount(owner, weights=weights[numbers], minlength=len(some)) + p[:, :k] @ weights[FEATURES:-1].astype(float) + weights[-1]
            p[:, k] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        done.append(p)
    return np.concatenate(done) if done else np.zeros((0, len(models)))


def score_chain(docs: DataFrame, models: list[np.ndarray], names: Sequence[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``id_col``, p_<name> of each category, and rejected, true if the last category's probability reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # FEATURES numbers a category, however large the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                p = probabilities(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= threshold)], ["id", *(f"p_{n}" for n in names), "rejected"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + "".join(f"p_{n} double, " for n in names) + "rejected boolean"
    return rows.mapInArrow(frugal(run), schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, models: list[np.ndarray], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rejected rows; all columns unchanged, nothing shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(probabilities(shared.value, part.column(at_text).to_pylist())[:, -1] < threshold))

    return docs.mapInArrow(frugal(run), docs.schema)


def label_categories(labels: DataFrame) -> dict[str, Column]:
    """The chain over the table ``labels``: low quality first, then toxic."""
    return {"low_quality": 1 - labels["quality"], "toxic": labels["toxic"]}


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    categories = label_categories(labels)
    return score_chain(docs, fit_chain(docs, labels, categories), list(categories))
