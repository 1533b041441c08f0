"""Periodic runs of words: stretches that repeat themselves every q words, found by probing harmonic grids.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(``LEAST``, ``TIMES`` q) that no neighbouring word extends keeping period q. For each period p the words at the multiples of p are
compared with those one step on: a run of period p holds so many multiples of p that at least ``TIMES`` - 1 comparisons next to each other
hold, for short periods more. Of a text of n words this takes n/1 + n/2 + ... comparisons in all. Only where so many hold is the stretch
extended to both sides, chunk by chunk. Periods ascend, and grid points within a run found already, whose period divides p, are skipped:
what they would lead to is that run again.

Texts are read some megabytes at a time, their words numbered, and laid one after the other with a number of its own between each
two, shortest first; so one comparison of arrays probes all of them that are long enough for the period. Nothing is shuffled, and a task holds one such
portion, or one longer text.

Defined cases: null, empty and blank texts have no words and no runs, and an empty collapsed text; equal rows are treated alike, each for
itself; runs may overlap; an empty table gives an empty result; other columns are not read. Texts are taken whole. In the query a null id is
that of a document left as it is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.llm._common import frugal, table

LEAST = 24
TIMES = 3
AT_ONCE = 4 << 20  # bytes of text
ROWS = 512
_CHUNK = 64, 1 << 16
_BETWEEN = 0.5, 0.25, 0.75, 0.1, 0.9

RUN = "struct<start:long,length:long,period:long>"


def _matching(x: np.ndarray, p: int, at: int, step: int) -> int:
    """How many places from ``at`` on (step 1) or backwards (step -1) have x[i] == x[i + p]."""
    n, size = 0, _CHUNK[0]
    end = len(x) - p if step > 0 else -1
    while (left := (end - at) * step) > 0:
        k = min(size, left)
        low = at if step > 0 else at - k + 1
        wrong = np.flatnonzero(x[low : low + k] != x[low + p : low + p + k])
        if len(wrong):
            return n + int(wrong[0] if step > 0 else k - 1 - wrong[-1])
        n, at, size = n + k, at + k * step, min(2 * size, _CHUNK[1])
    return n


def _probed(grid: np.ndarray, needed: int) -> np.ndarray:
    """Grid points from which on ``needed`` comparisons with the next point hold."""
    same = grid[:-1] == grid[1:]
    if needed == 2:
        return np.flatnonzero(same[:-1] & same[1:])
    sums = np.concatenate([[0], np.cumsum(same)])
    return np.flatnonzero(sums[needed:] - sums[:-needed] == needed)


def periodic_runs(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in x, which holds texts of ascending lengths from ``starts`` on, each followed by a number that is nowhere else. times: 3 or more."""
    found: dict[tuple[int, int], int] = {}
    period, until = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)  # of the run that covers a place
    for p in range(1, int(lengths[-1]) // times + 1 if len(lengths) else 0):
        shortest = max(least, times * p)
        first = int(np.searchsorted(lengths, shortest))
        if first == len(lengths):
            break
        begin, needed = int(starts[first]), (shortest - p) // p
        places = begin + p * _probed(x[begin::p], needed)
        if not len(places):
            continue
        q = period[places]
        places = places[(q == 0) | (until[places] <= places + needed * p) | (p % np.maximum(q, 1) != 0)]
        for share in _BETWEEN:  # within a run all words between its grid points equal those one period on
            between = places + int(p * share)
            places = places[x[between] == x[between + p]]
        k = 0
        while k < len(places):
            at = int(places[k])
            after = at + _matching(x, p, at, 1)
            before = at + 1 - _matching(x, p, at, -1)
            end = after + p
            if end - before >= shortest and (before, end) not in found:
                found[before, end] = p
                period[before:end], until[before:end] = p, end
            k = int(np.searchsorted(places, max(after, at + 1)))
    return [(s, e - s, q) for (s, e), q in found.items()]


def _runs_of(texts: list[bytes], least: int, times: int) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Of each text its words, and its runs by start, then period."""
    split = [t.split() for t in texts]  # of bytes: exactly the six ASCII white-space characters
    order = sorted((k for k in range(len(split)) if len(split[k]) >= least), key=lambda k: len(split[k]))
    out: list[tuple[list[bytes], list[tuple[int, int, int]]]] = [(w, []) for w in split]
    if not order:
        return out
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    lengths = np.array([len(split[k]) for k in order])
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    x = np.empty(int(lengths.sum()) + len(order), np.int64)
    for i, k in enumerate(order):
        x[starts[i] : starts[i] + lengths[i]] = np.fromiter(map(number.__getitem__, split[k]), np.int64, lengths[i])
        x[starts[i] + lengths[i]] = -1 - i
    for start, length, q in periodic_runs(x, starts, lengths, least, times):
        i = int(np.searchsorted(starts, start, "right")) - 1
        out[order[i]][1].append((start - int(starts[i]), length, q))
    for _, runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, exactly; the earliest of these, then that of the shortest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, t in enumerate(texts):
        if k > begin and size + len(t) > AT_ONCE:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def _found(least: int, times: int):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_row = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                for i, j in _portions(texts):
                    each = _runs_of(texts[i:j], least, times)
                    columns = [
                        part.column(0).slice(i, j - i), pa.array([len(w) for w, _ in each], pa.int64()), pa.array([[as_row(r) for r in runs] for _, runs in each], pa.list_(kind)),
                        pa.array([as_row(_strongest(runs)) for _, runs in each], kind), pa.array([_collapsed(w, runs) for w, runs in each], pa.binary()).cast(pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "strongest", "collapsed"])

    return run


def period_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row: ``id_col``, n_words, runs (array of start, length, period, by start and period), strongest (the run of the most
    repetitions, or null) and collapsed, the text with each run cut to its first period and one blank between words. Of ``times`` 3 or more."""
    if times < 3 or least < 1:
        raise ValueError("runs have three periods or more")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"
    return rows.mapInArrow(frugal(_found(least, times)), schema).withColumnRenamed("id", id_col)


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text of the query: of every tenth document, by a checksum of its id, the words from some place on repeat a period of its own."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def rewritten(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda word, i: F.when(i < a, word).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # words as the one element of an array, so that it is computed once
    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text)


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = period_runs(docs.select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.col("strongest")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
