"""op12 and op13 against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediafold.llm import period_runs, vector_codes


def brute_runs(w, least=24, times=3):
    """Every maximal stretch of every period, without those that a smaller period explains."""
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            s, e = i, j + p
            if j > i and e - s >= max(least, times * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
        digest(b" ".join(x for k, x in enumerate(w) if k not in gone)),
    )


pieces = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 80)).map(lambda x: [x[0][i % len(x[0])] for i in range(x[1])])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(pieces, max_size=5).map(lambda p: " ".join(sum(p, [])).encode()), min_size=1, max_size=5), st.sampled_from([(24, 3), (6, 3), (1, 4)]))
def test_runs(texts, shape):
    for words, runs in period_runs._runs_of(texts, *shape):
        assert runs == brute_runs(words, *shape)


def test_long_runs_cross_chunks():
    rng = random.Random(3)
    base = [rng.choice("abcdef") for _ in range(70_000)]
    text = " ".join([*base[:50], *base, *base, *base[:69_000], "x", *["y"] * 100_000]).encode()
    (words, runs), *_ = period_runs._runs_of([text], 24, 3)
    assert runs == [(len(words) - 100_000, 100_000, 1)]  # two periods and a bit are no run
    three = " ".join([*base, *base, *base, "z"]).encode()
    assert (0, 210_000, 70_000) in period_runs._runs_of([three], 24, 3)[0][1]


def test_period_query(spark, sf, edge_docs, no_docs, edge_rows):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = period_runs.op13_period_runs(spark, sf).collect()
    assert len(got) == len(docs) and any(r["n_runs"] for r in got)
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for r in got:
        if len(docs[r["doc_id"]]) < 20_000:
            assert tuple(r[c] for c in names) == brute_row(r["doc_id"], docs[r["doc_id"]])
    edges = period_runs.period_runs(edge_docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"]) for r in edges) == sorted((i or -1, len((t or "").encode().split())) for i, t in edge_rows)
    assert next(r["runs"] for r in edges if r["doc_id"] == 5) == [(0, 30_000, 1)] and all(r["collapsed"] is not None for r in edges)
    assert period_runs.period_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        period_runs.period_runs(no_docs, times=2)


def test_planted_runs_of_null_and_blank_texts(spark):
    rows = [(i, t) for i in range(300) for t in (None, "", " \t", "  a b\tc\nd ")] + [(None, "a a")]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", period_runs.with_planted_runs(F.col("text"), F.col("doc_id")).alias("t")).collect()
    for r in got:
        h = zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is None or h % 10:
            assert r["t"] == r["text"]
        elif (r["text"] or "").split():
            assert len(r["t"].split()) == 4


def brute_codes(vecs, k, parts, rounds):
    """Each part compared with every entry, with Python's integers."""
    x = [[math.floor(float(c) * 1024) for c in v] for v in vecs]
    size = -(-max(map(len, x)) // parts)
    x = [v + [0] * (size * parts - len(v)) for v in x]
    codes, errors, books = [], [0] * len(x), []
    for i in range(parts):
        part = [v[i * size : (i + 1) * size] for v in x]
        book = [list(p) for p in part[:k]]
        for r in range(rounds + 1):
            each = [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(book)) for p in part]
            if r < rounds:
                for j in range(len(book)):
                    own = [p for p, (_, c) in zip(part, each, strict=True) if c == j]
                    if own:
                        book[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        codes.append([c for _, c in each])
        errors = [e + d for e, (d, _) in zip(errors, each, strict=True)]
        books.append(book)
    return ["".join(f"{c[n]:02x}" for c in codes) for n in range(len(x))], errors, books


def _codes_of(spark, vecs, k, parts=2, rounds=3):
    rows = spark.createDataFrame([(n, v, n % 3 or None) for n, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int").repartition(2)
    coded, books = vector_codes.encode(rows, entries=k, parts=parts, rounds=rounds)
    got = {r["vec_id"]: r for r in coded.collect()}
    want = brute_codes(vecs, k, parts, rounds)
    assert ([got[n]["code"] for n in range(len(vecs))], [got[n]["error"] for n in range(len(vecs))], books) == (want[0], [min(e, (1 << 63) - 1) for e in want[1]], want[2])


@pytest.mark.parametrize("spread", [0.01, 3.0, 200_000.0, 1e9])
def test_codes(spark, spread):
    rng = random.Random(int(spread))
    vecs = [[rng.choice([0, 0.001, 1, -1]) * rng.random() * spread for _ in range(6)] for _ in range(120)]
    _codes_of(spark, vecs + vecs[:30], 16)  # equal rows are ties; wide components need more than 64 bits


def test_codes_of_ragged_vectors(spark):
    _codes_of(spark, [[0.5] * (k % 4) for k in range(20)] + [[], [1.0, 2.0, 3.0, 4.0, 5.0]], 4)


def test_pruning_is_strict_and_saves_work():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (16, 8))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 8))
    code, upper, lower = np.zeros(2000, np.int64), np.zeros(2000), np.zeros((2000, 16), np.int32)
    for _ in range(3):
        code, exact, computed = vector_codes.nearest(x, centres, code, upper, lower)
        every = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (exact == every.min(axis=1)).all()
        assert (lower[np.arange(2000)[:, None], np.arange(16)] ** 2 <= every).all()
    assert computed < 2.2 * len(x)  # of 16 entries


def test_code_query(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id", "embedding").collect()
    codes, errors, books = brute_codes([r["embedding"] for r in data], 256, 4, 4)
    by_label = Counter()
    for r, e in zip(data, errors, strict=True):
        by_label[r["label"]] += e
    want = Counter((r["vec_id"], c, e, by_label[r["label"]], vector_codes.codebooks_sha256(books)) for r, c, e in zip(data, codes, errors, strict=True))
    assert Counter(map(tuple, vector_codes.op12_elkan_codes(spark, sf).collect())) == want


def test_code_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0, 3.0, 4.0], None), (1, [1.0, 2.0, 3.0, 4.0], None), (None, [0.0, 0.0, 0.0, 1.0], 7), (3, None, 1), (4, [1.0, None, 2.0, 3.0], 1), (5, [inf, 0.0, 0.0, 0.0], 1), (6, [0.0, nan, 0.0, 0.0], 1), (2, [-0.5, 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, embedding array<float>, label int, codes string, n int")
    coded, books = vector_codes.encode(df, rounds=2)
    got = vector_codes.with_label_error(coded).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "2", "None"] and [len(b) for b in books] == [4] * 4
    assert {r["label_error"] for r in got} == {0} and {r["vec_id"]: r["code"][:2] for r in got} == {1: "00", 2: "02", None: "03"}
    empty, books = vector_codes.encode(df.filter("false"))
    assert vector_codes.with_label_error(empty).count() == 0 and books == []
