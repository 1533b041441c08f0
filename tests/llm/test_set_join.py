"""op11 against brute force, and its edge cases."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mediafold.llm import set_join
from mediafold.llm.simhash_similar import FOLD

from .test_documents import groups_of


def brute_set(text, words=4):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_join(rows, words=4, share=(17, 20)):
    """(id, size, component, rows of the same set) of each (id, text), by comparing all pairs of different sets."""
    sets = [brute_set(t, words) for _, t in rows]
    first = {}
    for k, s in enumerate(sets):
        if s:
            first.setdefault(s, k)
    distinct = list(first)
    pairs = [(first[s], k) for k, s in enumerate(sets) if s]
    for i, s in enumerate(distinct):
        for q in distinct[i + 1 :]:
            if share[1] * len(s & q) >= share[0] * len(s | q):
                pairs.append((first[s], first[q]))
    root = groups_of(pairs, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    same = Counter(sets)
    return Counter((i, len(s), least.get(root[k]), same[s] if s else None) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def variants(rng, base, n, share):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, max(1, int(len(w) * share)))):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = [f"n{rng.randrange(10**6)}"] * rng.randint(0, 2)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block,portion,quick", [(set_join.BLOCK, set_join.PORTION, 2), (3, 2, 1), (4, 1, 0), (5, 3, 2)])
def test_join(spark, tmp_path, monkeypatch, block, portion, quick):
    monkeypatch.setattr(set_join, "PORTION", portion)
    rng, rows = random.Random(block), []
    common = [f"c{k}" for k in range(40)]  # a passage that many share
    for g in range(8):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 8, 60, 150]))]
        base = base if g % 3 else base[:30] + common + base[30:]
        rows += [(len(rows) + k, t) for k, t in enumerate(variants(rng, base, 14, 0.04))]
    rows += [(1000 + k, t) for k, (_, t) in enumerate(rows[::9])] + [(2000, "a b"), (2001, "A  b"), (2002, ""), (2003, None), (None, rows[0][1])]
    rng.shuffle(rows)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = set_join.set_join(spark.read.parquet(path), quick=quick, block=block).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_equal"]) for r in got) == brute_join(rows)


def test_join_edges(spark, edge_docs, no_docs, edge_rows):
    got = set_join.set_join(edge_docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_equal"]) for r in got) == brute_join(edge_rows)
    assert set_join.set_join(no_docs).count() == 0


def test_join_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = set_join.op11_set_join(spark, sf).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_equal"]) for r in got) == brute_join(rows)
    assert any(r["component_id"] != r["doc_id"] for r in got)


numbers = st.frozensets(st.integers(0, 40), max_size=30)


@settings(max_examples=400, deadline=None)
@given(numbers, numbers, numbers, numbers, st.sampled_from([0.5, 0.8, 0.85]))
def test_answers_follow_from_the_leaders(lead, other, s, t, similarity):
    array = lambda x: np.array(sorted(x), np.uint64)
    relatives = set_join._Relatives(array(lead), array(other), similarity)
    want = len(s & t) >= similarity * len(s | t) - 1e-9
    assert relatives.linked(array(s - lead), array(lead - s), array(t - other), array(other - t)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(1, 12), st.integers(0, 4)), min_size=1, max_size=30), st.sampled_from([0.5, 0.85]))
def test_skipping_loses_no_pair(rows, similarity):
    rows = sorted(((c, n, min(i, n - 1), r) for c, r, n, i in rows), key=lambda x: x[:3])
    table = pa.table({
        "cell": [r[0] for r in rows], "row": list(range(len(rows))), "root": [r[3] for r in rows], "size": pa.array([r[1] for r in rows], pa.int32()), "place": pa.array([r[2] for r in rows], pa.int32()),
        "side": pa.array([2] * len(rows), pa.int8()), "sketch": [0] * len(rows), "fold": [bytes(8 * FOLD)] * len(rows),
    })
    index = set_join._List(table, similarity)
    got = sorted((min(a, b), max(a, b)) for p, q in index.partners() for a, b in zip(p.tolist(), q.tolist(), strict=True) if rows[a][3] != rows[b][3])
    want = []
    for a, x in enumerate(rows):
        for b in range(a + 1, len(rows)):
            y = rows[b]
            most = min(x[1] - x[2], y[1] - y[2])
            if x[0] == y[0] and x[3] != y[3] and min(x[1], y[1]) >= similarity * max(x[1], y[1]) - 1e-9 and most >= similarity / (1 + similarity) * (x[1] + y[1]) - 1e-9:
                want.append((a, b))
    assert got == want
