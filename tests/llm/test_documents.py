"""op1, op3, op8 and op9 against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediafold.llm import block_naming, components, ppm, simhash, simhash_similar, toxicity_chain


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [3, block_naming.BLOCK])
def test_block_naming_edges(edge_docs, no_docs, edge_rows, block):
    if block == 3:  # the long texts would take many levels
        edge_docs, edge_rows = edge_docs.filter("doc_id IS NULL OR doc_id NOT IN (5, 6)"), [r for r in edge_rows if r[0] not in (5, 6)]
    got = block_naming.exact_duplicates(edge_docs, block=block).collect()
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    members = defaultdict(list)
    for i, t in edge_rows:
        members[normal(t)].append(i)
    want = Counter()
    for t, ids in members.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[(i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in members}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    if block == block_naming.BLOCK:
        assert block_naming.exact_duplicates(no_docs).count() == 0
        kept = block_naming.drop_exact_duplicates(edge_docs)
        assert kept.columns == edge_docs.columns and kept.count() == len(members)


def test_names_tell_blocks_apart_across_salts(spark):
    rows = [(k, "hot" if k % 3 else f"b{k % 7}") for k in range(600)]
    got = block_naming.named(spark.createDataFrame(rows, "id long, block string"), ["block"], ["block"], salts=8).distinct().collect()
    assert len({r["name"] for r in got}) == len({r["block"] for r in got}) == len(got)


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: r for n, r in groups_of(edges, {x for e in edges for x in e}).items() if n != r}
    assert got == want


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aB cé\t"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(), 3) % (1 << 64) == brute_fingerprint(text)


def test_simhash_components_edges(edge_docs, no_docs, edge_rows):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(edge_docs).collect()]
    fps = [brute_fingerprint(t) for _, t in edge_rows]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    roots = groups_of(pairs, range(len(fps)))
    least = {r: min((edge_rows[k][0] for k in roots if roots[k] == r and edge_rows[k][0] is not None), default=None) for r in roots.values()}
    assert Counter(got) == Counter((i, f"{f:016x}", least[roots[k]]) for k, ((i, _), f) in enumerate(zip(edge_rows, fps, strict=True)))
    assert simhash.simhash_components(no_docs).count() == 0


def test_links_are_complete_in_sparse_and_dense_places(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:60]}
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}  # many under one key
    signed = {simhash.signed(f): f for f in fps}
    table = spark.createDataFrame([(s,) for s in signed], "fp long").withColumn("pivots", simhash.pivot_distances(F.col("fp")))
    found = [(signed[r["a"]], signed[r["b"]]) for r in simhash.links(table, bucket=20).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    order = sorted(fps)
    near = [(a, b) for i, a in enumerate(order) for b in order[:i] if (a ^ b).bit_count() <= 2]
    assert groups_of(found, fps) == groups_of(near, fps)


def test_pivot_bound_never_discards_a_linked_pair():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert max(abs((a ^ p).bit_count() - (b ^ p).bit_count()) for p in simhash.PIVOTS) <= simhash.RADIUS


def near_copies(n_groups=12, copies=5):
    rng = random.Random(11)
    rows, group = [], []
    for g in range(n_groups):
        base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
        for c in range(copies):
            w = list(base)
            if c:
                w[rng.randrange(200)] = f"new{g}x{c}"
            rows.append((len(rows), " ".join(w)))
            group.append(g)
    return rows, group


def test_near_duplicates_by_five_word_shingles(spark, tmp_path):
    rows, group = near_copies()
    clean = [(1000 + k, " ".join(f"clean{k}w{j}" for j in range(80))) for k in range(20)]
    half = [(2000, " ".join(rows[0][1].split()[:100] + [f"z{k}" for k in range(100)]))]  # shares half of a text only
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows + clean + half, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    kept = {r["doc_id"] for r in simhash_similar.drop_near_duplicates(docs).collect()}
    assert kept == {group.index(g) for g in set(group)} | {i for i, _ in clean + half}


def test_repeated_lines_do_not_hide_near_duplicates(spark, tmp_path):
    rows = []
    for k in range(20):
        line = " ".join(f"line{k}w{j}" for j in range(12))
        text = " ".join(f"text{k}w{j}" for j in range(300))
        rows += [(2 * k, f"{text} {line}"), (2 * k + 1, f"{text} {' '.join([line] * 30)}")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    kept = {r["doc_id"] for r in simhash_similar.drop_near_duplicates(spark.read.parquet(path)).collect()}
    assert kept == {2 * k for k in range(20)}


def similar_pairs(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    order = sorted(sets)
    return [(a, b) for k, b in enumerate(order) for a in order[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def family(n, shared, own, pairs):
    """n texts of one passage, 0.7 alike or less, and a near copy of each of the last ``pairs``: over 0.8."""
    passage = " ".join(f"p{k}" for k in range(shared))
    rows = [(k, f"{passage} {' '.join(f'o{k}x{j}' for j in range(own))}") for k in range(n)]
    return rows + [(n + k, " ".join(rows[n - 1 - k][1].split()[:-3] + [f"new{k}"])) for k in range(pairs)]


def test_near_duplicates_inside_a_large_family(spark, tmp_path):
    rows = family(300, 60, 14, 60)
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    kept = {r["doc_id"] for r in simhash_similar.drop_near_duplicates(spark.read.parquet(path)).collect()}
    pairs = similar_pairs(rows)
    assert len(pairs) == 60 and kept == set(groups_of(pairs, [i for i, _ in rows]).values())


@pytest.mark.parametrize("block", [8, simhash_similar.BLOCK])
def test_candidates_hold_every_similar_pair(spark, block):
    rng = random.Random(7)
    rows = family(60, 40, 8, 20)
    for size in (5, 8, 9, 12, 19, 30, 90, 250):  # sets of 1, 4, 5, 8, 15, 26, 86, 246 shingles, also at just 0.8
        for _ in range(12):
            w = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            cut = rng.randrange(max(1, size // 4))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[cut:])), (len(rows) + 2, " ".join(w + w[:cut] * rng.randrange(1, 5)))]
    docs = spark.createDataFrame(rows, "row long, text string")
    counts = simhash_similar.slot_counts(docs, 5)
    shared = simhash_similar.first_shared(docs.mapInArrow(simhash_similar._signatures(counts, 5, 0.8), simhash_similar.SIGNATURE))
    found = {(r["a"], r["b"]) for r in simhash_similar.other_candidates(shared, 0.8, block).collect()}
    pairs = similar_pairs(rows)
    assert len(pairs) > 150 and set(pairs) <= found and len(found) < 2 * len(pairs)
    linked = spark.createDataFrame([(b, a) for a, b in pairs[::2]], "node long, root long").dropDuplicates(["node"])
    root = {r["node"]: r["root"] for r in linked.collect()}
    rest = {(r["a"], r["b"]) for r in simhash_similar.other_candidates(simhash_similar.still_shared(shared, linked), 0.8, block).collect()}
    assert rest == {(a, b) for a, b in found if root.get(a, a) != root.get(b, b)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB \t\ncé\x00"), max_size=60)), min_size=1, max_size=6), st.integers(1, 80), st.integers(1, 5))
def test_shingle_sets(texts, at_once, words):
    raw = [None if t is None else t.encode() for t in texts]
    before, simhash_similar.AT_ONCE = simhash_similar.AT_ONCE, at_once
    try:
        cut = list(simhash_similar.shingle_sets(raw, words))
    finally:
        simhash_similar.AT_ONCE = before
    whole = list(simhash_similar.shingle_sets(raw, words))
    brute = [set(simhash_similar._byte_shingles(t, words)) for t in raw]
    assert len(cut) == len(raw) and all((a == b).all() and len(a) == len(s) for a, b, s in zip(cut, whole, brute, strict=True))
    for a, p in zip(whole, brute, strict=True):
        for b, q in zip(whole, brute, strict=True):
            assert len(np.intersect1d(a, b)) == len(p & q)


@pytest.mark.parametrize("work", ["_pairs", "_nearest"])
def test_cells_in_batches_are_those_of_one_batch(work):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n, words = 600, simhash_similar.FOLD
    cell = np.sort(rng.integers(0, 30, n))
    folds = np.repeat(rng.integers(0, 1 << 62, (n // 6, words)), 6, axis=0)[rng.permutation(n)]
    columns = [cell, np.arange(n), np.arange(n), np.full(n, 50, np.int32), np.zeros(n, np.int32), np.full(n, 2, np.int8), np.zeros(n, np.int64)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([f.tobytes() for f in folds])], ["cell", "row", "root", "size", "place", "side", "sketch", "fold"])
    found = lambda parts: {tuple(x.values()) for out in getattr(simhash_similar, work)(0.8)(iter(parts)) for x in out.to_pylist()}
    one = found([batch])
    assert one == found([batch.slice(k, 7) for k in range(0, n, 7)]) == found([batch.slice(k, 90) for k in range(0, n, 90)])
    assert len(one) > 30


def test_dedup_keeps_columns_of_any_name(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b", 77, 7), (2, "a  b", 78, 8), (3, "c", 79, 9)], "doc_id long, text string, row int, _ROW int").write.parquet(path)
    docs = spark.read.parquet(path)
    for drop in (simhash_similar.drop_near_duplicates, block_naming.drop_exact_duplicates):
        kept = drop(docs)
        assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b", 77, 7), (3, "c", 79, 9)]


def test_near_duplicate_edges(edge_docs, no_docs):
    kept = simhash_similar.drop_near_duplicates(edge_docs)
    texts = Counter(" ".join((r["text"] or "").encode().lower().decode().split()) for r in kept.collect())
    assert kept.columns == edge_docs.columns and texts["a b"] == 1 and texts["the same text, twice over."] == 1
    assert simhash_similar.drop_near_duplicates(no_docs).count() == 0


def brute_ppm(train, texts, order):
    """Log10 probabilities, from the definition."""
    follow = defaultdict(Counter)
    seq = lambda t: b"\n" * order + b" ".join(ppm.words_of((t or "").encode())) + b"\n"
    for t in train:
        s = seq(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                follow[s[i - k : i]][s[i]] += 1

    def p(context, symbol):
        out, excluded = 1.0, set()
        for k in range(order, -1, -1):
            seen = follow.get(context[len(context) - k :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out * left[symbol] / total
            out *= len(left) / total
            excluded |= set(left)
        return out / (ppm.ALPHABET - len(excluded))

    return [sum(math.log10(p(s[i - order : i], s[i])) for i in range(order, len(s))) for s in map(seq, texts)], p


def test_ppm_against_the_definition(edge_docs, no_docs, edge_rows):
    docs = edge_docs.filter("doc_id IS NULL OR doc_id NOT IN (5, 6)")
    rows = [r for r in edge_rows if r[0] not in (5, 6)]
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    got = ppm.ppm_scores(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 != 1, order=3, chunk_bytes=64).collect()
    scores, p = brute_ppm([t for i, t in rows if train(i)], [t for _, t in rows], 3)
    counts = Counter(w for i, t in rows if train(i) for w in [*ppm.words_of((t or "").encode()), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, t), s in zip(rows, scores, strict=True):
        w = [*ppm.words_of((t or "").encode()), None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((i, not train(i), len(w), sum(counts[x] > 0 for x in w), n, round(base, 6), round(s, 6)))
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got), key=repr) == sorted(want, key=repr)
    symbols = set(range(256)) - set(range(9, 14)) | {10}
    for context in (b"\n\n\n", b"zzz", b" b\n", b"a b"):
        assert abs(sum(p(context, s) for s in symbols) - 1) < 1e-9
    assert ppm.ppm_scores(no_docs, F.lit(True)).count() == 0
    unlearnt = ppm.ppm_scores(docs.filter("doc_id = 4"), F.lit(False)).first()
    assert unlearnt["n_known"] == 0 and abs(unlearnt["score"] - 4 * math.log10(1 / ppm.ALPHABET)) < 1e-9


def test_ppm_beats_single_words_on_held_out_texts(spark):
    r = ppm.op8_ppm(spark, "/root/testdata/sf0.1").groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert all(x["s"] > x["b"] for x in r) and len(r) == 2


def test_chain_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    train, test = labels.filter(part != 0), labels.filter(part == 0)
    models = toxicity_chain.fit_chain(docs, train, toxicity_chain.label_categories(train), train_rows=2500)
    scored = toxicity_chain.score_chain(docs.join(test.select("doc_id"), "doc_id", "left_semi"), models, ["low_quality", "toxic"]).join(test, "doc_id")
    n = {(r["toxic"], r["rejected"]): r["n"] for r in scored.groupBy("toxic", "rejected").agg(F.count("*").alias("n")).collect()}
    assert n[(1, True)] >= 0.95 * (n[(1, True)] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.01 * n[(0, False)]


def test_chain_feeds_earlier_odds_to_later_models():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 500, 12)) for _ in range(400)]
    earlier = rng.normal(size=(400, 1)) * 3
    y = (earlier[:, 0] + rng.normal(size=400) * 0.2 > 0).astype(float)
    w = toxicity_chain.Linear.fit(rows, earlier, y)
    assert w[toxicity_chain.FEATURES] > 1


@pytest.mark.parametrize("seed", range(4))
def test_fit_reaches_newton_s_optimum(seed):
    rng = np.random.default_rng(seed)
    rows = [np.unique(rng.integers(0, 60, rng.integers(0, 12))) for _ in range(150)]
    earlier = rng.random((150, seed % 3))
    y = (np.array([len(r) for r in rows]) + 6 * earlier.sum(axis=1) + rng.normal(size=150) * 3 > 7).astype(float)
    dense = np.zeros((150, 60))
    for at, r in enumerate(rows):
        dense[at, r] = 1
    good, df = (dense * y[:, None]).sum(axis=0), dense.sum(axis=0)
    ratio = np.log((good + 1) / (y.sum() + 1)) - np.log((df - good + 1) / (150 - y.sum() + 1))
    x = np.column_stack([dense * ratio * (df >= 2), earlier, np.ones(150)])
    penalty = np.diag([toxicity_chain.L2] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's method, with all second derivatives
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    got = toxicity_chain.Linear.fit(rows, earlier, y)
    found = np.array([toxicity_chain.Linear.probability(got, r, e) for r, e in zip(rows, earlier, strict=True)])
    own = np.where(ratio * (df >= 2) != 0, got[:60] / np.where(ratio == 0, 1, ratio), 0)  # of the scaled features
    v = np.concatenate([own, got[toxicity_chain.FEATURES :]])
    value = lambda z, u: np.logaddexp(0, z).sum() - y @ z + (penalty @ u) @ u / 2
    best = value(x @ w, w)
    assert best - 1e-6 <= value(x @ v, v) < 1.001 * best  # it stops where a step gains a ten-thousandth
    assert np.abs(found - 1 / (1 + np.exp(-x @ w))).max() < 0.05


def plain_features(text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    number = lambda x, level: int(toxicity_chain._numbers(np.array([x], np.uint32), level)[0])
    out = {number(zlib.crc32(w.encode()) & ~1, 0) for w in words}
    for level in toxicity_chain.LEVELS:
        for beginning, n in Counter(w[:k] for w in words for k in toxicity_chain.PREFIXES if len(w) >= k).items():
            if n >= level:
                out.add(number(zlib.crc32(beginning.encode()) | 1, level))
    return sorted(out)


def test_chain_against_a_plain_version(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["badword", "badwords", "good", "plain", "gooder", "other"]) + "xyzw"[: rng.randrange(5)] for _ in range(rng.randrange(12)))) for i in range(90)]
    rows += [(rows[0][0], "zz repeated id"), (None, "badword"), (200, None)]
    truth = [(i, 1 - ("plain" in t), int("badword" in t)) for i, t in rows[:90:2]] + [(200, None, 0), (rows[2][0], 0, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    models = toxicity_chain.fit_chain(docs, labels, toxicity_chain.label_categories(labels), folds=3)
    fold = {r[0]: r[1] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3))).collect()}
    text = {i: t for i, t in reversed(rows)}
    own = [(fold[i], [None if q is None else 1 - q, x], np.array(plain_features(text[i]), np.int64)) for i, q, x in truth]
    assert all(np.array_equal(f, toxicity_chain.features(text[i])) for (i, _, _), (_, _, f) in zip(truth, own, strict=True))
    earlier = np.zeros((len(own), 0))
    for k, model in enumerate(models):
        fit = lambda use: toxicity_chain.Linear.fit([own[i][2] for i in use], earlier[use], np.array([own[i][1][k] for i in use], float))  # noqa: B023, E731
        known = [i for i in range(len(own)) if own[i][1][k] is not None]
        assert np.allclose(model, fit(known), atol=1e-3)
        out_of_fold = np.zeros(len(own))
        for f in range(3):
            without = fit([i for i in known if own[i][0] != f])
            for i in range(len(own)):
                if own[i][0] == f:
                    out_of_fold[i] = toxicity_chain.Linear.probability(without, own[i][2], earlier[i])
        earlier = np.column_stack([earlier, out_of_fold])
    p = {(r["doc_id"], r["p_low_quality"], r["p_toxic"]) for r in toxicity_chain.score_chain(docs, models, ["low_quality", "toxic"]).collect()}
    first = toxicity_chain.Linear.probability(models[0], np.array(plain_features("badword"), np.int64), [])
    assert any(i is None and abs(a - first) < 1e-9 and abs(b - toxicity_chain.Linear.probability(models[1], np.array(plain_features("badword"), np.int64), [first])) < 1e-9 for i, a, b in p)


def test_chain_scores_many_texts_as_each_alone(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "1 2 3"] + [" ".join("abcdefgh"[: rng.randrange(9)] + rng.choice("xyzw") for _ in range(rng.randrange(400))) for _ in range(300)]
    weights = [np.random.default_rng(k).normal(size=toxicity_chain.FEATURES + 1 + k).astype(np.float32) for k in range(2)]
    monkeypatch.setattr(toxicity_chain, "AT_ONCE", 1500)
    assert [t for g in toxicity_chain._groups(texts) for t in g] == texts
    found = toxicity_chain.probabilities(weights, texts)
    for text, (a, b) in zip(texts, found, strict=True):
        own = np.array(sorted(plain_features(text)), np.int64)
        first = toxicity_chain.Linear.probability(weights[0], own, [])
        assert abs(a - first) < 1e-9 and abs(b - toxicity_chain.Linear.probability(weights[1], own, [first])) < 1e-9
    assert toxicity_chain.probabilities(weights, []).shape == (0, 2)


def test_chain_with_a_labelled_id_of_many_rows(spark):
    rows = [(1, f"text {k % 7}") for k in range(5000)] + [(2, "fine words"), (3, "bad words")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    once = docs.filter("doc_id <> 1").unionByName(docs.filter("text = 'text 0'").limit(1))
    many, few = (toxicity_chain.fit_chain(d, labels, toxicity_chain.label_categories(labels)) for d in (docs, once))
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(many, few, strict=True))


def test_chain_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(14, 1, 1), (14, 1, 1), (4, 1, 0), (11, None, 0), (12, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("false"), labels.filter("toxic = 0")):
        models = toxicity_chain.fit_chain(edge_docs, some, toxicity_chain.label_categories(some))
        assert len(models) == 2 and all(np.isfinite(m).all() for m in models)
        rows = toxicity_chain.score_chain(edge_docs, models, ["low_quality", "toxic"]).collect()
        assert len(rows) == edge_docs.count() and all(0 <= r["p_toxic"] <= 1 for r in rows)
        kept = toxicity_chain.keep_clean(edge_docs, models)
        assert kept.columns == edge_docs.columns and kept.count() == sum(not r["rejected"] for r in rows)
        assert toxicity_chain.score_chain(no_docs, models, ["low_quality", "toxic"]).count() == 0
    assert not any(r["rejected"] for r in rows)
