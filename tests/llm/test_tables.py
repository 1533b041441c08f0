"""op5, op6, op10, the pipeline, and the registered queries."""

import hashlib
import io
import math
import random
import re
import time
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediafold.llm import catalog, path_templates, wav_fingerprint
from mediafold.llm._common import new_path
from mediafold.llm.compaction import CommitConflict, ShardStore, op6_tiered_compaction

URLS = [
    "http://A.Example.COM/en/7817?x=1", "https://example.com/en/55", "http://other.com/en/9", "http://x.net/de/81", "http://example.net/de/81", "http://m.example.net/de/9#top", "http://notexample.net/de/81",
    "http://h.org/es", "http://h.org/es/", "http://h.org?x://y", "http://h.org#f", "no scheme", "", None, "://", "a://b://c/d", "http://com/en/", "http://deep.org/" + "/".join(f"s{k}" for k in range(40)),
    "http://h.org/%E4/ü/a.b.html", "http://h.org/a\nb?c",
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in path_templates.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_templates(rows, depth, children, z):
    """(host, template) of each url and its purity, by the method's definition; rows: (host, path, good, bad)."""
    segments = []
    for _, path, _, _ in rows:
        s = path.split("/")
        segments.append([*s[:depth], "**"] if depth is not None and len(s) > depth else s)
    depth = max(map(len, segments)) if depth is None else depth
    templates = [[] for _ in rows]
    for d in range(max(map(len, segments))):
        below, labelled = defaultdict(set), Counter()
        plain = [s[d] if d == 0 or d == depth else re.sub("[0-9]+", "*", s[d]) if len(s) > d else None for s in segments if len(s) > d]
        plain = dict(zip([k for k, s in enumerate(segments) if len(s) > d], plain, strict=True))
        for k, name in plain.items():
            node = (rows[k][0], tuple(templates[k]))
            below[node].add(name)
            labelled[node, name] += rows[k][2] + rows[k][3]
        for k, name in plain.items():
            node = (rows[k][0], tuple(templates[k]))
            rare = 0 < d != depth and len(below[node]) > children and not labelled[node, name]
            templates[k] = [*templates[k], re.sub(r"^[^.]+", "*", name) if rare else name]
    branches = [list(t) for t in templates]
    for d in reversed(range(1, min(max(map(len, templates)), depth + 1))):
        own, pool = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        parents = [[*b[:d], "*", *b[d + 1 :]] if len(b) > d else b for b in branches]
        for (host, _, good, bad), b, p in zip(rows, branches, parents, strict=True):
            for at, key in ((own, (host, *b)), (pool, (host, *p))):
                at[key][0] += good
                at[key][1] += good + bad
        new, siblings = [], defaultdict(set)
        for (host, *_), b, p in zip(rows, branches, parents, strict=True):
            siblings[(host, *p)].add(tuple(b))
        for (host, *_), b, p in zip(rows, branches, parents, strict=True):
            (g, k), (pg, pk) = own[(host, *b)], pool[(host, *p)]
            share = (pg + 1) / (pk + 2)
            new.append(b if len(siblings[(host, *p)]) < 2 or abs(g - k * share) > z * math.sqrt(k * share * (1 - share)) else p)
        branches = new
    good, bad = sum(r[2] for r in rows), sum(r[3] for r in rows)
    prior = good / (good + bad) if good + bad else 1.0
    total = defaultdict(lambda: [0, 0])
    for (host, _, g, b), t in zip(rows, branches, strict=True):
        total[(host, *t)][0] += g
        total[(host, *t)][1] += g + b
    return [("/".join(t), (total[(r[0], *t)][0] + path_templates.PRIOR * prior) / (total[(r[0], *t)][1] + path_templates.PRIOR)) for r, t in zip(rows, branches, strict=True)]


def judged_and_wanted(spark, urls, labels, rules, **how):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("good", F.lit("x"))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["page_id"]: r for r in path_templates.judge_urls(pages, known, rules, **how).collect()}
    by_id = defaultdict(lambda: [0, 0])
    for i, q in labels:
        if q is not None:
            by_id[i][q != 1] += 1
    rows = [(*brute_parts(u), *by_id[k]) for k, u in enumerate(urls)]
    return got, brute_templates(rows, how.get("depth", 8), how.get("children", 16), path_templates.Z), rows


def test_url_edges(spark):
    got, want, rows = judged_and_wanted(spark, URLS, [(0, 1), (1, 0), (1, None), (None, 0), (999, 0), (5, 1)], path_templates.RULES)
    for k, ((template, purity), (host, path, _, _)) in enumerate(zip(want, rows, strict=True)):
        rule, said = brute_rule(host, path)
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[k]
        assert r["template"] == template and abs(r["purity"] - purity) < 1e-5
        assert r["verdict"] == (said or ("block" if purity < 0.5 else "allow"))
    assert (got[0]["rule"], got[1]["rule"], got[6]["rule"]) == ("example.com/en/7", "com/en/", "net/de/")


def test_impure_branches_are_rejected_and_alike_ones_merged(spark):
    urls, labels = [], []
    for k in range(400):
        section = ("spam", "news", "blog", "shop")[k % 4]
        urls.append(f"http://site.org/{section}/{k}.html")
        if k % 2 == 0 or section == "spam":
            labels.append((k, int(section != "spam")))
    for k in range(40):
        urls.append(f"http://wide.org/tag{chr(97 + k % 26)}{chr(97 + k // 26)}/x")
    got, want, _ = judged_and_wanted(spark, urls, labels, ())
    assert all(got[k]["template"] == t and abs(got[k]["purity"] - p) < 1e-5 for k, (t, p) in enumerate(want))
    assert all((got[k]["verdict"] == "block") == (k % 4 == 0) for k in range(400))
    assert {got[k]["template"] for k in range(400, 440)} == {"/*/x"}


def test_frequent_sections_are_judged_at_any_number_of_siblings_and_depth(spark):
    urls, labels = [], []
    for k in range(900):
        section = "casino" if k % 3 == 0 else f"topic{chr(97 + k % 20)}"  # over 16 sections
        urls.append(f"http://many.org/{section}/p{k}")
        labels.append((k, int(section != "casino")))
    for k in range(900, 1000):
        section = ("spam", "news")[k % 2]
        urls.append(f"http://deep.org/a/b/c/d/e/f/g/h/i/{section}/p{k}")
        labels.append((k, int(section != "spam")))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = path_templates.judge_urls(pages, spark.createDataFrame(labels, "doc_id long, quality int"), depth=None).collect()
    assert len(rows) == 1000 and all((r["verdict"] == "block") == ("/casino/" in r["path"] or "/spam/" in r["path"]) for r in rows)


@pytest.mark.parametrize("children", [1, 3, 16])
def test_templates_of_all_levels(spark, children):
    rng = random.Random(children)
    urls = URLS * 2 + [f"http://{rng.choice('xy')}.org/" + "/".join(rng.choice(["a", "b", f"n{rng.randrange(30)}", rng.choice("cdefghijklmnopqrstuvwxyz")]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    labels = [(k, rng.randint(0, 1)) for k in range(len(urls)) if k % 3 == 0] + [(7, 1), (7, 0)]
    got, want, rows = judged_and_wanted(spark, urls, labels, (), depth=None, children=children)
    for k, (template, purity) in enumerate(want):
        assert got[k]["template"] == template and abs(got[k]["purity"] - purity) < 1e-5, urls[k]


def test_a_path_of_many_segments_takes_no_pass_a_segment(spark):
    long = "http://deep.org/" + "/".join(f"s{k}" for k in range(1000))
    began = time.monotonic()
    got, want, _ = judged_and_wanted(spark, [long, long, long + "/x", "http://deep.org/a"], [(0, 1)], (), depth=None)
    assert [got[k]["template"] for k in range(4)] == [t for t, _ in want] and time.monotonic() - began < 60


def test_no_urls_and_no_labels(spark):
    got, want, _ = judged_and_wanted(spark, URLS, [], ())
    assert len(got) == len(URLS) and all(r["verdict"] == "allow" for r in got.values())
    pages = spark.createDataFrame([], "page_id long, url string")
    assert path_templates.judge_urls(pages, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_rules_and_parts_of_the_pages(spark, sf):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = path_templates.op5_path_templates(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = brute_parts(urls[r["page_id"]])
        rule, said = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (said is None or r["verdict"] == said)


def test_rules_are_the_contract_s(spark):
    # written out here, not read from the module
    contract = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    assert [(kind, host + path) for kind, host, path in path_templates.RULES] == contract
    urls = ["http://a.com/en/1", "http://m.example.com/en/71", "http://x.net/de/81", "http://example.net/de/9", "http://m.example.net/de/81", "http://h.org/es/1", "http://h.org/fr/1"]
    pages, none = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in path_templates.judge_urls(pages, none, path_templates.RULES, depth=None).collect()}
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")]
    assert [got[k] for k in range(len(urls))] == want


@pytest.fixture
def store(spark):
    return ShardStore(spark, new_path(spark, "test-store"), target_bytes=20_000, fanout=3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_compaction_keeps_all_rows_and_bounds_small_shards(spark, store, edge_docs):
    want = []
    for k in range(7):
        arrival = edge_docs.withColumn("doc_id", F.col("doc_id") + 100 * k)
        store.append(arrival, rows_per_shard=4)
        want += rows_of(arrival)
        before = store.manifest().count()
        store.compact()
        assert rows_of(store.read()) == sorted(want, key=repr)
        tiers = store.tiers(store.manifest()).filter("tier IS NOT NULL").groupBy("tier").count().collect()
        assert all(r["count"] < 3 for r in tiers) and store.manifest().count() <= before
    assert store.manifest().agg(F.sum("rows")).first()[0] == len(want)


def test_old_versions_stay_readable_until_vacuum(spark, store, edge_docs):
    store.append(edge_docs, rows_per_shard=2)
    first = store.versions()[-1]
    store.compact()
    assert store.versions()[-1] > first and rows_of(store.read(first)) == rows_of(store.read())
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert len(store.versions()) == 1 and rows_of(store.read()) == rows_of(edge_docs)


def test_a_second_writer_of_a_version_fails(store, edge_docs):
    store.append(edge_docs)
    with pytest.raises(CommitConflict):
        store._commit(store.manifest(), store.versions()[-1])
    assert rows_of(store.read()) == rows_of(edge_docs)


def test_vacuum_spares_a_write_that_is_not_committed(store, edge_docs, monkeypatch):
    store.append(edge_docs, rows_per_shard=2)
    commit = ShardStore._commit

    def late(self, shards, version):
        monkeypatch.setattr(ShardStore, "_commit", commit)
        assert self.vacuum() == 0  # the arrival's files are there, no version has them
        return commit(self, shards, version)

    monkeypatch.setattr(ShardStore, "_commit", late)
    store.append(edge_docs)
    assert rows_of(store.read()) == sorted(2 * rows_of(edge_docs), key=repr)
    assert store._pending(1) == set()
    folder = store._begin()  # a writer that died
    edge_docs.write.parquet(folder)
    assert store.vacuum() == 0 and store.vacuum(pending_hours=-1) > 0
    assert len(rows_of(store.read())) == 2 * edge_docs.count()


@pytest.mark.parametrize("action", ["append", "compact"])
def test_a_second_writer_tries_again(store, edge_docs, monkeypatch, action):
    for _ in range(3):
        store.append(edge_docs, rows_per_shard=50)
    commit = ShardStore._commit

    def second(self, shards, version):
        monkeypatch.setattr(ShardStore, "_commit", commit)
        self.append(edge_docs)
        return commit(self, shards, version)

    monkeypatch.setattr(ShardStore, "_commit", second)
    store.append(edge_docs) if action == "append" else store.compact()
    assert rows_of(store.read()) == sorted((5 if action == "append" else 4) * rows_of(edge_docs), key=repr)


def test_a_merge_of_merged_shards_is_given_up(store, edge_docs, monkeypatch):
    for _ in range(3):
        store.append(edge_docs, rows_per_shard=50)
    commit = ShardStore._commit

    def second(self, shards, version):
        monkeypatch.setattr(ShardStore, "_commit", commit)
        self.compact()
        return commit(self, shards, version)

    monkeypatch.setattr(ShardStore, "_commit", second)
    with pytest.raises(CommitConflict):
        store.compact()
    assert rows_of(store.read()) == sorted(3 * rows_of(edge_docs), key=repr)


def test_compaction_query(spark, sf):
    docs = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_tiered_compaction(spark, sf).collect()
    assert len(got) == len(docs) and {r["doc_id"]: r["text_sha256"] for r in got} == docs
    for (rows, _), n in Counter((r["shard_rows"], r["shard_bytes"]) for r in got).items():
        assert n % rows == 0
    assert len({r["version"] for r in got}) == 1 and got[0]["version"] >= 4


def test_empty_arrivals_and_stores(store, edge_docs, no_docs):
    assert store.compact() == 0 and store.versions() == []
    store.append(edge_docs)
    n = store.manifest().count()
    store.append(no_docs)
    assert store.manifest().count() == n and rows_of(store.read()) == rows_of(edge_docs)


def test_wav_edges(edge_docs, no_docs, edge_rows):
    got = wav_fingerprint.fingerprint_media(wav_fingerprint.text_to_wav(edge_docs), digests=True).collect()
    want = []
    for i, t in edge_rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), None))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "error")
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(want)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["payload_sha256"]].add((r["feature"], r["media_sha256"], r["media_bytes"]))
    assert all(len(x) == 1 for x in by_text.values())
    assert wav_fingerprint.text_to_wav(no_docs).count() == 0


def test_peaks_of_tones_and_shift(spark):
    t = np.arange(wav_fingerprint.HOP * 60)
    envelope = 0.5 + 0.5 * np.sin(2 * np.pi * t / (wav_fingerprint.HOP * 10))
    x = 100 * envelope * np.sin(2 * np.pi * 20 / wav_fingerprint.FRAME * t)
    times, bins = wav_fingerprint.spectral_peaks(x.astype(np.float32))
    assert np.bincount(bins).argmax() == 20
    one = set(zip(*wav_fingerprint.landmarks(x.astype(np.float32)), strict=True))
    two = set(zip(*wav_fingerprint.landmarks(np.concatenate([np.zeros(wav_fingerprint.HOP * 7), x]).astype(np.float32)), strict=True))
    assert len({(a + 7, c) for a, c in one} & two) > 0.8 * len(one)
    assert len(wav_fingerprint.landmarks(np.zeros(5000, np.float32))[0]) == 0


def plain_landmarks(x):
    """From the definition, a frame at a time."""
    w = wav_fingerprint
    n = max(1, -(-len(x) // w.HOP))
    x = np.concatenate([x, np.zeros((n + 1) * w.HOP - len(x))])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(w.FRAME) / w.FRAME)
    power = [np.abs(np.fft.rfft(x[t * w.HOP : t * w.HOP + w.FRAME] * window)) ** 2 for t in range(n)]
    best = [[max(range(low, high), key=lambda k: (p[k], -k)) for low, high in zip(w.BANDS, w.BANDS[1:], strict=False)] for p in power]  # noqa: B023
    peaks = []
    for t in range(n):
        for b, k in enumerate(best[t]):
            loud = power[t][k]
            beside = [power[t][j] for j in (k - 1, k + 1) if j < len(power[t])]
            before = power[t - 1][best[t - 1][b]] if t else -1
            after = power[t + 1][best[t + 1][b]] if t + 1 < n else -1
            if loud > 1e-3 and loud >= max(beside) and loud >= before and loud > after:
                peaks.append((t, k))
    out = []
    for i, (t, f) in enumerate(peaks):
        for u, g in peaks[i + 1 : i + 1 + w.FAN_OUT]:
            if u - t <= w.REACH:
                out.append((t, f << 16 | g << 6 | (u - t)))
    return sorted(out)


def test_landmarks_against_a_plain_version():
    rng = np.random.default_rng(4)
    for n in (1, 95, 192, 500, 5000, 300_000):
        x = rng.normal(size=n).astype(np.float32) * 50 + 30 * np.sin(np.arange(n) / 3).astype(np.float32)
        if n > 100_000:  # long sounds are transformed in several blocks
            x = x[: (wav_fingerprint.FRAMES_AT_ONCE + 50) * wav_fingerprint.HOP]
        assert list(zip(*(a.tolist() for a in wav_fingerprint.landmarks(x)), strict=True)) == plain_landmarks(x)


def test_filters_on_an_empty_table(spark, no_docs):
    from mediafold.llm import block_naming, toxicity_chain

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert block_naming.drop_exact_duplicates(no_docs).count() == 0
    kept = toxicity_chain.keep_clean(no_docs, toxicity_chain.fit_chain(no_docs, labels, toxicity_chain.label_categories(labels)))
    assert kept.columns == no_docs.columns and kept.count() == 0


def test_other_widths_channels_and_broken_media(spark):
    files = [(1, None), (2, b"no wav"), (3, b"")]
    for k, (width, channels) in enumerate([(1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((channels, width, 8000, 0, "NONE", ""))
            w.writeframes(bytes(range(240)) * channels * width)
        files.append((10 + k, out.getvalue()))
    got = {r["k"]: r for r in wav_fingerprint.fingerprint_media(spark.createDataFrame(files, "k int, media binary"), "k").collect()}
    assert got[1]["times"] is None and got[1]["error"] is None and got[2]["error"] and got[3]["error"]
    assert all(got[k]["times"] is not None and len(got[k]["times"]) == len(got[k]["codes"]) for k in range(10, 15))


def test_pipeline_stages(spark, tmp_path):
    """Planted toxic documents, copies and near copies go; every other document is packed whole."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = [r for r in docs.orderBy("doc_id").collect() if len((r["text"] or "").split()) > 150][:6]
    planted = [(10_000 + k, r["text"], r["lang"], "planted", r["n_chars"]) for k, r in enumerate(base)]
    planted += [(11_000 + k, "  ".join(r["text"].split(" ")), r["lang"], "planted", 1) for k, r in enumerate(base)]
    planted += [(12_000 + k, r["text"] + " Addendum.", r["lang"], "planted", 1) for k, r in enumerate(base)]
    planted += [(13_000 + k, f"number {k} you idiot moron, pathetic stupid loser of a worthless clown {k}", "en", "planted", 1) for k in range(5)]
    here = str(tmp_path / "data")
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).repartition(3, "doc_id").write.parquet(f"{here}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{here}/labels.parquet")
    kept = {"": {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{here}/documents.parquet").collect()}}
    now = spark.read.parquet(f"{here}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, here)
        assert out.columns == docs.columns
        out.write.parquet(f"{here}/{name}")
        now = spark.read.parquet(f"{here}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{here}/labels.parquet").collect()}
    gone = kept[""].keys() - kept["toxicity"].keys()
    assert set(range(13_000, 13_005)) <= gone and sum(toxic.get(i) == 0 for i in gone) <= 2
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i in sorted(kept["toxicity"]):
        first.setdefault(normal(kept["toxicity"][i]), i)
    assert kept["exact_dedup"].keys() == set(first.values())
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in kept["exact_dedup"].items() for w in [t.lower().split()]}
    left = kept["simhash_dedup"].keys()
    order = sorted(shingles)
    near = {i: [j for j in order if j != i and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])] for i in order}
    assert all(near[i] for i in shingles.keys() - left)  # only documents with a near copy go
    assert not any(near[i] and set(near[i]) & left for i in left) and not set(range(12_000, 12_006)) & left
    pieces = corpus_pipeline.packing(spark, now, here).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in pieces} == left and all(r["n"] == r["all"] for r in pieces)


def test_all_numbers_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries()) == list(range(1, 14))
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
