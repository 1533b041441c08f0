"""As-of replies, cached vectors, outcomes, SQL names and streamed sessions: edge cases and plain versions."""

import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediafold.functions import sniff, sql_names, text
from mediafold.operators import asof, vector_cache
from mediafold.sources import outcomes
from mediafold.streaming import sessions


@pytest.mark.parametrize("levels,span,group", [(0, 10.0, 4096), (1, 3.0, 2), (2, 1.0, 2)])
def test_latest_reply(spark, monkeypatch, levels, span, group):
    monkeypatch.setattr(asof, "GROUP", group)
    rng = random.Random(levels)
    rows = [(k, rng.choice("aab"), float(rng.randint(0, 60)), "x") for k in range(80)] + [(90, None, 5.0, "x"), (91, "a", None, "x"), (92, "none", 7.0, "x"), (0, "a", -3.0, "y")]
    replies = [(rng.choice("aab"), float(rng.randint(0, 60)), rng.randint(0, 5)) for _ in range(25)] + [("a", 20.0, 9), ("a", 20.0, 1), (None, 1.0, 1), ("b", None, 1), ("c", 1.0, 1)]
    got = asof.latest_reply(spark.createDataFrame(rows, "id int, who string, at double, reply_of string").repartition(3), spark.createDataFrame(replies, "who string, at double, said int"), "who", "at", ["said"], span, levels).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [(t, s) for w, t, s in replies if w is not None and t is not None and r["at"] is not None and w == r["who"] and t <= r["at"]]
        assert (tuple(r["reply"]) if r["reply"] else None) == max(before, default=None)


def test_latest_reply_without_replies(spark):
    rows = spark.createDataFrame([(1, "a", datetime.datetime(2024, 1, 1))], "id int, who string, at timestamp")
    assert asof.latest_reply(rows, rows.filter("false"), "who", "at", ["id"]).first()["reply"] is None
    assert asof.latest_reply(rows.filter("false"), rows, "who", "at", ["id"]).count() == 0


def test_float_codec(spark):
    rows = [(0, [1.5, -0.0, 3e38]), (1, []), (2, None), (3, [1.0, None])]
    got = spark.createDataFrame(rows, "k int, v array<float>").select("k", vector_cache.packed_floats(F.col("v")).alias("b")).withColumn("w", vector_cache.unpacked_floats("b")).collect()
    for r in got:
        v = rows[r["k"]][1]
        want = None if v is None or None in v else np.array(v, "<f4")
        assert (r["b"] is None and r["w"] is None) if want is None else (bytes(r["b"]) == want.tobytes() and r["w"] == want.tolist())
    assert spark.createDataFrame([(b"abc",)], "b binary").select(vector_cache.unpacked_floats("b")).first()[0] is None


def test_vectors_are_computed_once(spark, tmp_path):
    asked = str(tmp_path / "asked")
    os.mkdir(asked)

    def embed(contents):
        with open(os.path.join(asked, str(random.random())), "w") as f:
            f.write("\n".join(c.decode() for c in contents))
        return np.array([[len(c), 1.0] for c in contents]).reshape(-1, 2)

    def computed():
        found = sorted(line for name in os.listdir(asked) for line in open(os.path.join(asked, name)).read().splitlines())
        for name in os.listdir(asked):
            os.remove(os.path.join(asked, name))
        return found

    key = vector_cache.content_key(F.lit("m"), F.col("text"))
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id int, text string").withColumn("key", key)
    store = vector_cache.VectorCache(spark, f"file://{tmp_path}/store", 2)
    run = lambda df, s=store: {r["id"]: (r["vector"], r["hit"]) for r in s.vectors(df, "key", vector_cache.by_batches(embed, "text", "key")).collect()}
    assert run(rows) == {1: ([1.0, 1.0], False), 2: ([2.0, 1.0], False), 3: ([1.0, 1.0], False), 4: (None, False)} and computed() == ["a", "bb"]
    assert run(rows) == {1: ([1.0, 1.0], True), 2: ([2.0, 1.0], True), 3: ([1.0, 1.0], True), 4: (None, False)} and computed() == []
    more = rows.unionByName(spark.createDataFrame([(5, "ccc")], "id int, text string").withColumn("key", key))
    assert run(more)[5] == ([3.0, 1.0], False) and computed() == ["ccc"]
    entry = store.entries().filter(F.col("key") == rows.filter("id = 1").first()["key"])
    short = entry.withColumn("data", F.expr("substring(data, 1, 7)")).collect()
    cut = vector_cache.VectorCache(spark, f"file://{tmp_path}/cut", 2)
    assert cut.keep(spark.createDataFrame(short, vector_cache.ENTRY)) and run(rows, cut)[1] == ([1.0, 1.0], False) and computed() == ["a", "bb"]
    (tmp_path / "blocked").write_text("a file")
    assert run(rows, vector_cache.VectorCache(spark, f"file://{tmp_path}/blocked/x", 2))[2] == ([2.0, 1.0], False)  # can't be kept


def test_outcomes_in_one_pass(spark, tmp_path):
    rows = [(1, b"\xff\xd8", 10, None), (2, b"text", 20, None), (3, b"BM", 30, "broken"), (4, None, None, "gone"), (5, b"BM", 5, None)]
    path = str(tmp_path / "out")
    counted = outcomes.write_outcomes(spark.createDataFrame(rows, "id int, header binary, bytes long, error string"), path)
    assert counted == {"entry": {"files": 2, "bytes": 15}, "skipped": {"files": 2, "bytes": 20}, "error": {"files": 1, "bytes": 30}}
    assert {r["id"]: r["outcome"] for r in spark.read.parquet(path).collect()} == {1: "entry", 2: "skipped", 3: "error", 4: "skipped", 5: "entry"}
    none = outcomes.write_outcomes(spark.createDataFrame([], "id int, header binary, bytes long, error string"), str(tmp_path / "none"))
    assert all(c == {"files": 0, "bytes": 0} for c in none.values())


def test_sql_names_are_the_functions(spark):
    sql_names.register(spark)
    heads = [bytes.fromhex(h) for h in ("FFD8", "89504E470D0A1A0A", "FFE0", "FFDF", "524946460000000057415645", "5249464600000000574156", "1A45DFA3", "000000186674797069736F6D", "0000001866747970", "", "4D4D002A")] + [None]
    paths = ["a/Big_DoorCreak-01.wav", "x", "", "/", None, "A/B.C/ÄÖ 7.tar.gz", ".hidden", "no\nline.x\ny"]
    df = spark.createDataFrame([(h, p) for h in heads for p in paths], "h binary, p string")
    mime = sniff.mime_of(F.col("h"))
    both = df.select(mime.alias("a"), F.expr("mf_sniff(h)").alias("b"), sniff.modality_of(sniff.kind_of(mime)).alias("c"), F.expr("mf_modality(mf_kind(mf_sniff(h)))").alias("d"), text.humanize(F.col("p")).alias("e"), F.expr("mf_humanize(p)").alias("f"), text.truncated(F.col("p"), 3).alias("g"), F.expr("mf_truncated(p, 3)").alias("i"))
    for r in both.collect():
        assert (r["a"], r["c"], r["e"], r["g"]) == (r["b"], r["d"], r["f"], r["i"])
    zero = spark.sql("SELECT t.* FROM VALUES (array(0.0D, 0.0D)), (CAST(NULL AS ARRAY<DOUBLE>)) AS v(x), LATERAL mf_zero_shot(x, array(named_struct('lid', 1L, 'vec', array(1.0D, 0.0D))), 0D, 0D, 0D, 3, 0D) AS t")
    assert zero.count() == 0


T0 = datetime.datetime(2024, 1, 1)
EVENT = "id long, who string, at timestamp, value double"


def run_stream(spark, tmp_path, files, delay):
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    for n, rows in enumerate(files):
        timed = [(i, w, T0 + datetime.timedelta(minutes=m), v) for i, w, m, v in rows]
        spark.createDataFrame(timed, EVENT).coalesce(1).write.parquet(f"{folder}/{n}")
        os.utime(f"{folder}/{n}", (n, n))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    found = sessions.sessions(stream, "who", "at", ["id"], "10 minutes", delay, [F.sum("value").alias("total")])
    out, check = str(tmp_path / "table"), str(tmp_path / "check")
    query = sessions.upsert(found, out, check)
    query.awaitTermination()
    return out, check, found, query


def test_sessions_of_a_stream_out_of_order(spark, tmp_path):
    files = [[(1, "a", 0, 1.0), (2, "a", 14, 2.0), (3, "b", 3, 1.0)], [(4, "a", 7, 4.0), (1, "a", 0, 1.0), (2, "a", 14, 2.0)], [(9, "end", 5000, 0.0)]]
    out, check, found, query = run_stream(spark, tmp_path, files, "1 hour")
    got = {(r["who"], int((r["start"] - T0).total_seconds() // 60), int((r["end"] - T0).total_seconds() // 60)): (r["n"], r["total"]) for r in sessions.latest(spark, out, ["who", "start"]).collect()}
    assert got == {("a", 0, 24): (3, 7.0), ("b", 3, 13): (1, 1.0)} and sessions.late_rows(query) == 0
    before = sorted(os.listdir(out))
    sessions.upsert(found, out, check).awaitTermination()  # nothing new
    assert sorted(os.listdir(out)) == before and sessions.latest(spark, out, ["who", "start"]).count() == 2


def test_late_rows_are_counted(spark, tmp_path):
    # a batch's late rows are those behind the watermark of the batch before it
    files = [[(1, "a", 0, 1.0)], [(2, "a", 500, 1.0)], [(4, "b", 501, 1.0)], [(3, "a", 1, 5.0)], [(9, "end", 5000, 0.0)]]
    out, _, _, query = run_stream(spark, tmp_path, files, "5 minutes")
    assert sessions.late_rows(query) >= 1
    assert sorted((r["who"], r["n"], r["total"]) for r in sessions.latest(spark, out, ["who", "start"]).collect()) == [("a", 1, 1.0), ("a", 1, 1.0), ("b", 1, 1.0)]


def test_the_latest_batch_wins(spark, tmp_path):
    for n, v in ((0, "old"), (1, "new")):
        spark.createDataFrame([("k", v), (f"only{n}", v)], "key string, v string").write.parquet(str(tmp_path / f"batch={n}"))
    assert {tuple(r) for r in sessions.latest(spark, str(tmp_path), ["key"]).collect()} == {("k", "new"), ("only0", "old"), ("only1", "new")}
