"""Queries with a store, a stream or SQL names in the middle: cached vectors, outcomes, SQL functions, sessions and as-of replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.functions.sql_names import register
from mediafold.operators.asof import latest_reply
from mediafold.operators.vector_cache import VectorCache, content_key
from mediafold.operators.zeroshot import IMAGE
from mediafold.plans.case_queries import HEADERS
from mediafold.plans.tag_queries import SQL as TAG_SQL
from mediafold.scratch import new_path
from mediafold.sources.outcomes import write_outcomes
from mediafold.streaming.sessions import latest, sessions, upsert


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cached_vectors(spark, sf_dir):
    """A small vector of each document's text through the store, twice: in the second run all is there, and documents of one text share an entry."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", content_key(F.lit("tower"), F.col("text")).alias("key"), "text")
    numbers = F.array(F.char_length("text"), F.octet_length("text"), F.size(F.split("text", " ")), F.ascii("text")).cast("array<float>")
    made = lambda missing: missing.select("key", numbers.alias("vector"))
    store = VectorCache(spark, new_path(spark, "vectors"), 4)
    first = store.vectors(docs, "key", made).groupBy("key").agg(F.count(F.lit(1)).alias("shared"), F.bool_or("hit").alias("hit_before"))
    first = first.select("key", "shared", "hit_before")
    first.write.parquet(path := new_path(spark, "first-run"))
    again = store.vectors(docs, "key", made).select("doc_id", "key", F.transform("vector", lambda x: x.cast("double")).alias("v"), "hit")
    found = again.join(spark.read.parquet(path), "key")
    return found.select("doc_id", "key", "shared", "hit_before", "hit", *(F.col("v")[k].alias(name) for k, name in enumerate(("chars", "bytes", "words", "first"))))


def outcome_counts(spark, sf_dir):
    """Each document as a file behind one of the headers, every seventeenth of which can't be read in full: what was counted on the way, and what was written."""
    docs = _table(spark, sf_dir, "documents")
    header = F.unhex(F.element_at(F.array(*map(F.lit, HEADERS)), (F.pmod("doc_id", F.lit(len(HEADERS))) + 1).cast("int")))
    files = docs.select("doc_id", header.alias("header"), F.octet_length("text").cast("long").alias("bytes"), F.when(F.col("doc_id") % 17 == 0, F.lit("read error")).alias("error"))
    counted = write_outcomes(files, path := new_path(spark, "outcomes"))
    written = spark.read.parquet(path).groupBy("outcome").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    of = lambda what: F.create_map(*(x for o, c in counted.items() for x in (F.lit(o), F.lit(c[what]).cast("long"))))[F.col("outcome")]
    return written.select("outcome", "files", "bytes", of("files").alias("observed_files"), of("bytes").alias("observed_bytes"))


def sql_zero_shot(spark, sf_dir):
    """``zero_shot_tags`` in SQL alone."""
    register(spark)
    return spark.sql(
        f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM parquet.`{sf_dir}/embeddings.parquet`),
f AS (SELECT label AS lid, mf_unit(min_by(v, vec_id)) AS v FROM e WHERE label IS NOT NULL GROUP BY label),
m AS (SELECT i, avg(x) AS mean FROM (SELECT posexplode(v) AS (i, x) FROM f) GROUP BY i),
c AS (SELECT lid, mf_unit(transform(array_sort(collect_list(struct(i, x - mean AS x))), p -> p.x)) AS vec FROM (SELECT lid, posexplode(v) AS (i, x) FROM f) JOIN m USING (i) GROUP BY lid),
w AS (SELECT sort_array(collect_list(named_struct('lid', CAST(lid AS BIGINT), 'vec', vec))) AS vocab FROM c)
SELECT vec_id, t.rk, CAST(t.lid AS INT) AS lid, round(t.s, 6) AS s FROM e CROSS JOIN w, LATERAL mf_zero_shot(v, vocab, {IMAGE.hi}D, {IMAGE.lo}D, {IMAGE.margin}D, {IMAGE.k}, {IMAGE.rel}D) AS t"""
    )


def sql_names_parts(spark, sf_dir):
    """File functions by their SQL names, over parts and documents."""
    register(spark)
    heads = ", ".join(f"'{h}'" for h in HEADERS)
    return spark.sql(
        f"""SELECT doc_id, mf_sniff(content) AS mime, mf_modality(mf_kind(mf_sniff(content))) AS modality, mf_humanize(concat('x/', source, '_Nr', doc_id, '.wav')) AS name, mf_truncated(text, 30) AS start
FROM (SELECT *, concat(unhex(element_at(array({heads}), CAST(doc_id % {len(HEADERS)} + 1 AS INT))), CAST(text AS BINARY)) AS content FROM parquet.`{sf_dir}/documents.parquet`)"""
    )


GAP, DELAY = "6 hours", "60 days"


def streamed_sessions(spark, sf_dir):
    """The users' sessions from events that come out of order in several files, some of them twice, as a stream; equal to what a batch would say."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    # a last row far ahead closes the sessions
    closing = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr(f"INTERVAL {DELAY} + INTERVAL {GAP} + INTERVAL 1 DAY")).alias("ts"), F.lit(0.0).alias("value"))
    folder = new_path(spark, "arrivals")
    for k in (3, 0, 2, 1):
        part = events.filter(F.pmod("event_id", F.lit(4)) == k).unionByName(events.filter(F.pmod("event_id", F.lit(50)) == k))
        part.coalesce(1).write.mode("append").parquet(folder)
    closing.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    found = sessions(stream, "user_id", "ts", ["event_id"], GAP, DELAY, [F.sum("value").alias("total")])
    table = new_path(spark, "sessions")
    upsert(found, table, new_path(spark, "progress")).awaitTermination()
    rows = latest(spark, table, ["user_id", "start"]).filter("user_id >= 0")
    return rows.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", F.round("total", 2).alias("total"))


def asof_events(spark, sf_dir):
    """For each purchase the user's latest click at or before it, as a local value that the reply's overwrites."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    found = latest_reply(events.filter("event_type = 'purchase'").drop("event_type"), events.filter("event_type = 'click'"), "user_id", "ts", ["event_id", "value"], span=6 * 3600.0)
    return found.select("event_id", "user_id", F.col("reply.event_id").alias("click_id"), F.coalesce("reply.value", "value").alias("value"))


QUERIES = {f.__name__: f for f in (cached_vectors, outcome_counts, sql_zero_shot, sql_names_parts, streamed_sessions, asof_events)}

_MIME = f"{list(HEADERS.values())}[doc_id % {len(HEADERS)} + 1]"
_OUTCOME = f"CASE WHEN {_MIME} = 'none' THEN 'skipped' WHEN doc_id % 17 = 0 THEN 'error' ELSE 'entry' END"

SQL = {
    "cached_vectors": """SELECT doc_id, left(sha256('tower' || text || chr(0)), 16) AS key, count(*) OVER (PARTITION BY text) AS shared, false AS hit_before, true AS hit,
length(text)::DOUBLE AS chars, strlen(text)::DOUBLE AS bytes, len(string_split(text, ' '))::DOUBLE AS words, ascii(text)::DOUBLE AS first FROM documents""",
    "outcome_counts": f"SELECT {_OUTCOME} AS outcome, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(*) AS observed_files, sum(strlen(text))::BIGINT AS observed_bytes FROM documents GROUP BY 1",
    "sql_zero_shot": TAG_SQL["zero_shot_tags"],
    "sql_names_parts": f"""SELECT doc_id, nullif({_MIME}, 'none') AS mime, CASE WHEN {_MIME} LIKE 'image/%' THEN 'vision' WHEN {_MIME} <> 'none' THEN split_part({_MIME}, '/', 1) END AS modality,
lower(regexp_replace(replace(source, '_', ' '), '[0-9]', '', 'g')) || ' nr' AS name, CASE WHEN length(text) > 30 THEN left(text, 30) || '…' ELSE text END AS start FROM documents""",
    "streamed_sessions": """WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS nr FROM s)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end, count(*) AS n, round(sum(value), 2) AS total FROM n GROUP BY user_id, nr""",
    "asof_events": """SELECT p.event_id, p.user_id, c.event_id AS click_id, coalesce(c.value, p.value) AS value
FROM (FROM events WHERE event_type = 'purchase') AS p ASOF LEFT JOIN (FROM events WHERE event_type = 'click') AS c ON p.user_id = c.user_id AND p.ts >= c.ts""",
}
