"""Queries over texts, names and JSON of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.functions.metadata import short_values
from mediafold.functions.text import clean_tags, data_url, humanize, last_lines, path_order, sidecar_path, truncated
from mediafold.operators.jsonspan import extract_json
from mediafold.operators.merge import collapsed, first_error
from mediafold.operators.render import json_records, markdown_blocks, text_blocks
from mediafold.plans.tag_queries import human_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def humanize_part_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", humanize(F.concat_ws("/", "p_type", F.concat("p_name", F.lit("-No7.wav")))).alias("name"))


def humanize_customer_names(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", humanize(F.col("c_name")).alias("name"))


def humanize_urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", humanize(F.col("url")).alias("name"))


def content_sha256(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


def duplicate_content(spark, sf_dir):
    """Hashes that several documents share: partial counts first, so a frequent one is no burden."""
    rows = _table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def props_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return _table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.get_json_object("props", "$.missing").try_cast("double").alias("missing"))


def long_string_filter(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents")
    kept = short_values(F.create_map(F.lit("text"), F.col("text"), F.lit("lang"), F.col("lang")))
    return rows.select("doc_id", F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("kept"))


def truncate_error(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", truncated(F.col("text"), 200).alias("message"))


def clean_fields(spark, sf_dir):
    words = F.split("text", " ")
    padded = F.transform(words, lambda w: F.concat(F.lit(" \t"), F.translate(w, ".,", "  "), F.lit("\n")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(clean_tags(padded), "|").alias("tags"))


def data_urls(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", data_url(F.lit("text/plain"), F.col("text").cast("binary")).alias("url"))


def sidecar_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", sidecar_path(F.col("p_name"), ".mediafold.json").alias("path"))


def stderr_tail(spark, sf_dir):
    text = F.translate("text", " ", "\n")
    return _table(spark, sf_dir, "documents").select("doc_id", last_lines(text, 5).alias("tail"))


def component_sort(spark, sf_dir):
    """All pages in path order: a range sort, which deals a busy host's pages to several tasks."""
    key = path_order(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(key, "|").alias("components"), key.alias("key")).orderBy("key", "page_id").drop("key")


def _records(spark, sf_dir, tasks: int | None = None) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    parts = parts if tasks is None else parts.repartition(tasks, "p_partkey")
    error = F.when(F.col("p_partkey") % 50 == 0, F.lit("unreadable"))
    rows = parts.select(
        F.concat(F.lit("parts/"), "p_name").alias("path"), F.lit("image").alias("type"), F.col("p_size").cast("long").alias("bytes"),
        F.when(F.col("p_partkey") % 4 != 0, F.array("p_brand", "p_type")).alias("tags"), humanize(F.col("p_name")).alias("description"), error.alias("error"),
        F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(F.col("p_size").alias("width"), F.struct(F.col("p_brand").alias("make")).alias("exif")))).alias("metadata"), "p_partkey",
    )
    return rows


def record_rows(spark, sf_dir, tasks: int | None = None) -> DataFrame:
    """A record for each part; every fiftieth is an error row. tasks: deal the parts to so many, as a table of few bytes is read by few."""
    return collapsed(_records(spark, sf_dir, tasks)).withColumn("path", F.concat_ws("#", "path", "p_partkey"))


def _rendered(blocks):
    def query(spark, sf_dir):
        return blocks(record_rows(spark, sf_dir))

    return query


def strict_exit(spark, sf_dir):
    """The row that decides a strict run."""
    rows = _records(spark, sf_dir)
    return first_error(rows.withColumn("path", F.concat_ws("/", "path", F.lpad("p_partkey", 9, "0")))).select("path", "error")


def extract_json_span(spark, sf_dir):
    reply = F.concat(F.lit("Sure: "), F.to_json(F.struct("role", "text")), F.lit(" {and so on"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", extract_json(F.when(F.col("turn") % 3 != 1, reply).otherwise(F.col("text"))).alias("span"))


QUERIES = {
    f.__name__: f
    for f in (
        humanize_part_names, humanize_customer_names, humanize_urls, content_sha256, duplicate_content, props_extract, long_string_filter, truncate_error, clean_fields, data_urls,
        sidecar_names, stderr_tail, component_sort, strict_exit, extract_json_span,
    )
} | {"render_text": _rendered(text_blocks), "render_markdown": _rendered(markdown_blocks), "render_json": _rendered(json_records)}

_RECORD = f"""(SELECT 'parts/' || p_name || '#' || p_partkey AS path, p_partkey % 50 = 0 AS bad, p_size AS bytes, CASE WHEN p_partkey % 4 <> 0 THEN p_brand || ', ' || p_type END AS tags,
p_brand, p_type, {human_sql("p_name")} AS description, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS width FROM part)"""


_META = "E'  metadata:\\n    {\\n      \"exif\": {\\n        \"make\": \"' || p_brand || E'\"\\n      },\\n      \"width\": ' || width || E'\\n    }\\n'"
_LINES = f"""CASE WHEN bad THEN E'  error: unreadable\\n' ELSE E'  type: image\\n  bytes: ' || bytes || coalesce(E'\\n  tags: ' || tags, '') || E'\\n  description: ' || description || E'\\n' || coalesce({_META}, '') END
|| '  path: ' || path || E'\\n'"""


SQL = {
    "humanize_part_names": f"""SELECT p_partkey, {human_sql("(p_type || '/' || p_name || '-No7.wav')")} AS name FROM part""",
    "humanize_customer_names": f"SELECT c_custkey, {human_sql('c_name')} AS name FROM customer",
    "humanize_urls": f"SELECT page_id, {human_sql('url')} AS name FROM pages",
    "content_sha256": "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents",
    "duplicate_content": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1",
    "props_extract": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE) AS missing FROM events",
    "long_string_filter": "SELECT doc_id, CASE WHEN strlen(text) <= 512 THEN 'lang,text' ELSE 'lang' END AS kept FROM documents",
    "truncate_error": "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS message FROM documents",
    "clean_fields": r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda w: trim(translate(w, '.,', '  '), E' \t\n\r')), lambda w: w <> ''), '|') AS tags FROM documents""",
    "data_urls": "SELECT doc_id, 'data:text/plain;base64,' || base64(encode(text)) AS url FROM documents",
    "sidecar_names": "SELECT p_partkey, p_name || '.mediafold.json' AS path FROM part",
    "stderr_tail": r"""SELECT doc_id, array_to_string(l[greatest(1, len(l) - 4):], E'\n') AS tail FROM (SELECT doc_id, string_split(regexp_replace(translate(text, ' ', E'\n'), '\n$', ''), E'\n') AS l FROM documents)""",
    "component_sort": "SELECT page_id, replace(url, '/', '|') AS components FROM pages",
    "strict_exit": "SELECT path, 'unreadable' AS error FROM (SELECT 'parts/' || p_name || '/' || lpad(p_partkey::VARCHAR, 9, '0') AS path FROM part WHERE p_partkey % 50 = 0) ORDER BY string_split(path, '/') LIMIT 1",
    "extract_json_span": "SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN to_json({'role': role, 'text': text})::VARCHAR END AS span FROM conversations",
    "render_text": f"SELECT path, rtrim('== ' || path || E' ==\\n' || {_LINES}, E'\\n') AS block FROM {_RECORD}",
    "render_markdown": f"SELECT path, '## ' || path || E'\\n' || {_LINES} || E'\\n' AS block FROM {_RECORD}",
    "render_json": f"""SELECT path, CASE WHEN bad THEN '{{"error":"unreadable","path":"' || path || '"}}' ELSE '{{"bytes":' || bytes || ',"description":"' || description || '"' || coalesce(',"metadata":{{"exif":{{"make":"' || p_brand || '"}},"width":' || width || '}}', '') || ',"path":"' || path || '"'
|| coalesce(CASE WHEN tags IS NOT NULL THEN ',"tags":["' || p_brand || '","' || p_type || '"]' END, '') || ',"type":"image"}}' END AS json FROM {_RECORD}""",
}

RENDER_SQL = {kind: SQL[f"render_{kind}"] for kind in ("text", "markdown", "json")}
