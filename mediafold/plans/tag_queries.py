"""Queries over the table ``embeddings``: vocabularies, scores, gates, tags, descriptions, merging, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.functions.text import confidence, describe_tags, humanize
from mediafold.operators.endpoint import MODALITIES, Endpoint, enrich
from mediafold.operators.merge import merged
from mediafold.operators.vocabulary import centred, first_vectors, norm, unit
from mediafold.operators.zeroshot import AUDIO, HYBRID, IMAGE, LOOSE, Gate, accepted, scored, shown_scores, valid_norm, zero_shot


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centred(first_vectors(_embeddings(spark, sf_dir)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_embeddings(spark, sf_dir).select("vec_id", "embedding"), _vocabulary(spark, sf_dir))


def _tags(gate: Gate):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = zero_shot(_embeddings(spark, sf_dir).select("vec_id", "embedding"), _vocabulary(spark, sf_dir), gate)
        rows = rows.select("vec_id", F.posexplode("tags").alias("pos", "tag"))
        return rows.select("vec_id", (F.col("pos") + 1).cast("long").alias("rk"), F.col("tag.lid").alias("lid"), F.round("tag.s", 6).alias("s"))

    return query


def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("vec_id", F.explode("ranking").alias("r"))
    return rows.select("vec_id", F.col("r.lid").alias("lid"), F.round("r.s", 6).alias("s"))


def label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("vec_id", F.posexplode(F.slice("ranking", 1, 3)).alias("pos", "r"))
    return rows.select("vec_id", (F.col("pos") + 1).cast("long").alias("rk"), F.col("r.lid").alias("lid"))


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", accepted(IMAGE).alias("tagged"), F.round("top", 6).alias("best"), F.round("second", 6).alias("next_best"))


def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best labels of each vector, to be shown with their scores."""
    return _scored(spark, sf_dir).select("vec_id", shown_scores(F.col("ranking"), lambda lid: F.concat(F.lit("label "), lid.cast("string"))).alias("scores"))


def l2_norm_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also with every tenth vector set to zero and every eleventh made infinite."""
    rows = _embeddings(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    factor = F.when(F.col("vec_id") % 10 == 0, F.lit(0.0)).when(F.col("vec_id") % 11 == 0, F.lit(1e200)).otherwise(F.lit(1.0))
    n = norm(F.transform("v", lambda x: x * factor))
    return rows.select("vec_id", valid_norm(n).alias("valid"), F.when(valid_norm(n), F.round(n, 6)).alias("length"))


def vocab_center_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vocabulary(spark, sf_dir).select("lid", F.posexplode("vec").alias("i", "x"))
    return rows.select("lid", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def vocab_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_vectors(_embeddings(spark, sf_dir)).select("lid", F.posexplode(unit(F.col("vec"))).alias("i", "x"))
    return rows.select("lid", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = zero_shot(_embeddings(spark, sf_dir).select("vec_id", "embedding"), _vocabulary(spark, sf_dir), LOOSE)
    return rows.withColumn("names", F.transform("tags", lambda t: F.concat(F.lit("label "), t["lid"].cast("string"))))


def tag_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _described(spark, sf_dir).filter("names IS NOT NULL")
    return rows.select("vec_id", describe_tags(F.col("names")).alias("description"), confidence(F.col("confidence")).alias("tag_confidence"))


def gated_fallback_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no label describes get their part's name."""
    rows = zero_shot(_embeddings(spark, sf_dir).select("vec_id", "embedding"), _vocabulary(spark, sf_dir), IMAGE)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("vec_id"), "p_name")
    rows = rows.filter("tags IS NULL").join(parts, "vec_id")
    return rows.select("vec_id", F.concat(humanize(F.col("p_name")), F.lit(".")).alias("description"))


def merge_local_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local tags of each vector, and as the endpoint's reply the assistant's turn of the conversation of the same number: an empty
    reply counts as a failure, the first word is its tag, odd turns have no description."""
    local = _described(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("names")).alias("tags"), confidence(F.col("confidence")).alias("tag_confidence"))
    local = local.withColumns({"description": F.when(F.col("tags").isNotNull(), describe_tags(F.col("tags"))), "model": F.when(F.col("tags").isNotNull(), F.lit("local"))})
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'assistant'")
    turns = turns.groupBy(F.col("conv_id").alias("vec_id")).agg(F.min_by("text", "turn").alias("reply"), F.min("turn").alias("turn"))
    failed = F.col("vec_id") % 7 == 0
    rows = local.join(turns, "vec_id").select(
        "*", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("llm_error"), F.lit(None).cast("string").alias("error"),
        F.when(~failed & (F.col("vec_id") % 2 == 0), F.array(F.lit(" "), F.concat(F.lit(" "), F.substring_index(F.trim("reply"), " ", 1), F.lit(" ")))).alias("llm_tags"),
        F.when(~failed & (F.col("vec_id") % 5 != 0), F.col("reply")).alias("llm_description"), F.lit(None).cast("string").alias("llm_summary"),
        F.when(~failed, F.lit("remote")).alias("llm_model"), F.when(failed, F.lit("HTTP 500")).alias("llm_failure"),
    )
    return merged(rows).select("vec_id", F.array_join("tags", "|").alias("tags"), "description", "model", "tag_confidence", "llm_error", "error")


def no_endpoint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Described vectors of three modalities, two of which have an endpoint that fails: without one a row keeps its facts and says so."""
    local = _described(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.col("names")).alias("tags"))
    modality = F.element_at(F.array(*(F.lit(m) for m in MODALITIES)), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = local.withColumns({"modality": modality, "prompt": F.lit("p"), **{c: F.lit(None).cast("string") for c in ("description", "summary", "model", "llm_error", "error")}})
    endpoints = {m: Endpoint("u", "m") for m in MODALITIES[:2]}
    asked = enrich(rows, endpoints, "ask", lambda *_: (400, '{"error": {"message": "refused"}}'), id_col="vec_id")
    out = merged(rows.join(asked.drop("llm_attempts", "llm_ms"), "vec_id"))
    return out.select("vec_id", F.array_join("tags", "|").alias("tags"), "llm_error", "error")


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = zero_shot(_embeddings(spark, sf_dir).select("vec_id", "label", "embedding"), _vocabulary(spark, sf_dir), IMAGE)
    hit = F.exists("tags", lambda t: t["lid"] == F.col("label"))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("tags").isNotNull()).alias("tagged"), F.count_if(hit).alias("hits"), F.coalesce(F.sum(F.size("tags")), F.lit(0)).alias("n_tags")
    )


QUERIES = {
    "zero_shot_tags": _tags(IMAGE), "zero_shot_audio_preset": _tags(AUDIO), "zero_shot_hybrid_preset": _tags(HYBRID), "zero_shot_loose_preset": _tags(LOOSE),
    **{f.__name__: f for f in (cosine_scores, label_topk, gate_decision, score_lines, l2_norm_guard, vocab_center_normalize, vocab_unit_vectors, tag_description, gated_fallback_description, merge_local_llm, no_endpoint_rows, coverage_report)},
}

_VOCAB = """
WITH f AS (SELECT label AS lid, arg_min(embedding, vec_id)::DOUBLE[] AS w FROM embeddings WHERE label IS NOT NULL GROUP BY label),
u AS (SELECT lid, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM f),
d AS (SELECT lid, i, w[i] AS x FROM u, range(1, 65) AS r(i)),
c AS (SELECT lid, list(x - m ORDER BY i) AS w FROM (SELECT lid, i, x, avg(x) OVER (PARTITION BY i) AS m FROM d) GROUP BY lid),
v AS (SELECT lid, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM c),
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT vec_id, label, lid, list_dot_product(e, w) / sqrt(list_dot_product(e, e)) AS s FROM e, v),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, lid) AS rk FROM s),
g AS (SELECT *, max(CASE WHEN rk = 1 THEN s END) OVER (PARTITION BY vec_id) AS best, coalesce(max(CASE WHEN rk = 2 THEN s END) OVER (PARTITION BY vec_id), 0) AS nxt FROM k)
"""


def _tagged_sql(gate: Gate) -> str:
    return f"SELECT * FROM g WHERE (best >= {gate.hi} OR (best >= {gate.lo} AND best - nxt >= {gate.margin})) AND rk <= {gate.k} AND s >= best * {gate.rel}"


def _tags_sql(gate: Gate) -> str:
    return f"{_VOCAB} SELECT vec_id, rk, lid, round(s, 6) AS s FROM ({_tagged_sql(gate)})"


_NAMED = f"n AS (SELECT vec_id, list('label ' || lid ORDER BY rk) AS names, max(best) AS best FROM ({_tagged_sql(LOOSE)}) GROUP BY vec_id)"
_SENTENCE = "'Label' || substr(array_to_string(names[1:3], ', '), 6) || '.'"
_HUMAN = r"trim(regexp_replace(translate(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace({}, '.*/', ''), '\.[^.]*$', ''), '_-', '  '), '([a-z])([A-Z])', '\1 \2', 'g'), '[0-9]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g'))"


def human_sql(column: str) -> str:
    return f"coalesce(nullif({_HUMAN.format(column)}, ''), 'sound')"


SQL = {
    "zero_shot_tags": _tags_sql(IMAGE), "zero_shot_audio_preset": _tags_sql(AUDIO), "zero_shot_hybrid_preset": _tags_sql(HYBRID), "zero_shot_loose_preset": _tags_sql(LOOSE),
    "cosine_scores": f"{_VOCAB} SELECT vec_id, lid, round(s, 6) AS s FROM s",
    "label_topk": f"{_VOCAB} SELECT vec_id, rk, lid FROM k WHERE rk <= 3",
    "gate_decision": f"{_VOCAB} SELECT vec_id, best >= {IMAGE.hi} OR (best >= {IMAGE.lo} AND best - nxt >= {IMAGE.margin}) AS tagged, round(best, 6) AS best, round(nxt, 6) AS next_best FROM g WHERE rk = 1",
    "score_lines": f"{_VOCAB} SELECT vec_id, string_agg('label ' || lid || '=' || printf('%.3f', s), ' ' ORDER BY rk) AS scores FROM k WHERE rk <= 6 GROUP BY vec_id",
    "l2_norm_guard": """
WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (CASE WHEN vec_id % 10 = 0 THEN 0.0 WHEN vec_id % 11 = 0 THEN 1e200 ELSE 1.0 END)) AS v FROM embeddings),
y AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM x)
SELECT vec_id, n >= 2.2250738585072014e-308 AND NOT isnan(n) AND NOT isinf(n) AS valid,
       CASE WHEN n >= 2.2250738585072014e-308 AND NOT isnan(n) AND NOT isinf(n) THEN round(n, 6) END AS length FROM y""",
    "vocab_center_normalize": f"{_VOCAB} SELECT lid, i - 1 AS i, round(w[i], 6) AS x FROM v, range(1, 65) AS r(i)",
    "vocab_unit_vectors": f"{_VOCAB} SELECT lid, i - 1 AS i, round(w[i], 6) AS x FROM u, range(1, 65) AS r(i)",
    "tag_description": f"{_VOCAB}, {_NAMED} SELECT vec_id, {_SENTENCE} AS description, round(best, 3) AS tag_confidence FROM n",
    "gated_fallback_description": f"""{_VOCAB} SELECT vec_id, {human_sql("p_name")} || '.' AS description FROM g JOIN part ON p_partkey = vec_id
WHERE rk = 1 AND NOT (best >= {IMAGE.hi} OR (best >= {IMAGE.lo} AND best - nxt >= {IMAGE.margin}))""",
    "merge_local_llm": f"""{_VOCAB}, {_NAMED},
l AS (SELECT e.vec_id, CASE WHEN e.vec_id % 3 <> 0 THEN names END AS tags, round(best, 3) AS tag_confidence FROM e LEFT JOIN n USING (vec_id)),
t AS (SELECT conv_id AS vec_id, arg_min(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
m AS (SELECT vec_id, tags AS names, tag_confidence, reply, vec_id % 7 = 0 AS failed FROM l JOIN t USING (vec_id)),
o AS (SELECT *, failed AND names IS NULL AS gone, trim(split_part(trim(reply), ' ', 1), E' \\t\\n\\r') AS word FROM m)
SELECT vec_id, CASE WHEN gone THEN NULL WHEN NOT failed AND vec_id % 2 = 0 THEN word ELSE array_to_string(names, '|') END AS tags,
       CASE WHEN gone THEN NULL WHEN NOT failed AND vec_id % 5 <> 0 THEN trim(reply, E' \\t\\n\\r') WHEN names IS NOT NULL THEN {_SENTENCE} END AS description,
       CASE WHEN gone THEN NULL WHEN NOT failed THEN 'remote' WHEN names IS NOT NULL THEN 'local' END AS model,
       CASE WHEN NOT gone THEN tag_confidence END AS tag_confidence, CASE WHEN failed AND NOT gone THEN 'HTTP 500' END AS llm_error, CASE WHEN gone THEN 'HTTP 500' END AS error
FROM o""",
    "no_endpoint_rows": f"""{_VOCAB}, {_NAMED},
l AS (SELECT e.vec_id, e.vec_id % 3 = 2 AS missing, CASE WHEN e.vec_id % 2 = 0 THEN names END AS names FROM e LEFT JOIN n USING (vec_id))
SELECT vec_id, array_to_string(names, '|') AS tags, CASE WHEN missing THEN 'no endpoint configured for video' WHEN names IS NOT NULL THEN 'HTTP 400: refused' END AS llm_error,
       CASE WHEN NOT missing AND names IS NULL THEN 'HTTP 400: refused' END AS error FROM l""",
    "coverage_report": f"""{_VOCAB}, t AS ({_tagged_sql(IMAGE)})
SELECT label, count(DISTINCT e.vec_id) AS vectors, count(DISTINCT t.vec_id) AS tagged, count(CASE WHEN t.lid = label THEN 1 END) AS hits, count(t.vec_id) AS n_tags
FROM e LEFT JOIN (SELECT vec_id, lid FROM t) AS t ON t.vec_id = e.vec_id GROUP BY label""",
}
