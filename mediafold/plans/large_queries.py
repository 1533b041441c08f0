"""Queries of what must not pass through one task: the ordered document, large vocabularies, spectrograms and resampling over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.functions.text import path_order
from mediafold.operators.blocked import ranked_blocks, zero_shot_blocks
from mediafold.operators.dsp import CUTOFF, FLOOR
from mediafold.operators.ordered import FRAMES, laid_out
from mediafold.operators.render import json_records, markdown_blocks, text_blocks
from mediafold.operators.signals import bank_table, blackman_harris, fitted, reflected, resampled, resampled_arrays, spectra
from mediafold.operators.zeroshot import AUDIO
from mediafold.plans.text_queries import RENDER_SQL, record_rows
from mediafold.scratch import written

_BLOCKS = {"text": text_blocks, "markdown": markdown_blocks, "json": lambda rows: json_records(rows).withColumnRenamed("json", "block")}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_layout(spark, sf_dir):
    """Where each part's block stands in the one document of all parts, for each kind of document: position, first byte and length."""
    kinds = []
    records = written(record_rows(spark, sf_dir, int(spark.conf.get("spark.sql.shuffle.partitions"))), "records")  # made once for all kinds
    for kind, blocks in _BLOCKS.items():
        laid = laid_out(blocks(records), [path_order(F.col("path"))], "block", FRAMES[kind])
        kinds.append(laid.select(F.lit(kind).alias("kind"), "path", "position", "offset", "length"))
    return reduce(DataFrame.unionByName, kinds)


def large_vocabulary_top(spark, sf_dir):
    """All vectors as labels of each other: the six best of each, ties in label order."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = ranked_blocks(rows, rows.toDF("lid", "vec"), 6).select("vec_id", F.posexplode("ranking").alias("pos", "r"))
    return found.select("vec_id", (F.col("pos") + 1).cast("long").alias("rk"), F.col("r.lid").alias("lid"), F.round("r.s", 6).alias("s"))


def large_vocabulary_tags(spark, sf_dir):
    """The sounds' gate over all other vectors of even number as labels, in small blocks."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked, labels = rows.filter("vec_id % 2 = 1"), rows.filter("vec_id % 2 = 0").toDF("lid", "vec")
    found = zero_shot_blocks(asked, labels, AUDIO, label_block=100, row_block=64)
    return found.select("vec_id", F.array_join(F.transform("tags", lambda t: t["lid"].cast("string")), ",").alias("tags"), F.round("confidence", 6).alias("confidence"))


FFT, HOP, BANDS = 32, 16, 6
_RATE, _LOW, _HIGH = 8000, 200.0, 3800.0


def log_mel_documents(spark, sf_dir):
    """Each text's bytes as a sound of 8 kHz: all frames of its spectrogram."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("samples"))
    found = spectra(docs, ["doc_id"], "samples", FFT, HOP, bank_table(BANDS, FFT, _RATE, _LOW, _HIGH))
    return found.select("doc_id", F.col("frame").cast("long").alias("frame"), *(F.round(F.col("bands")[b], 4).alias(f"band{b}") for b in range(BANDS)))


RATE_IN, RATE_OUT, TAPS = 44_100, 48_000, 16


def resampled_vectors(spark, sf_dir):
    """Each vector as a signal of 44.1 kHz, at 48 kHz."""
    out = resampled_arrays(_table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", RATE_IN, RATE_OUT, TAPS)
    return out.select("vec_id", "k", F.round("value", 6).alias("value"))


STEP, REACH = 3600.0, 7200.0


def resampled_events(spark, sf_dir):
    """Each user's values, which come at any time, as a signal with a value an hour: the weighted mean of the values up to two hours away."""
    rows = _table(spark, sf_dir, "events").select("user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    rows = rows.withColumn("t", F.col("t") / 1e6)
    found = resampled(rows, ["user_id"], "t", "value", STEP, REACH, lambda d: blackman_harris(d / REACH))
    return found.filter("weight > 0.01").select("user_id", "k", F.round(F.col("total") / F.col("weight"), 6).alias("value"), "n")


def fitted_vectors(spark, sf_dir):
    """Each vector cut to 40 numbers, repeated to 150, and mirrored by 5 at both ends: sums of the numbers times their places."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    forms = F.array(*(F.struct(F.lit(form).alias("form"), x.alias("x")) for form, x in (("cut", fitted(F.col("v"), 40)), ("repeated", fitted(F.col("v"), 150)), ("mirrored", reflected(F.col("v"), 5)))))
    rows = rows.select("vec_id", F.inline(forms))
    total = F.aggregate(F.zip_with("x", F.sequence(F.lit(1), F.size("x")), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", "form", F.size("x").cast("long").alias("n"), F.round(total, 6).alias("total"))


QUERIES = {f.__name__: f for f in (document_layout, large_vocabulary_top, large_vocabulary_tags, log_mel_documents, resampled_vectors, resampled_events, fitted_vectors)}


def _layout_sql(kind: str) -> str:
    frame = FRAMES[kind]
    head, gap, tail = (len(x.encode()) for x in (frame.head, frame.separator, frame.tail))
    return f"""SELECT '{kind}' AS kind, path, nr - 1 AS position, CASE WHEN nr = 1 THEN 0 ELSE earlier + {head - gap} END AS "offset",
CASE WHEN nr = 1 THEN {head} ELSE {gap} END + n + CASE WHEN nr = total THEN {tail} ELSE 0 END AS length
FROM (SELECT path, n, row_number() OVER w AS nr, count(*) OVER () AS total, coalesce(sum(n + {gap}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
FROM (SELECT path, block, strlen(block) AS n FROM (SELECT path, {'json' if kind == 'json' else 'block'} AS block FROM ({RENDER_SQL[kind]}))) WINDOW w AS (ORDER BY string_split(path, '/'), block))"""


_UNIT = "u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
_MEL = "CASE WHEN {0} >= 1000 THEN 15 + ln({0} / 1000.0) / (ln(6.4) / 27) ELSE {0} * 3 / 200.0 END"
_HZ = "CASE WHEN {0} >= 15 THEN 1000 * exp(ln(6.4) / 27 * ({0} - 15)) ELSE {0} * 200 / 3.0 END"
_LOW_MEL, _HIGH_MEL = _MEL.format(f"{_LOW}"), _MEL.format(f"{_HIGH}")
_WINDOW = "(0.35875 - 0.48829 * cos(pi() * ({0} + 1)) + 0.14128 * cos(2 * pi() * ({0} + 1)) - 0.01168 * cos(3 * pi() * ({0} + 1)))"
_SCALE = min(1.0, RATE_OUT / RATE_IN) * CUTOFF

SQL = {
    "document_layout": " UNION ALL ".join(_layout_sql(k) for k in _BLOCKS),
    "large_vocabulary_top": f"""WITH {_UNIT}, s AS (SELECT a.vec_id, b.vec_id AS lid, list_dot_product(a.v, b.v) AS s FROM u AS a, u AS b),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, lid) AS rk FROM s) SELECT vec_id, rk, lid, round(s, 6) AS s FROM k WHERE rk <= 6""",
    "large_vocabulary_tags": f"""WITH {_UNIT}, s AS (SELECT a.vec_id, b.vec_id AS lid, list_dot_product(a.v, b.v) AS s FROM u AS a, u AS b WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, lid) AS rk FROM s),
g AS (SELECT vec_id, max(CASE WHEN rk = 1 THEN s END) AS best, coalesce(max(CASE WHEN rk = 2 THEN s END), 0) AS nxt FROM k GROUP BY vec_id),
t AS (SELECT *, best >= {AUDIO.hi} OR (best >= {AUDIO.lo} AND best - nxt >= {AUDIO.margin}) AS fine FROM g)
SELECT t.vec_id, CASE WHEN fine THEN string_agg(lid, ',' ORDER BY rk) FILTER (WHERE rk <= {AUDIO.k} AND s >= best * {AUDIO.rel}) END AS tags, CASE WHEN fine THEN round(best, 6) END AS confidence
FROM t JOIN k ON k.vec_id = t.vec_id GROUP BY t.vec_id, fine, best""",
    "log_mel_documents": f"""WITH h AS (SELECT doc_id, string_split(hex(encode(text)), '') AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
s AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(list_transform(range(0, n), lambda i: ((strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 - 128) / 128.0::DOUBLE)) AS v FROM h),
p AS (SELECT doc_id, n, q, (q - {FFT // 2} + 1000 * greatest(2 * n - 2, 1)) % greatest(2 * n - 2, 1) AS m FROM (SELECT doc_id, n, unnest(range(0, n + {FFT})) AS q FROM h)),
x AS (SELECT p.doc_id, p.n, q, v FROM p JOIN s ON s.doc_id = p.doc_id AND s.i = least(m, greatest(2 * p.n - 2, 1) - m)),
f AS (SELECT doc_id, frame, q - frame * {HOP} AS j, v FROM (SELECT doc_id, n, q, v, q // {HOP} - d AS frame FROM x, range(0, {FFT // HOP}) AS r(d)) WHERE frame >= 0 AND frame <= n // {HOP}),
w AS (SELECT k, j, (0.5 - 0.5 * cos(2 * pi() * j / {FFT})) * cos(2 * pi() * k * j / {FFT}) AS c, (0.5 - 0.5 * cos(2 * pi() * j / {FFT})) * sin(2 * pi() * k * j / {FFT}) AS z FROM range(0, {FFT // 2 + 1}) AS a(k), range(0, {FFT}) AS b(j)),
y AS (SELECT doc_id, frame, k, sum(v * c) ** 2 + sum(v * z) ** 2 AS power FROM f JOIN w USING (j) GROUP BY ALL),
e AS (SELECT i, {_HZ.format(f'(({_LOW_MEL}) + (({_HIGH_MEL}) - ({_LOW_MEL})) * i / {BANDS + 1}.0)')} AS hz FROM range(0, {BANDS + 2}) AS r(i)),
b AS (SELECT a.i AS band, k, greatest(0, least((k * {_RATE}.0 / {FFT} - a.hz) / (b.hz - a.hz), (c.hz - k * {_RATE}.0 / {FFT}) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS weight
FROM e AS a JOIN e AS b ON b.i = a.i + 1 JOIN e AS c ON c.i = a.i + 2, range(0, {FFT // 2 + 1}) AS r(k)),
m AS (SELECT doc_id, frame, band, 10 * log10(greatest(sum(power * weight), {FLOOR})) AS db FROM y JOIN b USING (k) GROUP BY ALL)
SELECT doc_id, frame, {', '.join(f'round(max(CASE WHEN band = {b} THEN db END), 4) AS band{b}' for b in range(BANDS))} FROM m GROUP BY ALL""",
    "resampled_vectors": f"""WITH s AS (SELECT vec_id, len(embedding) AS n, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
o AS (SELECT vec_id, unnest(range(0, n * {RATE_OUT} // {RATE_IN})) AS k FROM (SELECT DISTINCT vec_id, n FROM s)),
w AS (SELECT o.vec_id, k, v, k * ({RATE_IN}::DOUBLE / {RATE_OUT}) - i AS d FROM o JOIN s ON s.vec_id = o.vec_id AND s.i BETWEEN k * ({RATE_IN}::DOUBLE / {RATE_OUT}) - {TAPS // 2} AND k * ({RATE_IN}::DOUBLE / {RATE_OUT}) + {TAPS // 2})
SELECT vec_id, k, round(sum(v * {_SCALE} * CASE WHEN abs(d * {_SCALE} * pi()) < 1e-12 THEN 1 ELSE sin(d * {_SCALE} * pi()) / (d * {_SCALE} * pi()) END * {_WINDOW.format(f'd / {TAPS // 2}')}), 6) AS value FROM w GROUP BY vec_id, k""",
    "resampled_events": f"""WITH s AS (SELECT user_id, value, epoch_us(ts) / 1e6 AS t FROM events),
o AS (SELECT DISTINCT user_id, unnest(range(greatest(ceil((t - {REACH}) / {STEP})::BIGINT, 0), floor((t + {REACH}) / {STEP})::BIGINT + 1)) AS k FROM s),
w AS (SELECT o.user_id, k, value, {_WINDOW.format(f'((k * {STEP} - t) / {REACH})')} AS w FROM o JOIN s ON s.user_id = o.user_id AND t BETWEEN k * {STEP} - {REACH} AND k * {STEP} + {REACH})
SELECT user_id, k, round(sum(w * value) / sum(w), 6) AS value, count(*) AS n FROM w GROUP BY user_id, k HAVING sum(w) > 0.01""",
    "fitted_vectors": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, len(embedding) AS n FROM embeddings),
f AS (SELECT vec_id, 'cut' AS form, list_transform(range(0, 40), lambda j: v[(j + CASE WHEN n >= 40 THEN (n - 40) // 2 ELSE 0 END) % n + 1]) AS x FROM e
UNION ALL SELECT vec_id, 'repeated', list_transform(range(0, 150), lambda j: v[(j + CASE WHEN n >= 150 THEN (n - 150) // 2 ELSE 0 END) % n + 1]) FROM e
UNION ALL SELECT vec_id, 'mirrored', list_concat(list_concat(list_reverse(v[2:6]), v), list_reverse(v[n - 5:n - 1])) FROM e)
SELECT vec_id, form, len(x) AS n, round(list_sum(list_transform(x, lambda a, i: a * i)), 6) AS total FROM f""",
}
