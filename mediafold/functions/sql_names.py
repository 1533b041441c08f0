"""The library's functions by name, for queries written in SQL alone. Each is SQL itself, so Catalyst sees through it and nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from mediafold.functions.sniff import BRANDS, HEADER_BYTES, RIFF, STARTS

_VEC = "ARRAY<DOUBLE>"
_VOCAB = f"ARRAY<STRUCT<lid: BIGINT, vec: {_VEC}>>"


def _mime_sql() -> str:
    starts = " ".join(f"WHEN startswith(h, '{s}') THEN '{mime}'" for s, mime in STARTS)
    riff = " ".join(f"WHEN length(h) = {2 * HEADER_BYTES} AND startswith(h, '52494646') AND substring(h, 17, 8) = '{form}' THEN '{mime}'" for form, mime in RIFF)
    boxed = f"length(h) = {2 * HEADER_BYTES} AND substring(h, 9, 8) = '66747970'"
    brands = " ".join("WHEN {} AND substring(h, 17, 8) IN ({}) THEN '{}'".format(boxed, ", ".join(f"'{b}'" for b in names), mime) for names, mime in BRANDS)
    return f"""CASE {starts} WHEN startswith(h, '494433') OR h RLIKE '^FF[EF]' THEN 'audio/mpeg' {riff} WHEN startswith(h, '1A45DFA3') THEN 'video/x-matroska'
WHEN startswith(h, '49492A00') OR startswith(h, '4D4D002A') THEN 'image/tiff' {brands} WHEN {boxed} THEN 'video/mp4' END"""


#: name, parameters, what it returns, body.
FUNCTIONS = (
    ("mf_mime_of_hex", "h STRING", "STRING", _mime_sql()),
    ("mf_sniff", "content BINARY", "STRING", f"mf_mime_of_hex(hex(substring(content, 1, {HEADER_BYTES})))"),
    ("mf_kind", "mime STRING", "STRING", "substring_index(mime, '/', 1)"),
    ("mf_modality", "kind STRING", "STRING", "if(kind = 'image', 'vision', kind)"),
    (
        "mf_humanize", "path STRING", "STRING",
        r"coalesce(nullif(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(translate(regexp_replace(element_at(split(path, '/'), -1), r'(?s)\.[^.]*$', ''), '_-', '  '), '(?<=[a-z])(?=[A-Z])', ' '), '[0-9]', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), r'(?U)\s+', ' '), r'(?U)^\s+|\s+$', ''), ''), if(path IS NULL, NULL, 'sound'))",
    ),
    ("mf_truncated", "text STRING, n INT", "STRING", "if(char_length(text) > n, concat(left(text, n), '…'), text)"),
    ("mf_dot", f"a {_VEC}, b {_VEC}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x)"),
    ("mf_norm", f"v {_VEC}", "DOUBLE", "sqrt(aggregate(v, 0.0D, (s, x) -> s + x * x))"),
    ("mf_unit", f"v {_VEC}", _VEC, "if(mf_norm(v) > 0, transform(v, x -> x / mf_norm(v)), v)"),
    (
        "mf_ranked", f"v {_VEC}, vocab {_VOCAB}", "ARRAY<STRUCT<negative: DOUBLE, lid: BIGINT>>",
        "if(mf_norm(v) >= 2.2250738585072014E-308D AND NOT isnan(mf_norm(v)) AND mf_norm(v) < double('infinity'), array_sort(transform(vocab, e -> named_struct('negative', -(aggregate(zip_with(v, e.vec, (x, y) -> x * y), 0.0D, (s, x) -> s + x) / mf_norm(v)), 'lid', e.lid))), NULL)",
    ),
)

#: name, parameters, columns, query.
TABLE_FUNCTIONS = (
    (
        "mf_zero_shot", f"v {_VEC}, vocab {_VOCAB}, hi DOUBLE, lo DOUBLE, margin DOUBLE, k INT, rel DOUBLE", "rk BIGINT, lid BIGINT, s DOUBLE",
        """SELECT pos + 1, x.lid, -x.negative FROM (SELECT posexplode(slice(ranking, 1, k)) AS (pos, x), -ranking[0].negative AS top, coalesce(-get(ranking, 1).negative, 0.0D) AS second
FROM (SELECT mf_ranked(v, vocab) AS ranking)) WHERE (top >= hi OR (top >= lo AND top - second >= margin)) AND -x.negative >= top * rel""",
    ),
)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for name, parameters, returns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    for name, parameters, columns, query in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
