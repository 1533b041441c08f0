"""Queries over file headers, sizes and durations; the bytes and numbers are the tables'."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediafold.functions.headers import over_pixel_cap
from mediafold.functions.sniff import kind_of, mime_of
from mediafold.functions.text import short_sound
from mediafold.operators.endpoint import over_inline_cap


def sniff_documents(spark, sf_dir):
    """Each text as the content behind one of eight headers, by its number, or behind none."""
    heads = F.array(*(F.lit(h) for h in _HEADS))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.concat(F.unhex(F.element_at(heads, (F.pmod("doc_id", F.lit(len(_HEADS))) + 1).cast("int"))), F.coalesce("text", F.lit("")).cast("binary"))
    mime = mime_of(content)
    return rows.select("doc_id", F.coalesce(mime, F.lit("none")).alias("mime"), F.coalesce(kind_of(mime), F.lit("none")).alias("type"))


_HEADS = ("FFD8FFE0", "424D", "664C6143", "494433", "524946460000000057415645", "1A45DFA3", "000000186674797061766966", "00")
_MIMES = ("image/jpeg", "image/bmp", "audio/flac", "audio/mpeg", "audio/wav", "video/x-matroska", "image/avif", "none")


def pixel_cap(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", over_pixel_cap(F.col("p_size").cast("long"), F.lit(100).cast("long"), 2500).alias("error"))


def short_audio_gate(spark, sf_dir):
    """Events' values as durations: which sounds are too short for the tagger."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", short_sound(F.col("value") / 100).alias("short"))


def inline_cap(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.when(over_inline_cap(F.octet_length("text"), "image", 4000).isNotNull(), F.lit("over the inline cap")).alias("error"))


QUERIES = {f.__name__: f for f in (sniff_documents, pixel_cap, short_audio_gate, inline_cap)}

SQL = {
    "sniff_documents": f"SELECT doc_id, mime, split_part(mime, '/', 1) AS type FROM (SELECT doc_id, {list(_MIMES)}[doc_id % {len(_MIMES)} + 1] AS mime FROM documents)",
    "pixel_cap": "SELECT p_partkey, CASE WHEN p_size * 100 > 2500 THEN 'image is ' || p_size || 'x100, over the cap of 2500 pixels' END AS error FROM part",
    "short_audio_gate": "SELECT event_id, value / 100 > 0 AND value / 100 < 0.35 AS short FROM events",
    "inline_cap": "SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'over the inline cap' END AS error FROM documents",
}
