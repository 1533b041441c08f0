"""Media type from the first bytes of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES = 12

# Signatures of file formats, in the order in which they are tried.
STARTS = (
    ("FFD8", "image/jpeg"),
    ("89504E470D0A1A0A", "image/png"),
    ("47494638", "image/gif"),
    ("424D", "image/bmp"),
    ("664C6143", "audio/flac"),
    ("4F676753", "audio/ogg"),
)
RIFF = (("57415645", "audio/wav"), ("57454250", "image/webp"), ("41564920", "video/avi"))
BRANDS = (
    (("4D344120", "4D344220"), "audio/mp4"),
    (("61766966", "61766973"), "image/avif"),
    (("68656963", "68656978", "6D696631", "6D736631"), "image/heic"),
)


def mime_of(content: Column) -> Column:
    """MIME type, or null where the bytes are of no known kind. A null or empty content is of no known kind."""
    h = F.hex(F.substring(content, 1, HEADER_BYTES))
    whole = F.length(h) >= 2 * HEADER_BYTES
    found = F.when(h.startswith(STARTS[0][0]), F.lit(STARTS[0][1]))
    for start, mime in STARTS[1:]:
        found = found.when(h.startswith(start), F.lit(mime))
    found = found.when(h.startswith("494433") | h.rlike("^FF[EF]"), F.lit("audio/mpeg"))
    for form, mime in RIFF:
        found = found.when(whole & h.startswith("52494646") & (F.substring(h, 17, 8) == form), F.lit(mime))
    found = found.when(h.startswith("1A45DFA3"), F.lit("video/x-matroska"))
    found = found.when(h.startswith("49492A00") | h.startswith("4D4D002A"), F.lit("image/tiff"))
    boxed = whole & (F.substring(h, 9, 8) == "66747970")
    for brands, mime in BRANDS:
        found = found.when(boxed & F.substring(h, 17, 8).isin(*brands), F.lit(mime))
    return found.when(boxed, F.lit("video/mp4"))


def kind_of(mime: Column) -> Column:
    """image, audio or video."""
    return F.substring_index(mime, "/", 1)


def modality_of(kind: Column) -> Column:
    """The endpoint modality of a kind: images are vision."""
    return F.when(kind == "image", F.lit("vision")).otherwise(kind)
