"""Shapes the JSON of external probes into metadata, a VARIANT: values keep their types, absent facts have no key, nulls of the probe stay nulls."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 512  # bytes of a metadata string
_ENTRIES = "map<string,variant>"
_ABOVE = Decimal(1 << 64)  # of unsigned numbers of 64 bits


def short_values(values: Column) -> Column:
    """The map of strings without values of over LONGEST bytes."""
    return F.map_filter(values, lambda _, v: F.octet_length(v) <= LONGEST)


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def short_entries(entries: Column) -> Column:
    """Of a map of variants those that are no string of over LONGEST bytes."""
    return F.map_filter(entries, lambda _, v: ~is_string(v) | (F.octet_length(F.try_variant_get(v, "$", "string")) <= LONGEST))


def entries_of(value: Column, path: str = "$") -> Column:
    """An object's entries; null where there is none."""
    at = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(at).startswith("OBJECT"), F.try_variant_get(at, "$", _ENTRIES))


def as_text(value: Column, path: str) -> Column:
    """A string, null where there is something else."""
    at = F.try_variant_get(value, path, "variant")
    return F.when(is_string(at), F.try_variant_get(at, "$", "string"))


def as_unsigned(value: Column, path: str) -> Column:
    """A whole number from 0 on, null where there is something else, be it the digits of one. The parser takes 64.0 for 64."""
    at = F.try_variant_get(value, path, "variant")
    whole = F.schema_of_variant(at).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    number = F.try_variant_get(at, "$", "decimal(38,0)")
    return F.when(whole & (number >= 0) & (number < F.lit(_ABOVE)), number)


def parsed_float(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def parsed_unsigned(text: Column) -> Column:
    number = F.when(text.rlike(r"^\+?[0-9]+$"), F.ltrim(text, F.lit("+")).try_cast("decimal(38,0)"))
    return F.when(number < F.lit(_ABOVE), number)


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _variant(value: Column) -> Column:
    """A number or string as a variant; null stays no value at all."""
    return F.get(F.map_values(F.try_variant_get(F.to_variant_object(F.create_map(F.lit("x"), value)), "$", _ENTRIES)), F.lit(0))


def _object(fields: dict[str, Column]) -> Column:
    """An object of those fields that have a value; the probe's own nulls are values."""
    entries = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values()))
    return F.to_variant_object(F.map_filter(entries, lambda _, v: v.isNotNull()))


def _some(value: Column, kind: str) -> Column:
    return F.when(value.isNotNull(), _variant(value.cast(kind)))


def probe_metadata(raw: Column) -> Column:
    """Metadata of a sound or a video from a container probe's JSON; null if that can't be read.

    The first video stream and the first sound stream count. A duration or bit rate that isn't a number's text is absent, and so is a sample rate that isn't
    text at all; text that is no number is a sample rate of 0. A stream's codec, size and frame rate are what the probe says, null where it says nothing.
    """
    null = F.parse_json(F.lit("null"))

    def said(stream: Column, name: str) -> Column:
        return F.when(stream.isNotNull(), F.coalesce(F.try_variant_get(stream, f"$.{name}", "variant"), null))

    def shaped(p: Column, video: Column, audio: Column) -> Column:
        tags, rate = short_entries(entries_of(p, "$.format.tags")), as_text(audio, "$.sample_rate")
        fields = {
            "duration_s": _some(parsed_float(as_text(p, "$.format.duration")), "double"), "bitrate": _some(parsed_unsigned(as_text(p, "$.format.bit_rate")), "decimal(20,0)"),
            "container": _some(as_text(p, "$.format.format_name"), "string"), "format_tags": _let(tags, lambda t: F.when(t.isNotNull(), F.to_variant_object(t))),
            "codec": said(video, "codec_name"), "width": said(video, "width"), "height": said(video, "height"), "fps": said(video, "avg_frame_rate"),
            "audio_codec": said(audio, "codec_name"), "sample_rate": F.when(rate.isNotNull(), _some(F.coalesce(parsed_unsigned(rate), F.lit(0)), "decimal(20,0)")),
        }
        return F.when(p.isNotNull(), _object(fields))

    def first(streams: Column, kind: str) -> Column:
        return F.get(F.filter(streams, lambda s: as_text(s, "$.codec_type") == kind), F.lit(0))

    def with_streams(p: Column) -> Column:
        found = _let(F.try_variant_get(p, "$.streams", "array<variant>"), lambda s: F.struct(first(s, "video").alias("video"), first(s, "audio").alias("audio")))
        return _let(found, lambda f: shaped(p, f["video"], f["audio"]))

    return _let(F.try_parse_json(raw), with_streams)


def exif_metadata(raw: Column) -> Column:
    """Metadata of an image from an EXIF tool's JSON array: width and height if they are whole numbers, and all short fields as they are under ``exif``; null if it can't be read."""

    def shaped(p: Column, first: Column) -> Column:
        fields = F.coalesce(entries_of(first), F.create_map().cast(_ENTRIES))
        kept = F.map_filter(short_entries(fields), lambda k, _: ~k.startswith("SourceFile") & (k != "ExifTool"))
        out = {"width": _some(as_unsigned(first, "$.ImageWidth"), "decimal(20,0)"), "height": _some(as_unsigned(first, "$.ImageHeight"), "decimal(20,0)"), "exif": F.to_variant_object(kept)}
        return F.when(p.isNotNull(), _object(out))

    return _let(F.try_parse_json(raw), lambda p: _let(F.get(F.try_variant_get(p, "$", "array<variant>"), F.lit(0)), lambda first: shaped(p, first)))
