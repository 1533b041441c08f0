"""Records as text, Markdown and JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediafold.operators.merge import as_records

_SHOWN = ("error", "type", "bytes", "mtime", "sha256", "tags", "description", "summary", "model", "duration_ms")
_MAY_BE_EMPTY = ("error", "type", "sha256")


def pretty(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _metadata_lines(texts: pd.Series) -> pd.Series:
    """Lines of pretty JSON, four blanks before each; text that is no JSON is shown as a string."""

    def shown(text: str | None) -> str | None:
        if not isinstance(text, str):
            return None
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        return None if value is None else "".join(f"    {line}\n" for line in pretty(value).split("\n"))

    return texts.map(shown)


def field_lines() -> Column:
    """The shown fields of a record, two blanks before each, one a line; those that are null or empty are left out."""

    def shown(name: str) -> Column:
        value = F.col(name).cast("string")
        if name == "tags":
            value = F.when(F.size("tags") > 0, F.array_join("tags", ", "))
        elif name == "duration_ms":
            value = F.concat(value, F.lit("ms"))
        elif name not in _MAY_BE_EMPTY:
            value = F.nullif(value, F.lit(""))
        return F.coalesce(F.concat(F.lit(f"  {name}: "), value, F.lit("\n")), F.lit(""))

    metadata = F.coalesce(F.concat(F.lit("  metadata:\n"), _metadata_lines("metadata")), F.lit(""))
    return F.concat(*(shown(n) for n in _SHOWN), metadata, F.lit("  path: "), F.col("path"), F.lit("\n"))


def text_blocks(rows: DataFrame) -> DataFrame:
    """path and block: a heading with the path, then its fields."""
    rows = as_records(rows)
    return rows.select("path", F.regexp_replace(F.concat(F.lit("== "), "path", F.lit(" ==\n"), field_lines()), r"\s+$", "").alias("block"))


def markdown_blocks(rows: DataFrame) -> DataFrame:
    rows = as_records(rows)
    return rows.select("path", F.concat(F.lit("## "), "path", F.lit("\n"), field_lines(), F.lit("\n")).alias("block"))


def json_records(rows: DataFrame) -> DataFrame:
    """path and json: an object without its null fields; metadata is an object in it, other text there a string."""
    rows = as_records(rows)
    nested = F.coalesce(F.try_parse_json("metadata"), F.col("metadata").cast("variant")).alias("metadata")
    return rows.select("path", F.to_json(F.struct(*(nested if c == "metadata" else F.col(c) for c in rows.columns))).alias("json"))


@F.pandas_udf(T.StringType())
def _indented(records: pd.Series) -> pd.Series:
    return records.map(lambda r: "  " + pretty(json.loads(r)).replace("\n", "\n  "))


def document_blocks(rows: DataFrame, kind: str) -> DataFrame:
    """path and block: the blocks of which ``ordered.write_document`` makes one document of that kind."""
    if kind == "json":
        return json_records(rows).select("path", _indented("json").alias("block"))
    return (text_blocks if kind == "text" else markdown_blocks)(rows)


def document(blocks: DataFrame, kind: str, single: bool = False) -> str:
    """All blocks in path order as one text for a terminal: the rows come to the driver one partition at a time."""
    rows = [r[1] for r in blocks.orderBy(F.split("path", "/")).toLocalIterator()]
    if kind == "json":
        values = [json.loads(r) for r in rows]
        return pretty(values[0] if single and values else values)
    return "\n\n".join(rows) if kind == "text" else "".join(rows)
