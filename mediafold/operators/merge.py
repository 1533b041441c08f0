"""Precedence between the local tagger's and the endpoint's results, and the errors of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafold.functions.text import clean_tags, trimmed

#: The fields of a record, in the order of its JSON.
FIELDS = (
    ("bytes", "bigint"), ("clap_error", "string"), ("clip_error", "string"), ("description", "string"), ("duration_ms", "bigint"), ("error", "string"),
    ("llm_error", "string"), ("metadata", "string"), ("mime", "string"), ("model", "string"), ("mtime", "bigint"), ("path", "string"), ("sha256", "string"),
    ("summary", "string"), ("tag_confidence", "double"), ("tags", "array<string>"), ("type", "string"),
)


def merged(rows: DataFrame) -> DataFrame:
    """Merges llm_tags, llm_description, llm_summary, llm_model and llm_failure into tags, description, summary, model, llm_error and error.

    The endpoint's fields overwrite where they are not null. tag_confidence stays, also where the tags are overwritten. If the
    endpoint failed, a row that has local tags or a description keeps them with the failure as llm_error; one without is an error row. llm_missing (no endpoint for the
    row's modality) is an llm_error and nothing else; llm_media_error (the medium to be attached can't be read) makes an error row in any case. Both may lack.
    """
    failed = F.col("llm_failure").isNotNull()
    useful = F.col("tags").isNotNull() | F.col("description").isNotNull()
    out = {
        "tags": F.when(failed, F.col("tags")).otherwise(F.coalesce(clean_tags(F.col("llm_tags")), F.col("tags"))),
        "description": F.when(failed, F.col("description")).otherwise(F.coalesce(trimmed(F.col("llm_description")), F.col("description"))),
        "summary": F.when(failed, F.col("summary")).otherwise(F.coalesce(trimmed(F.col("llm_summary")), F.col("summary"))),
        "model": F.when(failed, F.col("model")).otherwise(F.coalesce(F.col("llm_model"), F.col("model"))),
        "llm_error": F.when(failed & useful, F.col("llm_failure")).otherwise(F.coalesce("llm_missing", "llm_error") if "llm_missing" in rows.columns else F.col("llm_error")),
        "error": F.coalesce(*(F.col(c) for c in ("llm_media_error",) if c in rows.columns), F.when(failed & ~useful, F.col("llm_failure")).otherwise(F.col("error"))),
    }
    return collapsed(rows.withColumns(out)).drop("llm_tags", "llm_description", "llm_summary", "llm_model", "llm_failure", "llm_missing", "llm_media_error")


def collapsed(rows: DataFrame) -> DataFrame:
    """A row with an error keeps only its path and the error."""
    keep = {"path", "error"}
    kinds = dict(FIELDS)
    return rows.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in rows.columns if c in kinds and c not in keep})


def as_records(rows: DataFrame) -> DataFrame:
    """Exactly the record's fields; those that rows lacks are null."""
    have = set(rows.columns)
    return rows.select(*((F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS))


def first_error(rows: DataFrame) -> DataFrame:
    """The first row with an error in path order, which decides a strict run's outcome."""
    return rows.filter("error IS NOT NULL").orderBy(F.split("path", "/")).limit(1)


def local_model(used_endpoint: Column, name: str) -> Column:
    """The local model's name is given only where the row's modality has no endpoint."""
    return F.when(~used_endpoint, F.lit(name))
