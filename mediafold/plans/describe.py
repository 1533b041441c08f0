"""From files to records: kind, facts, local tags, endpoint results, errors. One record per file of a known kind."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediafold.functions.sniff import modality_of
from mediafold.functions.text import confidence, describe_name, describe_tags, short_sound
from mediafold.operators.endpoint import Endpoint, Transport, enrich, http
from mediafold.operators.merge import as_records, merged
from mediafold.operators.render import pretty
from mediafold.operators.taggers import Tagger
from mediafold.sources.listing import local_files, with_kind
from mediafold.sources.media import MIN_SECONDS, Attach, Programs, lean_json, tagged, with_facts

ASK = 'Describe this file. Answer with one JSON object: {"tags": [...], "description": "...", "summary": "..."}'


@dataclass(frozen=True)
class Settings:
    image_tagger: Tagger | None = None
    audio_tagger: Tagger | None = None
    endpoints: Mapping[str, Endpoint] = field(default_factory=dict)
    ask: str = ASK
    transport: Transport = http
    vision: bool = True
    audio: bool = False
    frames: int = 4
    min_seconds: float = MIN_SECONDS
    programs: Programs = Programs()
    tasks: int | None = None


@F.pandas_udf(T.StringType())
def _prompt_metadata(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: pretty(lean_json(text)))


def prompt_text(kind: Column, metadata: Column) -> Column:
    """What the endpoint is told of a file."""
    what = F.when(kind == "video", F.lit("Video (sample frames attached)")).otherwise(F.concat(F.initcap(kind), F.lit(" file")))
    return F.concat(what, F.lit(".\nMetadata:\n"), _prompt_metadata(metadata))


def describe(spark: SparkSession, paths: list[str], settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Records of the files, in no order. Each path once: a path is the key of its record."""
    files = with_kind(local_files(spark, sorted(set(paths)), settings.tasks))
    files = with_facts(files, settings.programs).withColumn("modality", modality_of(F.col("type")))
    empty = {"tags": "array<string>", "description": "string", "summary": "string", "model": "string", "tag_confidence": "double", "clip_error": "string", "clap_error": "string", "llm_error": "string"}
    rows = files.withColumns({c: F.lit(None).cast(k) for c, k in empty.items()}).withColumn("duration_ms", F.coalesce("probe_ms", F.lit(0)))
    covered = F.col("modality").isin(*settings.endpoints) if settings.endpoints else F.lit(False)
    short = short_sound(F.col("duration_s"), settings.min_seconds)
    # images and videos go to the image tagger, sounds to the other
    for audio, tagger, error_col in ((False, settings.image_tagger, "clip_error"), (True, settings.audio_tagger, "clap_error")):
        if tagger is None:
            continue
        own = ((F.col("type") == "audio") == audio) & F.col("error").isNull()
        found = tagged(files.filter(own), tagger.provider, tagger.labels, tagger.matrix, tagger.gate, settings.min_seconds, settings.programs)
        rows = rows.join(found, "path", "left")
        plain = describe_name(F.col("path"), short if audio else None)
        rows = rows.withColumns({
            "description": F.when(own, F.when(F.col("found").isNotNull(), describe_tags(F.col("found"))).otherwise(plain)).otherwise(F.col("description")),
            "tags": F.coalesce("found", "tags"), "tag_confidence": F.coalesce(confidence(F.col("score")), "tag_confidence"), error_col: F.coalesce("failure", error_col),
            "model": F.when(own & F.col("failure").isNull() & ~covered, F.lit(tagger.name)).otherwise(F.col("model")), "duration_ms": F.col("duration_ms") + F.coalesce("tag_ms", F.lit(0)),
        }).drop("found", "score", "failure", "tag_ms")
    if settings.endpoints:
        told = rows.filter("error IS NULL").withColumn("prompt", prompt_text(F.col("type"), F.col("metadata")))
        asked = enrich(told, settings.endpoints, settings.ask, settings.transport, attach=Attach(settings.frames, settings.audio, settings.programs), vision=settings.vision)
        rows = merged(rows.join(asked.drop("llm_attempts"), "path", "left")).withColumn("duration_ms", F.when(F.col("error").isNull(), F.col("duration_ms") + F.coalesce("llm_ms", F.lit(0))))
    kept = F.col("error").isNull()
    facts = ("metadata", "mime", "type", "bytes", "mtime", "sha256", "duration_ms", "tags", "description", "summary", "model", "tag_confidence", "clip_error", "clap_error", "llm_error")
    return as_records(rows.withColumns({c: F.when(kept, F.col(c)) for c in facts}))
