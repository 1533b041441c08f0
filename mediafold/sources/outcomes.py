"""What becomes of each file, in one pass: an entry, a skip or an error, each to its own folder, counted on the way.

The counts are an ``Observation`` of the job that writes, so there is no second scan; a task that runs again counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mediafold.functions.sniff import HEADER_BYTES, mime_of

OUTCOMES = ("entry", "skipped", "error")


def outcome_of(header: Column, error: Column) -> Column:
    """An unreadable or unknown header is skipped, whatever else is wrong; of the others those with an error are errors."""
    return F.when(mime_of(F.substring(header, 1, HEADER_BYTES)).isNull(), F.lit("skipped")).when(error.isNotNull(), F.lit("error")).otherwise(F.lit("entry"))


def write_outcomes(files: DataFrame, path: str, header_col: str = "header", error_col: str = "error", size_col: str = "bytes") -> dict[str, dict[str, int]]:
    """Writes files below ``path``, a folder an outcome; of each outcome the number of files and their bytes."""
    seen = Observation()
    rows = files.withColumn("outcome", outcome_of(F.col(header_col), F.col(error_col)))
    counts = [x for o in OUTCOMES for x in (F.count_if(F.col("outcome") == o).alias(f"{o}_files"), F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col(size_col))), F.lit(0)).cast("long").alias(f"{o}_bytes"))]
    rows.observe(seen, *counts).write.partitionBy("outcome").parquet(path)
    found = seen.get
    return {o: {"files": found[f"{o}_files"], "bytes": found[f"{o}_bytes"]} for o in OUTCOMES}
