"""Sinks: one JSON file beside each media file, or a table of records."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from mediafold.operators.merge import as_records
from mediafold.operators.render import json_records, pretty

SUFFIX = ".mediafold.json"


def write_sidecars(rows: DataFrame, suffix: str = SUFFIX) -> int:
    """Writes path + suffix for each row, error rows too, by a rename in the same folder; the number written. A failure leaves that file out.

    Writing a row again gives the same file, so tasks may be run again.
    """
    sc = rows.sparkSession.sparkContext
    written = sc.accumulator(0)

    def write(part: Iterator[Row]) -> None:
        for path, text in part:
            try:
                with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, encoding="utf-8") as f:
                    f.write(pretty(json.loads(text)) + "\n")
                os.replace(f.name, path + suffix)
                written.add(1)
            except OSError:
                continue

    json_records(rows).foreachPartition(write)
    return written.value


def write_records(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    as_records(rows).write.mode(mode).json(path)
