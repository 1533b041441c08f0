"""The first JSON object inside a model's reply."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_no_number)


def json_span(text: str | None) -> str | None:
    """The object that begins at the first brace, if one does; what follows it does not matter."""
    start = text.find("{") if text else -1
    if start < 0:
        return None
    try:
        return text[start : _DECODER.raw_decode(text, start)[1]]
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    return texts.map(json_span)
