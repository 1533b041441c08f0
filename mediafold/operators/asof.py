"""For each row the latest reply at or before its time, without an inequality join.

Rows and replies are one stream in time order per key. A key's time is cut into spans, so a key with most of the rows fills no task: within a span the last
reply is carried forward by a window; across spans each span's last reply is, by a window over one small row per span, and a span of its own for every ``GROUP``
spans above that. ``latest_reply`` merges what it finds as any local value is merged.

Defined cases: of replies of one key and time the greatest (as a struct) counts; a null key or time meets nothing; rows without an earlier reply have a null one; equal rows are kept, each with
its reply; an empty side gives rows without replies, or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = 4096


def _carried(spans: DataFrame, key: str, levels: int) -> DataFrame:
    """For each key and span the last reply of the spans before it. spans: key, span, last (null if it has none)."""
    if not levels:
        before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        return spans.select(key, "_span", F.last("_last", True).over(before).alias("_carried"))
    group = F.floor(F.col("_span") / GROUP)
    before = Window.partitionBy(key, "_group").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    within = spans.withColumn("_group", group).select(key, "_span", "_group", F.last("_last", True).over(before).alias("_near"))
    groups = spans.groupBy(key, group.alias("_span")).agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_span"))).alias("_last"))
    far = _carried(groups, key, levels - 1).select(key, F.col("_span").alias("_group"), F.col("_carried").alias("_far"))
    return within.join(far, [key, "_group"]).select(key, "_span", F.coalesce("_near", "_far").alias("_carried"))


def latest_reply(rows: DataFrame, replies: DataFrame, key: str, time: str, values: list[str], span: float = 3600.0, levels: int = 1) -> DataFrame:
    """rows with reply, a struct of the reply's time and ``values``: the latest of the same key at or before the row's own time (a timestamp or seconds). span: in seconds."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6 if dict(rows.dtypes)[time].startswith("timestamp") else F.col(time).cast("double")
    place = F.floor(seconds / span)
    asked = rows.withColumns({"_row": F.struct(*rows.columns), "_reply": F.lit(None)}).select(key, F.col(time).alias("_time"), place.alias("_span"), "_row", F.lit(1).alias("_kind"))
    said = replies.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.col(time).alias("_time"), place.alias("_span"), F.struct(F.col(time).alias("time"), *values).alias("_reply"), F.lit(0).alias("_kind"))
    stream = said.unionByName(asked.filter(F.col(key).isNotNull() & F.col("_time").isNotNull()), allowMissingColumns=True)
    upto = Window.partitionBy(key, "_span").orderBy("_time", "_kind", "_reply").rowsBetween(Window.unboundedPreceding, 0)
    near = stream.withColumn("_near", F.last("_reply", True).over(upto)).filter("_kind = 1")
    spans = said.groupBy(key, "_span").agg(F.max("_reply").alias("_last")).unionByName(asked.select(key, "_span", F.lit(None).alias("_last")).distinct())
    spans = spans.filter(F.col(key).isNotNull() & F.col("_span").isNotNull()).groupBy(key, "_span").agg(F.max("_last").alias("_last"))
    found = near.join(_carried(spans, key, levels), [key, "_span"], "left").select("_row", F.coalesce("_near", "_carried").alias("reply"))
    lost = asked.filter(F.col(key).isNull() | F.col("_time").isNull()).select("_row", F.lit(None).cast(found.schema["reply"].dataType).alias("reply"))
    return found.unionByName(lost).select("_row.*", "reply")
