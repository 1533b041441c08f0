"""Connected components of an edge list by alternating stars, each round written to the shared folder.

From ``FEW`` edges down a round is one task without a shuffle, as its tasks would have next to nothing to do; the rounds are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafold.llm._common import drop_table, join_groups, materialise


FEW = 1 << 18


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the least of u and its neighbours. A node may have most of the edges."""
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree"))
    return join_groups(edges, least, ["u"], "degree", total)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge but the roots; root is the least node of the component. Nodes are integers, never null."""
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state, few = None, None
    while True:
        total, check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not total or state == (total, check):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = total, check
        few = total <= FEW if few is None else few  # there are never more edges than at first
        now = now.coalesce(1) if few else now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        large = large.coalesce(1) if few else large
        small = _with_least(large, large.count())
        small = small.select("u", "m").union(small.filter("v <> m").select("v", "m")).toDF("u", "v").distinct()
        old, now = now, materialise(small, "small-star")
        drop_table(old)
        drop_table(large)
