"""Exact duplicates by deterministic block naming, with DataFrame operations only.

Each normalised text is cut into blocks of ``BLOCK`` characters. Equal blocks get the same integer name and unequal ones
different names, by sorting them within hash partitions and comparing the blocks themselves: the name is the number of the
block's first occurrence. Then adjacent names are paired and the pairs named in the same way, level by level, until one name
is left for each document. (level, name) is its identity; no digest is compared, so no two different texts can meet.

Naming is done in two steps, as one block or pair may have a third of all rows. First the occurrences are dealt by key and a
salt, and each salt's first occurrence stands for its others; then only these, at most ``SALTS`` a key, meet to find the
first of all. A text's characters are shuffled twice; all levels above move three integers a row.

Defined cases: a null text counts as empty and an empty text has one empty block; of equal texts the row with the smallest
id stays, null ids come last, and of rows equal in both the first in reading order stays; an empty table gives an empty
result; other columns are not read. Texts of any length are cut in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediafold.llm._common import free_name, join_groups, materialise, table, without

BLOCK = 1024
SALTS = 256


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space. The pattern passes over single spaces, which need no change."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def named(rows: DataFrame, keys: list[str], carry: list[str], salts: int = SALTS) -> DataFrame:
    """carry and ``name``: equal for rows with equal keys, different otherwise. rows has ``id``, a stable integer of its own for each row."""
    rows = rows.select(F.xxhash64(*keys).alias("h"), F.pmod("id", F.lit(salts)).alias("salt"), *keys, F.struct("id", *carry).alias("row"))
    rows = rows.withColumn("first", F.min("row").over(Window.partitionBy("h", *keys, "salt")))
    firsts = rows.filter("row = first").select("h", *keys, F.col("row.id").alias("first_id"))
    names = firsts.select("first_id", F.min("first_id").over(Window.partitionBy("h", *keys)).alias("name"))
    return rows.select("row", F.col("first.id").alias("first_id")).join(names, "first_id").select(*(F.col(f"row.{c}").alias(c) for c in carry), "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """row_id (of the row, in reading order), doc_id, text_sha256, level and name; rows with equal level and name have equal texts."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), docs[id_col].alias("doc_id"), normalised(docs[text_col]).alias("t"))
    cut = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    rows = rows.select("row_id", "doc_id", F.sha2("t", 256).alias("sha"), F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(cut).alias("blocks"))
    rows = rows.select("row_id", "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    rows = rows.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha"))).withColumn("id", F.monotonically_increasing_id())
    carry = ["row_id", "doc_id", "sha", "n", "pos"]
    level = materialise(named(rows, ["block"], carry), "names-0")
    most = level.agg(F.max("n")).first()[0] or 1
    done, k = [], 0
    while True:
        done.append(level.filter("n = 1").select("row_id", "doc_id", F.col("sha").alias("text_sha256"), F.lit(k).alias("level"), "name"))
        if most <= 1:
            break
        most, k = (most + 1) // 2, k + 1
        even = F.col("pos") % 2 == 0
        pairs = (
            level.filter("n > 1")
            .withColumn("id", F.monotonically_increasing_id())
            .groupBy("row_id", F.floor(F.col("pos") / 2).cast("int").alias("half"))
            .agg(
                F.min("id").alias("id"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
                F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.ceil(F.max("n") / 2).cast("int").alias("n"),
            )
            .withColumnRenamed("half", "pos")
        )
        level = materialise(named(pairs, ["a", "b"], carry), f"names-{k}")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: row_id, ``id_col``, keep_id, group_size, kept and text_sha256."""
    # the levels' tables are read once more, to be one small table
    found = materialise(identities(docs, id_col, text_col, block), "identities")
    total = found.count()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    groups = found.groupBy("level", "name").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    rows = join_groups(found, groups, ["level", "name"], "group_size", total)
    return rows.select(
        "row_id", F.col("doc_id").alias(id_col), F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an earlier one has, columns unchanged. docs is a table that is read alike each time."""
    at = free_name(docs, "row")
    gone = exact_duplicates(docs, id_col, text_col).filter("NOT kept").select(F.col("row_id").alias(at))
    rows = docs.withColumn(at, F.monotonically_increasing_id())
    return without(rows, at, materialise(gone, "exact-duplicates")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row_id")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)
"""
