"""SimHash fingerprints and the groups of documents whose fingerprints are linked, by pivot distance tables.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's word shingles. Equal fingerprints are one row
from then on, however many documents have them. A table holds each fingerprint's Hamming distances to ``PIVOTS``: zero and, for
each block of two bits, the fingerprint with these bits alone. By the triangle inequality no distance of two linked fingerprints
differs by more than the radius, 2. From the distance to zero and to a block's pivot follows the block's number of ones, and two
differing bits leave all these numbers equal in at least GROUPS - 2 of the ``GROUPS`` groups of blocks; so linked fingerprints meet
under one of the keys that these numbers make. Pairs that meet are discarded by their largest difference of pivot distances,
and the survivors are verified.

A key under which over ``BUCKET`` fingerprints meet is not paired out. Its fingerprints are linked exactly in another way:
two differ in 2 bits or fewer just if some fingerprint is within one bit of both, so each is listed under itself and its 64
neighbours, and those listed together, 65 at most, are linked to the least of them.

Defined cases: null and empty texts have fingerprint zero, linked like any other; of fewer words than a shingle's the
whole sequence is the only shingle; null ids are never a component's smallest unless it has no other; repeated rows are in one
component; an empty table gives an empty result; other columns are not read. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.llm._common import join_groups, materialise, table
from mediafold.llm.components import components

SEED = 42
RADIUS = 2
BLOCK_BITS = 2
GROUPS = 4  # 8 or more for over 10^9 fingerprints: more keys, each with more blocks
BUCKET = 32
ROWS = 256


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


PIVOTS = [0] + [((1 << BLOCK_BITS) - 1) << i for i in range(0, 64, BLOCK_BITS)]


def shingle_hashes(text: bytes, words: int) -> bytes:
    """XXH64 digests (8 bytes each, big-endian) of the shingles, repeats included."""
    w = text.lower().split()  # of bytes: A-Z alone, and exactly the six ASCII white-space characters
    if not w:
        return b""
    if len(w) <= words:
        return xxhash.xxh64_digest(b" ".join(w), SEED)
    whole = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1])
    digest = xxhash.xxh64_digest
    return b"".join([digest(whole[s:e], SEED) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)])


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """hashes: rows of bytes. Which bits, the highest of the first byte first, are set in over half of the rows."""
    counts = np.zeros(hashes.shape[1] * 8, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64], axis=1)
        for part in range(0, len(bits), 255):
            counts += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return counts * 2 > len(hashes)


def fingerprint(text: bytes, words: int) -> int:
    hashes = np.frombuffer(shingle_hashes(text, words), np.uint8).reshape(-1, 8)
    return int.from_bytes(np.packbits(majority_bits(hashes)).tobytes(), "big", signed=True)


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                texts = batch.column(1).slice(at, ROWS).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, ROWS), pa.array([fingerprint(t or b"", words) for t in texts], pa.int64())], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp, the 64 bits as a signed integer."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(words), f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def pivot_distances(fp: Column) -> Column:
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(signed(p)))).cast("tinyint") for p in PIVOTS))


def meeting_keys(distances: Column, groups: int = GROUPS) -> Column:
    """One key for each choice of groups - RADIUS groups: the choice, and the ones in each block of these groups."""
    ones = [F.shiftright(distances[0] - distances[j] + BLOCK_BITS, 1) for j in range(1, len(PIVOTS))]
    size = -(-len(ones) // groups)
    parts = [ones[i : i + size] for i in range(0, len(ones), size)]

    def number(blocks: list[Column]) -> Column:
        total = F.lit(0).cast("long")
        for b in blocks:
            total = total * (BLOCK_BITS + 1) + b
        return total

    held = [number(p) for p in parts]
    keys = [F.concat_ws("-", F.lit(k), *(held[i] for i in choice)) for k, choice in enumerate(combinations(range(len(parts)), len(parts) - RADIUS))]
    return F.array(*keys)


def links(fps: DataFrame, groups: int = GROUPS, bucket: int = BUCKET) -> DataFrame:
    """Pairs a < b of distinct fingerprints that connect all those within 2 bits of each other. fps: distinct fp and pivots."""
    rows = fps.select("fp", F.explode(meeting_keys(F.col("pivots"), groups)).alias("key"))
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = materialise(join_groups(rows, met, ["key"], "n", rows.count()), "met")
    pairs = (
        rows.filter(F.col("n") <= bucket)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("all"))
        .select(F.explode("all").alias("a"), "all")
        .select("a", F.explode(F.filter("all", lambda x: x > F.col("a"))).alias("b"))
        .distinct()
    )
    p, q = (fps.select(F.col("fp").alias(x), F.col("pivots").alias(f"{x}_pivots")) for x in "ab")
    apart = F.array_max(F.zip_with("a_pivots", "b_pivots", lambda x, y: F.abs(x - y)))
    near = pairs.join(p, "a").join(q, "b").filter(apart <= RADIUS).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)))
    dense = rows.filter(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(around).alias("middle"))
    dense = dense.groupBy("middle").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)  # 65 at most
    dense = dense.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return near.unionByName(dense).distinct()


def simhash_components(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", groups: int = GROUPS) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable by links."""
    rows = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).withColumn("pivots", pivot_distances(F.col("fp")))
    fps = materialise(fps, "pivots")
    total = rows.count()
    member = components(links(fps, groups)).withColumnsRenamed({"node": "fp"})
    member = materialise(member.join(fps.select("fp", "first_id"), "fp"), "members")
    roots = member.groupBy("root").agg(F.min("first_id").alias("least"), F.count(F.lit(1)).alias("m"))
    roots = roots.join(fps.select(F.col("fp").alias("root"), "first_id"), "root").select("root", "m", F.least("least", "first_id").alias("component_id"))
    known = join_groups(member.select("fp", "root"), roots, ["root"], "m", member.count()).select("fp", "component_id")
    known = known.unionByName(roots.select(F.col("root").alias("fp"), "component_id"))
    each = fps.join(known, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"))
    found = join_groups(rows, materialise(each, "classes"), ["fp"], "n", total)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
