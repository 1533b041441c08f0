"""Language-model scores by partial matching (PPM) over bytes, learnt from all training documents of the table itself.

A text is its words, joined by single spaces, in lower case (A-Z), and an end mark. The trie of contexts up to ``ORDER`` bytes is
kept as a table: the number of times that each string of ORDER + 1 bytes occurs in training. Shorter contexts are sums of it. The
probability of a byte is found from the longest context that has occurred: method C gives the escape the number of different bytes
that followed, and a byte that followed a longer context is excluded from the shorter ones, so no probability is wasted. What a longer
context excludes depends on that context alone, so the log probability of each string of ORDER + 1 bytes is a column, found
level by level from joins on the strings' endings and windows of at most 256 rows. Below order 0 all bytes not met are equally likely.

How it is spread: the texts are dealt into chunks of about ``CHUNK_BYTES``. Each chunk lists its distinct strings and words
with their training counts, in blocks by ``key % buckets``, there being as many buckets as chunks; so what is gathered grows with the corpus
and each group stays the same size. The blocks of a bucket are summed, the model is made and laid out in the same buckets, each chunk's
blocks meet the model's, and each chunk scores its texts with the entries that it asked for. No model is broadcast.

Words are told apart by their XXH64; two of V words meet in one with a probability of about V * V / 2**65.

Defined cases: a null or empty text is the end mark alone; a null id is in training; repeated rows count each; without
training documents every byte has the same probability and no word is known; an empty table gives an empty result; other columns are
not read. Texts are used whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediafold.llm._common import materialise, table

ORDER = 5
CHUNK_BYTES = 16 << 20
ALPHABET = 252  # bytes but the five control characters 9 to 13, of which 10 is used as the end mark
AT_ONCE = 1 << 20  # bytes of text
MERGE = 1 << 19  # keys that a chunk gathers before they are summed
END = b"\n"
STRINGS, WORDS = 0, 1


def packed(x: np.ndarray) -> bytes:
    """The numbers' bytes, first bytes first: bytes that hardly differ stand together and are compressed where they are stored or sent."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def sequences(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All strings of order + 1 bytes, as integers, text by text, and where each text's begin."""
    whole = [END * order + b" ".join(w) + END for w in texts]
    sizes = np.array([len(x) for x in whole])
    raw = np.frombuffer(b"".join(whole), np.uint8)
    keys = np.zeros(len(raw) - order, np.uint64)
    for j in range(order + 1):
        keys = (keys << np.uint64(8)) | raw[j : len(raw) - order + j]
    ends = np.cumsum(sizes)
    valid = np.ones(len(raw), bool)
    for j in range(1, order + 1):
        valid[ends - j] = False  # these windows would reach into the next text
    counts = sizes - order
    return keys[valid[: len(keys)]], np.cumsum(counts) - counts


def batches_of(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The texts' words, a few MB of text at a time, with the number of the first."""
    start, size, now = 0, 0, []
    for k, t in enumerate(texts):
        now.append(words_of(t))
        size += len(t or b"")
        if size >= AT_ONCE:
            yield start, now
            start, size, now = k + 1, 0, []
    if now:
        yield start, now


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def count_chunk(texts: list[bytes | None], train: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind, the distinct keys of the texts and their counts in training, which may be 0."""
    found, learnt, others = [], Counter(), set()
    for start, words in batches_of(texts):
        use = train[start : start + len(words)]
        for flag in (True, False):
            own = [w for w, u in zip(words, use, strict=True) if u == flag]
            if own:
                keys, n = np.unique(sequences(own, order)[0], return_counts=True)
                found.append((keys, n if flag else np.zeros(len(n), np.int64)))
        if sum(len(k) for k, _ in found) > len(found[0][0]) + MERGE:
            found = [summed(*map(np.concatenate, zip(*found, strict=True)))]
        for w, u in zip(words, use, strict=True):
            (learnt if u else others).update(w)
            (learnt if u else others).update([END])
    names = list(learnt.keys() | others)
    return {STRINGS: summed(*map(np.concatenate, zip(*found, strict=True))), WORDS: summed(word_keys(names), np.array([learnt[w] for w in names], np.int64))}


def _count(order: int, buckets: int):
    def run(chunk: pa.Table) -> pa.Table:
        texts, train = chunk["text"].cast(pa.binary()).to_pylist(), np.array(chunk["train"].to_pylist(), bool)
        rows, number = [], chunk["chunk"][0].as_py()
        for kind, (keys, counts) in count_chunk(texts, train, order).items():
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            deal = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[deal], counts[deal], bucket[deal]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            rows += [(kind, int(bucket[i]), number, packed_keys(keys[i:j]), packed(counts[i:j].astype("<u4"))) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "bucket", "chunk", "keys", "counts"])

    return run


def _joined(column: pa.ChunkedArray, kind: str | None = None) -> np.ndarray:
    """The numbers of all blocks; without a kind, keys."""
    return np.concatenate([unpacked(x, kind) if kind else unpacked_keys(x) for x in column.to_pylist()])


def _totals(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return summed(_joined(blocks["keys"]), _joined(blocks["counts"], "<u4").astype(np.int64))


def _string_totals(blocks: pa.Table) -> pa.Table:
    keys, n = _totals(blocks)
    return pa.table({"string": keys.astype(np.int64), "n": n})


def _word_totals(blocks: pa.Table) -> pa.Table:
    keys, n = _totals(blocks)
    row = (WORDS, blocks["bucket"][0].as_py(), packed_keys(keys), packed(n.astype("<f8")), int(n.sum()), int((n > 0).sum()))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["kind", "bucket", "keys", "values", "tokens", "different"])


def _string_blocks(rows: pa.Table) -> pa.Table:
    keys, values = rows["string"].to_numpy().astype(np.uint64), rows["logp"].to_numpy()
    order = np.argsort(keys)
    row = (STRINGS, rows["bucket"][0].as_py(), packed_keys(keys[order]), packed(values[order]))
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "bucket", "keys", "values"])


def log_probabilities(strings: DataFrame, order: int = ORDER) -> DataFrame:
    """string and logp, the natural logarithm of its last byte's probability after the bytes before. strings: string, n (0 if only asked for)."""

    def level(k: int) -> DataFrame:
        ending = strings if k == order else strings.groupBy(F.col("string").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("string")).agg(F.sum("n").alias("n"))
        return ending.withColumn("context", F.shiftright("string", 8))

    def ratio(a: Column, b: Column) -> Column:
        return F.log(a.cast("double") / b.cast("double"))

    context = Window.partitionBy("context")
    seen = F.count_if(F.col("n") > 0).over(context)
    now = level(0).select("string", "n", F.sum("n").over(context).alias("total"), seen.alias("kinds"))
    now = now.withColumn("below", -F.log(F.lit(ALPHABET) - F.col("kinds")))
    for k in range(1, order + 1):
        shorter = now.select(F.col("string").alias("ending"), *(F.col(c).alias(f"s_{c}") for c in ("n", "total", "kinds", "below")))
        rows = level(k).withColumn("ending", F.col("string").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(shorter, "ending")
        excluded = F.sum(F.when(F.col("n") > 0, F.col("s_n")).otherwise(0)).over(context)
        rows = rows.select("*", F.sum("n").over(context).alias("total"), seen.alias("kinds"), excluded.alias("excluded"))
        left = F.col("s_total") - F.col("excluded") + F.col("s_kinds") - F.col("kinds")
        below = F.when(F.col("n") > 0, F.lit(None).cast("double")).when(F.col("s_n") > 0, ratio(F.col("s_n"), left))
        below = below.when(F.col("s_kinds") == F.col("kinds"), F.col("s_below")).otherwise(ratio(F.col("s_kinds") - F.col("kinds"), left) + F.col("s_below"))
        now = rows.select("string", "n", "total", "kinds", below.alias("below"))
    most = F.col("total") + F.col("kinds")
    top = F.when(F.col("total") == 0, F.col("below")).when(F.col("n") > 0, ratio(F.col("n"), most)).otherwise(ratio(F.col("kinds"), most) + F.col("below"))
    return now.select("string", top.alias("logp"))


class Lookup:
    """Values by key. A table of slots finds nearly all; keys that share a slot are found by bisection."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.values[at]


def _look_up(asked: pa.Table, model: pa.Table) -> pa.Table:
    """The values of the keys that each chunk asked for in this bucket."""
    known, values = _joined(model["keys"]), _joined(model["values"], "<f8")
    found = [packed(values[np.searchsorted(known, unpacked_keys(k))]) for k in asked["keys"].to_pylist()]
    return pa.table({"chunk": asked["chunk"], "kind": asked["kind"], "keys": asked["keys"], "values": pa.array(found, pa.binary())})


def score_chunk(texts: list[bytes | None], strings: Lookup, counts: Lookup, tokens: int, different: int, order: int) -> dict[str, list]:
    out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
    size = math.log10(tokens + 0.5 * (different + 1))
    for _, texts_words in batches_of(texts):
        names = list(set().union([END], *texts_words))
        c = counts(word_keys(names))
        value = dict(zip(names, (np.log10(c + 0.5) - size).tolist(), strict=True))
        known = dict(zip(names, (c > 0).tolist(), strict=True))
        keys, starts = sequences(texts_words, order)
        out["score"] += (np.add.reduceat(strings(keys), starts) / math.log(10)).tolist()
        for w in texts_words:
            w.append(END)
            out["n_tokens"].append(len(w))
            out["n_known"].append(sum(map(known.__getitem__, w)))
            out["base_score"].append(math.fsum(map(value.__getitem__, w)))
    return out


def _score(order: int, tokens: int, different: int):
    def run(chunk: pa.Table, blocks: pa.Table) -> pa.Table:
        found = []
        for kind in (STRINGS, WORDS):
            own = blocks.filter(pc.equal(blocks["kind"], kind))
            found.append(Lookup(_joined(own["keys"]), _joined(own["values"], "<f8")))
        scores = score_chunk(chunk["text"].cast(pa.binary()).to_pylist(), *found, tokens, different, order)
        held_out = pc.invert(chunk["train"])
        return pa.table({"id": chunk["id"], "held_out": held_out, "n_tokens": pa.array(scores["n_tokens"], pa.int64()), "n_known": pa.array(scores["n_known"], pa.int64()), "base_score": scores["base_score"], "score": scores["score"]})

    return run


def ppm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score, both base-10 logarithms.

    ``train`` is true for the documents to learn from. base_score is that of smoothed single words.
    """
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    chunks = max(8, math.ceil(size / chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    blocks = rows.groupBy("chunk").applyInArrow(_count(order, chunks), "kind int, bucket int, chunk int, keys binary, counts binary")
    blocks = materialise(blocks, "ppm-blocks")
    words = blocks.filter(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(_word_totals, "kind int, bucket int, keys binary, values binary, tokens long, different long")
    words = materialise(words, "ppm-words")
    tokens, different = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()
    strings = materialise(blocks.filter(F.col("kind") == STRINGS).groupBy("bucket").applyInArrow(_string_totals, "string long, n long"), "ppm-strings")
    model = log_probabilities(strings, order).withColumn("bucket", F.pmod("string", F.lit(chunks)).cast("int"))
    model = model.groupBy("bucket").applyInArrow(_string_blocks, "kind int, bucket int, keys binary, values binary")
    model = model.unionByName(words.select("kind", "bucket", "keys", "values"))
    asked = blocks.select("kind", "bucket", "chunk", "keys").groupBy("kind", "bucket").cogroup(model.groupBy("kind", "bucket"))
    asked = asked.applyInArrow(_look_up, "chunk int, kind int, keys binary, values binary")
    kind = docs.schema[id_col].dataType.simpleString()
    scored = (
        rows.groupBy("chunk")
        .cogroup(asked.groupBy("chunk"))
        .applyInArrow(_score(order, tokens, different), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ppm_scores(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 != 1)
