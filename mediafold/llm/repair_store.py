"""Token ids in a binary shard format, compressed by a Re-Pair grammar, with random access.

Documents are dealt into ranges of ascending id; each task encodes its range in order and cuts it into shards of about
``SHARD_TOKENS`` ids. In each shard the frequent pairs of neighbouring symbols are replaced by nonterminals, round by round,
until no pair has ``MIN_USES`` uses: of the pairs that overlap, the more frequent one is replaced, and all that the round chose become rules at
once. No pair crosses the end of a document, so each document starts at a symbol. A shard stores its alphabet, its rules, the expansion length of each
rule, the symbols and the documents' first symbols; any stretch of ids is decoded from the symbols that cover it.

The shards are rows of a Parquet table in the shared folder (``write_store``), written by Spark's committer, so lost tasks are run
anew; ``read_store`` reads them back. ``start``, the ids before a document, is the sum of its task's start, which comes
from the few totals by task, and its place in the task.

A payload: "RPG1"; six little-endian 64-bit integers (alphabet, rules, symbols, documents, ids, bytes of a symbol); the ids of the
alphabet, which are the first symbols, and the rules' left and right symbols and expansion lengths (32 bits each); the symbols (16 or
32 bits); for each document its first symbol and its number of ids (64 bits each).

Defined cases: a null or empty text has only its end id; null ids come first; rows with equal ids are ordered by the first 32
characters, nulls first, then by the text's XXH64; an empty table gives an empty store; other columns are not read; a document larger than a shard is a shard of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.llm._common import new_path, table
from mediafold.llm.token_memo import packed_encoder
from mediafold.operators.ordered import totals_before

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 20
MOST_PARTS = 1 << 18  # rows of 16 bytes that are broadcast at most
MIN_USES = 4  # a rule costs about three symbols
ROWS = 128
_HEAD = struct.Struct("<4s6Q")


def grammar(symbols: np.ndarray, last: np.ndarray, first: int, min_uses: int = MIN_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols (uint32) after all replacements, which of them end a document, and the rules: rule r, named first + r, is a row (left, right).

    A round looks at the live places: those whose pair may still be frequent. A pair without a new symbol never gets more frequent, so a place dies
    when its pair turns out to be rare and lives again when a neighbour is replaced; later rounds are small. Pairs are counted in
    buckets; each counts one pair exactly, and others of the same bucket stay live for a round with another hash. No place is left live.
    """
    n = len(symbols)
    seq, rules = np.append(symbols, 0).astype(np.uint32), []
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    before[0] = n  # no place
    last = np.append(last, True)
    there, live = np.append(np.ones(n, bool), False), ~last
    name, turn = first, 0
    while len(at := np.flatnonzero(live)):
        turn += 1
        pair = seq.take(at).astype(np.uint64) << np.uint64(32) | seq.take(after.take(at))
        bits = min(20, max(8, len(at).bit_length()))
        bucket = (pair * np.uint64((0x9E3779B97F4A7C15 * (2 * turn - 1)) % (1 << 64)) >> np.uint64(64 - bits)).view(np.int64)
        counted = np.zeros(1 << bits, np.uint64)
        counted[bucket] = pair
        same = counted.take(bucket) == pair
        count = np.bincount(bucket[same], minlength=1 << bits).astype(np.int32)
        count[count < min_uses] = 0
        gain = count.take(bucket) * same
        # of pairs that overlap, the more frequent one; of equally frequent ones in a row, every other one
        beside = after.take(at[:-1]) == at[1:]
        alike = np.flatnonzero(beside & (gain[1:] == gain[:-1]) & (gain[1:] > 0)) + 1
        begin = np.flatnonzero(np.diff(alike, prepend=-1) != 1)
        odd = np.zeros(len(at), bool)
        odd[alike] = (np.arange(len(alike)) - np.repeat(begin, np.diff(begin, append=len(alike)))) % 2 == 0
        beaten = np.zeros(len(at), bool)
        beaten[1:] |= beside & (gain[:-1] > gain[1:])
        beaten[:-1] |= beside & (gain[1:] > gain[:-1])
        chosen = np.flatnonzero((gain > 0) & ~odd & ~beaten)
        kept = np.flatnonzero(np.bincount(bucket.take(chosen), minlength=1 << bits) >= min_uses)
        live[at[same & (gain == 0)]] = False
        if not len(kept):
            live[at[same]] = False
            continue
        names = np.zeros(1 << bits, np.uint32)  # 0: none, as rules are never named 0
        names[kept] = name + np.arange(len(kept))
        rules.append(counted[kept])
        name += len(kept)
        named = names.take(bucket.take(chosen))
        c, named = at.take(chosen[named > 0]), named[named > 0]
        gone = after.take(c)
        seq[c], last[c] = named, last[gone]
        after[c] = after[gone]
        before[after[c]] = c
        there[gone] = live[gone] = False
        live[c] = ~last[c]
        left = before[c]
        left = left[there[left]]
        live[left] = ~last[left]
    pairs = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    there = there[:n]
    return seq[:n][there], last[:n][there], np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for. A rule refers to rules of earlier rounds alone, so a pass for each round settles all."""
    known = np.concatenate([np.ones(first, np.int64), np.zeros(len(rules), np.int64)])
    while not known.all():
        parts = known[rules]
        known[first:] = np.where(parts.all(axis=1), parts.sum(axis=1), 0)
    return known[first:].astype(np.uint32)


def pack_shard(documents: list[np.ndarray]) -> bytes:
    """documents: each one's ids, none of them empty."""
    counts = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate(documents)
    alphabet = np.flatnonzero(np.bincount(ids))
    symbol = np.zeros(int(alphabet[-1]) + 1, np.uint32)
    symbol[alphabet] = np.arange(len(alphabet))
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    seq, last, rules = grammar(symbol[ids], last, len(alphabet))
    width = 2 if len(alphabet) + len(rules) <= 1 << 16 else 4
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    return b"".join([
        _HEAD.pack(b"RPG1", len(alphabet), len(rules), len(seq), len(documents), len(ids), width),
        alphabet.astype("<u4").tobytes(), rules[:, 0].astype("<u4").tobytes(), rules[:, 1].astype("<u4").tobytes(),
        expansion_lengths(rules, len(alphabet)).astype("<u4").tobytes(),
        seq.astype(f"<u{width}").tobytes(), starts.astype("<u8").tobytes(), counts.astype("<u8").tobytes(),
    ])


class Shard:
    """A payload opened for reading."""

    def __init__(self, payload: bytes) -> None:
        mark, self.first, n_rules, n_symbols, self.n_documents, self.n_ids, width = _HEAD.unpack_from(payload)
        if mark != b"RPG1":
            raise ValueError("not a shard of this format")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, kind, n, at)
            at += x.nbytes
            return x

        self.alphabet, self.left, self.right, self.lengths = take("<u4", self.first), *(take("<u4", n_rules) for _ in range(3))
        self.symbols = take(f"<u{width}", n_symbols)
        self.starts, self.counts = take("<u8", self.n_documents), take("<u8", self.n_documents)
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' ids one after another, and where each rule's begin."""
        if self._flat is None:
            flat = np.arange(self.first, self.first + len(self.lengths))
            while len(big := np.flatnonzero(flat >= self.first)):
                rule = flat[big] - self.first
                n = np.ones(len(flat), np.int64)
                n[big] = 2
                at = np.cumsum(n) - n
                flat = np.repeat(flat, n)
                flat[at[big]], flat[at[big] + 1] = self.left[rule], self.right[rule]
            self._flat = self.alphabet[flat], np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        return self._flat

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        n = np.ones(len(symbols), np.int64)
        big = symbols >= self.first
        n[big] = self.lengths[symbols[big].astype(np.int64) - self.first]
        return n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.symbol_lengths(symbols)
        flat, offset = self._expansions()
        at = np.cumsum(n) - n
        base = np.zeros(len(symbols), np.int64)
        big = symbols >= self.first
        base[big] = offset[symbols[big].astype(np.int64) - self.first]
        out = np.empty(int(n.sum()), np.uint32)
        out[at[~big]] = self.alphabet[symbols[~big]]
        long = np.repeat(big, n)
        out[long] = flat[(np.arange(len(out)) + np.repeat(base - at, n))[long]]
        return out

    def ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        """The k-th document's ids, from its own symbols alone."""
        start = int(self.starts[k])
        end = int(self.starts[k + 1]) if k + 1 < self.n_documents else len(self.symbols)
        return self.expand(self.symbols[start:end])

    def tokens(self, k: int, start: int, length: int) -> np.ndarray:
        """ids start to start + length of the k-th document; only the symbols that cover them are expanded."""
        low = int(self.starts[k])
        high = int(self.starts[k + 1]) if k + 1 < self.n_documents else len(self.symbols)
        ends = np.cumsum(self.symbol_lengths(self.symbols[low:high]))
        i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left")
        before = int(ends[i - 1]) if i else 0
        return self.expand(self.symbols[low + i : low + j + 1])[start - before : start - before + length]


def _write(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = packed_encoder(path)
        end, part, start, shard = end_id.to_bytes(encode.width, "little"), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        documents: list[np.ndarray] = []
        size, id_type = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal start, shard, size, doc_ids, documents
            payload = pack_shard(documents)
            row = [part, shard, start, size, payload]
            arrays = [pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            out = pa.RecordBatch.from_arrays([*arrays, pa.array([doc_ids], pa.list_(id_type))], ["part", "shard", "start_in_part", "n_tokens", "payload", "doc_ids"])
            start, shard, size, doc_ids, documents = start + size, shard + 1, 0, [], []
            return out

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                for doc_id, text in zip(batch.column(0).slice(at, ROWS).to_pylist(), batch.column(1).slice(at, ROWS).to_pylist(), strict=True):
                    ids = np.frombuffer(encode(text) + end, f"<u{encode.width}")
                    if documents and size + len(ids) > shard_tokens:
                        yield flush()
                    doc_ids.append(doc_id)
                    documents.append(ids)
                    size += len(ids)
        if documents:
            yield flush()

    return run


def write_store(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
    end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Writes the shards of docs, in ascending order of ``id_col``, to a new table at path."""
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("head", F.substring("text", 1, 32))
    rows = rows.withColumn("turn", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())  # rows of one id, null too, are spread like others
    order = ["id", "head", "turn", "copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    schema = f"part int, shard int, start_in_part long, n_tokens long, payload binary, doc_ids array<{kind_of_id}>"
    rows.mapInArrow(_write(tokenizer_path, end_id, shard_tokens), schema).write.parquet(path)


def _read(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                base, payload, doc_ids = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values
                shard = Shard(payload)
                counts = shard.counts.astype(np.int64)
                ends = np.cumsum(counts)
                ids = shard.ids().astype("<u4")
                values = pa.array([zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, counts, strict=True)], pa.int64())
                if not digests:
                    values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(base + ends - counts), pa.array(counts), values], ["id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return run


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """One row per document: ``id_col``, start, n_tokens and its ids, or with ``digests`` their CRC-32."""
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a task that wrote
    parts = (totals.agg(F.max("part")).first()[0] or 0) + 1
    starts = totals_before(totals, parts, ["n"]).select("part", F.col("n_before").alias("part_start"))
    starts = F.broadcast(starts) if parts <= MOST_PARTS else starts
    rows = shards.join(starts, "part").select((F.col("part_start") + F.col("start_in_part")).alias("base"), "payload", "doc_ids")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    made = "ids_crc32 long" if digests else "ids array<int>"
    return rows.mapInArrow(_read(digests), f"id {kind}, start long, n_tokens long, {made}").withColumnRenamed("id", id_col)


def op2_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "repair-store")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path, digests=True)
