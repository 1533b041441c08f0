"""Vector bin packing: examples are placed into training sequences under limits on tokens, segments and loss-bearing tokens.

Each sequence has a remaining vector and each example a demand vector, both in shares of the limits. The example that fits
and has the greatest dot product with what remains is placed next, so a sequence short of segments takes long examples and one
short of loss-bearing tokens takes prompts. With ``cut`` (documents) an example that doesn't fit may be cut to fill the rest.

Each task packs the rows that it reads, from a pool of at most ``POOL`` examples, so nothing is shuffled and memory is
bounded. A sequence that isn't full, as the limit of segments or of loss-bearing tokens was reached first or as the task ends, is with ``cut`` cut into
sequences whose lengths are powers of two, so they need no padding.

Defined cases: a null text is empty and has only its end id; an example longer than a sequence is cut even without ``cut``;
equal rows are packed each for itself; an empty table gives an empty result; other columns are not read. The result is a
function of the rows in reading order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from mediafold.llm._common import frugal, table
from mediafold.llm.token_memo import MEMO, packed_encoder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
POOL = 1024
ROWS = 128


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


class Packer:
    """add() and finish() give finished sequences: lists of (key, start, length)."""

    def __init__(self, limits: Limits, cut: bool, pool: int = POOL) -> None:
        self.limits, self.cut, self.size = limits, cut, pool
        self.most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.demand = np.zeros((0, 3))  # tokens, segments, loss-bearing tokens of each pooled example
        self.items: list[tuple] = []  # (key, start, length, loss) of each; loss: running counts over the example, or None if all tokens bear loss

    @staticmethod
    def _loss(loss: np.ndarray | None, start: int, end: int) -> int:
        return end - start if loss is None else int(loss[end] - loss[start])

    def _longest(self, loss: np.ndarray | None, start: int, end: int, tokens: float, loss_tokens: float) -> int:
        """The most tokens from start on that so many tokens and loss-bearing tokens allow."""
        end = int(min(end, start + tokens))
        if loss is None:
            return int(min(end - start, loss_tokens))
        return int(np.searchsorted(loss[: end + 1], loss[start] + loss_tokens, "right")) - 1 - start

    def add(self, examples: list[tuple]) -> Iterator[list[tuple]]:
        """examples: (key, number of tokens, mask of loss-bearing tokens or None)."""
        new = []
        for key, n, mask in examples:
            loss, start = None if mask is None else np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]), 0
            while (k := self._longest(loss, start, n, self.limits.tokens, self.limits.loss_tokens)) < n - start or k == self.limits.tokens:
                yield [(key, start, k)]
                start += k
                if start == n:
                    break
            if start < n:
                new.append((key, start, n - start, loss))
        if new:
            self.items += new
            self.demand = np.concatenate([self.demand, [[m, 1, self._loss(loss, s, s + m)] for _, s, m, loss in new]])
        while len(self.items) > self.size:
            yield from self._fill(self.size // 2)

    def _fill(self, keep: int) -> Iterator[list[tuple]]:
        """Sequences from the pool until ``keep`` examples are left."""
        weight = 1 / self.most
        share = self.demand * weight
        alive = np.ones(len(self.items), bool)
        while alive.sum() > keep:
            left, made = self.most.copy(), []
            while left[0] > 0 and left[1] > 0:
                fits = alive & (self.demand <= left).all(axis=1)
                if fits.any():
                    k = int(np.where(fits, share @ (left * weight), -1).argmax())
                    key, start, n, _ = self.items[k]
                    alive[k] = False
                elif self.cut and alive.any():
                    k = int(np.where(alive, self.demand[:, 0], -1).argmax())
                    key, start, whole, loss = self.items[k]
                    n = self._longest(loss, start, start + whole, left[0], left[2])
                    if not n:
                        break
                    self.items[k] = (key, start + n, whole - n, loss)
                    self.demand[k] = (whole - n, 1, self._loss(loss, start + n, start + whole))
                    share[k] = self.demand[k] * weight
                else:
                    break
                left -= (n, 1, self._loss(self.items[k][3], start, start + n))
                made.append((key, start, n))
            yield from self._closed(made)
        self.items = [x for x, a in zip(self.items, alive, strict=True) if a]
        self.demand = self.demand[alive]

    def _closed(self, made: list[tuple]) -> Iterator[list[tuple]]:
        """The sequence; cut at powers of two if that is allowed and it isn't full."""
        used = sum(n for _, _, n in made)
        while self.cut and made and used < self.limits.tokens:
            now, room = [], 1 << used.bit_length() - 1
            used -= room
            while room:
                key, start, n = made.pop(0)
                now.append((key, start, min(n, room)))
                if n > room:
                    made.insert(0, (key, start + room, n - room))
                room -= now[-1][2]
            yield now
        if made:
            yield made

    def finish(self) -> Iterator[list[tuple]]:
        return self._fill(0)


_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(path: str, end_id: int, limits: Limits, cut: bool, with_ids: bool, memo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = packed_encoder(path, memo)
        end, width = end_id.to_bytes(encode.width, "little"), encode.width
        packer, texts, sequence, serial, id_type = Packer(limits, cut), {}, (TaskContext.get().partitionId() << 33) - 1, 0, None

        def rows(sequences: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in sequences:
                sequence, offset = sequence + 1, 0
                for key, start, n in pieces:
                    doc_id, ids, left = texts[key]
                    piece = np.frombuffer(ids, f"<u{width}", n, start * width).astype("<u4")
                    out.append((doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids) // width, sequence, offset, *([piece] if with_ids else [])))
                    offset += n
                    if left == n:
                        del texts[key]
                    else:
                        texts[key] = (doc_id, ids, left - n)
            if out:
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.list_(pa.int32())) for c in columns[7:])]
                yield pa.RecordBatch.from_arrays(arrays, _NAMES + ["ids"] * with_ids)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                part, new = batch.slice(at, ROWS), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text) + end
                    texts[serial] = (doc_id, ids, len(ids) // width)
                    new.append((serial, len(ids) // width, None))
                    serial += 1
                yield from rows(packer.add(new))
        yield from rows(packer.finish())

    return run


def pack_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
    end_id: int = END_ID, limits: Limits | None = None, cut: bool = True, with_ids: bool = False, memo: int = MEMO,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id and offset, and with ``with_ids`` its ids. memo: how many words a Python worker remembers."""
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in _NAMES[1:]) + ", ids array<int>" * with_ids
    return rows.mapInArrow(frugal(_pack(path, end_id, limits or Limits(), cut, with_ids, memo)), schema).withColumnRenamed("id", id_col)


def _pack_examples(limits: Limits, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, ids, sequence, serial, id_type = Packer(limits, cut), {}, (TaskContext.get().partitionId() << 33) - 1, 0, None

        def rows(sequences: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in sequences:
                sequence, offset = sequence + 1, 0
                for key, start, n in pieces:
                    out.append((ids[key][0], start, n, sequence, offset))
                    offset += n
                    ids[key][1] -= n
                    if not ids[key][1]:
                        del ids[key]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "start", "length", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                new = []
                for row_id, mask in zip(batch.column(0).slice(at, ROWS).to_pylist(), batch.column(1).slice(at, ROWS).to_pylist(), strict=True):
                    if mask:
                        ids[serial] = [row_id, len(mask)]
                        new.append((serial, len(mask), np.array(mask, bool)))
                        serial += 1
                yield from rows(packer.add(new))
        yield from rows(packer.finish())

    return run


def pack_examples(examples: DataFrame, id_col: str, loss_mask_col: str, limits: Limits | None = None, cut: bool = False) -> DataFrame:
    """Packs instruction data: ``loss_mask_col`` is an array<boolean> with an element for each token, true where it bears loss.

    One row per piece: ``id_col``, start, length, sequence_id, offset. A null or empty mask has no tokens and no row; a null element is false.
    """
    rows = examples.select(examples[id_col].alias("id"), examples[loss_mask_col].alias("mask"))
    schema = f"id {examples.schema[id_col].dataType.simpleString()}, start long, length long, sequence_id long, offset long"
    return rows.mapInArrow(_pack_examples(limits or Limits(), cut), schema).withColumnRenamed("id", id_col)


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))
