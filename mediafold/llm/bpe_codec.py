"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode_documents`` keeps one row per input row, in no order. Defined cases: a null or empty text has no ids and decodes
to no bytes; repeated rows and null ids are encoded like any other row; an empty table gives an empty result; columns
beside the id and the text are not read, so their names cannot clash. A text of any length is encoded whole.

A text longer than ``LONG`` characters is first cut at safe boundaries: before one space that stands between two characters
that are no white space. No match of the pattern can cover both sides of such a place, and a match never looks back, so the
pieces encode to the ids of the whole. A stretch without a safe boundary is cut into the pattern's matches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from mediafold.llm._common import table

RANKS = "byte_bpe_50k.tiktoken"
LONG = 65_536
ROWS = 256


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def safe_pieces(text: str, pattern: str = public_tokenizers.PATTERN, long: int = LONG) -> Iterator[str]:
    """Pieces of text, of about ``long`` characters, that can be encoded one by one."""
    start = 0
    while len(text) - start > long:
        cut = _SAFE.search(text, start + long // 2, start + long)
        if cut is None or cut.start() == start:
            # no safe place near: go on match by match up to the next one
            cut = _SAFE.search(text, start + long // 2)
            end = cut.start() if cut else len(text)
            yield from (m.group() for m in _compiled(pattern).finditer(text, start, end))
        else:
            end = cut.start()
            yield text[start:end]
        start = end
    if start < len(text):
        yield text[start:]


def encode(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text, enc._pat_str) for i in enc.encode_ordinary(piece)]


def _encoder(ranks_path: str, digests: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [encode(enc, t) for t in part.column(1).to_pylist()]
                decoded = [enc.decode_bytes(i) for i in ids]
                if digests:
                    columns = [
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                        pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                    ]
                else:
                    columns = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", *names])

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, digests: bool = False) -> DataFrame:
    """``id_col`` with ids array<int> and decoded binary; with ``digests`` their count and SHA-256 instead, which stays small.

    No shuffle: each task encodes the rows that it reads.
    """
    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    kind = docs.schema[id_col].dataType.simpleString()
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_encoder(ranks_path, digests), f"id {kind}, {made}").withColumnRenamed("id", id_col)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digests=True)
