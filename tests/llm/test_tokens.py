"""op2, op4 and op7: encoders, shards, packing."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mediafold.llm import bpe_codec, repair_store, token_memo, vector_packing
from mediafold.llm._common import new_path

ODD = st.lists(
    st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " the", " word.", " Straße", " naïve,", "́", "中", "😀", *" \n\n\t\r\x00\x1c\xa0　ab'stéßÄ.,1İΣ<>|"]), max_size=24
).map("".join)


@pytest.fixture(scope="module")
def tokenizers():
    found = {}
    for name, kind in (("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "word")):
        t = Tokenizer.from_file(P.path(name))
        found[kind] = t
    return found


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(ODD)
def test_memo_gives_the_whole_texts_ids(text):
    for name, kind in (("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "word")):
        encoder = token_memo.packed_encoder(P.path(name))
        assert encoder.kind == kind
        whole = encoder.memo.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder(text), "<u2").tolist() == whole


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["Ärger", "ärger", "Word", "WORD", "word", "ÿ", "ø", "ß", *"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "***", "'s", "\n", " ", " ", " ", "7"]), max_size=24).map("".join))
def test_marks_and_capitals_give_the_whole_texts_ids(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = token_memo.PackedEncoder(P.path(name)) if not text else token_memo.packed_encoder(P.path(name))
        assert np.frombuffer(encoder(text), "<u2").tolist() == ids_of(encoder.memo.tokenizer, text)


def test_a_word_is_encoded_once_for_all_its_marks_and_capitals(tokenizers):
    """Any use of the library for a known word's letters is seen: it then has neither a model nor a whole tokenizer to ask."""
    for kind, variants in (("word", "whorha whorha. Whorha, WHORHA!! whorha***"), ("byte_level", "whorha whorha. whorha, whorha!! whorha***")):
        memo = token_memo.Memo(tokenizers[kind], kind, 2)
        for key in ["whorha", *(f"a{marks}" for marks in (".", ",", "!!", "***"))]:
            memo[key]
        want = [ids_of(tokenizers[kind], key if kind == "word" else " " + key) for key in variants.split()]
        for name in ("tokenizer", "model", "tokenize"):
            setattr(memo, name, None)
        assert [np.frombuffer(memo[key], "<u2").tolist() for key in variants.split()] == want


def test_memo_is_bounded(tokenizers):
    memo = token_memo.Memo(tokenizers["word"], "word", 2, limit=5)
    for k in range(50):
        memo[f"word{k}x"]
        assert len(memo) <= 5


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=30))
def test_safe_pieces_encode_to_the_whole(parts):
    text = "".join(parts)
    enc = bpe_codec.encoding(P.path(bpe_codec.RANKS))
    pieces = list(bpe_codec.safe_pieces(text, long=12))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_codec_edges(edge_docs, no_docs, edge_rows):
    enc = bpe_codec.encoding(P.path(bpe_codec.RANKS))
    got = sorted(map(tuple, bpe_codec.encode_documents(edge_docs, digests=True).collect()), key=repr)
    want = []
    for i, t in edge_rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe_codec.encode_documents(no_docs).count() == 0
    row = bpe_codec.encode_documents(edge_docs.filter("doc_id = 7")).first()
    assert row["decoded"].decode() == edge_rows[9][1] and row["ids"] == enc.encode_ordinary(edge_rows[9][1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=60), min_size=1, max_size=12), st.integers(0, 5))
def test_shard_round_trip_and_random_access(documents, seed):
    arrays = [np.array(d, np.uint16) for d in documents]
    shard = repair_store.Shard(repair_store.pack_shard(arrays))
    assert shard.ids().tolist() == [x for d in documents for x in d]
    rng = random.Random(seed)
    for k, d in enumerate(documents):
        assert shard.document(k).tolist() == d
        start = rng.randrange(len(d))
        n = rng.randint(0, len(d) - start)
        assert shard.tokens(k, start, n).tolist() == d[start : start + n]


def test_grammar_shrinks_repeats_and_no_rule_crosses_documents():
    d = np.array([1, 2, 3, 4] * 200 + [9], np.uint16)
    payload = repair_store.pack_shard([d] * 4)
    assert len(payload) < d.nbytes * 4 / 3
    shard = repair_store.Shard(payload)
    assert (shard.lengths[shard.lengths > 1] <= len(d)).all() and all((shard.document(k) == d).all() for k in range(4))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=300), min_size=1, max_size=4))
def test_no_frequent_pair_is_left(documents):
    shard = repair_store.Shard(repair_store.pack_shard([np.array(d * 3, np.uint16) for d in documents]))
    bounds = [*shard.starts.tolist(), len(shard.symbols)]
    left, free = Counter(), {}
    for i, j in zip(bounds, bounds[1:], strict=False):
        for k in range(i, j - 1):
            pair = (int(shard.symbols[k]), int(shard.symbols[k + 1]))
            if free.get(pair, 0) <= k:  # uses that don't overlap
                left[pair] += 1
                free[pair] = k + 2
    # pairs that overlap one another may keep a few uses each; of those that stand apart none is left
    assert sum(n >= 2 * repair_store.MIN_USES for n in left.values()) == 0


def test_wide_alphabet_uses_32_bits():
    d = np.arange(70_000, dtype=np.uint32)
    assert (repair_store.Shard(repair_store.pack_shard([d, d[::-1].copy()])).document(1) == d[::-1]).all()


def test_store_edges(spark, edge_docs, no_docs, edge_rows, tokenizers):
    path = new_path(spark, "store")
    repair_store.write_store(edge_docs, path, shard_tokens=5000)
    got = [tuple(r) for r in repair_store.read_store(spark, path, digests=True).orderBy("start").collect()]
    turn = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest((t or "").encode(), 42))
    rows = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "")[:32].encode(), turn(r[1])))
    want, start = [], 0
    for i, t in rows:
        ids = [*ids_of(tokenizers["word"], t), 2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    empty = new_path(spark, "store")
    repair_store.write_store(no_docs, empty)
    assert repair_store.read_store(spark, empty).count() == 0


def check_pieces(rows, docs, tokenizer, limit=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limit and len(pieces) <= vector_packing.Limits().segments
        padding += 0 if at & (at - 1) == 0 else limit - at
    for i, t in docs:
        ids = [*ids_of(tokenizer, t), 1]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    return padding


def test_packing_of_a_table(spark, sf, tokenizers):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = vector_packing.op4_vector_packing(spark, sf).collect()
    assert check_pieces(rows, docs, tokenizers["byte_level"]) == 0


def test_packing_edges(edge_docs, no_docs, edge_rows, tokenizers):
    rows = vector_packing.pack_texts(edge_docs, with_ids=True).collect()
    singles = {i for i, n in Counter(i for i, _ in edge_rows).items() if n == 1 and i is not None}
    whole = [r for r in rows if r["doc_id"] in singles]
    for i, t in edge_rows:
        if i in singles:
            pieces = sorted((r for r in whole if r["doc_id"] == i), key=lambda r: r["start"])
            assert [x for r in pieces for x in r["ids"]] == [*ids_of(tokenizers["byte_level"], t), 1]
    assert sum(r["length"] for r in rows) == sum(len(ids_of(tokenizers["byte_level"], t)) + 1 for _, t in edge_rows)
    assert vector_packing.pack_texts(no_docs).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=90), max_size=40), st.booleans())
def test_packer_keeps_all_limits(masks, cut):
    limits = vector_packing.Limits(32, 3, 10)
    packer = vector_packing.Packer(limits, cut, pool=8)
    made = [*packer.add([(k, len(m), np.array(m)) for k, m in enumerate(masks)]), *packer.finish()]
    seen = Counter()
    for pieces in made:
        assert sum(n for _, _, n in pieces) <= 32 and len(pieces) <= 3
        assert sum(sum(masks[k][s : s + n]) for k, s, n in pieces) <= 10
        for k, s, n in pieces:
            seen.update((k, x) for x in range(s, s + n))
    assert seen == Counter((k, x) for k, m in enumerate(masks) for x in range(len(m)))


def test_dot_product_mixes_prompts_and_answers():
    limits = vector_packing.Limits(100, 10, 50)
    masks = [np.ones(50, bool)] * 4 + [np.zeros(50, bool)] * 4
    packer = vector_packing.Packer(limits, cut=False)
    made = [*packer.add([(k, 50, m) for k, m in enumerate(masks)]), *packer.finish()]
    assert len(made) == 4 and all({k < 4 for k, _, _ in pieces} == {True, False} for pieces in made)


def test_instruction_packing(spark):
    rows = [(1, [True] * 3 + [False] * 2), (2, None), (3, []), (4, [True] * 5), (4, [True] * 5)]
    got = vector_packing.pack_examples(spark.createDataFrame(rows, "k long, mask array<boolean>"), "k", "mask", vector_packing.Limits(8, 2, 6)).collect()
    assert Counter(r["k"] for r in got) == {1: 1, 4: 2} and sum(r["length"] for r in got) == 15


def test_short_documents_need_no_padding():
    packer = vector_packing.Packer(vector_packing.Limits(), cut=True)
    lengths = [sum(n for _, _, n in made) for part in range(20) for made in packer.add([(k, 5, None) for k in range(1000 * part, 1000 * part + 1000)])]
    lengths += [sum(n for _, _, n in made) for made in packer.finish()]
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert sum(lengths) == 100_000 and padded < 0.02 * sum(lengths)
