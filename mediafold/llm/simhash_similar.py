"""Near duplicates: groups of documents linked by a word-shingle similarity (Jaccard of the sets) of 0.8 or more. Exact: no such pair is missed.

The search is a prefix filter. All shingles are put in one order, those that few documents have first: by the count of the shingle's slot in
a table of ``SLOTS`` counters over all documents, then by hash (any order is right; a good one makes few pairs). Two sets of
similarity s share a shingle among the first n - ceil(s n) + 1 of each, n being the set's size, so each of these is a key. Keys that
one row alone has go at once, by a count of all keys. Where the first key that two rows share is the i-th of n and the j-th of m, they
share no more than min(n - i, m - j), and no more than half of what n + m leaves above the differing bits of their
``FOLD`` parities; pairs for which this is too little are dropped.

``QUICK`` rounds link most. In each, every row takes those of its keys that have the smallest hashes in this round and meets the ``NEXT`` rows
after it under each; of those whose SimHash fingerprints differ in ``WIDE`` bits or fewer (the pivots' bound comes first) the one with
the closest parities is compared. The last round is whole: of each key, all pairs that the links found so far do not connect;
keys whose rows are all connected go before anything is dealt out. A key of over ``BLOCK`` rows is dealt out to cells, one for every two
of its blocks of rows, so no task holds more than two blocks of a key. Texts are joined and shingles compared exactly.

Defined cases: texts without words are similar to each other; of fewer words than a shingle's the whole sequence is the only
shingle; of each group the row with the smallest id stays, null ids last, then the first in reading order; an empty table gives
an empty result; other columns are passed on, whatever their names. Shingles are told apart by 64-bit hashes in the search (a pair of
similarity 0.8 could be missed only if two different shingles of its own have the same, less likely than n^2 / 2^64), by their bytes in the comparison.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafold.llm._common import drop_table, free_name, frugal, join_groups, marked, materialise, without
from mediafold.llm.components import components
from mediafold.llm.simhash import PIVOTS, majority_bits

WORDS = 5
SIMILARITY = 0.8
WIDE = 20
QUICK = 2
NEXT = 32
TAKEN = 8  # keys of a row in a quick round
SLOTS = 18  # 2^SLOTS counters
FOLD = 16  # words of 64 bits
BLOCK = 16384
PAIRS = 1 << 20
AT_ONCE = 1 << 20  # bytes of text
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)  # two multiples up to seven times differ in their highest byte
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first n bytes
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, eight bytes at a time, and where each begins. Different words of up to seven bytes never have the same hash."""
    data = b" %b %b" % (data.lower(), bytes(7))
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw[:-7]]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, length = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h, at, left = length.astype(np.uint64) * _LENGTH, np.arange(len(start)), length
    for c in range(0, int(length.max(initial=0)), 8):
        at = at[left > 0] if c else at
        left = length[at] - c
        x = (h[at] ^ eight[start[at] + c] & _FIRST[np.minimum(left, 8)]) * _ODD
        h[at] = x ^ x >> np.uint64(32)
        left = left - 8
    return h, start - 1


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about AT_ONCE bytes, cut at white space."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + AT_ONCE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def shingle_sets(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    """Of each text the hashes of its distinct shingles, sorted; a text without words has one of its own."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end] or b"") <= AT_ONCE):
            size, end = size + len(texts[end] or b""), end + 1
        group = [t or b"" for t in texts[begin:end]]
        if size > AT_ONCE:
            x, cuts = np.concatenate([word_hashes(p)[0] for p in _pieces(group[0])]), [0]
        else:
            x, start = word_hashes(b" ".join(group))
            cuts = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in group[:-1]])).tolist()
        whole = np.full(max(0, len(x) - words + 1), words, np.uint64)
        for k in range(words):
            whole = _step(whole, x[k : k + len(whole)])
        for i, j in zip(cuts, [*cuts[1:], len(x)], strict=True):
            own = whole[i : j - words + 1]
            if j - i < words:
                own = np.full(1, j - i, np.uint64)
                for k in range(i, j):
                    own = _step(own, x[k : k + 1])
            own = np.sort(own)
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        begin = end


def _step(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h + x) * _ODD
    return h ^ h >> np.uint64(32)


def _counts(words: int):
    """How many documents have a shingle of each slot, by part of the table; a task's whole table is sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOTS, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(at, 256).cast(pa.binary()).to_pylist()
                np.add.at(counts, np.concatenate(list(shingle_sets(texts, words))) >> np.uint64(64 - SLOTS), np.uint32(1))
        parts = counts.reshape(16, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    return run


def _added(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(np.frombuffer(c.as_py(), np.uint32).astype(np.int64) for batch in tables for c in batch.column("counts"))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())], ["part", "counts"])


def slot_counts(rows: DataFrame, words: int) -> np.ndarray:
    """The table of counters: 4 MB, whatever the number of documents."""
    parts = rows.select("text").mapInArrow(frugal(_counts(words)), "part int, counts binary")
    found = {r["part"]: r["counts"] for r in parts.groupBy("part").applyInArrow(_added, "part int, counts binary").collect()}
    return np.concatenate([np.frombuffer(found[k], np.uint32) for k in sorted(found)]) if found else np.zeros(1 << SLOTS, np.uint32)


def prefix_length(n: int, similarity: float) -> int:
    """So many of the first shingles of a set of n hold one of any other set's that is similar."""
    return n - math.ceil(similarity * n - 1e-9) + 1


SIGNATURE = "row long, size int, sketch long, fold binary, keys array<long>"


def _signatures(counts: np.ndarray, words: int, similarity: float):
    """row, size of the set, SimHash fingerprint of the set, parities (FOLD words), and the prefix in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, sketches, folds, prefixes = [], [], [], []
                for h in shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), words):
                    rank = counts[h >> np.uint64(64 - SLOTS)].astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
                    order = np.argsort(rank, kind="stable")[: prefix_length(len(h), similarity)]
                    parity = np.bincount((h % np.uint64(64 * FOLD)).astype(np.int64), minlength=64 * FOLD) & 1
                    sizes.append(len(h))
                    sketches.append(int(np.packbits(majority_bits(h.astype(">u8").view(np.uint8).reshape(-1, 8))).view(">i8")[0]))
                    folds.append(np.packbits(parity.astype(np.uint8)).tobytes())
                    prefixes.append(h[order].view(np.int64))
                ends = np.cumsum([0, *map(len, prefixes)])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)))
                columns = [part.column(0), pa.array(sizes, pa.int32()), pa.array(sketches, pa.int64()), pa.array(folds, pa.binary()), keys]
                yield pa.RecordBatch.from_arrays(columns, ["row", "size", "sketch", "fold", "keys"])

    return run


def first_shared(signed: DataFrame) -> DataFrame:
    """signed without keys but with root, the row itself, and ``shared``: those of its keys that other rows have too (key, place, and n, its number of rows).

    Keys are counted with a partial sum a task and joined, so a frequent one fills no task.
    """
    entries = signed.select(F.posexplode("keys").alias("place", "key"), "row")
    met = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _with_shared(signed.drop("keys").withColumn("root", F.col("row")), entries, met)


def still_shared(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The rows and keys of shared that rows of several roots have. links: node and root of the rows linked so far."""
    rooted = shared.drop("root").join(links.select(F.col("node").alias("row"), "root").hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    rooted = materialise(rooted, "rooted")
    entries = rooted.select(F.inline("shared"), "row", "root").drop("n")
    met = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key", "n")
    return _with_shared(rooted.drop("shared"), entries.drop("root"), met)


def _with_shared(rows: DataFrame, entries: DataFrame, met: DataFrame) -> DataFrame:
    shared = entries.join(met.hint("merge"), "key").groupBy("row").agg(F.collect_list(F.struct("key", "place", "n")).alias("shared"))
    return materialise(rows.join(shared.hint("merge"), "row"), "shared-keys")


CELL = "cell long, row long, root long, size int, place int, side byte, sketch long, fold binary"


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x165667B19E3779F9 % (1 << 64))) * _ODD
    return (x ^ x >> np.uint64(29)) * _ODD


def _cells(block: int, seed: int | None):
    """A row for each shared key of a signature and each cell of the key that the row is in. side: 2 where the cell is of one block.

    With a seed, the TAKEN keys of the smallest hashes alone, and for each the cell of the row's own block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out: list[tuple[np.ndarray, ...]] = []
                rows = part.column("row").to_numpy()
                for k, own in enumerate(part.column("shared")):
                    keys, place, n = (own.values.field(c).to_numpy() for c in ("key", "place", "n"))
                    keys = keys.view(np.uint64)
                    if seed is not None and len(keys) > TAKEN:
                        few = np.argpartition(_mixed(keys, seed), TAKEN)[:TAKEN]
                        keys, place, n = keys[few], place[few], n[few]
                    blocks = -(-n // block)
                    mine = (int(rows[k]) * 0x9E3779B97F4A7C15 % (1 << 64) >> 33) % blocks
                    if seed is None:
                        i = np.repeat(np.arange(len(keys)), blocks)
                        other = np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                        keys, place, mine = keys[i], place[i], mine[i]
                    else:
                        other = mine
                    low, high = np.minimum(mine, other).astype(np.uint64), np.maximum(mine, other).astype(np.uint64)
                    cell = keys + low * np.uint64(0xC2B2AE3D27D4EB4F) + high * np.uint64(0x165667B19E3779F9)
                    out.append((np.full(len(cell), k), cell.view(np.int64), place.astype(np.int32), np.where(mine == other, 2, mine > other).astype(np.int8)))
                of, cell, place, side = map(np.concatenate, zip(*out, strict=True))
                of = pa.array(of)
                columns = [pa.array(cell), *(part.column(c).take(of) for c in ("row", "root", "size")), pa.array(place), pa.array(side), *(part.column(c).take(of) for c in ("sketch", "fold"))]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "row", "root", "size", "place", "side", "sketch", "fold"])

    return run


class _Rows:
    """Rows of whole cells as arrays, in the order in which they came."""

    def __init__(self, table: pa.Table, similarity: float) -> None:
        self.cell, self.row, self.root, self.size, self.place, self.side, sketch = (table.column(c).to_numpy() for c in ("cell", "row", "root", "size", "place", "side", "sketch"))
        self.sketch = sketch.view(np.uint64)
        self.fold = np.frombuffer(b"".join(table.column("fold").to_pylist()), np.uint64).reshape(-1, FOLD)
        self.share = similarity / (1 + similarity)
        self.start = np.flatnonzero(np.concatenate([[True], self.cell[1:] != self.cell[:-1]]))
        end = np.concatenate([self.start[1:], [len(self.cell)]])
        self.last = np.repeat(end, end - self.start)
        self.several = np.repeat(np.minimum.reduceat(self.root, self.start) != np.maximum.reduceat(self.root, self.start), end - self.start)

    def possible(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs that no bound excludes, and the most that each may share."""
        need = self.share * (self.size[i] + self.size[j]) - 1e-6
        good = (self.root[i] != self.root[j]) & ((self.side[i] == 2) | (self.side[i] != self.side[j])) & (np.minimum(self.size[i] - self.place[i], self.size[j] - self.place[j]) >= need)
        i, j, need = i[good], j[good], need[good]
        most = (self.size[i] + self.size[j]) / 2
        for words in (slice(0, 2), slice(2, FOLD)):
            most = most - np.bitwise_count(self.fold[i, words] ^ self.fold[j, words]).sum(axis=1, dtype=np.int64) / 2
            good = most >= need
            i, j, need, most = i[good], j[good], need[good], most[good]
        return i, j, most


def _whole_cells(work):
    """Of sorted rows, work() gets the tables of whole cells; the rows of a batch's last cell wait for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            cut = int(np.argmax(cell == cell[-1]))
            if cut == 0 and waiting and waiting[0].column(0)[0].as_py() == cell[-1]:
                waiting.append(batch)
                continue
            whole = pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            if whole.num_rows:
                yield from work(whole)
            waiting = [batch.slice(cut)]
        if waiting:
            yield from work(pa.Table.from_batches(waiting))

    return run


def _pairs(similarity: float):
    """All pairs of the rows of a cell, sorted by cell and size, that may be similar and are not linked."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = _Rows(table, similarity)
        i = np.flatnonzero(rows.several)
        held, n, d = [], 0, 0

        def out() -> pa.RecordBatch:
            found = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        while len(i):
            d += 1
            i = i[i + d < rows.last[i]]
            i = i[rows.size[i] + 1e-6 >= similarity * rows.size[i + d]]  # sizes ascend, so what is too large now stays so
            a, b, _ = rows.possible(i, i + d)
            a, b = rows.row[a], rows.row[b]
            held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            n += len(a)
            if n >= PAIRS:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return _whole_cells(work)


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of sketches survive the pivots' bound and differ in WIDE bits or fewer."""
    alive = np.ones(len(x), bool)
    for p in (PIVOTS[0], (1 << 32) - 1):
        apart = np.bitwise_count(x ^ np.uint64(p)).astype(np.int16) - np.bitwise_count(y ^ np.uint64(p))
        alive &= np.abs(apart) <= WIDE
    return alive & (np.bitwise_count(x ^ y) <= WIDE)


def _nearest(similarity: float):
    """For each row the likeliest of the NEXT ones before and after it in its cell, and how like it is."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = _Rows(table, similarity)
        i = np.flatnonzero(rows.several)
        best, partner = np.full(len(rows.row), -1.0), np.zeros(len(rows.row), np.int64)
        for d in range(1, NEXT + 1):
            i = i[i + d < rows.last[i]]
            near = i[_close(rows.sketch[i], rows.sketch[i + d])]
            a, b, most = rows.possible(near, near + d)
            like = most / (rows.size[a] + rows.size[b] - most)
            for x, y in ((a, b), (b, a)):  # of one distance, no row is twice in x
                better = like > best[x]
                best[x[better]], partner[x[better]] = like[better], rows.row[y[better]]
        k = np.flatnonzero(best >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(rows.row[k]), pa.array(partner[k]), pa.array(best[k])], ["row", "partner", "like"])

    return _whole_cells(work)


def _clearly_unlike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Of hashes: so far from similar that no few equal hashes of different shingles can be the reason."""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both + 3 < (similarity - 0.01) * (len(p) + len(q) - both)


def _alike_by_bytes(x: bytes | None, y: bytes | None, words: int, similarity: float) -> bool:
    p, q = (set(_byte_shingles(t, words)) for t in (x, y))
    both = len(p & q)
    return both >= similarity * (len(p) + len(q) - both)


def _byte_shingles(text: bytes | None, words: int) -> list[bytes]:
    w = (text or b"").lower().split()
    return [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]


def _similar(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keep = []
                for x, y in zip(*(part.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)), strict=True):
                    p, q = shingle_sets([x], words), shingle_sets([y], words)
                    keep.append(not _clearly_unlike(next(p), next(q), similarity) and _alike_by_bytes(x, y, words, similarity))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def quick_candidates(shared: DataFrame, seed: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of rows: of each row its likeliest partner of a quick round."""
    cells = shared.mapInArrow(frugal(_cells(block, seed)), CELL).withColumn("turn", F.xxhash64("row", "cell", F.lit(seed)))
    cells = cells.repartition("cell").sortWithinPartitions("cell", "turn").drop("turn")
    found = cells.mapInArrow(frugal(_nearest(similarity)), "row long, partner long, like double")
    found = found.groupBy("row").agg(F.max(F.struct("like", "partner")).alias("x"))
    return materialise(found.select(F.least("row", "x.partner").alias("a"), F.greatest("row", "x.partner").alias("b")).distinct(), "quick-candidates")


def other_candidates(shared: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """All pairs a < b of rows that may be similar and are of different roots."""
    cells = shared.mapInArrow(frugal(_cells(block, None)), CELL).repartition("cell").sortWithinPartitions("cell", "size", "row")
    return materialise(cells.mapInArrow(frugal(_pairs(similarity)), "a long, b long").distinct(), "candidates")


def verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose texts are similar. rows: row, text."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    ends = materialise(ends, "candidate-rows")
    texts = materialise(marked(rows, "row", ends, "maybe").filter("maybe").drop("maybe").join(ends.hint("merge"), "row", "left_semi"), "candidate-texts")
    joined = pairs
    for end in ("a", "b"):
        joined = joined.join(texts.select(F.col("row").alias(end), F.col("text").alias(f"text_{end}")).hint("merge"), end)
    found = materialise(joined.select("a", "b", "text_a", "text_b").mapInArrow(frugal(_similar(words, similarity)), "a long, b long"), "verified")
    for old in (texts, ends, pairs):
        drop_table(old)
    return found


def similar_groups(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """node and root of the rows that are linked, without the roots. rows: row, an integer of its own for each row that is alike at each reading, and text.

    A pair whose ends the links found so far connect adds nothing to the groups, so only the other pairs are compared in a later round.
    """
    counts = slot_counts(rows, words)
    signed = materialise(rows.mapInArrow(frugal(_signatures(counts, words, similarity)), SIGNATURE), "signatures")
    shared, links = first_shared(signed), None
    drop_table(signed)
    for turn in range(QUICK + 1):
        pairs = quick_candidates(shared, turn, similarity) if turn < QUICK else other_candidates(shared, similarity)
        found = verified(pairs, rows, words, similarity)
        old = links
        links = components(found if old is None else old.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        if old is not None:
            drop_table(old)
        if turn < QUICK:
            before = shared
            shared = still_shared(before, links)
            drop_table(before)
    drop_table(shared)
    return links


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of similar texts, columns unchanged. docs is a table that is read alike each time."""
    columns, at = docs.columns, free_name(docs, "row")
    docs = docs.withColumn(at, F.monotonically_increasing_id())
    links = similar_groups(docs.select(F.col(at).alias("row"), docs[text_col].cast("string").alias("text")), words, similarity)
    links = links.unionByName(links.select(F.col("root").alias("node"), "root").distinct())
    ids = docs.select(F.col(at).alias("node"), F.struct(docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id"), F.col(at).alias("row")).alias("order"))
    member = materialise(links.join(ids, "node"), "group-members")
    groups = member.groupBy("root").agg(F.min("order").alias("keep"), F.count(F.lit(1)).alias("n"))
    gone = join_groups(member, groups, ["root"], "n", member.count()).filter(F.col("node") != F.col("keep.row")).select(F.col("node").alias(at))
    return without(docs, at, materialise(gone, "near-duplicates")).select(*(F.col(f"`{c}`") for c in columns))
