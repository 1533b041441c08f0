"""Jaccard join of word-shingle sets with two kinds of skipping by how sets are related; exact: no link between different sets is lost.

Equal sets are one row from the start. All shingles are put in one order, rare ones first (by counters over all documents; any order is
right). Two sets of similarity s share one of the first n - ceil(s n) + 1 shingles of each, so an index has a list for each such shingle
that several sets have. Entries know the shingle's position in their set.

* *Index level.* A list is sorted into blocks of one set size, and by position in a block. With a set of size n that has the shingle
  at position i, one of size m that has it at j shares min(n - i, m - j) at most, so blocks of sizes too far off are skipped, and of a
  block all behind the last position that leaves enough. Sets that are linked already, directly or through others, are related: if they are
  most of a list, only the other sets look for partners in it.
* *Answer level.* First rounds link each set to the likeliest sets that it meets, exactly compared. A set with more links than those it is linked to
  leads a family; a member S of leader L has the differences S - L and L - S. In the last round candidates (S, T) are grouped by their
  leaders L and M. These are compared once, and S's answer follows from L's: |S and T| is |L and M| up to the differences. If that
  bound can't reach the threshold, or can't miss it, nothing else is looked at; otherwise the differences alone are counted. The texts of S and T aren't read.

Lists of over ``BLOCK`` sets are dealt out to cells of two blocks each, the pairs of two leaders to portions of ``PORTION``, and all
else is joined with partial counts first, so no task needs a whole list or family.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; of fewer words than a shingle's the whole sequence is the only
shingle; null ids are never a component's smallest unless it has no other; equal rows are in one component; an empty table gives an empty
result; other columns are not read. Texts are taken whole. Shingles are told apart by 64-bit hashes, sets by 128 bits of a digest of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.llm._common import drop_table, frugal, join_groups, marked, materialise, table, without
from mediafold.llm.components import components
from mediafold.llm.simhash import majority_bits
from mediafold.llm.simhash_similar import BLOCK, CELL, FOLD, SLOTS, _cells, _Rows, _whole_cells, first_shared, prefix_length, quick_candidates, shingle_sets, slot_counts, still_shared

WORDS = 4
SIMILARITY = 0.85
QUICK = 2
PORTION = 4096
PAIRS = 1 << 20
ROWS = 256

SIGNATURE = "row long, id {id}, size int, digest binary, sketch long, fold binary, keys array<long>"


def _signatures(counts: np.ndarray, words: int, similarity: float):
    """Of each text the set's size, digest, SimHash fingerprint, parities, and its first shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(2).cast(pa.binary()).to_pylist()
                sizes, digests, sketches, folds, prefixes = [], [], [], [], []
                for text, h in zip(texts, shingle_sets(texts, words), strict=True):
                    h = h if (text or b"").strip() else h[:0]
                    rank = counts[h >> np.uint64(64 - SLOTS)].astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
                    order = np.argsort(rank, kind="stable")[: prefix_length(len(h), similarity)] if len(h) else np.zeros(0, np.int64)
                    sizes.append(len(h))
                    digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    sketches.append(int(np.packbits(majority_bits(h.astype(">u8").view(np.uint8).reshape(-1, 8))).view(">i8")[0]))
                    folds.append(np.packbits((np.bincount((h % np.uint64(64 * FOLD)).astype(np.int64), minlength=64 * FOLD) & 1).astype(np.uint8)).tobytes())
                    prefixes.append(h[order].view(np.int64))
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate(prefixes)))
                columns = [part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(sketches, pa.int64()), pa.array(folds, pa.binary()), keys]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "size", "digest", "sketch", "fold", "keys"])

    return run


class _List(_Rows):
    """Cells of the index, each sorted by size and position, with their blocks of one size."""

    def __init__(self, rows: pa.Table, similarity: float) -> None:
        super().__init__(rows, similarity)
        self.similarity = similarity
        cell = np.repeat(np.arange(len(self.start)), np.diff(np.append(self.start, len(self.cell))))
        self.at = cell << 32 | self.size.astype(np.int64)  # cell and size
        self.blocks, self.first = np.unique(self.at, return_index=True)
        self.block = np.repeat(np.arange(len(self.blocks)), np.diff(np.append(self.first, len(self.at))))
        self.placed = self.block << 32 | self.place.astype(np.int64)  # block and position: ascending
        # whether most of a row's cell is linked with it; such rows need not look for partners
        order = np.lexsort((self.root, cell))
        edge = np.flatnonzero(np.concatenate([[True], (cell[order][1:] != cell[order][:-1]) | (self.root[order][1:] != self.root[order][:-1])]))
        count = np.diff(np.append(edge, len(order)))
        share = np.empty(len(order), np.int64)
        share[order] = np.repeat(count, count)
        most = np.repeat(np.maximum.reduceat(share, self.start), np.diff(np.append(self.start, len(self.cell)))) if len(self.start) else share
        tied = np.full(len(self.start), np.iinfo(np.int64).max)
        np.minimum.at(tied, cell[share == most], self.root[share == most])
        self.most = self.root == tied[cell]

    def partners(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places that blocks and positions don't exclude; a few at a time."""
        t, n, i = self.similarity, self.size.astype(float), np.flatnonzero(self.several & ~self.most)
        low = np.ceil(t * n[i] - 1e-6).astype(np.int64)
        left = n[i] - self.place[i]  # the most that the row can share
        high = np.floor(np.minimum(n[i] / t, left / self.share - n[i]) + 1e-6).astype(np.int64)
        cell = self.at[i] >> 32 << 32
        from_block, to_block = np.searchsorted(self.blocks, cell | low), np.searchsorted(self.blocks, cell | np.maximum(high, 0), "right")
        blocks = np.where(high >= low, np.maximum(to_block - from_block, 0), 0)
        for begin, end in _portions(blocks):
            k = np.repeat(np.arange(begin, end), blocks[begin:end])
            b = from_block[k] + np.arange(len(k)) - np.repeat(np.cumsum(blocks[begin:end]) - blocks[begin:end], blocks[begin:end])
            size = (self.blocks[b] & 0xFFFFFFFF).astype(float)
            last = np.floor(size - self.share * (n[i[k]] + size) + 1e-6).astype(np.int64)  # the last position that leaves enough
            till = np.searchsorted(self.placed, b << 32 | np.maximum(last, 0), "right")
            length = np.where(last >= 0, np.maximum(till - self.first[b], 0), 0)
            for x, y in _portions(length):
                p = np.repeat(i[k[x:y]], length[x:y])
                q = np.repeat(self.first[b[x:y]] - (np.cumsum(length[x:y]) - length[x:y]), length[x:y]) + np.arange(len(p))
                once = self.most[q] | (q > p)  # two rows that both look meet once
                yield p[once], q[once]


def _portions(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PAIRS in all, or of one count."""
    total, begin = np.cumsum(counts), 0
    while begin < len(counts):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
        yield begin, end
        begin = end


def _index_pairs(similarity: float):
    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        index = _List(rows, similarity)
        for p, q in index.partners():
            a, b, _ = index.possible(p, q)
            if len(a):
                a, b = index.row[a], index.row[b]
                found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return _whole_cells(work)


def index_candidates(shared: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """All pairs a < b of rows of different roots that the index doesn't skip. shared: as first_shared() gives it."""
    cells = shared.mapInArrow(frugal(_cells(block, None)), CELL).repartition("cell").sortWithinPartitions("cell", "size", "place")
    return materialise(cells.mapInArrow(frugal(_index_pairs(similarity)), "a long, b long").distinct(), "candidates")


STREAM = "lead_a long, lead_b long, portion int, kind int, a long, b long, text_a string, text_b string, plus_a binary, minus_a binary, plus_b binary, minus_b binary"
LINK = "a long, b long, plus binary, minus binary"


def _numbers(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.uint64)


def _inside(x: np.ndarray, sorted_y: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_y, x)
    return sorted_y[np.minimum(at, len(sorted_y) - 1)] == x if len(sorted_y) else np.zeros(len(x), bool)


class _Relatives:
    """The sets of two leaders, and what follows for members of their families."""

    def __init__(self, lead_a: np.ndarray, lead_b: np.ndarray, similarity: float) -> None:
        self.a, self.b, self.limit = lead_a, lead_b, Fraction(similarity).limit_denominator(10**6)
        self.both = np.intersect1d(lead_a, lead_b, assume_unique=True)

    def enough(self, shared: int, n: int, m: int) -> bool:
        return shared * self.limit.denominator >= (n + m - shared) * self.limit.numerator

    def linked(self, plus_a: np.ndarray, minus_a: np.ndarray, plus_b: np.ndarray, minus_b: np.ndarray) -> bool:
        """Whether S = (L - minus_a) + plus_a and T = (M - minus_b) + plus_b are similar."""
        n, m = len(self.a) - len(minus_a) + len(plus_a), len(self.b) - len(minus_b) + len(plus_b)
        if not self.enough(min(n, m, len(self.both) + len(plus_a) + len(plus_b)), n, m):
            return False
        if self.enough(len(self.both) - len(minus_a) - len(minus_b), n, m):
            return True
        lost = np.union1d(minus_a[_inside(minus_a, self.both)], minus_b[_inside(minus_b, self.both)])
        shared = len(self.both) - len(lost) + len(np.intersect1d(plus_a, plus_b, assume_unique=True))
        shared += int((_inside(plus_b, self.a) & ~_inside(plus_b, minus_a)).sum()) + int((_inside(plus_a, self.b) & ~_inside(plus_a, minus_b)).sum())
        return self.enough(shared, n, m)

    def differences(self) -> tuple[bytes, bytes]:
        return np.setdiff1d(self.b, self.both, assume_unique=True).tobytes(), np.setdiff1d(self.a, self.both, assume_unique=True).tobytes()


def _answers(words: int, similarity: float, with_differences: bool):
    """Linked pairs of a stream in which the texts of two leaders come before the pairs of their families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Relatives | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, out = {c: part.column(c).to_pylist() for c in ("kind", "a", "b", "plus_a", "minus_a", "plus_b", "minus_b")}, []
                texts = (part.column(c).cast(pa.binary()) for c in ("text_a", "text_b"))
                texts_a, texts_b = (t.to_pylist() for t in texts)
                for k, kind in enumerate(rows["kind"]):
                    if kind == 0:
                        now = _Relatives(*shingle_sets([texts_a[k], texts_b[k]], words), similarity)
                    elif now and now.linked(*(_numbers(rows[c][k]) for c in ("plus_a", "minus_a", "plus_b", "minus_b"))):
                        out.append((rows["a"][k], rows["b"][k], *(now.differences() if with_differences else (None, None))))
                a, b, plus, minus = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(plus, pa.binary()), pa.array(minus, pa.binary())], ["a", "b", "plus", "minus"])

    return run


def compared(pairs: DataFrame, rows: DataFrame, words: int, similarity: float, members: DataFrame | None = None) -> DataFrame:
    """The linked ones of pairs a < b, with b - a (plus) and a - b (minus) if there are no members.

    members: row, lead, plus (row - lead), minus (lead - row), of rows in another one's family. The texts of leaders alone are read, once a
    portion of their families' pairs.
    """
    if members is None:
        led = pairs.withColumns({"lead_a": F.col("a"), "lead_b": F.col("b")} | {c: F.lit(None).cast("binary") for c in ("plus_a", "minus_a", "plus_b", "minus_b")})
    else:
        led = pairs
        for end in ("a", "b"):
            one = members.select(F.col("row").alias(end), F.col("lead").alias(f"lead_{end}"), F.col("plus").alias(f"plus_{end}"), F.col("minus").alias(f"minus_{end}"))
            led = led.join(one.hint("merge"), end, "left").withColumn(f"lead_{end}", F.coalesce(f"lead_{end}", end))
    if members is None:
        led = led.withColumn("portion", F.lit(0))
    else:  # the pair of two leaders is dealt out to so many portions that each has about PORTION pairs
        led = materialise(led, "led")
        n = led.groupBy("lead_a", "lead_b").agg(F.count(F.lit(1)).alias("n"))
        led = led.join(n.hint("merge"), ["lead_a", "lead_b"]).withColumn("portion", F.pmod(F.xxhash64("a", "b"), F.floor(F.col("n") / PORTION) + 1).cast("int"))
    leaders = led.select("lead_a", "lead_b", "portion").distinct()
    ends = materialise(leaders.select(F.explode(F.array("lead_a", "lead_b")).alias("row")).distinct(), "leaders")
    texts = marked(rows, "row", ends, "maybe").filter("maybe").drop("maybe").join(ends.hint("merge"), "row", "left_semi")
    texts = materialise(texts, "leader-texts")
    for end in ("a", "b"):
        leaders = leaders.join(texts.select(F.col("row").alias(f"lead_{end}"), F.col("text").alias(f"text_{end}")).hint("merge"), f"lead_{end}")
    stream = leaders.withColumn("kind", F.lit(0)).unionByName(led.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = stream.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in STREAM.split(", ")))
    stream = stream.repartition("lead_a", "lead_b", "portion").sortWithinPartitions("lead_a", "lead_b", "portion", "kind")
    found = materialise(stream.mapInArrow(frugal(_answers(words, similarity, members is None)), LINK), "links")
    for old in (ends, texts):
        drop_table(old)
    return found


def families(links: DataFrame) -> DataFrame:
    """row, lead, plus (row - lead) and minus (lead - row) of those rows that a leader has. links: a, b, plus (b - a), minus (a - b).

    A leader has more links than any row linked with it (ties: the smaller row number), so leaders are never members.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("minus").alias("plus"), F.col("plus").alias("minus")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"), "plus", "minus"))
    light = both.select("u", "v")
    degree = light.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    rank = lambda d, row: F.struct(F.col(d).alias("d"), (-F.col(row)).alias("r"))
    ranked = light.join(degree.withColumnsRenamed({"u": "v", "d": "dv"}).hint("merge"), "v")
    top = ranked.groupBy("u").agg(F.max(rank("dv", "v")).alias("top")).join(degree, "u")
    leaders = top.filter(rank("d", "u") > F.col("top")).select(F.col("u").alias("v"))
    own = ranked.join(leaders.hint("merge"), "v").groupBy("u").agg(F.max(rank("dv", "v")).alias("top")).select("u", (-F.col("top.r")).alias("v"))
    return both.join(own.hint("merge"), ["u", "v"]).select(F.col("u").alias("row"), F.col("v").alias("lead"), "plus", "minus").dropDuplicates(["row"])


def set_classes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (row, text), their signatures, and classes of equal sets that aren't empty: digest, rep (the smallest row), least (id) and n."""
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    counts = slot_counts(texts, words)
    signed = texts.select("row", "id", "text").mapInArrow(frugal(_signatures(counts, words, similarity)), SIGNATURE.format(id=texts.schema["id"].dataType.simpleString()))
    signed = materialise(signed, "signatures")
    classes = signed.filter("size > 0").groupBy("digest").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    return texts.select("row", "text"), signed, materialise(classes, "set-classes")


def similar_sets(texts: DataFrame, signed: DataFrame, classes: DataFrame, words: int, similarity: float, quick: int = QUICK, block: int = BLOCK) -> DataFrame:
    """node and root of the classes (by their rep) that links connect, without the roots."""
    others = signed.select("row", "size", "digest").filter("size > 0").join(classes.select(F.col("rep").alias("row"), "digest", F.lit(True).alias("first")).hint("merge"), ["row", "digest"], "left")
    others = materialise(others.filter("first IS NULL").select("row"), "other-rows")
    reps = without(signed.filter("size > 0").select("row", "size", "sketch", "fold", "keys"), "row", others)
    shared, members, found, links = first_shared(reps), None, None, None
    for turn in range(quick + 1):
        last = turn == quick
        pairs = index_candidates(shared, similarity, block) if last else quick_candidates(shared, turn, similarity, block)
        if last and found is not None:
            members = materialise(families(found), "families")
        new = compared(pairs, texts, words, similarity, members)
        drop_table(pairs)
        found = new if found is None else materialise(found.unionByName(new), "links")
        old, links = links, components(found.select("a", "b"))
        if old is not None:
            drop_table(old)
        if not last:
            before, shared = shared, still_shared(shared, links)
            drop_table(before)
    drop_table(shared)
    return links


def set_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, quick: int = QUICK, block: int = BLOCK
) -> DataFrame:
    """One row per row: ``id_col``, n_shingles, component_id (the smallest id that links reach, itself included) and n_equal, how many rows have the same set.
    docs is a table that is read alike each time."""
    texts, signed, classes = set_classes(docs, id_col, text_col, words, similarity)
    links = similar_sets(texts, signed, classes, words, similarity, quick, block)
    rooted = classes.join(links.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = materialise(rooted, "rooted-classes")
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    each = join_groups(rooted.select("digest", "root", "n"), roots, ["root"], "m", rooted.count()).select("digest", "component_id", "n")
    rows = signed.select("id", "size", "digest")
    full, empty = rows.filter("size > 0"), rows.filter("size = 0").withColumns({"component_id": F.col("id"), "n": F.lit(None).cast("long")})
    full = join_groups(full, materialise(each, "classes"), ["digest"], "n", rows.count())
    size: Column = F.col("size").cast("long").alias("n_shingles")
    return full.unionByName(empty).select(F.col("id").alias(id_col), size, "component_id", F.col("n").alias("n_equal"))


def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join(table(spark, sf_dir, "documents"))
