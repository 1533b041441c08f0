"""Product-quantiser codes by Lloyd's rounds with Elkan's bounds, in whole numbers.

A component x counts as floor(``SCALE`` x). A vector is cut into ``PARTS`` parts and each part position has a codebook, at first
that part of the ``ENTRIES`` vectors of the smallest ids. A round assigns each part to its nearest entry (ties to the lower
index) and then moves each entry to the floored mean of its parts; entries without parts stay.

Between rounds each row keeps, for each part, its entry, an upper bound of the distance to it, and one lower bound for every entry
(a whole number of 16 bits, rounded down). When entries move, the upper bound grows and the lower bounds shrink by how far each moved. An entry is
passed over only if its lower bound, or half its distance from the row's own entry, is strictly greater than the upper bound; the rest,
ties among them, are decided by squared distances in whole numbers. So the result is that of comparing everything with everything.

The rows and their bounds are a table in the shared folder, written anew each round; only the sums of each entry meet, a row per task and entry.
The codebooks, PARTS x ENTRIES short vectors whatever the input, pass through the driver.

Defined cases: rows whose vector is null or holds a null or a component that isn't finite go; vectors shorter than the longest, or of a length that
PARTS doesn't divide, count as continued by zeros; of equal ids the smaller vector comes first, and null ids come last; with fewer rows than ENTRIES there
are fewer entries; equal rows are kept, each for itself; an empty table gives an empty result; other columns are passed by. Components of 2^27 and more
are computed exactly too, with Python's integers; an error beyond a long is then its largest value.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.llm._common import drop_table, frugal, join_groups, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 4096
_WIDE = 1 << 27  # squared distances of smaller components fit into 64 bits
_MOST_BOUND = (1 << 16) - 1
_LONG = (1 << 63) - 1

Codebooks = list[list[list[int]]]  # part, entry, component
STATE = "id {id}, label {label}, vector binary, codes binary, upper binary, lower binary"


def _finite(vec: str) -> str:
    return f"{vec} IS NOT NULL AND forall({vec}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


def _as_integers(column: pa.Array, width: int, wide: bool) -> np.ndarray:
    """Rows of floor(SCALE x), continued by zeros to the width."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if wide:
        flat = np.array([int(x) for x in flat], object)
    offsets = np.cumsum(np.concatenate([[0], pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)]))
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), object if wide else np.int64)
    at = np.arange(width)
    inside = at < lengths[:, None]
    out[inside] = flat
    return out


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows as binaries: 32-bit numbers, or decimal digits where they may not fit."""
    if rows.dtype == object:
        return pa.array([",".join(map(str, r)).encode() for r in rows], pa.binary())
    return pa.array([r.tobytes() for r in rows.astype("<i4")], pa.binary())


def _unpacked(column: pa.Array, width: int, wide: bool) -> np.ndarray:
    values = column.to_pylist()
    if wide:
        return np.array([[int(x) for x in v.split(b",")] for v in values], object).reshape(len(values), width)
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), width).astype(np.int64)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.array([float(min(x, 1 << 1000)) for x in squares]) if squares.dtype == object else squares.astype(np.float64))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the parts x (a row each) the nearest entries of the book and the squared distances; code, upper and lower are brought up to date. Last, how many distances were computed."""
    between = np.stack([_root(_squares(book, c)) for c in book]) / 2
    between -= between * 1e-12 + 1e-9  # so rounding never makes a bound too strict
    exact = _squares(x, book[code])
    computed = len(x)
    upper[:] = _root(exact) * (1 + 1e-12)
    closest = np.where(np.eye(len(book), dtype=bool), np.inf, between).min(axis=1, initial=np.inf)
    open_rows = np.flatnonzero(upper >= closest[code])  # of the others even the entry next to theirs is too far
    for j in range(len(book)):
        own = code[open_rows]
        rows = open_rows[(own != j) & (lower[open_rows, j] <= upper[open_rows]) & (between[own, j] <= upper[open_rows])]
        if not len(rows):
            continue
        d = _squares(x[rows], book[j])
        computed += len(rows)
        root = _root(d)
        lower[rows, j] = np.minimum(np.floor(root * (1 - 1e-12)), _MOST_BOUND)
        better = (d < exact[rows]) | (d == exact[rows]) & (j < code[rows])
        rows, d, root = rows[better], d[better], root[better]
        # the entry left behind keeps what is known of it
        lower[rows, code[rows]] = np.minimum(np.floor(upper[rows] * (1 - 1e-11)), _MOST_BOUND)
        code[rows], exact[rows], upper[rows] = j, d, root * (1 + 1e-12)
    return code, exact, computed


def _as_books(books: Codebooks, wide: bool) -> list[np.ndarray]:
    return [np.array(b, object if wide else np.int64).reshape(len(b), -1) for b in books]


def _assigned(books: Codebooks, moved: list[list[float]] | None, wide: bool, last: bool):
    """A round's assignment. moved: how far each entry went since the bounds were made; None if there are none yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = _as_books(books, wide), len(books[0])
        part = own[0].shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                now = batch.slice(at, ROWS)
                n = now.num_rows
                x = _unpacked(now.column("vector"), part * len(own), wide)
                if moved is None:
                    codes, upper = np.zeros((n, len(own)), np.int64), np.zeros((n, len(own)))
                    lower = np.zeros((n, len(own), k), np.int32)
                else:
                    codes = np.frombuffer(b"".join(now.column("codes").to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
                    upper = np.frombuffer(b"".join(now.column("upper").to_pylist()), "<f8").reshape(n, -1).copy()
                    lower = np.frombuffer(b"".join(now.column("lower").to_pylist()), "<u2").reshape(n, len(own), k).astype(np.int32)
                    lower = np.maximum(0, lower - np.minimum(np.ceil(np.array(moved)), _MOST_BOUND).astype(np.int32))
                    upper += np.array(moved)[np.arange(len(own)), codes]
                error = 0
                for i, book in enumerate(own):
                    codes[:, i], squares, _ = nearest(x[:, i * part : (i + 1) * part], book, codes[:, i], upper[:, i], lower[:, i])
                    error = error + squares
                digits = [bytes(r) for r in codes.astype(np.uint8)]
                columns = [now.column("id"), now.column("label")]
                if last:
                    columns += [pa.array([d.hex() for d in digits]), pa.array([min(int(e), _LONG) for e in error], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])
                else:
                    columns += [now.column("vector"), pa.array(digits, pa.binary()), pa.array([u.tobytes() for u in upper.astype("<f8")], pa.binary())]
                    columns += [pa.array([b.tobytes() for b in lower.astype("<u2")], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "label", "vector", "codes", "upper", "lower"])

    return run


def _summed(parts: int, entries: int, width: int, wide: bool):
    """The sums and counts of each part position's entries over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width // parts
        sums, counts = np.zeros((parts, entries, size), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                now = batch.slice(at, ROWS)
                x = _unpacked(now.column("vector"), width, wide)
                codes = np.frombuffer(b"".join(now.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
                for i in range(parts):
                    own = np.zeros((entries, size), x.dtype)
                    np.add.at(own, codes[:, i], x[:, i * size : (i + 1) * size])
                    sums[i] += own
                    counts[i] += np.bincount(codes[:, i], minlength=entries)
        i, j = np.nonzero(counts)
        if len(i):
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(counts[i, j]), pa.array([[str(v) for v in s] for s in sums[i, j]], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return run


def _added(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in rows:
        for count, sums in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            n, now = n + count, [int(s) for s in sums]
            total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
    columns = [pa.array([k.as_py()], pa.int32()) for k in key]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([n]), pa.array([[str(x) for x in total or []]], pa.list_(pa.string()))], ["part", "entry", "n", "sums"])


def _moved(state: DataFrame, books: Codebooks, wide: bool) -> tuple[Codebooks, list[list[float]]]:
    """The books with each used entry at the floored mean of its parts, and how far each went."""
    parts, k, size = len(books), len(books[0]), len(books[0][0])
    shape = "part int, entry int, n long, sums array<string>"
    sums = state.select("vector", "codes").mapInArrow(frugal(_summed(parts, k, parts * size, wide)), shape)
    new = [[list(e) for e in b] for b in books]
    for r in sums.groupBy("part", "entry").applyInArrow(_added, shape).collect():  # PARTS x ENTRIES at most
        new[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    far = [[math.sqrt(min(sum((a - b) ** 2 for a, b in zip(e, f, strict=True)), 1 << 1000)) * (1 + 1e-12) for e, f in zip(b, c, strict=True)] for b, c in zip(books, new, strict=True)]
    return new, far


def encode(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """The codes, a row per kept row: ``id_col``, ``label_col``, code (two hexadecimal digits a part) and error, the squared distance; and the codebooks. entries: 256 or fewer."""
    if not 1 <= entries <= 256:
        raise ValueError("a code's digit tells 256 entries apart")
    kept = rows.select(rows[id_col].alias("id"), rows[label_col].alias("label"), rows[vec_col].alias("vec")).filter(_finite("vec"))
    longest, most, n = kept.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs))).cast("double"), F.count(F.lit(1))).first()
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    final = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    if not n:
        return rows.sparkSession.createDataFrame([], final).withColumnsRenamed({"id": id_col, "label": label_col}), []
    width, wide = -(-max(longest, 1) // parts) * parts, bool(most is not None and most * SCALE + 1 >= _WIDE)
    size = width // parts

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                now = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([now.column(0), now.column(1), _packed(_as_integers(now.column(2), width, wide))], ["id", "label", "vector"])

    state = materialise(kept.mapInArrow(frugal(integers), f"id {kinds['id']}, label {kinds['label']}, vector binary"), "vectors")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    values = [[math.floor(float(x) * SCALE) for x in r["vec"]] for r in first]
    values = [v + [0] * (width - len(v)) for v in values]
    books: Codebooks = [[v[i * size : (i + 1) * size] for v in values] for i in range(parts)]
    far, schema = None, STATE.format(**kinds)
    for _ in range(rounds):
        old, state = state, materialise(state.mapInArrow(frugal(_assigned(books, far, wide, False)), schema), "bounds")
        drop_table(old)
        books, far = _moved(state, books, wide)
    coded = materialise(state.mapInArrow(frugal(_assigned(books, far, wide, True)), final), "codes")
    drop_table(state)
    return coded.withColumnsRenamed({"id": id_col, "label": label_col}), books


def codebooks_sha256(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error, the error summed over the rows of equal labels; nulls are one label. A label may have most of the rows."""
    keyed = coded.withColumns({"_none": F.col(label_col).isNull(), "_key": F.coalesce(F.col(label_col).cast("string"), F.lit(""))})
    totals = keyed.groupBy("_none", "_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    out = join_groups(keyed, totals.select("_none", "_key", "n", F.least("total", F.lit(_LONG)).cast("long").alias("label_error")), ["_none", "_key"], "n", coded.count())
    return out.drop("_none", "_key", "n")


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
