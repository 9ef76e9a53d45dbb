"""Compression of vectors to short codes: Lloyd's rounds a part position, with Hamerly's bounds, in whole numbers.

Components become ``floor(4096 * x)`` and vectors are cut into 8 equal parts. A part position has a codebook of 16
entries, which begins as the parts of the 16 smallest ids; a round gives every part to its nearest
entry (ties to the lower index) and puts every entry at the floored mean of its parts.

Rows keep, beside each part's entry, an upper bound of the distance to it and a lower bound of the distance to
the second nearest one. A round shifts both by how far entries moved and scans all entries of a part
only where the upper bound is not strictly below the lower one (or below half the way to the
next entry), first as carried, then after it is made exact; so a tie is always scanned. Distances are exact integers; bounds are
doubles rounded away from each other. Rounds are written tables, the one before removed; no row is shuffled: a task sums its parts by entry, and
only those sums meet.

Defined results: vectors that are null or hold null or non-finite components are dropped, every finite vector
takes part (components beyond what longs can square go by Python's integers); vectors meet the codebooks of
their own dimension, and one that 8 does not divide is filled up with zeros at its end; fewer than 16
ids give fewer entries; a repeated id gives one entry (its least vector), null ids come last; an
error that no long holds is null, and so is the sum of its label; null labels are one label; an empty table gives no
rows; repeated rows give a row each; further columns are ignored. The driver holds the codebooks, 16 vectors a
dimension: more than ``MOST_COMPONENTS`` numbers in all of them raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import integers, materialize, removed, text_batches, written

MOST_COMPONENTS = 1 << 25
#: Sums leave a task in digits of so many bits, so that tables of them can be summed as longs.
DIGIT_BITS = 40
UP, DOWN = 1 + 1e-14, 1 - 1e-14


def largest(values: np.ndarray) -> int:
    return int(np.abs(values).max(initial=0)) if values.size else 0


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (n, w) from entries (n, w) or (n, k, w)."""
    if x.dtype == object or entries.dtype == object or x.shape[-1] * (largest(x) + largest(entries)) ** 2 >= 2**62:
        x, entries = x.astype(object), entries.astype(object)
    d = x - entries
    return (d * d).sum(axis=-1)


def roots(d2: np.ndarray, factor: float, unknown: float) -> np.ndarray:
    """Square roots rounded up or down; ``unknown`` for integers beyond longs, whose bounds then never hold."""
    if d2.dtype == object:
        return np.full(d2.shape, unknown)
    return np.sqrt(d2.astype(np.float64)) * factor


@dataclass
class Moves:
    """Of one part position: how far each entry moved, the most that any other did, half the way to the next entry."""

    own: np.ndarray
    others: np.ndarray
    half: np.ndarray


def moves(before: np.ndarray, now: np.ndarray) -> Moves:
    own = roots(squares(before, now), UP, np.inf)
    k = len(own)
    others = np.array([max((own[i] for i in range(k) if i != j), default=0.0) for j in range(k)])
    apart = squares(now[:, None, :], now[None, :, :]) if k else np.zeros((0, 0), np.int64)
    if apart.dtype == object:
        half = np.zeros(k)
    else:
        far = roots(apart, DOWN, 0.0)
        np.fill_diagonal(far, np.inf)
        half = far.min(axis=1, initial=np.inf) / 2
    return Moves(own, others, half)


def reassign(x: np.ndarray, entries: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: Moves) -> np.ndarray:
    """Nearest entries of parts (n, w), written into ``code``, ``upper`` and ``lower``; which rows were scanned."""
    upper[:] = (upper + moved.own[code]) * UP
    lower[:] = np.maximum(lower - moved.others[code], 0) * DOWN
    bound = np.maximum(lower, moved.half[code])
    left = np.flatnonzero(~(upper < bound))
    if len(left):
        upper[left] = roots(squares(x[left], entries[code[left]]), UP, np.inf)
        left = left[~(upper[left] < bound[left])]
    step = max(1, (1 << 20) // max(1, entries.size))
    for k in range(0, len(left), step):
        some = left[k : k + step]
        d2 = squares(x[some][:, None, :], entries[None, :, :])
        best = d2.argmin(axis=1)  # the first of the least
        least = d2[np.arange(len(some)), best]
        code[some] = best
        upper[some] = roots(least, UP, np.inf)
        if d2.dtype == object:
            lower[some] = 0
        else:
            d2[np.arange(len(some)), best] = np.iinfo(np.int64).max
            lower[some] = np.where(len(entries) > 1, roots(d2.min(axis=1), DOWN, 0.0), np.inf)
    return left


@dataclass
class Codebooks:
    """``books``: dimension -> integers [entry, padded component]."""

    books: dict[int, np.ndarray]
    parts: int
    scale: int

    def width(self, dim: int) -> int:
        return -(-dim // self.parts)

    def padded(self, values: np.ndarray) -> np.ndarray:
        """Rows of one dimension as integers [row, part, position]."""
        n, dim = values.shape
        w = self.width(dim)
        whole = integers(values, self.scale)
        if w * self.parts > dim:
            whole = np.concatenate([whole, np.zeros((n, w * self.parts - dim), whole.dtype)], axis=1)
        return whole.reshape(n, self.parts, w)

    def part(self, dim: int, p: int) -> np.ndarray:
        return self.books[dim][:, p]

    def digest(self, dim: int) -> str:
        """SHA-256 of all entries' components by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.books[dim].transpose(1, 0, 2).ravel()).encode()).hexdigest()

    def decode(self, dim: int, code: str) -> list[float]:
        """The components that a code stands for."""
        at = [int(code[i : i + 2], 16) for i in range(0, len(code), 2)]
        return [int(v) / self.scale for p, e in enumerate(at) for v in self.books[dim][e, p]][:dim]


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, values) of a batch's vectors, in small parts of one dimension."""
    lengths = b["embedding"].value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == dim)
        step = max(1, (1 << 18) // max(1, dim))
        for k in range(0, len(places), step):
            some = places[k : k + step]
            flat = b["embedding"].take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
            yield dim, some, flat.astype(np.float64).reshape(len(some), dim)


def _matrix(b: pa.RecordBatch, name: str, parts: int) -> np.ndarray:
    return b[name].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts).copy()


def _kept(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # a NaN is above infinity
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label")).filter(F.col("embedding").isNotNull() & finite)


def _first_entries(kept: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """The vectors of the smallest ids of each dimension; ids are ranked without their vectors."""
    ids = kept.select(F.size("embedding").alias("dim"), "vec_id").distinct()
    least = ids.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id")))).filter(F.col("rank") <= entries)
    found = kept.join(least.withColumnRenamed("vec_id", "i"), (F.size("embedding") == F.col("dim")) & F.col("vec_id").eqNullSafe(F.col("i")))
    first = found.groupBy("dim", "rank").agg(F.min("embedding").alias("embedding")).orderBy("dim", "rank")
    sizes = least.groupBy("dim").count().agg(F.sum(F.col("dim") * F.col("count"))).first()[0] or 0
    if sizes > MOST_COMPONENTS:
        raise ValueError(f"codebooks of {sizes} numbers in all dimensions; at most {MOST_COMPONENTS} are held by the driver")
    rows: dict[int, list] = {}
    for r in first.collect():
        rows.setdefault(r["dim"], []).append(r["embedding"])
    books = Codebooks({}, parts, scale)
    for dim, vectors in rows.items():
        books.books[dim] = books.padded(np.array(vectors, np.float64).reshape(len(vectors), dim))
    return books


def _bounded(state: DataFrame, books: Codebooks, moved: dict[int, list[Moves]]) -> DataFrame:
    """Every part with its nearest entry and bounds; ``scans``: how many parts of the row were scanned."""
    label = state.schema["label"].dataType.simpleString()
    kind = state.schema["embedding"].dataType.simpleString()
    parts = books.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, upper, lower = _matrix(b, "code", parts).astype(np.int64), _matrix(b, "upper", parts), _matrix(b, "lower", parts)
            scans = np.zeros(b.num_rows, np.int32)
            for dim, places, values in _rows(b):
                x = books.padded(values)
                for p in range(parts):
                    c, u, lo = code[places, p], upper[places, p], lower[places, p]
                    scans[places[reassign(x[:, p], books.part(dim, p), c, u, lo, moved[dim][p])]] += 1
                    code[places, p], upper[places, p], lower[places, p] = c, u, lo
            lists = lambda m, t: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * parts), pa.array(m.ravel(), t))
            columns = [b["vec_id"], b["label"], b["embedding"], lists(code.astype(np.int16), pa.int16()), lists(upper, pa.float64()), lists(lower, pa.float64()), pa.array(scans)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "embedding", "code", "upper", "lower", "scans"])

    return state.select("vec_id", "label", "embedding", "code", "upper", "lower").mapInArrow(run, f"vec_id long, label {label}, embedding {kind}, code array<smallint>, upper array<double>, lower array<double>, scans int")


def _moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at the floored means of their parts; unused ones stay. A task sends a sum an entry and position, in digits."""
    parts = books.parts
    schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            code = _matrix(b, "code", parts)
            for dim, places, values in _rows(b):
                x = books.padded(values)
                if x.dtype != object and largest(x) * len(places) >= 2**62:
                    x = x.astype(object)
                k, w = len(books.books[dim]), books.width(dim)
                if dim not in sums:
                    sums[dim] = np.zeros((parts, k, w + 1), object)  # the last one counts
                for p in range(parts):
                    own = code[places, p]
                    for e in np.unique(own).tolist():
                        chosen = x[own == e, p]
                        sums[dim][p, e, :w] += chosen.sum(axis=0).astype(object)
                        sums[dim][p, e, w] += len(chosen)
        out = []
        for dim, found in sums.items():
            for (p, e, i), v in np.ndenumerate(found):
                v, digit = int(v), 0
                while v:
                    low = v if abs(v) < 1 << DIGIT_BITS else v & ((1 << DIGIT_BITS) - 1)
                    out.append((dim, p, e, i, digit, low))
                    v, digit = (v - low) >> DIGIT_BITS, digit + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    found = state.select("embedding", "code").mapInArrow(run, "dim int, part int, entry int, position int, digit int, value long")
    totals = {d: np.zeros((parts, len(v), books.width(d) + 1), object) for d, v in books.books.items()}
    for r in found.groupBy("dim", "part", "entry", "position", "digit").agg(F.sum("value").alias("value")).collect():  # as many rows as the codebooks have numbers
        totals[r["dim"]][r["part"], r["entry"], r["position"]] += r["value"] << (DIGIT_BITS * r["digit"])
    new = {}
    for d, was in books.books.items():
        now = was.astype(object)
        for p in range(parts):
            for e in range(len(was)):
                if n := totals[d][p, e, -1]:
                    now[e, p] = [int(s) // int(n) for s in totals[d][p, e, :-1]]
        new[d] = now.astype(np.int64) if largest(now) < 2**62 else now
    return Codebooks(new, parts, books.scale)


@dataclass
class Compressed:
    """``rows``: vec_id, label, dim, code, error; ``scanned``: the parts that each round scanned."""

    rows: DataFrame
    codebooks: Codebooks
    scanned: list[int]


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Compressed:
    """Codes of all vectors after ``rounds`` rounds and a last assignment."""
    spark = vectors.sparkSession
    text_batches(spark)
    kept = _kept(vectors)
    books = _first_entries(kept, parts, entries, scale)
    fill = lambda x, kind: F.array_repeat(F.lit(x).cast(kind), parts)
    state = kept.select("vec_id", "label", "embedding", fill(0, "smallint").alias("code"), fill(float("inf"), "double").alias("upper"), fill(0.0, "double").alias("lower"))
    before, scanned, path = books, [], None
    for r in range(rounds + 1):
        moved = {d: [moves(before.part(d, p), books.part(d, p)) for p in range(parts)] for d in books.books}
        state, new_path = written(_bounded(state, books, moved))
        if path:
            removed(spark, path)
        path, before = new_path, books
        scanned.append(state.agg(F.sum("scans")).first()[0] or 0)
        if r < rounds:
            books = _moved(state, books)
    return Compressed(materialize(_coded(state, books)), books, scanned)


def _coded(state: DataFrame, books: Codebooks) -> DataFrame:
    label = state.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _matrix(b, "code", books.parts).astype(np.int64)
            error, dims = np.zeros(b.num_rows, object), b["embedding"].value_lengths()
            for dim, places, values in _rows(b):
                x = books.padded(values)
                for p in range(books.parts):
                    error[places] += squares(x[:, p], books.part(dim, p)[code[places, p]]).astype(object)
            errors = pa.array([int(e) if e < 2**63 else None for e in error], pa.int64())
            codes = pa.array(["".join(f"{e:02x}" for e in row) for row in code.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], dims, codes, errors], names=["vec_id", "label", "dim", "code", "error"])

    return state.select("vec_id", "label", "embedding", "code").mapInArrow(run, f"vec_id long, label {label}, dim int, code string, error long")


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (of all rows with the label) and the digest of the row's codebooks."""
    done = compress(vectors)
    whole = F.when(F.count("error") == F.count("*"), F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)"))
    sums = done.rows.groupBy(F.col("label").alias("own")).agg(whole.alias("label_error"))
    digest = F.lit(None).cast("string")
    for dim in done.codebooks.books:
        digest = F.when(F.col("dim") == dim, done.codebooks.digest(dim)).otherwise(digest)
    met = done.rows.join(sums, F.col("label").eqNullSafe(F.col("own")), "left")
    return met.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
