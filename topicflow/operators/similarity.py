"""Nearest vectors by blocked dot products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import top_n

#: Blocks are at least so many where they keep some rows each, and have at most so many rows.
BLOCKS, MOST_ROWS = 24, 32768
#: A block meets so many others in a task, so many of its rows and of theirs at a time (scores stay in a core's cache); best scores are kept for so many parts of the others.
WIDE, ROWS, COLUMNS, PARTS = 4, 256, 4096, 128


def blocked(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row a block: ids in order and their vectors end to end, as bytes that are copied whole from then on, and their kinds if they have any."""
    kind = dict(vectors.dtypes).get("kind")
    cell = "float" if dict(vectors.dtypes)["vector"] == "array<float>" else "double"
    id_, vector = F.col("id").cast("long").alias("id"), F.col("vector").cast(f"array<{cell}>").alias("vector")
    rows = vectors.filter("id is not null and vector is not null").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), id_, vector, *["kind"] * (kind is not None))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        cells = pa.concat_arrays(table["vector"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        more = {"kinds": pa.array([table["kind"].take(order).to_pylist()], pa.list_(table.schema.field("kind").type))} if kind else {}
        yield pa.RecordBatch.from_pydict({"block": table["block"][:1].combine_chunks(), "ids": pa.array([ids[order].tobytes()], pa.binary()), "flat": pa.array([cells.tobytes()], pa.binary()), **more})

    return rows.groupBy("block").applyInArrow(pack, "block int, ids binary, flat binary" + f", kinds array<{kind}>" * (kind is not None))


class Side:
    """Vectors of a block as rows of a matrix, by rising id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray | None = None):
        self.ids, self.rows, self.codes = ids, rows, codes
        with np.errstate(over="ignore", invalid="ignore"):
            self.size = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
        self.plain = bool((self.size < 1e15).all())  # neither infinite nor beyond what a short float holds


def near_misses(a: Side, b: Side, least: float, k: int | None = None, earlier: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score, error) of rows of ``a`` and earlier (else all other) ones of ``b``, some hundred rows at a time: all whose exact score may reach ``least`` and be of the best ``k``.

    Scores are computed in short floats where those hold them; ``error`` bounds how far they are off.
    """
    plain = a.plain and b.plain
    kind = np.float32 if plain else np.float64
    left, right = a.rows.astype(kind, copy=False), b.rows.astype(kind, copy=False)
    greatest = b.size[np.isfinite(b.size)].max(initial=0.0)
    error = (a.rows.shape[1] + 8) * (2.0**-24 if plain else 2.0**-53) * np.where(np.isfinite(a.size), a.size, 0.0) * greatest + 2e-9
    floor = np.finfo(kind).min
    for at in range(0, len(a.ids), ROWS):
        own, off = a.ids[at : at + ROWS], error[at : at + ROWS]
        upto = np.searchsorted(b.ids, own) if earlier else np.full(len(own), len(b.ids))
        first, width = int(upto[0]), int(upto[-1])
        parts = max(k, min(PARTS, width // 16)) if k is not None and width >= 2 * k else 0
        limit = np.maximum(_below(least - off, kind), floor)
        best = np.full((len(own), parts), -np.inf, kind)
        hits = []
        chunk = parts * max(1, COLUMNS // parts) if parts else COLUMNS
        for start in range(0, width, chunk):
            stop = min(width, start + chunk)
            with np.errstate(over="ignore", invalid="ignore"):
                score = left[at : at + ROWS] @ right[start:stop].T
            if not plain:
                score[np.isnan(score)] = -np.inf
            if first < stop:
                late = max(first, start)
                score[:, late - start :][np.arange(late, stop) >= upto[:, None]] = -np.inf
            if not earlier:
                score[own[:, None] == b.ids[start:stop]] = -np.inf
            if not parts:
                i, j = np.divmod(np.flatnonzero(score >= limit[:, None]), stop - start)
                yield i + at, j + start, score[i, j], off[i]
                continue
            whole = (stop - start) - (stop - start) % parts  # the k best of the parts' best scores have k rows that reach the least of them
            dealt = score[:, :whole].reshape(len(own), -1, parts)  # columns dealt to parts in turn
            top = dealt.max(axis=1, initial=-np.inf)
            rise = np.flatnonzero((top >= limit[:, None]).any(axis=1))
            best[rise] = np.maximum(best[rise], top[rise])
            reached = np.partition(best[rise], parts - k, axis=1)[:, parts - k] - 2 * off[rise]
            limit[rise] = np.maximum(limit[rise], _below(reached, kind))
            row, part = np.nonzero(top[rise] >= limit[rise, None])
            row = rise[row]
            hit, turn = np.nonzero(dealt[row, :, part] >= limit[row, None])
            more, rest = np.nonzero(score[:, whole:] >= limit[:, None])
            i, j = np.r_[row[hit], more], np.r_[turn * parts + part[hit], rest + whole]
            hits.append((i, j + start, score[i, j]))
        if hits:
            i, j, score = (np.concatenate(x) for x in zip(*hits))
            last = score >= limit[i]
            yield i[last] + at, j[last], score[last], off[i[last]]


def _below(limit: np.ndarray, kind: type) -> np.ndarray:
    return np.nextafter(limit.astype(kind), kind(-np.inf))


def exact_scores(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of stated pairs in doubles, rounded to nine places."""
    out = np.empty(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for n in range(0, len(i), 65536):
            rows, columns = a.rows[i[n : n + 65536]].astype(np.float64), b.rows[j[n : n + 65536]].astype(np.float64)
            out[n : n + 65536] = np.einsum("ij,ij->i", rows, columns)
        return np.round(out, 9)


def found_pairs(a: Side, b: Side, least: float, k: int | None = None, earlier: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of the pairs that reach ``least``, exactly; at most ``k`` of a row of ``a``, ties to the smaller id."""
    for i, j, _, _ in near_misses(a, b, least, k, earlier):
        score = exact_scores(a, b, i, j)
        keep = (score >= least) & (score > -np.inf)
        i, j, score = i[keep], j[keep], score[keep]
        if k is not None and len(i):
            order = np.lexsort((b.ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            keep = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)])) < k
            i, j, score = i[keep], j[keep], score[keep]
        yield i, j, score


def _by_strips(vectors: DataFrame, run: Callable[[Side, Side, list], Iterator[dict]], schema: str, rows_per_block: int | None) -> DataFrame:
    """``run`` over every block and every ``WIDE`` blocks, rows of the first against earlier ones of the others; its columns as a table.

    A strip is a group of a block and ``WIDE`` others, so a task holds no more than those; every vector is sent to as many strips as there are blocks and sets of others.
    """
    n = vectors.count()
    blocks = max(1, -(-n // rows_per_block) if rows_per_block else max(-(-n // MOST_ROWS), min(BLOCKS, -(-n // 1024))))
    sets = -(-blocks // WIDE)
    packed = blocked(vectors, blocks)
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    place = lambda block, set_, asks: F.struct((block * sets + set_).alias("strip"), F.lit(asks).alias("asks"))
    places = F.concat(F.transform(upto(sets), lambda s: place(F.col("block"), s, True)), F.transform(upto(blocks), lambda b: place(b, F.col("block") % sets, False)))
    strips = packed.withColumn("place", F.explode(places)).select("place.*", *packed.columns)
    cell = np.float32 if dict(vectors.dtypes)["vector"] == "array<float>" else np.float64

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asks = table["asks"].to_numpy()
        if asks.all() or not asks.any():
            return  # no rows, or none to meet
        names, codes = [], None
        if "kinds" in table.column_names:
            kinds = pa.concat_arrays([c.values.slice(c.offsets[0].as_py(), c.offsets[-1].as_py() - c.offsets[0].as_py()) for c in table["kinds"].chunks])
            coded = kinds.dictionary_encode(null_encoding="encode")
            codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        ids = [np.frombuffer(x.as_buffer(), np.int64) for x in table["ids"]]
        rows = [np.frombuffer(x.as_buffer(), cell).reshape(len(i), -1) for i, x in zip(ids, table["flat"])]
        block = np.repeat(np.arange(len(ids)), [len(i) for i in ids])

        def side(which: np.ndarray) -> Side:
            own = np.concatenate([ids[k] for k in which])
            order = np.argsort(own, kind="stable")
            kind = codes[np.isin(block, which)][order] if names else None
            return Side(own[order], np.concatenate([rows[k] for k in which])[order], kind)

        for columns in run(side(np.flatnonzero(asks)), side(np.flatnonzero(~asks)), names):
            yield pa.RecordBatch.from_pydict(columns)

    # four partitions a strip: most are a task alone, and short tasks even out what their hashes bring together
    return strips.repartition(4 * blocks * sets, "strip").groupBy("strip").applyInArrow(strip, schema)


def pairs_above(vectors: DataFrame, least: float, k: int | None = None, rows_per_block: int | None = None) -> DataFrame:
    """(id, near, score): earlier ids with a dot product of ``least`` or more, the best ``k`` of each id; with a column ``kind`` also ``same``, whether both have one kind.

    A block meets several others in a task, a few hundred rows against some thousand at a time; a pair is
    computed in one direction only, in short floats first, and exactly where that may decide.
    Only rows that pass leave a task, at most ``k`` of an id if given.
    """
    kinds = "kind" in vectors.columns

    def run(a: Side, b: Side, names: list) -> Iterator[dict]:
        known = np.array([x is not None for x in names])
        for i, j, score in found_pairs(a, b, least, k):
            more = {"same": (a.codes[i] == b.codes[j]) & known[a.codes[i]]} if kinds else {}
            yield {"id": pa.array(a.ids[i], pa.int64()), "near": pa.array(b.ids[j], pa.int64()), "score": pa.array(score, pa.float64()), **more}

    found = _by_strips(vectors, run, "id long, near long, score double" + ", same boolean" * kinds, rows_per_block)
    return found if k is None else top_n(found, ["id"], [F.desc("score"), F.asc("near")], k)


def pair_counts(vectors: DataFrame, limits: list[float], rows_per_block: int | None = None) -> DataFrame:
    """(kind, near_kind, score, n): how many pairs of an id and an earlier one have these kinds and a dot product from the limit ``score`` up to the next one.

    Pairs are counted where blocks meet, so no row is made for a pair; those below the first limit are not counted.
    """
    limits = sorted(limits)
    kind = dict(vectors.dtypes)["kind"]

    def run(a: Side, b: Side, names: list) -> Iterator[dict]:
        m, edges = len(names), np.array(limits)
        total = np.zeros((len(limits) + 1) * m * m, np.int64)
        for i, j, score, off in near_misses(a, b, limits[0]):
            zone = np.searchsorted(edges, score, side="right")
            doubt = np.zeros(len(i), bool)
            for e in limits:
                doubt |= ~(np.abs(score - e) > off)
            zone[doubt] = np.searchsorted(edges, exact_scores(a, b, i[doubt], j[doubt]), side="right")
            total += np.bincount((zone * m + a.codes[i]) * m + b.codes[j], minlength=len(total))
        total[: m * m] = 0
        at = np.flatnonzero(total)
        column = lambda codes: pa.array([names[c] for c in codes], target)
        yield {"kind": column(at // m % m), "near_kind": column(at % m), "score": pa.array(edges[at // m // m - 1], pa.float64()), "n": pa.array(total[at], pa.int64())}

    target = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    counted = _by_strips(vectors, run, f"kind {kind}, near_kind {kind}, score double, n long", rows_per_block)
    return counted.groupBy("kind", "near_kind", "score").agg(F.sum("n").alias("n"))


def grey_zone(score: Column, low: float, high: float) -> Column:
    """Both tails are decided by the score; the middle goes to an oracle."""
    return F.when(score >= high, "match").when(score >= low, "ask").otherwise("no")


def rerank(scored: DataFrame, k: int, least: float) -> DataFrame:
    """The best ``k`` of each query, and of those the ones that reach ``least``."""
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).filter(F.col("score") >= least)
