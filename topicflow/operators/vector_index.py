"""Nearest vectors by an index: inverted lists around centroids, exact dot products inside the lists probed.

Every vector is in the list of its nearest centroid. A search reads, for each query, the lists of its ``probes``
nearest centroids, so it costs that share of all pairs; :func:`recall` measures what it misses
against :func:`similarity.pairs_above`, which stays the exact way. Centroids are fitted to a sample of at most
``SAMPLE_ROWS`` vectors (those with the least hashes of their ids); every row is indexed. There are about a quarter of the
root of the rows lists, ``MOST_LISTS`` at most, and a list of any size is dealt to slots of a few
thousand rows, so that a crowded list is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import top_n
from .lineage import cut
from .similarity import BLOCKS, MOST_ROWS, Side, found_pairs, pairs_above

SAMPLE_ROWS = 1 << 16
MOST_LISTS = SAMPLE_ROWS // 4


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros and what is not finite become zeros."""
    v = np.where(np.isfinite(v), v, 0.0)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["vector"].tolist(), np.float64)


def fit(vectors: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = 6) -> np.ndarray:
    """Centroids (unit rows): spherical means of a bounded sample, from its first vectors on."""
    if lists is None:
        lists = min(MOST_LISTS, sample_rows // 4, max(1, round(vectors.count() ** 0.5 / 4)))
    sample = vectors.select("vector").orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    if not sample:
        return np.zeros((0, 0))
    rows = _unit(np.array([r["vector"] for r in sample], np.float64))
    centroids = rows[:lists].copy()
    for _ in range(rounds):
        near = np.concatenate([(rows[k : k + 4096] @ centroids.T).argmax(axis=1) for k in range(0, len(rows), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        used = np.bincount(near, minlength=len(centroids)) > 0
        centroids[used] = _unit(sums[used])
    return centroids


def _listed(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, vector, list): each vector once for each of its ``probes`` nearest centroids."""
    probes = min(probes, len(centroids))
    kind = vectors.schema["vector"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), 1024):
                some = part.iloc[k : k + 1024]
                score = _unit(_matrix(some)) @ centroids.T
                best = np.argpartition(-score, probes - 1, axis=1)[:, :probes] if probes < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(some), 1))
                yield pd.DataFrame({"id": np.repeat(some["id"].to_numpy(), probes), "vector": some["vector"].repeat(probes).to_numpy(), "list": best.ravel().astype(np.int32)})

    return vectors.select("id", "vector").mapInPandas(run, f"id long, vector {kind}, list int")


def _slots(listed: DataFrame, rows: int, name: str) -> DataFrame:
    """(list, slots): how many slots of about ``rows`` each list has; as many rows as lists at most."""
    return listed.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))


@dataclass
class Index:
    """``rows``: id, vector, list, slot; ``slots``: list, row_slots."""

    centroids: np.ndarray
    rows: DataFrame
    slots: DataFrame
    rows_per_slot: int


def build(vectors: DataFrame, centroids: np.ndarray | None = None, rows_per_slot: int = 4096) -> Index:
    """The index of ``vectors`` (id, vector); written to the shared folder. Null vectors are in no list."""
    clean = vectors.filter("id is not null and vector is not null")
    centroids = fit(clean) if centroids is None else centroids
    if not len(centroids):
        none = vectors.sparkSession.createDataFrame([], f"id long, vector {vectors.schema['vector'].dataType.simpleString()}, list int, slot int")
        return Index(centroids, none, _slots(none, rows_per_slot, "row_slots"), rows_per_slot)
    listed = cut(_listed(clean, centroids, 1))
    slots = cut(_slots(listed, rows_per_slot, "row_slots"))
    dealt = listed.join(F.broadcast(slots), "list")  # at most MOST_LISTS rows
    return Index(centroids, dealt.select("id", "vector", "list", F.pmod(F.xxhash64("id"), F.col("row_slots")).cast("int").alias("slot")), slots, rows_per_slot)


def search(index: Index, queries: DataFrame, k: int, least: float = -np.inf, probes: int = 8, earlier: bool = True) -> DataFrame:
    """(id, near, score): of each query's probed lists the best ``k`` rows with a dot product of ``least`` or more.

    ``earlier`` takes rows with ids before the query's only (else all but its own id). Scores are
    rounded to nine places, ties go to the smaller id.
    """
    spark = queries.sparkSession
    if not len(index.centroids):
        return spark.createDataFrame([], "id long, near long, score double")
    asked = cut(queries.filter("id is not null and vector is not null").select("id", "vector"))
    n_rows, n_asked = index.rows.count(), asked.count()
    bins = max(-(-n_rows // MOST_ROWS), min(BLOCKS, -(-n_rows // 512)), 1)
    blocks = max(-(-n_asked // MOST_ROWS), 1)
    first, inside = 0, [[] for _ in range(bins)]  # a list's slots go to bins in turn
    starts = []
    for r in index.slots.orderBy("list").collect():  # a row a list
        starts.append((r["list"], first % bins))
        for b in range(min(bins, r["row_slots"])):
            inside[(first + b) % bins].append(r["list"])
        first += r["row_slots"]
    start = F.broadcast(spark.createDataFrame(starts, "list int, start int"))
    rows = index.rows.join(start, "list").select(F.pmod(F.col("start") + F.col("slot"), F.lit(bins)).alias("bin"), "id", "vector", "list")
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = _probing(asked, index.centroids, probes, inside).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if mine.num_rows and theirs.num_rows:
            mine, theirs = mine.sort_by("id"), theirs.sort_by("id")
            places = inside[mine["bin"][0].as_py()]
            b_ids, b_rows, lists = mine["id"].to_numpy(), _flat(mine["vector"]), mine["list"].to_numpy()
            a_ids, a_rows = theirs["id"].to_numpy(), _flat(theirs["vector"])
            probed = np.unpackbits(np.frombuffer(b"".join(theirs["probed"].to_pylist()), np.uint8).reshape(len(a_ids), -1), axis=1, count=len(places))
            for n, at in enumerate(places):
                own, some = np.flatnonzero(probed[:, n]), np.flatnonzero(lists == at)
                if len(own) and len(some):
                    a, b = Side(a_ids[own], a_rows[own]), Side(b_ids[some], b_rows[some])
                    out += [(a.ids[i], b.ids[j], score) for i, j, score in found_pairs(a, b, least, k, earlier)]
        if not out:
            return FOUND.empty_table()
        ids, near, score = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((near, -score, ids))
        ids, near, score = ids[order], near[order], score[order]
        heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)])
        keep = np.arange(len(ids)) - np.repeat(heads, np.diff(np.r_[heads, len(ids)])) < k
        return pa.table([ids[keep], near[keep], score[keep]], schema=FOUND)

    met = left.groupBy("bin", "block").cogroup(right.groupBy("bin", "block")).applyInArrow(best, "id long, near long, score double")
    return top_n(met, ["id"], [F.desc("score"), F.asc("near")], k)


FOUND = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("score", pa.float64())])


def _flat(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of a matrix; null components become NaN."""
    flat = pa.concat_arrays(vectors.chunks).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _probing(queries: DataFrame, centroids: np.ndarray, probes: int, inside: list[list[int]]) -> DataFrame:
    """(id, vector, bin, probed): each query once for each bin with lists that it probes, and a bit for each of the bin's lists."""
    probes = min(probes, len(centroids))
    kind = queries.schema["vector"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), 1024):
                some = part.iloc[k : k + 1024]
                own = np.zeros((len(some), len(centroids)), bool)
                np.put_along_axis(own, _nearest(_matrix(some), centroids)[:, :probes], True, axis=1)
                for b, lists in enumerate(inside):
                    bits = own[:, lists]
                    keep = np.flatnonzero(bits.any(axis=1))
                    packed = np.packbits(bits[keep], axis=1)
                    yield pd.DataFrame({"id": some["id"].to_numpy()[keep], "vector": some["vector"].to_numpy()[keep], "bin": np.full(len(keep), b, np.int32), "probed": [x.tobytes() for x in packed]})

    return queries.mapInPandas(run, f"id long, vector {kind}, bin int, probed binary")


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids of each vector, nearest first."""
    return np.argsort(-(_unit(vectors) @ centroids.T), axis=1, kind="stable")


def probed_share(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """One row (pairs, share): pairs of query and row that a search computes, and their share of all."""
    sizes = index.rows.groupBy("list").agg(F.count("*").alias("n"))
    asked = _listed(queries, index.centroids, probes).groupBy("list").agg(F.count("*").alias("asks"))
    pairs = asked.join(sizes, "list").agg(F.coalesce(F.sum(F.col("asks") * F.col("n")), F.lit(0)).alias("pairs"))
    whole = queries.agg(F.count("*").alias("q")).join(index.rows.agg(F.count("*").alias("r")))
    return pairs.join(whole).select("pairs", (F.col("pairs") / (F.col("q") * F.col("r"))).alias("share"))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row (pairs, hits, recall): which of the exact pairs (id, near) a search found."""
    hits = exact.join(found.select("id", "near", F.lit(1).alias("hit_")), ["id", "near"], "left")
    return hits.agg(F.count("*").alias("pairs"), F.count("hit_").alias("hits")).withColumn("recall", F.when(F.col("pairs") == 0, 1.0).otherwise(F.col("hits") / F.col("pairs")))


def tuned(index: Index, vectors: DataFrame, k: int, least: float = -np.inf, target: float = 0.95, one_in: int = 50) -> int:
    """Probes (growing by half, or all lists) whose recall over the queries with ids divisible by ``one_in`` reaches ``target``.

    A search finds an exact pair when it probes the list of its row, so one exact pass and the places of
    those lists among the query's give the recall of every number of probes.
    """
    lists = len(index.centroids)
    if lists < 2:
        return 1
    asked = cut(vectors.filter(F.col("id") % one_in == 0))
    exact = exact_for(asked, vectors, k, least).join(index.rows.select(F.col("id").alias("near"), "list"), "near")
    counts = exact.select("id", "list").join(_placed(asked, index.centroids), "id").groupBy(F.element_at("places", F.col("list") + 1).alias("place")).agg(F.count("*").alias("n"))
    found = {r["place"]: r["n"] for r in counts.collect()}  # a row a list
    probes, whole = 1, sum(found.values())
    while probes < lists:
        if sum(n for place, n in found.items() if place < probes) >= target * whole:
            return probes
        probes += max(1, probes // 2)
    return lists


def _placed(queries: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, places): for every list, how many centroids are nearer to the query than its own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), 1024):
                some = part.iloc[k : k + 1024]
                order = _nearest(_matrix(some), centroids)
                places = np.empty(order.shape, np.int32)
                np.put_along_axis(places, order, np.arange(order.shape[1], dtype=np.int32)[None, :], axis=1)
                yield pd.DataFrame({"id": some["id"].to_numpy(), "places": list(places)})

    return queries.filter("id is not null and vector is not null").select("id", "vector").mapInPandas(run, "id long, places array<int>")


def exact_for(queries: DataFrame, vectors: DataFrame, k: int, least: float = -np.inf) -> DataFrame:
    """The exact answers of :func:`search` for a stated set of queries, against all rows in blocks."""
    one = vectors.select("vector").limit(1).first()
    if one is None:
        return queries.sparkSession.createDataFrame([], "id long, near long, score double")
    whole = build(vectors, np.ones((1, len(one["vector"]))) / len(one["vector"]) ** 0.5)  # one list of many slots
    return search(whole, queries, k, least, 1)


__all__ = ["Index", "build", "exact_for", "fit", "pairs_above", "probed_share", "recall", "search", "tuned"]
