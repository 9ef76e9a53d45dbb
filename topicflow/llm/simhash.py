"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are grouped by population count and cut into tiles. Fingerprints within
``radius`` bits differ by at most as much in population count, so only tiles of near counts meet;
inside a pair of tiles, rows sorted by the count of their upper half are compared in blocks
with exclusive-or and bit counts, skipping blocks whose half counts are too far apart. A pair
of tiles gives a spanning forest of its links, never the links themselves: a group of n near
copies costs n rows.

Defined results: null text counts as empty (fingerprint zero, linked like any other); texts of
fewer words than a shingle are one shingle; a null doc_id gets a fingerprint and, if all its
fingerprint's rows are null, a null component; repeated rows give a row each; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, slices, text_batches, text_or_empty
from .components import components


def fingerprint(text: bytes, size: int, seed: int) -> int:
    """64 bits, each set if it is set in over half the shingles' XXH64."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return h(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.fromiter([h(line[s:e], seed) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): whole texts, A-Z lower-cased, fp as a signed long."""
    text_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [fingerprint(t.as_py().encode("utf-8", "surrogatepass"), size, seed) for t in b["text"]]
            yield batch(schema, [b["doc_id"], pa.array(np.array(fps, np.uint64).view(np.int64))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a (b is None) or between a and b: two arrays of fingerprints."""
    half = lambda x: np.bitwise_count(x >> np.uint64(32)).astype(np.int16)
    a = a[np.argsort(half(a), kind="stable")]
    other = a if b is None else b[np.argsort(half(b), kind="stable")]
    ha, ho = half(a), half(other)
    la, lo = np.bitwise_count(a).astype(np.int16) - ha, np.bitwise_count(other).astype(np.int16) - ho
    both = a if b is None else np.concatenate([a, other])
    shift, label = (0 if b is None else len(a)), np.arange(len(both))
    span = lambda x, k: (int(x[k : k + block].min()), int(x[k : k + block].max()))
    sa = [(span(ha, k), span(la, k)) for k in range(0, len(a), block)]
    so = [(span(ho, k), span(lo, k)) for k in range(0, len(other), block)]
    gap = lambda x, y: max(0, x[0] - y[1], y[0] - x[1])
    for i, (hi, li) in enumerate(sa):
        for j, (hj, lj) in enumerate(so):
            if (b is None and j < i) or gap(hi, hj) + gap(li, lj) > radius:
                continue
            x, y = a[i * block : (i + 1) * block], other[j * block : (j + 1) * block]
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            p, q = p + i * block, q + j * block + shift
            while len(p):
                lp, lq = label[p], label[q]
                open_ = lp != lq
                if not open_.any():
                    break
                p, q, lp, lq = p[open_], q[open_], lp[open_], lq[open_]
                low = np.minimum(lp, lq)
                np.minimum.at(label, np.maximum(lp, lq), low)  # hang the higher root below the lower
                while True:  # every node points to its root again
                    up = label[label]
                    if np.array_equal(up, label):
                        break
                    label = up
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def tile_pairs(rows: DataFrame, klass: Column, reach: int, key: str, tile_rows: int | Callable[[int], int]) -> DataFrame | None:
    """Every pair of tiles once whose classes differ by ``reach`` at most: same, items, others (lists of rows).

    A tile holds about ``tile_rows`` rows (a number, or one by class) of one class; there are few classes.
    """
    classed = rows.select(klass.cast("int").alias("p"), F.struct(*rows.columns).alias("item"))
    counts = classed.groupBy("p").count().collect()  # a row per class
    most = tile_rows if callable(tile_rows) else lambda p: tile_rows
    tiles_of = {r["p"]: -(-r["count"] // most(r["p"])) for r in counts}
    if not tiles_of:
        return None
    n = F.create_map(*[F.lit(x) for kv in tiles_of.items() for x in kv])
    cells = classed.select("p", F.pmod(F.xxhash64(F.col("item")[key]), n[F.col("p")]).cast("int").alias("slot"), "item")
    tiles = materialize(cells.groupBy("p", "slot").agg(F.collect_list("item").alias("items")))
    # the lower tile goes to those of its own and the next classes
    ahead = F.filter(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(m).alias("m")) for q, m in sorted(tiles_of.items())]), lambda x: (x["q"] >= F.col("p")) & (x["q"] <= F.col("p") + reach))
    sent = tiles.select("p", "slot", "items", F.explode(ahead).alias("t")).select("p", "slot", "items", F.col("t.q").alias("q"), F.explode(F.sequence(F.lit(0), F.col("t.m") - 1)).alias("to"))
    sent = sent.filter((F.col("q") > F.col("p")) | (F.col("to") >= F.col("slot")))
    there = tiles.select(F.col("p").alias("q"), F.col("slot").alias("to"), F.col("items").alias("others"))
    # dealt by the pair, not by the tile, so that crowded classes do not meet in one task
    pairs = sent.join(there, ["q", "to"]).repartition(F.xxhash64("p", "slot", "q", "to"))
    return pairs.select(((F.col("p") == F.col("q")) & (F.col("slot") == F.col("to"))).alias("same"), "items", "others")


def links(distinct: DataFrame, radius: int = 3, tile_rows: int = 32768) -> DataFrame:
    """(a, b) edges between the fingerprints of ``distinct`` (fp) that connect all within ``radius``."""
    pairs = tile_pairs(distinct.select("fp"), F.bit_count("fp"), radius, "fp", tile_rows)
    if pairs is None:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for k, own in enumerate(rb["same"].to_pylist()):
                left, right = (rb[c][k].values.field("fp").to_numpy(zero_copy_only=False).view(np.uint64) for c in ("items", "others"))
                a, b = forest(left, None if own else right, radius)
                if len(a):
                    yield batch(schema, [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, radius: int = 3, tile_rows: int = 32768) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    fps = materialize(fingerprints(docs, size, seed))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(distinct.select("fp"), radius, tile_rows))
    rooted = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp", "left").select("doc_id", hexed.alias("fingerprint"), "component_id")
