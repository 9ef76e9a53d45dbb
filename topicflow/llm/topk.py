"""Exact top-k inner products by a bit-sliced index.

A block of rows is stored as bit slices: for each attribute and bit a bitmap over the rows. A
query adds the slices of its attributes, shifted by the bits of its own components, with
carry-save bitmap arithmetic; negative components add the complemented slices. The sums' slices
are then read from the most significant downward to find the rows surely among the best and the
rows tied at the boundary, which are resolved by id and scored exactly.

Queries and rows meet in blocks: (query block, row block) pairs are joined by key, each pair is
one task's work and gives at most k rows a query.

A block has as many slices as its own values need. Vectors with a component of 2**30 or more after scaling are in
small blocks of their own, as the numbers they came as; their slices, of as many bits as there are, come from Python's
integers, so every finite vector takes part.

Defined results: vectors that are null or hold null or non-finite components take no part, as
queries or as rows, nor does a null vec_id; a pair whose score no long holds is no result, and the
query's next best row takes its place; vectors meet those of their own dimension
(of an empty one, all scores are 0); rows that carry the query's id are its own and no
candidates, repeated rows ask once, and different vectors under one id are asked and ranked
apart; fewer than k candidates give all of them; ties go to the smaller id; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, integers, materialize


def bit_slices(values: np.ndarray, bits: int) -> np.ndarray:
    """uint64 bitmaps [complemented?, attribute, bit, word] of values 0..2**bits-1 in [row, attribute]."""
    n, d = values.shape
    if bits > 32:
        one = np.zeros((d, bits, -(-n // 64) * 64), bool)
        for b in range(bits):
            one[:, b, :n] = ((values >> b) & 1).T.astype(bool)
        maps = np.packbits(one, axis=2, bitorder="little").view(np.uint64)
        return np.stack([maps, ~maps])
    kind = np.dtype("u1" if bits <= 8 else "<u4")
    padded = np.zeros((-(-n // 64) * 64, d), kind)
    padded[:n] = values
    octets = np.ascontiguousarray(padded.T).view(np.uint8).reshape(d, len(padded), kind.itemsize)
    each = np.unpackbits(octets, axis=2, bitorder="little")[:, :, :bits]
    maps = np.packbits(each.transpose(0, 2, 1), axis=2, bitorder="little").view(np.uint64)
    return np.stack([maps, ~maps])


def add_up(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Bit slices of the sum, where columns[j] holds the bitmaps of weight 2**j: carry-save adders."""
    out, j = [], 0
    columns = [c for c in columns]
    while j < len(columns):
        have, carry = columns[j], []
        while len(have) > 1:
            m = len(have) // 3
            if m:
                x, y, z, rest = have[:m], have[m : 2 * m], have[2 * m : 3 * m], have[3 * m :]
                t = x ^ y
                carry.append((x & y) | (t & z))
                have = np.concatenate([t ^ z, rest])
            else:
                carry.append(have[:1] & have[1:2])
                have = have[:1] ^ have[1:2]
        out.append(have[0] if len(have) else None)
        if carry:
            up = np.concatenate(carry)
            if j + 1 == len(columns):
                columns.append(up)
            else:
                columns[j + 1] = np.concatenate([columns[j + 1], up])
        j += 1
    return out


def best(slices: list[np.ndarray], alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (surely among the best k, tied at the boundary), from the most significant slice down."""
    count = lambda x: int(np.bitwise_count(x).sum())
    sure, tied = np.zeros_like(alive), alive
    have = 0
    for s in reversed(slices):
        if s is None:
            tied_one = np.zeros_like(tied)
        else:
            tied_one = tied & s
        n = count(tied_one)
        if have + n > k:
            tied = tied_one
        else:
            sure, tied, have = sure | tied_one, tied & ~tied_one, have + n
            if have == k:
                tied = np.zeros_like(tied)
                break
    return sure, tied


def width(values: np.ndarray) -> int:
    """Bits of the largest of some numbers from 0 up."""
    return int(values.max(initial=0)).bit_length()


def search_block(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, maps: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows whose scores a long holds; ids ascend in the block. rows: signed values, maps of them from the least one up."""
    size = np.abs(query)
    wide, slices = width(size), maps.shape[2]
    bits = ((size[:, None] >> np.arange(wide).astype(size.dtype)) & 1).astype(bool)
    d, b = np.nonzero(bits)
    neg = (query[d] < 0).astype(np.int64)
    columns = []
    for j in range(wide + slices - 1):
        bit = j - b
        ok = (bit >= 0) & (bit < slices)
        columns.append(maps[neg[ok], d[ok], bit[ok]])
    sums = add_up(columns)
    to_rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    short = rows.dtype != object and query.dtype != object and len(query) * int(size.max(initial=0)) * int(np.abs(rows).max(initial=0)) < 2**62
    while True:
        sure, tied = best(sums, alive, k)
        sure, tied = to_rows(sure), to_rows(tied)
        at = np.concatenate([sure, tied[: k - len(sure)]])  # the boundary: smaller ids first
        if short:
            return ids[at], rows[at] @ query
        scores = rows[at].astype(object) @ query.astype(object) if len(query) else np.zeros(len(at), object)
        held = np.array([-(2**63) <= s < 2**63 for s in scores], bool)
        if held.all():
            return ids[at], scores.astype(np.int64)
        gone = np.zeros(64 * len(alive), bool)
        gone[at[~held]] = True
        alive = alive & ~np.packbits(gone, bitorder="little").view(np.uint64)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, row_block: int = 32768, query_block: int = 4096, far_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each vec_id divisible by ``every``."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # a NaN is above infinity
    near = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) <= 2.0**30 - 1)
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).cast("array<int>")
    quantised = clean.select("vec_id", F.when(near, whole).alias("v"), F.when(~near, F.col("embedding").cast("array<double>")).alias("far"), F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("nth"))
    quantised = materialize(quantised)
    asks = F.col("vec_id") % every == 0
    counts = [F.count("v"), F.count_if(asks & F.col("v").isNotNull()), F.count("far"), F.count_if(asks & F.col("far").isNotNull())]
    n, n_q, n_far, q_far, low, high = quantised.agg(*counts, F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not n_q + q_far:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    low, high = low or 0, high or 0  # null where all vectors are empty
    kind = next(k for k, size in (("tinyint", 7), ("smallint", 15), ("int", 31)) if max(-low, high + 1) <= 1 << size)
    tasks = max(1, 2 * spark.sparkContext.defaultParallelism)
    row_blocks, far_row_blocks = -(-n // row_block), -(-n_far // far_block)
    query_blocks = max(-(-n_q // query_block), min(-(-tasks // max(1, row_blocks)), -(-n_q // 64)))
    far_query_blocks = -(-q_far // far_block)

    def packed(df: DataFrame, blocks: int, far_blocks: int, key: str) -> DataFrame:
        """One row a block of one dimension: ids and values, ascending by id; far vectors in blocks behind the others."""
        block = F.when(F.col("far").isNull(), F.pmod("nth", F.lit(max(1, blocks)))).otherwise(blocks + F.pmod("nth", F.lit(max(1, far_blocks))))
        rows = df.select(block.cast("int").alias(key), "dim", "vec_id", F.col("v").cast(f"array<{kind}>").alias("v"), "far")
        lists = rows.groupBy(key, "dim").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v", "far"))).alias("rows"))
        return lists.select(key, "dim", F.col("rows.vec_id").alias(f"{key}_ids"), F.flatten("rows.v").alias(f"{key}_values"), F.flatten("rows.far").alias(f"{key}_far"))

    rows = packed(quantised, row_blocks, far_row_blocks, "r").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks + far_query_blocks - 1))))
    # queries are numbered anew: nth of a query may share its remainder with others
    asked = quantised.filter(asks).select("vec_id", "dim", "v", "far").distinct().withColumn("nth", F.xxhash64("vec_id", "v", "far"))
    queries = packed(asked, query_blocks, far_query_blocks, "q")
    pairs = rows.join(queries, ["q", "dim"]).repartition((row_blocks + far_row_blocks) * (query_blocks + far_query_blocks), "q", "r")
    schema = pa.schema([("query_id", pa.int64()), ("no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                flat = lambda c: rb[c][i].values.to_numpy(zero_copy_only=False)
                dim = rb["dim"][i].as_py()

                def matrix(key: str, n: int, i: int = i, dim: int = dim, flat=flat) -> np.ndarray:
                    if rb[f"{key}_far"][i].is_valid:
                        return integers(flat(f"{key}_far").reshape(n, dim), scale)
                    return flat(f"{key}_values").astype(np.int64).reshape(n, dim)

                ids, q_ids = flat("r_ids"), flat("q_ids")
                values, q_values = matrix("r", len(ids)), matrix("q", len(q_ids))
                least = int(values.min(initial=0))
                lifted = values.astype(object) - least if values.dtype == object or int(values.max(initial=0)) - least >= 2**62 else values - least
                maps = bit_slices(lifted, max(1, width(lifted)))
                words = maps.shape[3]
                every_row = np.packbits(np.arange(64 * words) < len(ids), bitorder="little").view(np.uint64)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for no, (qid, q) in enumerate(zip(q_ids.tolist(), q_values)):
                    alive = every_row
                    lo, hi = np.searchsorted(ids, qid), np.searchsorted(ids, qid, "right")
                    if hi > lo:
                        nth = np.arange(64 * words)
                        alive = np.packbits((nth < len(ids)) & ~((nth >= lo) & (nth < hi)), bitorder="little").view(np.uint64)
                    got, scores = search_block(q, ids, values, maps, alive, k)
                    out.append((np.full(len(got), qid), np.full(len(got), (rb["q"][i].as_py() << 32) + no), got, scores))
                yield batch(schema, [pa.array(np.concatenate(c)) for c in zip(*out)])

    found = pairs.mapInArrow(run, "query_id long, no long, vec_id long, score long")
    order = Window.partitionBy("query_id", "no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
