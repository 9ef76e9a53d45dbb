"""Near copies: SimHash with tiled exact comparison proposes, exact shingle similarity decides.

Two contents are linked if the sets of their shingles of five words have Jaccard similarity 4/5
or more. A content (its sequence of words, by a 64-bit hash) has a fingerprint of 256 bits over
its set. At similarity 4/5 the angle of two sets is at most acos(8/9), so a bit differs with
probability 0.152, 39 of 256 bits on average with a deviation of 5.7: the radius of 62 lies four
deviations further on (recall 0.9999), that of sets under 32 shingles, whose bits are less even, at
80. Unrelated contents differ in 128 bits, eight deviations of 8, so next to none is proposed.

Fingerprints meet in tiles, whose classes are sizes of sets: sets of that similarity differ by a
fourth in size at most. A tile goes once to a strip of ``WIDE`` others that it meets and once to the
strip of each that meets it, and tiles grow with the table, so a row is sent about as often at any
size (until ``MOST_ROWS`` a tile). Within a pair of tiles rows are sorted by size, blocks are skipped whose sizes
are over a fourth apart, and the rest is compared by exclusive-or and bit counts; a strip gives a
spanning forest of its proposals. Proposals never leave their connected group, so the sets of a group are
brought together and every proposal between parts of it that are still apart is decided there,
nearest first: by the sets' numbers of shingles in 256 buckets, which bound what they share, then by
the sets. Many groups share a task. A group of more than ``GROUP_ROWS`` rows or ``TILE_BYTES`` of sets
is a crowd: first its forest is verified, so that n copies cost n verifications, and where verified links do
not connect it, its sets go into tiles with the fingerprints. A pair of tiles gives the links that
connect parts, never a row a proposal.

Defined results: A-Z is lower-cased, words are split at white space; texts of fewer words than a
shingle are one shingle; null, empty and blank texts are copies of each other; repeated rows are
copies; further columns stay as they are.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, scratch, slices, text_batches, text_or_empty, written
from .components import components
from .decontam import Words, shingles

WORDS = 4  # of 64 bits
SEEDS = np.array([pow(0xD1B54A32D192ED03, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)
RADIUS, SMALL, SMALL_RADIUS = 62, 32, 80
#: A tile meets so many others in a task; tiles of fingerprints have rows from the one to the other number, those of sets so many bytes; a larger group is a crowd.
WIDE, LEAST_ROWS, MOST_ROWS, TILE_BYTES, GROUP_ROWS = 4, 8192, 1 << 18, 1 << 22, 1024


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(shingles(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


def wide_print(own: np.ndarray) -> np.ndarray:
    """256 bits, each set if it is set in over half the set's hashes."""
    each = (own[:, None] ^ SEEDS) * np.uint64(0x9E3779B97F4A7C15)
    each = (each ^ (each >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    each ^= each >> np.uint64(29)
    total = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(own), 255):  # so many ones fit a byte
        total += np.unpackbits(each[k : k + 255].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(own), bitorder="little").view(np.uint64)


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_py().encode("utf-8", "surrogatepass")


def _scanned(docs: DataFrame, size: int) -> DataFrame:
    """(nth, doc_id, node, n, f0..f3): node names the content, n is the size of its set."""
    names = [f"f{k}" for k in range(WORDS)]
    schema = pa.schema([("nth", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), *[(c, pa.int64()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        words = Words()
        for b in slices(batches):
            nodes, sizes, prints = [], [], []
            for t in b["text"]:
                w = words(_bytes(t))
                own = shingle_set(w, size)
                nodes.append(h(w.tobytes()))
                sizes.append(len(own))
                prints.append(wide_print(own))
            yield batch(schema, [b["nth"], b["doc_id"], pa.array(np.array(nodes, np.uint64).view(np.int64)), sizes, *[pa.array(x) for x in np.ascontiguousarray(np.stack(prints).T).view(np.int64)]])

    rows = docs.select("nth", F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(rows.mapInArrow(run, "nth long, doc_id long, node long, n int, " + ", ".join(f"{c} long" for c in names)))


def proposed(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of ``a`` and ``b`` (none: of a, each pair once) within the radius and near in size, and their differing bits, by blocks."""
    own, b = b is None, a if b is None else b
    order = [np.argsort(x["n"], kind="stable") for x in (a, b)]
    sizes = [x["n"][o].astype(np.int64) for x, o in zip((a, b), order)]
    prints = [[x[f"f{k}"][o] for k in range(WORDS)] for x, o in zip((a, b), order)]
    mixed, some, more = np.empty(block * block, np.uint64), np.empty(block * block, np.uint8), np.empty(block * block, np.uint8)
    for i in range(0, len(order[0]), block):
        n = sizes[0][i : i + block]
        first, last = np.searchsorted(5 * sizes[1], 4 * n[0]), np.searchsorted(4 * sizes[1], 5 * n[-1], side="right")
        for j in range(i if own else int(first), int(last), block):
            m = sizes[1][j : j + block]
            shape = len(n), len(m)
            bits, far, one = (x[: len(n) * len(m)].reshape(shape) for x in (mixed, some, more))
            for k in range(WORDS - 1):  # of unrelated prints next to none pass, so few need the last word
                np.bitwise_xor(prints[0][k][i : i + block, None], prints[1][k][None, j : j + block], out=bits)
                np.bitwise_count(bits, out=one if k else far)
                if k:
                    np.add(far, one, out=far)
            p, q = np.divmod(np.flatnonzero(far <= (SMALL_RADIUS if min(n[0], m[0]) < SMALL else RADIUS)), shape[1])
            if own and i == j:
                p, q = p[p < q], q[p < q]
            if not len(p):
                continue
            all_ = far[p, q].astype(np.uint16) + np.bitwise_count(prints[0][-1][i + p] ^ prints[1][-1][j + q])
            least, most = np.minimum(n[p], m[q]), np.maximum(n[p], m[q])
            ok = (5 * least >= 4 * most) & (all_ <= np.where(least < SMALL, SMALL_RADIUS, RADIUS))
            if ok.any():
                yield order[0][i + p[ok]], order[1][j + q[ok]], all_[ok]


def _hang(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the trees of p and q; every node points to its root, the lowest."""
    while True:
        lp, lq = label[p], label[q]
        open_ = lp != lq
        if not open_.any():
            return
        p, q, lp, lq = p[open_], q[open_], lp[open_], lq[open_]
        np.minimum.at(label, np.maximum(lp, lq), np.minimum(lp, lq))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _class(n: str) -> Column:
    """Size classes; sizes a fourth apart are three classes apart at most."""
    return F.floor(F.log(F.col(n).cast("double")) * (2 / math.log(1.25)))


PRINT = ["node", "n", *[f"f{k}" for k in range(WORDS)]]
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tile(row: dict) -> dict:
    """Columns of a packed tile as arrays; its sets lie end to end."""
    got = {c: np.frombuffer(row[c], np.int32 if c == "n" else np.uint64 if c[0] == "f" else np.int64) for c in row if c in (*PRINT, "label")}
    if "s" in row:
        ends = np.cumsum(got["n"], dtype=np.int64)
        got["s"] = np.split(np.frombuffer(row["s"], np.uint64), ends[:-1])
    return got


def _strips(rows: DataFrame, columns: list[str], klass: Column, tile_rows: Callable[[int], int], run: Callable[[dict, list[dict], bool], Iterator[tuple[np.ndarray, np.ndarray]]], reach: int = 3) -> DataFrame:
    """(a, b) that ``run`` finds in ``columns`` of a tile, some others, and whether the tile meets itself there; every pair of tiles once whose classes differ by ``reach`` at most.

    A tile holds about ``tile_rows`` rows of its class. Tiles are numbered by class, so one meets itself and a stretch of those after it.
    """
    spark = rows.sparkSession
    classed = rows.select(klass.cast("long").alias("p"), *columns)
    counts = {r["p"]: r["count"] for r in classed.groupBy("p").count().collect()}  # a row per class
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    tiles = {p: -(-n // tile_rows(p)) for p, n in counts.items()}
    kinds = sorted(tiles)
    first = dict(zip(kinds, np.cumsum([0, *[tiles[p] for p in kinds]]).tolist()))
    lo = {p: first[kinds[bisect.bisect_left(kinds, p - reach)]] for p in kinds}
    hi = {p: first[q] + tiles[q] for p in kinds for q in [kinds[bisect.bisect_right(kinds, p + reach) - 1]]}
    known = spark.createDataFrame([(p, first[p], tiles[p], lo[p], hi[p]) for p in kinds], "p long, first long, tiles long, lo long, hi long")
    dealt = classed.join(F.broadcast(known), "p").select((F.col("first") + F.pmod(F.xxhash64("node"), F.col("tiles"))).alias("tile"), "lo", "hi", *columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        row = {c: [table[c][0].as_py()] for c in ("tile", "lo", "hi")}
        yield pa.RecordBatch.from_pydict(row | {c: pa.array([b"".join(table[c].to_pylist()) if c == "s" else table[c].to_numpy().tobytes()], pa.binary()) for c in columns})

    packed = dealt.groupBy("tile").applyInArrow(pack, "tile long, lo long, hi long, " + ", ".join(f"{c} binary" for c in columns))
    place = lambda strip, part, asks: F.struct(strip.alias("strip"), part.cast("long").alias("part"), F.lit(asks).alias("asks"))
    asks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - 1 - F.col("tile")) / WIDE)), lambda w: place(F.col("tile"), w, True))
    met = F.transform(F.when(F.col("lo") < F.col("tile"), F.sequence(F.col("lo"), F.col("tile") - 1)).otherwise(F.array().cast("array<long>")), lambda t: place(t, F.floor((F.col("tile") - t) / WIDE), False))
    sent = packed.withColumn("place", F.explode(F.concat(asks, met))).select("place.*", *columns)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = [r for b in batches for r in b.to_pylist()]
        own = next(r for r in all_ if r["asks"])
        for a, b in run(_tile(own), [_tile(r) for r in all_ if not r["asks"]], own["part"] == 0):
            yield batch(EDGES, [pa.array(a), pa.array(b)])

    # four partitions a strip, up to a number: a strip is seconds of work, whatever its bytes
    strips = sum(-(-(hi[p] - first[p] - k) // WIDE) for p in kinds for k in range(tiles[p]))
    return sent.repartition(min(4 * strips, 4096), "strip", "part").groupBy("strip", "part").applyInArrow(strip, "a long, b long")


def _proposals(contents: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """(a, b): a spanning forest of the pairs within the radius in each strip of tiles."""
    rows = tile_rows or max(LEAST_ROWS, min(MOST_ROWS, -(-contents.count() // 48)))

    def run(a: dict, others: list[dict], own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        both = np.concatenate([a["node"], *[b["node"] for b in others]])
        label, left = np.arange(len(both)), []
        starts = np.cumsum([len(x["node"]) for x in (a, *others)]).tolist()
        for b, shift in [*[(None, 0)] * own, *zip(others, starts)]:
            for p, q, _ in proposed(a, b):
                left.append((p, q + shift))
                if sum(len(x) for x, _ in left) > 1 << 16:
                    _hang(label, *map(np.concatenate, zip(*left)))
                    left = []
        if left:
            _hang(label, *map(np.concatenate, zip(*left)))
        moved = np.flatnonzero(label != np.arange(len(both)))
        if len(moved):
            yield both[moved], both[label[moved]]

    found = _strips(contents, PRINT, _class("n"), lambda p: rows, run)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sketch(own: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of 256 buckets."""
    return np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256).astype(np.uint16)


def connect(a: dict, b: dict | None) -> Iterator[tuple[int, int]]:
    """(node, node) of similarity 4/5 or more that connect all proposed pairs of it between different labels; rows have sets ``s``."""
    other = a if b is None else b
    bounds = [np.stack([sketch(s) for s in x["s"]]) for x in (a, other)]
    names, places = np.unique(np.concatenate([a["label"], other["label"]]), return_inverse=True)
    label = [places[: len(a["label"])], places[len(a["label"]) :]]
    up = np.arange(len(names))

    def root(x: int) -> int:
        while (y := up[x]) != x:
            up[x] = up[y]
            x = y
        return x

    for p, q, bits in proposed(a, b):
        for k in range(0, len(p), 16384):
            while not np.array_equal(above := up[up], up):
                up[:] = above
            x, y, far = p[k : k + 16384], q[k : k + 16384], bits[k : k + 16384]
            apart = up[label[0][x]] != up[label[1][y]]
            order = np.argsort(far[apart], kind="stable")
            x, y = x[apart][order], y[apart][order]
            most = np.minimum(bounds[0][x], bounds[1][y]).sum(1, dtype=np.int64)
            may = 9 * most >= 4 * (a["n"][x].astype(np.int64) + other["n"][y])
            for i, j in zip(x[may].tolist(), y[may].tolist()):
                r, t = root(label[0][i]), root(label[1][j])
                if r != t and similar(a["s"][i], other["s"][j]):
                    up[max(r, t)] = min(r, t)
                    yield int(a["node"][i]), int(other["node"][j])


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(s, t, assume_unique=True)) >= 4 * (len(s) + len(t))


def _connected(rows: DataFrame, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(a, b): verified links that connect the labels of ``rows`` (PRINT, label, s, and their crowd's number) as far as all their proposals do."""

    def run(a: dict, others: list[dict], own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edges = [e for b in [*[None] * own, *others] for e in connect(a, b)]
        if edges:
            yield tuple(np.array(c, np.int64) for c in zip(*edges))

    # a crowd has classes of its own, and a class bounds the size of its sets, so a tile's sets have ``tile_bytes``, about
    size = lambda c: max(8, min(8192, int(tile_bytes / (8 * 1.25 ** ((c % 256 + 1) / 2)))))
    found = _strips(rows, [*PRINT, "label", "s"], F.col("crowd") * 256 + _class("n"), size, run)
    return materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _only(docs: DataFrame, wanted: DataFrame, most: int = 1 << 25) -> DataFrame:
    """The rows of ``docs`` whose nth is in ``wanted``: by bitmaps of ``most`` bytes at most, a bit a row, so that texts stay where they are; beyond, by a join."""
    bits = materialize(wanted.groupBy(F.bitmap_bucket_number(F.col("nth") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("nth") + 1)).alias("bits")))
    if bits.count() * 4096 > most:
        return docs.join(wanted, "nth", "left_semi")
    maps = docs.sparkSession.sparkContext.broadcast({r["k"]: bytes(r["bits"]) for r in bits.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nth = b.column(b.schema.get_field_index("nth")).to_numpy()
            out, bucket = np.zeros(len(nth), bool), nth // 32768 + 1
            for k in np.unique(bucket):
                if (found := maps.value.get(int(k))) is not None:
                    here = bucket == k
                    at = nth[here] % 32768
                    out[here] = (np.frombuffer(found, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield b.filter(pa.array(out))

    return docs.mapInArrow(run, docs.schema)


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(node, s) of ``rows`` (text), their whole sets; with a column ``group`` also that."""
    more = [c for c in rows.columns if c == "group"]
    schema = pa.schema([("node", pa.int64()), ("s", pa.binary()), *[(c, pa.int64()) for c in more]])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        words = Words()
        for b in slices(batches, 200):
            found = [words(_bytes(t)) for t in b["text"]]
            yield batch(schema, [pa.array(np.array([h(w.tobytes()) for w in found], np.uint64).view(np.int64)), [shingle_set(w, size).tobytes() for w in found], *[b[c] for c in more]])

    return rows.select(text_or_empty().alias("text"), *more).mapInArrow(sets, "node long, s binary" + ", group long" * bool(more))


def _grouped(docs: DataFrame, members: DataFrame, most: int = 1 << 25) -> DataFrame:
    """(text, group) of the rows of ``docs`` that ``members`` (nth, group) names: by ``most`` bytes at most sent to all, so that texts stay where they are; beyond, by a join."""
    if 16 * members.count() > most:
        return docs.select("nth", "text").join(members.select("nth", "group"), "nth").select("text", "group")
    named = members.select("nth", "group").toArrow().sort_by("nth")
    sent = docs.sparkSession.sparkContext.broadcast([named[c].to_numpy() for c in ("nth", "group")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, group = sent.value
        for b in batches:
            nth = b["nth"].to_numpy()
            at = np.minimum(np.searchsorted(known, nth), len(known) - 1)
            here = known[at] == nth
            yield pa.RecordBatch.from_pydict({"text": b["text"].filter(pa.array(here)), "group": pa.array(group[at[here]])})

    return docs.select("nth", text_or_empty().alias("text")).mapInArrow(run, "text string, group long")


def _in_groups(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(a, b): verified links that connect the rows of each group of ``members`` (nth, group, n) as far as all their proposals do; sets are sent once."""
    total = members.agg(F.sum(8 * F.col("n").cast("long"))).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    tasks = max(64, -(-total // TILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("group")
        nodes, groups, edges = table["node"].to_numpy(), table["group"].to_numpy(), []
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        for k, end in zip(starts.tolist(), [*starts[1:].tolist(), len(groups)]):
            sets = [np.frombuffer(s, np.uint64) for s in table["s"][k:end].to_pylist()]
            if len(sets) == 2:
                edges += [tuple(nodes[k:end].tolist())] if similar(*sets) else []
                continue
            prints = np.stack([wide_print(s) for s in sets])
            own = {"node": nodes[k:end], "label": np.arange(end - k), "n": np.array([len(s) for s in sets], np.int32), "s": sets}
            edges += connect(own | {f"f{w}": np.ascontiguousarray(prints[:, w]) for w in range(WORDS)}, None)
        if edges:
            yield batch(EDGES, [list(c) for c in zip(*edges)])

    rows = _sets(_grouped(docs, members), size).withColumn("task", F.pmod(F.xxhash64("group"), F.lit(tasks)))
    found = rows.groupBy("task").applyInArrow(run, "a long, b long")
    return materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _alike(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 4/5 or more, by their whole sets (node, s)."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            x, y = ([np.frombuffer(s, np.uint64) for s in b[c].to_pylist()] for c in ("a_s", "b_s"))
            ok = pa.array([similar(s, t) for s, t in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(ok), b["b"].filter(ok)], ["a", "b"])

    left, right = (known.select(F.col("node").alias(c), F.col("s").alias(f"{c}_s")) for c in "ab")
    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "a_s", "b_s").mapInArrow(test, "a long, b long"))


def _in_crowds(docs: DataFrame, members: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """:func:`_in_groups` for groups that no task should hold; ``first`` has their forests."""
    known = materialize(_sets(_only(docs, members.select("nth")), size))
    found = _alike(first.join(members.select(F.col("node").alias("a")), "a", "left_semi"), known)
    # crowds that verified links do not connect
    label = components(found).withColumnRenamed("root", "label")
    named = materialize(members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    mixed = named.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("group").collect()
    if not mixed:
        return found
    numbers = docs.sparkSession.createDataFrame([(r["group"], k) for k, r in enumerate(mixed)], "group long, crowd long")
    return found.union(_connected(named.join(F.broadcast(numbers), "group").join(known, "node")))


def links(docs: DataFrame, scanned: DataFrame, size: int, tile_rows: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b) edges between contents, all of similarity 4/5 or more, that connect all proposed pairs of that similarity."""
    prints = [F.first(f"f{k}").alias(f"f{k}") for k in range(WORDS)]
    contents = materialize(scanned.filter("n > 0").groupBy("node").agg(F.min("nth").alias("nth"), F.first("n").alias("n"), *prints))
    first = materialize(_proposals(contents, tile_rows))
    members = materialize(contents.join(components(first).withColumnRenamed("root", "group"), "node"))
    crowded = members.groupBy("group").agg(F.count("*").alias("rows"), F.sum(8 * F.col("n").cast("long")).alias("bytes")).filter((F.col("rows") > group_rows) | (F.col("bytes") > TILE_BYTES))
    crowds = materialize(crowded.select("group"))
    found = _in_groups(docs, members.join(crowds, "group", "left_anti"), size)
    if crowds.isEmpty():
        return found
    return found.union(_in_crowds(docs, materialize(members.join(crowds, "group", "left_semi")), first, size))


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` (nth, doc_id, text, ...) less all but the first row, by doc_id (nulls last), content and nth, of each group of near copies."""
    text_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as kept:
        scanned = _scanned(docs, size)
        nodes = scanned.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "nth")).alias("least"))
        groups = components(links(docs, scanned, size))
        whole = nodes.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
        wanted, folder = written(whole.select(F.col("least.nth").alias("nth")))
        kept.append(folder)
    return _only(docs, wanted)
