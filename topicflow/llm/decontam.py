"""Benchmark passages in documents.

Every window of a document as long as a benchmark item (in word shingles) that shares a
shingle with an item of that length gets a SimHash fingerprint of 128 bits. The radius follows from
the threshold and the length: a bit differs with a probability that the shared shingles give, and
no more than ``miss`` of the pairs at the threshold lie beyond. A multi-index of two blocks of 64
bits yields all items within it: of two fingerprints that differ in ``r`` bits, one block differs in
at most ``r // 2``. (At 0.8 the radius is about 46; narrower blocks would have to let more bits
differ in proportion and select less: of unrelated items two blocks pass 3 in 100, four 20.) A
candidate is accepted by the exact similarity of its weighted shingles, 2*sum(min)/sum(both),
at ``threshold``; a shingle's weight is its number of occurrences. A document shorter than an
item is one window as a whole, compared by exact similarity with every such item that shares a
shingle with it.

Windows that share no shingle have similarity 0, so leaving them out loses nothing. Items come
to the driver as the query set, in blocks of at most ``block_words`` words; each block is
one pass over the documents.

Defined results: texts and items that are null or without words match nothing; items shorter
than a shingle are one shingle of all their words; a null item_id or doc_id is kept; repeated
items are reported each, repeated rows once; A-Z is lower-cased; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, slices, text_batches, text_or_empty

FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(5)], np.uint64)
FILTER_BITS = 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """64-bit hashes of words, cached."""

    def __init__(self, keep: int = 150_000):
        self.keep, self.cache = keep, {}

    def __call__(self, text: bytes) -> np.ndarray:
        from xxhash import xxh64_intdigest as h

        cache, words = self.cache, text.lower().split()
        if len(cache) > self.keep:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = h(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = words[:n] * FACTORS[0]
    for k in range(1, size):
        total = total + words[k : k + n] * FACTORS[k]
    return _mixed(total)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 128 bits of each hash, two words of it."""
    both = np.stack([hashes, _mixed(hashes ^ np.uint64(0xA0761D6478BD642F))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def folded(sums: np.ndarray) -> np.ndarray:
    """Fingerprints [row, block] of sums of signs."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)


def _coin_sums(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and probabilities of the sum of ``n`` signs."""
    k = np.arange(n + 1)
    lg = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k]) - n * math.log(2)
    return 2 * k - n, np.exp(lg)


def radius_of(length: int, threshold: float, miss: float = 1e-5) -> int:
    """Differing bits of 128 beyond which at most ``miss`` of the pairs of ``length`` shingles lie that share ``threshold`` of them."""
    shared = math.ceil(threshold * length - 1e-9)
    common, p_common = _coin_sums(shared)
    own, p_own = _coin_sums(length - shared)
    up = np.array([p_own[own > -c].sum() for c in common])  # the rest carries the sum above 0
    p = float((p_common * 2 * up * (1 - up)).sum())
    k = np.arange(129)
    tail = np.array([math.comb(128, int(i)) * p**i * (1 - p) ** (128 - i) for i in k])[::-1].cumsum()[::-1]
    return int(np.flatnonzero(np.append(tail[1:], 0.0) <= miss)[0])


class Group:
    """Items of one shingle size and one length in shingles."""

    def __init__(self, size: int, length: int, items: list[tuple[int, np.ndarray]], threshold: float):
        self.size, self.length, self.items, self.radius = size, length, items, radius_of(length, threshold)
        self.prints = folded(np.stack([signs(h).sum(0) for _, h in items]))
        self.counts = [Counter(h.tolist()) for _, h in items]
        self._holders: dict[int, list[int]] = {}

    def holders(self) -> dict[int, list[int]]:
        """The items that have a shingle, by shingle; made when a shorter document asks first."""
        if not self._holders:
            for k, have in enumerate(self.counts):
                for h in have:
                    self._holders.setdefault(h, []).append(k)
        return self._holders

    def near(self, prints: np.ndarray, block: int = 4096) -> Iterator[tuple[int, int, int]]:
        """(window, item, differing bits) for all within the radius."""
        for first in range(0, len(self.prints), block):
            bits = [np.bitwise_count(prints[:, None, b] ^ self.prints[None, first : first + block, b]) for b in (0, 1)]
            w, k = np.nonzero((bits[0] <= self.radius // 2) | (bits[1] <= self.radius // 2))
            total = bits[0][w, k].astype(int) + bits[1][w, k]
            for i in np.flatnonzero(total <= self.radius):
                yield int(w[i]), first + int(k[i]), int(total[i])


class Index:
    """The items of one block by shingle size and length, and a bitmap of their shingles."""

    def __init__(self, items: list[tuple[int, bytes]], size: int, threshold: float):
        words, by = Words(), defaultdict(list)
        for item, text in items:
            w = words(text)
            if len(w):
                h = shingles(w, min(size, len(w)))
                by[min(size, len(w)), len(h)].append((item, h))
        self.groups = [Group(s, n, x, threshold) for (s, n), x in sorted(by.items())]
        self.known = {}
        for s in {g.size for g in self.groups}:
            pairs = sorted({(int(h), k) for k, g in enumerate(self.groups) if g.size == s for _, hs in g.items for h in hs})
            values = np.array([p[0] for p in pairs], np.uint64)
            bitmap = np.zeros(1 << FILTER_BITS, bool)
            bitmap[values >> np.uint64(64 - FILTER_BITS)] = True
            self.known[s] = (bitmap, values, np.array([p[1] for p in pairs]))

    def search(self, words: np.ndarray, threshold: float) -> dict:
        """Per item the best window: (similarity, -start, words, differing bits)."""
        best: dict = {}
        for size, (bitmap, values, owners) in self.known.items():
            hashes = shingles(words, size)
            maybe = np.flatnonzero(bitmap[hashes >> np.uint64(64 - FILTER_BITS)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(values, hashes[maybe]), np.searchsorted(values, hashes[maybe], "right")
            hits = defaultdict(list)
            for at, a, z in zip(maybe.tolist(), lo.tolist(), hi.tolist()):
                for k in owners[a:z].tolist():
                    hits[k].append(at)
            for k, at in hits.items():
                self._windows(self.groups[k], hashes, np.array(at), threshold, best)
        return best

    def _windows(self, g: Group, hashes: np.ndarray, at: np.ndarray, threshold: float, best: dict) -> None:
        n, last = g.length, len(hashes) - g.length
        if last < 0:
            self._whole(g, hashes, threshold, best)
            return
        # windows that hold a hit, in stretches that do not touch
        lo, hi = np.maximum(at - n + 1, 0), np.minimum(at, last)
        ok = lo <= hi
        lo, hi = lo[ok], hi[ok]
        if not len(lo):
            return
        cut = np.flatnonzero(lo[1:] > hi[:-1] + 1) + 1
        for a, z in zip(lo[np.concatenate([[0], cut])], hi[np.concatenate([cut, [len(hi)]]) - 1]):
            for s in range(int(a), int(z) + 1, 1024):
                e = min(int(z), s + 1023)
                own = hashes[s : e + n]
                total = np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(signs(own), 0, dtype=np.int32)])
                for w, k, bits in g.near(folded(total[n:] - total[:-n])):
                    item, have = g.items[k][0], g.counts[k]
                    mine = Counter(own[w : w + n].tolist())
                    alike = 2 * sum(min(c, mine[h]) for h, c in have.items() if h in mine) / (2 * n)
                    if alike >= threshold:
                        found = (alike, -(s + w), n + g.size - 1, bits)
                        if (item, k, g) not in best or found > best[item, k, g]:
                            best[item, k, g] = found


    def _whole(self, g: Group, hashes: np.ndarray, threshold: float, best: dict) -> None:
        """A document shorter than the items is its one window."""
        n = len(hashes)
        if 2 * n / (n + g.length) < threshold:
            return
        alike = Counter()
        for h, c in Counter(hashes.tolist()).items():
            for k in g.holders().get(h, ()):
                alike[k] += min(c, g.counts[k][h])
        for k, both in alike.items():
            if 2 * both / (n + g.length) >= threshold:
                bits = int(np.bitwise_count(folded(signs(hashes).sum(0)[None])[0] ^ g.prints[k]).sum())
                found = (2 * both / (n + g.length), 0, n + g.size - 1, bits)
                item = g.items[k][0]
                if (item, k, g) not in best or found > best[item, k, g]:
                    best[item, k, g] = found


def _blocks(items: list[tuple[int, bytes]], block_words: int) -> Iterator[list[tuple[int, bytes]]]:
    block, n = [], 0
    for item, text in items:
        size = len(text.split())
        if block and n + size > block_words:
            yield block
            block, n = [], 0
        block.append((item, text))
        n += size
    if block:
        yield block


def _items(benchmark: DataFrame) -> Iterator[tuple[int, bytes]]:
    ordered = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).orderBy("item_id", "text")
    return ((r["item_id"], r["text"].encode("utf-8", "surrogatepass")) for r in ordered.toLocalIterator())


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, similarity, word_start, n_words, differing_bits: the best window of each item in each document."""
    spark = docs.sparkSession
    text_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("word_start", pa.int64()), ("n_words", pa.int64()), ("differing_bits", pa.int32())])
    ddl = "doc_id long, item_id long, similarity double, word_start long, n_words long, differing_bits int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def scan(block: list[tuple[int, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # at most block_words words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, words = Index(sent.value, size, threshold), Words()
            for b in slices(batches):
                out = []
                for d, t in zip(b["doc_id"].to_pylist(), b["text"]):
                    for (item, _, _), (alike, at, n, bits) in index.search(words(t.as_py().encode("utf-8", "surrogatepass")), threshold).items():
                        out.append((d, item, alike, -at, n, bits))
                if out:
                    yield batch(schema, [list(c) for c in zip(*out)])

        return rows.mapInArrow(run, ddl)

    found = None
    for block in _blocks(_items(benchmark), block_words):
        found = scan(block) if found is None else found.union(scan(block))
    return spark.createDataFrame([], ddl) if found is None else found.dropDuplicates()




def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, block_words: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows that match an item; each row is decided by its own text, all columns kept."""
    spark = docs.sparkSession
    text_batches(spark)

    def clean(rows: DataFrame, block: list[tuple[int, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # at most block_words words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, words = Index(sent.value, size, threshold), Words()
            for b in slices(batches):
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([not index.search(words((t or "").encode("utf-8", "surrogatepass")), threshold) for t in texts], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    for block in _blocks(_items(benchmark), block_words):
        docs = clean(docs, block)
    return docs
