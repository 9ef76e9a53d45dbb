"""Removal of long repeated byte strings (a string of ``length`` bytes that starts twice).

1. Anchors. Every window of ``length`` bytes has an anchor: the first place of the least hash
   among its strings of ``length // 2`` bytes. Consecutive windows with one anchor form a run.
   Equal windows have equal anchors, so only runs with equal anchor hashes hold equal windows.
2. Equal runs (same anchor hash and same 128 bits of the content's SHA-256) are repeated as they stand.
3. Runs that share an anchor but differ are the ends of repeats. One of each content is fetched;
   all with one anchor go to one task, which builds the Burrows-Wheeler transform of their
   bytes and expands intervals backward, breadth first: common prefixes appear by increasing
   length and the search stops at ``length``. What is then undivided is repeated.
4. Anchors with more than ``crowd`` different runs are not gathered in one task: their runs are cut
   at fixed distances from the anchor into parts, and parts that share the bytes common to all
   their windows go to the transform together. Parts of a crowd are cut again, down to single
   windows, whose equality is that of their digests. So a task never holds more than ``crowd``
   contents of a group, and every content is compared at some step.

A key that holds more rows than a quarter of an even partition is joined by a broadcast of such keys,
of which there can be four a partition at most; the other keys are shuffled.

Defined results: null text counts as empty; a null doc_id is kept; repeated rows are
occurrences of their own (so each is removed if long enough) and give a row each; texts under
``length`` bytes lose nothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, removed, shuffle_partitions, text_or_empty, written

BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20
PARTS = (25, 5, 1)
_powers: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of ``data`` by prefix sums of byte * BASE**i, modulo 2**64."""

    def __init__(self, data: bytes):
        if not _powers or len(_powers[0]) <= len(data):
            n = max(1 << 16, 2 * len(data))
            for b in (BASE, pow(BASE, -1, 1 << 64)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                _powers.append(np.multiply.accumulate(x))
            del _powers[:-2]
        up, self.down = _powers
        a = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(a * up[: len(a)], out=self.sums[1:])

    def at(self, start: np.ndarray, size) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def digests(contents: Iterator) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each content's SHA-256, as two longs."""
    both = np.frombuffer(b"".join(hashlib.sha256(c).digest()[:16] for c in contents), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def runs(data: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, anchor's distance from the start, anchor hash, two halves of the content hash) arrays, by chunks."""
    half = length // 2
    w = length - half + 1
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        h = Hashes(data[at : at + CHUNK + length - 1])
        own = h.all(half)
        n = len(own) - w + 1
        blocks = np.concatenate([own, np.full(-len(own) % w, np.uint64(2**64 - 1))]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        # a run ends where the least hash changes or its first place is left behind
        start = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (own[: n - 1] == least[:-1])]))
        windows = np.diff(np.append(start, n))
        # the anchor: the first place of its hash in the last window of the run
        where = np.flatnonzero(np.isin(own, least[start]))
        last = start + windows - 1
        place = np.searchsorted(where, last)
        anchor = np.full(len(start), -1, np.int64)
        todo = np.arange(len(start))
        while len(todo):
            p = where[place[todo]]
            hit = own[p] == least[start[todo]]
            anchor[todo[hit]] = p[hit]
            todo = todo[~hit]
            place[todo] += 1
        content = memoryview(data)[at : at + CHUNK + length - 1]
        f, g = digests(content[s:e] for s, e in zip(start.tolist(), (start + windows + length - 1).tolist()))
        yield start + at, windows, anchor - start, least[start].view(np.int64), f, g


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """Per segment, which of its windows (by start) occur in two places of all segments."""
    # symbols: 0 ends the text, 1 ends a segment, bytes follow
    text = np.concatenate([np.concatenate([np.frombuffer(s, np.uint8).astype(np.uint16) + 2, [1]]) for s in segments] + [[0]]).astype(np.uint16)
    n = len(text)
    padded = np.concatenate([text, np.zeros(6, np.uint16)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(6):
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key).astype(np.int32)  # equal keys may come in any order: their group is sorted below
    ks = key[order]
    new = np.concatenate([[True], ks[1:] != ks[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))  # rank: the first place of the group
    rank = np.empty(n, np.int32)
    rank[order] = first
    h = 6
    while h < length:
        size_over_1 = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(size_over_1):
            break
        sa = order[size_over_1]
        nxt = rank[np.minimum(sa + h, n - 1)]
        group = rank[sa]
        o = np.argsort(group.astype(np.int64) * n + nxt)
        order[size_over_1] = sa[o]
        g, x = group[o], nxt[o]
        new[size_over_1] = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
        # only these places change; a group's first place is among them
        place = np.maximum.accumulate(np.where(new[size_over_1], size_over_1, 0)).astype(np.int32)
        rank[sa[o]] = place
        h *= 2

    # backward extension: row r of the transform is the symbol before suffix order[r]
    bwt = text[order - 1]
    step = np.empty(n, np.int32)  # the row of the suffix that is one symbol longer
    step[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    divided = np.zeros(n + 1, bool)  # a common prefix below ``length`` is known above this row
    divided[[0, n]] = True
    low, end = np.array([0]), np.array([n])
    for _ in range(length):
        sizes = end - low
        total = int(sizes.sum())
        if not total:
            break
        owner = np.repeat(np.arange(len(low)), sizes)
        rows = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        to = step[rows]
        o = np.argsort(to, kind="stable")
        to, owner = to[o], owner[o]
        symbol = bwt[rows[o]]
        starts = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])]))
        lows = to[starts]
        ends = to[np.append(starts[1:], total) - 1] + 1
        fresh = ~divided[ends]
        low, end = lows[fresh], ends[fresh]
        divided[end] = True
    again = np.zeros(n, bool)
    again[order] = ~divided[:n] | ~divided[1:]
    out, at = [], 0
    for s in segments:
        out.append(again[at : at + max(0, len(s) - length + 1)])
        at += len(s) + 1
    return out


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past the last) of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def dedup(docs: DataFrame, length: int = 400, crowd: int = 1024, chunk_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    return _kept(*_repeats(docs, length, crowd, chunk_bytes), length)


def cleaned(docs: DataFrame, length: int = 400, crowd: int = 1024, chunk_bytes: int = 1 << 18) -> DataFrame:
    """doc_id and the bytes that stay."""
    return _kept(*_repeats(docs, length, crowd, chunk_bytes, keep=True), length, content=True).select("doc_id", "kept")


def _spread_join(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, most: int) -> DataFrame:
    """``rows`` joined with ``keys`` (one row a key; ``weight``: how many of ``rows``, ``most`` at most in all, have it)."""
    limit = most / (4 * shuffle_partitions(rows.sparkSession))
    heavy, light = keys.filter(F.col(weight) > limit), keys.filter(F.col(weight) <= limit)  # heavy: four a partition at most
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(heavy.drop(weight)), on).unionByName(rest.join(light.drop(weight), on))


def _repeats(docs: DataFrame, length: int, crowd: int, chunk_bytes: int, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, their text only where something may repeat; intervals of repeated windows)."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    long_ = rows.filter(F.col("n_bytes") >= length)
    run_schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int32()), ("h", pa.int64()), ("f", pa.int64()), ("g", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def emit() -> pa.RecordBatch:
            b = batch(run_schema, [pa.array(np.concatenate(c) if k != 0 else [x for y in c for x in y], type=run_schema.field(k).type) for k, c in enumerate(zip(*held))])
            held.clear()
            return b

        for b in batches:
            for d, th, t in zip(b["doc_id"].to_pylist(), b["th"].to_pylist(), b["text"]):
                for start, windows, anchor, h, f, g in runs(t.as_py().encode("utf-8", "surrogatepass"), length):
                    held.append(([d] * len(start), np.full(len(start), th), start, windows, anchor, h, f, g))
                    n += len(start)
                if n > 100_000:
                    yield emit()
                    n = 0
        if held:
            yield emit()

    every, every_path = written(long_.select("doc_id", "th", "text").mapInArrow(scan, "doc_id long, th long, start long, windows int, anchor int, h long, f long, g long"))
    contents, contents_path = written(every.groupBy("h", "f", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "start", "windows", "anchor")).alias("one")))
    n_runs = every.count()
    per_anchor = contents.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("n_all")).filter("n_all > 1").select("h", "kinds", F.col("kinds").alias("weight"))
    members = materialize(_spread_join(contents, per_anchor, ["h"], "weight", n_runs).select("h", "f", "g", "n", "kinds", "one.*"))
    removed(docs.sparkSession, contents_path)
    same = _spread_join(every, members.filter("n > 1").select("h", "f", "g", "n"), ["h", "f", "g"], "n", n_runs).select("doc_id", "th", "start", (F.col("start") + F.col("windows")).alias("past"))
    same = materialize(same)
    removed(docs.sparkSession, every_path)
    unlike = members.filter("kinds > 1")

    # texts are moved once: kept only where something may repeat, else their digest
    keys = same.select("doc_id", "th").union(unlike.select("doc_id", "th")).distinct().withColumn("mark", F.lit(1))
    digested = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    k = keys.select(F.col("doc_id").alias("kd"), F.col("th").alias("kt"), "mark")
    base = materialize(
        digested.join(k, F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("th") == F.col("kt")), "left").select("doc_id", "th", "n_bytes", "sha", F.col("text") if keep else F.when(F.col("mark") == 1, F.col("text")).alias("text"))
    )

    # one content of each kind under an anchor, with its bytes
    wanted = unlike.groupBy(F.col("doc_id").alias("kd"), F.col("th").alias("kt")).agg(F.collect_list(F.struct("h", "n", "kinds", "start", "windows", "anchor")).alias("runs"))
    texts = base.filter(F.col("text").isNotNull()).dropDuplicates(["doc_id", "th"])
    member_schema = "h long, n long, kinds long, doc_id long, th long, start long, windows int, anchor int, bytes binary"
    to_arrow = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int32()), ("bytes", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, th, t, rs in zip(b["doc_id"].to_pylist(), b["th"].to_pylist(), b["text"], b["runs"]):
                data = t.as_py().encode("utf-8", "surrogatepass")
                out = [(r["h"], r["n"], r["kinds"], d, th, r["start"], r["windows"], r["anchor"], data[r["start"] : r["start"] + r["windows"] + length - 1]) for r in rs.as_py()]
                yield batch(to_arrow, [list(c) for c in zip(*out)])

    joined = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("th") == F.col("kt"))).select("doc_id", "th", "text", "runs")
    fetched = materialize(joined.mapInArrow(fetch, member_schema))

    found_schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("past", pa.int64())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor; a chunk ends between anchors."""
        held: list[tuple] = []
        size, last = 0, None

        def emit() -> pa.RecordBatch:
            out = []
            for (d, th, start, _), flags in zip(held, repeated_starts([x[3] for x in held], length)):
                out += [(d, th, start + s, start + e) for s, e in zip(*(x.tolist() for x in spans(flags)))]
            held.clear()
            return batch(found_schema, [list(c) for c in zip(*out)] if out else [[], [], [], []])

        for b in batches:
            for h, d, th, start, data in zip(*(b[c].to_pylist() for c in ("h", "doc_id", "th", "start", "bytes"))):
                if h != last and size > chunk_bytes:
                    yield emit()
                    size = 0
                held.append((d, th, start, data))
                size, last = size + len(data), h
        if held:
            yield emit()

    def compared(groups: DataFrame) -> DataFrame:
        """Repeated windows of each group ``h`` of contents, by the transform."""
        dealt = groups.repartition(2 * shuffle_partitions(docs.sparkSession), "h").sortWithinPartitions("h")
        return dealt.mapInArrow(expand, "doc_id long, th long, start long, past long")

    few = compared(fetched.filter(F.col("kinds") <= crowd).select("h", "doc_id", "th", "start", "bytes"))

    # crowded anchors: parts at fixed distances from the anchor, smaller ones where a part is crowded
    left = fetched.filter(F.col("kinds") > crowd).select("h", "doc_id", "th", "start", "windows", "anchor", "bytes")
    found = few
    for size in PARTS:
        parts = materialize(left.mapInArrow(_parts(length, size), PART_DDL))
        n = max(1, parts.count())
        kinds = materialize(parts.groupBy("key", "full", "more").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "start", "windows", "anchor", "h", "bytes")).alias("one")))
        alike = _spread_join(parts.select("key", "full", "more", "doc_id", "th", "start", "windows"), kinds.filter("n > 1").select("key", "full", "more", "n"), ["key", "full", "more"], "n", n)
        found = found.unionByName(alike.select("doc_id", "th", "start", (F.col("start") + F.col("windows")).alias("past")))
        if size == 1:
            break
        per = kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1").withColumn("weight", F.col("kinds"))
        mixed = materialize(_spread_join(kinds.select("key", "one"), per, ["key"], "weight", n).select("key", "kinds", "one.*"))
        found = found.unionByName(compared(mixed.filter(F.col("kinds") <= crowd).select(F.col("key").alias("h"), "doc_id", "th", "start", "bytes")))
        left = mixed.filter(F.col("kinds") > crowd).select("h", "doc_id", "th", "start", "windows", "anchor", "bytes")
    return base, same.unionByName(found)


PART_DDL = "key long, full long, more long, doc_id long, th long, start long, windows int, anchor int, h long, bytes binary"


def _parts(length: int, size: int):
    """Runs cut where a window's distance from its anchor passes a multiple of ``size``.

    Equal windows have equal distances, so they fall in equal parts; what all windows of a part
    share is hashed into the part's key.
    """
    types = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(PART_DDL.split(", "), types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh64

        for b in batches:
            out = []
            for h, d, th, start, windows, anchor, data in zip(*(b[c].to_pylist() for c in ("h", "doc_id", "th", "start", "windows", "anchor", "bytes"))):
                part = (anchor - np.arange(windows)) // size
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), windows]
                for s, e in zip(cuts, cuts[1:]):
                    p = int(part[s])
                    core = anchor - size * p  # where a whole part's last window begins
                    key = xxh64(data[core : core + length - size + 1], (h ^ (p * BASE)) & (2**64 - 1))
                    ((full,), (more,)) = digests([b"%d:" % (anchor - s) + data[s : e + length - 1]])
                    out.append((key - (1 << 64) if key >> 63 else key, int(full), int(more), d, th, start + s, e - s, anchor - s, h, data[s : e + length - 1] if size > 1 else b""))
            yield batch(schema, [list(c) for c in zip(*out)] if out else [[] for _ in schema])

    return run


def _kept(base: DataFrame, intervals: DataFrame, length: int, content: bool = False) -> DataFrame:
    # rows with one id and one text have the same intervals: each counts once, however many rows there are
    per_doc = intervals.groupBy(F.col("doc_id").alias("kd"), F.col("th").alias("kt")).agg(F.collect_set(F.struct("start", "past")).alias("found"))
    texts = base.filter(F.col("text").isNotNull())
    joined = texts.join(per_doc, F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("th") == F.col("kt")), "left").select("doc_id", "n_bytes", "text", "found")
    last = "kept" if content else "kept_sha256"
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), (last, pa.binary() if content else pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, n, t, found in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["text"], b["found"]):
                data, gone = t.as_py().encode("utf-8", "surrogatepass"), np.zeros(n + 1, np.int32)
                if found.is_valid and len(found):
                    s, e = (found.values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(gone, s, 1)
                    np.add.at(gone, e + length - 1, -1)  # windows start in [s, e), the last covers length bytes
                flags = np.cumsum(gone[:-1]) > 0
                a, z = spans(flags)
                kept = np.frombuffer(data, np.uint8)[~flags].tobytes()
                out.append((d, n, int(flags.sum()), len(a), kept if content else hashlib.sha256(kept).hexdigest()))
            yield batch(schema, [list(c) for c in zip(*out)])

    changed = joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'binary' if content else 'string'}")
    if content:
        return changed  # every text was kept
    plain = base.filter(F.col("text").isNull()).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return plain.unionByName(changed)
