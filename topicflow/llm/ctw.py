"""Context-tree weighting over bytes, with counts of the whole training corpus.

A text is its words (A-Z lower-cased), each followed by a blank, then one end. A byte is eight
binary decisions; each of the 255 decision nodes has a context tree over the last ``depth`` bytes
of the text, across blanks and words (blanks before the beginning). A tree node mixes its own
Krichevsky-Trofimov estimate with what its children say: the block probability is
``Pw = 1/2 Pe + 1/2 prod Pw(child)``, and the prediction weighs the node's estimate by
``Pe / (2 Pw)``, at every depth. The counts are those of all training rows, held fixed while texts
are scored.

Steps, all Spark work whose size follows the input: tasks count strings of ``depth + 1`` bytes
(context and byte) and combine them before the shuffle; the tree goes up and down two levels of
bytes at a time, dealt by the shorter context, so that a group has at most 65,536 contexts of 255
nodes however large the corpus; texts look their strings up. Broadcast are the strings (and, for
the base score, words) that are frequent enough for at most ``hot_strings`` (``hot_words``) of
them to be so; the rest is joined.

Defined results: null text counts as empty, which is an end alone; a null doc_id is trained
on; repeated rows count and are scored each; without training rows all estimates are even;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, shuffle_partitions, slices, text_or_empty

BLANK = 0x20
LN_HALF = math.log(0.5)
DEPTH = 6  # a string of context and byte fits a long
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 1, F.lit(False))


def _words(text: pa.Scalar) -> list[bytes]:
    return text.as_py().encode("utf-8", "surrogatepass").lower().split()


def word_counts(rows: DataFrame, keep: int = 300_000) -> DataFrame:
    """(word, n): every word of ``rows`` (text, held_out) and how often training rows have it."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text, out in zip(b["text"], b["held_out"].to_pylist()):
                if out:
                    for w in set(_words(text)):
                        seen.setdefault(w, 0)
                else:
                    seen.update(_words(text))
                if len(seen) > keep:
                    yield batch(schema, [list(seen), list(seen.values())])
                    seen.clear()
        if seen:
            yield batch(schema, [list(seen), list(seen.values())])

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def line_of(words: list[bytes]) -> bytes:
    return b" ".join([*words, b"\n"])


def strings(lines: list[bytes], depth: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(string, index of its line) for every byte of every line, in parts of about ``most`` bytes.

    A string is a number: the nearest byte of the context is the most significant, the byte
    itself the least, so that contexts with a common ending are neighbours.
    """
    if not 0 < depth <= DEPTH:
        raise ValueError(f"depth must lie in 1..{DEPTH}")
    pad = bytes([BLANK]) * depth
    line = np.frombuffer(pad + pad.join(lines), np.uint8)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    first = depth + np.cumsum(n + depth) - (n + depth)
    if n.sum() <= 2 * most:
        owner = np.repeat(np.arange(len(lines)), n)
        at = np.arange(len(owner)) + np.repeat(first - (np.cumsum(n) - n), n)
        yield _strings_at(line, depth)[at - depth], owner
        return
    for k in range(len(lines)):  # long texts come alone, in parts
        for s in range(0, int(n[k]), most):
            z = min(int(n[k]), s + most)
            part = _strings_at(line[first[k] + s - depth : first[k] + z], depth)
            yield part, np.full(len(part), k)


def _strings_at(line: np.ndarray, depth: int) -> np.ndarray:
    """Strings of all places from ``depth`` on."""
    wide = line.astype(np.uint64)
    key = wide[depth:].copy()
    for j in range(1, depth + 1):
        key |= wide[depth - j : len(wide) - j] << np.uint64(8 * (depth + 1 - j))
    return key.view(np.int64)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(s, n, every) summed by s."""
    s = np.concatenate([x[0] for x in parts])
    order = np.argsort(s, kind="stable")
    s = s[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    sums = [np.add.reduceat(np.concatenate([x[k] for x in parts])[order], start) if len(start) else parts[0][k] for k in (1, 2)]
    return s[start], *sums


def string_counts(rows: DataFrame, depth: int, keep: int = 3_000_000) -> DataFrame:
    """(s, n, every): strings of ``rows`` (text, held_out); n times in training rows, ``every`` times in all."""
    schema = pa.schema([("s", pa.int64()), ("n", pa.int32()), ("every", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the first is merged, parts of one line up behind it
        lines: tuple[list[bytes], list[bytes]] = ([], [])
        n_bytes = waiting = 0

        def count() -> int:
            new = 0
            for out in (0, 1):
                for s, _ in strings(lines[out], depth) if lines[out] else ():
                    u, c = np.unique(s, return_counts=True)
                    c = c.astype(np.int32)
                    held.append((u, c * np.int32(1 - out), c))
                    new += len(u)
                lines[out].clear()
            return new

        def emit() -> Iterator[pa.RecordBatch]:
            s, n, every = _merged(held)
            held.clear()
            for k in range(0, len(s), 100_000):
                yield batch(schema, [pa.array(x[k : k + 100_000]) for x in (s, n, every)])

        for b in slices(batches):
            for text, out in zip(b["text"], b["held_out"].to_pylist()):
                line = line_of(_words(text))
                lines[out].append(line)
                n_bytes += len(line)
                if n_bytes > 1 << 20:
                    waiting += count()
                    n_bytes = 0
                if waiting > 600_000:
                    held[:] = [_merged(held)]
                    waiting = 0
            if held and len(held[0][0]) > keep:
                yield from emit()
                waiting = 0
        count()
        if held:
            yield from emit()

    return rows.mapInArrow(run, "s long, n int, every int").groupBy("s").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, brought back by the product of x .. x + 7."""
    y = x + 8.0
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def estimated(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln Pe by Krichevsky and Trofimov."""
    le = _ln_gamma(zeros + 0.5) + _ln_gamma(ones + 0.5) - _ln_gamma(zeros + ones + 1.0) - math.log(math.pi)
    return np.where(zeros + ones == 0, 0.0, le)


class Levels:
    """The nodes of whole subtrees, from the longest context (level ``high``) to level ``low``.

    A node's key is its context and its decision node, eight bits: dropping the farthest byte
    of the context gives its parent.
    """

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, le: np.ndarray, lw: np.ndarray, high: int, low: int):
        self.high, self.low = high, low
        self.nodes = [(key, zeros, ones, le, lw)]
        self.parent: list[np.ndarray] = []
        for _ in range(high - low):
            key, zeros, ones, _, lw = self.nodes[-1]
            up, to = np.unique(((key >> 16) << 8) | (key & 255), return_inverse=True)
            z, o, below = (np.bincount(to, x, len(up)) for x in (zeros, ones, lw))
            le = estimated(z, o)
            self.parent.append(to)
            self.nodes.append((up, z, o, le, np.logaddexp(le, below) + LN_HALF))

    def predictions(self, depth: int, p0: np.ndarray | None, taken: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(p0, taken) of the nodes at ``high``: the estimates' shares down to there, and the share given away.

        ``p0`` and ``taken`` are those of the nodes at ``low``; none at the root.
        """
        for d in range(self.low, self.high + 1):
            _, z, o, le, lw = self.nodes[self.high - d]
            share = np.ones(len(z)) if d == depth else np.exp(np.minimum(le - lw + LN_HALF, 0.0))
            kt = (z + 0.5) / (z + o + 1.0)
            if d == self.low:
                if p0 is None:
                    p0, taken = share * kt, share
                continue
            to = self.parent[self.high - d]
            part = (1 - taken[to]) * share
            p0, taken = p0[to] + part * kt, taken[to] + part
        return p0, taken


def leaves(s: np.ndarray, n: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Nodes (key, zeros, ones, le, lw) of the strings' contexts; per string and decision its node's place and bit."""
    byte, context = s & 255, s >> 8
    t = np.arange(8)[:, None]
    node = (1 << t) | (byte >> (8 - t))
    bit = (byte >> (7 - t)) & 1
    key, to = np.unique(((context << 8) | node).ravel(), return_inverse=True)
    to = to.reshape(8, -1)
    weights = np.broadcast_to(n.astype(float), to.shape)
    zeros, ones = (np.bincount(to.ravel(), (weights * (bit == b)).ravel(), len(key)) for b in (0, 1))
    le = estimated(zeros, ones)
    return (key, zeros, ones, le, le), to, bit


NODES = pa.schema([("key", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("le", pa.float64()), ("lw", pa.float64())])
ABOVE = pa.schema([("key", pa.int64()), ("p0", pa.float64()), ("taken", pa.float64())])
SCORES = pa.schema([("s", pa.int64()), ("lg", pa.float64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double'}" for f in schema)


def _dealt(rows: DataFrame, context: Column) -> DataFrame:
    """Rows by group, the contexts that end alike."""
    return rows.withColumn("g", context).repartition(shuffle_partitions(rows.sparkSession), "g").sortWithinPartitions("g")


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of ``least`` rows or more that end where a group does."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        g = b["g"].to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if cut or len(held) > 1 and held[-2]["g"][-1].as_py() != g[0]:
            yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held = [b.slice(cut)]
            n = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names]


def _parts(schema: pa.Schema, columns: list[np.ndarray], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), rows):
        yield batch(schema, [pa.array(x[k : k + rows]) for x in columns])


def _upward(rows: DataFrame, high: int, low: int, leaf: bool) -> DataFrame:
    """Nodes at level ``low`` from strings (leaf) or from nodes at level ``high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            nodes = leaves(*_numbers(table, ["s", "n"]))[0] if leaf else _numbers(table, NODES.names)
            yield from _parts(NODES, list(Levels(*nodes, high, low).nodes[-1]))

    column = F.col("s") if leaf else F.col("key")
    return materialize(_dealt(rows, F.shiftright(column, 8 * (high - low + 1))).mapInArrow(run, _ddl(NODES)))


def _downward(rows: DataFrame, above: DataFrame | None, high: int, low: int, depth: int, leaf: bool) -> DataFrame:
    """Predictions at level ``high``, or (leaf) the strings' scores, from those at level ``low``."""
    names = ["s", "n"] if leaf else NODES.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            own = table["up"].to_numpy() == 0
            key, p0, taken = (x[~own] for x in _numbers(table, ["up_key", "p0", "taken"]))
            mine = [x[own] for x in _numbers(table, names)]
            nodes, to, bit = leaves(*mine) if leaf else (mine, None, None)
            levels = Levels(*nodes, high, low)
            if len(key):
                order = np.argsort(key)
                at = order[np.searchsorted(key[order], levels.nodes[-1][0])]
                p0, taken = levels.predictions(depth, p0[at], taken[at])
            else:
                p0, taken = levels.predictions(depth, None, None)
            if leaf:
                p = np.where(bit == 0, p0[to], 1 - p0[to])
                yield from _parts(SCORES, [mine[0], np.log10(p).sum(0)])
            else:
                yield from _parts(ABOVE, [nodes[0], p0, taken])

    column = F.col("s") if leaf else F.col("key")
    blank = {"up_key": "long", "p0": "double", "taken": "double"}
    own = rows.select(*names, F.shiftright(column, 8 * (high - low + 1)).alias("g"), F.lit(0).alias("up"), *[F.lit(0).cast(t).alias(c) for c, t in blank.items()])
    if above is not None:
        types = {f.name: f.dataType.simpleString() for f in rows.schema}
        own = own.unionByName(above.select(*[F.lit(0).cast(types[c]).alias(c) for c in names], F.shiftright("key", 8).alias("g"), F.lit(1).alias("up"), F.col("key").alias("up_key"), "p0", "taken"))
    return materialize(_dealt(own, F.col("g")).mapInArrow(run, _ddl(SCORES if leaf else ABOVE)))


def string_scores(counts: DataFrame, depth: int) -> DataFrame:
    """(s, lg): log10 of the weighted probability of each string's byte after its context."""
    cuts = [*range(depth, 0, -2), 0]  # two levels a step: at most 65,536 contexts in a group
    nodes = [counts]
    for high, low in zip(cuts[:-2], cuts[1:-1]):
        nodes.append(_upward(nodes[-1], high, low, len(nodes) == 1))
    above = None
    for k in range(len(cuts) - 2, -1, -1):
        above = _downward(nodes[k], above, cuts[k], cuts[k + 1], depth, k == 0)
    return above


def most_frequent(rows: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows of the highest counts, all those of a class of counts or none, ``limit`` at most; no row is sorted."""
    c = F.col(count)
    kind = F.when(c < 1024, c).otherwise(1024 + F.floor(F.log2(c.cast("double") / 1024) * 64)).cast("int")
    sizes = rows.filter(c > 0).groupBy(kind.alias("kind")).count().collect()  # under 4,500 classes
    left, least = limit, None
    for r in sorted(sizes, key=lambda r: -r["kind"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["kind"]
    return rows.filter(F.lit(False)) if least is None else rows.filter((c > 0) & (kind >= least))


class Table:
    """Look-up of strings: a slot for each by a multiplied hash, the more frequent first; a sorted list for the rest."""

    def __init__(self, s: np.ndarray, lg: np.ndarray):
        """``s`` by ascending frequency."""
        self.bits = max(8, int(len(s)).bit_length())
        self.slot_s, self.slot_lg = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        at = self._slots(s)
        self.slot_s[at] = s  # of equal slots the last stays
        won = self.slot_s[at] == s
        self.slot_lg[at[won]] = lg[won]
        order = np.argsort(s[~won])
        self.rest_s, self.rest_lg = s[~won][order], lg[~won][order]

    def _slots(self, s: np.ndarray) -> np.ndarray:
        return ((s.view(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, which are known)."""
        at = self._slots(s)
        known = self.slot_s[at] == s
        lg = np.where(known, self.slot_lg[at], 0.0)
        miss = np.flatnonzero(~known)
        if len(miss) and len(self.rest_s):
            x = s[miss]
            p = np.minimum(np.searchsorted(self.rest_s, x), len(self.rest_s) - 1)
            hit = self.rest_s[p] == x
            lg[miss[hit]] = self.rest_lg[p[hit]]
            known[miss[hit]] = True
        return lg, known


def score(docs: DataFrame, depth: int = DEPTH, folds: int = 5, hot_strings: int = 1 << 21, hot_words: int = 1 << 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds).alias("held_out"), text_or_empty().alias("text"))
    ends = rows.filter(~F.col("held_out")).count()
    words = materialize(word_counts(rows.select("text", "held_out")))
    seen = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    tokens, distinct = seen[0] + ends, seen[1] + (ends > 0)
    least = math.log10(1 / (tokens + 0.5 * (distinct + 1)))
    base = lambda n: math.log10(n + 0.5) + least
    known = {bytes(r["word"]): r["n"] for r in most_frequent(words, "n", hot_words).collect()}
    sent_words = spark.sparkContext.broadcast(known)  # at most hot_words entries

    counts = materialize(string_counts(rows.select("text", "held_out"), depth))
    scores = string_scores(counts.select("s", "n"), depth)
    hot = scores.join(most_frequent(counts, "every", hot_strings).select("s", "every"), "s").toArrow()  # at most hot_strings rows
    order = np.argsort(hot["every"].to_numpy(), kind="stable")
    sent_strings = spark.sparkContext.broadcast((hot["s"].to_numpy()[order], hot["lg"].to_numpy()[order]))
    schema = pa.schema(
        [("nth", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lg", pa.float64())]
        + [("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())), ("strings", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, table = {w: (n, base(n)) for w, n in sent_words.value.items()}, Table(*sent_strings.value)
        for part in slices(batches):
            out, lines = [], []
            for nth, d, held, text in zip(part["nth"].to_pylist(), part["doc_id"].to_pylist(), part["held_out"].to_pylist(), part["text"]):
                own = _words(text)
                n_known, total, cold = int(ends > 0), base(ends), []
                for w, n in Counter(own).items():
                    got = hot.get(w)
                    if got is None:
                        cold.append((w, n))
                    else:
                        n_known += n
                        total += n * got[1]
                lines.append(line_of(own))
                out.append((nth, d, held, len(own) + 1, len(lines[-1]), n_known, total, [w for w, _ in cold], [n for _, n in cold]))
            lg, rest, whose = np.zeros(len(out)), [], []
            for s, owner in strings(lines, depth):
                value, ok = table(s)
                lg += np.bincount(owner, value, len(out))
                rest.append(s[~ok])
                whose.append(owner[~ok])
            offsets = np.searchsorted(np.concatenate(whose), np.arange(len(out) + 1)).astype(np.int32)
            columns = [list(c) for c in zip(*out)]
            yield batch(schema, [*columns[:7], pa.array(lg), *columns[7:], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rest)))])

    ddl = "nth long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, lg double, words array<binary>, times array<int>, strings array<long>"
    looked = materialize(rows.withColumn("nth", F.monotonically_increasing_id()).mapInArrow(run, ddl))
    n = F.col("n").cast("double")
    rare = looked.select("nth", F.explode(F.arrays_zip("words", "times")).alias("x")).select("nth", F.col("x.words").alias("word"), F.col("x.times").alias("times")).join(words, "word")
    by_word = rare.groupBy("nth").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).cast("long").alias("n_known"), F.sum(F.col("times") * (F.log10(n + 0.5) + least)).alias("base"))
    by_string = looked.select("nth", F.explode("strings").alias("s")).join(scores, "s").groupBy("nth").agg(F.sum("lg").alias("lg"))
    fixed = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long", "n_bytes": "long"}
    summed = {"n_known": "long", "base": "double", "lg": "double"}
    empty = lambda have: [F.lit(None).cast(t).alias(c) for c, t in (fixed | summed).items() if c not in have]
    every = looked.select("nth", *fixed, *summed)
    every = every.unionByName(by_word.select("nth", "n_known", "base", *empty(("n_known", "base")))).unionByName(by_string.select("nth", "lg", *empty(("lg",))))
    whole = every.groupBy("nth").agg(*[F.max(c).alias(c) for c in fixed], *[F.sum(c).alias(c) for c in summed])
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lg").alias("score"), (-F.col("lg") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte")
    )
