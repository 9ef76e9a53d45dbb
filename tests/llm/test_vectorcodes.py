"""Vector codes against plain rounds, bounds against full scans."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
from topicflow.llm import vectorcodes

COLUMNS = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows with code and error, by dimension, with Python's integers only."""
    out = []
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for dim in {len(v) for _, v, _ in kept}:
        own = [(i, v, label) for i, v, label in kept if len(v) == dim]
        w = -(-dim // parts)
        whole = lambda v: [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v] + [0] * (w * parts - len(v))
        cut = [[whole(v)[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in own]
        ids = sorted({i for i, _, _ in own}, key=lambda i: (i is None, i or 0))[:entries]
        first = [whole(min(v for i, v, _ in own if i == k)) for k in ids]
        books = [[f[p * w : (p + 1) * w] for f in first] for p in range(parts)]
        d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        nearest = lambda x, book: min(range(len(book)), key=lambda e: (d(x, book[e]), e))
        for _ in range(rounds):
            for p in range(parts):
                groups = defaultdict(list)
                for x in cut:
                    groups[nearest(x[p], books[p])].append(x[p])
                books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else entry for e, entry in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
        for (i, _, label), x in zip(own, cut):
            codes = [nearest(x[p], books[p]) for p in range(parts)]
            error = sum(d(x[p], books[p][c]) for p, c in enumerate(codes))
            out.append((i, "".join(f"{c:02x}" for c in codes), error, label, sha))
    sums = defaultdict(int)
    for _, _, e, label, _ in out:
        sums[label] += e
    long = lambda x: x if x < 2**63 else None
    broken = {label for _, _, e, label, _ in out if e >= 2**63}
    return sorted(((i, c, long(e), None if label in broken else long(sums[label]), s) for i, c, e, label, s in out), key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=str)


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([-0.25, 0.0, 0.125, rng.gauss(0, 0.3)]) for _ in range(16)], k % 5 or None) for k in range(400)]
    assert result(vectorcodes.report(spark.createDataFrame(rows, COLUMNS))) == plain(rows)


def test_nulls_ties_repeats_odd_dimensions_and_far_values(spark):
    rng = random.Random(2)
    vector = lambda n, scale: [rng.gauss(0, scale) for _ in range(n)]
    rows = [(k, vector(16, 1), k % 3) for k in range(60)] + [(k, vector(16, 1), 9) for k in range(10)] * 2 + [(None, vector(16, 1), None)] * 3
    rows += [(200 + k, vector(11, 1), 4) for k in range(40)] + [(300 + k, vector(3, 1), 5) for k in range(5)] + [(400, [], 5), (401, [], 6)]
    rows += [(500 + k, vector(24, s), 7 + (s > 1e9)) for k, s in enumerate([1, 1e4, 1e9, 1e15, 1e30, 1e300, 1.7e308] * 6)]
    rows += [(600, None, 1), (601, [None] * 16, 1), (602, [float("nan")] + [0.0] * 15, 1), (603, [float("inf")] + [0.0] * 15, 1), (604, [5.0] * 16, 1), (604, [5.0] * 16, 1)]
    frame = spark.createDataFrame([(*r, "u", 3.0, 0) for r in rows], COLUMNS + ", code string, upper double, dim int")
    want = plain(rows)
    assert result(vectorcodes.report(frame)) == want and any(e is None for _, _, e, _, _ in want)
    assert result(vectorcodes.report(spark.createDataFrame([], COLUMNS))) == []


def test_bounds_spare_scans_and_codes_decode(spark):
    centres = np.random.default_rng(3).normal(0, 4, (16, 32))
    rows = [(k, (centres[k % 16] + np.random.default_rng(k).normal(0, 0.05, 32)).tolist(), 0) for k in range(3000)]
    done = vectorcodes.compress(spark.createDataFrame(rows, COLUMNS))
    assert done.scanned[0] > 0.9 * 3000 * 8 and done.scanned[-1] < 0.05 * done.scanned[0]
    r = next(r for r in done.rows.collect() if r["vec_id"] == 77)
    off = np.array(done.codebooks.decode(32, r["code"])) - np.array(rows[77][1])
    assert abs((off**2).sum() - r["error"] / 4096**2) < 0.01 and abs(off).max() < 0.5


def test_bounds_never_hide_a_nearer_or_lower_entry():
    rng = np.random.default_rng(4)
    for case in range(30):
        n, k, w = 300, int(rng.integers(1, 17)), int(rng.integers(0, 5))
        spread = int(rng.choice([2, 6, 5000]))
        x = rng.integers(-spread, spread + 1, (n, w))
        entries = rng.integers(-spread, spread + 1, (k, w))
        code, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
        before = entries
        for _ in range(8):
            vectorcodes.reassign(x, entries, code, upper, lower, vectorcodes.moves(before, entries))
            assert (code == ((x[:, None] - entries[None]) ** 2).sum(-1).argmin(1)).all()
            before, entries = entries, entries + rng.integers(-1, 2, entries.shape) * (rng.random((k, 1)) < 0.4)
