"""Packing documents into fixed windows by the sum-of-squares rule.

Every task packs the documents it reads, in one pass and without a shuffle. A document's
full windows are cut off first; what remains goes whole to the fill level that minimises the
sum over levels of the squared number of partly filled windows, kept in one level array.
Windows still open at the end of a task (or beyond ``max_open``) are completed by cutting
pieces of the emptiest ones into the fullest ones; the last is cut at powers of two, which
need no padding.

Defined results: null text packs as empty text (only the end id); a null doc_id is kept as
null; repeated rows are packed once each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, per_worker, slices, text_batches, text_or_empty

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


#: A full stop or comma after a letter and before a blank is a pre-token of its own.
PUNCTUATION = re.compile("(?<=[a-zA-Z])([.,])(?= )")


class WordEncoder:
    """Token ids of texts as little-endian bytes, by a word cache of two generations.

    The tokenizer lower-cases, and never joins across a blank or a line feed (its pre-tokenizer
    drops white space) or between a letter and punctuation, so a text's ids are those of its
    parts in turn. Texts that may hold special tokens keep their case.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.cache, self.older = Tokenizer.from_file(path), keep, {"": b""}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Words of letters alone are one pre-token each, so they are encoded in one go and cut at word ends."""
        cache, older = self.cache, self.older
        cache.update((w, older[w]) for w in words & older.keys())
        new = [w for w in words if w not in cache]
        plain = [w for w in new if w.isalpha()]
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = np.array(self._encode([" ".join(part)])[0], "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                cache.update(zip(part, (raw[a:z] for a, z in zip([0, *cuts], cuts))))
        odd = [w for w in new if w not in cache]
        cache.update((w, array("I", ids).tobytes()) for w, ids in zip(odd, self._encode(odd)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        lines = [t if "<|" in t else t.encode().lower().decode() for t in texts]
        parts = [PUNCTUATION.sub(r" \1", t.replace("\n", " ")).split(" ") for t in lines]
        self._learn(set().union(*parts).difference(self.cache))
        cache = self.cache
        ids = [b"".join([cache[w] for w in p]) for p in parts]
        if len(cache) > self.keep:
            self.older, self.cache = cache, {"": b""}
        return ids


def chunks(texts: list[str], chars: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) with about ``chars`` characters each."""
    first, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield first, texts[first : k + 1]
            first, n = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


class SumOfSquares:
    """Level array N[h]: how many open windows are filled to h."""

    def __init__(self, window: int):
        self.window, self.levels = window, np.zeros(window + 1, np.int64)

    def place(self, size: int) -> int:
        """The level to put ``size`` on (0: a new window); the array follows. Ties: the fullest."""
        n, w = self.levels, self.window
        rise = 2 * (n[size:] - n[: w - size + 1]) + 2
        rise[-1] -= 1  # a full window leaves the array
        rise[n[: w - size + 1] == 0] = np.iinfo(np.int64).max
        rise[0] = 2 * n[size] + 1 if size < w else 0
        h = w - size - int(np.argmin(rise[::-1]))
        if h:
            n[h] -= 1
        if h + size < w:
            n[h + size] += 1
        return h


def complete(windows: list[list], window: int) -> Iterator[list]:
    """Sequences from partly filled windows: the fullest are topped up with cuts of the emptiest.

    A piece is (doc_id, start, ids, doc_tokens). Every sequence but the last few is full; the
    rest of the last one is cut into powers of two.
    """
    size = lambda ps: sum(len(p[2]) for p in ps) // 4
    todo = sorted(windows, key=size)
    low, high, stock, now = 0, len(todo) - 1, [], []
    while low <= high or stock or now:
        if not now:
            if low <= high:
                now, high = todo[high], high - 1
            else:
                now, stock = stock, []
        room = window - size(now)
        while room > 0 and (stock or low <= high):
            if not stock:
                stock, low = todo[low][::-1], low + 1
            d, s, ids, n = stock.pop()
            take = min(room, len(ids) // 4)
            now = [*now, (d, s, ids[: 4 * take], n)]
            if take < len(ids) // 4:
                stock.append((d, s + take, ids[4 * take :], n))
            room -= take
        if room == 0:
            yield now
        else:
            left = window - room
            now = now[::-1]
            while left:
                part, want = [], 1 << (left.bit_length() - 1)
                left -= want
                while want:
                    d, s, ids, n = now.pop()
                    take = min(want, len(ids) // 4)
                    part.append((d, s, ids[: 4 * take], n))
                    if take < len(ids) // 4:
                        now.append((d, s + take, ids[4 * take :], n))
                    want -= take
                yield part
        now = []


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, max_open: int = 1024, cached_words: int = 300_000) -> DataFrame:
    """One row per piece: PIECES. A window or a document never crosses a task; ``cached_words`` trades memory for time only."""
    text_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("words", tokenizer, cached_words)
        encode, rule, count = per_worker(key, lambda: WordEncoder(tokenizer, cached_words)), SumOfSquares(window), 0
        base = TaskContext.get().partitionId() << 32
        opened: dict[int, list[list]] = {}
        out: list[tuple] = []

        def close(pieces: list) -> None:
            nonlocal count
            at = 0
            for d, s, ids, n in pieces:
                out.append((d, s, len(ids) // 4, zlib.crc32(ids), n, base + count, at))
                at += len(ids) // 4
            count += 1

        def flush() -> None:
            for ps in complete([x for xs in opened.values() for x in xs], window):
                close(ps)
            opened.clear()
            rule.levels[:] = 0

        def emit() -> pa.RecordBatch:
            b = batch(PIECES, [list(c) for c in zip(*out)])
            out.clear()
            return b

        n_open = 0
        for b in slices(batches, key=key):
            ids_of, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            for first, part in chunks(texts):
                for d, ids in zip(ids_of[first:], encode(part)):
                    ids += end
                    n, s = len(ids) // 4, 0
                    while n - s >= window:
                        close([(d, s, ids[4 * s : 4 * (s + window)], n)])
                        s += window
                    if s == n:
                        continue
                    h = rule.place(n - s)
                    pieces = opened[h].pop() if h else []
                    n_open += not h
                    pieces.append((d, s, ids[4 * s :], n))
                    if h + n - s == window:
                        close(pieces)
                        n_open -= 1
                    else:
                        opened.setdefault(h + n - s, []).append(pieces)
                    if n_open > max_open:
                        flush()
                        n_open = 0
                if len(out) >= 20_000:
                    yield emit()
        flush()
        if out:
            yield emit()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
