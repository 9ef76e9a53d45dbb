"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton over the vocabulary finds every piece that ends at a position, the
longest first; dynamic programming carries the best score and the piece count. The rules are
those of the ``tokenizers`` library's Unigram model behind its Metaspace pre-tokenizer: a blank
becomes the word mark, which is put before the text as well and begins each part; of equal
scores the longest last piece stays (a later candidate must be strictly better); a character
that is no piece of its own costs the lowest score less 10 and counts its UTF-8 bytes.
Parts are scored once and cached, so a text costs a look-up per word.

Defined results: null and empty texts have no tokens and score 0; a null doc_id is kept;
repeated rows give a row each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, slices, text_batches, text_or_empty

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(model: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's ordinary and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]


class Counter:
    """(score, pieces) of whole texts."""

    def __init__(self, pieces: list[tuple[str, float]], keep: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytewise = all(f"<0x{i:02X}>" in self.automaton for i in range(256))
        self.cut_lines = not any("\n" in p for p, _ in pieces)  # then a line feed is a token apart
        self.keep, self.cache, self.rest = keep, {}, {}

    def part(self, s: str) -> tuple[float, int]:
        """Viterbi over one part; unknown characters are fused unless they fall to bytes."""
        n = len(s)
        score, count, last_unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, value in self.automaton.iter(s):
            ends[end].append(value)
        for end in range(n):
            best, single = None, False
            for size, points in ends[end]:
                single |= size == 1
                candidate = score[end + 1 - size] + points
                if best is None or candidate > best:
                    best, at = candidate, end + 1 - size
            unknown = False
            if not single:
                candidate = score[end] + self.unknown
                if best is None or candidate > best:
                    best, at, unknown = candidate, end, True
            score[end + 1] = best
            last_unknown[end + 1] = unknown
            step = (len(s[end].encode("utf-8", "surrogatepass")) if self.bytewise else 0 if last_unknown[at] else 1) if unknown else 1
            count[end + 1] = count[at] + step
        return score[n], count[n]

    def _look(self, s: str, cache: dict, mark: str) -> tuple[float, int]:
        got = cache.get(s)
        if got is None:
            if len(cache) > self.keep:
                cache.clear()
            got = cache[s] = self.part(mark + s)
        return got

    def __call__(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        text = text.replace(" ", MARK)
        parts = (text[1:] if text[0] == MARK else text).split(MARK)
        score, count = 0.0, 0
        for p in parts:
            head, *lines = p.split("\n") if self.cut_lines and self.bytewise and "\n" in p else (p,)
            s, c = self._look(head, self.cache, MARK)
            score, count = score + s, count + c
            for x in lines:
                s, c = self._look(x, self.rest, "") if x else (0.0, 0)
                score, count = score + s + self.unknown, count + c + 1
        return score, count


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_chars, best_score for every row."""
    text_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_chars", pa.int64()), ("best_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(model))
        for b in slices(batches):
            texts = b["text"].to_pylist()
            found = [counter(t) for t in texts]
            yield batch(schema, [b["doc_id"], [c for _, c in found], [len(t) for t in texts], [s for s, _ in found]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_chars long, best_score double")
