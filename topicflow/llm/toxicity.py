"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits that stand for letters) and cut into words. The
lexicon holds whole words and word beginnings whose share of toxic training documents stands
out; a term's weight is its log odds. One Aho-Corasick automaton finds the terms and the
exception phrases (a term with a neighbouring word that is no likelier in toxic documents than
in others); terms inside an exception phrase do not count, and of several at one word the longest
does. The sum of weights over the length goes through a logistic curve fitted to the training rows.

Training uses at most ``max_rows`` labelled rows (those of least hash of doc_id) and keeps at most
``max_terms`` terms and as many phrases, those of most weight, which bounds the lexicon's cost at any
size; scoring covers every row and text. Labels, lang, source and
doc_id are no inputs of a score.

Defined results: null and empty texts have no terms and get the score of a text without terms;
a null doc_id is scored; several labels of one id count as toxic if one is; repeated rows give
a row each; without toxic or without other training rows all scores are their share (an empty
training set: 0); further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, slices, text_batches, text_or_empty

# Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "ν": "v", "υ": "u", "τ": "t", "κ": "k", "ı": "i", "ɑ": "a", "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
TABLE = str.maketrans(HOMOGLYPHS | DIGITS | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF21 + k): chr(97 + k) for k in range(26)})
NO_WORD = re.compile(r"\W+")
BEGINNINGS = (4, 5, 6)


def folded(text: str) -> str:
    """Words between single blanks, with a blank at both ends."""
    return f" {NO_WORD.sub(' ', text.lower().translate(TABLE)).strip()} "


class Lexicon:
    """Terms like " idiot " or " idio" with weights, and phrases that except them."""

    def __init__(self, terms: dict[str, float], exceptions: frozenset[str] = frozenset()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t in exceptions:
            self.automaton.add_word(t, (len(t), None))
        for t, w in terms.items():
            self.automaton.add_word(t, (len(t), w))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def hits(self, line: str) -> dict[int, float]:
        """Start of the word: weight of its longest term, but for excepted ones."""
        best: dict[int, tuple[int, float]] = {}
        free: list[tuple[int, int]] = []
        if self.any:
            for end, (size, weight) in self.automaton.iter(line):
                start = end + 1 - size
                if weight is None:
                    free.append((start, end))
                elif start not in best or size > best[start][0]:
                    best[start] = (size, weight)
        kept: dict[int, float] = {}
        free.sort()
        k = reach = 0  # both by start: an exception that begins no later covers a word if it ends after its start
        for s in sorted(best):
            while k < len(free) and free[k][0] <= s:
                reach, k = max(reach, free[k][1]), k + 1
            if s >= reach:
                kept[s] = best[s][1]
        return kept

    def measure(self, text: str) -> float:
        """log1p of the weights per hundred words (20 more, so that one word is no sentence)."""
        line = folded(text)
        total = sum(self.hits(line).values())
        return math.log1p(100 * total / (line.count(" ") - 1 + 20)) if total > 0 else 0.0


def _terms(line: str) -> set[str]:
    words = set(line.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) >= k}


def _phrases(line: str, lexicon: Lexicon) -> set[str]:
    out = set()
    for s in lexicon.hits(line):
        e = line.index(" ", s + 1)
        before, after = line.rfind(" ", 0, s), line.find(" ", e + 1)
        if before >= 0:
            out.add(line[before : e + 1])
        if after >= 0:
            out.add(line[s : after + 1])
    return out


def _counted(rows: DataFrame, features) -> DataFrame:
    """(term, toxic, other): how many of ``rows`` (text, toxic) have each feature."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def emit() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            b = batch(schema, [terms, [counts[1][t] for t in terms], [counts[0][t] for t in terms]])
            for c in counts:
                c.clear()
            return b

        for b in slices(batches):
            for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                counts[y].update(features(folded(text)))
                if len(counts[0]) + len(counts[1]) > 120_000:
                    yield emit()
        if counts[0] or counts[1]:
            yield emit()

    return rows.mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _pruned(terms: dict[str, float]) -> dict[str, float]:
    """Without terms that a shorter beginning covers at about the same weight."""
    out: dict[str, float] = {}
    for t in sorted(terms, key=len):
        cover = max((out[t[:k]] for k in range(2, len(t)) if t[:k] in out), default=None)
        if cover is None or terms[t] > cover + 0.5:
            out[t] = terms[t]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton steps over cells with ``n`` rows."""
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p) + 1e-12
        g0, g1 = (n * (y - p)).sum() - ridge * a, (n * (y - p) * x).sum() - ridge * b
        h00, h01, h11 = w.sum() + ridge, (w * x).sum(), (w * x * x).sum() + ridge
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 5 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


class Model:
    def __init__(self, terms: dict[str, float], exceptions: frozenset[str], intercept: float, slope: float):
        self.terms, self.exceptions, self.intercept, self.slope = terms, exceptions, intercept, slope


def held_out(folds: int = 3):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, max_terms: int = 4096, min_support: int = 5, min_weight: float = 1.5, min_z: float = 5.0, folds: int = 3) -> Model:
    """A model of the rows outside the held-out fold. The driver gets at most ``max_terms`` terms and phrases."""
    text_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded, so it may be broadcast
    rows = materialize(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic"))
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model({}, frozenset(), math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0)
    p1, p0 = F.col("toxic") / n1, F.col("other") / n0
    pool = (F.col("toxic") + F.col("other")) / (n0 + n1)
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("other") + 0.5) / (n0 + 1))
    z = (p1 - p0) / F.sqrt(F.greatest(pool * (1 - pool), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    chosen = _counted(rows, _terms).withColumn("w", weight).filter((F.col("toxic") >= min_support) & (F.col("w") >= min_weight) & (z >= min_z))
    terms = _pruned({r["term"]: r["w"] for r in chosen.orderBy(F.desc(F.col("toxic") * F.col("w")), "term").limit(max_terms).collect()})
    plain = Lexicon(terms)
    spare = _counted(rows, lambda line: _phrases(line, _cached(plain, terms))).filter((F.col("other") >= min_support) & (p1 <= p0)) if terms else None
    exceptions = frozenset(r["term"] for r in spare.orderBy(F.desc("other"), "term").limit(max_terms).collect()) if terms else frozenset()

    schema = pa.schema([("cell", pa.int32()), ("toxic", pa.int32())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, exceptions)
        for b in slices(batches):
            yield batch(schema, [[min(999, int(100 * lexicon.measure(t))) for t in b["text"].to_pylist()], b["toxic"]])

    table = rows.mapInArrow(cells, "cell int, toxic int").groupBy("cell").agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).collect()  # 1,000 rows at most
    x, n, y = (np.array([r[c] for r in table], float) for c in ("cell", "n", "y"))
    a, b = _logistic((x + 0.5) / 100 * (x > 0), y / n, n)
    return Model(terms, exceptions, a, max(b, 0.0))


def _cached(lexicon: Lexicon, terms: dict[str, float]) -> Lexicon:
    return lexicon if lexicon.any or not terms else Lexicon(terms)


def score(docs: DataFrame, model: Model, at: float = 0.7, folds: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    text_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    terms, exceptions, a, s = model.terms, model.exceptions, model.intercept, model.slope

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, exceptions)
        for b in slices(batches):
            x = np.array([lexicon.measure(t) for t in b["text"].to_pylist()])
            y = 1 / (1 + np.exp(-np.clip(a + s * x, -30, 30)))
            yield batch(schema, [b["doc_id"], b["held_out"], pa.array(y), pa.array((y >= at).astype(np.int32))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, at: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``at`` or more, all columns kept."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, limit = Lexicon(terms, exceptions), math.log(at / (1 - at))
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([a + s * lexicon.measure(t or "") < limit for t in texts]))

    terms, exceptions, a, s = model.terms, model.exceptions, model.intercept, model.slope
    return docs.mapInArrow(run, docs.schema)
