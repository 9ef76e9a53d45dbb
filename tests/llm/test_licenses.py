"""Licence scans against plain searches of phrases and of every maximal common run."""

import random
import re

import pytest
from topicflow.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))]


def plain_places(text, phrases):
    own = plain_words(text)
    return sorted((i, label) for label, phrase in phrases.items() for w in [phrase.encode().split()] for i in range(len(own) - len(w) + 1) if own[i : i + len(w)] == w)


def plain_matches(text, template, least):
    """Every maximal common run, by trying all pairs of places."""
    out = set()
    for i in range(len(text)):
        for j in range(len(template)):
            if text[i] == template[j] and (i == 0 or j == 0 or text[i - 1] != template[j - 1]):
                n = 0
                while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, i + n - 1, j, j + n - 1))
    return out


def plain_chain(matches):
    """Most words covered by a chain: the best over all pairs, one after another."""
    done = []
    for first, last, low, high in sorted(matches, key=lambda m: m[1]):
        own = high - low + 1
        follow = [f + new for (a, b, c, d), f in done if b < last and d < high and (new := own - max(0, b - first + 1, d - low + 1)) > 0]
        done.append(((first, last, low, high), max([own, *follow])))
    return max(f for _, f in done)


@pytest.mark.parametrize("seed", range(40))
def test_matches_and_chains_equal_plain_search(seed):
    rng = random.Random(seed)
    alphabet = [f"w{k}" for k in range(rng.choice([2, 4, 9]))]
    line = lambda n: [rng.choice(alphabet).encode() for _ in range(n)]
    templates = {f"t{k}": b" ".join(line(rng.randint(1, 25))).decode() for k in range(4)}
    phrases = {f"p{k}": b" ".join(line(rng.randint(1, 3))).decode() for k in range(3)}
    scanner = licenses.Scanner(templates, phrases, least=3, gap=4)
    text = line(30) + [b"unknown"] + templates["t0"].encode().split() + line(5) + [b"zz"] * 6 + templates["t1"].encode().split()[2:] + line(20)
    places, matches = scanner.stream(text)
    assert sorted((i, scanner.labels[t]) for i, t in places) == plain_places(b" ".join(text).decode(), phrases)
    for t, template in enumerate(templates.values()):
        own = template.encode().split()
        want = plain_matches(text, own, min(3, len(own)))
        got = matches.get(t, [])
        assert len(got) == len(set(got)) and set(got) == want
        assert [m[1] for m in got] == sorted(m[1] for m in got)
    found = scanner.spans(text)[1]
    for t in range(len(templates)):
        groups, end = [], None
        for m in sorted(matches.get(t, []), key=lambda m: m[1]):
            if end is None or m[0] - end - 1 > 4:
                groups.append([])
            groups[-1].append(m)
            end = m[1]
        own = [x for x in found if x[0] == t]
        assert [x[5] for x in own] == [plain_chain(g) for g in groups]
        assert all(min(m[0] for m in g) <= first <= last <= max(m[1] for m in g) and 0 <= low <= high for (_, first, last, low, high, _), g in zip(own, groups))


@pytest.mark.parametrize("seed", range(30))
def test_a_chain_covers_the_most(seed):
    rng = random.Random(seed)
    matches = set()
    for _ in range(rng.randint(1, 12)):
        n, i, j = rng.randint(1, 6), rng.randint(0, 25), rng.randint(0, 14)
        matches.add((i, i + n - 1, j, j + n - 1))
    ordered = sorted(matches, key=lambda m: (m[1], m))
    first, last, low, high, covered = licenses.chain(ordered, 20)
    assert covered == plain_chain(ordered) and low <= high and first <= last


def test_words_are_those_of_the_pattern():
    text = "MIT-License, ÄÖ Straße_x9 ÀB\x7fc\x00d İ ok \U0001f600z"
    assert licenses.words(text) == plain_words(text)


def spans_of(spark, rows, **more):
    frame = spark.createDataFrame([(d, t, "en", 5, None) for d, t in rows], "doc_id long, text string, label string, n_words long, spans string")
    return {r["doc_id"]: r for r in licenses.report(frame, **more).collect()}


def test_labels_places_and_scores(spark):
    mit = licenses.TEMPLATES["mit"]
    edited = mit.replace("free of charge, ", "").replace("sublicense", "re-license").upper().replace(" ", "\n * ")
    rows = [
        (1, "Released under the MIT License. Not the MIT\tlicense; a general public, LICENSE!"), (2, "nothing here"), (3, None), (4, ""), (5, f"int main() {{}} // {edited} and more"), (6, "permission is hereby granted free of charge to whom"),
        (7, "Licensed under the Apache License, Version 2.0."), (8, "x" * 50 + " licensed under CC-BY-NC 4.0 " * 3000), (9, "mit apache license licence"), (None, "mit license"), (11, " ".join(["mit license"] * 5000)),
    ]
    got = spans_of(spark, rows)
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["labels"], got[1]["score"]) == (3, 3, 10, "gpl,mit", "gpl,mit", 1.0)
    assert all((got[k]["n_base"], got[k]["first_word"], got[k]["labels"], got[k]["score"]) == (0, None, "", 0.0) for k in (2, 3, 4)) and got[3]["n_words"] == 0
    assert got[5]["labels"] == "mit" and got[5]["base_labels"] == "" and 0.85 < got[5]["score"] < 1
    assert got[6]["labels"] == "" and 0 < got[6]["score"] < 0.2
    assert (got[7]["base_labels"], got[7]["labels"]) == ("apache", "apache")
    assert (got[8]["base_labels"], got[8]["labels"], got[8]["score"]) == ("", "cc-by-nc", 1.0)
    assert got[9]["labels"] == "apache" and got[None]["labels"] == "mit" and got[11]["n_base"] == 5000
    assert spans_of(spark, []) == {}


def test_every_document_s_base_equals_a_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in licenses.report(docs).collect():
        want = plain_places(texts[r["doc_id"]], licenses.PHRASES)
        starts = [i for i, _ in want]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(plain_words(texts[r["doc_id"]])), len(want), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in want})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
