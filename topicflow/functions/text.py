"""Text expressions on columns."""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def dedupe_key(url: Column) -> Column:
    """Key under which two addresses are the same."""
    return F.lower(F.regexp_replace(strip(url), "/+$", ""))


def html_to_text(html: Column) -> Column:
    """Visible text, a line per text node: scripts, styles, comments and tags out, entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]*\n\s*", "\n"), r"^\n|\n$", "")


def outermost_object(reply: Column) -> Column:
    """From the first opening brace to the last closing one."""
    return F.regexp_extract(reply, r"(?s)(\{.*\})", 1)


#: What a JSON value may begin with, and what may follow a backslash.
JSON_BEGINNINGS = '"[{-0123456789tfn'
JSON_ESCAPES = r'"\\/bfnrtu'


def with_opening_quotes(json: Column) -> Column:
    """A line's value that lost its opening quote gets it back: it begins like no JSON value and ends in the line's one further quote."""

    def mended(line: Column) -> Column:
        at = F.instr(line, '":') + 1  # the colon after the name
        name, value = F.trim(F.substring(line, F.lit(1), at - 1)), F.ltrim(F.substring(line, at + 1, F.length(line)))
        quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
        bare = ~F.lit(JSON_BEGINNINGS).contains(F.left(value, F.lit(1))) & (quotes == 1) & F.rtrim(F.regexp_replace(F.rtrim(value), ",$", "")).endswith('"')
        return F.when((at > 1) & name.rlike('^"\\w+"$') & (value != "") & bare, F.concat(F.substring(line, F.lit(1), F.length(line) - F.length(value)), F.lit('"'), value)).otherwise(line)

    return F.array_join(F.transform(F.split(json, "\n"), mended), "\n")


def without_bad_escapes(json: Column) -> Column:
    """Pairs of a backslash and what may follow it stay, pair by pair; other backslashes go."""
    return F.regexp_replace(json, rf"(\\[{JSON_ESCAPES}])|\\", "$1")


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """Known aliases by their lower-case form, other names stripped, blank ones null."""
    clean = strip(name)
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.when(clean == "", None).otherwise(F.coalesce(F.element_at(known, F.lower(clean)), clean))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many keywords the lower-cased text contains."""
    low = F.lower(text)
    return sum((F.when(low.contains(k), 1).otherwise(0) for k in keywords), F.lit(0)).cast("long")


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template's {{names}} filled from columns (null: nothing); a name without a column raises."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    if missing := set(parts[1::2]) - set(values):
        raise KeyError(f"template variables without a value: {sorted(missing)}")
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def tagged_part(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>, stripped; empty if there is no such part."""
    return strip(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def without_echo(sections: Column, heading: Column, paragraphs: Column) -> Column:
    """Sections (heading, paragraphs) other than those that repeat the insight's heading or paragraphs."""
    return F.filter(sections, lambda s: ~(s["heading"].eqNullSafe(heading) | s["paragraphs"].eqNullSafe(paragraphs)))


def one_of(value: Column, allowed: list[str], otherwise: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(otherwise)


def mapped_characters(c: Column, table: dict[str, str], keep: str = "") -> Column:
    """Characters exchanged one by one, those in ``keep`` left alone."""
    pairs = [(a, b) for a, b in table.items() if a not in keep]
    return F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def retry_seconds(message: Column) -> Column:
    """Seconds that a refusal asks to wait ("try again in 6m26.2s"); null if it names none."""
    wait = F.regexp_extract(F.lower(message), "try again in ([0-9ms.]+)", 1)
    minutes = F.when(wait.contains("m"), F.substring_index(wait, "m", 1).cast("double")).otherwise(0.0)
    return 60 * minutes + F.nullif(F.regexp_extract(wait, "([0-9.]+)s", 1), F.lit("")).cast("double")


@F.pandas_udf(StringType())
def flattened(value: pd.Series) -> pd.Series:
    """All texts inside a JSON value in document order, blank-joined; numbers and flags have none, broken JSON gives null."""

    def texts(v) -> str:
        if isinstance(v, str):
            return v
        return " ".join(texts(x) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()))

    def read(s: str | None) -> str | None:
        try:
            return None if s is None else texts(json.loads(s))
        except ValueError:
            return None

    return value.map(read)


def bag_vector(content: Column, dims: int = 64, chars: int | None = None) -> Column:
    """A stand-in embedding without a model: words hashed to signed places, of length one (zeros for no words); of the whole text, or its first ``chars``."""

    @F.pandas_udf("array<double>")
    def signed(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def hashed(word: str) -> int:
            if (h := known.get(word)) is None:
                h = known[word] = int(hashlib.md5(word.encode()).hexdigest()[:4], 16)
            return h

        def vector(words: str | None) -> list[float]:
            out = [0] * dims
            for w in (words or "").split(" "):
                if w:
                    h = hashed(w)
                    out[(h >> 1) % dims] += 1 - 2 * (h & 1)
            size = math.sqrt(sum(x * x for x in out))
            return [x / size if size else 0.0 for x in out]

        return texts.map(vector)

    # Spark lower-cases and finds the blanks
    return signed(F.regexp_replace(F.lower(content if chars is None else F.left(content, F.lit(chars))), r"\s+", " "))
