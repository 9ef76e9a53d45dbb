"""Secrets in texts: three fixed patterns and strings of high sliding-window entropy.

DataFrame functions only, no shuffle. Positions come from a pattern's pieces: ``split`` gives
the text between matches and ``regexp_extract_all`` the matches, so running sums of their
lengths place every match in code points.

A candidate string is a run of at least ``window`` base64 or hexadecimal characters that mixes
letters and digits. A window slides over it with a count per character; leaving and entering
characters change the sum of c*log2(c), from which the window's entropy follows. A string is
reported if one window reaches the limit of its class (hexadecimal, or base64), unless an
allow-list pattern matches it or a span of the fixed patterns already covers it.

Defined results: null and empty texts have no spans; a null doc_id is kept; repeated rows
give a row each; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The three patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # at least 16 in all; a shorter run can hold no later match that is long enough
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Strings that look random and are harmless: UUIDs, counting sequences, documented samples.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)0123456789|abcdefghij",
    r"(?i)example|sample|placeholder|changeme",
)
SPAN = "array<struct<s:int,e:int,k:int>>"


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x))


def _places(pieces: Column, matches: Column, part: int = 64) -> Column:
    """Array of (s, e) per match from the lengths of what lies between and of the matches.

    An array that grows is copied at every step, so matches are placed by parts of ``part``, whose
    beginnings are summed first.
    """
    pair = lambda p, m: F.struct(p.alias("p"), m.alias("m"))
    none = F.array().cast("array<array<struct<p:int,m:int>>>")
    parts = lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x), F.lit(part)), lambda k: F.slice(x, k, F.lit(part)))).otherwise(none)
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v["p"] + v["m"])

    def begun(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + total(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias("x")))).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["p"]
        e = s + x["m"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,x:array<struct<p:int,m:int>>>>").alias("out"))
    placed = F.aggregate(parts(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, pair)), start, begun, lambda acc: acc["out"])
    empty = F.array().cast("array<struct<s:int,e:int>>")
    return F.flatten(F.transform(placed, lambda g: F.aggregate(g["x"], F.struct(g["at"].alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))


def _entropy_sum(s: Column, window: int) -> Column:
    """Least sum of c*log2(c) over the windows of string ``s``; entropy is log2(window) - sum/window."""
    chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)))
    letters = F.array_distinct(chars)
    plogp = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    coded = F.transform(chars, lambda c: F.array_position(letters, c).cast("int"))

    def over(x: Column) -> Column:
        ids, n = x["ids"], x["n"]
        first = F.transform(F.sequence(F.lit(1), n), lambda k: F.size(F.filter(F.slice(ids, 1, window), lambda v: v == k)))
        total = F.aggregate(first, F.lit(0.0), lambda a, c: a + plogp(c))

        def slide(acc: Column, i: Column) -> Column:
            out, new = F.get(ids, i - window), F.get(ids, i)
            c_out, c_new = F.get(acc["cnt"], out - 1), F.get(acc["cnt"], new - 1)
            moved = acc["sum"] - plogp(c_out) + plogp(c_out - 1) - plogp(c_new) + plogp(c_new + 1)
            total = F.when(out == new, acc["sum"]).otherwise(moved)
            cnt = F.transform(acc["cnt"], lambda c, k: c - F.when(k == out - 1, 1).otherwise(0) + F.when(k == new - 1, 1).otherwise(0))
            return F.struct(cnt.alias("cnt"), total.alias("sum"), F.least(acc["least"], total).alias("least"))

        later = F.when(F.size(ids) > window, F.sequence(F.lit(window), F.size(ids) - 1)).otherwise(F.array().cast("array<int>"))
        begin = F.transform(F.array(F.struct(first.alias("cnt"), total.alias("sum"))), lambda b: F.struct(b["cnt"].alias("cnt"), b["sum"].alias("sum"), b["sum"].alias("least")))
        return F.aggregate(later, F.get(begin, F.lit(0)), slide, lambda acc: acc["least"])

    return F.get(F.transform(F.array(F.struct(coded.alias("ids"), F.size(letters).alias("n"))), over), F.lit(0))


def find(docs: DataFrame, window: int = 20, hex_bits: float = 3.0, base64_bits: float = 3.6, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``doc`` (a row of ``docs`` whole, so that no name of its columns matters), ``text_`` (null: empty), ``base_`` and ``spans_``: (s, e, k) by start, then kind (index in KINDS)."""
    candidate = rf"[A-Za-z0-9+/_=-]{{{window},}}"
    both = rf"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{window}}}"
    none = F.array().cast("array<int>")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_or_empty().alias("text_"))
    for name, pattern, probe in (("assign", ASSIGN, ASSIGN), ("access", ACCESS, "AKIA"), ("hex", HEX, HEX), ("entropy", candidate, both)):
        hit = F.col("text_").contains(probe) if name == "access" else F.col("text_").rlike(probe)
        df = df.withColumn(f"hit_{name}", hit)
        df = df.withColumn(f"p_{name}", F.when(F.col(f"hit_{name}"), _lengths(F.split("text_", pattern, -1))).otherwise(none))
        df = df.withColumn(f"t_{name}", F.when(F.col(f"hit_{name}"), F.regexp_extract_all("text_", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        df = df.withColumn(f"m_{name}", _places(F.col(f"p_{name}"), _lengths(F.col(f"t_{name}"))))
    df = df.withColumn("g_assign", F.when(F.col("hit_assign"), _lengths(F.regexp_extract_all("text_", F.lit(ASSIGN), F.lit(2)))).otherwise(none))

    def kind(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k")))

    assign = F.filter(F.zip_with("m_assign", "g_assign", lambda m, g: F.struct(m["s"].alias("s"), m["e"].alias("e"), g.alias("g"))), lambda x: x["g"] >= 8)
    df = df.withColumn("base_", F.array_sort(F.concat(kind(0, assign), kind(1, F.col("m_access")), kind(2, F.col("m_hex"))), _by_start))

    def random_enough(x: Column) -> Column:
        t = x["t"]
        mixed = t.rlike("[0-9]") & t.rlike("[A-Za-z]")
        fresh = ~F.exists("base_", lambda b: (b["s"] <= x["m"]["s"]) & (b["e"] >= x["m"]["e"]))
        harmless = F.lit(False)
        for a in allowed:
            harmless = harmless | t.rlike(a)
        bits = F.when(t.rlike("^[0-9a-fA-F]+$"), F.lit(hex_bits)).otherwise(F.lit(base64_bits))
        entropy = F.log2(F.lit(float(window))) - _entropy_sum(t, window) / float(window)
        return F.when(mixed & fresh & ~harmless, entropy >= bits).otherwise(F.lit(False))

    found = F.filter(F.zip_with("m_entropy", "t_entropy", lambda m, t: F.struct(m.alias("m"), t.alias("t"))), random_enough)
    df = df.withColumn("added_", kind(3, F.transform(found, lambda x: x["m"])))
    df = df.withColumn("spans_", F.array_sort(F.concat("base_", "added_"), _by_start))
    return df.select("doc", "text_", "base_", "spans_")


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, **params) -> DataFrame:
    """The spans of every document in the contract's columns."""
    df = find(docs.select("doc_id", "text"), **params)
    count = lambda k: F.size(F.filter("base_", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return df.select("doc.doc_id", count(0), count(1), count(2), F.sha2(written(F.col("base_")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans_")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **params) -> DataFrame:
    """``docs`` with every span (overlaps merged) replaced by ``mark`` and n_chars renewed; all rows stay."""
    df = find(docs, **params)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col("text_"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    tail = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text_"), acc["at"] + 1, F.length("text_")))
    own = lambda c: F.col("doc").getField(c)
    found = F.size("spans_") > 0
    clean = df.select("doc", "spans_", F.when(found, F.aggregate("spans_", start, step, tail)).otherwise(own("text")).alias("clean_"))
    new = {"text": F.col("clean_"), "n_chars": F.when(found, F.length("clean_").cast("long")).otherwise(own("n_chars")) if "n_chars" in docs.columns else None}
    return clean.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])
