"""What model replies mean: one schema an operator, broken replies as rows with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import outermost_object, with_opening_quotes, without_bad_escapes

#: What each operator's reply holds.
SCHEMAS = {
    "tags": "content_mode string, is_ai_related boolean, is_case_example boolean, case_industry string, case_department string, case_outcome string, tech_tags array<string>, entity_tags array<string>, scenario_tags array<string>, industry_tags array<string>, one_line_summary string",
    "release": "is_release boolean, vendor string, product string, release_kind string, reason string",
    "scores": "module_scores map<string,struct<score:double,reason:string>>, content_type string",
    "same": "same boolean, reason string",
    "triples": "triples array<struct<subject:string,subject_type:string,relation:string,object:string,object_type:string>>",
    "article": "headline_candidates array<string>, chosen_headline string, sections array<struct<heading:string,paragraphs:array<string>>>, delta_insight struct<paragraphs:array<string>>, card_summary struct<text:string>",
    "review": "fact_claims array<struct<claim:string,verdict:string,evidence:string>>, style_violations array<string>, sensitivity_flags array<string>, coherence_check struct<headline_matches_body:boolean,single_subject:boolean,unrelated_sources:array<string>>, tone_score double, revision_instructions string",
    "comment": "comment string, delta_insight string",
    "headline": "headline string",
}
#: Fields without which a reply is of no use.
NEEDED = {"tags": ["one_line_summary"], "release": ["is_release"], "scores": ["module_scores", "content_type"], "same": ["same"], "triples": ["triples"], "article": ["chosen_headline", "sections"], "review": ["fact_claims"], "comment": ["comment"], "headline": ["headline"]}


def read(rows: DataFrame, kind: str, reply: str = "reply", modules: list[str] | None = None) -> DataFrame:
    """``rows`` with ``value`` (the kind's struct or null) and ``error``: no_object, bad_json, missing_fields, missing_modules or null."""
    schema = F.lit(SCHEMAS[kind])
    options = {"allowUnquotedControlChars": "true"}
    found = outermost_object(F.col(reply))
    raw = F.from_json(found, schema, options)
    mended = F.from_json(without_bad_escapes(with_opening_quotes(found)), schema, options)
    broken = lambda v: F.forall(F.array(*[v[c].isNull() for c in [f.split()[0] for f in _fields(kind)]]), lambda x: x)
    value = F.when(broken(raw), mended).otherwise(raw)
    out = rows.withColumn("value_", value)
    missing = F.lit(False)
    for c in NEEDED[kind]:
        missing = missing | F.col("value_")[c].isNull()
    lacking = F.lit(False)
    if kind == "scores" and modules:
        lacking = F.size(F.array_except(F.array(*map(F.lit, modules)), F.map_keys(F.col("value_")["module_scores"]))) > 0
    error = F.when(F.coalesce(found, F.lit("")) == "", "no_object").when(broken(F.col("value_")), "bad_json").when(missing, "missing_fields").when(lacking, "missing_modules")
    return out.withColumn("error", error).withColumn("value", F.when(F.col("error").isNull(), F.col("value_"))).drop("value_")


def _fields(kind: str) -> list[str]:
    """Top-level fields of a schema."""
    out, depth, part = [], 0, ""
    for c in SCHEMAS[kind] + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return out


def coherent(review: Column) -> Column:
    """False where the check finds a headline beside the body, several subjects or sources that do not belong; without a check, true."""
    check = review["coherence_check"]
    against = check["headline_matches_body"].eqNullSafe(F.lit(False)) | check["single_subject"].eqNullSafe(F.lit(False)) | (F.coalesce(F.size(check["unrelated_sources"]), F.lit(0)) > 0)
    return ~against


def confidence(review: Column) -> Column:
    """0.6 of the supported claims' share (1 without claims), 0.2 for style (half if violated), 0.2 without sensitive flags; 0.4 at most if incoherent."""
    claims = F.coalesce(review["fact_claims"], F.array().cast("array<struct<claim:string,verdict:string,evidence:string>>"))
    share = F.when(F.size(claims) == 0, 1.0).otherwise(F.size(F.filter(claims, lambda c: c["verdict"] == "supported")) / F.size(claims))
    none = lambda c: F.coalesce(F.size(review[c]), F.lit(0)) <= 0
    score = 0.6 * share + 0.2 * F.when(none("style_violations"), 1.0).otherwise(0.5) + 0.2 * F.when(none("sensitivity_flags"), 1.0).otherwise(0.0)
    return F.when(coherent(review), score).otherwise(F.least(score, F.lit(0.4)))
