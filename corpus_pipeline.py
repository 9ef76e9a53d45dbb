"""A corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage gets what the one before kept and decides on all of it, row by row: rows that share an id, or
have none, are decided by their own texts. Near duplicates are SimHash's proposals that exact
similarity confirms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.llm import decontam, nearcopies, packing, secrets, toxicity
from topicflow.llm.common import materialize, removed, scratch, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; learnt from those still here that have labels."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; rows without an id come last."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]  # apart, so that no name of theirs meets one of the operator's
    held = [F.struct(*rest).alias("rest")] if rest else []
    keyed = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("nth"), *held))
    return nearcopies.one_of_each(keyed).select(*[F.col("rest").getField(c).alias(c) if c in rest else c for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=100_000)  # other stages need memory too


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each), ("decontamination", drop_contaminated), ("secrets", hide_secrets), ("packing", pack)]

#: Fingerprints, learnt lexica and tokenizers are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:  # what a stage wrote on its way goes once its result is written, and so does the result before
            made, folder = written(stage(spark, docs, sf_dir))
            kept.append(folder)
        if last:
            removed(spark, last)
        docs, last = made, folder
    return STAGES[-1][1](spark, docs, sf_dir)
