"""From documents to a training mix in five stages; each is written as Parquet and read again by the next.

Every stage keeps rows with null doc_id, takes repeated rows as they are, gives an empty result for an empty table and
ignores columns it doesn't know. Its intermediate tables lie in the shared folder and belong to the caller: results
read them lazily. ``run`` removes those of a stage once the stage's own output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import decontaminate, jaccard, langid, mixing, substrings
from annalist.llm.common import Scratch, bounded_batches, collected, remove, table


def _stage(f):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return f(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


@_stage
def language_id(spark, docs, sf_dir):
    """Learns from the rows with a language; drops rows whose language can't be told (null texts, texts without a letter)."""
    return langid.accepted(docs, langid.train(docs.where(~langid.held_out())))


@_stage
def near_duplicates(spark, docs, sf_dir):
    """Five words, similarity 0.8: of each group of linked documents the one of the smallest doc_id stays (ties, and groups
    without any doc_id: the smallest digest of the text).

    Rows without words link with nothing and stay. A document is a doc_id (null counts as one) and a text: rows that
    repeat both stay or go together, and of two texts under one doc_id each is judged by itself.
    """
    found = jaccard.jaccard_groups(docs, 5, (80, 100))
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("tk").eqNullSafe(F.col("first_tk"))
    gone = found.where(~stays).select(F.col("doc_id").alias("__gone_id"), F.col("tk").alias("__gone_tk")).distinct()
    keyed = docs.withColumn("__tk", jaccard.text_key(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (F.col("__tk") == F.col("__gone_tk"))
    return keyed.join(gone.hint("merge"), same, "left_anti").select(docs.columns)


@_stage
def substring_dedup(spark, docs, sf_dir):
    """Cuts runs of 50 words that an earlier document has; texts of which nothing is left go, null texts stay."""
    return substrings.remove_repeated(docs)


@_stage
def decontamination(spark, docs, sf_dir):
    """Drops documents that hold ten consecutive words of a benchmark item (or a shorter item whole); null texts stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def source_mix(spark, docs, sf_dir):
    """doc_id, source, size, source_size, target, taken: what the mix takes of every document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: Language ID can't be written in SQL; tests/llm holds all other stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    box = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with collected() as made:
            docs = box.save(stage(spark, docs, sf_dir), name)
        remove(spark, *made)
    return STAGES[-1][1](spark, docs, sf_dir)
