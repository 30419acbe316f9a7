"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.llm.common import Scratch, table


def word_count(text: str = "text") -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    bare = F.expr(f"btrim({text}, ' \\t\\n\\u000B\\u000C\\r')")  # SQL has no \f: that is the letter
    return F.when(F.col(text).isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, r"[ \t-\r]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """Per source: its words, its weight and its target after resharing what exceeds ``cap`` times its words.

    ``sizes`` has a row per source (``source``, ``words``). Sources take ``weights`` in turn, ordered by code
    point with null last. Water-filling has a closed form: in the order of cap/weight the capped sources are a
    prefix, and the first source whose cap is not below the level left by those before it fixes the level. All
    sums are integers, so a target is one division and ``floor_words`` is exact. Rows are sources, never documents.
    """
    num, den = share
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*map(F.lit, weights)), ((n - 1) % len(weights) + 1).cast("int"))
    src = sizes.withColumn("weight", pick.cast("long")).withColumn("cap_words", F.col("words") * cap)
    by_ratio = W.orderBy((F.col("cap_words") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    src = (
        src.withColumn("k", F.row_number().over(by_ratio))
        .withColumn("capped", F.coalesce(F.sum("cap_words").over(before), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("all_words", F.sum("words").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("num", num * F.col("all_words") - den * F.col("capped"))
        .withColumn("den", den * (F.col("all_weight") - F.col("used")))
    )
    level = F.min(F.when(F.col("cap_words") * F.col("den") >= F.col("weight") * F.col("num"), F.struct("k", "num", "den"))).over(everything)
    src = src.withColumn("level", level)
    free = F.col("level").isNotNull() & (F.col("k") >= F.col("level.k"))
    exact = F.col("weight") * F.col("level.num")
    return src.select(
        "source", "words", "weight",
        F.when(free, exact / F.col("level.den")).otherwise(F.col("cap_words").cast("double")).alias("target"),
        F.when(free, F.expr("weight * level.num div level.den")).otherwise(F.col("cap_words")).alias("floor_words"),
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share=(3, 2), cap: int = 2, digits: int = 4) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    Random order: md5 of doc_id, then doc_id, then size; repeated rows with equal keys are interchangeable.
    A source's target holds whole epochs (each takes every document whole) and a rest, for which the documents
    in random order are taken until the budget is exact: the document on the cut gives only its first words.
    The prefix sums are distributed: keys are uniform, so their first ``digits`` hex digits range-sort a source
    into even buckets; bucket totals (at most 16^digits a source) get prefix sums, then each bucket sums on. Sources are
    named categories: their totals, a row each, are sorted in one task.
    Null text counts 0 words, null source is a source of its own, an empty table gives an empty result;
    columns besides the three are ignored. ``taken`` never exceeds ``cap`` times ``size``.
    """
    spark = docs.sparkSession
    box = Scratch(spark, "mix")
    base = box.save(
        docs.select("doc_id", "source", word_count().alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"))
        .withColumn("bucket", F.substring("key", 1, digits)),
        "sizes",
    )
    buckets = box.save(base.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    plan = targets(buckets.groupBy("source").agg(F.sum("words").alias("words")), weights, share, cap)
    # prefix sums in two levels, so that no task holds more than 16^(digits / 2) buckets of a source
    buckets = buckets.withColumn("head", F.substring("bucket", 1, digits // 2))
    heads = buckets.groupBy("source", "head").agg(F.sum("words").alias("words"))
    of_heads = W.partitionBy("source").orderBy("head").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(F.col("source").alias("hs"), F.col("head").alias("hh"), F.coalesce(F.sum("words").over(of_heads), F.lit(0)).alias("base"))
    ahead = W.partitionBy("source", "head").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.withColumn("inner", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(heads, F.col("source").eqNullSafe(F.col("hs")) & (F.col("head") == F.col("hh")))
    starts = starts.select("source", "bucket", (F.col("base") + F.col("inner")).alias("start"))
    starts = starts.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = box.save(starts.withColumnsRenamed({"source": "s", "bucket": "b"}), "starts")
    rows = base.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("words") == 0, F.lit(0)).otherwise(F.expr("floor_words div words"))
    rest = F.col("floor_words") - epochs * F.col("words")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    return rows.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM base GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM src),
o AS (SELECT *, row_number() OVER r AS k, coalesce(sum(2 * words) OVER b, 0) AS capped, coalesce(sum(weight) OVER b, 0) AS used,
             sum(words) OVER () AS t, sum(weight) OVER () AS tw
      FROM w WINDOW r AS (ORDER BY 2.0 * words / weight, source ASC NULLS LAST),
                    b AS (ORDER BY 2.0 * words / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, CAST(3 * t - 2 * capped AS BIGINT) AS num, CAST(2 * (tw - used) AS BIGINT) AS den FROM o),
l AS (SELECT k AS lk, num AS ln, den AS ld FROM lv WHERE 2 * words * den >= weight * num ORDER BY k LIMIT 1),
tg AS (SELECT source, words, CASE WHEN k >= lk THEN CAST(weight * ln AS DOUBLE) / ld ELSE CAST(2 * words AS DOUBLE) END AS target,
              CASE WHEN k >= lk THEN (weight * ln) // ld ELSE 2 * words END AS fw
       FROM lv LEFT JOIN l ON true),
r AS (SELECT b.*, tg.words, tg.target, CASE WHEN tg.words = 0 THEN 0 ELSE fw // tg.words END AS e, fw,
             coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM base b JOIN tg ON b.source IS NOT DISTINCT FROM tg.source)
SELECT doc_id, size, words AS source_size, target,
       CAST(e * size + greatest(0, least(size, fw - e * words - ahead)) AS BIGINT) AS taken
FROM r
"""

QUERIES = {"op9_mix_sources": op9_mix_sources}
SQL = {"op9_mix_sources": OP9_SQL}
