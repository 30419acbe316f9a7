"""Segment offsets in the joined text, interval overlap and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segment_spans(segments: DataFrame) -> DataFrame:
    """record_id, idx, start, end: half-open code point ranges in the texts joined by one line feed."""
    before = W.partitionBy("record_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return segments.select("record_id", "idx", start.alias("start"), (start + F.length("text")).cast("long").alias("end"))


def covered(spans: DataFrame, anchors: DataFrame) -> DataFrame:
    """Spans that an anchor of their record overlaps; ends that touch don't overlap."""
    a = anchors.select(F.col("record_id").alias("r"), F.col("start").alias("a"), F.col("end").alias("b"))
    return spans.join(a, (F.col("record_id") == F.col("r")) & (F.col("a") < F.col("end")) & (F.col("b") > F.col("start")), "left_semi")


def coverage(spans: DataFrame, anchors: DataFrame, threshold: float) -> DataFrame:
    """record_id, covered, total, ratio, passed: the share of a record's segments that anchors cover."""
    hit = covered(spans, anchors).select("record_id", "idx").distinct().withColumn("hit", F.lit(1))
    joined = spans.join(hit, ["record_id", "idx"], "left")
    ratio = F.col("covered") / F.col("total")
    return (
        joined.groupBy("record_id").agg(F.count("hit").cast("long").alias("covered"), F.count("*").cast("long").alias("total"))
        .select("record_id", "covered", "total", ratio.alias("ratio"), (ratio >= threshold).alias("passed"))
    )


def uncovered(spans: DataFrame, anchors: DataFrame) -> DataFrame:
    return spans.join(covered(spans, anchors).select("record_id", "idx").distinct(), ["record_id", "idx"], "left_anti")
