"""SRT text to segments and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import milliseconds

#: The time line and the speaker label of an SRT block.
TIME = r"^(\d{1,3}):([0-5]\d):([0-5]\d)[,.](\d{1,3})\s*-->\s*(\d{1,3}):([0-5]\d):([0-5]\d)[,.](\d{1,3})(?:\s+[Xx]1:.*)?$"
SPEAKER = r"(?U)^\s*([A-ZÄÖÜ][\wÄÖÜäöüß .\-]{0,32}?)\s*:(?:\s|$)"


def parse(files: DataFrame) -> DataFrame:
    """record_id, idx, start_ms, end_ms, speaker, text, problem from (record_id, srt).

    ``problem``: null, ``time`` (no valid time line), ``order`` (ends before it starts), ``empty`` (no words) or
    ``overlap`` (starts before an earlier block ends or starts). idx counts blocks from 0, whatever number is printed.
    A speaker's label stands on the first line of a block's text; lines are then joined by a space.
    """
    from pyspark.sql import Window as W

    clean = F.regexp_replace(F.regexp_replace("srt", "^﻿", ""), "\r\n?", "\n")
    blocks = F.filter(F.split(clean, r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, "\n", "")) != "")
    rows = files.select("record_id", F.posexplode(blocks).alias("idx", "block"))
    lines = F.split(F.regexp_replace("block", r"^\n+|\n+$", ""), "\n")
    rows = rows.withColumn("lines", lines)
    numbered = F.element_at("lines", 1).rlike(r"^\s*\d+\s*$") & (F.size("lines") > 1)
    rows = rows.withColumn("lines", F.when(numbered, F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines")))
    time = F.trim(F.element_at("lines", 1))
    part = lambda k: F.regexp_extract(time, TIME, k)
    valid = time.rlike(TIME)
    ms = lambda k: F.when(valid, milliseconds(part(k), part(k + 1), part(k + 2), part(k + 3)))
    rows = rows.withColumn("body", F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).withColumn("first", F.coalesce(F.get("body", F.lit(0)), F.lit("")))
    label = F.regexp_extract("first", SPEAKER, 1)
    first = F.when(label != "", F.regexp_replace("first", SPEAKER, "")).otherwise(F.col("first"))
    text = F.trim(F.array_join(F.transform(F.concat(F.array(first), F.slice("body", 2, F.greatest(F.size("body") - 1, F.lit(0)))), lambda x: F.trim(x)), " "))
    rows = rows.select("record_id", "idx", ms(1).alias("start_ms"), ms(5).alias("end_ms"), F.when(label != "", label).alias("speaker"), text.alias("text"))
    before = W.partitionBy("record_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    late = (F.col("start_ms") < F.max("end_ms").over(before)) | (F.col("start_ms") < F.max("start_ms").over(before))
    problem = F.when(F.col("start_ms").isNull(), "time").when(F.col("end_ms") < F.col("start_ms"), "order").when(F.col("text") == "", "empty").when(late, "overlap")
    return rows.select("record_id", "idx", "start_ms", "end_ms", "speaker", "text", problem.alias("problem"))


def accepted(parsed: DataFrame) -> DataFrame:
    """record_id, segments (null if refused), problems: a file with any bad block, or with none at all, is refused whole.

    ``problems`` names the first five bad blocks, as ``idx:problem``.
    """
    bad = F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("idx", "problem"))))
    found = parsed.groupBy("record_id").agg(F.count("*").alias("n"), bad.alias("bad"))
    told = F.array_join(F.transform(F.slice("bad", 1, 5), lambda x: F.concat_ws(":", x["idx"].cast("string"), x["problem"])), ",")
    return found.select("record_id", F.when(F.size("bad") == 0, F.col("n")).alias("segments"), told.alias("problems"))


def timecode(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", F.expr("0") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def render(segments: DataFrame) -> DataFrame:
    """record_id, srt from (record_id, idx, start_ms, end_ms, speaker, text); line feeds in texts become spaces."""
    block = F.concat((F.col("idx") + 1).cast("string"), F.lit("\n"), timecode(F.col("start_ms")), F.lit(" --> "), timecode(F.col("end_ms")), F.lit("\n"),
                     F.coalesce(F.concat("speaker", F.lit(": ")), F.lit("")), F.regexp_replace("text", r"\s*\n\s*", " "), F.lit("\n"))
    listed = F.array_sort(F.collect_list(F.struct("idx", block.alias("block"))))
    return segments.groupBy("record_id").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n").alias("srt"))
