"""What a subtitle file looks like, told without its words, and what a draft made from it is named by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import sha256
from annalist.sources import cues, srt
from annalist.sources.ingest import decoded

#: Segments of a block.
SIZE = 64
#: Labels that name nobody, and what drafts are made by.
NEUTRAL, PARSER, PROFILE, PROJECTION = r"^SPEAKER_[0-9]+\z", "annalist.srt-draft.v1", "nfc-strict-v1", "segments-newline-v1"


def structure(files: DataFrame, size: int = SIZE) -> DataFrame:
    """One row for each SRT file (record_id, content): error, sha256, bytes, cues, first_start, first_end, last_start, last_end, labels,
    occurrences, counts, characters, longest, blocks.

    Two parsers read a file, one for exact places and one for times and speakers, and must agree; otherwise, and for files that
    either refuses, there is only an error: ``cues``, ``metadata`` or ``count``. No text of the file is told, nor labels
    (``counts``: label to occurrences) unless all of them are neutral. ``blocks``: block, segments, characters of each
    ``size`` segments, from 1. Every file is read by expressions and grouped by record; a file is one task's row.
    """
    f = files.select("record_id", sha256(F.col("content")).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), decoded(F.col("content")).alias("text"))
    exact = cues.scan(f.where("text is not null").select("record_id", F.lit("srt").alias("format"), F.col("text").alias("source")))
    exact = exact.groupBy("record_id").agg(F.count("cue_index").alias("cues"), F.count("problem").alias("broken"))
    s = srt.parse(f.where("text is not null").select("record_id", F.col("text").alias("srt"))).withColumn("n", F.length("text").cast("long"))
    ends = F.struct("idx", "start_ms", "end_ms")
    told = s.groupBy("record_id").agg(
        F.count("*").alias("segments"), F.count("problem").alias("bad"), F.min(ends).alias("first"), F.max(ends).alias("last"), F.count_distinct("speaker").alias("labels"), F.count("speaker").alias("occurrences"),
        F.coalesce(F.bool_and(F.col("speaker").rlike(NEUTRAL)), F.lit(True)).alias("neutral"), F.sum("n").alias("characters"), F.max("n").alias("longest"))
    counts = s.where("speaker is not null").groupBy("record_id", "speaker").agg(F.count("*").alias("n")).groupBy("record_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "n")))).alias("counts"))
    blocks = s.groupBy("record_id", (F.floor(F.col("idx") / size) + 1).cast("long").alias("block")).agg(F.count("*").alias("segments"), F.sum("n").alias("characters"))
    blocks = blocks.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("block", "segments", "characters"))).alias("blocks"))
    j = f.drop("text").join(exact, "record_id", "left").join(told, "record_id", "left").join(counts, "record_id", "left").join(blocks, "record_id", "left")
    error = F.when(F.col("cues").isNull() | (F.col("broken") > 0) | (F.col("cues") == 0), "cues").when(F.col("segments").isNull() | (F.col("bad") > 0), "metadata").when(F.col("cues") != F.col("segments"), "count")
    j = j.withColumn("error", error)
    good = lambda c, name: F.when(F.col("error").isNull(), c).alias(name)
    time = lambda end, what: good(srt.timecode(F.col(f"{end}.{what}_ms")), f"{end}_{what}")
    return j.select("record_id", "error", good(F.col("sha256"), "sha256"), good(F.col("bytes"), "bytes"), good(F.col("cues"), "cues"), time("first", "start"), time("first", "end"), time("last", "start"), time("last", "end"),
                    good(F.col("labels"), "labels"), good(F.col("occurrences"), "occurrences"), good(F.when(F.col("neutral"), F.coalesce("counts", F.create_map().cast("map<string,bigint>"))), "counts"),
                    good(F.col("characters"), "characters"), good(F.col("longest"), "longest"), good(F.col("blocks"), "blocks"))


def _canonical(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def draft_segment(index: Column, start: Column, end: Column, speaker: Column, text: Column) -> Column:
    """A draft segment's canonical JSON, keys in order."""
    return _canonical(F.lit("transcript_srt_draft_segment").alias("domain"), end.alias("end_ms"), index.alias("index"), speaker.alias("speaker"), start.alias("start_ms"), text.alias("text"), F.lit(1).alias("v"))


def drafts(segments: DataFrame, files: DataFrame) -> DataFrame:
    """record_id, srt_bytes_sha256, segments_sha256 (array, in order), draft_sha256: what drafts (record_id, idx, start_ms, end_ms,
    speaker, text) of files (record_id, content) are named by."""
    e = segments.select("record_id", "idx", draft_segment(F.col("idx"), F.col("start_ms"), F.col("end_ms"), F.col("speaker"), F.col("text")).alias("json"))
    g = e.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("idx", "json"))).alias("s"))
    j = g.join(files.select("record_id", sha256(F.col("content")).alias("srt_bytes_sha256")), "record_id")
    head = lambda *c: F.regexp_replace(_canonical(*c), r"\}\z", "")
    whole = F.concat(head(F.lit("transcript_srt_draft").alias("domain"), F.lit(PARSER).alias("parser_version"), F.lit(PROFILE).alias("profile_id"), F.lit(PROJECTION).alias("projection_version")), F.lit(',"segments":['),
                     F.array_join(F.transform("s", lambda x: x["json"]), ","), F.lit('],"srt_bytes_sha256":"'), F.col("srt_bytes_sha256"), F.lit('","v":1}'))
    return j.select("record_id", "srt_bytes_sha256", F.transform("s", lambda x: sha256(x["json"])).alias("segments_sha256"), sha256(whole).alias("draft_sha256"))


def assignments(drafted: DataFrame, mappings: DataFrame, vocabulary: str) -> DataFrame:
    """record_id, assignment_sha256, problem: what a draft's languages are named by. problem ``segments``: the mapping (record_id,
    content, rows: array of struct(index, segment_sha256, language) in order) isn't of exactly the draft's segments in order; ``draft``: there is
    no draft for it; then there is no digest."""
    j = mappings.join(drafted, "record_id", "left")
    problem = F.when(F.col("draft_sha256").isNull(), "draft").when(F.transform("rows", lambda x: x["segment_sha256"]) != F.col("segments_sha256"), "segments")
    whole = _canonical(
        F.transform("rows", lambda x: F.struct(x["index"].alias("index"), x["language"].alias("language"), x["segment_sha256"].alias("segment_sha256"))).alias("assignments"), F.lit("transcript_segment_language_assignment").alias("domain"), F.col("draft_sha256").alias("draft_segments_sha256"), F.lit(vocabulary).alias("iso6393_vocabulary_sha256"), sha256(F.col("content")).alias("mapping_bytes_sha256"),
        F.lit(PARSER).alias("parser_version"), F.col("srt_bytes_sha256"), F.col("record_id").alias("target_record_id"), F.lit(1).alias("v"))
    return j.select("record_id", F.when(problem.isNull(), sha256(whole)).alias("assignment_sha256"), problem.alias("problem"))
