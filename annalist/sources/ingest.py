"""Files into a record: checks, whole-file refusal, what is new, and the events that tell it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.text import base_name, nfc
from annalist.sources import cues, srt

#: Media types by suffix, and the largest size of a source file in bytes.
MEDIA, LARGEST = {".srt": "application/x-subrip", ".vtt": "text/vtt"}, 32 * 1024 * 1024


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, content (binary) of the files of a folder, by Spark's reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def decoded(content: Column) -> Column:
    """UTF-8 text, without a byte order mark; null if the bytes are not UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")


def load_srt(files: DataFrame) -> DataFrame:
    """Segments (see ``srt.parse``) of files (record_id, content). Speakers may be missing: drafts."""
    return srt.parse(files.select("record_id", decoded(F.col("content")).alias("srt")))


def draft(segments: DataFrame) -> DataFrame:
    """record_id, segments, problem of a draft: every segment needs a speaker before languages are assigned."""
    g = segments.groupBy("record_id").agg(F.count("*").alias("segments"), F.count_if(F.col("speaker").isNull()).alias("lost"), F.count_if(F.col("problem").isNotNull()).alias("bad"))
    return g.select("record_id", "segments", F.when(F.col("bad") > 0, "parse").when(F.col("lost") > 0, "speaker").alias("problem"))


def fulltext(files: DataFrame) -> DataFrame:
    """record_id, text, problem of separate full texts: utf8, empty, return (a carriage return) or nfc (not composed)."""
    t = files.select("record_id", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    problem = F.when(F.col("text").isNull(), "utf8").when(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", "empty").when(F.contains("text", F.lit("\r")), "return").when(~nfc("text").eqNullSafe(F.col("text")), "nfc")
    return t.select("record_id", "text", problem.alias("problem"))


def plan(files: DataFrame, owners: DataFrame, journal: DataFrame, runtime: str) -> DataFrame:
    """record_id, name, sha256, bytes, cues, media_type, outcome for files (record_id, path, content).

    Outcomes, the first that fits: owner (the record belongs to another runtime), size, suffix, name, utf8, parse (any bad
    block, a WebVTT file without head, or no cue at all refuses the file), known (this record has these bytes), new. Owners: record_id, runtime (no row: may be
    written); journal: record_id, sha256 of sources ingested before. Contents are read once; joins are by record and digest.
    """
    f = files.select("record_id", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).alias("suffix"), base_name(F.col("path")).alias("name"), F.sha2("content", 256).alias("sha256"),
                     F.octet_length("content").cast("long").alias("bytes"), decoded(F.col("content")).alias("text"))
    blocks = f.where("suffix = '.srt' and text is not null").select(F.struct("record_id", "sha256").alias("record_id"), F.col("text").alias("srt")).distinct()
    told = srt.accepted(srt.parse(blocks)).select("record_id.*", F.col("segments").alias("cues"))
    webvtt = f.where("suffix = '.vtt' and text is not null").select(F.struct("record_id", "sha256").alias("record_id"), F.lit("vtt").alias("format"), F.col("text").alias("source")).distinct()
    told = told.unionByName(cues.accepted(cues.scan(webvtt)).groupBy("record_id").agg(F.count("*").alias("cues")).select("record_id.*", "cues"))
    j = f.join(told, ["record_id", "sha256"], "left").join(owners.select("record_id", F.col("runtime").alias("owner")), "record_id", "left")
    j = j.join(journal.select("record_id", "sha256").distinct().withColumn("there", F.lit(True)), ["record_id", "sha256"], "left")
    outcome = (
        F.when(F.col("owner").isNotNull() & (F.col("owner") != runtime), "owner").when(F.col("bytes") > LARGEST, "size").when(~F.col("suffix").isin(list(MEDIA)), "suffix").when(F.col("name").isNull(), "name")
        .when(F.col("text").isNull(), "utf8").when(F.col("cues").isNull(), "parse").when(F.col("there"), "known").otherwise("new")
    )
    media = F.coalesce(*[F.when(F.col("suffix") == s, F.lit(m)) for s, m in MEDIA.items()])
    return j.select("record_id", "name", "sha256", "bytes", "cues", media.alias("media_type"), outcome.alias("outcome"))


def ingest_events(planned: DataFrame, registered: DataFrame) -> DataFrame:
    """record_id, kind, payload (JSON) of what a plan appends: a registration for records that have none, then the source;
    each once for equal bytes."""
    new = planned.where("outcome = 'new'").dropDuplicates(["record_id", "sha256"])
    source = F.to_json(F.struct("bytes", "cues", F.col("name").alias("filename"), "media_type", "record_id", "sha256"), {"ignoreNullFields": "true"})
    fresh = new.select("record_id").distinct().join(registered.select("record_id"), "record_id", "left_anti")
    first = fresh.select("record_id", F.lit("record.registered").alias("kind"), F.to_json(F.struct("record_id")).alias("payload"))
    return first.unionByName(new.select("record_id", F.lit("source.ingested").alias("kind"), source.alias("payload")))


def observed(seen: DataFrame, journal: DataFrame) -> DataFrame:
    """role, sha256 of inputs that changed since they were observed last (journal: role, seq, sha256); first sights too."""
    last = journal.groupBy("role").agg(F.max_by("sha256", "seq").alias("before"))
    return seen.join(last, "role", "left").where(~F.col("sha256").eqNullSafe(F.col("before"))).select("role", "sha256")
