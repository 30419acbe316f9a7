"""Canonical revisions of transcripts: identity, projection, problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import nfc, sha256

DOMAIN, PROJECTION, VERSION = "transcript_revision", "seg-join-lf.v1", 1
FIELDS = ("end_ms", "index", "language", "speaker", "start_ms", "text")


def project(segments: Column) -> Column:
    """The full text of an array of segments in order: their texts joined by line feeds."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "\n")


def canonical(profile: Column, fulltext: Column, segments: Column) -> Column:
    """Canonical JSON of a revision: keys in order, nulls kept, nothing escaped that needn't be. Segments: an array of
    structs with FIELDS, in order. Source, languages, parent and notes are no part of it."""
    return F.to_json(F.struct(F.lit(DOMAIN).alias("domain"), fulltext.alias("fulltext"), profile.alias("profile_id"), F.lit(PROJECTION).alias("projection_version"), segments.alias("segments"), F.lit(VERSION).alias("v")), {"ignoreNullFields": "false"})


def revisions(segments: DataFrame, profile: str) -> DataFrame:
    """record_id, segments, fulltext, languages (sorted), problem, revision_sha256 (null with a problem).

    Rows: record_id, idx, start_ms, end_ms, speaker, language, text. Problems, the first that fits: type (a negative
    time or index, or a null text), draft (a speaker, language or time is missing: no identity yet), order (indices aren't 0, 1,
    ...), text (a carriage return or another control character), nfc (not composed).
    """
    order = W.partitionBy("record_id").orderBy("idx")
    s = segments.withColumns({"__place": F.row_number().over(order) - 1, "__nfc": nfc("text").eqNullSafe(F.col("text"))})
    row = F.struct(*[F.col("idx" if f == "index" else f).alias(f) for f in FIELDS])
    negative = F.coalesce((F.col("idx") < 0) | (F.col("start_ms") < 0) | (F.col("end_ms") < 0), F.lit(False)) | F.col("text").isNull()
    missing = F.col("speaker").isNull() | F.col("language").isNull() | F.col("start_ms").isNull() | F.col("end_ms").isNull()
    g = s.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", row.alias("s")))).alias("all"), F.array_sort(F.collect_set("language")).alias("languages"),
        F.bool_or(negative).alias("negative"), F.bool_or(missing).alias("missing"), F.bool_and(F.col("idx") == F.col("__place")).alias("ordered"),
        F.bool_or(F.col("text").rlike(r"[\x00-\x08\x0B-\x1F\x7F]")).alias("control"), F.bool_and("__nfc").alias("composed"))
    g = g.withColumn("segments", F.transform("all", lambda x: x["s"])).withColumn("fulltext", project(F.col("segments")))
    problem = F.when(F.col("negative"), "type").when(F.col("missing"), "draft").when(~F.coalesce("ordered", F.lit(False)), "order").when(F.col("control"), "text").when(~F.col("composed"), "nfc")
    digest = F.when(problem.isNull(), sha256(canonical(F.lit(profile), F.col("fulltext"), F.col("segments"))))
    return g.select("record_id", "segments", "fulltext", "languages", problem.alias("problem"), digest.alias("revision_sha256"))


_revisions = revisions


def revise(revisions: DataFrame, changes: DataFrame, profile: str) -> DataFrame:
    """record_id, parent_sha256, revision_sha256 of revisions whose segments (record_id, idx, new_text) got other texts; the
    old revisions stay as they are."""
    rows = revisions.where(F.col("revision_sha256").isNotNull()).select("record_id", F.col("revision_sha256").alias("parent_sha256"), F.explode("segments").alias("s"))
    rows = rows.select("record_id", "parent_sha256", F.col("s.index").alias("idx"), "s.start_ms", "s.end_ms", "s.speaker", "s.language", "s.text")
    touched = changes.select("record_id").distinct()
    j = rows.join(touched, "record_id", "left_semi").join(changes, ["record_id", "idx"], "left").withColumn("text", F.coalesce("new_text", "text"))
    parents = j.groupBy("record_id").agg(F.first("parent_sha256").alias("parent_sha256"))
    return _revisions(j, profile).join(parents, "record_id").select("record_id", "parent_sha256", "revision_sha256")


def sliced(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` in code points."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def structure_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """sha256 of a table as a sorted list: what a graph, plan or policy is named by. For small tables: one row holds all."""
    listed = F.array_sort(F.collect_list(F.struct(*columns)))
    return rows.agg(sha256(F.to_json(listed, {"ignoreNullFields": "false"})).alias("sha256"))


#: The head of a prompt; {} is the number of segments.
HEAD = (
    "Schlage je Sprechersegment einen deskriptiven L1-Inhaltscode vor, der beschreibt, wovon das Segment handelt.\n"
    "Verwende im Code keinen Sprechernamen, keine Sprecherkennung und keine Rollenbezeichnung.\n"
    "Der Datenblock trägt genau {} Segmente. Liefere für jedes Segment genau ein Ergebnis, auch für kurze Segmente."
)


def prompt(revision: Column, segments: Column) -> Column:
    """The prompt of a block: head, an empty line, and JSON with a blank behind each comma and colon, keys in order.

    Segments: an array of struct(index, speaker, text).
    """
    before, after = HEAD.split("{}")
    quoted = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]\z", ""))
    each = F.transform(segments, lambda s: F.concat(F.lit('{"index": '), s["index"].cast("string"), F.lit(', "speaker": '), quoted(s["speaker"]), F.lit(', "text": '), quoted(s["text"]), F.lit("}")))
    body = F.concat(F.lit(f'{{"projection_version": "{PROJECTION}", "revision_sha256": "'), revision, F.lit('", "segments": ['), F.array_join(each, ", "), F.lit('], "task": "descriptive_l1"}'))
    return F.concat(F.lit(before), F.size(segments).cast("string"), F.lit(after + "\n\n"), body)


def recorded_answer(segments: DataFrame) -> DataFrame:
    """record_id, idx, code of the recorded model: one code a segment, numbered from 1 in a record."""
    n = F.row_number().over(W.partitionBy("record_id").orderBy("idx"))
    return segments.select("record_id", "idx", F.concat(F.lit("L1."), F.when(n > 99, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))).alias("code"))
