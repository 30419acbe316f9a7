"""A revision's full text and its cues: one map of places for both directions, and marks made in either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import mention_id, sha256
from annalist.operators.receipts import latest_before

#: The head of a projected document and the time line of its cues, which is only a frame.
HEAD, TIMES = "WEBVTT\n\n", "00:00:00.000 --> 00:00:01.000"


def project(segments: DataFrame) -> DataFrame:
    """record_id, source, document_sha256, problem: a record's segments (record_id, idx, text) as a WebVTT document, a cue
    each, numbered from 0. problem ``text``: a segment is null, empty, or has a blank line or a carriage return, so
    that it would not come back as one cue; the document is null then. A record is one text, gathered in order of idx."""
    bad = F.col("text").isNull() | F.contains("text", F.lit("\r")) | F.exists(F.split("text", "\n", -1), lambda x: x.rlike(r"(?U)^[\s\x1c-\x1f]*\z"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x, i: F.concat(i.cast("string"), F.lit(f"\n{TIMES}\n"), x["text"], F.lit("\n\n")))
    found = segments.groupBy("record_id").agg(F.bool_or(bad).alias("bad"), F.concat(F.lit(HEAD), F.array_join(listed, "")).alias("source"))
    source = F.when(~F.col("bad"), F.col("source"))
    return found.select("record_id", source.alias("source"), sha256(source).alias("document_sha256"), F.when(F.col("bad"), "text").alias("problem"))


def places(segments: DataFrame) -> DataFrame:
    """record_id, cue, idx, text, start, end, doc_start: where each segment stands in the full text (texts joined by a line feed)
    and where its text begins in the projected document, all in code points."""
    order = W.partitionBy("record_id").orderBy("idx")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = segments.withColumn("cue", (F.row_number().over(order) - 1).cast("long"))
    digits = F.length(F.col("cue").cast("string"))
    s = s.withColumn("frame", digits + 1 + len(TIMES) + 1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    doc = len(HEAD) + F.coalesce(F.sum(F.col("frame") + F.length("text") + 2).over(before), F.lit(0)) + F.col("frame")
    return s.select("record_id", "cue", "idx", "text", start.alias("start"), (start + F.length("text")).alias("end"), doc.cast("long").alias("doc_start"))


def to_cues(marks: DataFrame, placed: DataFrame) -> DataFrame:
    """Marks in the full text (record_id, start, end, entity_type) as spans of cues: record_id, mark_start, mark_end,
    entity_type, cue, start, end, doc_start, doc_end. A mark over several segments is cut at their borders; the line feeds between
    them belong to no cue, and a mark of nothing but such has no span. Marks outside the text are cut to it.

    The first and the last cue of a mark are looked up in one sort of places by record; only cues between are joined.
    """
    keyed = placed.select("record_id", (F.col("start") * 2).alias("seq"), "cue")
    at = lambda df, c: latest_before(df.withColumn("seq", c), keyed, ["record_id"], ["cue"])
    m = at(marks.select("record_id", F.col("start").alias("mark_start"), F.col("end").alias("mark_end"), "entity_type").where("mark_start < mark_end"), F.greatest("mark_start", F.lit(0)) * 2 + 1)
    m = at(m.withColumn("first", F.col("found.cue")).drop("found", "seq"), F.col("mark_end") * 2 - 1)
    m = m.where("first is not null and found is not null").withColumn("cue", F.explode(F.sequence("first", F.col("found.cue")))).drop("first", "found", "seq")
    j = m.join(placed.select("record_id", "cue", F.col("start").alias("s"), F.col("end").alias("e"), F.col("doc_start").alias("d")), ["record_id", "cue"])
    start, end = F.greatest("mark_start", "s") - F.col("s"), F.least("mark_end", "e") - F.col("s")
    out = j.select("record_id", "mark_start", "mark_end", "entity_type", "cue", start.alias("start"), end.alias("end"), (F.col("d") + start).alias("doc_start"), (F.col("d") + end).alias("doc_end"))
    return out.where("start < end")


def to_text(spans: DataFrame, placed: DataFrame) -> DataFrame:
    """Spans of cues (record_id, cue, start, end) with ``text_start`` and ``text_end`` in the full text; null where they leave their cue."""
    j = spans.join(placed.select("record_id", "cue", F.col("start").alias("s"), F.length("text").alias("n")), ["record_id", "cue"], "left")
    fits = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n"))
    return j.withColumns({"text_start": F.when(fits, F.col("s") + F.col("start")), "text_end": F.when(fits, F.col("s") + F.col("end"))}).drop("s", "n")


def mark(spans: DataFrame, placed: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans of cues as what people marked: with document_sha256, input_sha256 of the cue's text, and mention_id, ready for ``mentions.bind``.
    Documents: as ``project`` returns them; spans of refused ones are left out."""
    j = spans.join(placed.select("record_id", "cue", sha256(F.col("text")).alias("input_sha256")), ["record_id", "cue"])
    j = j.join(documents.where("problem is null").select("record_id", "document_sha256"), "record_id").withColumns({"unit": F.lit("codepoint"), "recogniser": F.lit("human")})
    return j.withColumn("mention_id", mention_id(F.col("document_sha256"), F.col("cue"), F.col("start"), F.col("end"), F.col("entity_type")))
