"""Model runs in blocks with one supplement: a record's answers are whole, or there are none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import context, text_digest
from annalist.operators.contracts import answer_outcome
from annalist.operators.receipts import truncated
from annalist.operators.spans import segment_spans

#: Segments of a request.
SIZE = 64
Adapter = Callable[[DataFrame], DataFrame]


def requests(segments: DataFrame, size: int = SIZE) -> DataFrame:
    """record_id, block, kind, expected, request_sha256: the first requests for segments (record_id, idx), in blocks of ``size``."""
    nth = F.row_number().over(W.partitionBy("record_id").orderBy("idx")) - 1
    b = segments.select("record_id", "idx", F.floor(nth / size).cast("long").alias("block"))
    b = b.groupBy("record_id", "block").agg(F.array_sort(F.collect_list(F.col("idx").cast("long"))).alias("expected"))
    return named(b.withColumns({"kind": F.lit("original"), "parent": F.lit(None).cast("string")}))


def named(rows: DataFrame) -> DataFrame:
    """A request's digest covers what it asks for and, of a supplement, the request that it completes."""
    body = F.to_json(F.struct("block", "expected", "kind", "parent", "record_id"), {"ignoreNullFields": "false"})
    return rows.withColumn("request_sha256", F.sha2(body, 256)).select("record_id", "block", "kind", "expected", "parent", "request_sha256")


def asked(rows: DataFrame, adapter: Adapter, folder: str) -> DataFrame:
    """Requests with their answers (answer, finish_reason), which are written to ``folder`` once: a model that is asked again
    answers otherwise. What the adapter leaves out has null answers."""
    spark = rows.sparkSession
    answers = adapter(rows).select("request_sha256", "answer", "finish_reason")
    rows.join(answers, "request_sha256", "left").write.parquet(folder)
    return spark.read.parquet(folder)


def entries(answered: DataFrame) -> DataFrame:
    """record_id, block, kind, segment, code of answers that were found sound."""
    rows = F.from_json("answer", "results array<struct<segment:bigint,code:string>>")["results"]
    return answered.select("record_id", "block", "kind", F.inline(rows))


def supplements(answered: DataFrame) -> DataFrame:
    """The requests that complete first answers (with ``outcome``) which lack segments: for just these, naming the first request."""
    got = F.transform(F.from_json("answer", "results array<struct<segment:bigint>>")["results"], lambda x: x["segment"])
    lacking = answered.where("outcome = 'incomplete'").select("record_id", "block", F.lit("supplement").alias("kind"), F.array_except("expected", got).alias("expected"), F.col("request_sha256").alias("parent"))
    return named(lacking)


def judged(answered: DataFrame, codes: list[str] | None) -> DataFrame:
    """Answers with ``outcome``: finish (not ended cleanly), else what ``answer_outcome`` tells."""
    return answered.withColumn("outcome", F.coalesce(F.when(truncated(F.col("finish_reason")), "finish"), answer_outcome(F.col("answer"), F.col("expected"), codes)))


def run(segments: DataFrame, adapter: Adapter, folder: str, codes: list[str] | None = None, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Suggestions (record_id, idx, code, id, supplemented) and outcomes (record_id, segments, supplements, block, problem).

    Every block is asked for once. An answer that is sound but lacks segments opens one supplement for just these, which
    must be whole. A block's problem: ``finish`` (not ended cleanly), what ``answer_outcome`` tells of the answer,
    the same of the supplement behind ``supplement-``. The answers of a record are joined and held against its segments
    once more, as multisets (``union``). With a problem in any block a record has no suggestions at all; its outcome names the
    first such block. Ids are S001, S002, ... in order of segments. A record without segments has no row.

    ``adapter`` makes answers (request_sha256, answer, finish_reason) of requests. Both rounds are recorded in ``folder``.
    """
    first = judged(asked(requests(segments, size), adapter, f"{folder}/original"), codes)
    second = judged(asked(supplements(first), adapter, f"{folder}/supplement"), codes)
    # a supplement that lacks something again is as broken as any other
    after = second.select("record_id", "block", F.col("outcome").alias("later"))
    blocks = first.join(after, ["record_id", "block"], "left")
    problem = F.when(F.col("outcome") == "incomplete", F.when(F.col("later") != "ok", F.concat(F.lit("supplement-"), "later"))).when(F.col("outcome") != "ok", F.col("outcome"))
    blocks = blocks.withColumn("problem", problem)
    bad = F.when(F.col("problem").isNotNull(), F.struct("block", "problem"))
    records = blocks.groupBy("record_id").agg(F.sum(F.size("expected")).alias("segments"), F.count("later").alias("supplements"), F.min(bad).alias("bad"))
    sound = blocks.where("problem is null")
    rows = entries(sound).unionByName(entries(second.join(sound.select("record_id", "block"), ["record_id", "block"], "left_semi")))
    # each segment exactly once, whatever the rounds brought
    counts = segments.select("record_id", F.col("idx").cast("long").alias("segment"), F.lit(1).alias("want"), F.lit(0).alias("have")).unionByName(rows.select("record_id", "segment", F.lit(0).alias("want"), F.lit(1).alias("have")))
    off = counts.groupBy("record_id", "segment").agg(F.sum("want").alias("want"), F.sum("have").alias("have")).where("want <> have").select("record_id").distinct().withColumn("off", F.lit(True))
    outcomes = records.join(off, "record_id", "left").select("record_id", "segments", "supplements", F.col("bad.block").alias("block"), F.coalesce("bad.problem", F.when(F.col("off"), "union")).alias("problem"))
    whole = outcomes.where("problem is null").select("record_id")
    nth = F.row_number().over(W.partitionBy("record_id").orderBy("segment"))
    name = F.concat(F.lit("S"), F.when(nth > 999, nth.cast("string")).otherwise(F.lpad(nth.cast("string"), 3, "0")))
    done = rows.join(whole, "record_id", "left_semi").select("record_id", F.col("segment").alias("idx"), "code", name.alias("id"), (F.col("kind") == "supplement").alias("supplemented"))
    return done, outcomes


def evidence_findings(segments: DataFrame, originals: DataFrame, seconds: DataFrame, codes: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """record_id, kind, block, finding of recorded rounds that don't tell the same run again; a sound record has no row.

    Requests are made anew, without a model: the first ones from the segments, supplements from the recorded first answers.
    lost: a request that must be there isn't; foreign: one is that nothing asks for (or comes twice). A digest covers
    what a request asks for, so changed ones are both. Recorded: as ``asked`` writes them.
    """
    out = None
    for want, have in ((requests(segments, size), originals), (supplements(judged(originals.join(requests(segments, size).select("request_sha256"), "request_sha256", "left_semi"), codes)), seconds)):
        columns = ["record_id", "kind", "block", "request_sha256"]
        both = want.select(*columns, F.lit(1).alias("want"), F.lit(0).alias("have")).unionByName(have.select(*columns, F.lit(0).alias("want"), F.lit(1).alias("have")))
        told = both.groupBy(*columns).agg(F.sum("want").alias("want"), F.sum("have").alias("have")).where("want <> have")
        found = told.select("record_id", "kind", "block", F.when(F.col("want") > F.col("have"), "lost").otherwise("foreign").alias("finding"))
        out = found if out is None else out.unionByName(found)
    return out


def anchored(suggestions: DataFrame, segments: DataFrame) -> DataFrame:
    """Suggestions with start, end, quote_sha256 and context_sha256 of their segment in the record's full text (texts joined
    by a line feed): what later revisions are searched by. A record is one text, gathered in order."""
    listed = F.array_sort(F.collect_list(F.struct("idx", "text")))
    whole = segments.groupBy("record_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("fulltext"))
    j = suggestions.join(segment_spans(segments).withColumn("idx", F.col("idx").cast("long")), ["record_id", "idx"]).join(whole, "record_id")
    quote = F.substring("fulltext", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    around = context(F.col("fulltext"), F.col("start").cast("int"), F.col("end").cast("int"))
    return j.select(*suggestions.columns, "start", "end", text_digest(quote).alias("quote_sha256"), text_digest(around).alias("context_sha256"))
