"""Lossless SRT and WebVTT: where a file's spoken text stands, and the file with other texts in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CLOCK = r"([0-5][0-9]):([0-5][0-9])"
#: The time lines of the two formats, the WebVTT head and the blocks that never hold speech.
SRT_TIME = rf"(?sU)^([0-9]{{2,3}}):{_CLOCK}[,.]([0-9]{{3}}) --> ([0-9]{{2,3}}):{_CLOCK}[,.]([0-9]{{3}})(?:\s+[Xx]1:.*)?\z"
VTT_TIME = rf"(?sU)^(?:([0-9]{{2,}}):)?{_CLOCK}\.([0-9]{{3}}) --> (?:([0-9]{{2,}}):)?{_CLOCK}\.([0-9]{{3}})(?:\s+\S.*)?\z"
HEAD = "(?s)^﻿*WEBVTT(?:[ \t].*)?\\z"
STRUCTURE = r"(?sU)^\s*(NOTE|STYLE|REGION)(?: .*|\s*)\z"
#: A line of nothing but white space; the four separators count as such although Java's class lacks them.
BLANK = r"(?U)^[\s\x1c-\x1f]*\z"
#: Characters of a block from which a file's pieces are cut.
CUT = 500
#: Characters that other programs take for a line end.
LINE_BREAKING = "[\v\f\x1c\x1d\x1e\x85  ]"


def _ms(line: Column, pattern: str, first: int) -> Column:
    part = lambda k: F.coalesce(F.expr(f"try_cast('0' || regexp_extract({line}, r'{pattern}', {first + k}) as bigint)"), F.lit(0))
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * 1000 + part(3)


def _time(line: str, kind: str) -> tuple[Column, Column, Column]:
    """Whether a line (a column's name) is a time line of this row's format, and its begin and end in ms."""
    vtt = F.col(kind) == "vtt"
    begin, end = (F.when(vtt, _ms(line, VTT_TIME, k)).otherwise(_ms(line, SRT_TIME, k)) for k in (1, 5))
    fits = F.when(vtt, F.col(line).rlike(VTT_TIME)).otherwise(F.col(line).rlike(SRT_TIME)) & (end >= begin)
    return F.coalesce(fits, F.lit(False)), begin, end


def scan(files: DataFrame, payloads: bool = False) -> DataFrame:
    """record_id, cue_index, start, end, start_ms, end_ms, problem from (record_id, format: srt or vtt, source).

    ``start`` and ``end`` are half-open code point places of a cue's text in ``source``, up to before the line end of
    its last line; with ``payloads`` that text stands beside them. Lines end at LF or CRLF only. A block (lines up to a blank one) is a cue: an id if any, a time line,
    and text, whatever that looks like. Rows with a problem have no cue_index: ``head`` (no WebVTT head), ``line``
    (neither id nor time line), ``time`` (no time line after an id), ``text`` (no text), ``none`` (not one cue). A null
    source counts as empty. A file with a problem should be refused whole: see ``accepted``.

    The files are read once: what is told of a whole file comes from a window over its blocks, not from joins.
    """
    lines = files.select("record_id", "format", F.posexplode(F.split(F.coalesce("source", F.lit("")), "\n", -1)).alias("n", "raw"))
    order = W.partitionBy("record_id", "format").orderBy("n")
    to_here, whole = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("raw") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ended = F.lead("n").over(order).isNotNull()
    lines = lines.withColumn("line", F.when(ended, F.regexp_replace("raw", "\r\\z", "")).otherwise(F.col("raw"))).withColumn("blank", F.col("line").rlike(BLANK))
    lines = lines.withColumn("block", F.sum(F.col("blank").cast("int")).over(to_here))
    # a blank first line stays, as a block of no lines, so that every file has a first block
    kept = lines.where(~F.col("blank") | (F.col("n") == 0)).withColumn("block", F.when(F.col("blank"), 0).otherwise(F.col("block")))
    line = F.when(~F.col("blank"), F.struct("n", "start", "line", (F.length("raw") > F.length("line")).alias("cr")))
    blocks = kept.groupBy("record_id", "format", "block").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(line)).alias("l"))
    l, size = (lambda k, c: F.get("l", F.lit(k))[c]), F.size("l")
    last = F.get("l", size - 1)
    blocks = blocks.select("record_id", "format", "n", "l", size.alias("size"), (last["start"] + F.length(last["line"])).alias("end"), l(0, "line").alias("l1"), l(1, "line").alias("l2"), l(1, "start").alias("s2"), l(2, "start").alias("s3"))
    vtt = F.col("format") == "vtt"
    blocks = blocks.where(~(vtt & (F.col("n") > 0) & F.col("l1").rlike(STRUCTURE)))
    (first, b1, e1), (second, b2, e2) = _time("l1", "format"), _time("l2", "format")
    head = vtt & (F.col("n") == 0)
    named = F.when(vtt, F.lit(True)).otherwise(F.regexp_replace("l1", "^﻿+", "").rlike(r"(?U)^[\s\x1c-\x1f]*\d+[\s\x1c-\x1f]*\z"))
    problem = (
        F.when(F.col("size") == 0, None)
        .when(head, F.when(~F.col("l1").rlike(HEAD), "head"))
        .when(first, F.when(F.col("size") < 2, "text"))
        .when(~named | (vtt & ~second), "line").when(~second, "time").when(F.col("size") < 3, "text"))
    text = F.slice("l", F.when(first, 2).otherwise(3), F.greatest(size, F.lit(1)))
    text = F.array_join(F.transform(text, lambda x, i: F.concat(F.when(i > 0, "\n").otherwise(""), x["line"], F.when(x["cr"] & (x["n"] < F.get("l", F.size("l") - 1)["n"]), "\r").otherwise(""))), "")
    blocks = blocks.select(
        "record_id", "format", "n", "size", problem.alias("problem"), head.alias("head"), F.when(first, F.col("s2")).otherwise(F.col("s3")).alias("start"), "end",
        F.when(first, b1).otherwise(b2).alias("start_ms"), F.when(first, e1).otherwise(e2).alias("end_ms"), *[text.alias("payload")] * payloads)
    is_cue = (F.col("size") > 0) & ~F.col("head") & F.col("problem").isNull()
    blocks = blocks.withColumn("cue", is_cue)
    blocks = blocks.withColumns({"cue_index": (F.sum(F.col("cue").cast("int")).over(to_here) - 1).cast("long"), "any_head": F.max(F.col("head") & (F.col("size") > 0)).over(whole), "any_told": F.max(F.col("cue") | F.col("problem").isNotNull()).over(whole)})
    # a WebVTT file that starts with a blank line has no head at all; one without cues tells nothing
    lone = F.when(F.col("n") == 0, F.when(vtt & ~F.col("any_head"), "head").when(~F.col("any_told"), "none"))
    of_cue = ["cue_index", "start", "end", "start_ms", "end_ms", *["payload"] * payloads]
    blocks = blocks.withColumns({"lone": lone, **{c: F.when(F.col("cue"), F.col(c)) for c in of_cue}})
    own = F.when(F.col("cue") | F.col("problem").isNotNull(), F.struct(*of_cue[:5], "problem", *of_cue[5:]))
    empty = [F.lit(None).cast("string" if c == "payload" else "long").alias(c) for c in of_cue]
    alone = F.when(F.col("lone").isNotNull(), F.struct(*empty[:5], F.col("lone").alias("problem"), *empty[5:]))
    return blocks.select("record_id", F.inline(F.array_compact(F.array(own, alone))))


def accepted(cues: DataFrame) -> DataFrame:
    """Cues of files in which nothing is wrong."""
    refused = F.max(F.col("problem").isNotNull()).over(W.partitionBy("record_id"))
    return cues.withColumn("refused", refused).where(~F.col("refused")).drop("refused", "problem")


def payload(source: Column) -> Column:
    """The text of a cue, given ``start`` and ``end`` columns beside the source."""
    return F.substring(source, (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))


def barrier(old: Column, new: Column) -> Column:
    """Why a text may not stand in for another, null if it may: it would change the file's structure."""
    ends = lambda c: F.regexp_extract_all(c, F.lit("\r?\n"), F.lit(0))
    empty = F.exists(F.split(new, "\r?\n", -1), lambda x: x.rlike(BLANK))
    return (
        F.when(new.isNull(), "null").when(new.contains("﻿"), "bom").when(new.rlike("\r(?!\n)"), "lone_cr").when(new.rlike(LINE_BREAKING), "line_breaking")
        .when(empty, "blank_line").when(ends(old) != ends(new), "line_ends"))


def render(files: DataFrame, cues: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """record_id, source: each file with its cues' ``payload`` in place (cues: record_id, start, end, payload).

    With unchanged payloads the result is the file itself. A file without cues stays as it is. ``texts`` (new column to
    column of cues) gives several texts in one pass, beside the file's own ``source``.
    """
    texts = {"source": "payload"} if texts is None else texts
    # files and cues meet in one grouping, not a join: no text is sorted or sent once more, and a record without id counts too
    rows = files.select("record_id", "source", F.lit(True).alias("there"))
    rows = rows.unionByName(cues.select("record_id", F.struct("start", "end", *dict.fromkeys(texts.values())).alias("c")), allowMissingColumns=True)
    j = rows.groupBy("record_id").agg(F.max("source").alias("source"), F.max("there").alias("there"), F.array_sort(F.collect_list("c")).alias("m")).where("there")
    # substring counts from a text's beginning: cut from blocks of CUT characters, a file takes time by its length, not by that times its cues
    j = j.withColumn("b", F.regexp_extract_all("source", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)))
    cut = lambda a, blocks: f"array_join(slice(b, int({a} div {CUT}) + 1, int({blocks})), '')"
    at, last = "if(i = 0, 0, m[i - 1].end)", "element_at(m, -1).end"
    between = f"substring({cut(at, f'greatest(x.start, {at}) div {CUT} - {at} div {CUT} + 1')}, int({at} % {CUT}) + 1, int(x.start - {at}))"
    pieces = f"transform(m, (x, i) -> concat({between}, x.`{{}}`))"
    tail = F.expr(f"substring({cut(last, 'size(b)')}, int({last} % {CUT}) + 1)")
    whole = lambda c: F.when(F.size("m") == 0, F.col("source")).otherwise(F.concat(F.array_join(F.expr(pieces.format(c)), ""), tail))
    return j.withColumns({name: whole(c) for name, c in texts.items()}).drop("m", "there", "b")
