"""Queries over transcripts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import sha256
from annalist.operators import spans
from annalist.sources import srt
from annalist.sources.tables import segments

#: Fixture convention: segments of LONG code points or more get an anchor over their middle half.
LONG = 200
_SEGMENTS = "seg AS (SELECT conv_id AS record_id, turn AS idx, role AS speaker, text FROM conversations)"
_ANCHORS_SQL = f"""{_SEGMENTS},
sp AS (SELECT record_id, idx, s AS "start", s + length(text) AS "end" FROM (
         SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY record_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM seg)),
an AS (SELECT record_id, "start" + ("end" - "start") // 4 AS "start", "end" - ("end" - "start") // 4 AS "end" FROM sp WHERE "end" - "start" >= {LONG}),
hit AS (SELECT DISTINCT s.record_id, s.idx FROM sp s WHERE EXISTS (SELECT 1 FROM an a WHERE a.record_id = s.record_id AND a."start" < s."end" AND a."end" > s."start"))"""
BLOCK = 4


def _spans(spark, sf_dir):
    return spans.segment_spans(segments(spark, sf_dir))


def _anchors(found):
    quarter = F.expr("(end - start) div 4")
    return found.where(F.expr(f"end - start >= {LONG}")).select("record_id", (F.col("start") + quarter).alias("start"), (F.col("end") - quarter).alias("end"))


def coverage_by_record(spark, sf_dir):
    found = _spans(spark, sf_dir)
    return spans.coverage(found, _anchors(found), 0.5)


def segment_spans(spark, sf_dir):
    return _spans(spark, sf_dir)


def uncovered_segments(spark, sf_dir):
    found = _spans(spark, sf_dir)
    return spans.uncovered(found, _anchors(found)).select("record_id", "idx")


def coverage_gate(spark, sf_dir):
    found = _spans(spark, sf_dir)
    passed = spans.coverage(found, _anchors(found), 0.5)
    return passed.groupBy("passed").agg(F.count("*").alias("records"), F.sum("covered").alias("covered"), F.sum("total").alias("total"))


def transcript_profile(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.groupBy("record_id").agg(
        F.count("*").alias("segments"), F.countDistinct("speaker").alias("speakers"), F.sum(F.length("text")).cast("long").alias("chars"),
        F.max(F.length("text")).cast("long").alias("longest"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def speaker_profile(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("record_id", "speaker").agg(F.count("*").alias("segments"), F.sum(F.length("text")).cast("long").alias("chars"))


def block_plan(spark, sf_dir):
    order = W.partitionBy("record_id").orderBy("idx")
    return segments(spark, sf_dir).select("record_id", "idx", F.expr(f"cast((row_number() over (partition by record_id order by idx) - 1) div {BLOCK} as bigint)").alias("block"), F.format_string("S%03d", F.row_number().over(order)).alias("suggestion_id"))


def block_profile(spark, sf_dir):
    s = segments(spark, sf_dir).join(block_plan(spark, sf_dir).select("record_id", "idx", "block"), ["record_id", "idx"])
    return s.groupBy("record_id", "block").agg(F.count("*").alias("segments"), F.sum(F.length("text")).cast("long").alias("chars"))


def _fulltext(s):
    listed = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return s.groupBy("record_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("fulltext"), F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"))


def project_fulltext(spark, sf_dir):
    return _fulltext(segments(spark, sf_dir)).select("record_id", F.length("fulltext").cast("long").alias("chars"), sha256(F.col("fulltext")).alias("sha256"), "speakers")


def revision_identity(spark, sf_dir):
    """Digest of the canonical JSON: keys in order, nothing escaped that needn't be, control escapes in lower case."""
    listed = F.array_sort(F.collect_list(F.struct("idx", F.struct(F.col("idx").alias("index"), "speaker", "text").alias("s"))))
    r = segments(spark, sf_dir).groupBy("record_id").agg(F.transform(listed, lambda x: x["s"]).alias("segments"))
    canon = F.to_json(F.struct(F.lit("transcript_revision").alias("domain"), "segments", F.lit(1).alias("v")), {"ignoreNullFields": "false"})
    return r.select("record_id", sha256(canon).alias("revision_sha256"))


def turn_contiguity(spark, sf_dir):
    order = W.partitionBy("record_id").orderBy("idx")
    s = segments(spark, sf_dir).withColumn("ok", F.col("idx") == F.row_number().over(order) - 1)
    return s.groupBy("record_id").agg(F.bool_and("ok").alias("contiguous"))


def _timed(spark, sf_dir):
    s = segments(spark, sf_dir).join(_spans(spark, sf_dir), ["record_id", "idx"])
    return s.select("record_id", "idx", (F.col("start") * 10).alias("start_ms"), (F.col("end") * 10).alias("end_ms"), F.upper("speaker").alias("speaker"), "text")


def srt_roundtrip(spark, sf_dir):
    return srt.parse(srt.render(_timed(spark, sf_dir))).select("record_id", F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms", "speaker", "text", "problem")


def srt_refusals(spark, sf_dir):
    """Fixture convention: by record_id modulo 6, the second block of a rendered file has no time (1), begins too early (2),
    ends too early (3), has no words (4), or its speaker's label stands on the second line (5)."""
    rendered = srt.render(_timed(spark, sf_dir))
    block = r"(?s)(\n\n2\n)(\S+) --> (\S+)\n(.*?)(?=\n\n3\n|\n*\z)"
    swapped = {1: "$1$2 -> $3\n$4", 2: "$100:00:00,000 --> $3\n$4", 3: "$1$3 --> $2\n$4", 4: "$1$2 --> $3\nNAME:", 5: "$1$2 --> $3\nfirst\n$4"}
    broken = F.col("srt")
    for m, new in swapped.items():
        broken = F.when(F.col("record_id") % 6 == m, F.regexp_replace("srt", block, new)).otherwise(broken)
    return srt.accepted(srt.parse(rendered.select("record_id", broken.alias("srt"))))


QUERIES = {f.__name__: f for f in (coverage_by_record, segment_spans, uncovered_segments, coverage_gate, transcript_profile, speaker_profile, block_plan, block_profile, project_fulltext, revision_identity, turn_contiguity, srt_roundtrip, srt_refusals)}
SQL = {
    "srt_refusals": f"""WITH {_ANCHORS_SQL}, t AS (SELECT record_id, idx, "start" * 10 AS a, "end" * 10 AS b FROM sp),
u AS (SELECT record_id, idx, CASE WHEN idx <> 1 THEN a WHEN record_id % 6 = 1 THEN NULL WHEN record_id % 6 = 2 THEN 0 WHEN record_id % 6 = 3 THEN b ELSE a END AS a,
             CASE WHEN idx <> 1 THEN b WHEN record_id % 6 = 1 THEN NULL WHEN record_id % 6 = 3 THEN a ELSE b END AS b, idx = 1 AND record_id % 6 = 4 AS empty FROM t),
w AS (SELECT *, a < max(b) OVER o OR a < max(a) OVER o AS late FROM u WINDOW o AS (PARTITION BY record_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT record_id, idx, CASE WHEN a IS NULL THEN 'time' WHEN b < a THEN 'order' WHEN empty THEN 'empty' WHEN late THEN 'overlap' END AS problem FROM w)
SELECT record_id, CASE WHEN count(problem) = 0 THEN count(*)::BIGINT END AS segments,
coalesce(array_to_string(list(idx || ':' || problem ORDER BY idx) FILTER (problem IS NOT NULL)[1:5], ','), '') AS problems FROM p GROUP BY 1""",
    "coverage_by_record": f"""WITH {_ANCHORS_SQL}
SELECT sp.record_id, count(hit.idx)::BIGINT AS covered, count(*)::BIGINT AS total, count(hit.idx) / count(*) AS ratio, count(hit.idx) / count(*) >= 0.5 AS passed
FROM sp LEFT JOIN hit USING (record_id, idx) GROUP BY sp.record_id""",
    "segment_spans": f'WITH {_ANCHORS_SQL} SELECT record_id, idx, "start", "end" FROM sp',
    "uncovered_segments": f"WITH {_ANCHORS_SQL} SELECT sp.record_id, sp.idx FROM sp ANTI JOIN hit USING (record_id, idx)",
    "coverage_gate": f"""WITH {_ANCHORS_SQL}, r AS (SELECT sp.record_id, count(hit.idx) AS c, count(*) AS t FROM sp LEFT JOIN hit USING (record_id, idx) GROUP BY sp.record_id)
SELECT c / t >= 0.5 AS passed, count(*)::BIGINT AS records, sum(c)::BIGINT AS covered, sum(t)::BIGINT AS total FROM r GROUP BY 1""",
    "transcript_profile": f"WITH {_SEGMENTS} SELECT record_id, count(*)::BIGINT AS segments, count(DISTINCT speaker)::BIGINT AS speakers, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest, min(idx) AS first_idx, max(idx) AS last_idx FROM seg GROUP BY 1",
    "speaker_profile": f"WITH {_SEGMENTS} SELECT record_id, speaker, count(*)::BIGINT AS segments, sum(length(text))::BIGINT AS chars FROM seg GROUP BY 1, 2",
    "block_plan": f"WITH {_SEGMENTS} SELECT record_id, idx, ((row_number() OVER w - 1) // {BLOCK})::BIGINT AS block, 'S' || lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') AS suggestion_id FROM seg WINDOW w AS (PARTITION BY record_id ORDER BY idx)",
    "block_profile": f"WITH {_SEGMENTS}, b AS (SELECT *, ((row_number() OVER (PARTITION BY record_id ORDER BY idx) - 1) // {BLOCK})::BIGINT AS block FROM seg) SELECT record_id, block, count(*)::BIGINT AS segments, sum(length(text))::BIGINT AS chars FROM b GROUP BY 1, 2",
    "project_fulltext": f"WITH {_SEGMENTS}, f AS (SELECT record_id, string_agg(text, chr(10) ORDER BY idx) AS t, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM seg GROUP BY 1) SELECT record_id, length(t)::BIGINT AS chars, sha256(t) AS sha256, speakers FROM f",
    "revision_identity": f"""WITH {_SEGMENTS}, j AS (SELECT record_id, string_agg('{{"index":' || idx || ',"speaker":"' || speaker || '","text":"' || replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"}}', ',' ORDER BY idx) AS s FROM seg GROUP BY 1)
SELECT record_id, sha256('{{"domain":"transcript_revision","segments":[' || s || '],"v":1}}') AS revision_sha256 FROM j""",
    "turn_contiguity": f"WITH {_SEGMENTS}, o AS (SELECT record_id, idx = row_number() OVER (PARTITION BY record_id ORDER BY idx) - 1 AS ok FROM seg) SELECT record_id, bool_and(ok) AS contiguous FROM o GROUP BY 1",
    "srt_roundtrip": f"""WITH {_ANCHORS_SQL} SELECT record_id, idx, "start" * 10 AS start_ms, "end" * 10 AS end_ms, upper(speaker) AS speaker, trim(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g')) AS text, CAST(NULL AS VARCHAR) AS problem FROM seg JOIN sp USING (record_id, idx)""",
}
