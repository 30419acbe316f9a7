"""Queries over subtitle files: their structure without their words, and what drafts and language assignments are named by."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions.text import normalized, sha256
from annalist.operators import profile
from annalist.plans.transcripts import _ANCHORS_SQL, _timed
from annalist.sources import ledgers, srt
from annalist.sources.tables import read

#: Segments of a block of the fixture.
SIZE = 2


def _files(spark, sf_dir):
    """Conversations as SRT files, with numbered speakers in even records. By record modulo 6 times have no arrow (1), there is one more
    block without words (3), or the bytes aren't UTF-8 (5)."""
    t, r = _timed(spark, sf_dir), F.col("record_id")
    number = F.when(F.col("speaker") == "USER", "1").when(F.col("speaker") == "ASSISTANT", "2").otherwise("3")
    made = srt.render(t.withColumn("speaker", F.when(r % 2 == 0, F.concat(F.lit("SPEAKER_"), number)).otherwise(F.col("speaker"))))
    text = F.when(r % 6 == 1, F.replace("srt", F.lit(" --> "), F.lit(" -> "))).when(r % 6 == 3, F.concat("srt", F.lit("\n99\n00:59:00,000 --> 00:59:01,000\nNAME:\n"))).otherwise(F.col("srt"))
    return made.select("record_id", F.when(r % 6 == 5, F.concat(F.unhex(F.lit("C328")), text.cast("binary"))).otherwise(text.cast("binary")).alias("content"))


def source_structure(spark, sf_dir):
    found = profile.structure(_files(spark, sf_dir), SIZE)
    return found.withColumns({"counts": F.to_json("counts"), "blocks": F.to_json("blocks")})


def draft_identity(spark, sf_dir):
    """Fixture convention: segments are of two languages in turn; every 5th record's mapping is in reverse order, odd ones have no draft."""
    f = _files(spark, sf_dir)
    s = srt.parse(f.where("record_id % 2 = 0").select("record_id", F.col("content").cast("string").alias("srt")))
    made = profile.drafts(s.withColumn("idx", F.col("idx").cast("long")), f)
    rows = F.transform("segments_sha256", lambda x, i: F.struct(i.cast("long").alias("index"), x.alias("segment_sha256"), F.when(i % 2 == 0, "deu").otherwise("ltz").alias("language")))
    rows = F.when(F.col("record_id") % 5 == 0, F.reverse(rows)).otherwise(rows)
    line = F.transform("rows", lambda x: F.concat_ws("\t", x["index"].cast("string"), x["segment_sha256"], x["language"]))
    mapped = made.select("record_id", rows.alias("rows")).unionByName(f.where("record_id % 2 = 1").select("record_id", F.array().cast("array<struct<index:bigint,segment_sha256:string,language:string>>").alias("rows")))
    told = profile.assignments(made, mapped.withColumn("content", F.concat(F.array_join(line, "\n"), F.lit("\n"))), "0" * 64)
    return told.join(made.select("record_id", "draft_sha256"), "record_id", "left").select("record_id", "draft_sha256", "assignment_sha256", "problem")


def ledger_files(spark, sf_dir):
    """Fixture convention: purchases hand a user on, by their number in the ledger of users with one remainder modulo 20; saved, spoiled
    and loaded. By remainder, files are no JSON (1), name owners (2), have another default (3), transfers that are no list (4), or one
    that has no target (5)."""
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    who = lambda c: F.when(c, "old").otherwise("new")
    even = F.col("value") < 60
    t = e.select((F.col("user_id") % 20).alias("ledger"), F.col("event_id").alias("n"), F.col("user_id").cast("string").alias("record_id"), who(even).alias("from_runtime"), who(~even).alias("to_runtime"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.concat(F.lit("REF-"), F.col("event_id")).alias("reference"))
    m, text = F.col("ledger"), F.col("content").cast("string")
    spoiled = (
        F.when(m == 1, F.expr("substring(cast(content AS string), 2)")).when(m == 2, F.regexp_replace(text, ledgers.DERIVED, "owners")).when(m == 3, F.regexp_replace(text, '"default_runtime":"old"', '"default_runtime":"new"'))
        .when(m == 4, F.regexp_replace(text, r'"transfers":\[.*\]', '"transfers":{}')).when(m == 5, F.regexp_replace(text, r',"to":"(old|new)"\}\]', "}]")).otherwise(text))
    return ledgers.load(ledgers.save(t, "old").withColumn("content", spoiled.cast("binary")), "old")


def collapsed_digests(spark, sf_dir):
    """Digests of normalised pages in which two blank lines at most follow each other; every tag begins three lines."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", sha256(normalized(F.replace("html", F.lit("<"), F.lit("\n \n\n\n<")), 2)).alias("sha256"))


QUERIES = {f.__name__: f for f in (source_structure, draft_identity, ledger_files, collapsed_digests)}

_TC = lambda x: f"lpad(CAST({x} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({x} % 1000 AS VARCHAR), 3, '0')"
_FILES = f"""{_ANCHORS_SQL}, t AS (SELECT record_id, idx, "start" * 10 AS a, "end" * 10 AS b, CASE WHEN record_id % 2 = 0 THEN 'SPEAKER_' || CASE speaker WHEN 'user' THEN '1' WHEN 'assistant' THEN '2' ELSE '3' END ELSE upper(speaker) END AS who,
 regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') AS raw, trim(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g')) AS x FROM seg JOIN sp USING (record_id, idx)),
f AS (SELECT record_id, encode(string_agg(idx + 1 || chr(10) || {_TC('a')} || ' --> ' || {_TC('b')} || chr(10) || who || ': ' || raw || chr(10), chr(10) ORDER BY idx)) AS content FROM t GROUP BY 1)"""
_JSON = """'{"domain":"transcript_srt_draft_segment","end_ms":' || b || ',"index":' || idx || ',"speaker":"' || who || '","start_ms":' || a || ',"text":"' || replace(replace(replace(x, '\\', '\\\\'), '"', '\\"'), chr(9), '\\t') || '","v":1}'"""
SQL = {
    "ledger_files": """WITH t AS (SELECT user_id % 20 AS m, event_id, user_id, value < 60 AS low, ts FROM events WHERE event_type = 'purchase')
SELECT m AS ledger, (row_number() OVER (PARTITION BY m ORDER BY event_id) - 1)::INT AS n, CAST(user_id AS VARCHAR) AS record_id, CASE WHEN low THEN 'old' ELSE 'new' END AS from_runtime, CASE WHEN low THEN 'new' ELSE 'old' END AS to_runtime, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, 'REF-' || event_id AS reference, CAST(NULL AS VARCHAR) AS problem
FROM t WHERE m NOT BETWEEN 1 AND 5 UNION ALL SELECT DISTINCT m, NULL, NULL, NULL, NULL, NULL, NULL, ['json', 'owners', 'default', 'transfers', 'entry'][m] FROM t WHERE m BETWEEN 1 AND 5""",
    "collapsed_digests": """WITH a AS (SELECT page_id, regexp_replace(replace(html, '<', chr(10) || ' ' || chr(10) || chr(10) || chr(10) || '<'), '\\r\\n?', chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '[^\\S\\n]+(\\n|$)', '\\1', 'g') AS t FROM a), c AS (SELECT page_id, regexp_replace(regexp_replace(t, '^\\n{2,}', chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10) || chr(10), 'g') AS t FROM b)
SELECT page_id, sha256(regexp_replace(t, '\\n+$', '') || chr(10)) AS sha256 FROM c""",
    "source_structure": f"""WITH {_FILES}, g AS (SELECT record_id, CASE record_id % 6 WHEN 1 THEN 'cues' WHEN 5 THEN 'cues' WHEN 3 THEN 'metadata' END AS error, count(*) AS n, arg_min(a, idx) AS fa, arg_min(b, idx) AS fb, arg_max(a, idx) AS la, arg_max(b, idx) AS lb, count(DISTINCT who) AS labels, sum(length(x))::BIGINT AS characters, max(length(x))::BIGINT AS longest FROM t GROUP BY 1),
c AS (SELECT record_id, '{{' || string_agg('"' || who || '":' || n, ',' ORDER BY who) || '}}' AS counts FROM (SELECT record_id, who, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT record_id, '[' || string_agg('{{"block":' || k || ',"segments":' || n || ',"characters":' || m || '}}', ',' ORDER BY k) || ']' AS blocks FROM (SELECT record_id, idx // {SIZE} + 1 AS k, count(*) AS n, sum(length(x)) AS m FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT record_id, error, CASE WHEN error IS NULL THEN sha256(content) END AS sha256, CASE WHEN error IS NULL THEN octet_length(content)::BIGINT END AS bytes, CASE WHEN error IS NULL THEN n END AS cues, CASE WHEN error IS NULL THEN {_TC('fa')} END AS first_start, CASE WHEN error IS NULL THEN {_TC('fb')} END AS first_end,
 CASE WHEN error IS NULL THEN {_TC('la')} END AS last_start, CASE WHEN error IS NULL THEN {_TC('lb')} END AS last_end, CASE WHEN error IS NULL THEN labels END AS labels, CASE WHEN error IS NULL THEN n END AS occurrences, CASE WHEN error IS NULL AND record_id % 2 = 0 THEN counts END AS counts,
 CASE WHEN error IS NULL THEN characters END AS characters, CASE WHEN error IS NULL THEN longest END AS longest, CASE WHEN error IS NULL THEN blocks END AS blocks FROM g JOIN c USING (record_id) JOIN b USING (record_id) JOIN f USING (record_id)""",
    "draft_identity": f"""WITH {_FILES}, s AS (SELECT record_id, list({_JSON} ORDER BY idx) AS j FROM t WHERE record_id % 2 = 0 GROUP BY 1),
d AS (SELECT record_id, list_transform(j, lambda v: sha256(v)) AS h, sha256(content) AS c, sha256('{{"domain":"transcript_srt_draft","parser_version":"{profile.PARSER}","profile_id":"{profile.PROFILE}","projection_version":"{profile.PROJECTION}","segments":[' || array_to_string(j, ',') || '],"srt_bytes_sha256":"' || sha256(content) || '","v":1}}') AS draft_sha256 FROM s JOIN f USING (record_id)),
a AS (SELECT *, list_transform(range(len(h)), lambda i: '{{"index":' || i || ',"language":"' || ['deu', 'ltz'][i % 2 + 1] || '","segment_sha256":"' || h[i + 1] || '"}}') AS r, array_to_string(list_transform(range(len(h)), lambda i: i || chr(9) || h[i + 1] || chr(9) || ['deu', 'ltz'][i % 2 + 1]), chr(10)) || chr(10) AS m FROM d)
SELECT f.record_id, draft_sha256, CASE WHEN f.record_id % 5 > 0 OR len(h) < 2 THEN sha256('{{"assignments":[' || array_to_string(r, ',') || '],"domain":"transcript_segment_language_assignment","draft_segments_sha256":"' || draft_sha256 || '","iso6393_vocabulary_sha256":"' || repeat('0', 64) || '","mapping_bytes_sha256":"' || sha256(m)
 || '","parser_version":"{profile.PARSER}","srt_bytes_sha256":"' || c || '","target_record_id":' || f.record_id || ',"v":1}}') END AS assignment_sha256, CASE WHEN f.record_id % 2 = 1 THEN 'draft' WHEN f.record_id % 5 = 0 AND len(h) > 1 THEN 'segments' END AS problem FROM f LEFT JOIN a USING (record_id)""",
}
