"""Queries over ingests, acts and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import acts, planning
from annalist.plans.documents import _MERGED, render_report
from annalist.plans.workflow import _EV, _FACTS, _SEALED, artifact_status, events, journal_seal
from annalist.sources import ingest
from annalist.sources.tables import read

KINDS = [s.produces[0] for s in planning.base()]
_SHA = lambda c: F.sha2(c.cast("string"), 256)


def _files(spark, sf_dir):
    """Pages as files: by page_id modulo 5 an SRT file of one block (0), a WebVTT file of one cue (1; every second: no cue at
    all), other text (2), bytes that aren't UTF-8 (3), a file without a name (4). Every third block's times are bad."""
    p = read(spark, sf_dir, "pages")
    n = F.col("page_id")
    block = F.concat(F.lit("1\n00:00:01,000 --> 00:00:0"), (n % 3).cast("string"), F.lit(",500\nA: "), n.cast("string"), F.lit("\n")).cast("binary")
    cue = F.concat(F.lit("WEBVTT\n\n00:01.000 --> 00:0"), (n % 3).cast("string"), F.lit(".500\nA: "), n.cast("string"), F.lit("\n")).cast("binary")
    content = F.when(n % 5 == 0, block).when(n % 10 == 1, F.lit("no cue at all").cast("binary")).when(n % 5 == 1, cue).when(n % 5 == 3, F.unhex(F.lit("C328"))).otherwise(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    path = F.when(n % 5 == 4, "folder/..srt/.").otherwise(F.concat(F.lit("in/"), n.cast("string"), F.when(n % 5 == 2, ".txt").when(n % 5 == 1, ".VTT").otherwise(".SRT")))
    return p.select((n % 50).alias("record_id"), path.alias("path"), content.alias("content"))


def _planned(spark, sf_dir):
    f = _files(spark, sf_dir)
    r = F.col("record_id")
    owners = f.select("record_id").distinct().where(r % 7 == 0).select("record_id", F.when(r % 2 == 0, "legacy").otherwise("annalist").alias("runtime"))
    return ingest.plan(f, owners, f.where(r % 4 == 1).select("record_id", F.sha2("content", 256).alias("sha256")), "annalist")


def ingest_plan(spark, sf_dir):
    return _planned(spark, sf_dir).drop("media_type")


def ingest_events(spark, sf_dir):
    p = _planned(spark, sf_dir)
    return ingest.ingest_events(p, p.where("record_id % 3 = 0").select("record_id").distinct()).groupBy("record_id", "kind").agg(F.count("*").alias("n"))


def observed_inputs(spark, sf_dir):
    e = events(spark, sf_dir)
    role = F.concat(F.lit("role-"), (F.col("record_id") % 40).cast("string"))
    seen = e.groupBy(role.alias("role")).agg(_SHA(F.max("payload") % 3).alias("sha256"))
    return ingest.observed(seen, e.where("kind = 'source.ingested'").select(role.alias("role"), "seq", _SHA(F.col("payload") % 3).alias("sha256")))


def key_sets(spark, sf_dir):
    """Payloads of all variants, of which every third lacks its first field and every fifth has one more."""
    e = events(spark, sf_dir).where("kind = 'record.registered'")
    names = list(acts.KEYS)
    n = (F.col("payload") % len(names)).cast("int")
    keys = F.element_at(F.array(*[F.split(F.lit(k), " ") for k in acts.KEYS.values()]), n + 1)
    given = F.when(F.col("payload") % 3 == 0, F.slice(keys, 2, 100)).otherwise(keys)
    given = F.when(F.col("payload") % 5 == 0, F.concat(given, F.array(F.lit("extra")))).otherwise(given)
    payload = F.concat(F.lit("{"), F.array_join(F.transform(given, lambda k: F.concat(F.lit('"'), k, F.lit('":1'))), ","), F.lit("}"))
    d = acts.key_differences(F.element_at(F.array(*map(F.lit, names)), n + 1), payload)
    return e.select("seq", d.alias("d")).select("seq", F.array_join("d.missing", ",").alias("missing"), F.array_join("d.foreign", ",").alias("foreign"))


def decision_check(spark, sf_dir):
    e = events(spark, sf_dir).where("kind = 'decision.recorded'")
    p = F.col("payload")
    d = e.select("seq", "payload", F.when(p % 7 == 0, "").otherwise("l1.adjudicated").alias("artifact"), F.when(p % 11 == 0, "AB").otherwise(_SHA(p)).alias("subject_sha256"), F.when(p % 13 == 0, "MAYBE").when(p % 2 == 0, "REJECT").otherwise("ACCEPT").alias("verdict"),
                 F.when(p % 17 == 0, "x y").otherwise("REF-1").alias("reference"), F.when(p % 19 != 0, "human").alias("actor"), F.when(p % 23 == 0, "2024-01-01").otherwise("2024-01-01T00:00:00Z").alias("at"))
    return d.select("seq", acts.decision_problem(p % 3 == 0).alias("problem"))


#: Fixture convention: ids of the profile have as many digits as any record_id fits in; with three, records from 1000 on had none.
DIGITS = 19


def key_gate(spark, sf_dir):
    e = events(spark, sf_dir)
    name = lambda c: F.format_string(f"REC-%0{DIGITS}d", c)
    p, r = F.col("payload"), name(F.col("record_id"))
    k = e.select("seq", F.when(p % 7 == 0, "7").otherwise(r).alias("current_id"), F.when(p % 11 == 0, "workspace").otherwise("record").alias("scope"), F.when(p % 13 == 0, "REC-7").when(p % 17 == 0, name(F.lit(999).cast("long"))).otherwise(r).alias("scope_id"),
                 F.when(p % 5 == 0, "other").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (p % len(KINDS) + 1).cast("int"))).alias("kind"))
    return k.select("seq", acts.key_gate("REC", DIGITS, KINDS).alias("reason"))


def _artifacts(spark, sf_dir):
    e = events(spark, sf_dir).where("kind = 'artifact.produced'")
    return e.groupBy("record_id", F.concat(F.lit("a"), (F.col("payload") % 4).cast("string")).alias("artifact")).agg(_SHA(F.max_by(F.col("payload") % 10, "seq")).alias("sha256"), (F.max("payload") % 2 == 0).alias("bind"))


def derivation_events(spark, sf_dir):
    """Derivations against a journal that has some of the events already, some of them for other bytes."""
    e = events(spark, sf_dir).where("kind in ('source.ingested', 'decision.recorded', 'record.registered')")
    kind = F.when(F.col("kind") == "source.ingested", "artifact.produced").when(F.col("kind") == "decision.recorded", "receipt.recorded").otherwise("anchor.checked")
    last = e.groupBy("record_id", F.concat(F.lit("a"), (F.col("payload") % 4).cast("string")).alias("artifact"), kind.alias("kind")).agg(_SHA(F.max_by(F.col("payload") % 10, "seq")).alias("sha256"))
    return acts.derivation(_artifacts(spark, sf_dir), last)


def gate_events(spark, sf_dir):
    """Gates against the journal of ``derivation_events``, whose decisions are the table's withdrawals."""
    e = events(spark, sf_dir).where("kind in ('source.ingested', 'decision.withdrawn')")
    kind = F.when(F.col("kind") == "source.ingested", "artifact.produced").otherwise("decision.recorded")
    last = e.groupBy("record_id", F.concat(F.lit("a"), (F.col("payload") % 4).cast("string")).alias("artifact"), kind.alias("kind")).agg(_SHA(F.max_by(F.col("payload") % 10, "seq")).alias("sha256"))
    return acts.derivation(_artifacts(spark, sf_dir), last, True)


def package_differences(spark, sf_dir):
    """Reports of documents as stored, of which every fifth entry was changed and every seventh is lost, against a new rendering."""
    again = render_report(spark, sf_dir).select("doc_id", "start", "value")
    stored = again.where("start % 7 > 0").select("doc_id", "start", F.when(F.col("start") % 5 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("value"))
    return acts.differences(stored, again)


def moved_inputs(spark, sf_dir):
    a = _artifacts(spark, sf_dir)
    p = events(spark, sf_dir).where("kind = 'decision.recorded'").groupBy("record_id", F.concat(F.lit("a"), (F.col("payload") % 5).cast("string")).alias("artifact")).agg(_SHA(F.max_by(F.col("payload") % 10, "seq")).alias("sha256"))
    return acts.moved_inputs(p, a)


def resolved_humans(spark, sf_dir):
    """Requests name people or models by number; every third names none."""
    e = events(spark, sf_dir).where("kind = 'record.registered'")
    i = spark.range(60).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("coder_id"), F.when(F.col("id") % 4 == 0, "model").otherwise("human").alias("source"), (F.col("id") % 5 > 0).alias("active"))
    return acts.resolve_human(e.select(F.col("seq").alias("request"), F.when(F.col("payload") % 3 > 0, F.concat(F.lit("c"), F.col("payload").cast("string"))).alias("name")), i)


def confirmed_texts(spark, sf_dir):
    """Documents as texts, of which every fifth isn't stored; markers confirm them, of which some were rejected later."""
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    i, sha = F.col("doc_id"), F.sha2("content", 256)
    marker = F.sha2(acts.marker(i.cast("string"), sha, F.lit("human"), F.lit("segment_projection"), 2, "fixture"), 256)
    gates = d.select(i.alias("record_id"), marker.alias("marker_sha256"), sha.alias("text_sha256"))
    first = gates.where(F.col("record_id") % 3 > 0).select("record_id", F.col("marker_sha256").alias("subject_sha256"), F.lit("ACCEPT").alias("verdict"), F.lit("REF-1").alias("reference"), F.lit(1).alias("seq"))
    later = gates.where(F.col("record_id") % 7 == 1).select("record_id", F.col("marker_sha256").alias("subject_sha256"), F.lit("REJECT").alias("verdict"), F.lit("REF-2").alias("reference"), F.lit(2).alias("seq"))
    return acts.confirmed_text(gates, first.unionByName(later), d.where(i % 5 > 0).select(sha.alias("address"), "content"))


def release_digests(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    r = d.select("doc_id", i.alias("record_id"), F.lit("2024-01-01").alias("interview_date"), F.when(F.col("doc_id") % 9 > 0, "x").alias("interviewer"), F.lit("granted").alias("consent_status"), F.lit("open").alias("accessRights"), F.concat(F.lit('"T" '), i).alias("title"), F.col("lang").alias("language"))
    return r.select("doc_id", acts.release_digest().alias("sha256"))


def human_history(spark, sf_dir):
    """Of every record, the digest of its registrations."""
    return acts.human_history(journal_seal(spark, sf_dir).where("kind = 'record.registered'"), "record_id")


def reports(spark, sf_dir):
    """Reports of records' statuses, with what to run next."""
    s = artifact_status(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("record_id") % len(KINDS) + 1).cast("int"))
    text = acts.six_lines(F.col("status"), F.col("decision"), F.when(F.col("record_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")), F.col("record_id") % 5 == 0, F.lit(False),
                          F.when(F.col("status") != "READY", acts.repair(kind)), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return s.select("record_id", text.alias("report"))


QUERIES = {f.__name__: f for f in (ingest_plan, ingest_events, observed_inputs, key_sets, decision_check, key_gate, derivation_events, gate_events, package_differences, moved_inputs, resolved_humans, confirmed_texts, release_digests, human_history, reports)}

_H = lambda x: f"sha256(CAST({x} AS VARCHAR))"
_PLAN = """f AS (SELECT page_id AS n, page_id % 50 AS record_id, page_id % 5 AS m, CASE WHEN page_id % 5 = 0 THEN encode('1' || chr(10) || '00:00:01,000 --> 00:00:0' || page_id % 3 || ',500' || chr(10) || 'A: ' || page_id || chr(10))
  WHEN page_id % 10 = 1 THEN encode('no cue at all') WHEN page_id % 5 = 1 THEN encode('WEBVTT' || chr(10) || chr(10) || '00:01.000 --> 00:0' || page_id % 3 || '.500' || chr(10) || 'A: ' || page_id || chr(10))
  WHEN page_id % 5 = 3 THEN from_hex('C328') ELSE encode(coalesce(html, '')) END AS content FROM pages),
p AS (SELECT record_id, CASE WHEN m = 4 THEN NULL WHEN m = 2 THEN n || '.txt' WHEN m = 1 THEN n || '.VTT' ELSE n || '.SRT' END AS name, sha256(content) AS sha256, octet_length(content)::BIGINT AS bytes, CASE WHEN m < 2 AND n % 3 > 0 AND n % 10 <> 1 THEN 1 END::BIGINT AS cues,
 CASE WHEN record_id % 14 = 0 THEN 'owner' WHEN m IN (2, 4) THEN 'suffix' WHEN m = 3 THEN 'utf8' WHEN n % 3 = 0 OR n % 10 = 1 THEN 'parse' WHEN record_id % 4 = 1 THEN 'known' ELSE 'new' END AS outcome FROM f)"""
_ART = f"ar AS (SELECT record_id, 'a' || payload % 4 AS artifact, {_H('arg_max(payload % 10, seq)')} AS sha256, max(payload) % 2 = 0 AS bind FROM ev WHERE kind = 'artifact.produced' GROUP BY 1, 2)"
_KEYLISTS = "[" + ", ".join("[" + ", ".join(f"'{k}'" for k in v.split()) + "]" for v in acts.KEYS.values()) + "]"
_BASE = planning.base()
_REPAIRS = "[" + ", ".join(f"'{'decide' if s.gate else 'continue'} {s.name}'" for s in _BASE) + "]"
SQL = {
    "ingest_plan": f"WITH {_PLAN} SELECT * FROM p",
    "ingest_events": f"""WITH {_PLAN}, n AS (SELECT DISTINCT record_id, sha256 FROM p WHERE outcome = 'new')
SELECT record_id, 'source.ingested' AS kind, count(*)::BIGINT AS n FROM n GROUP BY 1 UNION ALL SELECT record_id, 'record.registered', 1 FROM n WHERE record_id % 3 > 0 GROUP BY 1""",
    "observed_inputs": f"""WITH {_EV}, s AS (SELECT record_id % 40 AS r, {_H('max(payload) % 3')} AS sha256 FROM ev GROUP BY 1), l AS (SELECT record_id % 40 AS r, {_H('arg_max(payload % 3, seq)')} AS now FROM ev WHERE kind = 'source.ingested' GROUP BY 1)
SELECT 'role-' || s.r AS role, sha256 FROM s LEFT JOIN l USING (r) WHERE sha256 IS DISTINCT FROM now""",
    "key_sets": f"""WITH {_EV}, k AS (SELECT seq, payload, {_KEYLISTS}[payload % 4 + 1] AS w FROM ev WHERE kind = 'record.registered')
SELECT seq, CASE WHEN payload % 3 = 0 THEN w[1] ELSE '' END AS missing, CASE WHEN payload % 5 = 0 THEN 'extra' ELSE '' END AS "foreign" FROM k""",
    "decision_check": f"""WITH {_EV} SELECT seq, CASE WHEN payload % 7 = 0 THEN 'artifact' WHEN payload % 11 = 0 THEN 'subject' WHEN payload % 13 = 0 THEN 'verdict' WHEN payload % 17 = 0 THEN 'reference' WHEN payload % 19 = 0 THEN 'actor' WHEN payload % 23 = 0 THEN 'time'
WHEN payload % 3 = 0 AND payload % 2 = 1 THEN 'negative' END AS problem FROM ev WHERE kind = 'decision.recorded'""",
    "key_gate": f"""WITH {_EV} SELECT seq, CASE WHEN payload % 7 = 0 THEN 'INVALID_CURRENT_RECORD_ID' WHEN payload % 11 = 0 THEN 'WORKSPACE_IDENTITY_UNAVAILABLE' WHEN payload % 13 = 0 THEN 'INVALID_SCOPE_ID' WHEN payload % 17 = 0 AND record_id <> 999 THEN 'SCOPE_ID_CONTEXT_MISMATCH'
WHEN payload % 5 = 0 THEN 'KIND_NOT_IN_ACTIVE_GRAPH' END AS reason FROM ev""",
    "derivation_events": f"""WITH {_EV}, {_ART}, l AS (SELECT record_id, 'a' || payload % 4 AS artifact, CASE kind WHEN 'source.ingested' THEN 'artifact.produced' WHEN 'decision.recorded' THEN 'receipt.recorded' ELSE 'anchor.checked' END AS kind, {_H('arg_max(payload % 10, seq)')} AS now
 FROM ev WHERE kind IN ('source.ingested', 'decision.recorded', 'record.registered') GROUP BY 1, 2, 3), r AS (SELECT record_id, artifact, sha256, unnest(CASE WHEN bind THEN ['artifact.produced', 'anchor.checked', 'receipt.recorded'] ELSE ['artifact.produced', 'receipt.recorded'] END) AS kind FROM ar)
SELECT record_id, artifact, kind, sha256 FROM r LEFT JOIN l USING (record_id, artifact, kind) WHERE CASE WHEN kind = 'anchor.checked' THEN now IS NULL ELSE now IS DISTINCT FROM sha256 END""",
    "gate_events": f"""WITH {_EV}, {_ART}, l AS (SELECT record_id, 'a' || payload % 4 AS artifact, CASE kind WHEN 'source.ingested' THEN 'artifact.produced' ELSE 'decision.recorded' END AS kind, {_H('arg_max(payload % 10, seq)')} AS now
 FROM ev WHERE kind IN ('source.ingested', 'decision.withdrawn') GROUP BY 1, 2, 3), r AS (SELECT record_id, artifact, sha256, unnest(list_concat(['artifact.produced', 'decision.recorded', 'receipt.recorded'], CASE WHEN bind THEN ['anchor.checked'] ELSE [] END)) AS kind FROM ar)
SELECT record_id, artifact, kind, sha256 FROM r LEFT JOIN l USING (record_id, artifact, kind) WHERE CASE WHEN kind = 'anchor.checked' THEN now IS NULL ELSE now IS DISTINCT FROM sha256 END""",
    "package_differences": f"""WITH {_MERGED} SELECT doc_id, "start", value || CASE WHEN "start" % 5 = 0 THEN '!' ELSE '' END AS value, 'stored' AS side FROM rep WHERE "start" % 7 > 0 AND "start" % 5 = 0
UNION ALL SELECT doc_id, "start", value, 'again' FROM rep WHERE "start" % 7 = 0 OR "start" % 5 = 0""",
    "moved_inputs": f"""WITH {_EV}, {_ART}, p AS (SELECT record_id, 'a' || payload % 5 AS artifact, {_H('arg_max(payload % 10, seq)')} AS planned FROM ev WHERE kind = 'decision.recorded' GROUP BY 1, 2)
SELECT record_id, artifact, planned, sha256 AS now FROM p LEFT JOIN ar USING (record_id, artifact) WHERE planned IS DISTINCT FROM sha256""",
    "resolved_humans": f"""WITH {_EV} SELECT seq AS request, CASE WHEN payload % 3 > 0 AND payload < 60 AND payload % 4 > 0 AND payload % 5 > 0 THEN 'c' || payload END AS actor,
CASE WHEN payload % 3 = 0 THEN 'many' WHEN payload >= 60 THEN 'unknown' WHEN payload % 4 = 0 THEN 'machine' WHEN payload % 5 = 0 THEN 'unknown' END AS problem FROM ev WHERE kind = 'record.registered'""",
    "confirmed_texts": """WITH d AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, sha256('{"actor":"human","domain":"transcript_confirmation","fulltext_origin":"segment_projection","profile_id":"fixture","record_id":"' || doc_id || '","revision_sha256":"' || s || '","v":2}') AS k FROM d)
SELECT doc_id AS record_id, s AS text_sha256, 'REF-1@' || left(k, 12) AS decision_id FROM m WHERE doc_id % 3 > 0 AND doc_id % 7 <> 1 AND s IN (SELECT s FROM d WHERE doc_id % 5 > 0)""",
    "release_digests": """SELECT doc_id, CASE WHEN doc_id % 9 > 0 AND lang IS NOT NULL THEN sha256('{"domain":"annalist.release.fields","fields":{"accessRights":"open","consent_status":"granted","interview_date":"2024-01-01","interviewer":"x","language":"' || lang || '","record_id":"' || doc_id || '","title":"\\"T\\" ' || doc_id || '"},"version":1}' || chr(10)) END AS sha256 FROM documents""",
    "human_history": f"WITH RECURSIVE {_SEALED} SELECT record_id, count(*)::BIGINT AS events, sha256(string_agg(digest, chr(10) ORDER BY seq)) AS sha256 FROM ch WHERE kind = 'record.registered' GROUP BY 1",
}
SQL["reports"] = f"""WITH {_FACTS} SELECT record_id, 'STATUS : ' || status || '  — ' || decision || chr(10) || 'CHANGED: ' || CASE WHEN record_id % 2 = 0 THEN 'a, b' ELSE 'none' END || chr(10) || 'SAFE   : Source data ' || CASE WHEN record_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END || '; Upload no' || chr(10)
|| 'NEXT   : ' || CASE WHEN status = 'READY' THEN '—' ELSE {_REPAIRS}[record_id % {len(KINDS)} + 1] END || chr(10) || 'CHECK  : —' || chr(10) || 'RECOVERY: —' AS report FROM st"""
