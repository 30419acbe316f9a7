"""Queries over cues, contracts, registers, freshness and stored objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions.text import sha256
from annalist.operators import contracts, freshness, graph, registers
from annalist.plans.workflow import KINDS, events
from annalist.sources import cues, mappings, store
from annalist.sources.tables import read, segments

#: Fixture convention: turns as WebVTT cues of one second each, with a head, a note and ids; Spark and DuckDB both read it.
_HEAD = "WEBVTT fixture\nlanguage: none\n\nNOTE made from turns\nof a conversation\n\n"
_STAMP = "lpad(cast(floor(({0}) / 3600) as int)::string, 2, '0') || ':' || lpad(cast(floor(({0}) / 60) % 60 as int)::string, 2, '0') || ':' || lpad((({0}) % 60)::string, 2, '0') || '.000'"
_LINES = f"'turn ' || idx::string || chr(10) || {_STAMP.format('idx')} || ' --> ' || {_STAMP.format('idx + 1')} || ' align:start' || chr(10)"


#: Turns of the files of one task; by bytes alone, far more would be merged than its lines and their windows leave room for.
TURNS = 2_500


def _files(spark, sf_dir):
    s = segments(spark, sf_dir)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-s.count() // TURNS))
    s = s.repartition(parts, "record_id").withColumn("body", F.expr(r"coalesce(nullif(trim(regexp_replace(text, r'\s*\n\s*', '\n')), ''), '-')"))
    s = s.select("record_id", "idx", F.expr(f"{_LINES} || body || chr(10) || chr(10)").alias("block"))
    listed = F.array_sort(F.collect_list(F.struct("idx", "block")))
    return s.groupBy("record_id").agg(F.concat(F.lit(_HEAD), F.array_join(F.transform(listed, lambda x: x["block"]), "")).alias("source")).withColumn("format", F.lit("vtt"))


def vtt_cues(spark, sf_dir):
    return cues.scan(_files(spark, sf_dir))


def cue_render(spark, sf_dir):
    """Every file with another letter in its spoken text, and with its own text (which gives the file itself)."""
    files = _files(spark, sf_dir)
    found = cues.accepted(cues.scan(files, payloads=True)).withColumn("other", F.replace("payload", F.lit("e"), F.lit("<i>e</i>")))
    both = cues.render(files, found, {"changed": "other", "again": "payload"})
    return both.select("record_id", sha256(F.col("changed")).alias("sha256"), (F.col("again") == F.col("source")).alias("identity"))


#: Fixture convention: payloads by event type that keep or break their contract in all ways.
_KIND = "CASE WHEN event_type = 'error' AND value < 10 THEN 'status.set' WHEN event_type = 'error' THEN 'anchor.checked' ELSE " + "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items() if a != "error") + " END END"
_PAYLOAD = """CASE event_type WHEN 'signup' THEN '{"record_id":"' || CASE WHEN value < 20 THEN 'other' ELSE user_id::string END || '","profile":"p"}'
WHEN 'view' THEN '{"sha256":"x","record_id":"r","filename":"f"}' WHEN 'click' THEN CASE WHEN value < 5 THEN '{"artifact":"a","artifact":"b"}' ELSE '{"artifact":"a","sha256":"x"}' END
WHEN 'purchase' THEN '{"quote":"q","text":"t"}' ELSE '{"artifact":"a","outcome":"exact","shade":1,"hue":2}' END"""


def event_contract(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return contracts.payload_problems(e.select(F.col("event_id").alias("seq"), F.expr(_KIND).alias("kind"), F.col("user_id").cast("string").alias("record_id"), F.expr(_PAYLOAD).alias("payload")))


#: Fixture convention: documents as metadata records with findings by language.
_FIELDS = """CASE lang WHEN 'de' THEN '{"record_id":"r","interview_date":"2024-02-30","interviewer":"i","consent_status":"broad","accessRights":"open","title":" ","language":"deu","keywords":"k"}'
WHEN 'fr' THEN '{"record_id":"r","interview_date":"2024-02-29","interviewer":"i","consent_status":"withdrawn","accessRights":"open","title":"t","language":"fra","keywords":["a",1]}'
WHEN 'en' THEN '{"record_id":7,"interview_date":"2024-02-29","interviewer":"i","consent_status":"closed","accessRights":"public","title":"t","language":"eng","autor":"x"}' ELSE '[1]' END"""


def metadata_findings(spark, sf_dir):
    return contracts.metadata_findings(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.expr(_FIELDS).alias("fields")), ["broad"])


def answer_outcomes(spark, sf_dir):
    """Fixture convention: an answer leaves system turns out, and has no code for turns of less than 25 characters."""
    s = segments(spark, sf_dir)
    entry = F.expr("""CASE WHEN speaker <> 'system' THEN '{"segment":' || idx || ',"code":"' || CASE WHEN length(text) < 25 THEN '' ELSE 'L1_X' END || '"}' END""")
    r = s.groupBy("record_id").agg(F.collect_list("idx").alias("expected"), F.collect_list(entry).alias("entries"))
    answer = F.concat(F.lit('{"results":['), F.array_join("entries", ","), F.lit("]}"))
    return r.select("record_id", contracts.answer_outcome(answer, F.col("expected"), ["L1_X"]).alias("outcome"))


def _have(spark, sf_dir):
    names = F.array(*[F.lit(s[3]) for s in graph.STEPS])
    e = events(spark, sf_dir).withColumn("artifact", F.element_at(names, (F.pmod("payload", F.lit(len(graph.STEPS))) + 1).cast("int")))
    last = e.groupBy("record_id", "artifact").agg(F.max("seq").alias("seq"))
    return last.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("artifact", "seq"))).alias("have"))  # one entry an artifact of the graph


def freshness_causes(spark, sf_dir):
    return freshness.evaluate(_have(spark, sf_dir), graph.STEPS)


def instance_outcomes(spark, sf_dir):
    """Fixture convention: signups register a user under the hundreds of their payload, errors retire it."""
    e = events(spark, sf_dir).withColumnRenamed("record_id", "coder_id")
    return registers.instances(e, F.col("kind") == "record.registered", F.col("kind") == "decision.withdrawn", F.expr("payload div 50"))


def ownership_ledger(spark, sf_dir):
    """Fixture convention: purchases hand a user from the old runtime to the old one, or to the new one from a value of 60."""
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    return registers.ownership(e.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), F.lit("old").alias("giver"), F.expr("CASE WHEN value < 60 THEN 'old' ELSE 'new' END").alias("taker")), "old")


def store_audit(spark, sf_dir):
    """Pages are stored by content; their urls' digests are named too, but nothing is stored under them."""
    p = read(spark, sf_dir, "pages")
    named = p.select(sha256(F.col("html")).alias("address")).unionByName(p.select(sha256(F.col("url")).alias("address")))
    return store.audit(store.objects(p, F.col("html")), named)


def sealed_roundtrip(spark, sf_dir):
    """Texts sealed for their document: opened for it, and for another."""
    key = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"))
    context = lambda c: F.to_json(F.struct(c.alias("doc_id"), F.lit(1).alias("v"))).cast("binary")
    d = read(spark, sf_dir, "documents").select("doc_id", store.seal(F.col("text"), key, context(F.col("doc_id"))).alias("sealed"))
    return d.select("doc_id", F.sha2(store.unseal(F.col("sealed"), key, context(F.col("doc_id"))), 256).alias("sha256"), store.unseal(F.col("sealed"), key, context(F.col("doc_id") + 1)).isNull().alias("refused"))


def language_mapping(spark, sf_dir):
    """Fixture convention: templates filled in with deu; system turns have a code that the vocabulary lacks."""
    s = segments(spark, sf_dir).select("record_id", "idx", "speaker", sha256(F.col("text")).alias("segment_sha256"))
    filled = F.regexp_replace("tsv", "\t\n", "\tdeu\n")
    system = s.groupBy("record_id").agg(F.bool_or(F.col("speaker") == "system").alias("system"))
    m = mappings.mapping_template(s).join(system, "record_id").select("record_id", F.when(F.col("system"), F.regexp_replace(filled, "\n0\t([0-9a-f]+)\tdeu", "\n0\t$1\tqqq")).otherwise(filled).alias("tsv"))
    codes = mappings.iso_codes(spark.createDataFrame([("r", bytearray(b"deu\nund\nzxx\n"))], "release string, content binary"))
    return mappings.read_mapping(m, s, codes.select(F.explode("codes").alias("language")))


def group_partition(spark, sf_dir):
    """Labelled documents as members, documents and benchmark items as groups."""
    groups = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("member")).unionByName(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("member")))
    return registers.partition_findings(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("member")), groups)


QUERIES = {f.__name__: f for f in (vtt_cues, cue_render, event_contract, metadata_findings, answer_outcomes, freshness_causes, instance_outcomes, ownership_ledger, store_audit, sealed_roundtrip, language_mapping, group_partition)}

_HEAD_SQL = "'" + _HEAD.replace("\n", "' || chr(10) || '") + "'"
_TURNS = f"""seg AS (SELECT conv_id AS record_id, turn AS idx, coalesce(nullif(trim(regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g')), ''), '-') AS body FROM conversations),
bl AS (SELECT *, {_LINES} AS lines FROM seg)"""
_EV = "ev AS (SELECT event_id AS seq, event_type, user_id AS record_id, value, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS payload FROM events)"


def _freshness_sql() -> str:
    """One common table expression a step, in topological order."""
    steps = freshness.topological(graph.STEPS)
    makes, parts, last = {s[3]: k for k, s in enumerate(steps)}, [], "base"
    place = ", ".join(f"max(CASE WHEN ((payload % 16) + 16) % 16 = {k} THEN seq END) AS a{makes[s[3]]}" for k, s in enumerate(graph.STEPS))
    parts = [_EV, f"base AS (SELECT record_id, {place} FROM ev GROUP BY 1)"]
    for k, (_, _, needs, name, _) in enumerate(steps):
        inputs = [makes[a] for a in needs.split() if a in makes]
        older = " OR ".join(f"coalesce(a{i} > a{k}, false)" for i in inputs) or "false"
        cause = ", ".join([f"c{i}" for i in inputs] + [f"CASE WHEN a{k} IS NULL THEN 'absent {name}' WHEN {older} THEN 'older {name}' END"])
        parts.append(f"f{k} AS (SELECT *, coalesce({cause}) AS c{k} FROM {last})")
        last = f"f{k}"
    rows = " UNION ALL ".join(f"SELECT record_id, '{s[3]}' AS artifact, c{k} IS NULL AS usable, c{k} AS cause FROM {last}" for k, s in enumerate(steps))
    return f"WITH {', '.join(parts)} {rows}"


def _findings_sql() -> str:
    found = {"de": [("interview_date", "type"), ("title", "missing"), ("keywords", "list")], "fr": [("accessRights", "rights"), ("keywords", "type")],
             "en": [("record_id", "type"), ("accessRights", "enum"), ("consent_status", "consent"), ("autor", "unknown")]}
    rows = ", ".join(f"('{lang}', '{f}', '{k}')" for lang, pairs in found.items() for f, k in pairs)
    return f"""SELECT doc_id AS record_id, field, finding FROM documents JOIN (VALUES {rows}) v(lang, field, finding) USING (lang)
UNION ALL SELECT doc_id, NULL, 'json' FROM documents WHERE lang IS NULL OR lang NOT IN ('de', 'fr', 'en')"""


SQL = {
    "vtt_cues": f"""WITH {_TURNS}, o AS (SELECT *, length({_HEAD_SQL}) + coalesce(sum(length(lines) + length(body) + 2) OVER (PARTITION BY record_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(lines) AS s FROM bl)
SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY idx) - 1)::BIGINT AS cue_index, s::BIGINT AS "start", (s + length(body))::BIGINT AS "end", (idx * 1000)::BIGINT AS start_ms, ((idx + 1) * 1000)::BIGINT AS end_ms, CAST(NULL AS VARCHAR) AS problem FROM o""",
    "cue_render": f"""WITH {_TURNS} SELECT record_id, sha256({_HEAD_SQL} || string_agg(lines || replace(body, 'e', '<i>e</i>') || chr(10) || chr(10), '' ORDER BY idx)) AS sha256, true AS identity FROM bl GROUP BY 1""",
    "event_contract": """SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN CASE WHEN value < 20 THEN 'record' END WHEN 'view' THEN 'missing:bytes,media_type' WHEN 'click' THEN CASE WHEN value < 5 THEN 'json' END
WHEN 'purchase' THEN 'plaintext:quote,text' ELSE CASE WHEN value < 10 THEN 'forbidden' ELSE 'foreign:hue,shade' END END AS problem FROM events""",
    "metadata_findings": _findings_sql(),
    "answer_outcomes": """SELECT conv_id AS record_id, CASE WHEN bool_or(role <> 'system' AND length(text) < 25) THEN 'entry' WHEN bool_and(role = 'system') THEN 'ids' WHEN bool_or(role = 'system') THEN 'incomplete' ELSE 'ok' END AS outcome FROM conversations GROUP BY 1""",
    "freshness_causes": _freshness_sql(),
    "instance_outcomes": f"""WITH {_EV}, e AS (SELECT seq, record_id AS coder_id, event_type = 'signup' AS reg, payload // 50 AS v FROM ev WHERE event_type IN ('signup', 'error')),
f AS (SELECT coder_id, min(seq) AS first, arg_min(v, seq) AS bound FROM e WHERE reg GROUP BY 1), r AS (SELECT e.coder_id, min(seq) AS done FROM e JOIN f ON e.coder_id = f.coder_id AND NOT reg AND seq > first GROUP BY 1)
SELECT seq, coder_id, CASE WHEN reg THEN CASE WHEN seq = first THEN 'registered' WHEN coalesce(seq > done, false) OR v <> bound THEN 'conflict' ELSE 'repeat' END
ELSE CASE WHEN first IS NULL OR seq < first THEN 'unknown' WHEN seq > done THEN 'retired_before' ELSE 'retired' END END AS outcome FROM e LEFT JOIN f USING (coder_id) LEFT JOIN r USING (coder_id)""",
    "ownership_ledger": """WITH t AS (SELECT user_id AS record_id, event_id AS seq, CASE WHEN value < 60 THEN 'old' ELSE 'new' END AS taker FROM events WHERE event_type = 'purchase'),
n AS (SELECT record_id, min(seq) FILTER (taker = 'new') AS first_new FROM t GROUP BY 1), b AS (SELECT t.record_id, min(seq) AS broken_at FROM t JOIN n ON t.record_id = n.record_id AND seq > first_new GROUP BY 1)
SELECT t.record_id, CASE WHEN any_value(first_new) IS NULL THEN 'old' ELSE 'new' END AS owner, coalesce(any_value(first_new), max(seq)) AS seq, any_value(broken_at) AS broken_at FROM t JOIN n USING (record_id) LEFT JOIN b USING (record_id) GROUP BY 1""",
    "store_audit": "SELECT DISTINCT sha256(url) AS address, 'dangling' AS finding FROM pages WHERE url IS NOT NULL AND sha256(url) NOT IN (SELECT sha256(html) FROM pages WHERE html IS NOT NULL)",
    "sealed_roundtrip": "SELECT doc_id, sha256(text) AS sha256, true AS refused FROM documents",
    "language_mapping": """WITH s AS (SELECT conv_id AS record_id, bool_or(role = 'system') AS system FROM conversations GROUP BY 1)
SELECT record_id, turn AS idx, CASE WHEN system AND turn = 0 THEN 'qqq' ELSE 'deu' END AS language, CASE WHEN system AND turn = 0 THEN 'language' END AS problem FROM conversations c JOIN s ON s.record_id = c.conv_id""",
    "group_partition": """WITH g AS (SELECT member, count(*) AS n FROM (SELECT doc_id AS member FROM documents UNION ALL SELECT item_id FROM benchmark) GROUP BY 1), m AS (SELECT DISTINCT doc_id AS member FROM labels)
SELECT member, CASE WHEN n IS NULL THEN 'missing' WHEN m.member IS NULL THEN 'foreign' ELSE 'repeated' END AS finding FROM m FULL JOIN g USING (member) WHERE n IS NULL OR m.member IS NULL OR n > 1""",
}
