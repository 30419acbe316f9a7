"""Queries over the event journal and the step graph."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from annalist.operators import graph, journal
from annalist.sources.tables import read

#: Fixture convention: events of the table as journal kinds.
KINDS = {"signup": "record.registered", "view": "source.ingested", "click": "artifact.produced", "purchase": "decision.recorded", "error": "decision.withdrawn"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"


def events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.expr(_CASE).alias("kind"), F.col("user_id").alias("record_id"), F.get_json_object("props", "$.k").cast("long").alias("payload"))


def journal_seal(spark, sf_dir):
    return journal.seal(events(spark, sf_dir))


def _tampered(spark, sf_dir):
    """Fixture convention: by (7 seq + record_id) modulo 50, rows of a sealed journal are altered (0), lost (1), or begin
    a chain of their own (2)."""
    j = journal_seal(spark, sf_dir).withColumn("m", (F.col("seq") * 7 + F.col("record_id")) % 50).where("m <> 1")
    fresh = F.sha2(journal.envelope(F.col("kind"), F.col("payload"), F.lit(journal.GENESIS), F.col("record_id"), F.col("seq")), 256)
    return j.select("record_id", "seq", "kind", F.when(F.col("m") == 0, F.col("payload") + 1).otherwise(F.col("payload")).alias("payload"),
                    F.when(F.col("m") == 2, journal.GENESIS).otherwise(F.col("prev")).alias("prev"), F.when(F.col("m") == 2, fresh).otherwise(F.col("digest")).alias("digest"))


def journal_verify(spark, sf_dir):
    return journal.verify(_tampered(spark, sf_dir))


def journal_head(spark, sf_dir):
    return journal.head(journal_seal(spark, sf_dir))


def latest_by_kind(spark, sf_dir):
    return journal.latest(events(spark, sf_dir), "record_id", "kind")


def append_once(spark, sf_dir):
    return journal.append_once(events(spark, sf_dir), "record_id", "kind", "payload")


def receipt_asof_decision(spark, sf_dir):
    e = events(spark, sf_dir)
    return journal.as_of(e.where("kind = 'artifact.produced'"), e.where("kind = 'decision.recorded'"), "record_id")


def withdrawal_latch(spark, sf_dir):
    e = events(spark, sf_dir)
    return journal.latch(e, F.col("kind") == "decision.withdrawn", F.col("kind") == "record.registered").select("seq", "record_id", "latched")


def replay_facts(spark, sf_dir):
    return journal.facts(events(spark, sf_dir))


def artifact_status(spark, sf_dir):
    return journal.axes(replay_facts(spark, sf_dir))


def workspace_status(spark, sf_dir):
    """Worst status over all records, and the records of each status."""
    s = artifact_status(spark, sf_dir)
    return s.groupBy("status").agg(F.count("*").alias("records"), F.min(journal.rank(F.col("status"))).alias("rank"))


AXES = (("n/a", "bound", "drifted", "unknown"), ("n/a", "current", "stale", "unverifiable"), ("n/a", "accepted", "undecided", "rejected", "withdrawn"))
#: With values that no axis knows, and none at all.
WIDER = tuple((*a, "other", None) for a in AXES)


def status_truth_table(spark, sf_dir):
    d = spark.createDataFrame(list(product(*WIDER)), "binding string, derivation string, decision string")
    return d.withColumn("status", journal.ladder(F.col("binding"), F.col("derivation"), F.col("decision"), F.lit(True)))


def graph_upstream(spark, sf_dir):
    return graph.upstream(spark)


def egress_paths(spark, sf_dir):
    return graph.egress_paths(spark)


def next_steps(spark, sf_dir):
    """Fixture convention: a record has the artifact of the n-th step if it has an event whose payload modulo 16 is n."""
    names = F.array(*[F.lit(s[3]) for s in graph.STEPS])
    have = events(spark, sf_dir).groupBy("record_id").agg(F.array_sort(F.collect_set(F.element_at(names, (F.pmod("payload", F.lit(len(graph.STEPS))) + 1).cast("int")))).alias("artifacts"))
    return graph.next_steps(spark, have)


def contract_totality(spark, sf_dir):
    """Artifacts that a step requires and none produces, or that a step produces and none requires."""
    s = graph.steps(spark)
    need, make = s.select(F.explode("requires").alias("artifact")).distinct().withColumn("required", F.lit(True)), s.select(F.col("produces").alias("artifact")).withColumn("produced", F.lit(True))
    j = need.join(make, "artifact", "full_outer")
    return j.select("artifact", F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("produced", F.lit(False)).alias("produced"))


def recovery_matrix(spark, sf_dir):
    rows = list(product(*[(True, False)] * 5, ("none", "prefix", "other")))
    d = spark.createDataFrame(rows, "intent boolean, valid boolean, complete boolean, prestate boolean, foreign_event boolean, written string")
    c = [F.col(x) for x in d.columns]
    return d.withColumn("class", graph.recovery(*c))


QUERIES = {f.__name__: f for f in (journal_seal, journal_verify, journal_head, latest_by_kind, append_once, receipt_asof_decision, withdrawal_latch, replay_facts, artifact_status, workspace_status, status_truth_table, graph_upstream, egress_paths, next_steps, contract_totality, recovery_matrix)}

_EV = f"ev AS (SELECT event_id AS seq, {_CASE} AS kind, user_id AS record_id, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS payload FROM events)"
_LATCH = "la AS (SELECT *, coalesce(last_value(CASE kind WHEN 'decision.withdrawn' THEN true WHEN 'record.registered' THEN false END IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS latched FROM ev)"
_FACTS = f"""{_EV}, {_LATCH}, fa AS (SELECT record_id,
 arg_max(payload, seq) FILTER (kind = 'source.ingested') AS source, max(seq) FILTER (kind = 'source.ingested') AS source_seq,
 arg_max(payload, seq) FILTER (kind = 'artifact.produced') AS produced, max(seq) FILTER (kind = 'artifact.produced') AS produced_seq,
 arg_max(payload, seq) FILTER (kind = 'decision.recorded' AND NOT latched) AS subject, max(seq) FILTER (kind = 'decision.recorded' AND NOT latched) AS decision_seq,
 arg_max(kind, seq) FILTER (kind IN ('decision.withdrawn', 'record.registered')) = 'decision.withdrawn' AS withdrawn FROM la GROUP BY 1),
ax AS (SELECT record_id, CASE WHEN produced IS NULL THEN 'unverifiable' WHEN source_seq > produced_seq THEN 'stale' ELSE 'current' END AS derivation,
 CASE WHEN coalesce(withdrawn, false) THEN 'withdrawn' WHEN subject = produced AND decision_seq > produced_seq THEN 'accepted' ELSE 'undecided' END AS decision FROM fa),
st AS (SELECT *, CASE WHEN derivation = 'unverifiable' THEN 'STOP' WHEN decision = 'withdrawn' THEN 'EXCLUDED' WHEN derivation = 'stale' THEN 'STALE' WHEN decision = 'undecided' THEN 'ACTION_NEEDED' ELSE 'READY' END AS status FROM ax)"""
_STEPS = "s(step, kind, req, produces, gate) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {str(e).lower()})" for a, b, c, d, e in graph.STEPS) + ")"
_EDGES = f"""{_STEPS}, need AS (SELECT step, unnest(string_split(req, ' ')) AS artifact FROM s WHERE req <> ''),
ed AS (SELECT s.step AS source, need.step AS target FROM need JOIN s ON s.produces = need.artifact)"""
_AXES = ", ".join(f"{n} AS (SELECT unnest([{', '.join('NULL' if v is None else repr(v) for v in a)}]) AS {n})" for n, a in zip(("binding", "derivation", "decision"), WIDER, strict=True))
_ENVELOPE = """'{"kind":"' || e.kind || '","payload":' || e.payload || ',"prev":"' || %s || '","record_id":' || e.record_id || ',"seq":' || e.seq || '}'"""
_ZERO = "repeat('0', 64)"
_SEALED = f"""{_EV}, nu AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS seq, kind, payload FROM ev),
ch AS (SELECT e.record_id, e.seq, e.kind, e.payload, {_ZERO} AS prev, sha256({_ENVELOPE % _ZERO}) AS digest FROM nu e WHERE seq = 1
  UNION ALL SELECT e.record_id, e.seq, e.kind, e.payload, ch.digest, sha256({_ENVELOPE % 'ch.digest'}) FROM ch JOIN nu e ON e.record_id = ch.record_id AND e.seq = ch.seq + 1)"""
SQL = {
    "journal_seal": f"WITH RECURSIVE {_SEALED} SELECT * FROM ch",
    "journal_head": f"WITH RECURSIVE {_SEALED} SELECT record_id, max(seq) AS seq, arg_max(digest, seq) AS digest FROM ch GROUP BY 1",
    "journal_verify": f"""WITH RECURSIVE {_SEALED}, m AS (SELECT *, (seq * 7 + record_id) % 50 AS m FROM ch),
t AS (SELECT record_id, seq, kind, payload + (m = 0)::INT AS payload, CASE WHEN m = 2 THEN {_ZERO} ELSE prev END AS prev, CASE WHEN m = 2 THEN sha256({_ENVELOPE % _ZERO}) ELSE digest END AS digest FROM m e WHERE m <> 1),
o AS (SELECT *, coalesce(lag(digest) OVER w, {_ZERO}) AS before, coalesce(lag(seq) OVER w, 0) AS number FROM t WINDOW w AS (PARTITION BY record_id ORDER BY seq))
SELECT record_id, seq, CASE WHEN seq <> number + 1 THEN 'gap' WHEN prev <> before THEN 'link' WHEN digest <> sha256({_ENVELOPE % 'e.prev'}) THEN 'altered' END AS problem FROM o e""",
    "latest_by_kind": f"WITH {_EV} SELECT record_id, kind, max(seq) AS seq, arg_max(payload, seq) AS payload FROM ev GROUP BY 1, 2",
    "append_once": f"WITH {_EV} SELECT record_id, kind, payload, min(seq) AS seq FROM ev GROUP BY 1, 2, 3",
    "receipt_asof_decision": f"WITH {_EV} SELECT l.record_id, l.seq, r.seq AS decision_seq FROM (SELECT * FROM ev WHERE kind = 'artifact.produced') l ASOF LEFT JOIN (SELECT * FROM ev WHERE kind = 'decision.recorded') r ON l.record_id = r.record_id AND l.seq > r.seq",
    "withdrawal_latch": f"WITH {_EV}, {_LATCH} SELECT seq, record_id, latched FROM la",
    "replay_facts": f"WITH {_FACTS} SELECT * FROM fa",
    "artifact_status": f"WITH {_FACTS} SELECT * FROM st",
    "workspace_status": f"WITH {_FACTS} SELECT status, count(*)::BIGINT AS records, CASE status WHEN 'STOP' THEN 1 WHEN 'STALE' THEN 4 WHEN 'EXCLUDED' THEN 5 WHEN 'ACTION_NEEDED' THEN 6 ELSE 7 END AS rank FROM st GROUP BY 1",
    "status_truth_table": f"""WITH {_AXES} SELECT *, CASE WHEN binding = 'unknown' OR derivation = 'unverifiable' THEN 'STOP' WHEN decision IN ('rejected', 'withdrawn') THEN 'EXCLUDED' WHEN binding = 'drifted' THEN 'REVIEW_REQUIRED'
WHEN derivation = 'stale' THEN 'STALE' WHEN decision = 'undecided' THEN 'ACTION_NEEDED' WHEN binding IN ('n/a', 'bound') AND derivation IN ('n/a', 'current') AND decision IN ('n/a', 'accepted') THEN 'READY' ELSE 'STOP' END AS status FROM binding, derivation, decision""",
    "graph_upstream": f"WITH RECURSIVE {_EDGES}, r AS (SELECT target AS step, source AS ancestor FROM ed UNION SELECT r.step, ed.source FROM r JOIN ed ON ed.target = r.ancestor) SELECT * FROM r",
    "egress_paths": f"""WITH RECURSIVE {_EDGES}, p AS (SELECT step AS model, step AS here, [step] AS path FROM s WHERE kind = 'model' UNION ALL
SELECT p.model, ed.target, list_append(p.path, ed.target) FROM p JOIN ed ON ed.source = p.here WHERE NOT list_contains(p.path, ed.target))
SELECT model, here AS egress, array_to_string(path, '>') AS path, len(list_intersect(path, (SELECT list(step) FROM s WHERE gate))) > 0 AS gated FROM p WHERE here IN (SELECT step FROM s WHERE kind = 'egress')""",
    "next_steps": f"""WITH {_EV}, {_STEPS}, n AS (SELECT *, row_number() OVER () - 1 AS i FROM s), h AS (SELECT DISTINCT record_id, produces AS a FROM ev JOIN n ON ((payload % 16) + 16) % 16 = i),
hs AS (SELECT record_id, list(a) AS have FROM h GROUP BY 1)
SELECT record_id, step FROM hs, s WHERE NOT list_contains(have, produces) AND (req = '' OR list_has_all(have, string_split(req, ' ')))""",
    "contract_totality": f"WITH {_EDGES} SELECT artifact, bool_or(r) AS required, bool_or(p) AS produced FROM (SELECT artifact, true AS r, false AS p FROM need UNION ALL SELECT produces, false, true FROM s) GROUP BY 1",
    "recovery_matrix": """WITH b AS (SELECT unnest([true, false]) AS x), w AS (SELECT unnest(['none', 'prefix', 'other']) AS written)
SELECT a.x AS intent, v.x AS valid, c.x AS complete, p.x AS prestate, f.x AS foreign_event, written,
CASE WHEN NOT a.x THEN 'A' WHEN NOT v.x THEN 'B' WHEN c.x THEN CASE WHEN p.x AND NOT f.x THEN 'D' ELSE 'G' END WHEN NOT p.x OR f.x THEN 'C' WHEN written = 'none' THEN 'F' WHEN written = 'prefix' THEN 'E' ELSE 'G' END AS class
FROM b a, b v, b c, b p, b f, w""",
}
