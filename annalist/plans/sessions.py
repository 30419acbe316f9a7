"""Queries over sessions of work by hand, runs, bundles and the doctor's report."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from annalist.operators import graph, planning, sessions
from annalist.plans import actions, documents, evidence, governance, texts, workflow
from annalist.plans.workflow import _EV, events
from annalist.sources.tables import read

#: Fixture conventions: one profile, records named after customers, digests and opaque ids of one letter.
PROFILES = {"by-hand": ("CUS", 6)}
_D, _E, _O, _P = "a" * 64, "b" * 64, "0" * 32, "1" * 32
_AT = "2024-01-01T00:00:00+00:00"
_EDITOR = {"v": 1, "role": "pii.spans", "sha256": _D, "cipher_sha256": _E, "aad": {
    "domain": "annalist:p4b:protected", "v": 1, "workspace": _D, "profile": "by-hand", "graph": _E, "record": "@", "phase": "pii.mark", "object_id": _O, "session_id": _O, "revision": 1, "key_id": _O, "store_id": _O}}
_REGISTER = {"v": 1, "role": "pseudonymisation.registry", "sha256": _D, "cipher_sha256": _D, "aad": {
    "domain": "annalist:p4c:protected", "v": 1, "workspace": _D, "profile": "by-hand", "graph": _E, "registry_id": _O, "key_id": _O, "role": "pseudonymisation.registry", "record": None, "version": 1, "parent": None, "operation": _O}}


def _with(base: dict, **changes) -> dict:
    """A copy with values set at dotted paths (``__`` for the dot); None stays a value, ``...`` removes the key."""
    out = json.loads(json.dumps(base))
    for path, value in changes.items():
        *way, last = path.split("__")
        here = out
        for k in way:
            here = here[k]
        if value is ...:
            here.pop(last)
        else:
            here[last] = value
    return out


def _based(roles: list[str]) -> dict:
    return {r: [_D, 1] for r in roles}


_SESSION = {"v": 1, "ref": _EDITOR, "basis": _based(sessions.EDITOR_BASIS), "actor": "coder-1", "actor_state": _D}
_CHECKPOINT = _with(_SESSION, previous=None, ref__role="editor")
_PREPARED = _SESSION | {"plan": _with(_EDITOR, role="plan", aad__object_id=_P), "checkpoint": _D, "at": _AT}
_RESOLUTION = _with(_REGISTER, role="pseudonymisation.resolution", aad__role="pseudonymisation.resolution", aad__record="@")
_RESOLVE = {"v": 1, "phase": "resolve", "operation": _O, "actor": "coder-1", "actor_state": _D, "at": _AT, "basis": _based(sessions.RESOLVE_BASIS), "registry_before": _REGISTER, "registry_after": _REGISTER,
            "refs": {"pseudonymisation.resolution": _RESOLUTION}, "marker": None}
_MARKER = {"domain": "annalist:p4c:confirmation", "v": 1, "record": "@", "profile": "by-hand", "graph": _E, "operation": _O, "actor": "coder-1", "actor_state": _D, "at": _AT, "basis": _based(sessions.REVIEW_BASIS), "volltext_gelesen": True,
           "counts": {"total": 3, "worked": 2, "open": 0, "excluded": 1, "added": 0}}
_REVIEW = _RESOLVE | {"phase": "review", "basis": _based(sessions.REVIEW_BASIS), "refs": {}, "marker": _MARKER}
_FINAL = {r: _with(_RESOLUTION, role=r, aad__role=r) for r in (sessions.FINAL, sessions.REPORT)}
_FINALISE = _RESOLVE | {"phase": "finalise", "basis": _based(sessions.FINALISE_BASIS), "refs": _FINAL, "registry_after": _with(_REGISTER, aad__version=2, aad__parent=_D)}
_POLICY = {"v": 1, "profile": "by-hand", "graph": _D, "sha256": _E}
_DONE = {"v": 1, "prepared_sha256": _D}
#: Payloads by kind, and the first rule each breaks.
PAYLOADS = [
    ("p4b.policy", _POLICY, None), ("p4b.policy", _with(_POLICY, profile="other"), "profile"), ("p4b.policy", _with(_POLICY, sha256=7), "sha256"), ("p4b.policy", _with(_POLICY, v=True), "version"), ("p4b.policy", _with(_POLICY, graph=...), "keys"),
    ("p4b.completed", _DONE, None), ("p4b.completed", _with(_DONE, prepared_sha256="x"), "prepared"), ("p4b.completed", _with(_DONE, more=1), "keys"), ("p4b.completed", [1], "keys"),
    ("p4b.checkpoint", _CHECKPOINT, None), ("p4b.checkpoint", _with(_CHECKPOINT, previous=_D), "first"), ("p4b.checkpoint", _with(_CHECKPOINT, previous=_D, ref__aad__revision=2), None), ("p4b.checkpoint", _with(_CHECKPOINT, previous="x"), "previous"),
    ("p4b.checkpoint", _with(_CHECKPOINT, ref__role="pii.spans"), "role"), ("p4b.checkpoint", _with(_CHECKPOINT, ref__aad__phase="pii.read"), "ref"), ("p4b.checkpoint", _with(_CHECKPOINT, ref__aad__record="CUS-999999"), "ref_record"),
    ("p4b.checkpoint", _with(_CHECKPOINT, basis=_based(sessions.EDITOR_BASIS[:2])), "basis"), ("p4b.checkpoint", _with(_CHECKPOINT, actor="c"), "actor"), ("p4b.checkpoint", _with(_CHECKPOINT, actor_state=None), "actor_state"),
    ("p4b.prepared", _PREPARED, None), ("p4b.prepared", _with(_PREPARED, plan__aad__session_id=_P), "plan_context"), ("p4b.prepared", _with(_PREPARED, plan__role="editor"), "plan"), ("p4b.prepared", _with(_PREPARED, checkpoint=None), "checkpoint"),
    ("p4b.prepared", _with(_PREPARED, at="2024-01-01T00:00:00+01:00"), "at"), ("p4b.prepared", _with(_PREPARED, basis__transcript=[_D, 1]), "basis"), ("p4b.prepared", _with(_PREPARED, ref__role="plan"), "role"), ("p4b.other", _DONE, "kind"),
    ("p4c.prepared", _RESOLVE, None), ("p4c.prepared", _with(_RESOLVE, marker=_MARKER), "marker"), ("p4c.prepared", _with(_RESOLVE, refs={}), "refs"), ("p4c.prepared", _with(_RESOLVE, phase="other"), "phase"), ("p4c.prepared", _with(_RESOLVE, operation="x"), "operation"),
    ("p4c.prepared", _with(_RESOLVE, registry_after__aad__registry_id=_P), "registry_id"), ("p4c.prepared", _with(_RESOLVE, registry_after__aad__version=2, registry_after__aad__parent=_D), "successor"), ("p4c.prepared", _with(_RESOLVE, registry_before__cipher_sha256=_E), "registry"),
    ("p4c.prepared", _FINALISE, None), ("p4c.prepared", _with(_FINALISE, registry_after__aad__parent=_E), "successor"), ("p4c.prepared", _with(_FINALISE, basis=_based(sessions.RESOLVE_BASIS)), "basis"), ("p4c.prepared", _with(_FINALISE, at="2024-01-01"), "at"),
    ("p4c.prepared", _REVIEW, None), ("p4c.prepared", _with(_REVIEW, marker__counts__open=1), "marker"), ("p4c.prepared", _with(_REVIEW, marker__volltext_gelesen=1), "marker"), ("p4c.prepared", _with(_REVIEW, marker__actor="coder-2"), "marker"), ("p4c.prepared", _with(_REVIEW, marker=None), "marker"),
    ("p4c.completed", _DONE, None), ("p4c.aborted", _with(_DONE, v=2), "version"), ("p4c.initialised", {"v": 1, "ref": _REGISTER, "at": _AT}, "record"), ("p4c.unknown", _DONE, "kind"),
]


def session_payloads(spark, sf_dir):
    """A payload for each customer, by key in turn; the ids of one in 53 are of no profile."""
    table = spark.createDataFrame([(n, k, json.dumps(p)) for n, (k, p, _) in enumerate(PAYLOADS)], "n long, kind string, template string")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"))
    record = F.concat(F.when(F.col("seq") % 53 == 0, "SUC-").otherwise("CUS-"), F.lpad(F.col("seq").cast("string"), 6, "0"))
    j = c.withColumns({"record": record, "n": F.col("seq") % len(PAYLOADS)}).join(F.broadcast(table), "n")  # the table is a constant of this module
    j = j.select("seq", "kind", "record", F.try_parse_json(F.replace("template", F.lit('"@"'), F.concat(F.lit('"'), F.col("record"), F.lit('"')))).alias("v"))
    at = (F.col("kind"), F.col("v"), F.col("record"), PROFILES)
    problem = F.when(F.col("kind").startswith("p4b"), sessions.editor_problem(*at)).otherwise(sessions.register_problem(*at))
    return j.select("seq", "kind", problem.alias("problem"))


def _groups(spark, sf_dir):
    """Fixture convention: a record's events are one group of mentions, its type the record modulo 3."""
    g = events(spark, sf_dir).groupBy("record_id").agg(F.array_sort(F.collect_list("seq")).alias("members"))
    return g.select(F.col("record_id").alias("group_id"), (F.col("record_id") % 3).alias("entity_type"), F.lit("corpus").alias("scope"), F.lit("RESOLVED").alias("state"), "members")


def group_merges(spark, sf_dir):
    """Every fourth group merges with another, in turn: none, itself, one that isn't there, one of its type, one of another."""
    r = F.col("group_id")
    other = F.when(r % 20 == 4, r).when(r % 20 == 8, -1 - r).when(r % 20 == 12, r + 3).when(r % 20 == 16, r + 1)
    acts = _groups(spark, sf_dir).where(r % 4 == 0).select(r.alias("act"), F.array_compact(F.array(r, other)).alias("group_ids"))
    return sessions.merge(_groups(spark, sf_dir), acts).select("act", "problem", sessions.sha256(F.array_join(F.col("members").cast("array<string>"), ",")).alias("group_id"), F.size("members").alias("n"))


def group_splits(spark, sf_dir):
    """Every third group is split: in two, in one, without some members, or with one member twice; and one that isn't there."""
    e = events(spark, sf_dir).select(F.col("record_id").alias("group_id"), F.col("seq").alias("member")).where("group_id % 3 = 0")
    g = F.col("group_id")
    parts = e.where((g % 9 != 6) | (F.col("member") % 2 == 0)).select("group_id", F.when(g % 9 == 3, 0).otherwise(F.col("member") % 4).cast("long").alias("part"), "member")
    twice = parts.where(g % 15 == 0).groupBy("group_id").agg(F.lit(9).cast("long").alias("part"), F.min("member").alias("member"))
    return sessions.split(_groups(spark, sf_dir), parts.unionByName(twice).unionByName(spark.createDataFrame([(-1, 0, 1), (-1, 1, 2)], parts.schema)))


def group_exclusions(spark, sf_dir):
    """Mentions are excluded from even groups (every third) and from each tenth (all); some of those left get a new state."""
    g = F.col("record_id")
    m = events(spark, sf_dir).where((g % 10 == 0) | ((g % 2 == 0) & (F.col("seq") % 3 == 0))).select(g.alias("group_id"), F.col("seq").alias("member"))
    acts = events(spark, sf_dir).where("kind = 'artifact.produced'").select(g.alias("group_id"), "seq", F.when(F.col("payload") % 3 == 0, "DEFERRED").when(F.col("payload") % 3 == 1, "DONE").otherwise("RESOLVED").alias("state")).where("group_id % 4 = 1")
    out = sessions.set_state(sessions.exclude(_groups(spark, sf_dir), m), acts)
    return out.select("group_id", "state", F.size("members").alias("n"), F.array_min("members").alias("first"))


#: Fixture convention: models are dear; two steps have no handler.
HANDLERS = {s: ("INPUT" if not r else "GATE" if k == "human" else "RUN", k != "model") for s, k, r, _, _ in graph.STEPS if s not in ("analysis.confirm", "export")}


def runs(spark, sf_dir):
    """Artifacts by payload modulo 16, as in ``next_steps``; a step fails in records divisible by 7, another leaves nothing in
    those divisible by 5."""
    r = F.col("record_id")
    names = F.array(*[F.lit(s[3]) for s in graph.STEPS])
    have = events(spark, sf_dir).groupBy("record_id").agg(F.array_sort(F.collect_set(F.element_at(names, (F.pmod("payload", F.lit(len(graph.STEPS))) + 1).cast("int")))).alias("artifacts"))
    some = lambda when, step: F.when(when, F.array(F.lit(step))).otherwise(F.array().cast("array<string>"))
    return sessions.run_on(have.withColumns({"failing": some(r % 7 == 0, "l1.coverage"), "silent": some(r % 5 == 0, "metadata.derive")}), "none", HANDLERS)


def export_bundles(spark, sf_dir):
    """Bundles of the chains of ``bundle_chain``; odd records are in production, some inputs moved, some fields are missing."""
    r = F.col("record_id")
    chain = governance.bundle_chain(spark, sf_dir)
    fields = F.when(r % 3 == 0, F.create_map(F.lit("title"), F.concat(F.lit("T "), r.cast("string")))).otherwise(F.create_map(F.lit("title"), F.concat(F.lit("T "), r.cast("string")), F.lit("language"), F.lit("de")))
    drafts = chain.where(r % 8 != 5).select("record_id", F.lit("coder-1").alias("actor"), F.sha2(r.cast("string"), 256).alias("input_sha256"), F.sha2((r + F.when(r % 6 == 1, 1).otherwise(0)).cast("string"), 256).alias("now_sha256"),
                                            fields.alias("fields"), F.array(F.lit("title"), F.lit("language")).alias("required"))
    return sessions.export_bundle(chain, drafts, r % 2 == 1)


ROLES = ["pseudonymisation.policy", "pseudonymisation.registry", "l1.codebook"]


def side_inputs(spark, sf_dir):
    """Sources whose payload is divisible by 11 are inputs of all records: a policy or a register."""
    e = events(spark, sf_dir)
    t = e.where("kind = 'source.ingested' and payload % 11 = 0").select(F.when(F.col("payload") % 2 == 0, ROLES[0]).otherwise(ROLES[1]).alias("role"), "seq", F.sha2(F.col("payload").cast("string"), 256).alias("sha256"))
    out = sessions.side_inputs(e.select("record_id").distinct(), t, ROLES)
    return out.select("record_id", *[x for i, role in enumerate(ROLES) for x in (F.col(f"`{role}`.sha256").alias(f"sha256_{i}"), F.col(f"`{role}`.seq").alias(f"seq_{i}"))])


def doctor(spark, sf_dir):
    """What the checks of files, the journal, the graph's handlers, egress, the ledger, the store and the metadata find."""
    area = lambda df, name, record, text: df.select(F.lit(name).alias("area"), record.cast("long").alias("record_id"), text.alias("text"))
    meta = evidence.metadata_findings(spark, sf_dir)
    found = area(workflow.journal_verify(spark, sf_dir).where("problem is not null"), "journal", F.col("record_id"), F.concat(F.col("problem"), F.lit(" at "), F.col("seq").cast("string")))
    for more in (
        area(actions.ingest_plan(spark, sf_dir).where("outcome in ('utf8', 'parse')"), "structure", F.col("record_id"), F.concat(F.col("outcome"), F.lit(" "), F.col("name"))),
        area(governance.egress_inheritance(spark, sf_dir).where("inherited and not holds"), "egress", F.col("record_id"), F.concat(F.lit("moved after "), F.col("seq").cast("string"))),
        area(texts.handler_registry(spark, sf_dir), "graph", F.lit(0), F.concat(F.col("step"), F.lit(": "), F.col("finding"))),
        area(governance.ledger_against_journal(spark, sf_dir).where("finding <> 'behind'"), "ledger", F.col("record_id"), F.col("finding")),
        area(documents.dangling_refs(spark, sf_dir), "store", F.col("doc_id"), F.concat(F.lit("lost: "), F.col("doc_id").cast("string"))),
        area(meta, "metadata", F.col("record_id"), F.concat(F.coalesce("field", F.lit("-")), F.lit(": "), F.col("finding"))),
    ):
        found = found.unionByName(more)
    return sessions.doctor(found)


QUERIES = {f.__name__: f for f in (session_payloads, group_merges, group_splits, group_exclusions, runs, export_bundles, side_inputs, doctor)}

_Q = lambda x: "NULL" if x is None else f"'{x}'"
_G = "g AS (SELECT user_id AS group_id, list(event_id ORDER BY event_id) AS members FROM events GROUP BY 1)"
_RUN = ", ".join(f"({i}, '{s.name}', {list(s.requires)!r}::VARCHAR[], {list(s.produces)!r}::VARCHAR[], {str(s.gate).lower()}, '{HANDLERS.get(s.name, ('NONE', False))[0]}', {str(HANDLERS.get(s.name, ('NONE', False))[1]).lower()})" for i, s in enumerate(planning.build("none")))
_WAIT = lambda keep: f"coalesce((SELECT string_agg(step, ',' ORDER BY i) FROM st WHERE failure IS NULL AND NOT list_has_all(f.have, produces) AND list_has_all(f.have, requires) AND {keep}), '')"
_INDEX = " ".join(f"WHEN {n} THEN {_Q(p)}" for n, (_, _, p) in enumerate(PAYLOADS))
_KINDS = " ".join(f"WHEN {n} THEN '{k}'" for n, (k, _, _) in enumerate(PAYLOADS))
SQL = {
    "session_payloads": f"""WITH c AS (SELECT c_custkey AS seq, c_custkey % {len(PAYLOADS)} AS n, c_custkey % 53 = 0 AS wrong FROM customer), t AS (SELECT seq, n, wrong, CASE n {_KINDS} END AS kind, CASE n {_INDEX} END AS p FROM c)
SELECT seq, kind, CASE WHEN wrong AND kind NOT LIKE '%initialised' AND coalesce(p NOT IN ('kind', 'keys'), true) AND NOT (kind LIKE 'p4c%' AND coalesce(p = 'version', false)) THEN 'record' ELSE p END AS problem FROM t""",
    "group_merges": f"""WITH {_G}, a AS (SELECT group_id AS act, CASE group_id % 20 WHEN 4 THEN [group_id, group_id] WHEN 8 THEN [group_id, -1 - group_id] WHEN 12 THEN [group_id, group_id + 3] WHEN 16 THEN [group_id, group_id + 1] ELSE [group_id] END AS ids FROM g WHERE group_id % 4 = 0),
n AS (SELECT act, unnest(ids) AS group_id FROM a), j AS (SELECT act, count(*) AS n, count(DISTINCT n.group_id) AS d, count(g.members) AS f, count(DISTINCT CASE WHEN g.members IS NOT NULL THEN n.group_id % 3 END) AS k, list_sort(flatten(list(g.members) FILTER (g.members IS NOT NULL))) AS m FROM n LEFT JOIN g USING (group_id) GROUP BY 1),
p AS (SELECT *, CASE WHEN n < 2 THEN 'few' WHEN d < n THEN 'repeated' WHEN f < n THEN 'unknown' WHEN k > 1 THEN 'kinds' END AS problem FROM j)
SELECT act, problem, CASE WHEN problem IS NULL THEN sha256(array_to_string(m, ',')) END AS group_id, CASE WHEN problem IS NULL THEN len(m)::INT END AS n FROM p""",
    "group_splits": """WITH e AS (SELECT user_id AS g, event_id AS m FROM events WHERE user_id % 3 = 0), p AS (SELECT g, CASE WHEN g % 9 = 3 THEN 0 ELSE m % 4 END AS part, m FROM e WHERE g % 9 <> 6 OR m % 2 = 0),
u AS (SELECT * FROM p UNION ALL SELECT g, 9, min(m) FROM p WHERE g % 15 = 0 GROUP BY g UNION ALL VALUES (-1, 0, 1), (-1, 1, 2)), l AS (SELECT g, count(DISTINCT part) AS parts, count(*) AS n, count(DISTINCT m) AS d FROM u GROUP BY 1),
w AS (SELECT user_id AS g, count(*) AS size FROM events GROUP BY 1), j AS (SELECT l.*, size, CASE WHEN size IS NULL THEN 'unknown' WHEN parts < 2 THEN 'few' WHEN d < n THEN 'repeated' WHEN d < size THEN 'cover' END AS problem FROM l LEFT JOIN w USING (g))
SELECT g AS group_id, problem, CASE WHEN problem IS NULL THEN parts ELSE 0 END AS parts FROM j""",
    "group_exclusions": f"""WITH {_EV}, l AS (SELECT record_id AS g, count(*) AS n0, count(*) FILTER (NOT gone) AS n, min(seq) FILTER (NOT gone) AS first FROM (SELECT *, record_id % 10 = 0 OR (record_id % 2 = 0 AND seq % 3 = 0) AS gone FROM ev) GROUP BY 1),
s AS (SELECT record_id AS g, arg_max(CASE payload % 3 WHEN 0 THEN 'DEFERRED' ELSE 'RESOLVED' END, seq) AS state FROM ev WHERE kind = 'artifact.produced' AND payload % 3 <> 1 AND record_id % 4 = 1 GROUP BY 1)
SELECT g AS group_id, coalesce(state, CASE WHEN n < n0 THEN 'OPEN' ELSE 'RESOLVED' END) AS state, n::INT AS n, first FROM l LEFT JOIN s USING (g) WHERE n > 0""",
    "runs": f"""WITH RECURSIVE {_EV}, st(i, step, requires, produces, gate, mode, cheap) AS (VALUES {_RUN}), nm(i, a) AS (VALUES {', '.join(f"({i}, '{s[3]}')" for i, s in enumerate(graph.STEPS))}),
h AS (SELECT record_id, list(DISTINCT a) AS have FROM ev JOIN nm ON payload % 16 = i GROUP BY 1),
f AS (SELECT record_id, 0 AS at_, have, []::VARCHAR[] AS executed, NULL::VARCHAR AS failure FROM h UNION ALL
 SELECT record_id, at_ + 1, CASE WHEN r AND NOT fails AND NOT silent THEN list_concat(have, produces) ELSE have END, CASE WHEN r AND NOT fails THEN list_append(executed, step) ELSE executed END,
 CASE WHEN r AND fails THEN 'failed: ' || step WHEN r AND silent THEN 'unproven: ' || step ELSE failure END FROM
 (SELECT f.*, st.*, failure IS NULL AND NOT list_has_all(have, produces) AND list_has_all(have, requires) AND mode = 'RUN' AND cheap AS r, record_id % 7 = 0 AND step = 'l1.coverage' AS fails, record_id % 5 = 0 AND step = 'metadata.derive' AS silent FROM f JOIN st ON st.i = f.at_))
SELECT record_id, array_to_string(executed, ',') AS executed, {_WAIT("gate AND mode <> 'NONE'")} AS gates, {_WAIT("mode = 'INPUT'")} AS inputs, {_WAIT("mode = 'RUN' AND NOT cheap")} AS deferred, {_WAIT("mode = 'NONE'")} AS unbuilt, failure FROM f WHERE at_ = {len(graph.STEPS)}""",
    "export_bundles": f"""WITH b AS ({governance.SQL['bundle_chain']}), d AS (SELECT *, record_id % 2 = 1 AS prod, record_id % 3 = 0 AS lacks, coalesce(problem, CASE WHEN record_id % 8 = 5 THEN 'draft' WHEN prod AND record_id % 6 = 1 THEN 'moved' WHEN prod AND lacks THEN 'open' END) AS told FROM b)
SELECT record_id, told AS problem, CASE WHEN told IS NULL THEN sha256('{{"analysis_included":false,"catalog":{{"abstract":{{"draft":"' || abstract_draft || '"}},"adjudicated":"' || adjudicated || '","metadata":{{"draft":"' || metadata_draft || '","fields":{{' || CASE WHEN lacks THEN '' ELSE '"language":"de",' END
 || '"title":"T ' || record_id || '"}},"open_requirements":[' || CASE WHEN lacks THEN '"language"' ELSE '' END || ']}}}},"record_id":' || record_id || ',"release":{{"actor":"coder-1"}},"schema":"annalist.export.bundle"}}') END AS bundle_sha256,
CASE WHEN record_id % 8 <> 5 AND lacks THEN 'language' ELSE '' END AS open FROM d""",
    "side_inputs": f"""WITH {_EV}, t AS (SELECT payload % 2 AS r, max(seq) AS seq, sha256(CAST(arg_max(payload, seq) AS VARCHAR)) AS sha FROM ev WHERE kind = 'source.ingested' AND payload % 11 = 0 GROUP BY 1)
SELECT DISTINCT record_id, (SELECT sha FROM t WHERE r = 0) AS sha256_0, (SELECT seq FROM t WHERE r = 0) AS seq_0, (SELECT sha FROM t WHERE r = 1) AS sha256_1, (SELECT seq FROM t WHERE r = 1) AS seq_1, NULL::VARCHAR AS sha256_2, NULL::BIGINT AS seq_2 FROM ev""",
    "doctor": f"""WITH jv AS ({workflow.SQL['journal_verify']}), hr AS ({texts.SQL['handler_registry']}), la AS ({governance.SQL['ledger_against_journal']}), dr AS ({documents.SQL['dangling_refs']}), mf AS ({evidence.SQL['metadata_findings']}), ip AS ({actions.SQL['ingest_plan']}), ei AS ({governance.SQL['egress_inheritance']}),
f AS (SELECT 'journal' AS area, record_id::BIGINT AS record_id, problem || ' at ' || seq AS text FROM jv WHERE problem IS NOT NULL UNION ALL SELECT 'graph', 0, step || ': ' || finding FROM hr UNION ALL
 SELECT 'ledger', record_id, finding FROM la WHERE finding <> 'behind' UNION ALL SELECT 'store', doc_id, 'lost: ' || doc_id FROM dr UNION ALL SELECT 'metadata', record_id, coalesce(field, '-') || ': ' || finding FROM mf
 UNION ALL SELECT 'structure', record_id, outcome || ' ' || name FROM ip WHERE outcome IN ('utf8', 'parse') UNION ALL SELECT 'egress', record_id, 'moved after ' || seq FROM ei WHERE inherited AND NOT holds),
n AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY record_id, text) AS n FROM f)
SELECT area, CASE area WHEN 'structure' THEN 1 WHEN 'egress' THEN 4 WHEN 'journal' THEN 2 WHEN 'graph' THEN 3 WHEN 'ledger' THEN 5 WHEN 'store' THEN 6 ELSE 7 END AS rank, CASE area WHEN 'graph' THEN 'CONFIG' WHEN 'metadata' THEN 'ACTION_NEEDED' ELSE 'STOP' END AS status,
count(*) AS findings, string_agg(text, '; ' ORDER BY n) FILTER (n <= 3) AS shown FROM n GROUP BY 1""",
}
