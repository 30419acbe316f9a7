"""Queries over receipts, decisions, statuses, ownership and recovery."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import decision_id
from annalist.operators import journal, ledger, receipts, recovery, status
from annalist.plans.workflow import _EV, AXES, KINDS, events, recovery_matrix
from annalist.plans.workflow import SQL as _WORKFLOW
from annalist.sources.tables import read

#: Fixture conventions: what events of the table stand for, by their payload (0 to 99).
RUNTIMES = ("legacy", "annalist")
_SHA = lambda c: F.sha2(c.cast("string"), 256)
_AT = lambda: F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("seq") * 60), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
_AT_SQL = "strftime(make_timestamp(1704067200000000 + seq * 60000000), '%Y-%m-%dT%H:%M:%S+00:00')"


def _decisions(spark, sf_dir):
    """Decisions on payload modulo 20; one in six rejects; the artifact and reference go by payload modulo 3 and 4."""
    e = events(spark, sf_dir).where("kind = 'decision.recorded'")
    p = F.col("payload")
    return e.select("record_id", "seq", F.concat(F.lit("DEC-"), (p % 4).cast("string")).alias("reference"), _SHA(p % 20).alias("subject_sha256"),
                    F.when(p % 6 == 0, "REJECT").otherwise("ACCEPT").alias("verdict"), F.when(p % 3 == 0, "l1.adjudicated").otherwise("transcript.confirmed").alias("artifact"), _AT().alias("at"))


_DECISIONS = f"""de AS (SELECT record_id, seq, 'DEC-' || payload % 4 AS reference, sha256(CAST(payload % 20 AS VARCHAR)) AS subject_sha256, CASE WHEN payload % 6 = 0 THEN 'REJECT' ELSE 'ACCEPT' END AS verdict,
CASE WHEN payload % 3 = 0 THEN 'l1.adjudicated' ELSE 'transcript.confirmed' END AS artifact, {_AT_SQL} AS at_, 'DEC-' || payload % 4 || '@' || left(sha256(CAST(payload % 20 AS VARCHAR)), 12) AS id FROM ev WHERE kind = 'decision.recorded')"""


def _acts_of_decision(spark, sf_dir):
    """Decisions and withdrawals of two artifacts a record; by payload modulo 6 decisions accept, reject (0) or undo (1, 2): the
    last withdrawal before them, or by modulo 5 (0) another event; by modulo 7 (0) no human acts."""
    e = events(spark, sf_dir).where("kind in ('decision.recorded', 'decision.withdrawn')")
    p = F.col("payload")
    e = e.withColumn("artifact", F.when(F.col("seq") % 2 == 0, "a").otherwise("b"))
    verdict = F.when(F.col("kind") == "decision.withdrawn", "WITHDRAW").when(p % 6 == 0, "REJECT").when(p % 6 <= 2, "UNDO").otherwise("ACCEPT")
    before = W.partitionBy("record_id", "artifact").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    named = F.last(F.when(F.col("kind") == "decision.withdrawn", F.col("seq")), ignorenulls=True).over(before) - F.when(p % 5 == 0, 1).otherwise(0)
    return e.select("record_id", "artifact", "seq", verdict.alias("verdict"), F.when(verdict == "UNDO", named).alias("undo_of"), (p % 7 != 0).alias("human"))


def decided_acts(spark, sf_dir):
    return journal.decide(_acts_of_decision(spark, sf_dir)).select("record_id", "artifact", "seq", "effective", "withdrawal")


def effective_decisions(spark, sf_dir):
    return journal.effective(journal.decide(_acts_of_decision(spark, sf_dir)))


def _receipts(spark, sf_dir):
    """Receipts that break one rule or another, by payload."""
    e = events(spark, sf_dir).where("kind = 'artifact.produced'")
    p = F.col("payload")
    inputs = F.when(p % 13 == 0, F.create_map()).when(p % 17 == 0, F.create_map(F.lit("a"), F.lit("x"))).otherwise(F.create_map(F.lit("a"), _SHA(p), F.lit("b"), _SHA(p + 1))).cast("map<string,string>")
    return e.select(
        "record_id", "seq", F.when(p % 11 == 0, "short").otherwise(_SHA(p)).alias("output_sha256"), inputs.alias("inputs"), F.when(p % 19 != 0, "1.0").alias("code_version"),
        F.when(p % 5 == 0, "deterministic").otherwise("model").alias("kind"), F.when(p % 23 != 0, "m").alias("model"),
        F.when(p % 7 == 0, "DEC-1").otherwise(decision_id(F.concat(F.lit("DEC-"), (p % 4).cast("string")), _SHA(p % 20))).alias("authorisation"),
        F.when(p % 29 == 0, _SHA(p + 1)).otherwise(_SHA(p % 20)).alias("subject"), F.when(p % 31 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+00:00").alias("authorised_at"),
        F.when(p % 37 == 0, "2023-12-31T23:00:00-00:30").when(p % 10 == 1, "2024-01-02T00:00:00+00:00").otherwise("2024-02-01T00:00:00Z").alias("started_at"),
        F.when(p % 8 == 1, "length").when(p % 8 == 2, None).otherwise("stop").alias("finish_reason"))


_RECEIPTS = f"""re AS (SELECT record_id, seq, payload AS p, CASE WHEN payload % 7 = 0 THEN 'DEC-1' ELSE 'DEC-' || payload % 4 || '@' || left(sha256(CAST(payload % 20 AS VARCHAR)), 12) END AS authorisation,
CASE WHEN payload % 29 = 0 THEN sha256(CAST(payload + 1 AS VARCHAR)) ELSE sha256(CAST(payload % 20 AS VARCHAR)) END AS subject,
CASE WHEN payload % 37 = 0 THEN TIMESTAMP '2023-12-31 23:30:00' WHEN payload % 10 = 1 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-02-01' END AS started FROM ev WHERE kind = 'artifact.produced')"""


def receipt_check(spark, sf_dir):
    return _receipts(spark, sf_dir).select("record_id", "seq", receipts.receipt_problem(F.lit(True)).alias("problem"))


def receipt_binding(spark, sf_dir):
    r = _receipts(spark, sf_dir).where("kind = 'model'")
    return receipts.bound(r, _decisions(spark, sf_dir), F.array(F.lit("transcript.confirmed"))).select("record_id", "seq", "authorisation", "decision_seq", "binding")


def egress_inheritance(spark, sf_dir):
    """Receipts are ingested sources, upstream digests produced artifacts; payloads modulo 3 are digests."""
    e = events(spark, sf_dir)
    sha = _SHA(F.col("payload") % 3)
    part = lambda kind: e.where(F.col("kind") == kind)
    d = part("decision.recorded").select("record_id", "seq", F.when(F.col("payload") % 6 == 0, "REJECT").otherwise("ACCEPT").alias("verdict"), sha.alias("subject"))
    withdrawn = part("decision.withdrawn").select("record_id", "seq", F.lit("WITHDRAW").alias("verdict"), F.lit(None).cast("string").alias("subject"))
    return receipts.inherited(part("source.ingested").select("record_id", "seq", sha.alias("input")), part("artifact.produced").select("record_id", "seq", sha.alias("sha256")),
                              d.unionByName(withdrawn), part("record.registered").select("record_id", "seq"))


def _axes(spark, sf_dir):
    """Artifacts of records with their axes, by the last payload of each record and kind."""
    last = journal.latest(events(spark, sf_dir), "record_id", "kind")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    p = F.col("payload")
    return last.select("record_id", F.col("kind").alias("artifact"), p.alias("payload"), pick(AXES[0], F.floor(p / 2)).alias("binding"), pick(AXES[1], F.floor(p / 7)).alias("derivation"), pick(AXES[2], p).alias("decision"), (p % 10 != 9).alias("enabled"))


def _stated(spark, sf_dir):
    a = _axes(spark, sf_dir)
    return a.withColumn("status", journal.ladder(*map(F.col, ("binding", "derivation", "decision", "enabled"))))


def status_explanations(spark, sf_dir):
    s = _stated(spark, sf_dir)
    words = status.explanation(*map(F.col, ("binding", "derivation", "decision", "enabled", "status")))
    return s.select("record_id", "artifact", "status", words.alias("explanation"), status.exit_code(F.col("status")).alias("exit_code"))


def gate_conjunction(spark, sf_dir):
    """Gates are the artifacts of a record; records of conversations without any are STOP."""
    records = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("record_id")).union(events(spark, sf_dir).select("record_id"))
    return status.conjunction(records, _stated(spark, sf_dir).select("record_id", F.array_position(F.array(*map(F.lit, KINDS.values())), F.col("artifact")).alias("ordinal"), F.col("artifact").alias("gate"), "status"))


def _records(spark, sf_dir):
    """Fixture convention: findings by payload of registrations, disabled, gates and authority by record_id."""
    s = _stated(spark, sf_dir).where("artifact <> 'decision.withdrawn' and payload % 4 > 0")
    found = s.groupBy("record_id").agg(F.min_by("status", journal.rank(F.col("status"))).alias("worst"), F.count_if(F.col("payload") == 77).alias("findings"))
    r, none = F.col("record_id"), F.coalesce("findings", F.lit(0))
    ids = events(spark, sf_dir).select("record_id").distinct().join(found, "record_id", "left")
    return ids.select("record_id", status.record_status(none, r % 11 != 0, F.col("worst"), (r % 3).cast("int"), r % 2 == 0).alias("status"))


def record_status(spark, sf_dir):
    return _records(spark, sf_dir).withColumn("exit_code", status.exit_code(F.col("status")))


def workspace_worst(spark, sf_dir):
    return status.workspace(_records(spark, sf_dir).where("status not in ('STOP', 'REVIEW_REQUIRED')"))


def usable_artifacts(spark, sf_dir):
    """Artifacts that may feed a next step; those of a payload divisible by 5 have no bytes."""
    return _stated(spark, sf_dir).where(status.usable(F.col("payload") % 5 != 0, F.col("status"))).select("record_id", "artifact")


def _adoptions(spark, sf_dir):
    """Registrations as adoptions, whose runtimes, times and envelopes are wrong for some payloads."""
    e = events(spark, sf_dir).where("kind = 'record.registered'")
    p = F.col("payload")
    name = lambda n: F.when(n == 0, RUNTIMES[0]).when(n == 1, RUNTIMES[1]).otherwise("other")
    a = e.select("record_id", "seq", F.when(p % 23 == 0, "").otherwise("REF-1").alias("reference"), name(p % 2 + F.when(p % 19 == 0, 2).otherwise(0)).alias("from_runtime"), name(F.when(p % 17 == 0, p % 2).otherwise(1 - p % 2)).alias("to_runtime"),
                 F.when(p % 29 == 0, "2024-01-01T00:00:00").otherwise(_AT()).alias("at"), F.when(p % 13 == 0, F.col("record_id") + 1).otherwise(F.col("record_id")).alias("envelope_id"),
                 decision_id(F.concat(F.lit("DEC-"), (F.col("record_id") % 2).cast("string")), _SHA(F.col("record_id") % 10)).alias("decision_id"))
    # each record's decision comes first, but for one in seven; one in nine is rejected
    ids = events(spark, sf_dir).groupBy("record_id").agg(F.min("seq").alias("seq"))
    r = F.col("record_id")
    d = ids.where(r % 7 != 0).select("record_id", (F.col("seq") - 1).alias("seq"), F.concat(F.lit("DEC-"), (r % 2).cast("string")).alias("reference"), _SHA(r % 10).alias("subject_sha256"), F.when(r % 9 == 0, "REJECT").otherwise("ACCEPT").alias("verdict"))
    # decisions are named by reference and bytes: those of other records come between
    return ledger.adoptions(a, d, RUNTIMES)


def adoption_check(spark, sf_dir):
    return _adoptions(spark, sf_dir).select("record_id", "seq", "problem")


def ledger_owners(spark, sf_dir):
    return ledger.owners(_adoptions(spark, sf_dir))


def owner_counts(spark, sf_dir):
    records = events(spark, sf_dir).select("record_id")
    return ledger.owner_counts(ledger.owned(records, ledger_owners(spark, sf_dir), RUNTIMES[0]), [*RUNTIMES, "third"])


def ledger_against_journal(spark, sf_dir):
    """A ledger file that lacks a third of the owners, has another runtime for some, and claims records of its own."""
    truth = ledger_owners(spark, sf_dir)
    r = F.col("record_id")
    file = truth.where(r % 3 != 0).select("record_id", F.when(r % 5 == 0, "third").otherwise(F.col("runtime")).alias("runtime"), "reference")
    extra = truth.select((r + 1_000_000).alias("record_id"), "runtime", "reference").where(r % 4 == 0)
    return ledger.against_truth(file.unionByName(extra), truth)


def _acts(spark, sf_dir):
    return events(spark, sf_dir).withColumn("digest", F.sha2(F.concat_ws("|", F.col("record_id").cast("string"), (F.col("payload") % 25).cast("string")), 256))


def uncertain_intents(spark, sf_dir):
    a = _acts(spark, sf_dir)
    intents = a.where("kind = 'record.registered'").select("record_id", "seq", F.col("digest").alias("intent_sha256"))
    return recovery.uncertain(intents, a.where("kind = 'artifact.produced'").select(F.when(F.col("payload") % 3 > 0, F.col("digest")).alias("operation_intent_sha256")))


def operation_events(spark, sf_dir):
    """Events that carry an intent, with the number of intents they could answer."""
    a = _acts(spark, sf_dir)
    intents = a.where("kind = 'record.registered'").groupBy("digest").agg(F.count("*").alias("intents"))
    return a.where("kind = 'artifact.produced' and payload % 3 > 0").join(intents, "digest").select("record_id", "seq", "intents")


def prepared_completed(spark, sf_dir):
    a = _acts(spark, sf_dir)
    return recovery.pairs(a.where("kind = 'source.ingested'"), a.where("kind = 'decision.recorded'"))


def recovery_report(spark, sf_dir):
    return recovery_matrix(spark, sf_dir).withColumn("r", recovery.report(F.col("class"))).select("intent", "valid", "complete", "prestate", "foreign_event", "written", "r.status", "r.reason")


def intent_digests(spark, sf_dir):
    e = events(spark, sf_dir).where("kind = 'record.registered'")
    inputs = F.create_map(F.lit("source"), F.sha2(F.col("payload").cast("string"), 256), F.lit("assignment"), F.sha2((F.col("payload") + 1).cast("string"), 256))
    return e.select("seq", recovery.intent_digest(F.lit("operation"), F.lit("ingest"), F.concat(F.lit("REC-"), F.col("record_id").cast("string")), F.lit("ws"), inputs).alias("intent_sha256"))


def bundle_chain(spark, sf_dir):
    """Objects of every conversation: drafts, confirmed parts, preview and approval, some of which are missing."""
    r = F.col("record_id")
    ids = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("record_id")).distinct()
    at = lambda name: F.sha2(F.concat_ws("|", F.lit(name), r.cast("string")), 256)
    refs = {
        "approved": {"confirmed": "preview"}, "preview": {"metadata": "metadata", "abstract": "abstract", "adjudicated": "l1"}, "metadata": {"confirmed": "metadata.draft"},
        "abstract": {"confirmed": "abstract.draft"}, "metadata.draft": {}, "abstract.draft": {},
    }
    lost = {"approved": 31, "preview": 13, "metadata": 11, "abstract": 7, "metadata.draft": 19, "abstract.draft": 5}
    objects = None
    for name, fields in refs.items():
        pairs = [x for k, v in fields.items() for x in (F.lit(k), F.when(~((F.lit(k) == "adjudicated") & (r % 17 == 3)), at(v)))]
        m = (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")
        one = ids.where(r % lost[name] != 1).select(at(name).alias("address"), F.when((F.lit(name) == "approved") & (r % 23 == 2), r + 1).otherwise(r).alias("record_id"), m.alias("refs"))
        objects = one if objects is None else objects.unionByName(one)
    return recovery.bundle(ids.select("record_id", at("approved").alias("address")), objects)


QUERIES = {f.__name__: f for f in (decided_acts, effective_decisions, receipt_check, receipt_binding, egress_inheritance, status_explanations, gate_conjunction, record_status, workspace_worst, usable_artifacts, adoption_check, ledger_owners, owner_counts,
                                   ledger_against_journal, uncertain_intents, operation_events, prepared_completed, recovery_report, intent_digests, bundle_chain)}

_H = lambda x: f"sha256(CAST({x} AS VARCHAR))"
_LAST = """la AS (SELECT record_id, kind AS artifact, arg_max(payload, seq) AS payload FROM ev GROUP BY 1, 2),
ax AS (SELECT *, ['n/a', 'bound', 'drifted', 'unknown'][(payload // 2) % 4 + 1] AS binding, ['n/a', 'current', 'stale', 'unverifiable'][(payload // 7) % 4 + 1] AS derivation,
 ['n/a', 'accepted', 'undecided', 'rejected', 'withdrawn'][payload % 5 + 1] AS decision, payload % 10 <> 9 AS enabled FROM la),
st AS (SELECT *, CASE WHEN NOT enabled THEN 'EXCLUDED' WHEN binding = 'unknown' OR derivation = 'unverifiable' THEN 'STOP' WHEN decision IN ('rejected', 'withdrawn') THEN 'EXCLUDED' WHEN binding = 'drifted' THEN 'REVIEW_REQUIRED'
 WHEN derivation = 'stale' THEN 'STALE' WHEN decision = 'undecided' THEN 'ACTION_NEEDED' ELSE 'READY' END AS status FROM ax)"""
_RANK = "list_position(['STOP', 'CONFIG', 'REVIEW_REQUIRED', 'STALE', 'EXCLUDED', 'ACTION_NEEDED', 'READY'], status)"
_EXIT = "CASE status WHEN 'READY' THEN 0 WHEN 'STOP' THEN 1 WHEN 'CONFIG' THEN 2 ELSE 3 END"
_RECORDS = f"""wo AS (SELECT record_id, arg_min(status, {_RANK}) AS worst, count(*) FILTER (payload = 77) AS findings FROM st WHERE artifact <> 'decision.withdrawn' AND payload % 4 > 0 GROUP BY 1),
rs AS (SELECT i.record_id, CASE WHEN findings > 0 THEN 'STOP' WHEN i.record_id % 11 = 0 THEN 'EXCLUDED' WHEN worst IS NULL THEN 'ACTION_NEEDED' WHEN worst = 'READY' AND (i.record_id % 3 > 0 OR i.record_id % 2 = 1) THEN 'ACTION_NEEDED' ELSE worst END AS status
 FROM (SELECT DISTINCT record_id FROM ev) i LEFT JOIN wo USING (record_id))"""
_ADOPT = f"""ids AS (SELECT record_id, min(seq) - 1 AS seq FROM ev GROUP BY 1),
dd AS (SELECT record_id, seq, 'DEC-' || record_id % 2 || '@' || left({_H('record_id % 10')}, 12) AS id, CASE WHEN record_id % 9 = 0 THEN 'REJECT' ELSE 'ACCEPT' END AS verdict FROM ids WHERE record_id % 7 <> 0),
ad AS (SELECT record_id, seq, payload AS p, 'DEC-' || record_id % 2 || '@' || left({_H('record_id % 10')}, 12) AS id,
  CASE WHEN payload % 19 = 0 THEN 'other' WHEN payload % 2 = 0 THEN 'legacy' ELSE 'annalist' END AS f, CASE WHEN (CASE WHEN payload % 17 = 0 THEN payload % 2 ELSE 1 - payload % 2 END) = 0 THEN 'legacy' ELSE 'annalist' END AS t FROM ev WHERE kind = 'record.registered'),
aj AS (SELECT a.*, d.verdict, d.record_id AS of_record FROM ad a ASOF LEFT JOIN dd d ON a.id = d.id AND a.seq > d.seq),
fo AS (SELECT *, CASE WHEN p % 23 = 0 THEN 'reference' WHEN f = 'other' THEN 'runtime' WHEN f = t THEN 'same' WHEN p % 29 = 0 THEN 'time' WHEN p % 13 = 0 THEN 'envelope' WHEN verdict IS NULL THEN 'decision' WHEN verdict <> 'ACCEPT' OR of_record <> record_id THEN 'verdict' END AS told FROM aj),
ap AS (SELECT *, coalesce(told, CASE WHEN coalesce(last_value(CASE WHEN told IS NULL THEN t END IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'legacy') <> f THEN 'owner' END) AS problem FROM fo),
ow AS (SELECT record_id, arg_max(t, seq) AS runtime, 'REF-1' AS reference FROM ap WHERE problem IS NULL GROUP BY 1)"""
_ACTS = "ac AS (SELECT *, sha256(record_id || '|' || payload % 25) AS digest FROM ev)"
_AD = lambda name: f"sha256('{name}|' || record_id)"
_W = " OVER (PARTITION BY record_id ORDER BY seq"
_FOLD = f"""da AS (SELECT record_id, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'b' END AS artifact, seq, payload AS p, CASE WHEN kind = 'decision.withdrawn' THEN 'WITHDRAW' WHEN payload % 6 = 0 THEN 'REJECT' WHEN payload % 6 <= 2 THEN 'UNDO' ELSE 'ACCEPT' END AS verdict
 FROM ev WHERE kind IN ('decision.recorded', 'decision.withdrawn')),
du AS (SELECT *, last_value(CASE WHEN verdict = 'WITHDRAW' THEN seq END IGNORE NULLS) OVER (PARTITION BY record_id, artifact ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - (p % 5 = 0)::INT AS undo_of, row_number() OVER (PARTITION BY record_id, artifact ORDER BY seq) AS n FROM da),
fo AS (SELECT record_id, artifact, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS verdict, false AS effective, NULL::BIGINT AS withdrawal FROM du WHERE n = 1
 UNION ALL SELECT d.record_id, d.artifact, d.n, d.seq, d.verdict, CASE d.verdict WHEN 'WITHDRAW' THEN true WHEN 'UNDO' THEN coalesce(p % 7 <> 0 AND undo_of = fo.withdrawal, false) ELSE fo.withdrawal IS NULL END,
  CASE WHEN d.verdict = 'WITHDRAW' THEN d.seq WHEN d.verdict = 'UNDO' AND p % 7 <> 0 AND undo_of = fo.withdrawal THEN NULL ELSE fo.withdrawal END FROM fo JOIN du d ON d.record_id = fo.record_id AND d.artifact = fo.artifact AND d.n = fo.n + 1)"""
SQL = {
    "decided_acts": f"WITH RECURSIVE {_EV}, {_FOLD} SELECT record_id, artifact, seq, effective, withdrawal FROM fo WHERE n > 0",
    "effective_decisions": f"WITH RECURSIVE {_EV}, {_FOLD} SELECT record_id, artifact, max(seq) FILTER (effective) AS seq, arg_max(verdict, seq) FILTER (effective) AS verdict, arg_max(withdrawal IS NOT NULL, seq) AS withdrawn FROM fo WHERE n > 0 GROUP BY 1, 2",
    "receipt_check": f"""WITH {_EV}, {_RECEIPTS}, s AS (SELECT *, strpos(authorisation, '@') > 0 AS named FROM re)
SELECT record_id, seq, CASE WHEN p % 11 = 0 THEN 'output' WHEN p % 13 = 0 THEN 'inputs' WHEN p % 17 = 0 THEN 'input_digest' WHEN p % 19 = 0 THEN 'code_version' WHEN p % 5 = 0 THEN 'not_a_model' WHEN p % 23 = 0 THEN 'model'
WHEN NOT named THEN 'reference' WHEN left(subject, 12) <> string_split(authorisation, '@')[2] THEN 'subject' WHEN p % 31 = 0 THEN 'time' WHEN started < TIMESTAMP '2024-01-01' THEN 'early' WHEN p % 8 IN (1, 2) THEN 'truncated' END AS problem FROM s""",
    "receipt_binding": f"""WITH {_EV}, {_DECISIONS}, {_RECEIPTS}, j AS (SELECT r.*, d.seq AS decision_seq, d.verdict, d.artifact, d.subject_sha256, d.at_ FROM (SELECT * FROM re WHERE p % 5 <> 0) r ASOF LEFT JOIN de d ON r.record_id = d.record_id AND r.authorisation = d.id AND r.seq > d.seq)
SELECT record_id, seq, authorisation, decision_seq, CASE WHEN decision_seq IS NULL THEN 'unknown' WHEN verdict <> 'ACCEPT' THEN 'verdict' WHEN artifact <> 'transcript.confirmed' THEN 'artifact' WHEN subject <> subject_sha256 THEN 'subject'
WHEN strptime(left(at_, 19), '%Y-%m-%dT%H:%M:%S') <= started THEN 'bound' ELSE 'early' END AS binding FROM j""",
    "egress_inheritance": f"""WITH {_EV}, x AS (SELECT record_id, seq, kind, {_H('payload % 3')} AS sha, kind = 'decision.withdrawn' OR (kind = 'decision.recorded' AND payload % 6 = 0) AS bad FROM ev),
y AS (SELECT *, last_value(CASE WHEN kind = 'artifact.produced' THEN sha END IGNORE NULLS){_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up,
 last_value(CASE WHEN kind IN ('decision.recorded', 'decision.withdrawn') THEN CASE WHEN bad THEN 'no' ELSE sha END END IGNORE NULLS){_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told,
 coalesce(bool_or(bad OR kind IN ('artifact.produced', 'record.registered')){_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS moved FROM x),
z AS (SELECT record_id, seq, coalesce(sha = up AND told = up, false) AS inherited, moved FROM y WHERE kind = 'source.ingested') SELECT record_id, seq, inherited, inherited AND NOT moved AS holds FROM z""",
    "status_explanations": f"""WITH {_EV}, {_LAST} SELECT record_id, artifact, status, {_EXIT} AS exit_code, CASE
WHEN status = 'READY' THEN CASE WHEN binding = 'n/a' AND derivation = 'n/a' AND decision = 'n/a' THEN '{status.NOTHING_NEEDED}'
 ELSE array_to_string(list_filter([CASE WHEN binding = 'bound' THEN '{status.BOUND}' END, CASE WHEN derivation = 'current' THEN '{status.UNCHANGED}' END, CASE WHEN decision = 'accepted' THEN '{status.ANSWERED}' END], lambda x: x IS NOT NULL), ', ') END
WHEN status = 'EXCLUDED' THEN CASE WHEN NOT enabled THEN '{status.DISABLED}' WHEN decision = 'rejected' THEN '{status.REJECTED}' ELSE '{status.WITHDRAWN}' END
WHEN status = 'REVIEW_REQUIRED' THEN '{status.DRIFT}' WHEN status = 'STALE' THEN '{status.MOVED}' WHEN status = 'ACTION_NEEDED' THEN '{status.UNDECIDED}' WHEN binding = 'unknown' THEN '{status.UNBOUND}' ELSE '{status.UNPROVEN}' END AS explanation FROM st""",
    "gate_conjunction": f"""WITH {_EV}, {_LAST}, i AS (SELECT conv_id AS record_id FROM conversations UNION SELECT record_id FROM ev),
g AS (SELECT record_id, arg_min(status, {_RANK} * 1000 + list_position({list(KINDS.values())}, artifact)) AS status, arg_min(artifact, {_RANK} * 1000 + list_position({list(KINDS.values())}, artifact)) AS gate, count(*) FILTER (status <> 'READY') AS failed, count(*) AS gates FROM st GROUP BY 1)
SELECT i.record_id, coalesce(g.status, 'STOP') AS status, CASE WHEN failed > 0 THEN gate END AS gate, coalesce(failed, 0)::BIGINT AS failed, coalesce(gates, 0)::BIGINT AS gates FROM i LEFT JOIN g USING (record_id)""",
    "record_status": f"WITH {_EV}, {_LAST}, {_RECORDS} SELECT record_id, status, {_EXIT} AS exit_code FROM rs",
    "workspace_worst": f"WITH {_EV}, {_LAST}, {_RECORDS}, w AS (SELECT coalesce(arg_min(status, {_RANK}), 'STOP') AS status, count(*)::BIGINT AS records FROM rs WHERE status NOT IN ('STOP', 'REVIEW_REQUIRED')) SELECT *, {_EXIT} AS exit_code FROM w",
    "usable_artifacts": f"WITH {_EV}, {_LAST} SELECT record_id, artifact FROM st WHERE status = 'READY' AND payload % 5 <> 0",
    "adoption_check": f"WITH {_EV}, {_ADOPT} SELECT record_id, seq, problem FROM ap",
    "ledger_owners": f"WITH {_EV}, {_ADOPT} SELECT * FROM ow",
    "owner_counts": f"""WITH {_EV}, {_ADOPT}, o AS (SELECT i.record_id, coalesce(runtime, 'legacy') AS runtime FROM ids i LEFT JOIN ow USING (record_id))
SELECT r.runtime, count(o.record_id)::BIGINT AS records, count(o.record_id) = 0 AND (SELECT count(*) FROM o) > 0 AS retired FROM (SELECT unnest(['legacy', 'annalist', 'third']) AS runtime) r LEFT JOIN o USING (runtime) GROUP BY 1""",
    "ledger_against_journal": f"""WITH {_EV}, {_ADOPT} SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 'behind' ELSE 'differs' END AS finding FROM ow WHERE record_id % 3 = 0 OR record_id % 5 = 0
UNION ALL SELECT record_id + 1000000, 'claims' FROM ow WHERE record_id % 4 = 0""",
    "uncertain_intents": f"WITH {_EV}, {_ACTS} SELECT record_id, seq, digest AS intent_sha256 FROM ac WHERE kind = 'record.registered' AND digest NOT IN (SELECT digest FROM ac WHERE kind = 'artifact.produced' AND payload % 3 > 0)",
    "operation_events": f"WITH {_EV}, {_ACTS} SELECT a.record_id, a.seq, count(*)::BIGINT AS intents FROM ac a JOIN ac i ON a.digest = i.digest AND i.kind = 'record.registered' WHERE a.kind = 'artifact.produced' AND a.payload % 3 > 0 GROUP BY 1, 2",
    "prepared_completed": f"""WITH {_EV}, {_ACTS}, c AS (SELECT digest, count(*) FILTER (kind = 'source.ingested') AS prepared, count(*) FILTER (kind = 'decision.recorded') AS completed FROM ac WHERE kind IN ('source.ingested', 'decision.recorded') GROUP BY 1)
SELECT *, CASE WHEN prepared = 0 THEN 'orphan' WHEN completed = 0 THEN 'open' WHEN prepared = 1 AND completed = 1 THEN 'done' ELSE 'repeated' END AS state FROM c""",
    "intent_digests": f"""WITH {_EV} SELECT seq, sha256('{{"command":"ingest","domain":"operation","inputs":{{"assignment":"' || {_H('payload + 1')} || '","source":"' || {_H('payload')} || '"}},"target_key":"REC-' || record_id || '","v":1,"workspace_id":"ws"}}') AS intent_sha256 FROM ev WHERE kind = 'record.registered'""",
    "bundle_chain": f"""WITH r AS (SELECT DISTINCT conv_id AS record_id FROM conversations),
t AS (SELECT record_id, record_id % 31 <> 1 AS a, a AND record_id % 13 <> 1 AS p, p AND record_id % 11 <> 1 AS m, p AND record_id % 7 <> 1 AS b, m AND record_id % 19 <> 1 AS md, b AND record_id % 5 <> 1 AS bd FROM r)
SELECT record_id, CASE WHEN m THEN {_AD('metadata.draft')} END AS metadata_draft, CASE WHEN b THEN {_AD('abstract.draft')} END AS abstract_draft, CASE WHEN p AND record_id % 17 <> 3 THEN {_AD('l1')} END AS adjudicated,
CASE WHEN NOT a THEN 'approval' WHEN record_id % 23 = 2 THEN 'record' WHEN NOT p THEN 'preview' WHEN NOT m THEN 'metadata' WHEN NOT b THEN 'abstract' WHEN NOT md THEN 'metadata_last' WHEN NOT bd THEN 'abstract_last' WHEN record_id % 17 = 3 THEN 'adjudicated' END AS problem FROM t""",
}
SQL["recovery_report"] = f"""WITH m AS ({_WORKFLOW['recovery_matrix']}) SELECT intent, valid, complete, prestate, foreign_event, written, {' '.join(['CASE class', *(f"WHEN '{k}' THEN '{v[0]}'" for k, v in recovery.REPORT.items()), 'END'])} AS status,
{' '.join(['CASE class', *(f"WHEN '{k}' THEN '{v[1]}'" for k, v in recovery.REPORT.items()), 'END'])} AS reason FROM m"""
