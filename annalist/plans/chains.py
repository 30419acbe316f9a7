"""Queries over journals of many records as keyed chains, and what replay makes of them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.operators import chain, protected, timeline, views
from annalist.operators.receipts import latest_before
from annalist.plans.workflow import _CASE
from annalist.sources import commits
from annalist.sources.tables import read, shared
from annalist.streaming import replay

#: Fixture convention: sixteen journals; the key they are sealed with, and another one.
JOURNALS, KEY, OTHER = 16, b"fixture-journal-key", b"another-key"


def journal_events(spark, sf_dir):
    """Fixture convention: the events of all users with one remainder modulo 16 are one journal; every tenth carries an intent."""
    e = read(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % JOURNALS).alias("journal"), F.col("event_id").alias("order"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.expr(_CASE).alias("kind"), F.col("user_id").alias("record_id"),
        F.get_json_object("props", "$.k").cast("long").alias("payload"), F.when(F.col("event_id") % 10 == 0, F.sha2(F.col("event_id").cast("string"), 256)).alias("operation_intent_sha256"))


def chain_seal(spark, sf_dir):
    return chain.seal(journal_events(spark, sf_dir), KEY)


def _tampered(spark, sf_dir):
    """Fixture convention, by (seq + 13 journal) modulo 97: a row is lost (0), its time edited (10), sealed with another key
    (20), or has changed places with the next (30 and 31)."""
    j = chain_seal(spark, sf_dir).withColumn("m", (F.col("seq") + 13 * F.col("journal")) % 97).where("m <> 0")
    body = F.concat(chain.front(*map(F.col, ("at", "kind", "operation_intent_sha256", "payload"))), F.col("prev"), chain.back(F.col("record_id")), F.col("seq").cast("string"), F.lit("}"))
    j = j.withColumn("digest", F.when(F.col("m") == 20, chain.digest(body, OTHER)).otherwise(F.col("digest")))
    return j.withColumns({"at": F.when(F.col("m") == 10, "2000-01-01T00:00:00Z").otherwise(F.col("at")), "seq": F.col("seq") + F.when(F.col("m") == 30, 1).when(F.col("m") == 31, -1).otherwise(0)}).drop("m")


def chain_verify(spark, sf_dir):
    return chain.verify(_tampered(spark, sf_dir), KEY)


def chain_breaks(spark, sf_dir):
    return chain.breaks(chain_verify(spark, sf_dir))


#: Fixture convention: what the views of users are inputs of, by remainder.
ROLES = ["codebook", "policy", "register"]


def _numbered(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("record_id"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def inputs_as_of(spark, sf_dir):
    """Fixture convention: every 20th event is an input of all records, of a role by its number; what held before each event."""
    e = _numbered(spark, sf_dir)
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("seq") / 20 % 3 + 1).cast("int"))
    found = timeline.inputs_as_of(e.select("seq", "record_id"), e.where("seq % 20 = 0").select(role.alias("role"), "seq", F.sha2(F.col("k").cast("string"), 256).alias("sha256")), ROLES)
    return found.select("seq", "record_id", *[F.col(f"{r}.{c}").alias(f"{r}_{c}") for r in ROLES for c in ("sha256", "seq")])


#: Fixture convention: phases, the role that each makes, and the role that it is based on.
PHASES = {"review": ("r0", "source"), "resolve": ("r1", "r0"), "pseudonymise": ("r2", "r1")}


def _acts(spark, sf_dir):
    """Fixture convention: events of users as protected acts. A view makes a source (every 7th, of a role that only acts may make),
    a click prepares the phase k modulo 3, a purchase completes the last plan of its user (every 11th: of another user),
    an error is a checkpoint that begins a session. Plans claim the last source, or what the last plan of the phase before was to
    make at the last purchase, and the state of policy, actor and checkpoint then; every 5th claims other bytes."""
    e = _numbered(spark, sf_dir)
    at = lambda kind: F.last(F.when(F.col("event_type") == kind, F.struct("seq", "k")), ignorenulls=True).over(before)
    before = W.partitionBy("record_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    phase = F.element_at(F.array(*map(F.lit, PHASES)), (F.col("k") % 3 + 1).cast("int"))
    click = F.struct("seq", "k")
    e = e.withColumns({"source": F.last(F.when((F.col("event_type") == "view") & (F.col("k") % 7 != 0), click), ignorenulls=True).over(before), "click": at("click"), "purchase": at("purchase")})
    e = e.withColumns({f"plan{n}": F.last(F.when((F.col("event_type") == "click") & (F.col("k") % 3 == n), click), ignorenulls=True).over(before) for n in range(2)})
    e = e.withColumns({f"point{n}": F.last(F.when((F.col("event_type") == "error") & (F.col("k") % 3 == n), F.col("seq")), ignorenulls=True).over(before) for n in range(3)})
    inputs = e.where("seq % 500 = 0").select(F.lit("policy").alias("role"), "seq", (F.col("k") % 10).cast("string").alias("sha256"))
    actors = e.where("seq % 500 = 250").select((F.col("k") % 4).alias("actor"), "seq", (F.col("k") % 5 > 0).alias("active"))
    clicks = e.where("event_type = 'click'").select("seq", (F.col("k") % 4).alias("actor"))
    claims = timeline.inputs_as_of(latest_before(clicks, actors, ["actor"], ["seq"]), inputs, ["policy"]).select("seq", F.col("found.seq").alias("actor_seq"), "policy")
    e = e.join(claims, "seq", "left")
    sha = lambda c: (F.col(c)["k"] % 10 + (F.col("k") % 5 == 0).cast("int")).cast("string")
    based = lambda n: F.struct(F.lit(["source", "r0", "r1"][n]).alias("role"), sha(["source", "plan0", "plan1"][n]).alias("sha256"), F.col("source.seq" if n == 0 else "purchase.seq").alias("seq"))
    policy = F.struct(F.lit("policy").alias("role"), F.col("policy.sha256").alias("sha256"), F.col("policy.seq").alias("seq"))
    by_phase = lambda f: F.when(F.col("k") % 3 == 0, f(0)).when(F.col("k") % 3 == 1, f(1)).otherwise(f(2))
    is_ = {n: F.col("event_type") == n for n in ("view", "click", "purchase", "error")}
    text = lambda c: c.cast("string")
    acts = e.select(
        "record_id", "seq", F.when(is_["view"], protected.PRODUCED).when(is_["click"], protected.PREPARED).when(is_["purchase"], protected.COMPLETED).when(is_["error"], protected.CHECKPOINT).otherwise("other").alias("kind"),
        F.when(is_["view"], F.when(F.col("k") % 7 == 0, "r1").otherwise("source")).when(is_["click"], F.concat(F.lit("r"), text(F.col("k") % 3))).alias("artifact"),
        F.when(is_["view"] | is_["click"], text(F.col("k") % 10)).alias("sha256"),
        F.when(is_["click"], text(F.col("seq"))).when(is_["purchase"], text(F.when(F.col("k") % 11 == 0, F.col("click.seq") + 1).otherwise(F.col("click.seq")))).alias("plan"),
        F.when(is_["click"] | is_["error"], phase).alias("phase"), F.when(is_["click"], F.array(by_phase(based), policy)).alias("basis"), F.when(is_["click"], F.col("k") % 4).alias("actor"), "actor_seq",
        F.when(is_["click"], text(by_phase(lambda n: F.col(f"point{n}")))).when(is_["error"], text(F.col("seq"))).alias("checkpoint"),
        F.when(is_["error"], text(F.col("seq"))).alias("session"), F.when(is_["error"], F.when(F.col("k") % 13 == 0, 2).otherwise(1)).alias("revision"), F.lit(None).cast("string").alias("previous"))
    return acts, inputs, actors


def protected_expansion(spark, sf_dir):
    acts, inputs, actors = _acts(spark, sf_dir)
    return protected.expand(acts, inputs, actors, ["r0", "r1", "r2"])


def _artifact_events(spark, sf_dir):
    """Fixture convention: a view makes bytes, a click is a receipt, a purchase a decision, an error an anchor check of artifact k modulo
    3; signups only count. Every 17th has no digest, every 19th decision no known verdict, every 23rd check no known outcome;
    an UNDO names the last WITHDRAW of its artifact (every second one the number after it)."""
    e = _numbered(spark, sf_dir).withColumn("number", F.row_number().over(W.partitionBy("record_id").orderBy("seq")).cast("long"))
    kinds = {"view": views.PRODUCED, "click": views.RECEIPT, "purchase": views.DECISION, "error": views.ANCHOR}
    kind = F.coalesce(*[F.when(F.col("event_type") == t, k) for t, k in kinds.items()], F.lit("seen"))
    verdicts = F.array(*map(F.lit, [*["ACCEPT"] * 5, "REJECT", "WITHDRAW", "UNDO"]))
    e = e.withColumns({
        "kind": kind, "artifact": F.when(kind != "seen", F.concat(F.lit("a"), (F.col("k") % 3).cast("string"))), "sha256": F.when(F.col("k") % 17 == 0, "none").otherwise(F.sha2((F.col("k") % 10).cast("string"), 256)),
        "verdict": F.when(kind == views.DECISION, F.when(F.col("k") % 19 == 0, "MAYBE").otherwise(F.element_at(verdicts, (F.col("k") % 8 + 1).cast("int")))),
        "outcome": F.when(kind == views.ANCHOR, F.when(F.col("k") % 23 == 0, "odd").otherwise(F.element_at(F.array(*map(F.lit, views.OUTCOMES)), (F.col("k") % 4 + 1).cast("int")))), "human": F.col("k") % 3 > 0})
    before = W.partitionBy("record_id", "artifact").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    named = F.last(F.when(F.col("verdict") == "WITHDRAW", F.col("seq")), ignorenulls=True).over(before)
    return e.withColumn("undo_of", F.when(F.col("verdict") == "UNDO", named + (F.col("seq") % 2))).select("record_id", *replay.EVENTS)


def replay_views(spark, sf_dir):
    return views.views(_artifact_events(spark, sf_dir))


def replay_stream(spark, sf_dir):
    """The same events in three slices of each record's numbers; the stream is begun anew from its checkpoint for each."""
    folder, e = shared(spark, "replay"), _artifact_events(spark, sf_dir)
    piece = F.when(F.col("number") <= 4, 0).when(F.col("number") <= 20, 1).otherwise(2)
    e.withColumn("piece", piece).write.parquet(f"{folder}/events")  # made once, not once a slice
    made = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in e.schema)}, piece int").parquet(f"{folder}/events")
    for n in range(3):
        made.where(F.col("piece") == n).drop("piece").write.mode("append").parquet(f"{folder}/in")
        replay.run(spark, f"{folder}/in", e.schema, f"{folder}/out", f"{folder}/checkpoint")
    return replay.latest(spark.read.schema(views.SCHEMA.format("long")).parquet(f"{folder}/out"))


def journal_commits(spark, sf_dir):
    """The events in three transactions, of which the second comes twice and a fourth dies before it is published; the snapshot
    of what counts, with the version that each row came with."""
    j = commits.Journal(spark, f"{shared(spark, 'journal')}", KEY)
    e = journal_events(spark, sf_dir)
    for n in (0, 1, 1, 2):
        j.append(e.where(F.col("order") % 3 == n), f"batch/{n}")

    def die():
        raise InterruptedError

    try:
        j.append(e, "batch/3", before_publish=die)
    except InterruptedError:
        pass  # as a killed writer would leave it: a part that nothing names
    return j.snapshot()


QUERIES = {f.__name__: f for f in (chain_seal, chain_verify, chain_breaks, inputs_as_of, protected_expansion, replay_views, replay_stream, journal_commits)}


def _pad(key: bytes, byte: int) -> str:
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in key.ljust(64, b"\0")) + "'::BLOB"


def _mac(key: bytes, text: str) -> str:
    return f"sha256({_pad(key, 0x5C)} || unhex(sha256({_pad(key, 0x36)} || encode({text}))))"


_BODY = """'{"at":"' || e.at || '","kind":"' || e.kind || CASE WHEN e.intent IS NULL THEN '"' ELSE '","operation_intent_sha256":"' || e.intent || '"' END || ',"payload":' || e.payload || ',"prev":"' || %s || '","record_id":' || e.record_id || ',"seq":' || e.seq || '}'"""
_ZERO = "repeat('0', 64)"
_EVENTS = f"""ev AS (SELECT user_id % {JOURNALS} AS journal, row_number() OVER (PARTITION BY user_id % {JOURNALS} ORDER BY event_id) AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, {_CASE} AS kind,
 user_id AS record_id, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS payload, CASE WHEN event_id % 10 = 0 THEN sha256(CAST(event_id AS VARCHAR)) END AS intent FROM events)"""
_SEALED = f"""{_EVENTS}, ch AS (SELECT e.*, {_ZERO} AS prev, {_mac(KEY, _BODY % _ZERO)} AS digest FROM ev e WHERE seq = 1
 UNION ALL SELECT e.*, ch.digest, {_mac(KEY, _BODY % 'ch.digest')} FROM ch JOIN ev e ON e.journal = ch.journal AND e.seq = ch.seq + 1)"""
_VERIFIED = f"""{_SEALED}, m AS (SELECT *, (seq + 13 * journal) % 97 AS m FROM ch),
t AS (SELECT journal, seq + CASE m WHEN 30 THEN 1 WHEN 31 THEN -1 ELSE 0 END AS seq, CASE WHEN m = 10 THEN '2000-01-01T00:00:00Z' ELSE e.at END AS at, kind, record_id, payload, intent, prev, CASE WHEN m = 20 THEN {_mac(OTHER, _BODY % 'e.prev')} ELSE digest END AS digest FROM m e WHERE m <> 0),
o AS (SELECT *, coalesce(lag(digest) OVER w, {_ZERO}) AS before, coalesce(lag(seq) OVER w, 0) AS number FROM t WINDOW w AS (PARTITION BY journal ORDER BY seq, digest)),
v AS (SELECT journal, seq, CASE WHEN seq <> number + 1 THEN 'gap' WHEN prev <> before THEN 'link' WHEN digest <> {_mac(KEY, _BODY % 'e.prev')} THEN 'altered' END AS problem FROM o e)"""
_INPUTS = f"""n AS (SELECT event_id AS seq, user_id AS record_id, event_type, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS k FROM events)"""
_ROLE = lambda r, i: f"(SELECT sha256(CAST(k AS VARCHAR)) AS {r}_sha256, seq AS {r}_seq FROM n WHERE seq % 20 = 0 AND seq // 20 % 3 = {i}) {r} ON n.seq > {r}.{r}_seq"
_ACTS = f"""{_INPUTS}, po AS (SELECT seq AS po_seq, CAST(k % 10 AS VARCHAR) AS po_sha FROM n WHERE seq % 500 = 0), ac AS (SELECT k % 4 AS actor, seq AS ac_seq, k % 5 > 0 AS active FROM n WHERE seq % 500 = 250),
l AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS nth, k % 3 AS ph,
 last_value(CASE WHEN event_type = 'view' AND k % 7 <> 0 THEN {{'seq': seq, 'k': k}} END IGNORE NULLS) OVER w AS source, last_value(CASE WHEN event_type = 'click' THEN seq END IGNORE NULLS) OVER w AS click,
 last_value(CASE WHEN event_type = 'purchase' THEN seq END IGNORE NULLS) OVER w AS purchase, last_value(CASE WHEN event_type = 'click' AND k % 3 = 0 THEN k END IGNORE NULLS) OVER w AS plan0, last_value(CASE WHEN event_type = 'click' AND k % 3 = 1 THEN k END IGNORE NULLS) OVER w AS plan1,
 [last_value(CASE WHEN event_type = 'error' AND k % 3 = 0 THEN seq END IGNORE NULLS) OVER w, last_value(CASE WHEN event_type = 'error' AND k % 3 = 1 THEN seq END IGNORE NULLS) OVER w, last_value(CASE WHEN event_type = 'error' AND k % 3 = 2 THEN seq END IGNORE NULLS) OVER w][k % 3 + 1] AS point
 FROM n WINDOW w AS (PARTITION BY record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT l.*, po.*, ac.ac_seq, ac.active FROM l ASOF LEFT JOIN po ON l.seq > po.po_seq ASOF LEFT JOIN ac ON l.k % 4 = ac.actor AND l.seq > ac.ac_seq),
c AS (SELECT g.*, CASE WHEN event_type = 'purchase' AND k % 11 > 0 THEN click END AS plan FROM g),
p AS (SELECT seq AS p_seq, ph AS p_ph, k % 10 AS p_sha, k % 4 AS p_actor, CASE ph WHEN 0 THEN source.k WHEN 1 THEN plan0 ELSE plan1 END % 10 + (k % 5 = 0)::INT AS b_sha, CASE ph WHEN 0 THEN source.seq ELSE purchase END AS b_seq,
 po_sha AS b_po_sha, po_seq AS b_po_seq, ac_seq AS b_ac, point AS p_point FROM g WHERE event_type = 'click'),
x AS MATERIALIZED (SELECT c.record_id, c.seq, c.nth, c.event_type, c.k, c.ph, c.po_sha, c.po_seq, p.*, a.ac_seq AS now_ac, a.active AS now_active FROM c LEFT JOIN p ON c.plan = p.p_seq ASOF LEFT JOIN ac a ON p.p_actor = a.actor AND c.seq > a.ac_seq),
-- made: bytes and numbers of source, r0, r1, r2; the last plan that was completed (plans come in order); the last checkpoint by phase
f AS (SELECT record_id, nth, [CASE WHEN event_type = 'view' AND k % 7 <> 0 THEN k % 10 END, NULL, NULL, NULL] AS sha, [CASE WHEN event_type = 'view' AND k % 7 <> 0 THEN seq END, NULL, NULL, NULL] AS num,
  NULL::BIGINT AS used, [CASE WHEN event_type = 'error' AND k % 13 > 0 AND k % 3 = i THEN seq END for i in [0, 1, 2]] AS points,
  CASE WHEN event_type = 'purchase' THEN 'unknown' WHEN event_type = 'view' AND k % 7 = 0 THEN 'unprotected' WHEN event_type = 'error' AND k % 13 = 0 THEN 'order' END AS finding FROM x WHERE nth = 1
 UNION ALL SELECT record_id, nth, [CASE WHEN i = made THEN bytes ELSE sha[i] END for i in [1, 2, 3, 4]], [CASE WHEN i = made THEN seq ELSE num[i] END for i in [1, 2, 3, 4]], CASE WHEN event_type = 'purchase' AND finding IS NULL THEN p_seq ELSE used END,
  [CASE WHEN event_type = 'error' AND k % 13 > 0 AND k % 3 = i THEN seq ELSE points[i + 1] END for i in [0, 1, 2]], finding
 FROM (SELECT *, CASE WHEN event_type = 'view' AND k % 7 <> 0 THEN 1 WHEN event_type = 'purchase' AND finding IS NULL THEN p_ph + 2 END AS made, CASE WHEN event_type = 'view' THEN k % 10 ELSE p_sha END AS bytes
  FROM (SELECT x.*, f.sha, f.num, f.used, f.points, CASE WHEN event_type = 'view' AND k % 7 = 0 THEN 'unprotected' WHEN event_type = 'error' AND k % 13 = 0 THEN 'order' WHEN event_type <> 'purchase' THEN NULL WHEN p_seq IS NULL THEN 'unknown' WHEN p_seq <= f.used THEN 'twice'
   WHEN b_sha IS NULL OR b_seq IS NULL OR f.sha[p_ph + 1] IS DISTINCT FROM b_sha OR f.num[p_ph + 1] IS DISTINCT FROM b_seq OR po_sha IS DISTINCT FROM b_po_sha OR po_seq IS DISTINCT FROM b_po_seq THEN 'basis'
   WHEN NOT coalesce(now_active, false) OR now_ac IS DISTINCT FROM b_ac THEN 'actor' WHEN p_point IS NOT NULL AND f.points[p_ph + 1] IS DISTINCT FROM p_point THEN 'checkpoint' END AS finding
   FROM f JOIN x ON x.record_id = f.record_id AND x.nth = f.nth + 1)))"""
_VIEWS = f"""{_INPUTS}, e0 AS (SELECT seq, record_id, k, CASE event_type WHEN 'view' THEN 'P' WHEN 'click' THEN 'R' WHEN 'purchase' THEN 'D' WHEN 'error' THEN 'A' END AS kind FROM n),
e1 AS (SELECT *, 'a' || k % 3 AS artifact, CASE WHEN k % 17 > 0 THEN sha256(CAST(k % 10 AS VARCHAR)) END AS sha, CASE WHEN kind <> 'D' OR k % 19 = 0 THEN NULL WHEN k % 8 < 5 THEN 'ACCEPT' ELSE ['REJECT', 'WITHDRAW', 'UNDO'][k % 8 - 4] END AS v,
 CASE WHEN k % 23 > 0 THEN ['exact', 'unique_move', 'ambiguous', 'missing'][k % 4 + 1] END AS o, k % 3 > 0 AS human FROM e0),
x AS MATERIALIZED (SELECT *, row_number() OVER w AS nth, CASE WHEN v = 'UNDO' THEN last_value(CASE WHEN v = 'WITHDRAW' THEN seq END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + seq % 2 END AS undo_of
 FROM e1 WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY record_id, artifact ORDER BY seq)),
f AS (SELECT DISTINCT record_id, artifact, 0::BIGINT AS nth, NULL::VARCHAR AS sha256, []::VARCHAR[] AS had, NULL::VARCHAR AS receipt_for, NULL::VARCHAR AS decided_sha256, NULL::VARCHAR AS verdict, NULL::BIGINT AS withdrawal, NULL::VARCHAR AS outcome, NULL::BIGINT AS epoch, 0::BIGINT AS bad FROM x
 UNION ALL SELECT record_id, artifact, nth, CASE WHEN kind = 'P' AND sha IS NOT NULL THEN sha ELSE old END, CASE WHEN kind = 'P' AND sha IS NOT NULL AND NOT list_contains(had, sha) THEN list_append(had, sha) ELSE had END,
  CASE WHEN kind = 'R' AND sha IS NOT NULL THEN sha ELSE receipt_for END, CASE WHEN kind = 'D' AND (v IS NULL OR sha IS NULL) THEN NULL WHEN counts THEN sha ELSE decided_sha256 END, CASE WHEN kind = 'D' AND (v IS NULL OR sha IS NULL) THEN NULL WHEN counts THEN v ELSE verdict END,
  CASE WHEN counts AND v = 'WITHDRAW' THEN seq WHEN counts AND v = 'UNDO' THEN NULL ELSE withdrawal END, CASE WHEN kind = 'A' AND old IS NOT NULL AND o IS NOT NULL THEN o ELSE outcome END,
  CASE WHEN kind IN ('P', 'R') AND sha IS NOT NULL OR counts THEN seq ELSE epoch END, bad + CASE kind WHEN 'A' THEN old IS NULL OR o IS NULL WHEN 'D' THEN v IS NULL OR sha IS NULL ELSE sha IS NULL END::INT
 FROM (SELECT f.* EXCLUDE (nth, sha256), f.sha256 AS old, x.* EXCLUDE (record_id, artifact), coalesce(kind = 'D' AND sha IS NOT NULL AND CASE v WHEN 'WITHDRAW' THEN true WHEN 'UNDO' THEN human AND undo_of = withdrawal ELSE v IS NOT NULL AND withdrawal IS NULL END, false) AS counts
  FROM f JOIN x ON x.record_id = f.record_id AND x.artifact = f.artifact AND x.nth = f.nth + 1)),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY record_id, artifact ORDER BY nth DESC) = 1), r AS (SELECT record_id, CAST(sum(bad) AS BIGINT) AS findings FROM l GROUP BY 1), u AS (SELECT record_id, max(seq) AS upto FROM e0 GROUP BY 1)
SELECT record_id, artifact, sha256, CAST(len(had) AS BIGINT) AS versions, receipt_for, decided_sha256, verdict, withdrawal, outcome, epoch, findings, upto FROM l JOIN r USING (record_id) JOIN u USING (record_id)"""
_COMMITS = f"""c0 AS (SELECT row_number() OVER (ORDER BY event_id % 3, event_id) AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, {_CASE} AS kind, user_id AS record_id, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS payload, sha256('batch/' || event_id % 3) AS intent FROM events),
ch AS (SELECT e.*, {_ZERO} AS prev, {_mac(KEY, _BODY % _ZERO)} AS digest FROM c0 e WHERE seq = 1 UNION ALL SELECT e.*, ch.digest, {_mac(KEY, _BODY % 'ch.digest')} FROM ch JOIN c0 e ON e.seq = ch.seq + 1)"""
SQL = {
    "replay_views": f"WITH RECURSIVE {_VIEWS}",
    "replay_stream": f"WITH RECURSIVE {_VIEWS}",
    "journal_commits": f"WITH RECURSIVE {_COMMITS} SELECT * EXCLUDE (intent), intent AS operation_intent_sha256 FROM ch",
    "inputs_as_of": f"WITH {_INPUTS} SELECT n.seq, n.record_id, codebook_sha256, codebook_seq, policy_sha256, policy_seq, register_sha256, register_seq FROM n " + " ".join(f"ASOF LEFT JOIN {_ROLE(r, i)}" for i, r in enumerate(ROLES)),
    "protected_expansion": f"""WITH RECURSIVE {_ACTS}, y AS (SELECT x.*, f.finding FROM x JOIN f USING (record_id, nth))
SELECT record_id, seq, 0 AS part, CASE event_type WHEN 'view' THEN 'artifact.produced' WHEN 'click' THEN 'protected.prepared' WHEN 'purchase' THEN 'protected.completed' WHEN 'error' THEN 'protected.checkpoint' ELSE 'other' END AS kind,
 CASE WHEN event_type = 'view' THEN CASE WHEN k % 7 = 0 THEN 'r1' ELSE 'source' END WHEN event_type = 'click' THEN 'r' || ph END AS artifact, CASE WHEN event_type IN ('view', 'click') THEN CAST(k % 10 AS VARCHAR) END AS sha256, finding FROM y
UNION ALL SELECT record_id, seq, t.part, t.kind, 'r' || p_ph, CAST(p_sha AS VARCHAR), NULL FROM y, (VALUES (1, 'artifact.produced'), (2, 'receipt.recorded'), (3, 'decision.recorded')) t(part, kind) WHERE event_type = 'purchase' AND finding IS NULL AND (part < 3 OR p_ph < 2)""",
    "chain_seal": f"WITH RECURSIVE {_SEALED} SELECT * EXCLUDE (intent), intent AS operation_intent_sha256 FROM ch",
    "chain_verify": f"WITH RECURSIVE {_VERIFIED} SELECT * FROM v",
    "chain_breaks": f"WITH RECURSIVE {_VERIFIED}, b AS (SELECT journal, count(*) AS events, min(seq) FILTER (problem IS NOT NULL) AS broken_at, arg_min(problem, seq) FILTER (problem IS NOT NULL) AS problem FROM v GROUP BY 1) SELECT *, coalesce(broken_at - 1, events) AS sound FROM b",
}
