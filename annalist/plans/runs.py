"""Queries over model runs, prepared plans, evidence chains and marks in cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import completion, evidence, prepared, projection
from annalist.plans.chains import _INPUTS, _numbered
from annalist.sources.tables import segments, shared

#: Fixture convention: segments a request, and the one code.
SIZE, CODE = 3, "L1_X"


def _recorded(requests):
    """Fixture convention: what a recorded model answers. By record modulo 17: the run is cut off (1), a segment comes twice (2), a
    code is none of the book's (3), no JSON (4). Of the others, answers leave out segments whose number modulo 4 is 1;
    supplements have all but those of every 5th record, which lack their first segment."""
    m, whole = F.col("record_id") % 17, F.col("kind") == "supplement"
    kept = F.when(whole & (F.col("record_id") % 5 == 0), F.slice("expected", 2, 1000)).when(whole, F.col("expected")).otherwise(F.filter("expected", lambda x: x % 4 != 1))
    kept = F.when(m == 2, F.concat("expected", F.slice("expected", 1, 1))).otherwise(kept)
    code = F.when(m == 3, "OTHER").otherwise(CODE)
    entry = F.transform(kept, lambda x: F.concat(F.lit('{"segment":'), x.cast("string"), F.lit(',"code":"'), code, F.lit('"}')))
    answer = F.when(m == 4, "no answer").otherwise(F.concat(F.lit('{"results":['), F.array_join(entry, ","), F.lit("]}")))
    return requests.select("request_sha256", answer.alias("answer"), F.when(m == 1, "length").otherwise("stop").alias("finish_reason"))


def _run(spark, sf_dir):
    return completion.run(segments(spark, sf_dir), _recorded, shared(spark, "model-run"), [CODE], SIZE)


def model_suggestions(spark, sf_dir):
    return _run(spark, sf_dir)[0]


def model_outcomes(spark, sf_dir):
    return _run(spark, sf_dir)[1]


def model_anchors(spark, sf_dir):
    return completion.anchored(model_suggestions(spark, sf_dir), segments(spark, sf_dir)).select("record_id", "id", "start", "end", "quote_sha256", "context_sha256")


def model_evidence(spark, sf_dir):
    """Fixture convention: of the recorded run, by record modulo 7, the first request is lost (1) or another (2), or all supplements
    are lost (3)."""
    folder, m = shared(spark, "model-run"), F.col("record_id") % 7
    completion.run(segments(spark, sf_dir), _recorded, folder, [CODE], SIZE)
    first, second = spark.read.parquet(f"{folder}/original"), spark.read.parquet(f"{folder}/supplement")
    first = first.where(~((m == 1) & (F.col("block") == 0))).withColumn("request_sha256", F.when((m == 2) & (F.col("block") == 0), F.sha2("request_sha256", 256)).otherwise(F.col("request_sha256")))
    return completion.evidence_findings(segments(spark, sf_dir), first, second.where(m != 3), [CODE], SIZE)


#: Fixture convention: types of entities, by their number modulo 3.
TYPES = ["PERSON", "PLACE", "ORG"]
_TYPE = "element_at(array('PERSON', 'PLACE', 'ORG'), cast(k % 3 + 1 AS int))"


def _plans(spark, sf_dir):
    """Fixture convention: the first view of each k registers the surface ``s<k>`` of a type, numbered by type. Every 16th purchase is
    a plan, which needs what its user has viewed, before and after, and two new surfaces. By seq modulo 5 its report gives a
    number one higher (1), lacks its row of the least surface (2), has one more (3), or it claims an older basis (4)."""
    from pyspark.sql import Window as W

    e = _numbered(spark, sf_dir)
    first = e.where("event_type = 'view'").groupBy("k").agg(F.min("seq").alias("seq"))
    register = first.select(F.expr(_TYPE).alias("entity_type"), F.concat(F.lit("s"), "k").alias("surface"), F.row_number().over(W.partitionBy(F.col("k") % 3).orderBy("seq")).cast("long").alias("number"), "seq")
    chosen = e.where("event_type = 'purchase' AND seq % 16 = 0").select("seq", "record_id", "k")
    viewed = e.where("event_type = 'view'").select("record_id", F.col("k").alias("v")).distinct()
    old = chosen.join(viewed, "record_id").select(F.col("seq").alias("plan"), F.col("v").alias("k"), F.concat(F.lit("s"), "v").alias("surface"))
    new = chosen.select(F.col("seq").alias("plan"), "k", F.explode(F.transform(F.array(F.lit("n"), F.lit("o")), lambda x: F.concat(x, F.col("seq").cast("string")))).alias("surface"))
    needs = old.unionByName(new).select("plan", F.expr(_TYPE).alias("entity_type"), "surface")
    plans = chosen.select(F.col("seq").alias("plan"), "seq")
    return plans, needs, register


def _reported(plans, needs, register):
    """The report that each plan must give, spoiled by the convention; and the basis it claims."""
    m = F.col("plan") % 5
    right = prepared.allocated(plans, needs, register, TYPES)
    least = right.where(m.isin(1, 2)).groupBy("plan").agg(F.min(F.struct("entity_type", "surface")).alias("least"))
    r = right.join(least, "plan", "left").withColumn("hit", F.coalesce(F.struct("entity_type", "surface") == F.col("least"), F.lit(False)))
    r = r.where(~((m == 2) & F.col("hit"))).select("plan", "entity_type", "surface", (F.col("number") + ((m == 1) & F.col("hit")).cast("long")).alias("number"))
    extra = plans.where(m == 3).select("plan", F.lit("ORG").alias("entity_type"), F.lit("extra").alias("surface"), F.lit(7).cast("long").alias("number"))
    return r.unionByName(extra)


def prepared_plans(spark, sf_dir):
    plans, needs, register = _plans(spark, sf_dir)
    # the newest entry before the plan; entries are one a k, so few
    heads = plans.join(F.broadcast(register.select(F.col("seq").alias("entry"))), F.col("entry") < F.col("seq"), "left").groupBy("plan", "seq").agg(F.max("entry").alias("head"))
    claimed = heads.select("plan", "seq", (F.col("head") - (F.col("plan") % 5 == 4).cast("long")).alias("basis"))
    return prepared.findings(claimed, needs, _reported(plans, needs, register), register, TYPES)


def evidence_chains(spark, sf_dir):
    """Fixture convention: a view is a revision of bytes k modulo 6, a click a projection of such bytes with an assignment k modulo 5, an
    error a language receipt of assignment k modulo 5, a purchase a confirmation."""
    e = _numbered(spark, sf_dir)
    kinds = {"view": evidence.REVISION, "click": evidence.PROJECTION, "error": evidence.LANGUAGES, "purchase": evidence.CONFIRM}
    kind = F.coalesce(*[F.when(F.col("event_type") == t, k) for t, k in kinds.items()], F.lit("other"))
    output = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("r"), F.col("k") % 6)).when(F.col("event_type") == "error", F.concat(F.lit("l"), F.col("k") % 5))
    return evidence.chains(e.select("record_id", "seq", kind.alias("kind"), output.alias("output"), F.when(F.col("event_type") == "click", F.concat(F.lit("l"), F.col("k") % 5)).alias("assignment")))


def _texts(spark, sf_dir):
    """Fixture convention: lines of a turn without the blanks around them; an empty one is a dash. Every 9th record keeps a blank line."""
    body = F.coalesce(F.nullif(F.trim(F.regexp_replace("text", r"\s*\n\s*", "\n")), F.lit("")), F.lit("-"))
    return segments(spark, sf_dir).select("record_id", "idx", F.when((F.col("record_id") % 9 == 8) & (F.col("idx") == 0), F.concat(body, F.lit("\n\n-"))).otherwise(body).alias("text"))


def marked_cues(spark, sf_dir):
    """Fixture convention: every even segment is marked from its third on, to five places into the next one; in cues and back."""
    t = _texts(spark, sf_dir)
    placed = projection.places(t)
    n = F.col("end") - F.col("start")
    marks = placed.where("idx % 2 = 0").select("record_id", (F.col("start") + F.floor(n / 3)).alias("start"), (F.col("end") + 6).alias("end"), F.lit("PERSON").alias("entity_type"))
    found = projection.mark(projection.to_cues(marks, placed), placed, projection.project(t))
    back = projection.to_text(found, placed)
    return back.select("record_id", "mark_start", "mark_end", "cue", "start", "end", "doc_start", "doc_end", "text_start", "text_end", "document_sha256", "input_sha256")


QUERIES = {f.__name__: f for f in (model_suggestions, model_outcomes, model_anchors, model_evidence, prepared_plans, evidence_chains, marked_cues)}

#: Normalised text: line ends as LF, lines without blanks at their end, one final LF.
_NORMAL = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[^\\S\\n]+(\\n|$)', '\\1', 'g'), '\\n+$', '') || chr(10)"
_MODEL = f"""s AS (SELECT conv_id AS r, turn AS idx, conv_id % 17 AS m, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // {SIZE} AS b FROM conversations),
t AS (SELECT r, b, any_value(m) AS m, count(*) AS n, count(*) FILTER (idx % 4 = 1) AS lacks FROM s GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN m NOT IN (1, 2, 3, 4) AND lacks BETWEEN 1 AND n - 1 THEN 1 ELSE 0 END AS sup, CASE WHEN m = 1 THEN 'finish' WHEN m = 2 THEN 'ids' WHEN m = 3 AND lacks < n THEN 'code' WHEN m = 4 THEN 'json' WHEN lacks = n THEN 'ids'
 WHEN lacks > 0 AND r % 5 = 0 THEN CASE WHEN lacks > 1 THEN 'supplement-incomplete' ELSE 'supplement-ids' END END AS problem FROM t),
o AS (SELECT r AS record_id, CAST(sum(n) AS BIGINT) AS segments, CAST(sum(sup) AS BIGINT) AS supplements, min(b) FILTER (problem IS NOT NULL) AS block, arg_min(problem, b) FILTER (problem IS NOT NULL) AS problem FROM p GROUP BY 1)"""
_PLANS = f"""{_INPUTS}, g0 AS (SELECT k, min(seq) AS seq FROM n WHERE event_type = 'view' GROUP BY 1), rg AS MATERIALIZED (SELECT k % 3 AS t, 's' || k AS surface, row_number() OVER (PARTITION BY k % 3 ORDER BY seq) AS number, seq FROM g0),
pl AS (SELECT seq AS plan, record_id, k FROM n WHERE event_type = 'purchase' AND seq % 16 = 0),
nd AS (SELECT DISTINCT plan, v.k % 3 AS t, 's' || v.k AS surface FROM pl JOIN n v ON v.record_id = pl.record_id AND v.event_type = 'view' UNION ALL SELECT plan, k % 3, x || plan FROM pl, (VALUES ('n'), ('o')) q(x)),
al AS (SELECT nd.plan, nd.t, nd.surface, ['PERSON', 'PLACE', 'ORG'][nd.t + 1] AS entity_type, rg.number AS had, coalesce((SELECT max(number) FROM rg u WHERE u.t = nd.t AND u.seq < nd.plan), 0) AS used FROM nd LEFT JOIN rg ON rg.t = nd.t AND rg.surface = nd.surface AND rg.seq < nd.plan),
nu AS MATERIALIZED (SELECT plan, entity_type, surface, coalesce(had, used + row_number() OVER (PARTITION BY plan, t, had IS NULL ORDER BY left(sha256(entity_type || '|' || surface), 32))) AS number FROM al),
le AS (SELECT plan, min((entity_type, surface)) AS least FROM nu GROUP BY 1)"""
_TEXTS = """t0 AS (SELECT conv_id AS record_id, turn AS idx, coalesce(nullif(trim(regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g')), ''), '-') AS body FROM conversations),
t1 AS (SELECT record_id, idx, body || CASE WHEN record_id % 9 = 8 AND idx = 0 THEN chr(10) || chr(10) || '-' ELSE '' END AS text, row_number() OVER (PARTITION BY record_id ORDER BY idx) - 1 AS cue FROM t0),
pc AS MATERIALIZED (SELECT *, s + length(text) AS e FROM (SELECT *, coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT AS s, (8 + coalesce(sum(length(text) + length(CAST(cue AS VARCHAR)) + 33) OVER w, 0) + length(CAST(cue AS VARCHAR)) + 31)::BIGINT AS d
 FROM t1 WINDOW w AS (PARTITION BY record_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
dc AS (SELECT record_id, sha256('WEBVTT' || chr(10) || chr(10) || string_agg(cue || chr(10) || '00:00:00.000 --> 00:00:01.000' || chr(10) || text || chr(10) || chr(10), '' ORDER BY idx)) AS document_sha256 FROM t1 GROUP BY 1 HAVING record_id % 9 <> 8),
mk AS (SELECT record_id, s + (e - s) // 3 AS mark_start, e + 6 AS mark_end FROM pc WHERE idx % 2 = 0)"""
SQL = {
    "model_suggestions": f"""WITH {_MODEL} SELECT s.r AS record_id, s.idx, '{CODE}' AS code, 'S' || lpad(CAST(row_number() OVER (PARTITION BY s.r ORDER BY s.idx) AS VARCHAR), 3, '0') AS id, s.idx % 4 = 1 AS supplemented
FROM s JOIN o ON o.record_id = s.r AND o.problem IS NULL""",
    "model_outcomes": f"WITH {_MODEL} SELECT * FROM o",
    "model_anchors": f"""WITH {_MODEL}, f AS (SELECT conv_id AS r, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1),
q AS (SELECT conv_id AS r, turn AS idx, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM conversations),
k AS (SELECT q.*, a + length(text) AS b, 'S' || lpad(CAST(row_number() OVER (PARTITION BY r ORDER BY idx) AS VARCHAR), 3, '0') AS id FROM q)
SELECT k.r AS record_id, id, a AS start, b AS "end", sha256({_NORMAL('text')}) AS quote_sha256, sha256({_NORMAL("substr(t, greatest(a - 64, 0) + 1, a - greatest(a - 64, 0)) || chr(0) || substr(t, b + 1, 64)")}) AS context_sha256
FROM k JOIN f USING (r) JOIN o ON o.record_id = k.r AND o.problem IS NULL""",
    "model_evidence": f"""WITH {_MODEL} SELECT r AS record_id, 'original' AS kind, b AS block, f AS finding FROM p, (VALUES ('lost'), ('foreign')) v(f) WHERE b = 0 AND (r % 7 = 2 OR r % 7 = 1 AND f = 'lost')
UNION ALL SELECT r, 'supplement', b, CASE WHEN r % 7 = 3 THEN 'lost' ELSE 'foreign' END FROM p WHERE sup = 1 AND (r % 7 = 3 OR b = 0 AND r % 7 IN (1, 2))""",
    "prepared_plans": f"""WITH {_PLANS} SELECT plan, 'moved' AS finding, NULL AS entity_type, NULL AS surface, h AS expected, h - 1 AS reported FROM (SELECT plan, (SELECT max(seq) FROM rg WHERE rg.seq < plan) AS h FROM pl) WHERE plan % 5 = 4 AND h IS NOT NULL
UNION ALL SELECT plan, 'number', entity_type, surface, number, number + 1 FROM nu JOIN le USING (plan) WHERE plan % 5 = 1 AND (entity_type, surface) = least
UNION ALL SELECT plan, 'lost', entity_type, surface, number, NULL FROM nu JOIN le USING (plan) WHERE plan % 5 = 2 AND (entity_type, surface) = least
UNION ALL SELECT plan, 'extra', 'ORG', 'extra', NULL, 7 FROM pl WHERE plan % 5 = 3""",
    "evidence_chains": f"""WITH {_INPUTS}, c AS (SELECT * FROM n WHERE event_type = 'purchase'), r AS (SELECT record_id, seq AS revision_seq, 'r' || k % 6 AS revision FROM n WHERE event_type = 'view'),
p AS (SELECT record_id, seq AS projection_seq, 'r' || k % 6 AS output, 'l' || k % 5 AS assignment FROM n WHERE event_type = 'click'), l AS (SELECT record_id, seq AS languages_seq, 'l' || k % 5 AS output FROM n WHERE event_type = 'error'),
x AS (SELECT c.record_id, c.seq, revision, revision_seq FROM c ASOF LEFT JOIN r ON c.record_id = r.record_id AND c.seq > r.revision_seq),
y AS (SELECT x.*, projection_seq, assignment FROM x ASOF LEFT JOIN p ON x.record_id = p.record_id AND x.revision = p.output AND x.seq > p.projection_seq)
SELECT y.*, languages_seq, CASE WHEN revision IS NULL THEN 'revision' WHEN projection_seq IS NULL THEN 'projection' WHEN languages_seq IS NULL THEN 'languages' END AS problem FROM y ASOF LEFT JOIN l ON y.record_id = l.record_id AND y.assignment = l.output AND y.seq > l.languages_seq""",
    "marked_cues": f"""WITH {_TEXTS}, j AS (SELECT m.*, p.cue, p.text, p.d, p.s, greatest(mark_start, s) AS text_start, least(mark_end, e) AS text_end FROM mk m JOIN pc p ON p.record_id = m.record_id AND mark_start < e AND mark_end > s)
SELECT j.record_id, mark_start, mark_end, cue, text_start - s AS start, text_end - s AS "end", d + text_start - s AS doc_start, d + text_end - s AS doc_end, text_start, text_end, document_sha256, sha256(text) AS input_sha256 FROM j JOIN dc USING (record_id)""",
}
