"""Queries over documents: mentions, pseudonyms, content addresses, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions.text import hmac_sha256, sha256, text_digest
from annalist.operators import anchors, mentions
from annalist.sources.tables import read


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def content_dedupe(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.groupBy(sha256(F.col("text")).alias("address")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def dangling_refs(spark, sf_dir):
    """Labels name documents by id; those whose content the deduplicated store holds under another document."""
    kept = content_dedupe(spark, sf_dir).select(F.col("first_doc").alias("doc_id"))
    return read(spark, sf_dir, "labels").select("doc_id").distinct().join(kept, "doc_id", "left_anti")


def normalised_digests(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text_digest(F.col("text")).alias("text_sha256"), hmac_sha256(b"fixture-key", F.col("text")).alias("token"))


def pii_spans(spark, sf_dir):
    return mentions.recognise(_docs(spark, sf_dir))


def merge_spans(spark, sf_dir):
    return mentions.merge(pii_spans(spark, sf_dir))


def overlap_refusal(spark, sf_dir):
    return mentions.overlaps(merge_spans(spark, sf_dir))


def _found(spark, sf_dir):
    return mentions.mentions(_docs(spark, sf_dir), mentions.settled(merge_spans(spark, sf_dir)))


def mention_ids(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", "start", "end", "entity_type", "mention_id")


#: Fixture convention: mail addresses and phone numbers become pseudonyms, other numbers one word.
POLICY = {"IDENTIFIER": ("coarsen", "[number]")}
KEY, REGISTRY = b"fixture-key", "registry-1"


def register(spark, sf_dir):
    return mentions.allocate(_found(spark, sf_dir))


def register_extended(spark, sf_dir):
    """The register of even documents, extended by those of all."""
    found = _found(spark, sf_dir)
    return mentions.allocate(found, mentions.allocate(found.where("doc_id % 2 = 0")))


def register_check(spark, sf_dir):
    """A register in which every seventh label is that of the number before, every eleventh number is 0, and counters one too low."""
    r = register(spark, sf_dir)
    n = F.col("number")
    bad = r.withColumn("pseudonym", F.when(n % 7 == 0, mentions.pseudonym(F.col("entity_type"), n - 1)).otherwise(F.col("pseudonym"))).withColumn("number", F.when(n % 11 == 0, F.lit(0)).otherwise(n).cast("long"))
    return mentions.register_findings(bad, r.groupBy("entity_type").agg(F.max("number").alias("counter")))


def alias_candidates(spark, sf_dir):
    """Surfaces are entered as they are and in upper case: two entities of one token."""
    r = register(spark, sf_dir)
    up = r.withColumn("surface", F.upper("surface")).withColumn("entity_id", mentions.entity_id(F.col("entity_type"), F.col("surface")))
    return mentions.candidates(r.unionByName(up), KEY, REGISTRY).select("token", F.array_join("entities", ",").alias("entities"))


def _report(spark, sf_dir):
    found = _found(spark, sf_dir)
    return mentions.entries(found, mentions.allocate(found), POLICY)


def render_report(spark, sf_dir):
    return _report(spark, sf_dir)


def pseudonymise(spark, sf_dir):
    return mentions.render(_docs(spark, sf_dir), _report(spark, sf_dir)).select("doc_id", "replaced", F.length("rendered").cast("long").alias("chars"), sha256(F.col("rendered")).alias("sha256"))


def replacement_sums(spark, sf_dir):
    return _report(spark, sf_dir).groupBy("entity_type", "action").agg(F.count("*").alias("n"), F.countDistinct("value").alias("entities"))


def provisional_labels(spark, sf_dir):
    return mentions.provisional(_found(spark, sf_dir))


def case_counts(spark, sf_dir):
    """Fixture convention: entities by document are cases, their state goes by the id's first digit; mentions by start
    modulo 7 are excluded (0) or added (1)."""
    f = _found(spark, sf_dir).withColumn("entity_id", mentions.entity_id(F.col("entity_type"), F.col("surface")))
    state = F.element_at(F.array(*map(F.lit, ("OPEN", "RESOLVED", "DEFERRED"))), (F.conv(F.left("entity_id", F.lit(1)), 16, 10).cast("int") % 3 + 1).cast("int"))
    groups = f.select("doc_id", "entity_id").distinct().select("doc_id", state.alias("state"))
    m = F.col("start") % 7
    return mentions.case_counts(groups, f.where(m < 2).select("doc_id", F.when(m == 0, F.col("mention_id")).alias("old"), F.when(m == 1, F.col("mention_id")).alias("new")))


def span_binding(spark, sf_dir):
    """Spans as code points or bytes, of which some name another document, cue or payload, or cut a character."""
    d = _docs(spark, sf_dir).where(F.col("text").isNotNull())
    cues = d.select(sha256(F.col("text")).alias("doc_sha256"), F.lit(0).alias("cue_index"), F.left("text", F.lit(200)).alias("payload")).distinct()
    i = F.col("doc_id")
    spans = d.select("doc_id", F.when(i % 11 == 0, "x").otherwise(sha256(F.col("text"))).alias("document_sha256"), F.when(i % 13 == 0, 5).otherwise(0).alias("cue_index"), F.when(i % 2 == 0, "codepoint").otherwise("byte").alias("unit"),
                     (i % 40).alias("start"), (i % 40 + i % 90).alias("end"), F.when(i % 17 == 0, "x").otherwise(sha256(F.left("text", F.lit(200)))).alias("input_sha256"))
    return mentions.bind(spans, cues).select("doc_id", "start", "end", "problem")


def reanchor_outcome(spark, sf_dir):
    """Anchors over code points 10 to 40 of every text, in a revision with its first word twice and its last 50 characters gone."""
    d = _docs(spark, sf_dir).where(F.length("text") >= 40)
    new = F.concat(F.substring_index("text", " ", 1), F.lit(" "), F.expr("left(text, length(text) - 50)"))
    return d.withColumn("new", new).select("doc_id", anchors.reanchored(F.col("text"), F.lit(10), F.lit(40), F.col("new")).alias("r")).select("doc_id", "r.outcome", "r.new_start")


QUERIES = {f.__name__: f for f in (content_dedupe, dangling_refs, normalised_digests, pii_spans, merge_spans, overlap_refusal, mention_ids, register, register_extended, register_check, alias_candidates, render_report, pseudonymise, replacement_sums, provisional_labels, case_counts, span_binding, reanchor_outcome)}

_VALUES = ", ".join(f"('{n}', '{k}', '{p}')" for n, k, p in mentions.PATTERNS)
_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, '{k}' AS entity_type, '{n}' AS recogniser, unnest(regexp_extract_all(text, '{p}')) AS hit,
unnest(range(len(regexp_extract_all(text, '{p}')))) AS k, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits FROM documents WHERE regexp_matches(text, '{p}')""" for n, k, p in mentions.PATTERNS)
_LABEL = "entity_type || '-' || CASE WHEN {0} > 999 THEN CAST({0} AS VARCHAR) ELSE lpad(CAST({0} AS VARCHAR), 3, '0') END"
_MERGED = f"""raw AS ({_SPANS}),
spans AS (SELECT doc_id, b AS "start", b + length(hit) AS "end", entity_type, recogniser FROM (
  SELECT *, (length(array_to_string(gaps[1:k+1], '')) + length(array_to_string(hits[1:k], '')))::BIGINT AS b FROM raw)),
merged AS (SELECT doc_id, "start", "end", entity_type, string_agg(DISTINCT recogniser, ',' ORDER BY recogniser) AS recognisers FROM spans GROUP BY ALL),
nx AS (SELECT doc_id, "start", "end", lead("start") OVER w AS next_start, lead("end") OVER w AS next_end FROM merged WINDOW w AS (PARTITION BY doc_id ORDER BY "start", "end", entity_type)),
clash AS (SELECT * FROM nx WHERE next_start < "end"),
found AS (SELECT m.doc_id, "start", "end", entity_type, substr(text, ("start" + 1)::INT, ("end" - "start")::INT) AS surface,
  'MEN-' || left(sha256('annalist:mention:v1|' || sha256(text) || '|0|' || "start" || '|' || "end" || '|' || entity_type), 24) AS mention_id
  FROM merged m JOIN documents d USING (doc_id) WHERE m.doc_id NOT IN (SELECT doc_id FROM clash)),
ents AS (SELECT entity_type, surface, left(sha256(entity_type || '|' || surface), 32) AS entity_id, bool_or(doc_id % 2 = 0) AS even FROM found GROUP BY 1, 2),
nums AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY entity_id) AS number, row_number() OVER (PARTITION BY entity_type ORDER BY NOT even, entity_id) AS later FROM ents),
reg AS (SELECT entity_id, entity_type, surface, number, {_LABEL.format('number')} AS pseudonym FROM nums),
ent AS (SELECT f.*, CASE entity_type WHEN 'IDENTIFIER' THEN 'coarsen' ELSE 'pseudonym' END AS action, CASE entity_type WHEN 'IDENTIFIER' THEN '[number]' ELSE pseudonym END AS value FROM found f JOIN reg USING (entity_type, surface)),
rep AS (SELECT *, ("start" + coalesce(sum(length(value) - ("end" - "start")) OVER (PARTITION BY doc_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS result_start FROM ent)"""
def _normal(text: str) -> str:
    """SQL of a text's normalised form."""
    lines = rf"list_transform(string_split(regexp_replace({text}, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[\s\p{{Z}}\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}]+$', ''))"
    return f"(rtrim(array_to_string({lines}, chr(10)), chr(10)) || chr(10))"


def _around(text: str, at: str) -> str:
    """SQL of the digest of a quote's context (30 code points from ``at``)."""
    return "sha256(" + _normal(f"(substr({text}, greatest({at} - 64, 0) + 1, {at} - greatest({at} - 64, 0)) || chr(0) || substr({text}, {at} + 31, 64))") + ")"


def _blob(data: bytes) -> str:
    return f"from_hex('{data.hex()}')"


_BLOCK = b"fixture-key".ljust(64, b"\0")
SQL = {
    "normalised_digests": f"""SELECT doc_id, sha256({_normal('text')}) AS text_sha256,
sha256({_blob(bytes(b ^ 0x5C for b in _BLOCK))} || from_hex(sha256({_blob(bytes(b ^ 0x36 for b in _BLOCK))} || encode(text)))) AS token FROM documents""",
    "reanchor_outcome": f"""WITH d AS (SELECT doc_id, text AS o, substr(text, 11, 30) AS q, string_split(text, ' ')[1] || ' ' || left(text, greatest(length(text) - 50, 0)::INT) AS n FROM documents WHERE length(text) >= 40),
p AS (SELECT *, list_filter(range(0, greatest(length(n) - 29, 0)), lambda i: substr(n, i + 1, 30) = q) AS places FROM d),
c AS (SELECT *, list_filter(places, lambda i: {_around('n', 'i')} = {_around('o', '10')}) AS alike, o = n OR (substr(n, 11, 30) = q AND length(n) >= 40) AS exact FROM p)
SELECT doc_id, CASE WHEN exact THEN 'exact' WHEN len(places) = 0 THEN 'missing' WHEN len(places) = 1 OR len(alike) = 1 THEN 'unique_move' ELSE 'ambiguous' END AS outcome,
CASE WHEN exact THEN 10 WHEN len(places) = 1 THEN places[1] WHEN len(alike) = 1 THEN alike[1] END::BIGINT AS new_start FROM c""",
    "content_dedupe": "SELECT sha256(text) AS address, min(doc_id) AS first_doc, count(*)::BIGINT AS copies FROM documents GROUP BY 1",
    "dangling_refs": "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))",
    "pii_spans": f"WITH {_MERGED} SELECT * FROM spans",
    "merge_spans": f"WITH {_MERGED} SELECT * FROM merged",
    "overlap_refusal": f"WITH {_MERGED} SELECT * FROM clash",
    "mention_ids": f"WITH {_MERGED} SELECT doc_id, \"start\", \"end\", entity_type, mention_id FROM found",
    "register": f"WITH {_MERGED} SELECT * FROM reg",
    "register_extended": f"WITH {_MERGED} SELECT entity_id, entity_type, surface, later AS number, {_LABEL.format('later')} AS pseudonym FROM nums",
    "register_check": f"""WITH {_MERGED}, b AS (SELECT entity_type, CASE WHEN number % 11 = 0 THEN 0 ELSE number END AS number, number AS n, CASE WHEN number % 7 = 0 THEN {_LABEL.format('(number - 1)')} ELSE pseudonym END AS pseudonym FROM reg),
x AS (SELECT entity_type, CASE WHEN number < 1 THEN 'number' WHEN n % 7 = 0 THEN 'form' END AS finding FROM b WHERE number < 1 OR n % 7 = 0
  UNION ALL SELECT entity_type, 'label' FROM (SELECT entity_type, pseudonym FROM b GROUP BY 1, 2 HAVING count(*) > 1)
  UNION ALL SELECT entity_type, 'counter' FROM (SELECT entity_type, max(number) + 1 <> max(n) AS off FROM b GROUP BY 1) WHERE off) SELECT entity_type, finding, count(*)::BIGINT AS n FROM x GROUP BY 1, 2""",
    "alias_candidates": f"""WITH {_MERGED}, a AS (SELECT entity_type, surface FROM reg UNION ALL SELECT entity_type, upper(surface) FROM reg),
t AS (SELECT left(sha256(entity_type || '|' || surface), 32) AS e, '["annalist:candidate:v1","{REGISTRY}","' || entity_type || '","' || lower(surface) || '"]' AS m FROM a)
SELECT sha256({_blob(bytes(b ^ 0x5C for b in _BLOCK))} || from_hex(sha256({_blob(bytes(b ^ 0x36 for b in _BLOCK))} || encode(m)))) AS token, string_agg(DISTINCT e, ',' ORDER BY e) AS entities FROM t GROUP BY 1""",
    "render_report": f"""WITH {_MERGED} SELECT doc_id, mention_id, entity_type, "start", "end", result_start, result_start + length(value) AS result_end, action, value FROM rep""",
    "provisional_labels": f"""WITH {_MERGED}, l AS (SELECT doc_id, mention_id, entity_type, dense_rank() OVER (PARTITION BY doc_id, entity_type ORDER BY left(sha256(entity_type || '|' || surface), 32)) AS n FROM found)
SELECT doc_id, mention_id, {_LABEL.format('n')} || '?' AS label FROM l""",
    "case_counts": f"""WITH {_MERGED}, g AS (SELECT DISTINCT doc_id, left(sha256(entity_type || '|' || surface), 32) AS e FROM found),
s AS (SELECT doc_id, CAST('0x' || left(e, 1) AS INT) % 3 AS k FROM g), o AS (SELECT doc_id, count(*) FILTER ("start" % 7 = 0) AS excluded, count(*) FILTER ("start" % 7 = 1) AS added FROM found GROUP BY 1)
SELECT doc_id, count(*)::BIGINT AS total, count(*) FILTER (k > 0)::BIGINT AS worked, count(*) FILTER (k <> 1)::BIGINT AS open, any_value(excluded)::BIGINT AS excluded, any_value(added)::BIGINT AS added FROM s JOIN o USING (doc_id) GROUP BY 1""",
    "span_binding": """WITH d AS (SELECT doc_id, text, left(text, 200) AS p, doc_id % 40 AS s, doc_id % 40 + doc_id % 90 AS e, doc_id % 2 = 1 AS bytes FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, list_transform(range(0, length(p) + 1), lambda i: strlen(left(p, i::INT))) AS cuts FROM d),
x AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'revision' WHEN doc_id % 13 = 0 THEN 'cue' WHEN doc_id % 17 = 0 THEN 'payload' WHEN e > CASE WHEN bytes THEN strlen(p) ELSE length(p) END THEN 'range'
  WHEN bytes AND (NOT list_contains(cuts, s) OR NOT list_contains(cuts, e)) THEN 'boundary' END AS problem FROM c)
SELECT doc_id, CASE WHEN problem IS NULL THEN CASE WHEN bytes THEN list_position(cuts, s) - 1 ELSE s END END::BIGINT AS "start", CASE WHEN problem IS NULL THEN CASE WHEN bytes THEN list_position(cuts, e) - 1 ELSE e END END::BIGINT AS "end", problem FROM x""",
    "replacement_sums": f"WITH {_MERGED} SELECT entity_type, action, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS entities FROM rep GROUP BY 1, 2",
    "pseudonymise": f"""WITH {_MERGED},
pc AS (SELECT doc_id, "start", "end", value AS pseudonym, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY "start" DESC) = 1 AS last FROM rep),
rd AS (SELECT doc_id, count(*)::BIGINT AS replaced, string_agg(substr(text, (p + 1)::INT, ("start" - p)::INT) || pseudonym || CASE WHEN last THEN substr(text, ("end" + 1)::INT) ELSE '' END, '' ORDER BY "start") AS r FROM pc JOIN documents USING (doc_id) GROUP BY 1)
SELECT doc_id, replaced, length(r)::BIGINT AS chars, sha256(r) AS sha256 FROM rd""",
}
