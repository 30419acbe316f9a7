"""Detected spans: recognise, bind, merge, refuse overlaps, number and replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import casefold, codepoint_offset, hmac_sha256, let, mention_id, sha256

#: Recognisers: name, entity type, pattern.
PATTERNS = [
    ("mail", "CONTACT", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]"),
    ("mail-host", "CONTACT", r"[A-Za-z0-9_%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+"),
    ("phone", "CONTACT", r"\+[0-9][0-9 ()-]{6,}[0-9]"),
    ("number", "IDENTIFIER", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
]


#: A sign that every hit of a recogniser holds: looking for it is much faster than trying the pattern everywhere.
SIGNS = {"mail": "@", "mail-host": "@", "phone": "+", "number": "-"}


def recognise(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, entity_type, recogniser: half-open code point ranges, left to right without overlap.

    A text without any sign that a pattern needs never meets the regular expression engine's match list. Offsets
    come from cutting the text at its matches: the running lengths of what is before.
    """
    def found(name: str, kind: str, pattern: str):
        text, none = F.col("text"), F.array().cast("array<struct<start:bigint,end:bigint,entity_type:string,recogniser:string>>")
        length = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))

        def spans(x):
            def span(hit, k):
                start = (length(x["gaps"], k + 1) + length(x["hits"], k)).cast("long")
                return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), F.lit(kind).alias("entity_type"), F.lit(name).alias("recogniser"))

            return F.transform(x["hits"], span)

        both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
        return F.when(text.contains(SIGNS[name]) & text.rlike(pattern), let(both, spans)).otherwise(none)

    return docs.select("doc_id", F.explode(F.concat(*(found(*p) for p in PATTERNS))).alias("s")).select("doc_id", "s.*")


def merge(spans: DataFrame) -> DataFrame:
    """Identical spans as one, with the sorted names of all their recognisers."""
    return spans.groupBy("doc_id", "start", "end", "entity_type").agg(F.array_join(F.array_sort(F.collect_set("recogniser")), ",").alias("recognisers"))


def overlaps(merged: DataFrame) -> DataFrame:
    """Pairs of neighbours that overlap (touching is allowed): doc_id, start, end, next_start, next_end."""
    order = W.partitionBy("doc_id").orderBy("start", "end", "entity_type")
    n = merged.select("doc_id", "start", "end", F.lead("start").over(order).alias("next_start"), F.lead("end").over(order).alias("next_end"))
    return n.where(F.col("next_start") < F.col("end"))


def settled(merged: DataFrame) -> DataFrame:
    """Merged spans of documents in which none overlap: one sort by document, no second look at the spans."""
    order = W.partitionBy("doc_id").orderBy("start", "end", "entity_type")
    n = merged.withColumn("__next", F.lead("start").over(order))
    clash = F.bool_or(F.coalesce(F.col("__next") < F.col("end"), F.lit(False))).over(W.partitionBy("doc_id"))
    return n.withColumn("__clash", clash).where(~F.col("__clash")).drop("__next", "__clash")


def mentions(docs: DataFrame, merged: DataFrame) -> DataFrame:
    """doc_id, start, end, entity_type, surface, mention_id; the document is named by its digest, as cue 0."""
    d = docs.select("doc_id", "text", sha256(F.col("text")).alias("sha"))
    j = merged.join(d, "doc_id")
    return j.select("doc_id", "start", "end", "entity_type", F.expr("substring(text, int(start) + 1, int(end - start))").alias("surface"), mention_id(F.col("sha"), F.lit(0), F.col("start"), F.col("end"), F.col("entity_type")).alias("mention_id"))


def entity_id(kind: Column, surface: Column) -> Column:
    """An opaque name of an entity: hex digits of a digest, so that ids are spread evenly."""
    return F.left(sha256(F.concat_ws("|", kind, surface)), F.lit(32))


def numbered(entities: DataFrame) -> DataFrame:
    """``entities`` (entity_type, entity_id) with ``number``: from 1 by type, in the order of ids.

    Ids begin evenly, so their first three hex digits deal a type to 4096 groups; only the groups' sizes are summed up
    in one place, and each group is numbered by itself.
    """
    e = entities.withColumn("head", F.left("entity_id", F.lit(3)))
    sizes = e.groupBy("entity_type", "head").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("entity_type").orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("entity_type", "head").orderBy("entity_id"))
    return e.join(sizes.withColumn("before", before).drop("n"), ["entity_type", "head"]).withColumn("number", (F.col("before") + within).cast("long")).drop("head", "before")


def pseudonym(kind: Column, number: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(kind, F.lit("-"), F.when(number > 999, number.cast("string")).otherwise(F.lpad(number.cast("string"), 3, "0"))))


def allocate(found: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """entity_id, entity_type, surface, number, pseudonym: the register with all surfaces of ``found`` in it.

    Entities of ``register`` keep their numbers; others get the next ones of their type, in the order of ids.
    """
    seen = found.select("entity_type", "surface").distinct().withColumn("entity_id", entity_id(F.col("entity_type"), F.col("surface")))
    if register is None:
        fresh, kept = numbered(seen), None
    else:
        used = register.groupBy("entity_type").agg(F.max("number").alias("used"))
        fresh = numbered(seen.join(register.select("entity_id"), "entity_id", "left_anti")).join(F.broadcast(used), "entity_type", "left")
        fresh, kept = fresh.withColumn("number", F.col("number") + F.coalesce("used", F.lit(0))), register
    out = fresh.select("entity_id", "entity_type", "surface", "number", pseudonym(F.col("entity_type"), F.col("number")).alias("pseudonym"))
    return out if kept is None else kept.select(out.columns).unionByName(out)


def register_findings(register: DataFrame, counters: DataFrame) -> DataFrame:
    """entity_type, finding, n: label (two entities share one), form (a label isn't that of its number), number (none above
    0), counter (not the highest number plus one, or of a type without numbers)."""
    row = F.when(F.col("number") < 1, "number").when(~F.col("pseudonym").eqNullSafe(pseudonym(F.col("entity_type"), F.col("number"))), "form")
    bad = register.select("entity_type", row.alias("finding")).where(F.col("finding").isNotNull())
    twice = register.where(F.col("pseudonym").isNotNull()).groupBy("entity_type", "pseudonym").agg(F.count("*").alias("k")).where("k > 1").select("entity_type", F.lit("label").alias("finding"))
    top = register.groupBy("entity_type").agg(F.max("number").alias("top"))
    off = counters.join(top, "entity_type", "full_outer").where(~F.col("counter").eqNullSafe(F.col("top") + 1)).select("entity_type", F.lit("counter").alias("finding"))
    return bad.unionByName(twice).unionByName(off).groupBy("entity_type", "finding").agg(F.count("*").alias("n"))


def candidates(register: DataFrame, key: bytes, registry: str) -> DataFrame:
    """token, entities (sorted ids): which entities a surface may be, by the keyed digest of its type and folded form."""
    token = alias_token(key, registry, F.col("entity_type"), F.col("surface"))
    return register.select(token.alias("token"), "entity_id").groupBy("token").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))


def alias_token(key: bytes, registry: str, kind: Column, surface: Column) -> Column:
    name = F.to_json(F.array(F.lit("annalist:candidate:v1"), F.lit(registry), kind, casefold(surface)))
    return hmac_sha256(key, name)


#: What becomes of a mention, by type: keep, remove, coarsen (to the value) or pseudonym.
Policy = dict[str, tuple[str, str | None]]


def entries(found: DataFrame, register: DataFrame, policy: Policy) -> DataFrame:
    """doc_id, mention_id, entity_type, start, end, result_start, result_end, action, value: the report of a rendering.

    Offsets in the result are those in the source moved by what all earlier values of the document added or took.
    Types without a rule are pseudonyms.
    """
    j = found.join(register.select("entity_type", "surface", "pseudonym"), ["entity_type", "surface"])
    of = lambda k, last: F.coalesce(*[F.when(F.col("entity_type") == t, F.lit(r[k])) for t, r in policy.items()], last)
    action = of(0, F.lit("pseudonym"))
    value = F.when(F.col("action") == "keep", F.col("surface")).when(F.col("action") == "remove", "").when(F.col("action") == "coarsen", of(1, F.lit(None).cast("string"))).otherwise(F.col("pseudonym"))
    j = j.withColumn("action", action).withColumn("value", value)
    before = W.partitionBy("doc_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("value") - (F.col("end") - F.col("start"))).over(before), F.lit(0))
    j = j.withColumn("result_start", (F.col("start") + moved).cast("long"))
    return j.select("doc_id", "mention_id", "entity_type", "start", "end", "result_start", (F.col("result_start") + F.length("value")).cast("long").alias("result_end"), "action", "value")


def provisional(found: DataFrame) -> DataFrame:
    """doc_id, mention_id, label: labels of a document's entities before any is confirmed, by type in the order of ids."""
    e = found.withColumn("entity_id", entity_id(F.col("entity_type"), F.col("surface")))
    n = F.dense_rank().over(W.partitionBy("doc_id", "entity_type").orderBy("entity_id"))
    return e.select("doc_id", "mention_id", F.concat(pseudonym(F.col("entity_type"), n), F.lit("?")).alias("label"))


def case_counts(groups: DataFrame, overlay: DataFrame) -> DataFrame:
    """doc_id, total, worked, open, excluded, added. Groups: doc_id, state (OPEN, RESOLVED, DEFERRED); overlay: doc_id, old,
    new (null: none). Deferred cases are worked on, and still open."""
    g = groups.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("state") != "OPEN").alias("worked"), F.count_if(F.col("state") != "RESOLVED").alias("open"))
    o = overlay.groupBy("doc_id").agg(F.count_if(F.col("old").isNotNull() & F.col("new").isNull()).alias("excluded"), F.count_if(F.col("old").isNull()).alias("added"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g.join(o, "doc_id", "left").select("doc_id", "total", "worked", "open", none("excluded"), none("added"))


def regroup(groups: DataFrame, merged: DataFrame, split: DataFrame, excluded: DataFrame) -> DataFrame:
    """group_id, mention_id after a session's acts: groups merged into others, mentions split off into groups of their own,
    mentions excluded. Groups: group_id, mention_id; merged: group_id, into; split and excluded: mention_id (and group_id)."""
    g = groups.join(merged, "group_id", "left").select(F.coalesce("into", "group_id").alias("group_id"), "mention_id")
    g = g.join(split.select("mention_id", F.col("group_id").alias("own")), "mention_id", "left").select(F.coalesce("own", "group_id").alias("group_id"), "mention_id")
    return g.join(excluded.select("mention_id"), "mention_id", "left_anti").select("group_id", "mention_id")


def bind(spans: DataFrame, cues: DataFrame) -> DataFrame:
    """``spans`` with ``start`` and ``end`` in code points and ``problem``: revision, cue, payload, boundary or range.

    A span (document_sha256, cue_index, unit, start, end, input_sha256) holds only for exactly the document and the
    cue's payload that it names; offsets in bytes must lie between characters. Cues: doc_sha256, cue_index, payload; the
    first rule that is broken is the problem.
    """
    documents = cues.select(F.col("doc_sha256").alias("document_sha256")).distinct().withColumn("known", F.lit(True))
    c = cues.select(F.col("doc_sha256").alias("document_sha256"), "cue_index", "payload")
    j = spans.join(documents, "document_sha256", "left").join(c, ["document_sha256", "cue_index"], "left")
    place = lambda n: F.when(F.col("unit") == "codepoint", F.col(n)).otherwise(codepoint_offset(F.col("payload"), F.col(n).cast("int")))
    size = F.when(F.col("unit") == "codepoint", F.length("payload")).otherwise(F.octet_length("payload"))
    problem = (
        F.when(F.col("known").isNull(), "revision").when(F.col("payload").isNull(), "cue").when(sha256(F.col("payload")) != F.col("input_sha256"), "payload")
        .when((F.col("end") > size) | (F.col("start") > F.col("end")), "range").when(place("start").isNull() | place("end").isNull(), "boundary")
    )
    j = j.withColumn("problem", problem)
    good = F.col("problem").isNull()
    return j.withColumns({"start": F.when(good, place("start")).cast("long"), "end": F.when(good, place("end")).cast("long")}).drop("known", "payload")


def render(docs: DataFrame, report: DataFrame) -> DataFrame:
    """doc_id, rendered, replaced: the texts with the values of a report's entries, left to right."""
    p = report.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("m"))
    j = docs.select("doc_id", "text").join(p, "doc_id")
    pieces = F.expr("transform(m, (x, i) -> concat(substring(text, int(if(i = 0, 0, m[i - 1].end)) + 1, int(x.start - if(i = 0, 0, m[i - 1].end))), x.value))")
    tail = F.expr("substring(text, int(element_at(m, -1).end) + 1)")
    return j.select("doc_id", F.concat(F.array_join(pieces, ""), tail).alias("rendered"), F.size("m").cast("long").alias("replaced"))
