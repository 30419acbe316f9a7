"""Closed contracts: event payloads, metadata records, model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event kind, required keys, optional keys, whether it belongs to a record.
KINDS = [
    ("workspace.initialised", "profile root version", "", False),
    ("record.registered", "record_id profile", "note", True),
    ("source.ingested", "record_id sha256 media_type filename bytes", "cues note", True),
    ("input.observed", "role sha256", "", True),
    ("p4c.init.prepared", "v ref at", "", False),
    ("p4c.initialised", "v ref at", "", False),
    ("p4c.prepared", "v phase operation actor actor_state at basis registry_before registry_after refs marker", "", True),
    ("p4c.completed", "v prepared_sha256", "", True),
    ("p4c.aborted", "v prepared_sha256", "", True),
    ("p4b.policy", "v profile graph sha256", "", True),
    ("p4b.checkpoint", "v ref basis actor actor_state previous", "", True),
    ("p4b.prepared", "v ref plan basis actor actor_state checkpoint at", "", True),
    ("p4b.completed", "v prepared_sha256", "", True),
    ("artifact.produced", "artifact sha256", "disposition harness_era", True),
    ("receipt.recorded", "artifact output_sha256 inputs code_version", "kind step params prompt_sha256 finish_reason authorisation authorisation_subject_sha256 authorised_at started_at", True),
    ("decision.recorded", "artifact subject_sha256 verdict reference actor at", "note record_id input_refs input_refs_version profile_id graph_sha256 undo_of", True),
    ("anchor.checked", "artifact outcome", "note", True),
    ("record.disabled", "artifact subject_sha256 verdict reference actor at", "note record_id", True),
    ("record.adopted", "record_id from to reference", "decision_id artifact_hashes note", True),
    ("operation.intent.recorded", "domain v workspace_id command target_key intent_sha256", "", False),
    ("instance.registered", "coder_id source label reference", "model parametersatz", False),
    ("instance.retired", "coder_id reference", "", False),
    ("iso6393.snapshot.prepared", "release_id source_sha256 vocabulary_sha256 reference raw_store canonical_store", "", False),
]
#: Kinds that claim a state, and keys that could hold plain text.
FORBIDDEN = ["artifact.state", "record.state", "status.set"]
SUSPECT = ["context", "name", "original", "quote", "replacement", "surface", "text", "value"]
#: Property, block, datatype, mandatory, repeatable, allowed values.
PROPERTIES = [
    ("record_id", "A", "string", True, False, ""),
    ("interview_date", "A", "date", True, False, ""),
    ("interviewer", "A", "string", True, False, ""),
    ("consent_status", "A", "string", True, False, ""),
    ("accessRights", "A", "string", True, False, "open|restricted|closed"),
    ("title", "B", "string", True, False, ""),
    ("interviewee_display", "B", "string", False, False, ""),
    ("language", "B", "string", True, False, ""),
    ("spatial", "B", "string", False, False, ""),
    ("keywords", "B", "string", False, True, ""),
    ("abstract", "B", "string", False, False, ""),
    ("timecoded_segments", "C", "object", False, True, ""),
    ("related_materials", "C", "string", False, True, ""),
]


def _named(code: str, keys: Column) -> Column:
    return F.when(F.size(keys) > 0, F.concat(F.lit(code + ":"), F.array_join(F.array_sort(keys), ",")))


def payload_problems(events: DataFrame) -> DataFrame:
    """seq, problem for events (seq, kind, record_id string, payload JSON object); null: the payload keeps its contract.

    The first that applies: ``forbidden``, ``unknown`` (kind), ``json`` (no object, or a key twice), ``plaintext``,
    ``missing``, ``foreign`` (each with the keys in order), ``record`` (none named, one named where none belongs, or
    another than the payload's).
    """
    rules = events.sparkSession.createDataFrame(
        [(k, r.split(), o.split(), n) for k, r, o, n in KINDS], "kind string, required array<string>, optional array<string>, needs_record boolean")
    # the rule table is a constant of this module, so its size is known
    e = events.select("seq", "kind", "record_id", "payload", F.expr("try_parse_json(payload)").alias("v")).join(F.broadcast(rules), "kind", "left")
    keys = F.when(F.expr("schema_of_variant(v)").startswith("OBJECT<"), F.json_object_keys("payload"))
    e = e.withColumn("keys", keys)
    allowed = F.concat("required", "optional")
    extra = F.array_except("keys", allowed)
    own = F.get_json_object("payload", "$.record_id")
    envelope = F.when(F.col("kind").isin(FORBIDDEN), "forbidden").when(F.col("required").isNull(), "unknown").when(F.col("keys").isNull(), "json")
    keyed = F.coalesce(_named("plaintext", F.array_intersect("keys", F.array(*map(F.lit, SUSPECT)))), _named("missing", F.array_except("required", "keys")), _named("foreign", extra))
    record = F.when(F.col("needs_record") == F.coalesce(F.col("record_id") == "", F.lit(True)), "record").when(own != F.col("record_id"), "record")
    return e.select("seq", F.coalesce(envelope, keyed, record).alias("problem"))


def metadata_findings(records: DataFrame, consent: list[str] | None = None) -> DataFrame:
    """record_id, field, finding for records (record_id, fields JSON object); all findings, none if all is well.

    ``missing`` (mandatory, null or blank), ``unknown`` (no such field), ``list`` (a repeatable field that is no list),
    ``type`` (a value of another type; dates are YYYY-MM-DD), ``enum``, ``consent`` (not in the profile's vocabulary;
    ``withdrawn`` always is), ``rights`` (withdrawn, but not closed). Fields that aren't an object: one ``json``.
    """
    spark = records.sparkSession
    tap = spark.createDataFrame(PROPERTIES, "field string, block string, datatype string, mandatory boolean, repeatable boolean, allowed string")
    parsed = records.select("record_id", F.from_json("fields", "map<string,variant>", {"mode": "PERMISSIVE"}).alias("m"), F.expr("schema_of_variant(try_parse_json(fields))").startswith("OBJECT<").alias("good"))
    known = F.array(*[F.lit(p[0]) for p in PROPERTIES])
    good = parsed.where("good").select("record_id", "m")
    names = good.select("record_id", F.explode(F.array_union(F.map_keys("m"), known)).alias("field"), "m")
    cell = names.select("record_id", "field", F.try_element_at("m", F.col("field")).alias("v")).join(F.broadcast(tap), "field", "left")
    kind = F.expr("coalesce(schema_of_variant(v), 'VOID')")
    text = F.expr("try_variant_get(v, '$', 'string')")
    cell = cell.select("record_id", "field", "datatype", "mandatory", "repeatable", "allowed", kind.alias("kind"), text.alias("text"), F.expr("try_variant_get(v, '$', 'array<variant>')").alias("items"), "v")
    blank = (F.col("kind") == "VOID") | ((F.col("kind") == "STRING") & (F.trim("text") == ""))
    fits = lambda k, t: (
        F.when(F.col("datatype") == "object", k.startswith("OBJECT<"))
        .when(F.col("datatype") == "date", (k == "STRING") & t.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(t, "yyyy-MM-dd").isNotNull()).otherwise(k == "STRING"))
    item = lambda x: fits(F.schema_of_variant(x), F.try_variant_get(x, "$", "string"))
    listed = F.col("kind").startswith("ARRAY<")
    typed = F.when(F.col("repeatable"), F.when(~listed, "list").when(~F.forall("items", item), "type")).when(~fits(F.col("kind"), F.col("text")), "type")
    there = F.col("datatype").isNotNull() & (F.col("kind") != "VOID")
    found = F.array(
        F.when(F.coalesce("mandatory", F.lit(False)) & blank, "missing"), F.when(F.col("datatype").isNull(), "unknown"), F.when(there, typed),
        F.when(there & (F.col("allowed") != "") & ~F.array_contains(F.split("allowed", r"\|"), F.col("text")), "enum"),
        F.when((F.col("field") == "consent_status") & there & ~F.col("text").isin([*(consent or []), "withdrawn"]), "consent") if consent else F.lit(None).cast("string"))
    single = cell.select("record_id", "field", F.explode(F.array_compact(found)).alias("finding"))
    value = lambda k: F.try_variant_get(F.try_element_at("m", F.lit(k)), "$", "string")
    rights = good.where((value("consent_status") == "withdrawn") & ~F.coalesce(value("accessRights") == "closed", F.lit(False))).select("record_id", F.lit("accessRights").alias("field"), F.lit("rights").alias("finding"))
    broken = parsed.where(~F.coalesce("good", F.lit(False))).select("record_id", F.lit(None).cast("string").alias("field"), F.lit("json").alias("finding"))
    return single.unionByName(rights).unionByName(broken)


def answer_outcome(answer: Column, expected: Column, codes: list[str] | None = None, partial: bool = False) -> Column:
    """What a model's answer (text) is worth for the expected segments (array<bigint>).

    ``ok``; ``json`` (none, or a key twice), ``results`` (not exactly a list ``results``), ``entry`` (not exactly a whole
    ``segment`` and a ``code`` with text), ``code`` (not allowed), ``incomplete`` (some missing, all else right: may be
    supplemented), ``ids`` (missing, foreign or repeated). ``partial`` takes a true, non-empty subset as ``ok`` and
    nothing else. Null answers are ``json``.
    """
    v = F.try_parse_json(answer)
    rows = F.try_variant_get(v, "$.results", "array<variant>")
    shape = F.schema_of_variant(v)
    exact = shape.startswith("OBJECT<results: ARRAY<") & (F.size(F.json_object_keys(answer)) == 1)
    code, segment = (lambda x: F.try_variant_get(x, "$.code", "string")), (lambda x: F.try_variant_get(x, "$.segment", "bigint"))
    entry = F.forall(rows, lambda x: (F.schema_of_variant(x) == "OBJECT<code: STRING, segment: BIGINT>") & (F.trim(code(x)) != ""))
    allowed = F.forall(rows, lambda x: code(x).rlike(r"^[A-Z][A-Z0-9_]{1,31}\z") & code(x).isin(codes)) if codes is not None else F.lit(True)
    got = F.transform(rows, segment)
    missing, sound = F.size(F.array_except(expected, got)) > 0, (F.size(F.array_except(got, expected)) == 0) & (F.size(F.array_distinct(got)) == F.size(got))
    ids = F.when(sound & missing & (F.size(got) > 0), "ok" if partial else "incomplete").when(~sound | missing, "ids").otherwise("ids" if partial else "ok")
    return F.when(v.isNull(), "json").when(~exact, "results").when(~entry, "entry").when(~allowed, "code").otherwise(ids)
