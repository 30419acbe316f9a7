"""What acts append to the journal, the checks before they may, and the reports after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import REFERENCE, SHA256, decision_id, sha256, zoned_time
from annalist.operators.planning import base

#: Fields of the specialised receipts, sources and decisions.
KEYS = {
    "source.text": "bytes filename media_type record_id sha256",
    "receipt.separate_input": "artifact code_version fulltext_origin fulltext_source_receipt inputs kind output_sha256 reference",
    "receipt.segment_projection": "artifact code_version fulltext_origin inputs kind output_sha256",
    "receipt.segment_languages": "actor artifact code_version inputs iso6393_release iso6393_snapshot_receipt iso6393_vocabulary_sha256 kind output_sha256 reference target_record_id",
}
#: Fields of a released record.
RELEASE = ("record_id", "interview_date", "interviewer", "consent_status", "accessRights", "title", "language")
#: Verdicts, and those that need no authority to be told.
VERDICTS = ("ACCEPT", "REJECT", "WITHDRAW", "UNDO")


def key_differences(variant: Column, payload: Column) -> Column:
    """struct(missing, foreign) of a JSON payload's keys against those of its variant; nulls for an unknown variant."""
    want = F.coalesce(*[F.when(variant == v, F.split(F.lit(k), " ")) for v, k in KEYS.items()])
    have = F.json_object_keys(payload)
    return F.struct(F.array_sort(F.array_except(want, have)).alias("missing"), F.array_sort(F.array_except(have, want)).alias("foreign"))


def decision_problem(negative_only: Column) -> Column:
    """The first bad field of a decision (artifact, subject_sha256, verdict, reference, actor, at); null if none. A legacy
    artifact takes negative verdicts only."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(text("artifact"), "artifact").when(~F.coalesce(F.col("subject_sha256").rlike(SHA256), F.lit(False)), "subject").when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "verdict")
        .when(~F.coalesce(F.col("reference").rlike(REFERENCE), F.lit(False)), "reference").when(text("actor"), "actor").when(zoned_time(F.col("at")).isNull(), "time").when(negative_only & (F.col("verdict") == "ACCEPT"), "negative")
    )


def key_gate(prefix: str, digits: int, kinds: list[str]) -> Column:
    """Why an artifact's key (current_id, scope, scope_id, kind) may not be written; null if it may. In this order: the
    context's id, the scope, the key's id, their equality, the kind."""
    canonical = lambda c: F.coalesce(F.col(c).rlike(rf"^{prefix}-[0-9]{{{digits}}}\z"), F.lit(False))
    return (
        F.when(~canonical("current_id"), "INVALID_CURRENT_RECORD_ID").when(F.coalesce(F.col("scope"), F.lit("")) != "record", "WORKSPACE_IDENTITY_UNAVAILABLE").when(~canonical("scope_id"), "INVALID_SCOPE_ID")
        .when(F.col("scope_id") != F.col("current_id"), "SCOPE_ID_CONTEXT_MISMATCH").when(~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "KIND_NOT_IN_ACTIVE_GRAPH")
    )


def derivation(artifacts: DataFrame, last: DataFrame, gate: bool = False) -> DataFrame:
    """record_id, artifact, kind, sha256 of what a derivation appends: artifact.produced, anchor.checked if it is bound, and
    receipt.recorded, and for a ``gate`` decision.recorded too; nothing that is current already.

    Artifacts: record_id, artifact, sha256, bind; last: record_id, artifact, kind, sha256 of the latest event of each kind.
    """
    decision = [F.lit("decision.recorded")] if gate else []
    kinds = F.array(F.lit("artifact.produced"), *decision, F.when(F.col("bind"), F.lit("anchor.checked")), F.lit("receipt.recorded"))
    rows = artifacts.select("record_id", "artifact", "sha256", F.explode(F.array_compact(kinds)).alias("kind"))
    j = rows.join(last.select("record_id", "artifact", "kind", F.col("sha256").alias("now")), ["record_id", "artifact", "kind"], "left")
    return j.where(F.when(F.col("kind") == "anchor.checked", F.col("now").isNull()).otherwise(~F.col("now").eqNullSafe(F.col("sha256")))).select("record_id", "artifact", "kind", "sha256")


def differences(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Rows (with ``side``: stored or again) that a package has and its recomputation hasn't, or the other way round, repeated
    rows counted; none: the package is verified."""
    again = again.select(stored.columns)
    return stored.exceptAll(again).withColumn("side", F.lit("stored")).unionByName(again.exceptAll(stored).withColumn("side", F.lit("again")))


def moved_inputs(planned: DataFrame, current: DataFrame) -> DataFrame:
    """record_id, artifact, planned, now: inputs of a plan that are others by now, or not usable any more (null)."""
    j = planned.select("record_id", "artifact", F.col("sha256").alias("planned")).join(current.select("record_id", "artifact", F.col("sha256").alias("now")), ["record_id", "artifact"], "left")
    return j.where(~F.col("planned").eqNullSafe(F.col("now")))


def resolve_human(requests: DataFrame, instances: DataFrame) -> DataFrame:
    """request, actor, problem: the named active human, or the only one; unknown, machine (a model's instance), none or many.

    Requests: request, name (null: not named); instances: coder_id, source (human or model), active.
    """
    humans = instances.where(F.col("active") & (F.col("source") == "human"))
    only = humans.agg(F.count("*").alias("n"), F.min("coder_id").alias("one"))
    j = requests.join(instances.withColumnRenamed("coder_id", "name"), "name", "left").crossJoin(F.broadcast(only))
    named = F.when(F.col("source") == "model", "machine").when(F.col("source").isNull() | ~F.col("active"), "unknown")
    problem = F.when(F.col("name").isNotNull(), named).when(F.col("n") == 0, "none").when(F.col("n") > 1, "many")
    return j.select("request", F.when(problem.isNull(), F.coalesce("name", "one")).alias("actor"), problem.alias("problem"))


def authority(keyed: Column) -> Column:
    """What a journal may confer: all three only if its chain is keyed."""
    yes = F.coalesce(keyed, F.lit(False))
    return F.struct(yes.alias("may_confer_ready"), yes.alias("may_confer_ownership"), yes.alias("may_confer_exclusion"))


def release_digest() -> Column:
    """Digest of exactly the released fields, as JSON with keys in order and a line feed; null if one is missing."""
    fields = sorted(RELEASE)
    whole = F.to_json(F.struct(F.lit("annalist.release.fields").alias("domain"), F.struct(*fields).alias("fields"), F.lit(1).alias("version")))
    return F.when(F.forall(F.array(*(F.col(f).isNotNull() for f in fields)), lambda x: x), sha256(F.concat(whole, F.lit("\n"))))


def marker(record: Column, revision: Column, actor: Column, origin: Column, version: int = 2, profile: str | None = None) -> Column:
    """Canonical bytes of a confirmation marker: version 2 names the profile too."""
    fields = {"actor": actor, "domain": F.lit("transcript_confirmation"), "fulltext_origin": origin, "record_id": record, "revision_sha256": revision, "v": F.lit(version)} | ({"profile_id": F.lit(profile)} if version == 2 else {})
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def confirmed_text(gates: DataFrame, decisions: DataFrame, texts: DataFrame) -> DataFrame:
    """record_id, text_sha256, decision_id: texts that a gate's marker, a decision on exactly these bytes and the stored bytes
    agree on. Inner joins on all keys: nothing for a record means that its next step halts.

    Gates: record_id, marker_sha256, text_sha256; decisions: record_id, subject_sha256, verdict, reference, seq (the last one
    counts); texts: address, content.
    """
    last = decisions.groupBy("record_id", "subject_sha256").agg(F.max_by(F.struct("verdict", "reference"), "seq").alias("d")).where("d.verdict = 'ACCEPT'")
    stored = texts.where(F.sha2("content", 256) == F.col("address")).select(F.col("address").alias("text_sha256"))
    j = gates.withColumn("subject_sha256", F.col("marker_sha256")).join(last, ["record_id", "subject_sha256"]).select("record_id", "text_sha256", decision_id(F.col("d.reference"), F.col("subject_sha256")).alias("decision_id"))
    return j.join(stored, "text_sha256", "left_semi")


def repair(stale: Column) -> Column:
    """What to run for a stale or missing artifact: its producing step, or the gate that confirms it."""
    return F.coalesce(*[F.when(stale == a, F.concat(F.lit("decide " if s.gate else "continue "), F.lit(s.name))) for s in base() for a in s.produces], F.lit("look"))


def six_lines(status: Column, reason: Column, changed: Column, touched: Column, upload: Column, next_: Column, check: Column, recovery: Column) -> Column:
    """A report of fixed six lines; what isn't there is a dash."""
    dash = lambda c: F.coalesce(c, F.lit("—"))
    safe = F.concat(F.when(touched, "Source data changed").otherwise("Source data unchanged"), F.lit("; Upload "), F.when(upload, "yes").otherwise("no"))
    return F.concat_ws("\n", F.concat(F.lit("STATUS : "), status, F.coalesce(F.concat(F.lit("  — "), reason), F.lit(""))), F.concat(F.lit("CHANGED: "), F.when(F.size(changed) > 0, F.array_join(changed, ", ")).otherwise("none")),
                       F.concat(F.lit("SAFE   : "), safe), F.concat(F.lit("NEXT   : "), dash(next_)), F.concat(F.lit("CHECK  : "), dash(check)), F.concat(F.lit("RECOVERY: "), dash(recovery)))


def human_history(events: DataFrame, *keys: str) -> DataFrame:
    """keys, events, sha256 of the ordered digests of all events of humans' instances (seq, digest), by ``keys``: what a
    confirmation was made under. The events of a key are one text."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "digest")))
    return events.groupBy(*keys).agg(F.count("*").alias("events"), sha256(F.array_join(F.transform(listed, lambda x: x["digest"]), "\n")).alias("sha256"))
