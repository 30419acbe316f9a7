"""Receipts of derivations and the decisions they appeal to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import REFERENCE, SHA256, decision_id, zoned_time

#: Ends of a model's run that count as clean.
CLEAN = ["stop", "end_turn", "eos", "stop_sequence"]


def truncated(finish_reason: Column) -> Column:
    """Whether a run wasn't ended cleanly; an unknown end counts as cut off."""
    return ~F.coalesce(finish_reason.isin(CLEAN), F.lit(False))


def authorisation_problem(authorisation: Column, subject: Column, authorised_at: Column, started_at: Column) -> Column:
    """reference (no decision id), subject (bytes not named, or others than the id's), time (no time with a zone), early (begun
    before it was authorised); null if all is well."""
    reference, short = F.substring_index(authorisation, "@", 1), F.substring(authorisation, F.instr(authorisation, "@") + 1, F.length(authorisation))
    named = F.coalesce(authorisation.contains("@") & reference.rlike(REFERENCE) & (F.length(short) == 12), F.lit(False))
    allowed, started = zoned_time(authorised_at), zoned_time(started_at)
    return (
        F.when(~named, "reference").when(~F.coalesce(subject.rlike(SHA256) & F.startswith(subject, short), F.lit(False)), "subject")
        .when(allowed.isNull() | started.isNull(), "time").when(started < allowed, "early")
    )


def receipt_problem(must_be_model: Column) -> Column:
    """The first rule that a receipt (columns output_sha256, inputs, code_version, kind, model, authorisation, subject,
    authorised_at, started_at, finish_reason) breaks; null if none. A model's artifact needs a model's receipt."""
    bad_input = F.exists(F.map_values("inputs"), lambda x: ~F.coalesce(x.rlike(SHA256), F.lit(False)))
    is_model = F.coalesce(F.col("kind") == "model", F.lit(False))
    allowed = authorisation_problem(*map(F.col, ("authorisation", "subject", "authorised_at", "started_at")))
    return (
        F.when(~F.coalesce(F.col("output_sha256").rlike(SHA256), F.lit(False)), "output")
        .when(F.col("inputs").isNull() | (F.size("inputs") == 0), "inputs").when(bad_input, "input_digest")
        .when(F.coalesce(F.col("code_version"), F.lit("")) == "", "code_version").when(must_be_model & ~is_model, "not_a_model")
        .when(is_model & (F.coalesce(F.col("model"), F.lit("")) == ""), "model").when(is_model, F.coalesce(allowed, F.when(truncated(F.col("finish_reason")), "truncated")))
    )


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``left`` with ``found``: the struct of ``values`` of the latest earlier row of ``right`` with equal keys (null if none).

    One union, one sort by the keys, one running last value; right rows are never paired with left ones.
    """
    row = F.struct(*[F.col(v) for v in values])
    lefts = left.select(*keys, "seq", F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).alias("__right"))
    rights = right.select(*keys, "seq", F.lit(0).alias("__side"), F.lit(None).alias("__left"), row.alias("__right"))
    before = W.partitionBy(*keys).orderBy("seq", F.desc("__side")).rowsBetween(W.unboundedPreceding, -1)
    both = lefts.unionByName(rights).withColumn("found", F.last("__right", ignorenulls=True).over(before))
    return both.where("__side = 1").select("__left.*", "found")


def bound(receipts: DataFrame, decisions: DataFrame, expected: Column) -> DataFrame:
    """``receipts`` with ``binding``: how a model's receipt is bound to the decision it names.

    The decision is the latest of that id earlier in the record's journal: unknown (none), verdict (not ACCEPT), artifact
    (not one of ``expected``, if there are any), subject (other bytes), early (the run began before the decision, whatever
    time the receipt claims), bound. Receipts: record_id, seq, authorisation, subject, started_at; decisions: record_id,
    seq, reference, subject_sha256, verdict, artifact, at.
    """
    d = decisions.withColumn("authorisation", decision_id(F.col("reference"), F.col("subject_sha256")))
    j = latest_before(receipts, d, ["record_id", "authorisation"], ["seq", "verdict", "artifact", "subject_sha256", "at"])
    at, started = zoned_time(F.col("found.at")), zoned_time(F.col("started_at"))
    binding = (
        F.when(F.col("found").isNull(), "unknown").when(F.col("found.verdict") != "ACCEPT", "verdict")
        .when((F.size(expected) > 0) & ~F.array_contains(expected, F.col("found.artifact")), "artifact")
        .when(~F.col("subject").eqNullSafe(F.col("found.subject_sha256")), "subject").when(F.coalesce(at <= started, F.lit(False)), "bound").otherwise("early")
    )
    return j.withColumns({"decision_seq": F.col("found.seq"), "binding": binding}).drop("found")


def inherited(receipts: DataFrame, upstream: DataFrame, decisions: DataFrame, outputs: DataFrame) -> DataFrame:
    """record_id, seq, inherited, holds for receipts of what leaves the system.

    inherited: at the receipt, its one input is the upstream artifact's last digest and the last decision on that artifact
    accepts exactly these bytes. holds: since then no other upstream digest, no decision but an acceptance and no other
    output came. Receipts: record_id, seq, input; upstream: record_id, seq, sha256; decisions: record_id, seq, verdict,
    subject; outputs: record_id, seq.
    """
    none = F.lit(None)
    rows = [
        receipts.select("record_id", "seq", F.lit("r").alias("what"), F.col("input").alias("sha256"), none.cast("string").alias("verdict")),
        upstream.select("record_id", "seq", F.lit("u"), "sha256", none.cast("string")), decisions.select("record_id", "seq", F.lit("d"), "subject", "verdict"),
        outputs.select("record_id", "seq", F.lit("o"), none.cast("string"), none.cast("string")),
    ]
    all_ = rows[0]
    for r in rows[1:]:
        all_ = all_.union(r)
    order = W.partitionBy("record_id").orderBy("seq", "what")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    last = lambda what, column: F.last(F.when(F.col("what") == what, column), ignorenulls=True).over(before)
    up, told = last("u", F.col("sha256")), last("d", F.struct("verdict", "sha256"))
    now = (F.col("sha256") == up) & (told["verdict"] == "ACCEPT") & (told["sha256"] == up)
    moved = F.bool_or(F.when(F.col("what") == "o", True).when(F.col("what") == "u", True).when(F.col("what") == "d", ~F.col("verdict").eqNullSafe(F.lit("ACCEPT"))).otherwise(False)).over(after)
    out = all_.withColumns({"inherited": F.coalesce(now, F.lit(False)), "moved": F.coalesce(moved, F.lit(False))}).where("what = 'r'")
    return out.select("record_id", "seq", "inherited", (F.col("inherited") & ~F.col("moved")).alias("holds"))
