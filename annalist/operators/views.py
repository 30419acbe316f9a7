"""Replay of many artifacts a record: what a journal's events leave of each, with findings that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import SHA256
from annalist.operators.journal import decide

#: Verdicts, and outcomes of an anchor check.
VERDICTS, OUTCOMES = ["ACCEPT", "REJECT", "WITHDRAW", "UNDO"], ["exact", "unique_move", "ambiguous", "missing"]
PRODUCED, RECEIPT, DECISION, ANCHOR = "artifact.produced", "receipt.recorded", "decision.recorded", "anchor.checked"
SCHEMA = "record_id {}, artifact string, sha256 string, versions long, receipt_for string, decided_sha256 string, verdict string, withdrawal long, outcome string, epoch long, findings long, upto long"


def finding(produced_before: Column) -> Column:
    """The rule that an event breaks by itself, null if none: such an event changes nothing but the count of findings,
    only that a broken decision also takes away the one before."""
    sha = F.coalesce(F.col("sha256").rlike(SHA256), F.lit(False))
    kind = F.col("kind")
    return (
        F.when((kind == PRODUCED) & ~sha, "bytes").when((kind == RECEIPT) & ~sha, "receipt").when((kind == DECISION) & (~sha | ~F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False))), "decision")
        .when((kind == ANCHOR) & ~produced_before, "early").when((kind == ANCHOR) & ~F.coalesce(F.col("outcome").isin(OUTCOMES), F.lit(False)), "outcome"))


def views(events: DataFrame) -> DataFrame:
    """A row for each record and artifact: its bytes, how many versions they had, whose the last receipt is, the decision
    that counts, the withdrawal that blocks (its number), the last anchor check, the epoch (the last event that moved it),
    the record's findings, and the last event seen.

    Events: record_id, seq, kind, artifact, sha256, verdict, undo_of, human, outcome (null where a kind has none). Rows
    without artifact count as seen only. Two sorts by record and artifact, then one aggregation.
    """
    order = W.partitionBy("record_id", "artifact").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    good = (F.col("kind") == PRODUCED) & F.coalesce(F.col("sha256").rlike(SHA256), F.lit(False))
    e = events.withColumn("there", F.coalesce(F.bool_or(good).over(order), F.lit(False)))
    e = e.withColumn("finding", finding(F.col("there")))
    sound = F.col("finding").isNull()
    acts = decide(e.where((F.col("kind") == DECISION) & sound).select("record_id", "artifact", "seq", "verdict", "undo_of", "human"))
    e = e.join(acts.select("record_id", "artifact", "seq", "effective", F.col("withdrawal")), ["record_id", "artifact", "seq"], "left")
    is_ = lambda kind: (F.col("kind") == kind) & F.col("finding").isNull()
    counts = F.coalesce(F.col("effective"), F.lit(False))
    # a broken decision counts as one that leaves none
    turn = F.when(counts | (F.col("finding") == "decision"), F.struct("seq", F.when(counts, F.col("sha256")).alias("sha256"), F.when(counts, F.col("verdict")).alias("verdict")))
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("seq")))
    g = e.where("artifact is not null").groupBy("record_id", "artifact").agg(
        last(F.col("sha256"), is_(PRODUCED)).alias("sha256"), F.count_distinct(F.when(is_(PRODUCED), F.col("sha256"))).alias("versions"), last(F.col("sha256"), is_(RECEIPT)).alias("receipt_for"), F.max(turn).alias("turn"),
        F.max_by("withdrawal", F.when(is_(DECISION), F.col("seq"))).alias("withdrawal"), last(F.col("outcome"), is_(ANCHOR)).alias("outcome"), F.max(F.when(is_(PRODUCED) | is_(RECEIPT) | counts, F.col("seq"))).alias("epoch"))
    record = e.groupBy("record_id").agg(F.count("finding").alias("findings"), F.max("seq").alias("upto"))
    return g.join(record, "record_id").select("record_id", "artifact", "sha256", "versions", "receipt_for", F.col("turn.sha256").alias("decided_sha256"), F.col("turn.verdict").alias("verdict"), "withdrawal", "outcome", "epoch", "findings", "upto")
