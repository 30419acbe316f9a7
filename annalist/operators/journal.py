"""An append-only journal: hash chain, latest facts, as-of joins, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.operators import chain

GENESIS = chain.GENESIS
#: Worst first: the rank of a status when many are rolled up to one.
RANK = ["STOP", "CONFIG", "REVIEW_REQUIRED", "STALE", "EXCLUDED", "ACTION_NEEDED", "READY"]


def envelope(kind: Column, payload: Column, prev: Column, record_id: Column, seq: Column) -> Column:
    """An event's canonical JSON: keys in order, nulls kept, the digest before it inside."""
    return F.to_json(F.struct(kind.alias("kind"), payload.alias("payload"), prev.alias("prev"), record_id.alias("record_id"), seq.alias("seq")), {"ignoreNullFields": "false"})


def seal(events: DataFrame) -> DataFrame:
    """record_id, seq, kind, payload, prev, digest: each record's journal as a hash chain, numbered from 1.

    A digest covers the event and the digest before it: one streaming pass over each record's sorted events (see
    ``chain.linked``). Events: record_id, seq (any order), kind, payload.
    """
    rows = events.select("record_id", F.col("seq").alias("order"), "kind", "payload")
    front = F.concat(F.lit("{"), chain.members(F.col("kind"), F.col("payload")), F.lit(',"prev":"'))
    sealed = chain.linked(rows.withColumns({"front": front, "back": chain.back(F.col("record_id"))}), "record_id", "order")
    return sealed.select("record_id", "seq", "kind", "payload", "prev", "digest")


def verify(journal: DataFrame) -> DataFrame:
    """record_id, seq, problem for every row of a sealed journal; null where all is well.

    gap: seq doesn't follow the one before (from 1); link: prev isn't the stored digest before; altered: the stored digest
    isn't that of the row. The first that fits. One sort by record.
    """
    order = W.partitionBy("record_id").orderBy("seq")
    before, number = F.coalesce(F.lag("digest").over(order), F.lit(GENESIS)), F.coalesce(F.lag("seq").over(order), F.lit(0))
    told = F.sha2(envelope(*map(F.col, ("kind", "payload", "prev", "record_id", "seq"))), 256)
    problem = F.when(F.col("seq") != number + 1, "gap").when(~F.col("prev").eqNullSafe(before), "link").when(~F.col("digest").eqNullSafe(told), "altered")
    return journal.select("record_id", "seq", problem.alias("problem"))


def head(journal: DataFrame) -> DataFrame:
    """record_id, seq, digest of the last event: what the next one is sealed to."""
    return journal.groupBy("record_id").agg(F.max("seq").alias("seq"), F.max_by("digest", "seq").alias("digest"))


def latest(events: DataFrame, *keys: str) -> DataFrame:
    """The last event of each key: keys, seq, payload."""
    return events.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def append_once(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key; later duplicates are not appended."""
    return events.groupBy(*keys).agg(F.min("seq").alias("seq"))


def as_of(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left rows with the latest earlier right row of their key: one union, one sort, one running maximum."""
    both = left.select(key, "seq", F.lit(1).alias("side")).unionByName(right.select(key, "seq", F.lit(0).alias("side")))
    before = W.partitionBy(key).orderBy("seq", "side").rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("decision_seq", F.max(F.when(F.col("side") == 0, F.col("seq"))).over(before)).where("side = 1").drop("side")


def latch(events: DataFrame, sets: Column, clears: Column) -> DataFrame:
    """``latched`` before each event: whether the last setter or clearer of its record was a setter."""
    before = W.partitionBy("record_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    turn = F.when(sets, True).when(clears, False)
    return events.withColumn("latched", F.coalesce(F.last(turn, ignorenulls=True).over(before), F.lit(False)))


def decide(decisions: DataFrame) -> DataFrame:
    """``decisions`` with ``effective`` and ``withdrawal``: which acts of a record's artifact count, in journal order.

    A WITHDRAW always counts and blocks what follows. An UNDO counts only by an active human (``human``) and if it names the
    withdrawal that blocks then (``undo_of``); it lifts the block. ACCEPT and REJECT count while nothing blocks.
    ``withdrawal``: the one that blocks after the act (its seq, else null). Rows: record_id, artifact, seq, verdict, undo_of,
    human. The block is always the last withdrawal, until it is undone: two windows by artifact, no fold.
    """
    before = W.partitionBy("record_id", "artifact").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    is_withdraw = F.col("verdict") == "WITHDRAW"
    d = decisions.withColumn("last", F.last(F.when(is_withdraw, F.col("seq")), ignorenulls=True).over(before))
    lifts = F.coalesce((F.col("verdict") == "UNDO") & F.col("human") & (F.col("undo_of") == F.col("last")), F.lit(False))
    since = W.partitionBy("record_id", "artifact", "last").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("lifts", lifts).withColumn("lifted", F.coalesce(F.bool_or("lifts").over(since), F.lit(False)))
    blocked = F.col("last").isNotNull() & ~F.col("lifted")
    effective = F.when(is_withdraw, True).when(F.col("verdict") == "UNDO", F.col("lifts") & blocked).otherwise(~blocked)
    after = F.when(is_withdraw, F.col("seq")).when(blocked & ~F.col("lifts"), F.col("last"))
    return d.withColumns({"effective": effective, "withdrawal": after}).drop("last", "lifts", "lifted")


def effective(decided: DataFrame) -> DataFrame:
    """record_id, artifact, seq, verdict of the last act that counts, and withdrawn: whether the artifact is blocked."""
    return decided.groupBy("record_id", "artifact").agg(
        F.max(F.when(F.col("effective"), F.col("seq"))).alias("seq"), F.max_by(F.when(F.col("effective"), F.col("verdict")), F.when(F.col("effective"), F.col("seq"))).alias("verdict"),
        F.max_by(F.col("withdrawal").isNotNull(), "seq").alias("withdrawn"))


def facts(events: DataFrame) -> DataFrame:
    """Per record, what replay leaves: last source, last produced bytes, effective decision, withdrawal.

    An acceptance that comes while the record is withdrawn has no effect; every other decision replaces the last.
    """
    seen = latch(events, F.col("kind") == "decision.withdrawn", F.col("kind") == "record.registered")
    counts = (F.col("kind") == "decision.recorded") & ~F.col("latched")
    turn = F.when(F.col("kind") == "decision.withdrawn", 1).when(F.col("kind") == "record.registered", 0)
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("payload")), F.when(F.col("kind") == kind, F.col("seq")))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("seq")))
    return seen.groupBy("record_id").agg(
        last("source.ingested").alias("source"), at("source.ingested").alias("source_seq"),
        last("artifact.produced").alias("produced"), at("artifact.produced").alias("produced_seq"),
        F.max_by(F.when(counts, F.col("payload")), F.when(counts, F.col("seq"))).alias("subject"),
        F.max(F.when(counts, F.col("seq"))).alias("decision_seq"),
        (F.max_by(turn, F.when(turn.isNotNull(), F.col("seq"))) == 1).alias("withdrawn"),
    )


def ladder(binding: Column, derivation: Column, decision: Column, enabled: Column) -> Column:
    """The status of an artifact from its three axes; the first rule that fits decides. What no rule covers (unknown
    values, nulls) is STOP, never READY."""
    ready = binding.isin("bound", "n/a") & derivation.isin("current", "n/a") & decision.isin("accepted", "n/a")
    return (
        F.when(F.coalesce(~enabled, F.lit(False)), "EXCLUDED").when(binding == "unknown", "STOP").when(derivation == "unverifiable", "STOP")
        .when(decision.isin("rejected", "withdrawn"), "EXCLUDED").when(binding == "drifted", "REVIEW_REQUIRED")
        .when(derivation == "stale", "STALE").when(decision == "undecided", "ACTION_NEEDED")
        .when(ready & enabled, "READY").otherwise("STOP")
    )


def axes(found: DataFrame) -> DataFrame:
    """record_id, derivation, decision, status: equal bytes are fresh only if produced after the source."""
    derivation = F.when(F.col("produced").isNull(), "unverifiable").when(F.col("source_seq") > F.col("produced_seq"), "stale").otherwise("current")
    decision = F.when(F.coalesce("withdrawn", F.lit(False)), "withdrawn").when((F.col("subject") == F.col("produced")) & (F.col("decision_seq") > F.col("produced_seq")), "accepted").otherwise("undecided")
    out = found.withColumns({"derivation": derivation, "decision": decision})
    return out.select("record_id", "derivation", "decision", ladder(F.lit("n/a"), F.col("derivation"), F.col("decision"), F.lit(True)).alias("status"))


def rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RANK)), status).cast("int")


def worst(statuses: DataFrame, *keys: str) -> DataFrame:
    """The worst status of each group, and how many have each rank's best and worst."""
    return statuses.groupBy(*keys).agg(F.min_by("status", rank(F.col("status"))).alias("status"), F.count("*").cast("long").alias("n"))
