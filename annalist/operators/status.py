"""Statuses rolled up: gates, records, the workspace; exit codes and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.journal import RANK, rank

#: Exit codes; all other statuses give OTHER.
EXIT, OTHER = {"READY": 0, "STOP": 1, "CONFIG": 2}, 3
#: What a status is explained by.
BOUND, UNCHANGED, ANSWERED = "aktuell gebunden", "Eingaben unverändert", "von einem Menschen verantwortet"
NOTHING_NEEDED = "keine Bindung, kein Ableitungsbeleg und keine menschliche Entscheidung erforderlich"
DISABLED, REJECTED, WITHDRAWN, RETIRED = "bewusst deaktiviert", "verworfen", "zurückgezogen", "aus dem Betrieb genommen"
DRIFT = "Ankerdrift: Annotationen zeigen nicht mehr eindeutig auf den Text"
MOVED = "Eingaben der Ableitung haben sich geändert"
UNDECIDED = "keine menschliche Entscheidung zu genau diesen Bytes"
UNBOUND, UNPROVEN, UNCOVERED = "Bindung an eine Transkriptfassung nicht feststellbar", "kein Beleg für die Ableitung vorhanden", "nicht abgedeckter Zustand"


def exit_code(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, F.lit(n)) for s, n in EXIT.items()], F.lit(OTHER))


def explanation(binding: Column, derivation: Column, decision: Column, enabled: Column, status: Column) -> Column:
    """Words for a status and its axes."""
    good = F.array_compact(F.array(F.when(binding == "bound", BOUND), F.when(derivation == "current", UNCHANGED), F.when(decision == "accepted", ANSWERED)))
    return (
        F.when(status == "READY", F.when(F.size(good) > 0, F.array_join(good, ", ")).otherwise(NOTHING_NEEDED))
        .when(status == "EXCLUDED", F.when(~enabled, DISABLED).when(decision == "rejected", REJECTED).when(decision == "withdrawn", WITHDRAWN).otherwise(RETIRED))
        .when(status == "REVIEW_REQUIRED", DRIFT).when(status == "STALE", MOVED).when(status == "ACTION_NEEDED", UNDECIDED)
        .when(binding == "unknown", UNBOUND).when(derivation == "unverifiable", UNPROVEN).otherwise(UNCOVERED)
    )


def conjunction(records: DataFrame, gates: DataFrame) -> DataFrame:
    """record_id, status, gate (the worst one's name, null if all passed), failed, gates: the worst gate decides.

    Ties keep the first. A record without any gate evaluated is STOP. Records: record_id; gates: record_id, ordinal, gate,
    status. Statuses that no rank knows are worst.
    """
    order = F.struct(F.coalesce(F.when(rank(F.col("status")) > 0, rank(F.col("status"))), F.lit(0)), F.col("ordinal"))
    worst = F.min_by(F.struct("status", "gate"), order)
    found = gates.groupBy("record_id").agg(worst.alias("w"), F.count_if(~F.col("status").eqNullSafe(F.lit("READY"))).alias("failed"), F.count("*").alias("gates"))
    j = records.select("record_id").distinct().join(found, "record_id", "left")
    status = F.when(F.col("gates").isNull(), "STOP").when(F.array_contains(F.array(*map(F.lit, RANK)), F.col("w.status")), F.col("w.status")).otherwise("STOP")
    return j.select("record_id", status.alias("status"), F.when(F.col("failed") > 0, F.col("w.gate")).alias("gate"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("gates", F.lit(0)).alias("gates"))


def record_status(findings: Column, enabled: Column, worst: Column, open_gates: Column, may_confer: Column) -> Column:
    """A record's status from its number of findings, its artifacts' worst status (null: none), its reachable gates and
    whether the journal's authority may say READY."""
    capped = (worst == "READY") & ((open_gates > 0) | ~F.coalesce(may_confer, F.lit(False)))
    return F.when(findings > 0, "STOP").when(~enabled, "EXCLUDED").when(worst.isNull() | capped, "ACTION_NEEDED").otherwise(worst)


def workspace(statuses: DataFrame) -> DataFrame:
    """status, records, exit_code: one row, the worst of all records; STOP if there are none."""
    w = statuses.agg(F.min_by("status", rank(F.col("status"))).alias("w"), F.count("*").alias("records"))
    return w.select(F.coalesce("w", F.lit("STOP")).alias("status"), "records").withColumn("exit_code", exit_code(F.col("status")))


def usable(has_bytes: Column, status: Column) -> Column:
    """An artifact may feed the next step: its bytes exist and its status is READY."""
    return has_bytes & F.coalesce(status == "READY", F.lit(False))
