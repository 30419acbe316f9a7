"""Operations that stopped half way: intents, prepared and completed acts, and chains of exported objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uncertain(intents: DataFrame, events: DataFrame) -> DataFrame:
    """Intents (intent_sha256) that no event carries."""
    carried = events.where(F.col("operation_intent_sha256").isNotNull()).select(F.col("operation_intent_sha256").alias("intent_sha256")).distinct()
    return intents.join(carried, "intent_sha256", "left_anti")


def pairs(prepared: DataFrame, completed: DataFrame) -> DataFrame:
    """digest, prepared, completed, state of every act: open, done (once each), repeated or orphan (never prepared)."""
    a = prepared.groupBy("digest").agg(F.count("*").alias("prepared"))
    b = completed.groupBy("digest").agg(F.count("*").alias("completed"))
    j = a.join(b, "digest", "full_outer").select("digest", F.coalesce("prepared", F.lit(0)).alias("prepared"), F.coalesce("completed", F.lit(0)).alias("completed"))
    state = F.when(F.col("prepared") == 0, "orphan").when(F.col("completed") == 0, "open").when((F.col("prepared") == 1) & (F.col("completed") == 1), "done").otherwise("repeated")
    return j.withColumn("state", state)


#: The status and reason of each class of the recovery matrix.
REPORT = {
    "A": ("STOP", "no intent"), "B": ("STOP", "invalid intent"), "C": ("STOP", "moved on"), "D": ("READY", "complete"), "E": ("ACTION_NEEDED", "resume"),
    "F": ("ACTION_NEEDED", "start again"), "G": ("STOP", "contradiction"),
}


def report(klass: Column) -> Column:
    """struct(status, reason) of a class of the matrix; an unknown class is STOP."""
    pick = lambda k: F.coalesce(*[F.when(klass == c, F.lit(v[k])) for c, v in REPORT.items()], F.lit(("STOP", "contradiction")[k]))
    return F.struct(pick(0).alias("status"), pick(1).alias("reason"))


def intent_digest(domain: Column, command: Column, target: Column, workspace: Column, inputs: Column) -> Column:
    """Digest of an intent's canonical JSON (keys in order; ``inputs``: a map of role to digest, in the order of roles)."""
    sorted_ = F.map_from_entries(F.array_sort(F.map_entries(inputs)))
    return F.sha2(F.to_json(F.struct(command.alias("command"), domain.alias("domain"), sorted_.alias("inputs"), target.alias("target_key"), F.lit(1).alias("v"), workspace.alias("workspace_id")), {"ignoreNullFields": "false"}), 256)


def bundle(approved: DataFrame, objects: DataFrame) -> DataFrame:
    """record_id, metadata_draft, abstract_draft, adjudicated, problem: the chain from an approval to its drafts.

    approved -> preview -> {metadata, abstract, adjudicated} -> drafts, each by an equi join on the address; what is missing
    is named by the first ``problem`` (record: the approval is of another record). Approved: record_id, address; objects:
    address, record_id, refs (map of field to address).
    """

    def follow(df: DataFrame, column: str, name: str) -> DataFrame:
        o = objects.select(F.col("address").alias(column), F.col("refs").alias(name), F.col("record_id").alias(f"{name}_record"), F.lit(True).alias(f"{name}_there"))
        return df.join(o.hint("merge"), column, "left")  # objects are as many as records: never sent whole through the driver

    j = follow(approved.select("record_id", F.col("address").alias("at")), "at", "approval")
    j = follow(j.withColumn("preview_at", F.col("approval")["confirmed"]), "preview_at", "preview")
    for part in ("metadata", "abstract"):
        j = follow(j.withColumn(f"{part}_at", F.col("preview")[part]), f"{part}_at", part)
        j = follow(j.withColumn(f"{part}_draft", F.col(part)["confirmed"]), f"{part}_draft", f"{part}_last")
    missing = [F.when(F.col(f"{n}_there").isNull(), n) for n in ("approval", "preview", "metadata", "abstract", "metadata_last", "abstract_last")]
    problem = F.coalesce(missing[0], F.when(~F.col("approval_record").eqNullSafe(F.col("record_id")), "record"), *missing[1:], F.when(F.col("preview")["adjudicated"].isNull(), "adjudicated"))
    return j.select("record_id", "metadata_draft", "abstract_draft", F.col("preview")["adjudicated"].alias("adjudicated"), problem.alias("problem"))
