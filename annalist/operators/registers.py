"""Registers folded from events in order of seq: instances, owners, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def instances(events: DataFrame, registers: Column, retires: Column, view: Column) -> DataFrame:
    """seq, coder_id, outcome of register and retire events (seq, coder_id); others are left out.

    ``registered`` (binds the first view), ``repeat`` (equal view), ``conflict`` (another view, or retired already),
    ``retired``, ``retired_before``, ``unknown`` (retired without registration). Refused events change nothing, so
    the first registration and the first retirement after it decide; no row-by-row state is needed.
    """
    e = events.select("seq", "coder_id", registers.alias("reg"), retires.alias("ret"), view.alias("view")).where("reg or ret")
    whole = W.partitionBy("coder_id")
    e = e.withColumn("first", F.min(F.when(F.col("reg"), F.col("seq"))).over(whole)).withColumn("bound", F.min_by("view", F.when(F.col("reg"), F.col("seq"))).over(whole))
    e = e.withColumn("end", F.min(F.when(F.col("ret") & (F.col("seq") > F.col("first")), F.col("seq"))).over(whole))
    gone = F.coalesce(F.col("seq") > F.col("end"), F.lit(False))
    registered = F.when(F.col("seq") == F.col("first"), "registered").when(gone | ~F.col("view").eqNullSafe(F.col("bound")), "conflict").otherwise("repeat")
    retired = F.when(F.coalesce(F.col("seq") < F.col("first"), F.lit(True)), "unknown").when(gone, "retired_before").otherwise("retired")
    return e.select("seq", "coder_id", F.when(F.col("reg"), registered).otherwise(retired).alias("outcome"))


def active(events: DataFrame, registers: Column, retires: Column, view: Column) -> DataFrame:
    """coder_id, view of instances registered and not retired."""
    told = instances(events, registers, retires, view).where("outcome in ('registered', 'retired')")
    last = told.groupBy("coder_id").agg(F.max_by("outcome", "seq").alias("outcome"), F.min("seq").alias("first")).where("outcome = 'registered'")
    return last.join(events.select("seq", view.alias("view")), F.col("first") == F.col("seq")).select("coder_id", "view")


def ownership(transfers: DataFrame, birth: str) -> DataFrame:
    """record_id, owner, seq, broken_at for transfers (record_id, seq, giver, taker).

    Every transfer must come from the owner of the moment, at first ``birth``. The first that doesn't stops its
    record's ledger (``broken_at``): owner and seq are those before it, seq null if there was none.
    """
    order = W.partitionBy("record_id").orderBy("seq")
    t = transfers.withColumn("bad", ~F.col("giver").eqNullSafe(F.coalesce(F.lag("taker").over(order), F.lit(birth))))
    t = t.withColumn("broken", F.max("bad").over(order.rowsBetween(W.unboundedPreceding, 0)))
    good = ~F.col("broken")
    last = t.groupBy("record_id").agg(
        F.max_by("taker", F.when(good, F.col("seq"))).alias("owner"), F.max(F.when(good, F.col("seq"))).alias("seq"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("broken_at"))
    return last.select("record_id", F.when(F.col("seq").isNull(), birth).otherwise(F.col("owner")).alias("owner"), "seq", "broken_at")


def heads(versions: DataFrame) -> DataFrame:
    """name, version, ref, forked: the newest version of each, and whether some version had two successors.

    ``versions``: name, version, parent (the version it replaced, null at first), ref. A compare-and-set that loses
    would have written a second child of one parent.
    """
    children = versions.groupBy("name", "parent").agg(F.count("*").alias("n")).groupBy("name").agg((F.max("n") > 1).alias("forked"))
    return versions.groupBy("name").agg(F.max("version").alias("version"), F.max_by("ref", "version").alias("ref")).join(children, "name")


def partition_findings(members: DataFrame, groups: DataFrame) -> DataFrame:
    """member, finding: ``missing`` (in no group), ``repeated`` (in several), ``foreign`` (grouped, but no member)."""
    g = groups.groupBy("member").agg(F.count("*").alias("n"))
    j = members.select("member").distinct().withColumn("there", F.lit(True)).join(g, "member", "full_outer")
    finding = F.when(F.col("n").isNull(), "missing").when(F.col("there").isNull(), "foreign").when(F.col("n") > 1, "repeated")
    return j.select("member", finding.alias("finding")).where("finding is not null")


def overlay_findings(base: DataFrame, removed: DataFrame, added: DataFrame, result: DataFrame) -> DataFrame:
    """Rows in which base without removed, with added, differs from the result; all have the same columns."""
    want = base.join(removed, base.columns, "left_anti").unionByName(added).distinct()
    return want.exceptAll(result).withColumn("finding", F.lit("lost")).unionByName(result.exceptAll(want).withColumn("finding", F.lit("surplus")))
