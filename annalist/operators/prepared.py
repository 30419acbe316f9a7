"""Prepared plans checked before they take effect: the register as it was, and what must follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.operators.mentions import entity_id
from annalist.operators.timeline import inputs_as_of


def allocated(plans: DataFrame, needs: DataFrame, register: DataFrame, types: list[str]) -> DataFrame:
    """plan, entity_type, surface, number: the numbers that each plan must give, from the register as of its own seq.

    Surfaces that were registered before keep their number; others get the next ones of their type, in the order of entity
    ids. Later entries change nothing. Plans: plan, seq; needs: plan, entity_type, surface; register: entity_type, surface,
    number, seq (each surface of a type once, numbers rising with seq). The counters of the types are looked up as of every plan.
    """
    wanted = needs.distinct().join(plans.select("plan", "seq"), "plan")
    known = register.select("entity_type", "surface", F.col("number").alias("had"), F.col("seq").alias("had_seq"))
    j = wanted.join(known, ["entity_type", "surface"], "left")
    j = j.withColumn("had", F.when(F.col("had_seq") < F.col("seq"), F.col("had")))
    counters = inputs_as_of(plans.select("plan", "seq"), register.select(F.col("entity_type").alias("role"), "seq", F.col("number").cast("string").alias("sha256")), types)
    used = counters.select("plan", F.explode(F.create_map(*[x for t in types for x in (F.lit(t), F.coalesce(F.col(f"{t}.sha256").cast("long"), F.lit(0)))])).alias("entity_type", "used"))
    order = W.partitionBy("plan", "entity_type", F.col("had").isNull()).orderBy(entity_id(F.col("entity_type"), F.col("surface")))
    j = j.withColumn("nth", F.row_number().over(order)).join(used, ["plan", "entity_type"], "left")
    return j.select("plan", "entity_type", "surface", F.coalesce("had", F.col("used") + F.col("nth")).cast("long").alias("number"))


def findings(plans: DataFrame, needs: DataFrame, reported: DataFrame, register: DataFrame, types: list[str]) -> DataFrame:
    """plan, finding, entity_type, surface, expected, reported: all that is wrong with prepared plans; sound ones have no row.

    moved: the plan's ``basis`` (the seq of the last entry it was made on, null for none) isn't the register's last one before
    the plan; lost: a number that must be given isn't reported; extra: one is that needn't be; number: it is another.
    Reported: plan, entity_type, surface, number.
    """
    heads = inputs_as_of(plans.select("plan", "seq", "basis"), register.select(F.lit("register").alias("role"), "seq", F.lit("").alias("sha256")), ["register"])
    none = lambda kind: F.lit(None).cast(kind)
    moved = heads.where(~F.col("basis").eqNullSafe(F.col("register.seq"))).select("plan", F.lit("moved").alias("finding"), none("string").alias("entity_type"), none("string").alias("surface"), F.col("register.seq").alias("expected"), F.col("basis").alias("reported"))
    want = allocated(plans, needs, register, types).withColumnRenamed("number", "expected")
    have = reported.select("plan", "entity_type", "surface", F.col("number").alias("reported"))
    j = want.join(have, ["plan", "entity_type", "surface"], "full_outer")
    finding = F.when(F.col("reported").isNull(), "lost").when(F.col("expected").isNull(), "extra").when(F.col("expected") != F.col("reported"), "number")
    return moved.unionByName(j.select("plan", finding.alias("finding"), "entity_type", "surface", "expected", "reported").where("finding is not null"))
