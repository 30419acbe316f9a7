"""Who owns a record: adoptions in the journal, the ledger derived from them, and where a ledger file differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import REFERENCE, decision_id, zoned_time
from annalist.operators.receipts import latest_before


def adoption_problem(known: list[str]) -> Column:
    """record, reference, runtime (not one of ``known``), same (no change of owner), time (no zone), envelope (another
    record's); null if the event (record_id, reference, from_runtime, to_runtime, at, envelope_id) is well formed."""
    strange = lambda c: ~F.coalesce(F.col(c).isin(known), F.lit(False))
    return (
        F.when(F.col("record_id").isNull(), "record").when(~F.coalesce(F.col("reference").rlike(REFERENCE), F.lit(False)), "reference")
        .when(strange("from_runtime") | strange("to_runtime"), "runtime").when(F.col("from_runtime") == F.col("to_runtime"), "same")
        .when(zoned_time(F.col("at")).isNull(), "time").when(F.col("envelope_id").isNotNull() & (F.col("envelope_id") != F.col("record_id")), "envelope")
    )


def adoptions(events: DataFrame, decisions: DataFrame, runtimes: tuple[str, str], authorised: bool = True) -> DataFrame:
    """``events`` with ``problem``: null for transfers that count.

    Beyond form, an adoption needs the decision that it names, earlier in the journal, as an acceptance for this record
    (``decision``, ``verdict``), and must come from whoever owns the record then (``owner``). With two runtimes, each
    well-founded adoption leaves its own target as the owner, whether it counts or not; so the owner before one is the
    target of the one before, and ``runtimes[0]`` at first. Without an authenticated journal none counts
    (``authority``).
    """
    d = decisions.withColumn("decision_id", decision_id(F.col("reference"), F.col("subject_sha256")))
    j = latest_before(events.withColumn("form", adoption_problem(list(runtimes))), d, ["decision_id"], ["verdict", "record_id"])
    told = F.coalesce("form", F.when(F.col("found").isNull(), "decision").when((F.col("found.verdict") != "ACCEPT") | ~F.col("found.record_id").eqNullSafe(F.col("record_id")), "verdict"))
    j = j.withColumn("told", told)
    before = W.partitionBy("record_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    owner = F.coalesce(F.last(F.when(F.col("told").isNull(), F.col("to_runtime")), ignorenulls=True).over(before), F.lit(runtimes[0]))
    problem = F.coalesce("told", F.when(owner != F.col("from_runtime"), "owner"))
    return j.withColumn("problem", problem if authorised else F.lit("authority")).drop("form", "told", "found")


def owners(adopted: DataFrame) -> DataFrame:
    """record_id, runtime, reference: the last transfer that counts."""
    good = adopted.where(F.col("problem").isNull())
    return good.groupBy("record_id").agg(F.max_by("to_runtime", "seq").alias("runtime"), F.max_by("reference", "seq").alias("reference"))


def owned(records: DataFrame, owners: DataFrame, default: str) -> DataFrame:
    """record_id, runtime of every active record: unknown ones belong to the default."""
    return records.select("record_id").distinct().join(owners.select("record_id", "runtime"), "record_id", "left").select("record_id", F.coalesce("runtime", F.lit(default)).alias("runtime"))


def owner_counts(owned: DataFrame, runtimes: list[str]) -> DataFrame:
    """runtime, records, retired for each of ``runtimes``: retired if it owns no active record, and there are any."""
    r = owned.sparkSession.createDataFrame([(x,) for x in runtimes], "runtime string")
    n, total = owned.groupBy("runtime").agg(F.count("*").alias("n")), owned.agg(F.count("*").alias("total"))
    j = r.join(n, "runtime", "left").crossJoin(F.broadcast(total))
    return j.select("runtime", F.coalesce("n", F.lit(0)).alias("records"), (F.col("n").isNull() & (F.col("total") > 0)).alias("retired"))


def against_truth(ledger: DataFrame, truth: DataFrame) -> DataFrame:
    """record_id, finding: what a ledger file says beside the journal. claims (the journal knows no transfer) and differs
    are findings; behind (the file lacks one) is none, the file is built anew."""
    a = ledger.select("record_id", F.struct("runtime", "reference").alias("a"))
    b = truth.select("record_id", F.struct("runtime", "reference").alias("b"))
    j = a.join(b, "record_id", "full_outer")
    finding = F.when(F.col("b").isNull(), "claims").when(F.col("a").isNull(), "behind").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return j.select("record_id", finding.alias("finding")).where(F.col("finding").isNotNull())
