"""Ownership ledgers as files: read with all that makes one untrustworthy, and written from transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.sources.ingest import decoded

#: The block that tells owners to readers and is never read.
DERIVED = "owners_derived_do_not_edit"
TRANSFER = "array<struct<at:string,`from`:string,record_id:string,reference:string,`to`:string>>"


def load(files: DataFrame, default: str) -> DataFrame:
    """ledger, n, record_id, from_runtime, to_runtime, at, reference, problem of files (ledger, content): a row for each transfer,
    numbered from 0 in the file's order, or one row with the problem that the whole file is refused for.

    ``json`` (not UTF-8, no JSON, or no object), ``transfers`` (no list), ``entry`` (a transfer is no object, or one without
    from, to or at as text), ``default`` (declares another default runtime than the profile's ``default``), ``owners`` (has
    an owners block: ownership is computed from transfers, not entered). A ledger without transfers has no row.
    """
    v = F.try_parse_json(decoded(F.col("content")))
    f = files.select("ledger", decoded(F.col("content")).alias("text"), v.alias("v"))
    whole = F.schema_of_variant("v")
    keys = F.when(whole.startswith("OBJECT<"), F.json_object_keys("text"))
    listed = F.try_variant_get("v", "$.transfers", "array<variant>")
    entry = lambda x, k: F.coalesce(F.schema_of_variant(F.try_variant_get(x, f"$.{k}", "variant")) == "STRING", F.lit(False))
    bad = F.exists(listed, lambda x: ~(F.schema_of_variant(x).startswith("OBJECT<") & entry(x, "from") & entry(x, "to") & entry(x, "at")))
    problem = (
        F.when(~F.coalesce(whole.startswith("OBJECT<"), F.lit(False)), "json").when(F.array_contains(keys, "transfers") & listed.isNull(), "transfers").when(F.coalesce(bad, F.lit(False)), "entry")
        .when(F.array_contains(keys, "default_runtime") & ~F.try_variant_get("v", "$.default_runtime", "string").eqNullSafe(F.lit(default)), "default").when(F.array_contains(keys, "owners"), "owners"))
    f = f.withColumn("problem", problem)
    rows = F.from_json("text", f"transfers {TRANSFER}")["transfers"]
    good = f.where("problem is null").select("ledger", F.posexplode(rows).alias("n", "t")).select("ledger", "n", "t.record_id", F.col("t.from").alias("from_runtime"), F.col("t.to").alias("to_runtime"), "t.at", F.coalesce("t.reference", F.lit("")).alias("reference"), F.lit(None).cast("string").alias("problem"))
    none = F.lit(None).cast("string")
    refused = f.where("problem is not null").select("ledger", F.lit(None).cast("int").alias("n"), none.alias("record_id"), none.alias("from_runtime"), none.alias("to_runtime"), none.alias("at"), none.alias("reference"), "problem")
    return good.unionByName(refused)


def save(transfers: DataFrame, default: str) -> DataFrame:
    """ledger, content of transfers (ledger, n, record_id, from_runtime, to_runtime, at, reference): JSON with the keys in order, a
    block of owners that is only for readers, and a final line feed. A ledger is one file, gathered in order of n."""
    t = F.struct(F.col("at"), F.col("from_runtime").alias("from"), "record_id", "reference", F.col("to_runtime").alias("to"))
    last = transfers.groupBy("ledger", "record_id").agg(F.max_by("to_runtime", "n").alias("to"))
    owners = last.groupBy("ledger").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_id", "to")))).alias("owners"))
    g = transfers.groupBy("ledger").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", t.alias("t")))), lambda x: x["t"]).alias("transfers")).join(owners, "ledger")
    whole = F.to_json(F.struct(F.lit(default).alias("default_runtime"), F.col("owners").alias(DERIVED), "transfers", F.lit(1).alias("version")), {"ignoreNullFields": "false"})
    return g.select("ledger", F.concat(whole, F.lit("\n")).cast("binary").alias("content"))
