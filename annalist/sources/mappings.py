"""Small registers from text: language codes, language mappings of segments, and configuration in TOML."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the head of a mapping.
MAPPING_HEAD = "index\tsegment_sha256\tlanguage"


def iso_codes(snapshots: DataFrame) -> DataFrame:
    """release, problem, codes (sorted) for snapshots (release, content binary): one code of three small letters a line.

    Problems: ``bytes`` (not UTF-8, a BOM, a CR, no line feed at the end), ``line`` (empty, or no code), ``repeated``,
    ``und`` (und or zxx is missing). A null content is ``bytes``.
    """
    text = F.try_validate_utf8("content")
    rows = F.split(F.expr("left(text, length(text) - 1)"), "\n", -1)
    d = snapshots.select("release", text.alias("text")).withColumn("rows", rows)
    bad = F.col("text").isNull() | F.col("text").startswith("﻿") | F.col("text").contains("\r") | ~F.col("text").endswith("\n")
    problem = (
        F.when(bad, "bytes").when(F.exists("rows", lambda x: ~x.rlike(r"^[a-z]{3}\z")), "line").when(F.size("rows") != F.size(F.array_distinct("rows")), "repeated")
        .when(~F.array_contains("rows", F.lit("und")) | ~F.array_contains("rows", F.lit("zxx")), "und"))
    return d.select("release", problem.alias("problem"), F.when(problem.isNull(), F.array_sort("rows")).alias("codes"))


def mapping_template(drafts: DataFrame) -> DataFrame:
    """record_id, tsv: a line for each segment of drafts (record_id, idx, segment_sha256), its language to be filled in."""
    line = F.concat_ws("\t", F.col("idx").cast("string"), "segment_sha256", F.lit(""))
    listed = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return drafts.groupBy("record_id").agg(F.concat(F.lit(MAPPING_HEAD + "\n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n"), F.lit("\n")).alias("tsv"))


def read_mapping(mappings: DataFrame, drafts: DataFrame, codes: DataFrame) -> DataFrame:
    """record_id, idx, language, problem for mappings (record_id, tsv), drafts and codes (language), line by line.

    Problems: ``bytes`` (not ASCII, a CR, no line feed at the end), ``head``, ``cells`` (not three), ``segment`` (index
    or digest is not the draft's at that place, or there is a line too many), ``missing`` (a segment without a line),
    ``language`` (not three small letters, or not among the codes). idx is the line's place, null for whole files.
    """
    bad = F.when(~F.col("tsv").rlike(r"^[\x00-\x7f]*\z") | F.col("tsv").contains("\r") | ~F.col("tsv").endswith("\n"), "bytes").when(~F.col("tsv").startswith(MAPPING_HEAD + "\n"), "head")
    m = mappings.select("record_id", "tsv", F.when(F.col("tsv").isNull(), "bytes").otherwise(bad).alias("bad"))
    whole = m.where("bad is not null").select("record_id", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("language"), F.col("bad").alias("problem"))
    body = F.split(F.expr(f"substring(tsv, {len(MAPPING_HEAD) + 2}, length(tsv) - {len(MAPPING_HEAD) + 2})"), "\n", -1)
    lines = m.where("bad is null").select("record_id", F.posexplode(F.when(F.length("tsv") > len(MAPPING_HEAD) + 1, body).otherwise(F.array().cast("array<string>"))).alias("idx", "line"))
    cell = F.split("line", "\t", -1)
    lines = lines.select("record_id", F.col("idx").cast("long").alias("idx"), cell.alias("c"))
    d = drafts.join(m.where("bad is null").select("record_id"), "record_id", "left_semi").select("record_id", F.col("idx").cast("long").alias("idx"), F.col("segment_sha256").alias("want"))
    j = lines.join(d, ["record_id", "idx"], "full_outer")
    j = j.withColumn("language", F.when(F.size("c") == 3, F.get("c", F.lit(2)))).join(codes.select("language", F.lit(True).alias("known")).distinct(), "language", "left")
    problem = (
        F.when(F.col("c").isNull(), "missing").when(F.size("c") != 3, "cells")
        .when(F.col("want").isNull() | (F.get("c", F.lit(0)) != F.col("idx").cast("string")) | (F.get("c", F.lit(1)) != F.col("want")), "segment")
        .when(~F.col("language").rlike(r"^[a-z]{3}\z") | F.col("known").isNull(), "language"))
    return j.select("record_id", "idx", "language", problem.alias("problem")).unionByName(whole)


def toml(text: str, required: set[str], optional: set[str] = frozenset()) -> dict:
    """Configuration with exactly these keys; a missing, foreign or repeated key is an error."""
    found = tomllib.loads(text)
    missing, foreign = sorted(required - found.keys()), sorted(found.keys() - required - set(optional))
    if missing or foreign:
        raise ValueError(f"missing {missing}, foreign {foreign}")
    return found


#: What a codebook and its categories must hold.
CODEBOOK_KEYS = {"rules", "category"}
CATEGORY_KEYS = {"id", "label", "definition", "include", "exclude", "examples"}


def codebook(spark, text: str, head: set[str]) -> DataFrame:
    """One row a category of a codebook in TOML; ids must be unique and the one for the undecided must be there."""
    found = toml(text, head | CODEBOOK_KEYS)
    rows = found["category"]
    for r in rows:
        if set(r) != CATEGORY_KEYS:
            raise ValueError(f"category {r.get('id')!r} has the keys {sorted(r)}")
    ids = [r["id"] for r in rows]
    if len(ids) != len(set(ids)) or "UNGEKLAERT" not in ids:
        raise ValueError("category ids must be unique and include UNGEKLAERT")
    return spark.createDataFrame([tuple(r[k] for k in sorted(CATEGORY_KEYS)) for r in rows], "definition string, examples array<string>, exclude string, id string, include string, label string")
