"""What held for the whole journal when each event came: inputs of all records, as of every event."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Inputs that are sent to all tasks; with more, events and inputs meet by ranges of numbers.
LIMIT = 100_000
#: Numbers of one range.
BLOCK = 1 << 16
_KIND = "struct<sha256:string,seq:bigint>"


def inputs_as_of(events: DataFrame, timeline: DataFrame, roles: list[str]) -> DataFrame:
    """``events`` with a struct (sha256, seq) for each role: the last input of that role strictly before the event, null if
    there was none. Later inputs change nothing. Events: seq and any columns; timeline: role, seq, sha256.

    Up to LIMIT inputs of these roles are broadcast in order and looked up by binary search, without a shuffle of the
    events. More of them meet the events by ranges of BLOCK numbers (what held at the beginning of each range, a row a
    range, is found in one task). Of inputs with one number the larger sha256 counts.
    """
    named = timeline.where(F.col("role").isin(roles)).select("role", F.col("seq").cast("long").alias("seq"), "sha256")
    few = named.limit(LIMIT + 1).collect()
    return _searched(events, few, roles) if len(few) <= LIMIT else _by_ranges(events, named, roles)


def _searched(events: DataFrame, inputs: list, roles: list[str]) -> DataFrame:
    last: dict[str, dict[int, str]] = {r: {} for r in roles}
    for x in sorted(inputs, key=lambda x: (x["seq"], x["sha256"] or "")):
        last[x["role"]][x["seq"]] = x["sha256"]
    sent = events.sparkSession.sparkContext.broadcast({r: (list(v), list(v.values())) for r, v in last.items()})
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("sha256", pa.string()), ("seq", pa.int64())])
        for batch in batches:
            at, more = batch.column("seq").to_pylist(), []
            for r in roles:
                seqs, values = sent.value[r]
                found = [-1 if s is None else bisect_left(seqs, s) - 1 for s in at]
                more.append(pa.array([None if k < 0 else {"sha256": values[k], "seq": seqs[k]} for k in found], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *roles])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema] + [f"`{r}` {_KIND}" for r in roles])
    return events.mapInArrow(run, schema)


def _by_ranges(events: DataFrame, timeline: DataFrame, roles: list[str]) -> DataFrame:
    block = F.floor(F.col("seq") / BLOCK).alias("__block")
    pair, nothing = F.struct("sha256", "seq"), F.lit(None).cast(_KIND)
    each = {r: F.when(F.col("role") == r, pair) for r in roles}
    latest = timeline.groupBy(block).agg(*[F.max_by(each[r], F.when(F.col("role") == r, F.struct("seq", "sha256"))).alias(r) for r in roles])
    # one row a range: what held when it began
    ranges = events.select(block).distinct().join(latest, "__block", "full_outer")
    before = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    begun = ranges.select("__block", *[F.last(r, ignorenulls=True).over(before).alias(f"__{r}") for r in roles])
    rows = events.select(block, "seq", F.lit(1).alias("__side"), F.struct(*events.columns).alias("__e"), *[nothing.alias(r) for r in roles], F.lit(None).cast("string").alias("sha256"))
    inputs = timeline.select(block, "seq", F.lit(0).alias("__side"), F.lit(None).alias("__e"), *[each[r].alias(r) for r in roles], "sha256")
    # an event comes before inputs of its own number: it doesn't see them
    order = W.partitionBy("__block").orderBy("seq", F.desc("__side"), F.col("sha256")).rowsBetween(W.unboundedPreceding, -1)
    held = rows.unionByName(inputs).select("__block", "__side", "__e", *[F.last(r, ignorenulls=True).over(order).alias(r) for r in roles]).where("__side = 1")
    return held.join(begun, "__block", "left").select("__e.*", *[F.coalesce(r, f"__{r}").alias(r) for r in roles])
