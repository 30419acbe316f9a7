"""Transitive freshness: which artifacts of a record may be used, and the earliest cause why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def topological(steps) -> list:
    """Steps in an order in which producers come first; of those that are ready, the first of the table. A cycle is an error."""
    makes, done, out, left = {s[3] for s in steps}, set(), [], list(steps)
    while left:
        ready = next((s for s in left if all(a in done or a not in makes for a in s[2].split())), None)
        if ready is None:
            raise ValueError("the step graph has a cycle")
        left.remove(ready)
        out.append(ready)
        done.add(ready[3])
    return out


def evaluate(records: DataFrame, steps) -> DataFrame:
    """record_id, artifact, usable, cause for records (record_id, have map<artifact, seq>), all artifacts of the steps.

    An artifact is usable if it is there, came after all its inputs, and these are usable. ``cause``: ``absent ARTIFACT``,
    ``older ARTIFACT`` (than an input), or that of its first unusable input; null if usable. The graph is a constant,
    so the fixpoint is one pass of column expressions in topological order. A null map has no artifacts.
    """
    d = records.select("record_id", F.coalesce("have", F.create_map().cast("map<string,bigint>")).alias("have"))
    order = topological(steps)
    name = {s[3]: f"c{k}" for k, s in enumerate(order)}
    at = lambda a: F.try_element_at("have", F.lit(a))
    for _, _, needs, makes, _ in order:
        cause: Column = F.when(at(makes).isNull(), F.lit(f"absent {makes}"))
        inherited = [F.col(name[a]) for a in needs.split() if a in name]
        older = F.lit(False)
        for a in needs.split():
            older = older | F.coalesce(at(a) > at(makes), F.lit(False))
        d = d.withColumn(name[makes], F.coalesce(*inherited, cause, F.when(older, F.lit(f"older {makes}"))) if inherited else F.coalesce(cause, F.when(older, F.lit(f"older {makes}"))))
    rows = F.array(*[F.struct(F.lit(a).alias("artifact"), F.col(c).isNull().alias("usable"), F.col(c).alias("cause")) for a, c in name.items()])
    return d.select("record_id", F.inline(rows))
