"""Vectors as whole numbers: what clustering and whitening count exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are held within plus and minus this, so that squares of 8,000 dimensions still fit 64 bits.
LARGEST = 1 << 24


def usable(dims: int | None = None) -> F.Column:
    """Whether ``embedding`` is a vector (of ``dims`` components) without null and non-finite ones."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    size = F.size("embedding") > 0 if dims is None else F.size("embedding") == dims
    return F.col("embedding").isNotNull() & size & ~F.coalesce(bad, F.lit(True))


def whole_numbers(scale: int = 256) -> F.Column:
    """``embedding`` as array<int>: floor(scale * c) of every component as double, held within LARGEST."""
    return F.transform("embedding", lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))


def matrix(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    """A column of arrays of equal length as rows of 64-bit integers."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def column_sums(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[int, tuple[int, list[int]]]:
    """Exact sums by group: ``run`` gives (g int, n long, s array<long>) once a task for each of a bounded number of
    groups; the result, by group, has the sum of n and of each place of s."""
    parts = rows.mapInArrow(run, "g int, n long, s array<long>")
    each = parts.select("g", "n", F.posexplode("s").alias("i", "s")).groupBy("g", "i").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.orderBy("g", "i").collect():  # groups times dimensions
        out.setdefault(r["g"], (int(r["n"]), []))[1].append(int(r["s"]))
    return out
