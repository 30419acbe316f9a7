"""Embedding whitening: a QR tree over blocks of centred rows, then one-sided Jacobi rotations of what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import Scratch, table
from annalist.llm.quantised import column_sums, matrix, usable, whole_numbers

#: Rows that one QR step takes at once, and triangles that one task merges.
BLOCK, FAN = 4096, 32


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n with one rounding: the differences n*x - S are whole numbers (longer than 64 bits only for huge n)."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums.tolist()), default=0) < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    return ((n * x.astype(object) - sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums over the dimensions of (n*x - S)^2, exactly; None where 64 bits can't hold one."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums.tolist()), default=0)
    if most * most * x.shape[1] < 1 << 63:
        d = n * x - sums.astype(np.int64)
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - sums
    return [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


def triangle(fit: DataFrame, box: Scratch, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows' QR decomposition: each task folds its blocks into one, then FAN triangles become one, level
    by level; at most FAN of them (dims x dims numbers each) are in a task, the last one comes to the driver."""
    dims = len(sums)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = matrix(batch, "x", dims)
            for at in range(0, len(x), BLOCK):
                y = centred(x[at : at + BLOCK], n, sums)
                r = stacked([y] if r is None else [r, y])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "r"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = stacked([np.asarray(v).reshape(-1, dims) for v in pdf.sort_values("part")["r"]])
        return pd.DataFrame({"part": [int(key[0])], "r": [r.ravel()]})

    now = box.save(fit.mapInArrow(leaves, "part int, r array<double>"), "triangles")
    level = 0
    while now.count() > 1:
        level += 1
        now = box.save(now.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInPandas(merge, "part int, r array<double>"), f"triangles{level}")
    r = np.asarray(now.first()["r"]).reshape(-1, dims)
    return np.concatenate([r, np.zeros((max(0, dims - len(r)), dims))])


def rounds_of_pairs(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of m columns in rounds of disjoint ones, like games of a tournament (an odd one out sits idle)."""
    ring = list(range(m + m % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[: half - 1 : -1], strict=True) if max(a, b) < m]
        yield np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of r by one-sided Jacobi rotations.

    Each rotation makes two columns orthogonal; disjoint pairs turn at once. Ends when in a whole sweep no pair was
    farther from orthogonal than rounding. Each vector's largest component is positive.
    """
    a, v = r.astype(np.float64), np.eye(r.shape[1])
    eps = np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for i, j in rounds_of_pairs(a.shape[1]):
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            todo = np.abs(xy) > eps * np.sqrt(xx * yy)
            if not todo.any():
                continue
            turned = True
            i, j, x, y, xx, yy, xy = i[todo], j[todo], x[:, todo], y[:, todo], xx[todo], yy[todo], xy[todo]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            p, q = v[:, i], v[:, j]
            v[:, i], v[:, j] = c * p - s * q, s * p + c * q
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    sigma, v = sigma[order], v[:, order]
    return sigma, v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def identity_gap(fit: DataFrame, n: int, sums: np.ndarray, axes: np.ndarray) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity: means first, then centred products."""
    dims, k = axes.shape

    def moments(mean: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if mean is None else k * k)
            for batch in batches:
                w = centred(matrix(batch, "x", dims), n, sums) @ axes
                total += w.sum(0) if mean is None else ((w - mean).T @ (w - mean)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "s"])

        rows = fit.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # k or k x k numbers
        return np.array([r["s"] for r in rows]) / n

    return float(np.abs(moments(moments(None)).reshape(k, k) - np.eye(k)).max(initial=0.0))


def whiten(embeddings: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row of ``embeddings``
    (vec_id, embedding) and each of the first components.

    Components of a vector become x = floor(scale * c). The fit list has each distinct x once, grouped before and after the
    shuffle, so copies of any number weigh nothing. Sums are exact; rows less their mean, from whole numbers with one
    rounding, are folded into a triangle R by a tree of QR steps (never a covariance, whose squares would lose half the
    digits), and plane rotations on the driver make R's columns orthogonal: dims x dims numbers, whatever the
    table. Standard deviations are their lengths over sqrt(n).

    Left out: vectors that are null, empty, hold null or non-finite components, or aren't of the most common length
    (ties: the longer). Components beyond 2^24 / scale count as that. A component without variance (fewer distinct
    vectors than dimensions) has null ``whitened``, no share in ``identity_error`` and 0 ``explained`` (null where nothing
    varies). ``deviation`` is null where 64 bits can't hold it. Vectors with fewer dimensions than ``components`` have that
    many rows. Rows that share a vec_id or have none are separate. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    box = Scratch(spark, "whitening")
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = embeddings.select("vec_id", "embedding").where(usable())
    lengths = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["d"]
    rows = good.where(F.size("embedding") == dims).select("vec_id", whole_numbers(scale).alias("x"))
    fit = box.save(rows.select("x").distinct(), "fit")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dims, np.int64)
        for batch in batches:
            n, s = n + batch.num_rows, s + matrix(batch, "x", dims).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.int64()))], names=["g", "n", "s"])

    n, s = column_sums(fit, totals)[0]
    sums = np.array(s, object)
    sigma, v = jacobi(triangle(fit, box, n, sums))
    varied = sigma > dims * np.finfo(np.float64).eps * sigma[0]
    squares, k = np.where(varied, sigma * sigma, 0.0), min(components, dims)
    explained = [float(e) for e in squares[:k] / squares.sum()] if varied.any() else [None] * k
    live = np.flatnonzero(varied[:k])
    axes = v[:, live] * (np.sqrt(n) / sigma[live])
    gap = identity_gap(fit, n, sums, axes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, "x", dims)
            w, known = np.zeros((len(x), k)), np.zeros((len(x), k), bool)
            w[:, live], known[:, live] = centred(x, n, sums) @ axes, True
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(each), n, np.int64)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                 pa.array(w.ravel(), mask=~known.ravel()), pa.array(explained * len(x), pa.float64()), pa.array(np.full(len(each), gap))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
SQL: dict[str, str] = {}
