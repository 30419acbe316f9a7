"""Centroid clustering: Lloyd's rounds over distinct quantised vectors with multiplicities, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import HOT_ROWS, Scratch, table
from annalist.llm.quantised import column_sums, matrix, usable, whole_numbers


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row (ties: the smaller number) and the squared distance, exactly.

    Products go through floating point only where every sum stays below 2^53, that is, where they are exact there.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None]
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def sums_by_cluster(x: np.ndarray, mult: np.ndarray, best: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Adds multiplicities and weighted vectors to the totals of their clusters."""
    order = np.argsort(best, kind="stable")
    found, begin = np.unique(best[order], return_index=True)
    sums[found] += np.add.reduceat(x[order] * mult[order, None], begin)
    counts[found] += np.add.reduceat(mult[order], begin)


def lloyd_round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floors of exact means; those without vectors stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, "x", dims)
                sums_by_cluster(x, batch.column("mult").to_numpy(), nearest(x, centroids)[0], counts, sums)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], names=["g", "n", "s"])

    out = centroids.copy()
    for g, (n, s) in column_sums(distinct, run).items():
        out[g] = [v // n for v in s]
    return out


def weighted_lloyd(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable row of ``embeddings``
    (vec_id, embedding).

    Components become floor(scale * c); equal vectors are one row with a multiplicity, grouped with partial counts before
    the shuffle, so copies cost nothing in the rounds. The first centroids are the k vectors of the smallest
    sha256 of ``seed:vec_id``. A round assigns every distinct vector (one pass over a saved table; ties: the smaller
    number) and takes floors of exact weighted means; k x dims sums come to the driver. The last assignment goes
    back to the rows by a join on the vector; those of a vector with very many rows are dealt to many tasks.

    Left out: vectors that are null, of another length, or hold null or non-finite components. Components beyond
    2^24 / scale count as that. Fewer than k usable rows make that many clusters. Rows with a null vec_id never are
    first centroids but are assigned; rows that share one are separate (the same hash: the smaller vector first).
    Sums fit 64 bits up to 5 * 10^11 rows. An empty table gives an empty result; other columns are ignored.
    """
    spark = embeddings.sparkSession
    box = Scratch(spark, "clusters")
    rows = embeddings.select("vec_id", "embedding").where(usable(dims)).select("vec_id", whole_numbers(scale).alias("x"))
    distinct = box.save(rows.groupBy("x").agg(F.count("*").alias("mult")), "distinct")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where(F.col("vec_id").isNotNull()).select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)  # rows without any vec_id are one cluster
    for _ in range(rounds):
        centroids = lloyd_round(distinct, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(matrix(batch, "x", dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("mult"), pa.array(best, pa.int32()), pa.array(distance)], names=["x", "mult", "cluster", "distance"])

    assigned = box.save(distinct.mapInArrow(assign, "x array<int>, mult long, cluster int, distance long"), "assigned")
    whole = F.col("distance").cast("decimal(20,0)") * F.col("mult").cast("decimal(18,0)")
    told = assigned.groupBy("cluster").agg(F.sum(whole).alias("inertia"), F.sum("mult").alias("n")).collect()  # k rows
    inertia = sum(int(r["inertia"]) for r in told)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    clusters = spark.createDataFrame([(r["cluster"], int(r["inertia"]), inertia, names[r["cluster"]]) for r in told], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # vectors of very many rows: 10,000 at most
    limit = max(HOT_ROWS, sum(r["n"] for r in told) // 10_000)
    hot = F.broadcast(assigned.where(F.col("mult") > limit).select(F.col("x").alias("hx"), F.ceil(F.col("mult") / limit).cast("int").alias("salts")))
    parts = F.coalesce("salts", F.lit(1))
    left = rows.join(hot, F.col("x") == F.col("hx"), "left").select("vec_id", "x", F.xxhash64("x").alias("h"), F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("salt"))
    right = assigned.join(hot, F.col("x") == F.col("hx"), "left").select("x", "cluster", "distance", F.xxhash64("x").alias("h"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    out = left.join(right.hint("merge"), ["h", "salt", "x"]).join(F.broadcast(clusters), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return weighted_lloyd(table(spark, sf_dir, "embeddings"))


def _rounds(rounds: int) -> str:
    """Assignment and new centroids of every round, then the last assignment, as CTEs a0, c1, a1, ..."""
    out = ""
    for r in range(rounds + 1):
        out += f"""
d{r} AS MATERIALIZED (
  SELECT q.x, q.mult, c.cluster, list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM q, c{r} c),
a{r} AS MATERIALIZED (SELECT x, any_value(mult) AS mult, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d{r} GROUP BY x),
"""
        if r < rounds:
            out += f"""
s{r} AS (SELECT cluster, i, sum(x[i] * mult) AS s, sum(mult) AS n FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster)),
"""
    return out


OP11_SQL = f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
q AS MATERIALIZED (SELECT x, count(*) AS mult FROM e GROUP BY x),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x
  FROM (SELECT sha256('2:' || vec_id) AS h, x FROM e WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 40)),
{_rounds(5)}
t AS (SELECT cluster, CAST(sum(d * mult) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY cluster)
SELECT e.vec_id, a.cluster, a.d AS distance, t.cluster_inertia, (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM t) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM e JOIN a5 a ON e.x = a.x JOIN t USING (cluster) JOIN c5 c USING (cluster)
"""

QUERIES = {"op11_centroid_clusters": op11_centroid_clusters}
SQL = {"op11_centroid_clusters": OP11_SQL}
