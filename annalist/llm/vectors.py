"""Embedding near-dedup: an exact all-pairs join of packed blocks, whose disk grows with the vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import Scratch, table
from annalist.llm.components import connected_components

#: Vectors of a block: as many are compared with as many others at once.
BLOCK = 2048
#: Numbers that a block has for its vectors.
WIDTH = 1 << 16
_TYPES = {"float": np.float32, "double": np.float64}


def usable(v) -> np.ndarray | None:
    """The vector in double precision, or None: null, empty, zero, or with a null or non-finite component."""
    if v is None or len(v) == 0:
        return None
    x = np.asarray(v, dtype=np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    return x


def keyed(embeddings: DataFrame) -> DataFrame:
    """vec_id, key (digest of the components; null if not usable), embedding (in single precision if the table's is)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = []
            for v in pdf["embedding"]:
                x = usable(v)
                keys.append(None if x is None else hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).hexdigest())
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "key": pd.Series(keys, dtype=object), "embedding": pdf["embedding"]})

    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, key string, embedding {kind}"
    return embeddings.select("vec_id", F.col("embedding").cast(kind).alias("embedding")).mapInPandas(run, schema)


def unit(vectors) -> np.ndarray:
    x = vectors.astype(np.float64) if isinstance(vectors, np.ndarray) else np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Pivots:
    """Unit vectors in two levels: about the square root of them on top, each with a list of those nearest to it.

    A cell is a top pivot and one of its list. Distances between pivots are only needed inside the top level and inside
    each list, so k pivots take about k^1.5 numbers instead of k^2; they are computed once a task.
    """

    def __init__(self, points: np.ndarray):
        self.top = points[: max(1, round(len(points) ** 0.5))]
        owner = (points @ self.top.T).argmax(1)
        owner[: len(self.top)] = np.arange(len(self.top))  # equal pivots keep a list each
        self.lists = [points[owner == j] for j in range(len(self.top))]
        self.offset = np.cumsum([0, *map(len, self.lists)])
        self.apart: list[np.ndarray] | None = None

    @staticmethod
    def _between(points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * points @ points.T, 0))

    @staticmethod
    def _near(squares: np.ndarray, apart: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of every row, and which pivots y's within ``radius`` of it may be nearest to.

        A vector y is no farther from its own pivot q than from p, the nearest of x. By the triangle inequality (in its
        form for the plane between p and q) x can be within ``radius`` of such a y only if
        (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) <= radius.
        """
        best = squares.argmin(1)
        return best, squares - squares[np.arange(len(squares)), best][:, None] <= 2 * apart[best] * radius + 1e-9

    def place(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """For unit vectors: the home cell, and the lower-numbered cells they must visit. The rule holds on top, and again in
        the list of every top pivot that it leaves. Visiting lower cells is enough: a pair meets in the lower of its two home
        cells, once."""
        if self.apart is None:
            self.apart = [self._between(self.top), *map(self._between, self.lists)]
        squares = lambda rows, points: np.maximum(2 - 2 * rows @ points.T, 0)
        top, goes = self._near(squares(x, self.top), self.apart[0], radius)
        home, visits = np.empty(len(x), np.int64), [[] for _ in x]
        for j, points in enumerate(self.lists):
            rows = np.flatnonzero(goes[:, j] & (j <= top))
            if not len(rows):
                continue
            best, near = self._near(squares(x[rows], points), self.apart[1 + j], radius)
            mine = top[rows] == j
            home[rows[mine]] = self.offset[j] + best[mine]
            near[mine] &= np.arange(len(points)) < best[mine, None]
            for r, cells in zip(rows.tolist(), near, strict=True):
                visits[r].append(self.offset[j] + np.flatnonzero(cells))
        return home, [np.concatenate(v) if v else np.empty(0, np.int64) for v in visits]


def close_pairs(a: np.ndarray, b: np.ndarray, raw_a: list, raw_b: list, least: float) -> np.ndarray:
    """Boolean matrix of cosine >= least; products within 1e-9 of it are computed again from the raw components."""
    m = a @ b.T
    out = m >= least
    for i, j in zip(*np.nonzero(np.abs(m - least) < 1e-9), strict=True):
        x, y = np.asarray(raw_a[i], np.float64), np.asarray(raw_b[j], np.float64)
        out[i, j] = float(x @ y) / float(np.sqrt((x @ x) * (y @ y))) >= least
    return out


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a bipartite boolean matrix, the component label of each row and column (the least row number in it)."""
    n, m = linked.shape
    row, col = np.arange(n), np.full(m, n)
    while True:
        new_col = np.where(linked, row[:, None], n).min(0)
        new_row = np.minimum(row, np.where(linked, new_col[None], n).min(1))
        if (new_row == row).all() and (new_col == col).all():
            return row, col
        row, col = new_row, new_col


def packed(classes: DataFrame) -> DataFrame:
    """block, dims, keys, mults, least_ids, data: classes (key, mult, least_id, embedding) in blocks of BLOCK vectors of one length."""
    kind = classes.schema["embedding"].dataType.elementType.simpleString()
    least_id = classes.schema["least_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 20  # blocks are numbered by task, and then as they are made

        def block(rows: list) -> pd.DataFrame:
            nonlocal made
            keys, mults, least_ids, raw = (list(c) for c in zip(*rows, strict=True))
            made += 1
            data = np.stack([np.asarray(v) for v in raw]).astype(_TYPES[kind]).tobytes()
            return pd.DataFrame({"block": [made - 1], "dims": [len(raw[0])], "keys": [keys], "mults": [mults], "least_ids": [least_ids], "data": [data]})

        for pdf in batches:
            for row in zip(pdf["key"], pdf["mult"], pdf["least_id"], pdf["embedding"], strict=True):
                some = held.setdefault(len(row[3]), [])
                some.append(row)
                if len(some) == BLOCK:
                    yield block(held.pop(len(row[3])))
        for some in held.values():
            yield block(some)

    schema = f"block long, dims int, keys array<string>, mults array<long>, least_ids array<{least_id}>, data binary"
    return classes.select("key", "mult", "least_id", "embedding").mapInPandas(run, schema)


def range_join(embeddings: DataFrame, least: float = 0.9, pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding).

    Equal vectors are one class with a multiplicity, so copies are never paired. Class representatives are packed in
    blocks of BLOCK vectors, and each pair of blocks is one row of a Cartesian product, which reads both sides from the shared folder: no
    vector is written or shuffled once a pair, so disk grows with the vectors. All pairs of classes are compared: products in
    single precision rule out what is farther from ``least`` than their error bound, the rest is compared in double
    precision. A pair of blocks returns counts and spanning links, not pairs. ``pivots`` has no effect any more.

    Vectors that are null, zero, or hold null or non-finite components link with nothing: n_links 0, component_id
    their own vec_id. Vectors of different lengths don't link. Rows with one vec_id are separate rows. An empty
    table gives an empty result; other columns are ignored. Cosine is exactly symmetric and in double precision.
    """
    spark = embeddings.sparkSession
    box = Scratch(spark, "vectors")
    rows = keyed(embeddings)
    parts = max(1, -(-embeddings.count() // BLOCK))
    grouped = rows.where(F.col("key").isNotNull()).repartition(parts, "key").groupBy("key")
    classes = grouped.agg(F.count("*").alias("mult"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least_id"))
    blocks = box.save(packed(classes), "blocks")
    kind = classes.schema["embedding"].dataType.elementType.simpleString()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, kept, a_unit, a_single = None, None, None, None
        for pdf in batches:
            out = []
            for i, j, dims, a_mult, b_mult, a_data, b_data in zip(*(pdf[c] for c in ("a_block", "b_block", "dims", "a_mults", "b_mults", "a_data", "b_data")), strict=True):
                if i != name:  # the left block stays for many right ones
                    kept = np.frombuffer(a_data, _TYPES[kind]).reshape(-1, dims)
                    name, a_unit = i, unit(kept)
                    a_single = a_unit.astype(np.float32)
                a = kept
                b = np.frombuffer(b_data, _TYPES[kind]).reshape(-1, dims)
                b_unit = unit(b)
                near = a_single @ b_unit.astype(np.float32).T >= least - (dims + 8) * 1.2e-7
                if i == j:
                    near = np.triu(near, 1)
                r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(r):
                    continue
                near = near[np.ix_(r, c)] & close_pairs(a_unit[r], b_unit[c], a[r], b[c], least)
                rows_in, cols_in = near.any(1), near.any(0)
                if not rows_in.any():
                    continue
                near, r, c = near[np.ix_(rows_in, cols_in)], r[rows_in], c[cols_in]
                row, col = spanning(near)
                ids = np.concatenate([i * WIDTH + r, j * WIDTH + c])
                n = np.concatenate([near @ np.asarray(b_mult)[c], near.T @ np.asarray(a_mult)[r]])
                out.append(pd.DataFrame({"id": ids, "root": np.concatenate([i * WIDTH + r[row], i * WIDTH + r[col]]), "n": n}))
            if out:
                yield pd.concat(out)

    side = lambda name: blocks.select(*(F.col(c).alias(f"{name}_{c}") for c in ("block", "dims", "mults", "data")))
    # not written as an equality, which would deal the pairs out by length: as a rule all vectors have one
    meet = (F.col("a_block") <= F.col("b_block")) & (F.col("a_dims") - F.col("b_dims") == 0)
    pairs = side("a").hint("shuffle_replicate_nl").join(side("b"), meet).withColumnRenamed("a_dims", "dims").drop("b_dims")
    found = box.save(pairs.mapInPandas(compare, "id long, root long, n long").groupBy("id", "root").agg(F.sum("n").alias("n")), "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = blocks.select("block", F.posexplode(F.arrays_zip("keys", "mults", "least_ids")).alias("k", "x"))
    named = named.select((F.col("block") * WIDTH + F.col("k")).alias("id"), F.col("x.keys").alias("key"), F.col("x.mults").alias("mult"), F.col("x.least_ids").alias("least_id"))
    named = named.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").join(counts, "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    first = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(first, "root").select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""

QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
SQL = {"op7_embedding_dedup": OP7_SQL}
