"""Shared pieces: reading tables, shared-folder scratch tables, words."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as ``[\x20\x09-\x0D]``; ``bytes.split()`` splits on the same six bytes.
BLANK = r"[\x20\x09-\x0D]+"


#: Texts that a Python worker gets at once; with long texts Spark's own limit of bytes a batch comes first.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Fewer texts a batch than Spark's default, unless the session sets fewer itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; where it is unset and Spark runs in one
    process (tests), a folder of our own. On a cluster without the setting this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="annalist-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle whose later work is CPU-heavy, so that AQE doesn't merge them by bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)


def released(run):
    """A function of batches that gives back what it freed once it is done.

    Python workers are used again by later stages; Arrow's pool and malloc would hold on to the memory of a stage's peak.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # glibc's
                trim(0)

    return wrapped


_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """The folders of all Scratch instances that the block makes, for ``remove`` once nothing reads them any more."""
    mine: list[str] = []
    token = _made.set(mine)
    try:
        yield mine
    finally:
        _made.reset(token)


class Scratch:
    """Intermediate tables as Parquet in the shared folder, so that a lost executor costs no recomputation.

    ``save`` writes and rereads; ``drop`` deletes tables that nothing reads any more. Results are lazy and read these
    tables, so what is left stays until the caller is done: ``collected`` tells which folders a block of code made.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.n = 0
        if (made := _made.get()) is not None:
            made.append(self.base)

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> str:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        self.paths[name] = path
        return path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, name))

    def drop(self, *names: str) -> None:
        remove(self.spark, *(self.paths.pop(name) for name in names))


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, wherever they are; those that are gone don't matter."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


_BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = np.ones((2, 1), np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """Powers of the base and of its inverse modulo 2^64, kept for the longest text so far."""
    global _powers
    if _powers.shape[1] < n:
        each = np.empty((2, max(n, 1 << 16)), np.uint64)
        each[0], each[1], each[:, 0] = _BASE, pow(_BASE, -1, 1 << 64), 1
        _powers = np.multiply.accumulate(each, axis=1)
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words (``text.split()``), all at once: sums of random byte values times powers."""
    a = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[a], [True]]).view(np.int8)))
    first, past = edges[::2], edges[1::2]
    up, down = _powers_to(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTES[a] * up[: len(a)], out=sums[1:])
    h = (sums[past] - sums[first]) * down[first]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


#: Bytes of texts that are hashed at once.
TOGETHER = 1 << 20


def _pieces(text: bytes) -> list[bytes]:
    """A text in pieces of about TOGETHER bytes, cut at blanks; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > TOGETHER:
        cut = at + TOGETHER
        blank = _BLANK[np.frombuffer(text, np.uint8, offset=cut)].argmax() if len(text) > cut else 0
        if not _BLANK[text[cut + blank]]:
            break
        out.append(text[at : cut + blank])
        at = cut + blank
    return [*out, text[at:]]


def hash_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the 64-bit hashes of all words in order; many texts are hashed at once."""
    counts, hashes, held, size = np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            joined = b"\n".join(t for _, t in held)
            a = _BLANK[np.frombuffer(joined, np.uint8)]
            first = np.flatnonzero(~a & np.concatenate([[True], a[:-1]])) if len(a) else np.empty(0, np.int64)
            ends = np.cumsum([len(t) + 1 for _, t in held])
            n = np.diff(np.searchsorted(first, ends), prepend=0)
            np.add.at(counts, [i for i, _ in held], n)
            hashes.append(word_hashes(joined))
            held, size = [], 0

    for i, text in enumerate(texts):
        for piece in _pieces(text) if text else ():
            held.append((i, piece))
            size += len(piece)
            if size >= TOGETHER:
                flush()
    flush()
    return counts, np.concatenate(hashes) if hashes else np.empty(0, np.uint64)


#: Rows of one key that may meet in one task of a join.
HOT_ROWS = 10_000


def hot_keys(rows: DataFrame, key: str, least: int = HOT_ROWS) -> DataFrame:
    """key, salts: the keys of more than ``least`` rows, or of one in 10,000 of all rows if that is more, and the number of
    parts to deal them to. These are 10,000 rows at most, whatever the table, so they can be broadcast."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    limit = F.greatest(F.lit(least), F.ceil(F.col("total") / 10_000))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("salts"))


def salted(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, by: F.Column) -> DataFrame:
    """Left join of ``many`` with ``one`` (one row a key) on ``key``: the rows of a hot key are dealt out by ``by``, and
    that key's row of ``one`` goes to each part."""
    parts = F.broadcast(hot.withColumnsRenamed({key: "__hot", "salts": "__salts"}))
    left = many.join(parts, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__hot", "__salts")
    right = one.join(parts, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__hot", "__salts")
    return left.join(right.hint("merge"), [key, "__salt"], "left").drop("__salt")


def crc_mod(key: str, m: int) -> F.Column:
    """crc32 of the key as text, modulo m (null key: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(m)


def frames(rows: int = 20_000, **columns):
    """Slices of a table as DataFrames; texts stay Python objects, so that Arrow never gets a chunked column."""
    import pandas as pd

    columns = {k: pd.Series(list(v), dtype=object) if len(v) and isinstance(v[0], str | bytes) else pd.Series(v) for k, v in columns.items()}
    whole = pd.DataFrame(columns)
    for k in range(0, len(whole), rows):
        yield whole.iloc[k : k + rows]
