"""Journals as keyed hash chains: sealed in one ordered pass each, piece by piece, verified block by block wherever the rows lie."""

from __future__ import annotations

import functools
import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import hmac_sha256
from annalist.sources.tables import remove, shared

GENESIS = "0" * 64
#: Numbers of one block of a chain when it is verified.
BLOCK = 1 << 16
#: Rows of journals that a task sorts at once when they are sealed.
PART = 1_000_000


class JournalBroken(ValueError):
    """A chain doesn't hold: which journal, which number, and what is wrong."""


def members(*columns: Column) -> Column:
    """A JSON object's text without its braces; nulls are kept."""
    whole = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def front(at: Column, kind: Column, intent: Column, payload: Column) -> Column:
    """An event's canonical JSON up to the digest before it: keys in order, no intent where there is none."""
    named = F.when(intent.isNull(), "").otherwise(F.concat(F.lit(',"operation_intent_sha256":"'), intent, F.lit('"')))
    return F.concat(F.lit("{"), members(at.alias("at"), kind.alias("kind")), named, F.lit(","), members(payload.alias("payload")), F.lit(',"prev":"'))


def back(record_id: Column) -> Column:
    """What stands between that digest and the number."""
    return F.concat(F.lit('",'), members(record_id.alias("record_id")), F.lit(',"seq":'))


def digest(body: Column, key: bytes | None) -> Column:
    return F.sha2(body.cast("binary"), 256) if key is None else hmac_sha256(key, body)


def linked(rows: DataFrame, by: str, order: str, key: bytes | None = None, seq: int = 0, last: str = GENESIS) -> DataFrame:
    """``rows`` with seq, prev, digest: each value of ``by`` is one chain in ``order``, that goes on from number ``seq`` and the
    digest ``last``.

    Rows have the columns ``front`` and ``back`` around the digest before and the number. A digest needs the one before, so a
    chain is hashed by one task, but as a stream of its sorted rows: only the last digest is held, and the time is
    linear in the chain's length. Chains are independent.
    """
    return _passed(rows.repartition(by).sortWithinPartitions(by, order), by, {}, key, seq, last)


def _passed(rows: DataFrame, by: str, heads: dict, key: bytes | None, seq: int, last: str) -> DataFrame:
    """The pass over partitions that are sorted; ``heads``: chains that go on from another number and digest."""
    made = [f for f in rows.schema if f.name not in ("front", "back")]
    names = [f.name for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, n = None, last, None
        for batch in batches:
            chains, fronts, backs = (batch.column(c).to_pylist() for c in (by, "front", "back"))
            seqs, prevs, digests = [], [], []
            for chain, head, tail in zip(chains, fronts, backs, strict=True):
                if chain != now or n is None:
                    now, (n, before) = chain, heads.get(chain, (seq, last))
                n += 1
                body = f"{head}{before}{tail}{n}}}".encode()
                told = hashlib.sha256(body).hexdigest() if key is None else hmac.digest(key, body, "sha256").hex()
                seqs.append(n)
                prevs.append(before)
                digests.append(told)
                before = told
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seqs, pa.int64()), pa.array(prevs, pa.string()), pa.array(digests, pa.string())], names=[*names, "seq", "prev", "digest"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in made], "seq long, prev string, digest string"])
    return rows.mapInArrow(run, schema)


def linked_in_parts(rows: DataFrame, by: str, order: str, add: dict[str, Column], folder: str, key: bytes | None = None, seq: int = 0, last: str = GENESIS) -> DataFrame:
    """As ``linked``, but for chains longer than a task should sort: read from ``folder``, where it is written.

    Rows are dealt by chain and place to pieces of about PART rows. The first pieces of all chains are hashed at once, then the
    second ones, and so on: as many rounds as the longest chain has pieces, each going on from the numbers and digests that the
    round before ended with. A task sorts a piece of a chain. The heads of chains that go on come to the driver, fewer than there are
    pieces. ``add``: the columns ``front`` and ``back``, made as the pieces are read.
    """
    spark, part = rows.sparkSession, "__part"
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    n = max(1, -(-rows.count() // PART))
    rows.repartitionByRange(n, by, order).withColumn(part, F.spark_partition_id()).write.parquet(f"{folder}/parts")  # a file a part, which filters skip by its bounds
    parts = spark.read.schema(f"{listed}, {part} int").parquet(f"{folder}/parts")
    piece, filled = {}, 0  # small parts that follow each other are one piece
    for r in sorted(parts.groupBy(part).count().collect()):
        filled += r["count"]
        piece[r[part]] = (filled - 1) // PART
    # a chain lies in parts that follow each other; those of more than one piece are at most as many as there are parts
    ends = parts.groupBy(by).agg(F.min(part).alias("a"), F.max(part).alias("b")).where("a < b").collect()
    long = {r[by]: (piece[r["a"]], piece[r["b"]]) for r in ends if piece[r["a"]] < piece[r["b"]]}
    of = lambda c, k: F.col(by).eqNullSafe(F.lit(c)) & F.col(part).isin([p for p, q in piece.items() if q == long[c][0] + k])
    heads, made = {}, []
    for k in range(max((b - a for a, b in long.values()), default=0) + 1):
        here = [c for c, (a, b) in long.items() if a + k <= b]
        now = _any(of(c, k) for c in here) if here else F.lit(True)
        if k == 0 and here:  # and all chains that lie in one piece
            now |= ~_any(F.col(by).eqNullSafe(F.lit(c)) for c in here)
        dealt = parts.where(now).withColumns(add).repartition(n if k == 0 else len(here), by).sortWithinPartitions(by, order).drop(part)
        made.append(f"{folder}/sealed/{k}")
        passed = _passed(dealt, by, heads, key, seq, last)
        passed.write.parquet(made[-1])
        going = [c for c in here if long[c][0] + k < long[c][1]]
        if going:
            ended = spark.read.schema(passed.schema).parquet(made[-1]).where(_any(F.col(by).eqNullSafe(F.lit(c)) for c in going))
            heads = {r[by]: (r["seq"], r["digest"]) for r in ended.groupBy(by).agg(F.max("seq").alias("seq"), F.max_by("digest", "seq").alias("digest")).collect()}
    remove(spark, f"{folder}/parts")
    return spark.read.schema(passed.schema).parquet(*made)


def _any(found: Iterator[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, found)


def seal(events: DataFrame, key: bytes | None = None, seq: int = 0, last: str = GENESIS, folder: str | None = None) -> DataFrame:
    """journal, seq, at, kind, record_id, payload, operation_intent_sha256, prev, digest of events (the same without seq, prev
    and digest, but with ``order``).

    A journal holds the events of all its records in one chain. Digests cover every field, with a key as HMAC. ``seq`` and
    ``last`` are the head that the chains go on from. Written to ``folder`` (default: a new one that executors share), which the
    result reads, piece by piece: see ``linked_in_parts``.
    """
    parts = {"front": front(*map(F.col, ("at", "kind", "operation_intent_sha256", "payload"))), "back": back(F.col("record_id"))}
    rows = events.select("journal", "order", "at", "kind", "record_id", "payload", "operation_intent_sha256")
    return linked_in_parts(rows, "journal", "order", parts, folder or shared(events.sparkSession, "sealed"), key, seq, last).drop("order")


def verify(journal: DataFrame, key: bytes | None = None) -> DataFrame:
    """journal, seq, problem for every row of sealed journals, null where all is well.

    gap: the number doesn't follow the one before (from 1); link: prev isn't the stored digest before; altered: the digest
    isn't the row's own under this key. The first that fits. Rows are looked at in blocks of BLOCK numbers, so a
    journal of any length goes to many tasks; a block's first row is held against the last one of the block before,
    one row a block. Of rows with one number the second is a gap.
    """
    j = journal.withColumn("block", F.floor(F.col("seq") / BLOCK))
    last = j.groupBy("journal", "block").agg(F.max("seq").alias("tail_seq"), F.max_by("digest", F.struct("seq", "digest")).alias("tail"))
    order = W.partitionBy("journal", "block").orderBy("seq", "digest")
    j = j.withColumns({"number": F.lag("seq").over(order), "before": F.lag("digest").over(order), "nth": F.row_number().over(order)})
    j = j.join(last.withColumn("block", F.col("block") + 1), ["journal", "block"], "left")
    first = F.col("nth") == 1
    number, before = F.coalesce(F.when(first, F.col("tail_seq")).otherwise(F.col("number")), F.lit(0)), F.coalesce(F.when(first, F.col("tail")).otherwise(F.col("before")), F.lit(GENESIS))
    body = F.concat(front(*map(F.col, ("at", "kind", "operation_intent_sha256", "payload"))), F.coalesce("prev", F.lit("")), back(F.col("record_id")), F.col("seq").cast("string"), F.lit("}"))
    problem = F.when(F.col("seq") != number + 1, "gap").when(~F.col("prev").eqNullSafe(before), "link").when(~F.col("digest").eqNullSafe(digest(body, key)), "altered")
    return j.select("journal", "seq", problem.alias("problem"))


def breaks(verified: DataFrame) -> DataFrame:
    """journal, events, broken_at, problem, sound: the first row of a journal that doesn't hold, and how many hold before it."""
    bad = F.when(F.col("problem").isNotNull(), F.col("seq"))
    told = verified.groupBy("journal").agg(F.count("*").alias("events"), F.min(bad).alias("broken_at"), F.min_by("problem", bad).alias("problem"))
    return told.withColumn("sound", F.coalesce(F.col("broken_at") - 1, F.col("events")))


def verified_scan(journal: DataFrame, key: bytes | None = None) -> DataFrame:
    """The journals' rows, if all chains hold; else JournalBroken names the first break. One row comes to the driver."""
    worst = breaks(verify(journal, key)).where("broken_at is not null").orderBy("journal").first()
    if worst is not None:
        raise JournalBroken(f"journal {worst['journal']}, seq {worst['broken_at']}: {worst['problem']}")
    return journal
