"""Suffix-array dedup: repeated byte strings by buckets of suffixes that are refined on identifiers of later offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import Scratch, hot_keys, released, salted, table, width

#: Lengths of the strings that name a bucket, level by level, before the whole length does.
LEVELS = (32, 64, 128)
#: Bytes of texts that are worked on at once, and starts that one row tells at most.
TOGETHER, LONGEST = 1 << 19, 1024
#: Rows of a bucket that one task resolves; larger buckets are split to smaller ones first.
HOT = 20_000
_BYTES, _OTHERS = np.random.default_rng(12).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def refined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a longer string from those at its front and at a later offset."""
    x = a * _M1
    x ^= x >> np.uint64(32)
    x += b
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def identifiers(codes: np.ndarray, q: int, first: np.ndarray = _BYTES) -> np.ndarray:
    """Of the q bytes at every place: identifiers of half the length, already known, name the buckets of twice the length;
    the last step overlaps where q is no power of two."""
    ids, k = first[codes], 1
    while k < q:
        step = min(k, q - k)
        ids = refined(ids[: len(ids) - step], ids[step:])
        k += step
    return ids


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minima of all stretches of w values."""
    k = 1
    while k < w:
        step = min(k, w - k)
        h = np.minimum(h[: len(h) - step], h[step:])
        k += step
    return h


def pieces(offsets: np.ndarray, least: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, begin, end) of about TOGETHER bytes a list; a longer text is cut so that every string of ``least`` bytes is in one piece."""
    held, size = [], 0
    for i, n in enumerate(np.diff(offsets).tolist()):
        for a in range(0, n - least + 1, TOGETHER):
            held.append((i, a, min(n, a + TOGETHER + least - 1)))
            size += held[-1][2] - a
            if size >= TOGETHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def runs(data: np.ndarray, offsets: np.ndarray, q: int, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of starts of ``least`` bytes whose least identifier of q bytes is the same: (text, at, starts, bucket, inner, from).

    Equal strings have equal least identifiers, so they are in one bucket. ``inner`` tells runs that may hold one string
    twice: where the identifier at a start is itself the least and the run goes on, it comes again later.
    ``from`` is the place in ``data``. q = least: every start has its own string's bucket.
    """
    for some in pieces(offsets, least):
        codes = np.concatenate([data[offsets[i] + a : offsets[i] + b] for i, a, b in some])
        h = identifiers(codes, q)
        m = window_min(h, least - q + 1)
        sizes = np.array([b - a for _, a, b in some])
        begins = np.cumsum(sizes) - sizes
        edge = np.zeros(len(m) + 1, np.int8)
        edge[begins] += 1
        edge[begins + sizes - least + 1] -= 1
        good = np.cumsum(edge[:-1]) > 0
        cut = np.flatnonzero((m[1:] != m[:-1]) | (good[1:] != good[:-1])) + 1
        first = np.concatenate([[0], cut])
        past = np.append(cut, len(m))
        keep = good[first]
        first, past = first[keep], past[keep]
        parts = -(-(past - first) // LONGEST)  # long runs: several rows
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, past = np.repeat(first, parts) + nth * LONGEST, np.repeat(past, parts)
        past = np.minimum(past, first + LONGEST)
        again = np.concatenate([[0], np.cumsum(h[: len(m)] == m)])
        which = np.searchsorted(begins, first, "right") - 1
        text, start = np.array([i for i, _, _ in some])[which], np.array([a for _, a, _ in some])[which]
        at = first - begins[which] + start
        yield text, at, past - first, m[first].view(np.int64), again[past - 1] > again[first], offsets[text] + at


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    c = batch.column(name)
    offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    data = c.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def digest(text: memoryview) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def bucket_names(texts: DataFrame, least: int) -> DataFrame:
    """b, once a run (twice where a run may repeat itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, b, inner, _ in runs(*column(batch, "text"), LEVELS[0], least):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b, 1 + inner))], names=["b"])

    return texts.select("text").mapInArrow(released(run), "b long")


def first_runs(texts: DataFrame, least: int) -> DataFrame:
    """b, d, key, at, len, inner of every run; d is a digest of all bytes that the run's strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "text")
            whole = memoryview(data)
            for text, at, n, b, inner, place in runs(data, offsets, LEVELS[0], least):
                d = [digest(whole[p : p + k]) for p, k in zip(place.tolist(), (n + least - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(d, pa.int64()), batch.column("key").take(pa.array(text)), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(inner)], names=["b", "d", "key", "at", "len", "inner"])

    return texts.select("key", "text").mapInArrow(released(run), "b long, d long, key binary, at int, len int, inner boolean")


def split_runs(held: DataFrame, q: int, least: int) -> DataFrame:
    """b, d, key, at, len, inner, settled, piece: rows of bucket b are refined by the least identifier of q later bytes.

    With q = least a bucket is one string, told by its own digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "piece")
            whole = memoryview(data)
            before, base = batch.column("b").to_numpy().view(np.uint64), batch.column("at").to_numpy()
            for text, at, n, b, inner, place in runs(data, offsets, q, least):
                covered = (n + least - 1).tolist()
                told = covered if q < least else [least] * len(covered)
                d = [digest(whole[p : p + k]) for p, k in zip(place.tolist(), told, strict=True)]
                cut = [bytes(whole[p : p + k]) for p, k in zip(place.tolist(), covered, strict=True)]
                which = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(refined(before[text], b.view(np.uint64)).view(np.int64)), pa.array(d, pa.int64()), batch.column("key").take(which), pa.array((base[text] + at).astype(np.int32)), pa.array(n, pa.int32()), pa.array(inner), batch.column("settled").take(which), pa.array(cut, pa.binary())],
                    names=["b", "d", "key", "at", "len", "inner", "settled", "piece"])

    return held.select("b", "key", "at", "settled", "piece").mapInArrow(released(run), "b long, d long, key binary, at int, len int, inner boolean, settled boolean, piece binary")


def refine(found: DataFrame, box: Scratch, name: str, weight: F.Column, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Buckets sorted by (b, d): which rows are repeated, and one row of each kind that must be looked at further, settled
    if its kind is repeated, with the number of kinds in its bucket.

    A kind (b, d) of weight two or more is settled. A bucket of one kind needs no further look unless its run may repeat
    itself, nor does one whose kinds are all settled.
    """
    kinds = found.groupBy("b", "d").agg(F.sum(weight).alias("n"), F.max("inner").alias("inner"), F.first(F.struct(*columns)).alias("one"))
    kinds = box.save(kinds, f"{name}-kinds")
    twice = kinds.where("n > 1").select("b", "d")
    buckets = kinds.groupBy("b").agg(F.count("*").alias("kinds"), F.max("inner").alias("inner"), F.max(F.col("n") == 1).alias("open"))
    buckets = buckets.where(F.col("open") & ((F.col("kinds") > 1) | F.col("inner"))).select("b", "kinds")
    left = kinds.select("b", "one.*", (F.col("n") > 1).alias("settled")).join(buckets.hint("merge"), "b")
    return found.join(twice.hint("merge"), ["b", "d"], "left_semi"), left


def again(codes: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Which places begin ``least`` bytes, within one piece, that begin elsewhere among the pieces too: a sort by two
    64-bit identifiers, made from those of shorter strings at later offsets. Identifiers are made for about TOGETHER bytes of
    whole pieces at once; only those of starts are kept."""
    ends = np.cumsum(sizes)
    begins, held = ends - sizes, []
    turns = np.flatnonzero(np.diff(begins // TOGETHER, prepend=-1))
    for first, past in zip(turns, [*turns[1:], len(sizes)], strict=True):
        a, b = begins[first], ends[past - 1]
        edge = np.zeros(b - a + 1, np.int8)
        edge[begins[first:past] - a] += 1
        edge[ends[first:past] - a - least + 1] -= 1
        at = np.flatnonzero(np.cumsum(edge[:-1]))
        held.append((at + a, *(identifiers(codes[a:b], least, of)[at] for of in (_BYTES, _OTHERS))))
    at, x, y = (np.concatenate(v) for v in zip(*held, strict=True))
    order = np.argsort(x)
    x, y = x[order], y[order]
    same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    out = np.zeros(len(codes), bool)
    out[at[order[1:][same]]] = out[at[order[:-1][same]]] = True
    return out


def resolve(held: DataFrame, least: int) -> DataFrame:
    """key, at, len of repeated starts in unsettled rows (b, key, at, settled, piece): whole buckets of at most HOT rows are
    resolved together, about TOGETHER bytes at a time."""

    def told(parts: list[tuple[bytes, int, bool, bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(p[3]) for p in parts])
        twice = again(np.frombuffer(b"".join(p[3] for p in parts), np.uint8), sizes, least)
        ends = np.cumsum(sizes)
        turn = np.diff(np.concatenate([[0], twice.view(np.int8), [0]]))
        first, past = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        which = np.searchsorted(ends, first, "right")
        keep = [i for i, w in enumerate(which.tolist()) if not parts[w][2]]
        which, first, past = which[keep], first[keep], past[keep]
        at = np.array([p[1] for p in parts])[which] + first - (ends - sizes)[which]
        return pa.RecordBatch.from_arrays([pa.array([parts[w][0] for w in which.tolist()], pa.binary()), pa.array(at, pa.int32()), pa.array(past - first, pa.int32())], names=["key", "at", "len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, now = [], 0, None
        for batch in batches:
            for b, *part in zip(*(batch.column(c).to_pylist() for c in ("b", "key", "at", "settled", "piece")), strict=True):
                if b != now and size >= TOGETHER:
                    yield told(parts)
                    parts, size = [], 0
                now = b
                parts.append(part)
                size += len(part[3])
        if parts:
            yield told(parts)

    rows = held.select("b", "key", "at", "settled", "piece").repartition(width(held.sparkSession), "b").sortWithinPartitions("b")
    return rows.mapInArrow(released(run), "key binary, at int, len int")


def repeated_starts(texts: DataFrame, least: int, box: Scratch) -> DataFrame:
    """key, at, len: runs of starts whose ``least`` bytes start elsewhere too; ``texts`` (key, text) may repeat rows.

    Starts are named by the least identifier of 32 bytes in their string (equal strings agree in it), which makes a row
    of about every 85 starts; buckets of one row are done with after one count of names. The others are sorted by a
    digest of all their bytes: equal rows are repeated as a whole. What is in a bucket with other bytes goes on, once a
    kind: a bucket's rows meet in one task, where identifiers of all bytes are made from shorter ones and
    sorted. Buckets of over HOT kinds are split before, by the least identifiers of 64, 128 and at last of all bytes.
    """
    spark = texts.sparkSession
    several = bucket_names(texts, least).groupBy("b").count().where("count > 1").select("b")
    alive = box.save(first_runs(texts, least).join(several.hint("merge"), "b", "left_semi"), "alive")
    repeated, left = refine(alive, box, "level1", F.lit(1), ["key", "at", "len"])
    out = repeated.select("key", "at", "len")
    wanted = left.groupBy("key").agg(F.collect_list(F.struct("b", "at", "len", "settled", "kinds")).alias("wanted"))  # of one text
    cut = F.transform("wanted", lambda x: F.struct(x["b"].alias("b"), x["at"].alias("at"), x["settled"].alias("settled"), x["kinds"].alias("kinds"), F.substring("text", x["at"] + 1, x["len"] + least - 1).alias("piece")))
    once = texts.where(F.octet_length("text") >= least).dropDuplicates(["key"])
    held = box.save(once.join(wanted.hint("merge"), "key").select("key", F.inline(cut)), "pieces")
    bounded = held.where(F.col("kinds") <= HOT)
    for q in (*LEVELS[1:], least):
        held = held.where(F.col("kinds") > HOT)
        if held.isEmpty():
            break
        found = box.save(split_runs(held, q, least).repartition(width(spark), "b", "d"), f"split{q}")
        each = F.when(F.col("settled"), 2).otherwise(1)
        repeated, held = refine(found, box, f"level{q}", each if q < least else each * F.col("len"), ["key", "at", "piece"])
        out = out.unionByName(repeated.where(~F.col("settled")).select("key", "at", "len"))
        bounded = bounded.unionByName(held.where(F.col("kinds") <= HOT))
    return out.unionByName(resolve(bounded, least))


def remove_spans(rows: DataFrame, least: int) -> DataFrame:
    """doc_id, n_bytes, removed (maximal runs as begin, end), kept of rows (doc_id, text, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "text")
            whole, spans, kept = memoryview(data), [], []
            for k, starts in enumerate(batch.column("starts").to_pylist()):
                text, mine = whole[offsets[k] : offsets[k + 1]], []
                for x in sorted(starts or (), key=lambda x: x["at"]):
                    end = x["at"] + x["len"] + least - 1
                    if mine and x["at"] <= mine[-1]["end"]:
                        mine[-1]["end"] = max(mine[-1]["end"], end)
                    else:
                        mine.append({"begin": x["at"], "end": end})
                at = 0
                out = []
                for x in mine:
                    out.append(text[at : x["begin"]])
                    at = x["end"]
                spans.append(mine)
                kept.append(b"".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "starts").mapInArrow(released(run), f"doc_id {kind}, n_bytes long, removed array<struct<begin:int,end:int>>, kept binary")


def remove_repeated_bytes(docs: DataFrame, least: int = 200) -> DataFrame:
    """doc_id, n_bytes, removed, kept for every row of ``docs`` (doc_id, text): bytes covered by a string of ``least``
    bytes that also starts anywhere else, in the same row or another, are removed.

    Matches never cross rows; strings are judged on the input. ``removed`` has the maximal runs (0-based begin, end),
    ``kept`` the bytes left, which may cut a character. Null texts are empty. Rows that repeat a text (whatever their
    doc_id) lose all of it if it has ``least`` bytes; null and repeated doc_ids are separate rows. A very long text is
    worked on piece by piece. An empty table gives an empty result; other columns are ignored.

    Texts are known by 128 bits of SHA-256, rows of a bucket by 128 bits (identifier and digest). ``least`` over 128.
    """
    if least <= LEVELS[-1]:
        raise ValueError(f"least must be over {LEVELS[-1]}")
    box = Scratch(docs.sparkSession, "suffixes")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    found = repeated_starts(rows.select("key", "text"), least, box)
    starts = found.groupBy("key").agg(F.collect_set(F.struct("at", "len")).alias("starts"))  # of one text
    return remove_spans(salted(rows, starts, "key", hot_keys(rows.select("key"), "key"), F.col("doc_id")), least)


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT rid, 128 * j AS base, h[256 * j + 1 : 256 * j + 654] AS h FROM d, range(0, CAST((length(h) // 2 - 72) // 128 AS BIGINT)) t(j)),
w AS MATERIALIZED (SELECT rid, base + i AS pos, md5(h[2 * i + 1 : 2 * i + 400]) AS m FROM c, range(0, 128) t(i) WHERE 2 * i + 400 <= length(h)),
r AS (SELECT rid, pos FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
b AS (SELECT rid, pos, pos - lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS gap FROM r),
g AS (SELECT rid, pos, count(*) FILTER (gap IS NULL OR gap > 200) OVER (PARTITION BY rid ORDER BY pos) AS g FROM b),
s AS MATERIALIZED (SELECT rid, g, min(pos) AS a, max(pos) + 200 AS e FROM g GROUP BY rid, g),
k AS (SELECT rid, a, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS f FROM s),
o AS (SELECT rid, sum(e - a) AS gone, count(*) AS n, max(e) AS tail FROM s GROUP BY rid),
p AS (SELECT k.rid, string_agg(d.h[2 * f + 1 : 2 * a], '' ORDER BY a) AS front FROM k JOIN d USING (rid) GROUP BY k.rid)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(o.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(o.n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(p.front, '') || d.h[2 * coalesce(o.tail, 0) + 1 :])) AS kept_sha256
FROM d LEFT JOIN o USING (rid) LEFT JOIN p USING (rid)
"""

QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
SQL = {"op12_suffix_dedup": OP12_SQL}
