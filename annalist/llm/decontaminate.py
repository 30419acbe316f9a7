"""Benchmark decontamination by suffix arrays over shards of documents, searched for every benchmark suffix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm.common import Scratch, released, table

#: Words are runs of ASCII digits and letters and of all other characters: in UTF-8, of these bytes. A-Z are lowered.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def bench_words(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text is not None else []


class SuffixArray:
    """Suffixes of a shard (word ids, one array for many documents), sorted by their first ``depth`` words.

    ``breaks`` are ids below 0: each differs from every other, so that no match crosses one. Only suffixes that
    begin with a word of the benchmark's vocabulary are kept: no other can begin a match.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        rank = np.where(ids < 0, -1 - np.arange(n, dtype=np.int64), ids.astype(np.int64))
        rank = rank - rank.min() if n else rank
        self.ids, self.depth, step = ids, 1, 1
        while step < depth:  # prefix doubling: ranks by the first 1, 2, 4, ... words
            after = np.zeros(n, np.int64)
            after[: max(n - step, 0)] = rank[step:] + 1
            pair = rank * np.int64(rank.max() + 2 if n else 1) + after
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            step *= 2
        begin = np.flatnonzero(ids >= 0)
        self.order = begin[np.argsort(rank[begin], kind="stable")]

    def bounds(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of ``words`` (padded), the range of suffixes that begin with the row's first ``lengths`` words."""
        return self._search(words, lengths, False), self._search(words, lengths, True)

    def _search(self, words: np.ndarray, lengths: np.ndarray, past: bool) -> np.ndarray:
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), len(self.order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            below = self._compare(words, lengths, np.where(open_, mid, 0), open_)
            right = open_ & ((below <= 0) if past else (below < 0))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    def _compare(self, words, lengths, mid, open_) -> np.ndarray:
        """-1, 0, 1: the suffix at ``mid``, cut to the query's length, against the query. Breaks sort by place."""
        out = np.zeros(len(words), np.int8)
        left = np.flatnonzero(open_)
        start = self.order[mid]
        for k in range(words.shape[1]):
            left = left[lengths[left] > k]
            if not len(left):
                break
            at = start[left] + k
            inside = at < len(self.ids)
            have = np.where(inside, self.ids[np.minimum(at, len(self.ids) - 1)], -1)
            want = words[left, k]
            out[left] = np.sign(np.where(have < 0, -1, have) - want)
            left = left[have == want]
        return out


class Benchmark:
    """The query set: every suffix of every item, cut to ``window`` words, and the items' words for extension."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        self.window, self.vocabulary = window, {}
        self.items: list[object] = []
        self.words: list[np.ndarray] = []
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in bench_words(text)], np.int64)
            if len(ids):
                self.items.append(item)
                self.words.append(ids)
        # one window for an item that is shorter than a window
        rows = [(i, s, min(window, len(w))) for i, w in enumerate(self.words) for s in range(max(1, len(w) - window + 1))]
        self.item = np.array([r[0] for r in rows], np.int64)
        self.start = np.array([r[1] for r in rows], np.int64)
        self.length = np.array([r[2] for r in rows], np.int64)
        self.grams = np.full((len(rows), window), -1, np.int64)
        for k, (i, s, n) in enumerate(rows):
            self.grams[k, :n] = self.words[i][s : s + n]
        # equal windows are searched once
        if len(rows):
            self.distinct, self.of = np.unique(self.grams, axis=0, return_inverse=True)
            self.distinct_length = (self.distinct >= 0).sum(1)
            self.firsts = np.unique(self.distinct[:, 0])


def search_shard(bench: Benchmark, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits (document index, word position, distinct window) in a shard of documents."""
    get = bench.vocabulary.get
    none = (np.empty(0, np.int64),) * 3
    if not len(bench.item):
        return none
    parts, lengths = [], []
    for words in texts:
        parts.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
        lengths.append(len(words) + 1)
        parts.append(np.array([-1], np.int64))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    # a match lies inside a run of vocabulary words that is at least as long as the shortest window
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
    first, past = edges[::2], edges[1::2]
    long_ = past - first >= bench.distinct_length.min()
    kept = np.zeros(len(ids) + 1, np.int8)
    kept[first[long_]] = 1
    kept[np.minimum(past[long_] + 1, len(ids))] -= 1  # a run and the break behind it
    place = np.flatnonzero(np.cumsum(kept[:-1]) > 0)
    if not len(place):
        return none
    sa = SuffixArray(ids[place], bench.window)
    lo, hi = sa.bounds(bench.distinct, bench.distinct_length)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return none
    at = place[np.concatenate([sa.order[lo[k] : hi[k]] for k in found])]
    which = np.repeat(found, (hi - lo)[found])
    begins = np.concatenate([[0], np.cumsum(lengths)])
    doc = np.searchsorted(begins, at, side="right") - 1
    return doc, at - begins[doc], which


def _shards(batches: Iterator[pd.DataFrame], words: int):
    """(keys, lists of words) of about ``words`` words; a document is never divided."""
    keys, texts, n = [], [], 0
    for pdf in batches:
        for key, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
            w = bench_words(text)
            keys.append(key)
            texts.append(w)
            n += len(w)
            if n >= words or len(keys) >= 20_000:
                yield keys, texts
                keys, texts, n = [], [], 0
    if keys:
        yield keys, texts


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes | None]]]:
    """The stated query set in blocks of at most ``block_bytes`` of text (a longer item is a block of its own), one block
    at a time: neither the driver nor a broadcast ever holds more."""
    block, size = [], 0
    for item, text in benchmark.select("item_id", F.col("text").cast("binary")).orderBy(F.col("item_id").asc_nulls_first()).toLocalIterator():
        n = len(text) if text is not None else 0
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, bytes(text) if text is not None else None))
        size += n
    yield block


def matches(bench: Benchmark, texts: list[list[bytes]]) -> Iterator[tuple[int, list[tuple[int, int]], list[str], int, int]]:
    """For each document with a hit: its index, its hit spans of words (merged), the items' names (as text, sorted; an
    item without an id has an empty name), and the length and first place of the longest verbatim match with an item.

    A match of more than a window is a run of hits, each one word further both in the document and in the item.
    """
    doc, at, which = search_shard(bench, texts)
    if not len(doc):
        return
    # the rows (item, place) of every window that is hit
    of = bench.of.reshape(-1)
    by_window = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(bench.distinct)))
    sizes = np.diff(ends, prepend=0)[which]
    first = (ends[which] - sizes).repeat(sizes)
    row = by_window[first + np.arange(sizes.sum()) - (np.cumsum(sizes) - sizes).repeat(sizes)]
    doc, at, item = doc.repeat(sizes), at.repeat(sizes), bench.item[row]
    length, shift = bench.length[row], at - bench.start[row]
    order = np.lexsort((at, shift, item, doc))
    doc, at, item, length, shift = doc[order], at[order], item[order], length[order], shift[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(fresh)
    n = np.diff(np.append(head, len(doc))) - 1 + length[head]
    edges = np.flatnonzero(np.diff(doc[head], prepend=-1))
    for x, y in zip(edges, [*edges[1:], len(head)], strict=True):
        some = slice(x, y)
        begin, size = at[head[some]], n[some]
        names = sorted({"" if (k := bench.items[i]) is None else str(k) for i in item[head[some]].tolist()})
        longest = int(size.max())
        yield int(doc[head[x]]), _merged(zip(begin.tolist(), (begin + size).tolist(), strict=True)), names, longest, int(begin[size == longest].min())


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at"]


def _told(key, n_words: int, spans, names, longest: int, at) -> tuple:
    hit = sum(b - a for a, b in spans)
    return key, n_words, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, longest, at


def _schema(docs: DataFrame) -> T.StructType:
    long, text = T.LongType(), T.StringType()
    return T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in zip(COLUMNS[1:], (long, long, long, text, T.BooleanType(), long, long), strict=True)]])


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"longest_at": "Int64"})


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the text), text: results of a row follow from the first two."""
    text = F.col("text").cast("binary")
    return docs.select("doc_id", F.unhex(F.md5(F.coalesce(text, F.lit("").cast("binary")))).alias("sha"), text.alias("text"))


def _found(docs: DataFrame, blocks: Iterator, window: int, shard_words: int) -> DataFrame:
    """doc_id, sha, spans, names, longest, longest_at for rows with a hit, once for each block of the benchmark: each is
    broadcast alone, searched in one pass and written before the next."""
    spark, box = docs.sparkSession, Scratch(docs.sparkSession, "decontaminate")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("sha", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("longest_at", T.LongType())])
    parts = []
    for k, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(Benchmark(block, window))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for keys, texts in _shards(((pd.DataFrame({"k": list(zip(p["doc_id"], p["sha"], strict=True)), "t": p["text"]})) for p in batches), shard_words):
                rows = [(*keys[d], spans, names, n, at) for d, spans, names, n, at in matches(sent.value, texts)]
                yield pd.DataFrame(rows, columns=schema.names)

        parts.append(box.save(_named(docs).mapInPandas(released(run), schema), f"block{k}"))
        sent.destroy()
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _one_or_more(benchmark: DataFrame, block_bytes: int):
    """The first block, and all blocks if there are more than one (else None)."""
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 400_000, block_bytes: int = 8_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at.

    A shard's suffix array is built by the task that reads the documents, binary-searched for every suffix of every
    item (by its first ``window`` words; a suffix that is shorter can't hold a window, except for an item that is short
    as a whole) and thrown away: documents are never shuffled. ``longest`` is the length in words of the longest
    verbatim match with an item that holds a window (0: none), ``longest_at`` its first place. A benchmark of more than
    ``block_bytes`` is broadcast and searched block by block, one pass each; rows with hits are then joined by shuffle.
    Null texts have no words; repeated doc_ids give a row each; long texts are searched whole, by one task each; items
    without an id have an empty name; an empty benchmark hits nothing, an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    schema = _schema(docs)
    first, blocks = _one_or_more(benchmark, block_bytes)
    if blocks is None:
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(first, window))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for keys, texts in _shards(batches, shard_words):
                rows = [_told(key, len(words), [], [], 0, None) for key, words in zip(keys, texts, strict=True)]
                for d, spans, names, n, at in matches(shared.value, texts):
                    rows[d] = _told(keys[d], len(texts[d]), spans, names, n, at)
                yield _table(rows)

        return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(released(run), schema)
    # rows that repeat a doc_id and a text have equal hits: they are told once
    found = _found(docs, blocks, window, shard_words).groupBy("doc_id", "sha").agg(
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"),
        F.min(F.struct((-F.col("longest")).alias("n"), F.col("longest_at").alias("at"))).alias("longest"))
    found = found.select(F.col("doc_id").alias("id"), F.col("sha").alias("own"), "spans", "names", "longest")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sha": pdf["sha"], "n": [len(bench_words(t)) for t in pdf["text"]]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, n, spans, names, best in zip(pdf["doc_id"], pdf["n"], pdf["spans"], pdf["names"], pdf["longest"], strict=True):
                rows.append(_told(key, n, [], [], 0, None) if spans is None else _told(key, n, _merged(map(tuple, spans)), list(names), -best["n"], best["at"]))
            yield _table(rows)

    sized = _named(docs).mapInPandas(released(count), T.StructType([docs.schema["doc_id"], T.StructField("sha", T.BinaryType()), T.StructField("n", T.LongType())]))
    both = sized.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("own")), "left")
    return both.select("doc_id", "n", "spans", "names", "longest").mapInPandas(released(finish), schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 400_000, block_bytes: int = 8_000_000) -> DataFrame:
    """``docs`` without the rows whose text holds a window of the benchmark; all columns stay as they are.

    Null and empty texts, repeated rows, null doc_ids and empty tables as in ``contamination``.
    """
    import pyarrow as pa

    first, blocks = _one_or_more(benchmark, block_bytes)
    if blocks is not None:
        gone = _found(docs, blocks, window, shard_words).select(F.col("doc_id").alias("__annalist_id"), F.col("sha").alias("__annalist_sha")).distinct()
        own = F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))))
        return docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__annalist_id")) & (own == F.col("__annalist_sha")), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(first, window))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            texts, begin, n = [], 0, 0
            for k, text in enumerate(batch.column(place).to_pylist(), 1):
                texts.append(bench_words(text.encode() if text is not None else None))
                n += len(texts[-1])
                if n >= shard_words or k == batch.num_rows:
                    clean[begin + search_shard(shared.value, texts)[0]] = False
                    texts, begin, n = [], k, 0
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
d AS (SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM t),
b AS (SELECT row_number() OVER () AS item, coalesce(CAST(item_id AS VARCHAR), '') AS name,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
q AS (SELECT item, name, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT item, name, n, s, array_to_string(w[s:s+n-1], ' ') AS h FROM q),
ns AS (SELECT DISTINCT n FROM bw),
p AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n),
dw AS (SELECT rid, n, p, array_to_string(w[p:p+n-1], ' ') AS h FROM p),
hit AS MATERIALIZED (SELECT rid, item, name, dw.n, p, p - s AS shift FROM dw JOIN bw ON dw.n = bw.n AND dw.h = bw.h),
run AS (SELECT *, p - row_number() OVER (PARTITION BY rid, item, shift ORDER BY p) AS g FROM hit),
m AS (SELECT rid, max(k) AS longest, arg_min(place, row(-k, place)) AS longest_at FROM (SELECT rid, count(*) - 1 + any_value(n) AS k, min(p) - 1 AS place FROM run GROUP BY rid, item, shift, g) GROUP BY rid),
k AS (SELECT rid, count(DISTINCT i) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS i FROM hit) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT rid, name FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(longest, 0)::BIGINT AS longest, CAST(longest_at AS BIGINT) AS longest_at
FROM d LEFT JOIN k USING (rid) LEFT JOIN i USING (rid) LEFT JOIN m USING (rid)
"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
SQL = {"op5_decontaminate": OP5_SQL}
