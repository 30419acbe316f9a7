"""Substring dedup: suffix automata of reference shards, documents streamed through them for matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.llm.common import Scratch, frames, hot_keys, released, salted, table, width, word_hashes

#: Words of the grams among which anchors are chosen.
GRAM = 8
#: Words of the documents that one automaton holds: a larger shard has several, for documents in order of doc_id.
SHARD_WORDS = 80_000
#: Anchor entries of a shard (about one in 20 words) from which its windows are dealt out one by one, by digest: in a
#: shard of so many automata every document would be streamed through all of them.
SHARD_ENTRIES = 200_000
_BASE = 0x9E3779B97F4A7C15
_B = np.uint64(_BASE)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    # polynomial by binary splitting of n: log n vector steps
    def power(of: int) -> np.uint64:
        return np.uint64(pow(_BASE, of, 1 << 64))

    done, length, block, size = None, 0, h, 1
    rest = n
    while rest:
        if rest & 1:
            if done is None:
                done, length = block, size
            else:  # a run of ``length`` words followed by one of ``size``
                m = len(h) - length - size + 1
                done, length = done[:m] * power(size) + block[length : length + m], length + size
        rest >>= 1
        if rest:
            m = len(h) - 2 * size + 1
            block, size = block[:m] * power(size) + block[size : size + m], 2 * size
    k = done[:count].copy()
    k ^= k >> np.uint64(31)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    k ^= k >> np.uint64(29)
    return k


def anchors(h: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors: the least gram of every window (ties: the last).

    Equal windows have equal anchors at equal places, so two documents that share a window share an anchor.
    """
    g = gram_hashes(h, gram)
    span = window - gram + 1
    if len(g) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # last minimum of every span: doubling over (value, place)
    value, place, size = g, np.arange(len(g)), 1
    while size * 2 <= span:
        value, place = _least(value[:-size], place[:-size], value[size:], place[size:])
        size *= 2
    if size < span:
        m, s = len(g) - span + 1, span - size
        value, place = _least(value[:m], place[:m], value[s : s + m], place[s : s + m])
    at = np.unique(place)
    return at, g[at]


def _least(va, pa, vb, pb):
    right = vb <= va
    return np.where(right, vb, va), np.where(right, pb, pa)


class SuffixAutomaton:
    """Suffix automaton over words of several passages, extended passage by passage."""

    __slots__ = ("next", "link", "length")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:  # a passage that was there before
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each place, the length of the longest match with the passages that ends there."""
        out, state, n = [], 0, 0
        follow, link, length = self.next, self.link, self.length
        for w in words:
            while state and w not in follow[state]:
                state = link[state]
                n = length[state]
            to = follow[state].get(w)
            if to is None:
                state = n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


def matched_spans(statistics: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans covered by matches of ``window`` words at least."""
    spans: list[list[int]] = []
    for end, n in enumerate(statistics, 1):
        if n >= window:
            begin = end - n
            if spans and begin <= spans[-1][1]:
                spans[-1][0], spans[-1][1] = min(begin, spans[-1][0]), end
                while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                    last = spans.pop()
                    spans[-1][0], spans[-1][1] = min(spans[-1][0], last[0]), max(spans[-1][1], last[1])
            else:
                spans.append([begin, end])
    return [tuple(s) for s in spans]


def merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(s) for s in out]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the text), text (bytes): what joins use as a row's name."""
    text = F.col("text").cast("binary")
    return docs.select("doc_id", F.unhex(F.md5(F.coalesce(text, F.lit("").cast("binary")))).alias("sha"), text.alias("text"))


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, sha, spans array<struct<begin, end>> (words, merged) for the texts that lose words.

    1. Anchors (about one in 20 words) are counted; only those of two documents or more go on. The smallest
       document of an anchor owns it. Of equal texts only that of the smallest doc_id takes part: the others are
       repeated whole.
    2. Stretches of a document around anchors of one owner go to that owner's shard, sorted by doc_id. Each is
       streamed through the shard's suffix automaton of all smaller documents: matches of ``window`` words at least
       are spans to remove. Then its own passage extends the automaton. Automata are sent no wider than their
       shard: they grow with the corpus, so a broadcast would have no bound.
       A shard of more than SHARD_WORDS is cut by doc_id into blocks, each with its own automaton; a document is
       streamed through that of its own block and those of the blocks before. The automaton of a block is sent to
       as many tasks as there are 4 * SHARD_WORDS words to stream, and each later document goes to one of them.
    3. A shard of more than SHARD_ENTRIES anchors (one extremely common passage) is split to its windows: each goes by
       the 128-bit BLAKE2 digest of its words, the least document of each is a pre-aggregated minimum, and later
       ones lose it. Equal digests are taken for equal words, as in the copies above.
    """
    box = Scratch(docs.sparkSession, "substrings")
    spark = docs.sparkSession
    rows = _rows(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()))

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, shas, whole, lists, places = [], [], [], [], []
            for key, sha, text in zip(pdf["doc_id"], pdf["sha"], pdf["text"], strict=True):
                h = word_hashes(text)
                if len(h) < window:
                    continue
                at, a = anchors(h, window)
                ids.append(key)
                shas.append(sha)
                whole.append(hashlib.blake2b(h.tobytes(), digest_size=12).digest() + len(h).to_bytes(4, "big"))
                lists.append(a.view(np.int64))
                places.append(at.astype(np.int32))
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "sha": pd.Series(shas, dtype=object), "whole": pd.Series(whole, dtype=object), "anchors": pd.Series(lists, dtype=object), "places": pd.Series(places, dtype=object)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    meta = box.save(rows.mapInPandas(released(survey), f"doc_id {kind}, sha binary, whole binary, anchors array<long>, places array<int>"), "meta")
    first = meta.groupBy("whole").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = box.save(meta.select("doc_id", "sha", "whole").join(first, "whole").where(F.col("doc_id") > F.col("least_id")).select("doc_id", "sha", F.expr("cast(conv(hex(substring(whole, 13, 4)), 16, 10) as int)").alias("words")).distinct(), "copies")
    entries = meta.join(copies.select("doc_id", "sha"), ["doc_id", "sha"], "left_anti").select("doc_id", "sha", F.explode(F.arrays_zip("anchors", "places")).alias("x"))
    entries = entries.select("doc_id", "sha", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    owners = entries.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where(F.col("owner") != F.col("last"))
    owners = box.save(owners.select("anchor", "owner", "n"), "owners")
    hot = owners.groupBy("owner").agg(F.sum("n").alias("n")).where(F.col("n") > SHARD_ENTRIES).select("owner", F.lit(True).alias("hot"))
    owners = owners.drop("n").join(hot, "owner", "left")
    found = entries.join(owners, "anchor").select("doc_id", "sha", F.struct("place", "owner", F.coalesce("hot", F.lit(False)).alias("hot")).alias("a"))
    lists = box.save(found.groupBy("doc_id", "sha").agg(F.array_sort(F.collect_set("a")).alias("a")), "lists")
    box.drop("meta", "owners")

    def stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = window - GRAM
        for pdf in batches:
            out = {k: [] for k in ("doc_id", "sha", "owner", "begin", "n", "words", "win")}
            for key, sha, text, marks in zip(pdf["doc_id"], pdf["sha"], pdf["text"], pdf["a"], strict=True):
                words = text.split()
                parts: list[list] = []
                latest: dict = {}  # each owner's last part: parts of other owners may lie between, so begins differ
                starts: set = set()
                for m in marks:
                    p = m["place"]
                    if m["hot"]:
                        starts.update(range(max(0, p - reach), min(p, len(words) - window) + 1))
                        continue
                    begin, end = max(0, p - reach), min(len(words), p + window)
                    part = latest.get(m["owner"])
                    if part is not None and begin <= part[2]:
                        part[2] = end
                    else:
                        latest[m["owner"]] = part = [m["owner"], begin, end]
                        parts.append(part)
                for owner, begin, end in parts:
                    for c, v in zip(out, (key, sha, owner, begin, end - begin, b" ".join(words[begin:end]), None), strict=True):
                        out[c].append(v)
                if starts:
                    named = [{"h": hashlib.blake2b(b" ".join(words[y : y + window]), digest_size=16).digest(), "begin": y} for y in sorted(starts)]
                    for c, v in zip(out, (key, sha, None, None, None, None, named), strict=True):
                        out[c].append(v)
            yield pd.DataFrame({"doc_id": out["doc_id"], "sha": pd.Series(out["sha"], dtype=object), "owner": pd.array(out["owner"], dtype="Int64"), "begin": pd.array(out["begin"], dtype="Int32"), "n": pd.array(out["n"], dtype="Int32"), "words": pd.Series(out["words"], dtype=object), "win": pd.Series(out["win"], dtype=object)})

    cut = rows.join(lists.hint("merge"), ["doc_id", "sha"]).mapInPandas(released(stretch), f"doc_id {kind}, sha binary, owner {kind}, begin int, n int, words binary, win array<struct<h: binary, begin: int>>")
    # repeated rows have equal stretches
    cut = box.save(cut.dropDuplicates(["doc_id", "sha", "owner", "begin", "n"]), "stretches")
    stretches = cut.where(F.col("win").isNull()).drop("win")
    # the frame holds all rows of a document at once, so that a document is in one block; an owner has at most SHARD_ENTRIES rows
    by_owner = W.partitionBy("owner")
    upto = F.sum("n").over(by_owner.orderBy("doc_id").rangeBetween(W.unboundedPreceding, W.currentRow))
    stretches = stretches.withColumn("block", ((upto - 1) / SHARD_WORDS).cast("int")).withColumn("salts", F.ceil(F.sum("n").over(by_owner) / (4 * SHARD_WORDS)).cast("int"))
    stretches = stretches.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("block")))).withColumn("refers", F.col("block") == F.col("part"))
    one = F.pmod(F.xxhash64("doc_id", "sha"), "salts").cast("int")
    stretches = stretches.withColumn("salt", F.explode(F.when(F.col("refers"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(one))))
    order = ["owner", "part", "salt", "doc_id", "sha", "begin"]
    shards = stretches.select(*order, "refers", "words").repartition(width(spark), "owner", "part", "salt").sortWithinPartitions(*order)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = doc = None
        automaton, held, out = SuffixAutomaton(), [], []
        for pdf in batches:
            for o, part, salt, key, sha, begin, refers, text in zip(*(pdf[c] for c in (*order, "refers", "words")), strict=True):
                words = text.split()
                if (o, part, salt) != shard:
                    shard, doc, automaton, held = (o, part, salt), key, SuffixAutomaton(), []
                elif key != doc:  # passages of smaller documents only are in the automaton
                    for w in held:
                        automaton.add(w)
                    doc, held = key, []
                told = automaton.statistics(words) if len(automaton.link) > 1 else []
                spans = matched_spans(told, window) if not (refers and salt) else []  # a block's own rows tell once
                out += [(key, sha, begin + a, begin + b) for a, b in spans]
                # only a single match of all its words is in the automaton whole: several that cover them leave seams
                if refers and not (told and told[-1] == len(words)):
                    held.append(words)
            if len(out) > 10_000:
                yield from frames(doc_id=[x[0] for x in out], sha=[x[1] for x in out], begin=[x[2] for x in out], end=[x[3] for x in out])
                out = []
        yield from frames(doc_id=[x[0] for x in out], sha=[x[1] for x in out], begin=[x[2] for x in out], end=[x[3] for x in out])

    spans = shards.mapInPandas(released(stream), f"doc_id {kind}, sha binary, begin int, end int")
    wins = cut.where(F.col("win").isNotNull()).select("doc_id", "sha", F.explode("win").alias("w")).select("doc_id", "sha", "w.h", "w.begin")
    least = wins.groupBy("h").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id")).where(F.col("least_id") != F.col("most_id")).drop("most_id")
    # a window that very many documents have is dealt to many tasks
    common = salted(wins, least, "h", hot_keys(wins, "h"), F.col("doc_id")).where(F.col("doc_id") > F.col("least_id")).select("doc_id", "sha", "begin", (F.col("begin") + window).alias("end"))
    all_spans = spans.unionByName(common).unionByName(copies.select("doc_id", "sha", F.lit(0).alias("begin"), F.col("words").alias("end")))
    return box.save(all_spans.groupBy("doc_id", "sha").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans")), "spans")


def _kept(text: bytes, spans) -> tuple[int, list[bytes]]:
    words = text.split()
    if spans is None or not len(spans):
        return len(words), words
    keep = np.ones(len(words), bool)
    for s in spans:
        keep[s["begin"] : s["end"]] = False
    return len(words), [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text).

    A word is removed if a run of ``window`` words around it also starts in a document with a smaller doc_id; runs
    are judged on the input. Null texts have no words. Texts below ``window`` words lose nothing. Rows that share a
    doc_id aren't smaller than each other; a null doc_id is neither smaller nor larger than any. Empty tables give
    empty results; other columns are ignored.
    """
    spans = repeated_spans(docs, window)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, s in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
                n, kept = _kept(text if text is not None else b"", s)
                out.append((key, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _rows(docs).join(spans.hint("merge"), ["doc_id", "sha"], "left").select("doc_id", "text", "spans").mapInPandas(released(digest), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeated(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with repeated runs cut out: such texts become their kept words joined by a space (n_chars follows,
    where there is such a column); texts of which nothing is left go; all others stay as they are."""
    spans = repeated_spans(docs, window).withColumnsRenamed({"doc_id": "__annalist_id", "sha": "__annalist_sha", "spans": "__annalist_spans"})
    named = docs.withColumn("__annalist_own", F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")))))
    both = named.join(spans.hint("merge"), (F.col("doc_id") == F.col("__annalist_id")) & (F.col("__annalist_own") == F.col("__annalist_sha")), "left").drop("__annalist_id", "__annalist_sha", "__annalist_own")

    @F.pandas_udf("string")
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(_kept(t, s)[1]).decode() if s is not None and t is not None else None for t, s in zip(text, spans, strict=True)], dtype=object)

    cut = F.when(F.col("__annalist_spans").isNotNull(), rest(F.col("text").cast("binary"), "__annalist_spans")).otherwise(F.col("text"))
    out = both.withColumn("text", cut).where(F.col("__annalist_spans").isNull() | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__annalist_spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
v AS MATERIALIZED (SELECT rid, doc_id, p, md5(array_to_string(w[p:p+49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS least_id FROM v GROUP BY h),
g AS (SELECT DISTINCT rid, unnest(range(p, p + 50)) AS i FROM v JOIN f USING (h) WHERE least_id < doc_id),
x AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT x.rid, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN g ON x.rid = g.rid AND x.i = g.i GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

QUERIES = {"op6_substring_dedup": op6_substring_dedup}
SQL = {"op6_substring_dedup": OP6_SQL}
