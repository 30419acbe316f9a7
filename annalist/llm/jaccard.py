"""N-gram Jaccard join with set-relation skipping: exact links between documents, as components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.llm.common import HOT_ROWS, Scratch, frames, hot_keys, released, table, width, word_hashes
from annalist.llm.components import connected_components

#: Counters by which shingles are ordered from rare to frequent: bounded whatever the corpus, equal for all documents.
COUNTERS = 1 << 18
#: Bits of a set's parity map.
BITS = 1024
#: Entries of an index list that one task compares with each other.
BLOCK = 1024
MEMORY = 150_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct 64-bit hashes of a text's word shingles (A-Z lowered; blanks are the six ASCII ones)."""

    def __init__(self, n: int):
        self.n = n

    def words(self, text: bytes | None) -> np.ndarray:
        return word_hashes(text.lower()) if text is not None else np.empty(0, np.uint64)

    def shingles(self, text: bytes | None) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        n = min(self.n, len(h))
        count = len(h) - n + 1
        k = np.full(count, n, np.uint64)
        for j in range(n):
            k *= _MULTIPLY
            k += h[j : j + count]
        k ^= k >> np.uint64(29)
        k *= np.uint64(0xBF58476D1CE4E5B9)
        k ^= k >> np.uint64(32)
        k.sort()
        return k[np.concatenate([[True], k[1:] != k[:-1]])]


def parity(shingles: np.ndarray) -> bytes:
    """BITS bits, each the parity of the shingles that hash to it: two maps differ in no more bits than sets differ."""
    odd = np.bincount((shingles >> np.uint64(7)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_overlap(n, m, num: int, den: int):
    """The least intersection for which den * i >= num * (n + m - i)."""
    return -((-num * (n + m)) // (den + num))


def prefix(n: int, num: int, den: int) -> int:
    """So many rarest shingles of a set of n that a set without any of them can't link: n - ceil(n num/den) + 1."""
    return n - -(-n * num // den) + 1


def survey(docs: DataFrame, n: int) -> DataFrame:
    """One pass: rows of documents (doc_id, tk, n, node, bits) and rows of counters (bucket, hits).

    ``node`` is a 96-bit digest of the set: documents with equal sets are one node. ``tk`` is the text's key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, hits = Shingler(n), np.zeros(COUNTERS, np.int64)
        for pdf in batches:
            rows = []
            for key, tk, text in zip(pdf["doc_id"], pdf["tk"], pdf["text"], strict=True):
                s = make.shingles(text)
                if len(s):
                    np.add.at(hits, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                    rows.append((key, tk, len(s), hashlib.blake2b(s.tobytes(), digest_size=12).digest(), parity(s), None, None))
                else:
                    rows.append((key, tk, 0, None, None, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "tk", "n", "node", "bits", "bucket", "hits"]).astype({"bucket": "Int32", "hits": "Int64"})
        at = np.flatnonzero(hits)
        for part in frames(bucket=at, hits=hits[at]):
            yield pd.DataFrame({"doc_id": None, "tk": None, "n": pd.Series([None] * len(part), dtype="Int32"), "node": None, "bits": None, "bucket": part["bucket"].to_numpy(), "hits": part["hits"].to_numpy()})

    # ids go through Python as text: with nulls beside them pandas would make them doubles
    ids = _texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    found = ids.mapInPandas(released(run), "doc_id string, tk binary, n int, node binary, bits binary, bucket int, hits long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def text_key(text: F.Column) -> F.Column:
    """128 bits of the text's SHA-256 (null text: null)."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), F.col("text").cast("binary").alias("text"))


def index_entries(docs: DataFrame, n: int, num: int, den: int, hits: np.ndarray, least: int = 0) -> DataFrame:
    """token, node, n, pos: the prefix of every set in the common order (rare counters first, then by hash); with ``least``
    only tokens whose counter is above it."""
    sent = docs.sparkSession.sparkContext.broadcast(hits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, rank, seen = Shingler(n), sent.value, set()
        for pdf in batches:
            tokens, nodes, sizes, places = [], [], [], []
            if len(seen) > MEMORY:
                seen.clear()
            for text in pdf["text"]:
                s = make.shingles(text)
                if not len(s):
                    continue
                node = hashlib.blake2b(s.tobytes(), digest_size=12).digest()
                if node in seen:  # a copy in this task: its set is indexed already
                    continue
                seen.add(node)
                p = prefix(len(s), num, den)
                own = rank[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((s, own))[:p]
                place = np.flatnonzero(own[order] > least)
                tokens.append(s[order[place]].view(np.int64))
                nodes += [node] * len(place)
                sizes.append(np.full(len(place), len(s), np.int32))
                places.append(place.astype(np.int32))
            if tokens:
                yield from frames(token=np.concatenate(tokens), node=nodes, n=np.concatenate(sizes), pos=np.concatenate(places))

    return docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(released(run), "token long, node binary, n int, pos int")


class Block:
    """Entries of one index list (or of two blocks of it): which pairs can link, and by how much they may differ.

    The list is sorted by set size, then position. A pair is skipped when its sizes, its positions in the list (the
    matching shingle plus all behind it can't reach the overlap), or its parity maps rule a link out.
    """

    def __init__(self, nodes, sizes, places, bits, num, den, sides=None, roots=None):
        self.nodes = nodes
        self.n, self.pos = np.asarray(sizes, np.int64), np.asarray(places, np.int64)
        self.bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(nodes), BITS // 64)
        self.num, self.den, self.sides, self.roots = num, den, sides, roots

    def differences(self, v: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For entry v and others: how many parity bits differ, and whether the pair can link."""
        n, m = self.n[v], self.n[others]
        need = least_overlap(n, m, self.num, self.den)
        # sizes and positions first: no parity map is read for pairs that they rule out
        can = (self.den * np.minimum(n, m) >= self.num * np.maximum(n, m)) & (1 + np.minimum(n - self.pos[v], m - self.pos[others]) - 1 >= need)
        differ = np.full(len(others), 1 << 30, np.int64)
        at = np.flatnonzero(can)
        if len(at):
            differ[at] = np.bitwise_count(self.bits[others[at]] ^ self.bits[v]).sum(1)
            can[at] = differ[at] <= (n + m[at] - 2 * need[at])
        if self.sides is not None:
            can &= self.sides[others] != self.sides[v]
        return differ, can

    def forest(self) -> list[tuple[int, int]]:
        """A spanning forest of the pairs that can link, by least difference (Prim).

        A set's answers follow from those of its most similar neighbour: once that pair is verified, every other
        link between what the two have reached is known and needn't be computed.
        """
        count = len(self.nodes)
        best, parent, left = np.full(count, 1 << 30, np.int64), np.full(count, -1, np.int64), np.ones(count, bool)
        out, now = [], 0
        left[0] = False
        for _ in range(count - 1):
            others = np.flatnonzero(left)
            differ, can = self.differences(now, others)
            nearer = can & (differ < best[others])
            best[others[nearer]], parent[others[nearer]] = differ[nearer], now
            now = others[best[others].argmin()]
            if parent[now] >= 0:
                out.append((int(parent[now]), int(now)))
            left[now] = False
        return out

    def foreign(self) -> Iterator[tuple[int, int]]:
        """All pairs that can link and whose roots differ."""
        for v in range(len(self.nodes) - 1):
            others = np.arange(v + 1, len(self.nodes))
            others = others[self.roots[others] != self.roots[v]]
            if len(others):
                _, can = self.differences(v, others)
                for o in others[can].tolist():
                    yield v, o


def deal(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Index lists as groups (token, i, j) of bounded size: a list of over BLOCK entries is cut into blocks by set size.

    Every pair of blocks whose sizes can link is a group; others are skipped. ``side`` tells the blocks of a pair.
    """
    small = shared.where(F.col("cnt") <= BLOCK).withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "side": F.lit(0)})
    by_size = W.partitionBy("token").orderBy("n", "pos", "node")
    large = shared.where(F.col("cnt") > BLOCK).withColumn("b", ((F.row_number().over(by_size) - 1) / BLOCK).cast("long"))
    ranges = large.groupBy("token", "b").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    ranges = ranges.groupBy("token").agg(F.collect_list(F.struct("b", "lo", "hi")).alias("blocks"))  # one per BLOCK entries
    mine = F.expr("filter(blocks, x -> x.b = b)[0]")
    large = large.join(ranges, "token").withColumn("mine", mine)
    meets = F.filter("blocks", lambda x: (x["lo"] * num <= F.col("mine.hi") * den) & (F.col("mine.lo") * num <= x["hi"] * den))
    large = large.withColumn("x", F.explode(F.transform(meets, lambda x: x["b"])))
    large = large.withColumns({"i": F.least("b", "x"), "j": F.greatest("b", "x")}).withColumn("side", (F.col("b") != F.col("i")).cast("int"))
    return small.unionByName(large.drop("blocks", "mine", "x", "b"))


def deal_hot(hot: DataFrame, num: int, den: int, pairs: bool) -> DataFrame:
    """Index lists of very common shingles as groups (token, i, j) of bounded size, without ever sorting a whole list.

    Entries of a list are dealt by class of size (sets of classes that aren't the same or next to each other can't link)
    and within it by hash to blocks of about BLOCK. Groups are single blocks, or with ``pairs`` all pairs of blocks whose
    classes can link. Rows per list and class are counted before the shuffle.
    """
    size = F.floor(F.log("n") / math.log(den / num) + 1e-9).cast("long")
    h = hot.withColumn("c", size)
    blocks = h.groupBy("token", "c").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))  # hot tokens (see hot_keys) times classes
    h = h.join(F.broadcast(blocks), ["token", "c"]).withColumn("b", F.col("c") * (1 << 40) + F.pmod(F.xxhash64("node"), "nb"))
    if not pairs:
        return h.withColumns({"i": F.col("b"), "j": F.col("b"), "side": F.lit(0)}).drop("c", "nb", "b")
    near = blocks.select("token", F.col("c").alias("oc"), F.col("nb").alias("on"))
    h = h.join(F.broadcast(near), "token").where(F.abs(F.col("c") - F.col("oc")) <= 1)
    h = h.withColumn("x", F.explode(F.sequence(F.col("oc") * (1 << 40), F.col("oc") * (1 << 40) + F.col("on") - 1)))
    h = h.withColumns({"i": F.least("b", "x"), "j": F.greatest("b", "x")}).withColumn("side", (F.col("b") != F.col("i")).cast("int"))
    return h.drop("c", "nb", "b", "oc", "on", "x")


def candidate_pairs(dealt: DataFrame, num: int, den: int, foreign: bool) -> DataFrame:
    """Distinct pairs (a, b) from sorted groups: a spanning forest of each, or all pairs of different roots."""
    rows = dealt.select("token", "i", "j", "side", "node", "n", "pos", "bits", "root").repartition(width(dealt.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "pos", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: set = set()

        def group(g: pd.DataFrame) -> None:
            nodes = g["node"].tolist()
            two = g["i"].iat[0] != g["j"].iat[0]
            block = Block(nodes, g["n"], g["pos"], g["bits"].tolist(), num, den, g["side"].to_numpy() if two else None, g["root"].to_numpy(object) if foreign else None)
            for v, o in block.foreign() if foreign else block.forest():
                pairs.add((min(nodes[v], nodes[o]), max(nodes[v], nodes[o])))

        def out():
            found = list(pairs)
            pairs.clear()
            yield from frames(a=[p[0] for p in found], b=[p[1] for p in found])

        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["token", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            begins = np.concatenate([[0], cuts])
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                group(pdf.iloc[a:b])
            rest = pdf.iloc[begins[-1] :]
            if len(pairs) > MEMORY:
                yield from out()
        if rest is not None and len(rest):
            group(rest)
        yield from out()

    return rows.mapInPandas(released(run), "a binary, b binary").distinct()


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, linked: exact intersections of the two sets."""
    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    return both.select("a", "b", (den * F.col("i") >= num * (F.col("t") - F.col("i"))).alias("linked"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, s (array of shingle hashes) of wanted (doc_id, tk, node): a row that has the node's set, found by doc_id (null ones too) and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Shingler(n)
        for pdf in batches:
            nodes, arrays = [], []
            for node, text in zip(pdf["node"], pdf["text"], strict=True):
                s = make.shingles(text)
                if hashlib.blake2b(s.tobytes(), digest_size=12).digest() == node:
                    nodes.append(node)
                    arrays.append(s.view(np.int64))
            yield pd.DataFrame({"node": pd.Series(nodes, dtype=object), "s": pd.Series(arrays, dtype=object)})

    named = wanted.select(F.col("doc_id").alias("wanted_id"), F.col("tk").alias("wanted_tk"), "node")
    found = _texts(docs).join(named, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("tk") == F.col("wanted_tk")))
    return found.select("node", "text").mapInPandas(released(run), "node binary, s array<long>").dropDuplicates(["node"])


def jaccard_components(docs: DataFrame, n: int = 4, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text): see ``jaccard_groups``."""
    return jaccard_groups(docs, n, threshold).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, n: int = 4, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, tk, first_id, first_tk for every row of ``docs`` (doc_id, text): ``tk`` is the text's key, the
    last two tell the document that stands for the component, which has its smallest doc_id (null: no row has one)
    and of those the smallest key.

    Documents link when den * |A & B| >= num * |A | B| for their sets of distinct n-word shingles, ``threshold`` =
    (num, den). Fewer than n words: the whole sequence is the one shingle. Null, empty and blank texts have an empty
    set, link with nothing and are their own component. Equal sets are one node, so copies are never paired; rows
    that repeat a doc_id belong to the component of their set. Rows without doc_id link like others; they have the
    smallest doc_id of their component, null if no row of it has one. Other columns are ignored; texts may be of any
    length (a set is held at once). No links are lost:

    1. Sets are ordered from rare to frequent shingles by bounded counters; only prefixes are indexed, and the
       lists of a shingle that one node alone has are dropped.
    2. Lists of two give their pair. Longer ones are cut into bounded blocks, pairs are skipped by size, position
       and parity map, and only a spanning forest of what remains is verified.
       The list of a very common shingle (more than HOT_ROWS sets, or one in 10,000 entries) is dealt to blocks by
       size and hash instead of being sorted; each block has a forest of its own.
    3. Where all pairs of a forest are verified, its answers decide those of all pairs in that list. Lists with a
       pair that failed, and common ones with more than one component, are read again, and all remaining pairs between
       different components are verified.

    Sets are hashed to 64 bits a shingle and 96 bits a set. An empty table gives an empty result.
    """
    num, den = threshold
    spark = docs.sparkSession
    box = Scratch(spark, "jaccard")
    pass1 = box.save(survey(docs, n), "survey")
    hits = np.zeros(COUNTERS, np.int64)
    counted = pass1.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("hits").alias("hits")).toPandas()  # at most COUNTERS rows
    hits[counted["bucket"].to_numpy()] = counted["hits"].to_numpy()
    meta = pass1.where(F.col("bucket").isNull())
    nodes = box.save(meta.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "nodes")
    # very common shingles are told apart first: their lists would be sorted in one task each
    limit, hot = max(HOT_ROWS, int(hits.sum()) // 10_000), None
    if (hits > limit).any():
        maybe = box.save(index_entries(docs, n, num, den, hits, limit).dropDuplicates(["token", "node"]), "maybe")
        common = box.save(hot_keys(maybe, "token", HOT_ROWS).select("token"), "common")  # 10,000 rows at most
        hot = maybe.join(F.broadcast(common), "token", "left_semi")
    # lists in order of size: repeated nodes fall together and go, then nodes that are alone in their list
    in_list = W.partitionBy("token").orderBy("n", "node")
    entries = index_entries(docs, n, num, den, hits)
    entries = entries if hot is None else entries.join(F.broadcast(common), "token", "left_anti")
    entries = entries.withColumn("same", F.lag("node").over(in_list)).where(F.col("same").isNull() | (F.col("same") != F.col("node"))).drop("same")
    entry = F.struct("node", "n", "pos")
    shared = entries.withColumns({"before": F.lag(entry).over(in_list), "behind": F.lead("node").over(in_list)})
    shared = shared.where(F.col("before").isNotNull() | F.col("behind").isNotNull()).drop("behind")
    shared = box.save(shared.withColumn("cnt", F.count("*").over(W.partitionBy("token"))), "shared")
    x = F.col("before")
    fits = (den * F.least(x["n"], F.col("n")) >= num * F.greatest(x["n"], F.col("n"))) & (
        (den + num) * F.least(x["n"] - x["pos"], F.col("n") - F.col("pos")) >= num * (x["n"] + F.col("n")))
    twos = shared.where((F.col("cnt") == 2) & x.isNotNull() & fits).select(F.least(x["node"], F.col("node")).alias("a"), F.greatest(x["node"], F.col("node")).alias("b")).distinct()
    lists = shared.where("cnt > 2").drop("before")
    bits = nodes.select("node", "bits")
    columns = ["token", "i", "j", "side", "node", "n", "pos"]
    dealt = deal(lists, num, den).select(*columns)
    dealt = dealt if hot is None else dealt.unionByName(deal_hot(hot, num, den, False).select(*columns))
    forest = candidate_pairs(dealt.join(bits, "node").withColumn("root", F.lit(None).cast("binary")), num, den, False)
    pairs = box.save(twos.unionByName(forest).distinct(), "pairs")

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return box.save(shingle_sets(docs, nodes.select("node", "rep.doc_id", "rep.tk").join(wanted, "node", "left_semi"), n), name)

    checked = box.save(verify(pairs, sets_of(pairs, "sets"), num, den), "checked")
    box.drop("sets", "pairs")
    roots = box.save(connected_components(checked.where("linked").select("a", "b")), "roots")
    failed = checked.where(~F.col("linked")).select("a", "b")
    if hot is not None or not failed.isEmpty():
        doubtful = failed.select(F.col("a").alias("node")).unionByName(failed.select(F.col("b").alias("node"))).distinct()
        tokens = lists.join(doubtful, "node", "left_semi").select("token").distinct()
        again = deal(lists.join(tokens, "token", "left_semi"), num, den).select(*columns)
        if hot is not None:
            # a list in which all sets are of one component has nothing left to find
            parts = hot.join(roots, "node", "left").groupBy("token").agg(F.min(F.coalesce("root", "node")).alias("a"), F.max(F.coalesce("root", "node")).alias("b"))
            several = box.save(parts.where("a <> b").select("token"), "several")
            again = again.unionByName(deal_hot(hot.join(F.broadcast(several), "token", "left_semi"), num, den, True).select(*columns))
        again = again.join(bits, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = box.save(candidate_pairs(again, num, den, True).join(failed, ["a", "b"], "left_anti"), "more")
        late = box.save(verify(more, sets_of(more, "late_sets"), num, den), "late")
        box.drop("late_sets")
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late.where("linked").select("a", "b"))
        roots = box.save(connected_components(links), "all_roots")
    box.drop("shared")
    named = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("rep").alias("first"))
    named = named.join(first, "root").select("node", "first")
    out = meta.select("doc_id", "tk", "n", "node").join(named, "node", "left")
    alone = F.col("first").isNull()
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "tk",
                      F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("first_id"), F.when(alone, F.col("tk")).otherwise(F.col("first.tk")).alias("first_tk"))


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [md5(array_to_string(w, ' '))]
                                         ELSE list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i+3], ' '))) END) AS g
  FROM w),
u AS MATERIALIZED (SELECT rid, len(g) AS n, unnest(g) AS h FROM s),
i AS (SELECT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb, count(*) AS n FROM u a JOIN u b ON a.h = b.h AND a.rid <> b.rid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * n >= 85 * (na + nb - n)),
r AS (SELECT rid AS a, rid AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rid, min(s.doc_id) AS component_id FROM r JOIN s ON r.b = s.rid GROUP BY r.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c USING (rid)
"""

QUERIES = {"op2_jaccard_join": op2_jaccard_join}
SQL = {"op2_jaccard_join": OP2_SQL}
