"""Masked pseudo-likelihood: a window network that sees both sides predicts every token; summed log-probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm.common import Scratch, frames, hash_texts, released, table, width

OFFSETS = (-2, -1, 1, 2)
REACH = 2
#: Tokens outside the vocabulary share this many tokens by hash; the last token stands for what is beyond a text's ends.
BUCKETS = 32
#: Words that a task counts at once.
MEMORY = 2_000_000
#: Frequent words whose counts are sent to the tasks; all other counts are joined. Results don't depend on it.
SENT = 200_000
#: Words of a shard, the unit of training: texts are dealt to shards by hash, so results don't depend on partitions.
SHARD_WORDS = 1 << 22
#: Parameters that are summed together.
CHUNK = 4096
#: Logarithms and parameters are summed as whole multiples of one over these, so that the order of a shuffle changes nothing.
UNIT, FINE = 1 << 32, 1 << 24


class Tokens:
    """Words (hashes) as numbers: the vocabulary by frequency, then buckets, then the border; and log shares of words.

    A word outside the vocabulary has the share n(word) / n(bucket) of its bucket's tokens, so every word of the corpus
    has a probability of its own, and all of them sum to one. ``words``: hashes of the vocabulary by frequency;
    ``sizes``: all tokens by bucket; ``counts``: hashes and counts of frequent words.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, counts: tuple[np.ndarray, np.ndarray]):
        self.words = words
        self.border = len(words) + BUCKETS
        self.size = self.border + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.order = np.argsort(words, kind="stable")
        self.sorted = words[self.order]
        h, n = counts
        at = np.argsort(h, kind="stable")
        self.known, self.logs = h[at], np.round(np.log(n[at].astype(float)) * UNIT).astype(np.int64)
        inside = np.isin(h, words)
        sizes = sizes - np.bincount(self.bucket(h[inside]), n[inside], BUCKETS).astype(np.int64)
        self.whole = np.round(np.log(np.maximum(sizes, 1).astype(float)) * UNIT).astype(np.int64)

    @staticmethod
    def bucket(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(40)).astype(np.int64) % BUCKETS

    @staticmethod
    def _find(sorted_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
        return at, sorted_[at] == h

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers, and which words aren't in the vocabulary."""
        at, hit = self._find(self.sorted, h)
        out = len(self.words) + self.bucket(h)
        out[hit] = self.order[at[hit]]
        return out.astype(self.kind), ~hit

    def shares(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words outside the vocabulary: log shares in multiples of 1 / UNIT, without log n where it isn't known here."""
        at, hit = self._find(self.known, h)
        out = -self.whole[self.bucket(h)]
        out[hit] += self.logs[at[hit]]
        return out, hit


class Network:
    """Embeddings of the window, a tanh layer, and a two-step softmax: a token's class, then the token in its class.

    Classes are runs of equal length in the order of the vocabulary. All parameters are one float32 vector.
    """

    def __init__(self, size: int, dim: int = 8, hidden: int = 16, seed: int = 7):
        self.size, self.dim, self.hidden = size, dim, hidden
        self.per = int(np.ceil(np.sqrt(size)))
        self.classes = int(np.ceil(size / self.per))
        self.shapes = [(size, dim), (len(OFFSETS) * dim, hidden), (hidden,), (hidden, self.classes), (self.classes,), (self.classes, hidden, self.per), (self.classes, self.per)]
        rng = np.random.default_rng(seed)
        scale = [0.3, 0.3, 0, 0.1, 0, 0.1, 0]
        self.w = [(rng.standard_normal(s) * k).astype(np.float32) for s, k in zip(self.shapes, scale, strict=True)]
        last = size - (self.classes - 1) * self.per
        self.w[6][-1, last:] = -30  # places without a token

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, s in enumerate(self.shapes):
            n = int(np.prod(s))
            self.w[k] = flat[at : at + n].reshape(s).astype(np.float32).copy()
            at += n

    def _hidden(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.w[0][window].reshape(len(window), -1)
        h = x @ self.w[1]
        h += self.w[2]
        return x, np.tanh(h, out=h)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def _sorted(self, token: np.ndarray):
        """Rows in the order of their tokens, so that each class is a slice: order, class, place in it, slices."""
        order = np.argsort(token, kind="stable")
        own, place = np.divmod(token[order].astype(np.int64), self.per)
        ends = np.searchsorted(own, np.arange(self.classes + 1))
        return order, own, place, [(c, ends[c], ends[c + 1]) for c in np.flatnonzero(np.diff(ends)).tolist()]

    def log_prob(self, window: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log p(token | window) for rows of a batch."""
        order, own, place, slices = self._sorted(token)
        _, h = self._hidden(window[order])
        z = h @ self.w[3]
        z += self.w[4]
        p = self._softmax(z)[np.arange(len(token)), own]
        for c, a, b in slices:
            p[a:b] *= self._softmax(h[a:b] @ self.w[5][c] + self.w[6][c])[np.arange(b - a), place[a:b]]
        out = np.empty(len(token))
        out[order] = np.log(np.maximum(p.astype(np.float64), 1e-30))
        return out

    def learn(self, window: np.ndarray, token: np.ndarray, square: list[np.ndarray], rate: float) -> None:
        """One Adagrad step on a batch."""
        order, own, place, slices = self._sorted(token)
        window = window[order]
        x, h = self._hidden(window)
        n = len(token)
        g = [None] * 5 + [np.zeros_like(self.w[5]), np.zeros_like(self.w[6])]
        z = h @ self.w[3]
        z += self.w[4]
        d = self._softmax(z)
        d[np.arange(n), own] -= 1
        g[3], g[4] = h.T @ d, d.sum(0)
        dh = d @ self.w[3].T
        for c, a, b in slices:
            e = self._softmax(h[a:b] @ self.w[5][c] + self.w[6][c])
            e[np.arange(b - a), place[a:b]] -= 1
            g[5][c], g[6][c] = h[a:b].T @ e, e.sum(0)
            dh[a:b] += e @ self.w[5][c].T
        h *= h
        dh *= 1 - h
        g[1], g[2] = x.T @ dh, dh.sum(0)
        dx = (dh @ self.w[1].T).reshape(-1, self.dim)
        seen = window.ravel()
        g[0] = np.stack([np.bincount(seen, dx[:, k], self.size) for k in range(self.dim)], 1).astype(np.float32)
        for v, a, k in zip(self.w, square, g, strict=True):
            k /= n
            a += k * k
            v -= rate * k / (np.sqrt(a) + 1e-6)


def windows(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row i: the tokens around place ``at[i]`` of texts that have REACH borders before, between and behind them."""
    return np.stack([flat[at + o] for o in OFFSETS], 1).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def lowered(texts) -> list[bytes | None]:
    return [None if t is None else t.lower() for t in texts]


def counted_words(docs: DataFrame) -> DataFrame:
    """h (64-bit hash of a lower-cased word), n: all words of all texts, counted in each task before the shuffle."""

    def told(parts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        h, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield from frames(200_000, h=h.view(np.int64), n=n.astype(np.int64))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for pdf in batches:
            h = hash_texts(lowered(pdf["text"]))[1]
            parts.append(h)
            size += len(h)
            if size > MEMORY:
                yield from told(parts)
                parts, size = [], 0
        yield from told(parts)

    return _texts(docs).mapInPandas(released(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame, size: int) -> Tokens:
    """The ``size`` most frequent words (ties by hash), bucket sizes, and the counts of at most SENT further words."""
    top = counted.orderBy(F.desc("n"), "h").limit(size).collect()
    by_bucket = {r["b"]: r["n"] for r in counted.groupBy((F.shiftrightunsigned("h", 40) % BUCKETS).alias("b")).agg(F.sum("n").alias("n")).collect()}
    # a least count from the counts' counts: a sort would send SENT rows of every task to the driver
    least, room = None, len(top) + SENT
    for r in sorted(counted.where("n > 1").groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    known = {r["h"]: r["n"] for r in top}
    if least is not None:
        found = counted.where(F.col("n") >= least).toPandas()
        known |= dict(zip(found["h"].tolist(), found["n"].tolist(), strict=True))
    words = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    pair = np.fromiter(known, np.int64, len(known)).view(np.uint64), np.fromiter(known.values(), np.int64, len(known))
    return Tokens(words, np.array([by_bucket.get(b, 0) for b in range(BUCKETS)], np.int64), pair)


def tokenise(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """doc_id, n_tokens, ids (binary), inside (sum of log shares in 1 / UNIT), rest (hashes whose log n is missing)."""
    sent = docs.sparkSession.sparkContext.broadcast(tokens)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("inside", T.LongType()), T.StructField("rest", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for pdf in batches:
            counts, h = hash_texts(lowered(pdf["text"]))
            ids, outside = own.ids(h)
            ends = np.cumsum(counts)
            begins = ends - counts
            lost = np.flatnonzero(outside)
            share, hit = own.shares(h[lost])
            total = np.concatenate([[0], np.cumsum(share)])
            a, b = np.searchsorted(lost, begins), np.searchsorted(lost, ends)
            miss = lost[~hit]
            c, d = np.searchsorted(miss, begins), np.searchsorted(miss, ends)
            unknown = h[miss].view(np.int64)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_tokens": counts, "ids": pd.Series([ids[x:y].tobytes() for x, y in zip(begins, ends, strict=True)], dtype=object),
                "inside": total[b] - total[a], "rest": pd.Series([unknown[x:y] for x, y in zip(c, d, strict=True)], dtype=object)})

    return _texts(docs).mapInPandas(released(run), schema)


def shards(tokenised: DataFrame, tokens: Tokens, total: int, words: int) -> DataFrame:
    """ids: about ``words`` words of texts a row, with borders between texts. Which texts, and in which order, follows
    from hashes of doc_id and tokens alone."""
    n = max(1, -(-total // max(words, 1)))
    key = F.xxhash64("ids", "doc_id")
    dealt = tokenised.where("n_tokens > 0").select("ids", key.alias("key")).withColumn("shard", F.pmod(F.shiftright("key", 16), F.lit(n)))
    dealt = dealt.repartition(width(tokenised.sparkSession), "shard").sortWithinPartitions("shard", "key", "ids")
    gap = np.full(REACH, tokens.border, tokens.kind).tobytes()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, size = None, [], 0
        for pdf in batches:
            for s, ids in zip(pdf["shard"], pdf["ids"], strict=True):
                # a shard of far more words than expected (rows repeated under one doc_id) is cut, so that memory is bounded
                if held and (s != shard or size > 8 * words):
                    yield pd.DataFrame({"ids": [gap + gap.join(held) + gap]})
                    held, size = [], 0
                shard = s
                held.append(ids)
                size += len(ids) // len(gap) * REACH
        if held:
            yield pd.DataFrame({"ids": [gap + gap.join(held) + gap]})

    return dealt.select("shard", "ids").mapInPandas(released(pack), "ids binary")


def fit(dealt: DataFrame, tokens: Tokens, rounds: int = 2, batch: int = 8192, rate: float = 0.1) -> Network:
    """Trains over all texts: each shard is learnt from the shared parameters, then parameters are averaged by places seen.

    The places of all texts are dealt to the rounds by hash, so that each is predicted in one of them. Sums are of
    whole numbers and are shuffled by parameter, so one row for each comes to the driver.
    """
    spark = dealt.sparkSession
    net = Network(tokens.size)
    for step in range(rounds):
        sent = spark.sparkContext.broadcast((net.flat(), tokens.border, np.dtype(tokens.kind).str))

        def learn(batches: Iterator[pd.DataFrame], sent=sent, step=step) -> Iterator[pd.DataFrame]:
            flat, border, kind = sent.value
            total, weight = np.zeros(len(flat), np.int64), 0
            for pdf in batches:
                for packed in pdf["ids"]:
                    ids = np.frombuffer(packed, kind)
                    at = np.flatnonzero(ids != border)
                    mark = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    at = at[mark % np.uint64(rounds) == step]
                    if not len(at):
                        continue
                    own = Network(border + 1)
                    own.load(flat)
                    square = [np.full_like(v, 1e-4) for v in own.w]
                    at = at[np.random.default_rng(len(at)).permutation(len(at))]
                    for k in range(0, len(at), batch):
                        some = at[k : k + batch]
                        own.learn(windows(ids, some), ids[some], square, rate)
                    n = len(at) // 1024 + 1
                    total += np.round(own.flat().astype(np.float64) * FINE).astype(np.int64) * n
                    weight += n
            if weight:
                cuts = range(0, len(total), CHUNK)
                yield pd.DataFrame({"chunk": range(len(cuts)), "v": [total[k : k + CHUNK].tobytes() for k in cuts], "n": weight})

        got = summed(dealt.mapInPandas(released(learn), "chunk int, v binary, n long")).orderBy("chunk").collect()  # the parameters once
        if got:
            net.load(np.concatenate([np.frombuffer(r["v"], np.int64) / FINE / r["n"] for r in got]))
    return net


def summed(parts: DataFrame) -> DataFrame:
    """chunk, v, n: sums of vectors of whole numbers (binary) by chunk; a task holds one chunk at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, total, weight = None, None, 0
        for pdf in batches:
            for c, v, n in zip(pdf["chunk"], pdf["v"], pdf["n"], strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield pd.DataFrame({"chunk": [chunk], "v": [total.tobytes()], "n": [weight]})
                    chunk, total, weight = c, np.zeros(len(v) // 8, np.int64), 0
                total += np.frombuffer(v, np.int64)
                weight += n
        if chunk is not None:
            yield pd.DataFrame({"chunk": [chunk], "v": [total.tobytes()], "n": [weight]})

    return parts.repartition(width(parts.sparkSession), "chunk").sortWithinPartitions("chunk").mapInPandas(released(run), parts.schema)


def pseudo_likelihood(tokenised: DataFrame, net: Network, tokens: Tokens, batch: int = 16_384) -> DataFrame:
    """``tokenised`` with pll in place of ids: the sum of log p of every token (a word or its bucket) given both sides."""
    sent = tokenised.sparkSession.sparkContext.broadcast((net.flat(), tokens.border, np.dtype(tokens.kind).str))
    schema = T.StructType([T.StructField("pll", T.DoubleType()) if f.name == "ids" else f for f in tokenised.schema])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, border, kind = sent.value
        own = Network(border + 1)
        own.load(flat)
        gap = np.full(REACH, border, kind).tobytes()
        for pdf in batches:
            ids = np.frombuffer(gap + gap.join(pdf["ids"]) + gap, kind)
            lengths = pdf["n_tokens"].to_numpy()
            at = np.flatnonzero(ids != border)
            logs = np.empty(len(at) + 1)
            logs[-1] = 0
            for k in range(0, len(at), batch):
                some = at[k : k + batch]
                logs[k : k + len(some)] = own.log_prob(windows(ids, some), ids[some])
            ends = np.cumsum(lengths)
            sums = np.where(lengths > 0, np.add.reduceat(logs, np.minimum(ends - lengths, len(at))), 0.0) if len(lengths) else np.empty(0)
            yield pdf.assign(ids=sums).rename(columns={"ids": "pll"})[schema.names]

    return tokenised.mapInPandas(released(run), schema)


def joined_counts(read: DataFrame, counted: DataFrame) -> DataFrame:
    """row, more: the summed logarithms of the counts of each row's ``rest`` (word hashes), in multiples of 1 / UNIT.

    Words that occur once have log n = 0, so only the counts of the others are joined. Frequent words never are in
    ``rest``, so no key of this join is hot.
    """
    log_n = F.round(F.log(F.col("n").cast("double")) * UNIT).cast("long")
    counts = counted.where("n > 1").select("h", log_n.alias("log_n"))
    return read.select("row", F.explode("rest").alias("h")).join(counts.hint("merge"), "h").groupBy("row").agg(F.sum("log_n").alias("more"))


def score_documents(docs: DataFrame, size: int = 4000, rounds: int = 2, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_tokens, pll, pll_per_token: counts all words, trains the network and scores every whole text.

    log p(token) is the network's for the ``size`` most frequent words. For every other word of the corpus it is that of
    its bucket, from both sides, and of the word in its bucket, by its count: the counts grow with the corpus. Words are
    lower-cased (A-Z) and named by 64-bit hashes. Training has the order of hashes, so rows in other partitions get
    the same scores (up to rounding of sums). Null and blank texts have no tokens: pll 0, pll_per_token null. Repeated
    rows get equal scores. An empty table gives an empty result (the network stays as it was initialised). Texts of any
    length are scored whole. Other columns are ignored, whatever their names.
    """
    box = Scratch(docs.sparkSession, "lm")
    counted = box.save(counted_words(docs), "counts")
    tokens = vocabulary(counted, size)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # saved, so that a row keeps its number
    read = box.save(tokenise(docs, tokens).withColumn("row", F.monotonically_increasing_id()), "tokens")
    dealt = box.save(shards(read, tokens, total, shard_words), "shards")
    net = fit(dealt, tokens, rounds)
    box.drop("shards")
    scored = pseudo_likelihood(read.drop("rest"), net, tokens).join(joined_counts(read, counted).hint("merge"), "row", "left")
    pll = F.col("pll") + (F.col("inside") + F.coalesce("more", F.lit(0))) / F.lit(float(UNIT))
    return scored.select("doc_id", "n_tokens", pll.alias("pll"), F.when(F.col("n_tokens") > 0, pll / F.col("n_tokens")).alias("pll_per_token"))


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm_score": op10_lm_score}
SQL: dict[str, str] = {}
