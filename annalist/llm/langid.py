"""Language ID by segmentation-marginalised unigrams over the pieces of a public vocabulary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm.common import Scratch, crc_mod, frames, released, table

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_RUN = re.compile(r"[^\W\d_]+")
#: Words this long are summed in logarithms; shorter ones can't underflow.
LONG = 40
#: Distinct words that a task remembers before it starts anew.
MEMORY = 300_000
#: Words whose segmentations are summed at once.
TOGETHER = 8192


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    if not text:
        return []
    words = _RUN.findall(text.lower())
    if not all(map(str.isalpha, words)):
        words = ["".join(filter(str.isalpha, w)) for w in words]
        words = [w for w in words if w]
    return words


def load_pieces(path: str = PIECES) -> dict[str, int]:
    """Lower-case pieces of letters (with or without the word mark) of a sentencepiece model, numbered."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    kept = sorted(n for n in {x.lower() for x in names} if n == MARK or n.removeprefix(MARK).isalpha())
    return {n: i for i, n in enumerate(kept)}


class Lattice:
    """All segmentations of many words into pieces; a letter without a piece is one unknown piece (number V)."""

    def __init__(self, pieces: dict[str, int]):
        import ahocorasick

        self.unknown = len(pieces)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, k in pieces.items():
            self.found.add_word(piece, k << 8 | len(piece))
        if pieces:
            self.found.make_automaton()

    def edges(self, words: list[str]):
        """Edges (begin, end, piece) over the boundaries of the words' letters, the offset of each edge's end in its
        word, and each word's first and last boundary. Boundaries are places in the words joined by line feeds."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        last = np.cumsum(lengths + 1) - 1
        first = last - lengths
        size = int(last[-1]) + 1
        flat = np.fromiter(chain.from_iterable(self.found.iter("\n".join(MARK + w for w in words))) if self.unknown else (), np.int64)
        end, value = flat[::2] + 1, flat[1::2]
        length, piece = value & 255, value >> 8
        alone = np.ones(size + 1, bool)
        alone[end[length == 1]] = False
        alone[first] = False
        alone[last[:-1] + 1] = False  # what follows a line feed is a first boundary
        alone[0] = alone[size] = False
        lost = np.flatnonzero(alone)
        end = np.concatenate([end, lost])
        begin = np.concatenate([end[: len(length)] - length, lost - 1])
        piece = np.concatenate([piece, np.full(len(lost), self.unknown)])
        own = np.searchsorted(last, end)
        return begin, end, piece, end - first[own], own, first, last


def forward(lattice: Lattice, words: list[str], probs: np.ndarray) -> np.ndarray:
    """For each word and row of ``probs``, log of the sum over all segmentations of the product of probabilities.

    All words go at once, end offset by end offset. A word's values are scaled by a constant a letter, so that long
    words neither vanish nor overflow within LONG letters; longer words are summed one by one in logarithms.
    """
    out = np.zeros((len(words), len(probs)))
    short = [i for i, w in enumerate(words) if len(w) < LONG]
    if len(short) < len(words):
        logs = np.log(probs)
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = _long(lattice, w, logs)[0][-1]
    if short:
        begin, end, piece, offset, _, first, last = lattice.edges([words[i] for i in short])
        a = np.zeros((int(last[-1]) + 1, len(probs)))
        a[first] = 1
        p = np.ascontiguousarray(probs.T)
        order = np.lexsort((end, offset))
        begin, end, piece, offset = begin[order], end[order], piece[order], offset[order]
        cuts = np.searchsorted(offset, np.arange(1, offset[-1] + 2))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y > x:
                part = a[begin[x:y]] * p[piece[x:y]]
                to = end[x:y]
                heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                a[to[heads]] = np.add.reduceat(part, heads)
        out[short] = np.log(a[last])
    return out


def _long(lattice: Lattice, word: str, logs: np.ndarray):
    """Forward and backward sums of one word in logarithms, and its edges."""
    begin, end, piece, _, _, _, last = lattice.edges([word])
    n = int(last[0])
    a, b = np.full((n + 1, len(logs)), -np.inf), np.full((n + 1, len(logs)), -np.inf)
    a[0], b[n] = 0, 0
    by_end, by_begin = np.argsort(end, kind="stable"), np.argsort(-begin, kind="stable")
    for k in by_end.tolist():
        a[end[k]] = np.logaddexp(a[end[k]], a[begin[k]] + logs[:, piece[k]])
    for k in by_begin.tolist():
        b[begin[k]] = np.logaddexp(b[begin[k]], b[end[k]] + logs[:, piece[k]])
    return a, b, begin, end, piece


def expected(lattice: Lattice, words: list[str], n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of all words (forward-backward), each word n times."""
    total = np.zeros(len(p))
    long_ = np.fromiter((len(w) >= LONG for w in words), bool, len(words))
    for i in np.flatnonzero(long_):
        a, b, begin, end, piece = _long(lattice, words[i], np.log(p)[None])
        np.add.at(total, piece, n[i] * np.exp(a[begin, 0] + np.log(p[piece]) + b[end, 0] - a[-1, 0]))
    short = np.flatnonzero(~long_)
    if not len(short):
        return total
    begin, end, piece, offset, own, first, last = lattice.edges([words[i] for i in short])
    a, b = np.zeros(int(last[-1]) + 1), np.zeros(int(last[-1]) + 1)
    a[first], w = 1, p[piece]
    order = np.lexsort((end, offset))
    cuts = np.searchsorted(offset[order], np.arange(1, offset.max() + 2))
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        k = order[x:y]
        np.add.at(a, end[k], a[begin[k]] * w[k])
    b[last] = n[short] / a[last]
    for x, y in zip(cuts[-2::-1], cuts[:0:-1], strict=True):  # an edge's end is done before its begin: later ends first
        k = order[x:y]
        np.add.at(b, begin[k], w[k] * b[end[k]])
    np.add.at(total, piece, a[begin] * w * b[end])
    return total


class LanguageModel:
    """Piece probabilities per language and class priors; small: pieces times languages."""

    def __init__(self, pieces: dict[str, int], langs: list[str], probs: np.ndarray, prior: np.ndarray):
        self.pieces, self.langs, self.probs, self.prior = pieces, langs, probs, prior

    def scorer(self):
        """A function of many texts: (language or und, score) for each."""
        lattice, langs = Lattice(self.pieces), self.langs
        prior = np.log(self.prior)
        known: dict[str, int] = {}
        logs = np.empty((0, len(langs)))

        def some(lists: list[list[str]]) -> Iterator[tuple[str, float]]:
            nonlocal logs
            if len(known) > MEMORY:
                known.clear()
                logs = logs[:0]
            fresh = list({w for words in lists for w in words}.difference(known))
            if fresh and langs:
                known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                logs = np.concatenate([logs, *(forward(lattice, fresh[k : k + TOGETHER], self.probs) for k in range(0, len(fresh), TOGETHER))])
            for words in lists:
                if not words or not langs:
                    yield "und", 0.0
                    continue
                total = prior + logs[[known[w] for w in words]].sum(0)
                best = int(total.argmax())
                yield langs[best], float(1 / np.exp(total - total[best]).sum())

        def score(texts) -> list[tuple[str, float]]:
            out, lists, n = [], [], 0
            for t in texts:
                lists.append(letters(t))
                n += len(lists[-1])
                if n >= 100_000:
                    out += some(lists)
                    lists, n = [], 0
            return out + list(some(lists))

        return score


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over whole texts; counted in each task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        size = 0

        def out():
            for lang, c in held.items():
                yield from frames(lang=[lang] * len(c), word=list(c), n=list(c.values()))
            held.clear()

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                words = letters(text)
                held.setdefault(lang, Counter()).update(words)
            size = sum(map(len, held.values()))
            if size > MEMORY:
                yield from out()
        yield from out()

    return docs.select("lang", "text").mapInPandas(released(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, path: str = PIECES, rounds: int = 2, smooth: float = 0.05) -> LanguageModel:
    """Fits piece probabilities of each non-null ``lang`` by EM over all words of ``docs`` (lang, text).

    A round is one pass over the distinct words: expected piece counts are summed per task, then per (language,
    piece). Only that table, bounded by vocabulary times languages, comes to the driver. Null texts add nothing.
    """
    spark = docs.sparkSession
    pieces = load_pieces(path)
    box = Scratch(spark, "langid")
    words = box.save(word_counts(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())), "words")
    shares = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(shares)
    v = len(pieces) + 1
    probs = np.full((len(langs), v), 1.0 / v)
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast((pieces, langs, probs))

        def step(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            known, names, now = sent.value
            lattice, total = Lattice(known), np.zeros(now.shape)
            for pdf in batches:
                for i, name in enumerate(names):
                    own = pdf[pdf["lang"] == name]
                    if len(own):
                        total[i] += expected(lattice, own["word"].tolist(), own["n"].to_numpy(float), now[i])
            for i in range(len(names)):
                at = np.flatnonzero(total[i])
                yield pd.DataFrame({"lang": i, "piece": at, "n": total[i][at]})

        got = words.mapInPandas(released(step), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(probs.shape, smooth)
        counts[got["lang"].to_numpy(), got["piece"].to_numpy()] += got["n"].to_numpy()
        probs = counts / counts.sum(1, keepdims=True)
    box.drop("words")
    prior = np.array([shares[x] for x in langs], float)
    return LanguageModel(pieces, langs, probs, prior / prior.sum() if langs else prior)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred and score; ``und`` and 0 for null texts and texts without a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = sent.value.scorer()
        for pdf in batches:
            found = score(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    return docs.select("doc_id", "text").mapInPandas(released(run), schema)


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known: not ``und``, and a score of ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = sent.value.scorer()
        for text in texts:
            found = score(text)
            yield pd.Series([lang != "und" and s >= least for lang, s in found], dtype=bool)

    return docs.where(F.pandas_udf(released(known), "boolean")("text"))


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(crc_mod(key, 4) == 2, F.lit(False))


def identify(docs: DataFrame, path: str = PIECES) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from rows that aren't held out, then predicts every row.

    Null texts and texts without a letter: ``und``, 0. Rows without a language teach nothing; if none has one, every row is
    ``und``. Texts of any length are read whole. Repeated rows count as often as they come, and get equal predictions;
    ties go to the language first by name. An empty table gives an empty result; other columns are ignored, whatever
    their names. A null doc_id isn't held out.
    """
    model = train(docs.where(~held_out()), path)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
