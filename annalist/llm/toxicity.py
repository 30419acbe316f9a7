"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm.common import Scratch, crc_mod, frames, released, table

#: Common public insults, given to the fixed lexicon voters.
INSULTS = {
    "en": "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown dumb fool garbage filth vermin imbecile ugly",
    "de": "idiot idioten dumm dummkopf trottel abschaum wertlos erbärmlich widerlich versager müll depp",
    "fr": "idiot idiote imbécile crétin stupide ordure minable dégoûtant abruti nul raté débile",
    "es": "idiota idiotas imbécil estúpido basura escoria patético asqueroso inútil payaso tonto",
}
_WORD = re.compile(r"[^\W\d_]+")
_ABUSE = re.compile(r"(?i)\b(?:shut up|get lost|go to hell|drop dead|nobody likes you|i hate you)\b")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b[^.?]{0,40}!{2,}")
_LOUD = re.compile(r"!{2,}")
#: Forms of address, next to which a lexicon word is an insult to someone.
ADDRESS = frozenset("you your youre du dich dein deine ihr tu toi te vous eres tú ti usted".split())
PREFIXES = (4, 5, 6, 7, 8)
#: Learned entries vote in bands of their lift (share among toxic words over that among clean ones).
BANDS = (4.0, 8.0, 16.0, 32.0)
MEMORY = 300_000

#: Voters: four fixed lists; whole words and beginnings of each band; patterns and densities.
NAMES = (
    *(f"insults_{x}" for x in INSULTS),
    *(f"{kind}_{b:.0f}" for kind in ("word", "prefix") for b in BANDS),
    "abuse_phrase", "shouting", "exclamations", "addressed", "many_strong", "dense_1", "dense_3", "several",
)
VOTERS = len(NAMES)


def entries_of(word: str) -> list[str]:
    """A word's lexicon entries: itself, and its beginnings (marked by ``*``)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class Lexicon:
    """Finds the entries in texts, casts the votes and gives the features."""

    def __init__(self, entries: list[str], lifts: list[float]):
        self.index = {e: i for i, e in enumerate(entries)}
        lift = np.array(lifts, float)
        self.strong = lift >= BANDS[2]
        band = np.clip(np.searchsorted(BANDS, lift, side="right") - 1, 0, len(BANDS) - 1)
        self.voter = 4 + band + len(BANDS) * np.array([e.endswith("*") for e in entries], int)
        self.fixed: dict[str, list[int]] = {}
        for k, words in enumerate(INSULTS.values()):
            for w in words.split():
                self.fixed.setdefault(w, []).append(k)
        self._known: dict[str, tuple] = {}

    def _look(self, w: str) -> tuple:
        ids = [i for e in entries_of(w) if (i := self.index.get(e)) is not None]
        fixed = self.fixed.get(w, ())
        self._known[w] = k = (tuple(ids), tuple(fixed)) if ids or fixed else ()
        return k

    def read(self, text: str | None) -> tuple[str, list[int], list[float]]:
        """The votes (a character a voter: t toxic, c clean, - none) and sparse features of a whole text."""
        text, get = text or "", self._known.get
        words = _WORD.findall(text.lower())
        if len(self._known) > MEMORY:
            self._known.clear()
        got = [get(w) for w in words]
        for i in [i for i, k in enumerate(got) if k is None]:
            got[i] = self._look(words[i])
        found, fixed, addressed = Counter(), [0] * 4, False
        hits = [i for i, k in enumerate(got) if k]
        for i in hits:
            found.update(got[i][0])
            for k in got[i][1]:
                fixed[k] += 1
            if got[i][1] or any(self.strong[j] for j in got[i][0]):
                addressed = addressed or not ADDRESS.isdisjoint(words[max(0, i - 3) : i + 4])
        strong = [i for i in hits if got[i][1] or any(self.strong[j] for j in got[i][0])]
        per = [0] * VOTERS
        for i, n in found.items():
            per[self.voter[i]] += n
        n = max(len(words), 1)
        votes = ["t" if k else "-" for k in fixed]
        votes += ["t" if per[4 + k] else "c" if k % len(BANDS) < 2 else "-" for k in range(2 * len(BANDS))]
        votes += [
            "t" if _ABUSE.search(text) else "-",
            "t" if _SHOUT.search(text) else "-",
            "t" if len(_LOUD.findall(text)) >= 2 else "-",
            "t" if addressed else "-",
            "t" if len(strong) >= 3 else "c" if not strong else "-",
            "t" if len(strong) >= 0.01 * n and strong else "c",
            "t" if len(strong) >= 0.03 * n and strong else "-",
            "t" if len({words[i] for i in strong}) >= 2 else "c" if not hits else "-",
        ]
        size, ids = len(self.index), sorted(found)
        values = [float(np.log1p(min(found[i], 20))) for i in ids]
        more = [*np.log1p(fixed).tolist(), np.log1p(len(strong)), np.log1p(len({words[i] for i in strong})), min(1.0, 20 * len(strong) / n), float(len(strong) > 0), float(len(strong) > 1), float(addressed), *(float(v == "t") for v in votes[4 + 2 * len(BANDS) :][:3])]
        for k, x in enumerate(more):
            if x:
                ids.append(size + k)
                values.append(float(x))
        return "".join(votes), ids, values

    @property
    def width(self) -> int:
        return len(self.index) + 13


class LabelModel:
    """p(class) times p(each vote | class, vote of the voter it depends on): accuracies and correlations of all voters.

    ``prior``: share of toxic rows. Until there is a tree, votes depend on the class alone. ``tables[j]`` has the shape
    (class, parent's vote, vote).
    """

    def __init__(self, prior: float, parents: list[int] | None = None, tables: np.ndarray | None = None):
        self.prior, self.parents = float(np.clip(prior, 1e-4, 0.9)), parents or [-1] * VOTERS
        self.tables = tables

    @staticmethod
    def codes(votes) -> np.ndarray:
        flat = np.frombuffer("".join(votes).encode(), np.uint8).reshape(-1, VOTERS)
        return np.select([flat == ord("t"), flat == ord("c")], [1, 0], 2)

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        if self.tables is None:  # the first guess: more votes for toxic than against
            lead = (codes == 1).sum(1) - 0.5 * (codes == 0).sum(1)
            return np.where(lead > 0, 0.9, 0.05)
        odds = np.full(len(codes), np.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.parents):
            above = codes[:, p] if p >= 0 else np.zeros(len(codes), int)
            t = self.tables[j]
            odds += np.log(t[1, above, codes[:, j]] / t[0, above, codes[:, j]])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def statistics(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected counts of pairs of votes by class: (2, 3 voters, 3 voters)."""
        q = self.posterior(codes)
        x = np.eye(3)[codes].reshape(len(codes), 3 * VOTERS)
        return np.stack([(x * (n * w)[:, None]).T @ x for w in (1 - q, q)])

    def improved(self, counts: np.ndarray, grow: bool) -> LabelModel:
        """The next EM step's model; ``grow`` chooses the dependencies anew: a tree of largest mutual information given the class."""
        c = counts.reshape(2, VOTERS, 3, VOTERS, 3) + 0.02
        parents = _tree(c) if grow else self.parents
        tables = np.empty((VOTERS, 2, 3, 3))
        for j, p in enumerate(parents):
            joint = c[:, p, :, j, :] if p >= 0 else np.repeat(np.diagonal(c[:, j, :, j, :], axis1=1, axis2=2)[:, None, :], 3, 1)
            # a vote's distribution under a rare vote of its parent leans on that under the class alone
            alone = np.diagonal(c[:, j, :, j, :], axis1=1, axis2=2)
            alone = alone / alone.sum(1, keepdims=True)
            joint = joint + 5 * alone[:, None, :] if p >= 0 else joint
            tables[j] = joint / joint.sum(2, keepdims=True)
        return LabelModel(self.prior, parents, tables)

    def correlations(self, counts: np.ndarray) -> np.ndarray:
        """Correlations of all pairs of voters (votes as -1, 0, 1) within the classes, averaged by the classes' sizes."""
        c = counts.reshape(2, VOTERS, 3, VOTERS, 3)
        value, out = np.array([-1.0, 1.0, 0.0]), np.zeros((VOTERS, VOTERS))
        size = c[:, 0, :, 0, :].sum((1, 2))
        for y in (0, 1):
            n = max(size[y], 1e-9)
            second = np.einsum("ajbk,j,k->ab", c[y], value, value) / n
            mean = np.einsum("ajak,k->a", c[y], value) / n
            cov = second - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            out += cov / np.outer(sd, sd) * size[y] / max(size.sum(), 1e-9)
        return out


def _tree(c: np.ndarray) -> list[int]:
    """Parents of a maximum spanning tree of the voters' mutual information given the class (Prim, from voter 0)."""
    total = c[:, 0, :, 0, :].sum()
    p = np.transpose(c, (0, 1, 3, 2, 4)) / total  # class, voter, voter, vote, vote
    left, right, both = p.sum(4, keepdims=True), p.sum(3, keepdims=True), p.sum((3, 4), keepdims=True)
    gain = (p * np.log(p * both / (left * right))).sum((0, 3, 4))
    parents, inside = [-1] * VOTERS, [0]
    while len(inside) < VOTERS:
        _, i, j = max((gain[i, j], -i, -j) for i in inside for j in range(VOTERS) if j not in inside)
        parents[-j] = -i
        inside.append(-j)
    return parents


def label_model(patterns: DataFrame, prior: float, rounds: int = 6) -> tuple[LabelModel, np.ndarray]:
    """EM over ``patterns`` (votes, n): ``rounds`` steps with independent voters, as many with a tree of dependencies.

    Each step is one pass over the saved patterns; only expected counts of pairs of votes, a matrix whose size is that
    of the voters squared, come to the driver. Gold labels aren't voters: they give ``prior`` and the lexicon.
    """
    spark, model, counts = patterns.sparkSession, LabelModel(prior), np.zeros((2, 3 * VOTERS, 3 * VOTERS))
    for step in range(2 * rounds):
        sent = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, 3 * VOTERS, 3 * VOTERS))
            for pdf in batches:
                if len(pdf):
                    total += sent.value.statistics(LabelModel.codes(pdf["votes"]), pdf["n"].to_numpy(float))
            # whole multiples of 1 / 1024, so that the order of tasks changes nothing
            at = np.flatnonzero(total)
            yield pd.DataFrame({"i": at, "x": np.round(total.ravel()[at] * 1024).astype(np.int64)})

        got = patterns.mapInPandas(expect, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect()
        counts = np.zeros(2 * (3 * VOTERS) ** 2)
        counts[[r["i"] for r in got]] = [r["x"] / 1024 for r in got]
        counts = counts.reshape(2, 3 * VOTERS, 3 * VOTERS)
        model = model.improved(counts, step == rounds)
    return model, counts


def fit_linear(rows: list[tuple[list[int], list[float]]], y: np.ndarray, width: int, l2: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels (Adam, full batches, from zero); the last weight is the intercept."""
    x = np.zeros((len(rows), width + 1), np.float32)
    for r, (ids, values) in enumerate(rows):
        x[r, ids] = values
    x[:, -1] = 1
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ (p - y).astype(np.float32) / max(len(y), 1) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def calibrated(w: np.ndarray, rows: list[tuple[list[int], list[float]]], y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Scales and shifts the weights so that scores are probabilities of gold labels (two parameters, Newton's method);
    as they are, if the rows have one class only. A scale that isn't positive, which would turn the order round, isn't taken."""
    if not 0 < y.sum() < len(y):
        return w
    m = np.array([w[-1] + np.dot(w[ids], values) if len(ids) else w[-1] for ids, values in rows])
    x, b = np.column_stack([m, np.ones(len(m))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + 0.1 * (b - [1.0, 0.0])
        b = b - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), g)
    if not np.isfinite(b).all() or b[0] <= 0:
        return w
    out = w * b[0]
    out[-1] += b[1]
    return out


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(crc_mod(key, 5) == 0, F.lit(False))


def learned_entries(docs: DataFrame, gold: DataFrame, size: int) -> list:
    """The ``size`` lexicon entries (entry, lift) most tied to toxic rows, counted over all rows of ``gold``.

    A row counts each of its words once. An entry needs three toxic rows' words, a share among their words of four
    times that among clean ones after smoothing, and a G-squared of 12; the largest G-squared stay (ties by entry).
    Texts are joined by shuffle at every size; words are counted in each task before the shuffle.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (Counter(), Counter())

        def out():
            for y in (0, 1):
                yield from frames(word=list(held[y]), gold=[y] * len(held[y]), n=list(held[y].values()))
                held[y].clear()

        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["gold"], strict=True):
                held[y].update(set(_WORD.findall((text or "").lower())))
            if len(held[0]) + len(held[1]) > MEMORY:
                yield from out()
        yield from out()

    labelled = docs.select("doc_id", "text").join(gold.hint("merge"), "doc_id").select("text", "gold")
    words = labelled.mapInPandas(released(count), "word string, gold int, n long").groupBy("word").agg(*(F.sum(F.when(F.col("gold") == y, F.col("n")).otherwise(0)).alias(name) for y, name in ((0, "clean"), (1, "toxic"))))
    long_ = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]
    entry = F.explode(F.array_compact(F.array(F.col("word"), *long_))).alias("entry")
    counted = words.select(entry, "toxic", "clean").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    total = Scratch(docs.sparkSession, "toxicity").save(counted, "entries")
    sums = total.where(~F.endswith("entry", F.lit("*"))).agg(F.sum("a"), F.sum("b")).first()
    n, m = (F.lit(float(max(x or 0, 1))) for x in sums)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    lift = ((a + 0.5) / (n + 1)) / ((b + 0.5) / (m + 1))
    rate, log = (a + b) / (n + m), lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    g = 2 * (a * (log(a / n) - log(rate)) + (n - a) * (log(1 - a / n) - log(1 - rate)) + b * (log(b / m) - log(rate)) + (m - b) * (log(1 - b / m) - log(1 - rate)))
    return total.where(a >= 3).select("entry", lift.alias("lift"), g.alias("g")).where("lift >= 4 and g >= 12").orderBy(F.desc("g"), "entry").limit(size).collect()


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, size: int = 400) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    ``sample``: labelled rows, chosen by hash of doc_id, that the classifier is fitted on (all, if there are fewer; of
    rows that share a doc_id, that of the least votes). ``size``: learned lexicon entries, counted over all labelled
    rows. The label model's votes are counted over all documents; gold labels of rows that aren't held out give the
    lexicon, the share of toxic rows and the scale of the scores (over the sample), and are no voter. A doc_id with several labels counts as toxic if one says so;
    null labels are none. Null and empty texts have no hits and get the score of such texts; texts of any length are
    read whole; repeated rows get equal scores. Without labels the score is the label model's posterior. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    box = Scratch(spark, "toxicity")
    gold = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("gold"))
    n_of = {r["gold"]: r["n"] for r in gold.groupBy("gold").agg(F.count("*").alias("n")).collect()}
    chosen = learned_entries(docs, gold, size)
    lexicon = spark.sparkContext.broadcast(([r["entry"] for r in chosen], [r["lift"] for r in chosen]))
    kind = T.StructType([docs.schema["doc_id"], T.StructField("votes", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(*lexicon.value)
        for pdf in batches:
            got = [lex.read(text) for text in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: pd.Series([x[k] for x in got], dtype=object) for k, c in enumerate(("votes", "ids", "values"))}})

    # texts are read once: votes and features are small
    seen = box.save(docs.select("doc_id", "text").mapInPandas(released(read), kind), "read")
    patterns = box.save(seen.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    prior = (n_of.get(1, 0) + 1) / (sum(n_of.values()) + 10)
    model, _ = label_model(patterns, prior)
    picked = gold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows
    least = F.min(F.struct("votes", "ids", "values")).alias("x")
    rows = seen.join(F.broadcast(picked.select("doc_id")), "doc_id").groupBy("doc_id").agg(least).join(F.broadcast(picked), "doc_id").select("doc_id", "gold", "x.*").orderBy("doc_id").collect()
    weights = None
    if rows:
        y = model.posterior(LabelModel.codes([r["votes"] for r in rows]))
        sparse = [(r["ids"], r["values"]) for r in rows]
        weights = calibrated(fit_linear(sparse, y, len(chosen) + 13), sparse, np.array([r["gold"] for r in rows], float))
    sent = spark.sparkContext.broadcast((weights, model))
    out = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, labelled = sent.value
        for pdf in batches:
            if w is None:
                got = labelled.posterior(LabelModel.codes(pdf["votes"])) if len(pdf) else []
            else:
                got = [1 / (1 + np.exp(-np.clip(w[-1] + (np.dot(w[ids], values) if len(ids) else 0.0), -30, 30))) for ids, values in zip(pdf["ids"], pdf["values"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.asarray(got, float)})

    scored = seen.select("doc_id", "votes", "ids", "values").mapInPandas(score, out)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
