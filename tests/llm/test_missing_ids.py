"""Documents without doc_id, and texts that share one, link like all others."""

import random

import pytest

import corpus_pipeline
from annalist.llm import jaccard

SCHEMA = "doc_id long, text string, node string, tk string, first_id long, n int"


def words(a, b):
    return " ".join(f"w{k}" for k in range(a, b))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 5, 6) for i, t in rows], SCHEMA)


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sets, [find(a) for a in range(len(rows))], least


def test_a_bridge_without_id(spark):
    rows = [(1, words(0, 100)), (None, words(6, 106)), (2, words(12, 112)), (3, "other words here now")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, rows)).collect())
    assert got == [("1", 97, 1), ("2", 97, 1), ("3", 1, 3), ("None", 97, 1)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [10_000, 3])
def test_random_ids(spark, monkeypatch, seed, hot):
    """Ids that are null, repeat or are larger than doubles can tell, and components without any."""
    monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
    rng = random.Random(seed)
    rows = []
    for k in range(70):
        a = rng.choice([0, 0, 0, 40, 400])
        begin = a + rng.randrange(0, 14)
        rows.append((rng.choice([None, None, 7, k, k, (1 << 60) + k]), words(begin, begin + 95 + rng.randrange(8))))
    rows += [(None, words(900, 930)), (None, words(900, 930)), (None, words(900, 931)), (8, None), (None, None), (9, "")]
    sets, roots, least = brute(rows, 4, 85, 100)
    want = sorted((str(i), len(s), str(least.get(r)) if s else str(i)) for (i, _), s, r in zip(rows, sets, roots, strict=True))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(table(spark, rows)).collect()) == want


def test_one_document_of_each_group_stays(spark):
    long = words(0, 200)
    rows = [(5, long), (None, long + " a"), (5, words(300, 500)), (2, words(300, 501)), (None, words(600, 700)), (None, words(600, 701)), (6, None), (None, None), (7, "only here"), (7, long + " b"), (9, "twice the same row"), (9, "twice the same row")]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(5, long), (2, words(300, 501)), *[x for x in kept if x[0] is None and x[1]], (6, None), (None, None), (7, "only here"), (9, "twice the same row"), (9, "twice the same row")]))
    assert len([x for x in kept if x[0] is None and x[1]]) == 1  # one of the two without an id, none of the copy of 5
