"""Clustering and whitening against plain loops, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest

from annalist.llm import clusters, quantised, whitening

SCHEMA = "vec_id long, embedding array<double>, x string, mult long, cluster int, h long, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 2, 3, 4, 5) for i, v in rows], SCHEMA)


def some(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=dims).round(3).tolist()) for k in range(n)]
    return rows + [(1000 + k, rows[k % 3][1]) for k in range(copies)]


BAD = [(-1, None), (-2, []), (-3, [1.0]), (-4, [float("nan")] * 5), (-5, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (-6, [None, 1.0, 1.0, 1.0, 1.0])]


def plain_lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centroids = [x for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [near(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            own = [x for (_, x), m in zip(kept, mine, strict=True) if m == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [(i, *near(x)) for i, x in kept]
    of = lambda j: sum(d for _, d, m in found if m == j)
    return sorted((str(i), j, d, of(j), sum(x[1] for x in found), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found)


@pytest.mark.parametrize(("k", "hot"), [(7, 10_000), (7, 2), (200, 10_000)])
def test_lloyd_against_loops(spark, monkeypatch, k, hot):
    monkeypatch.setattr(clusters, "HOT_ROWS", hot)
    rows = some(60, 5, 1, copies=40) + BAD + [(3, [0.5] * 5), (3, [0.5] * 5), (None, [0.25] * 5), (70, [-0.0, 1e300, -1e300, 0.0, 0.0])]
    got = clusters.weighted_lloyd(table(spark, rows), k=k, dims=5).collect()
    held = [(i, v if v is None else [c if c is None or not math.isfinite(c) else max(min(c, quantised.LARGEST / 256), -quantised.LARGEST / 256) for c in v]) for i, v in rows]
    assert sorted((str(r.vec_id), *tuple(r)[1:3], *tuple(r)[3:]) for r in got) == plain_lloyd(held, k, 5, 5)


def test_lloyd_without_rows_or_ids(spark):
    assert clusters.weighted_lloyd(table(spark, BAD), dims=5).collect() == []
    assert [(r.cluster, r.distance) for r in clusters.weighted_lloyd(table(spark, [(None, [1.0, 2.0])]), dims=2).collect()] == [(0, 0)]


def test_distances_beyond_floats_are_exact():
    x = np.array([[quantised.LARGEST, -quantised.LARGEST, 1] * 20])
    c = np.array([[-quantised.LARGEST, quantised.LARGEST, 0] * 20, [quantised.LARGEST, -quantised.LARGEST, 3] * 20])
    assert [a.tolist() for a in clusters.nearest(x, c)] == [[1], [80]]
    assert clusters.nearest(x, c[:1])[1].tolist() == [sum((int(a) - int(b)) ** 2 for a, b in zip(x[0], c[0], strict=True))]


def check_whitening(got, rows, dims, k):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, mean = len(fit), fit.mean(0)
    e, u = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    e, u = e[::-1], u[:, ::-1]
    sums = [sum(int(v) for v in col) for col in zip(*fit.astype(int).tolist(), strict=True)]
    assert len(got) == k * len(kept)
    by = sorted(got, key=lambda r: (r.component, str(r.vec_id)))
    for c in range(k):
        mine = by[c * len(kept) : (c + 1) * len(kept)]
        want = [(x - mean) @ u[:, c] / math.sqrt(e[c]) for _, x in sorted(kept, key=lambda r: str(r[0]))]
        sign = 1 if np.dot([r.whitened for r in mine], want) > 0 else -1
        assert np.allclose([sign * r.whitened for r in mine], want, rtol=1e-9, atol=1e-9)
        assert all(abs(r.explained - e[c] / e.sum()) < 1e-12 and r.identity_error < 1e-12 and r.n == n for r in mine)
        assert [r.deviation for r in mine] == [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in sorted(kept, key=lambda r: str(r[0]))]


@pytest.mark.parametrize("block", [4096, 3])
def test_whitening_against_eigenvectors(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = some(80, 6, 2, copies=50) + BAD
    check_whitening(whitening.whiten(table(spark, rows).repartition(9)).collect(), rows, 6, 4)


def test_whitening_of_the_table(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(whitening.op13_embedding_whitening(spark, data).collect(), rows, 64, 4)


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, BAD[:2])).collect() == []
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, 0.0)}
    line = whitening.whiten(table(spark, [(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [3.0, 6.0, 0.0])])).collect()
    assert all((r.whitened is None) == (r.component > 1) and (r.explained > 0.999) == (r.component == 1) for r in line) and len(line) == 9


def test_whitening_of_large_numbers(spark):
    x, sums = np.array([[quantised.LARGEST, 0], [0, 5]]), np.array([quantised.LARGEST, 5], object)
    assert whitening.deviations(x, 1 << 40, sums * (1 << 20)) == [None, None]
    assert np.allclose(whitening.centred(x, 1 << 40, sums << 39), [[quantised.LARGEST / 2, -2.5], [-quantised.LARGEST / 2, 2.5]])
    assert whitening.deviations(x, 2, sums) == [(2 * quantised.LARGEST - quantised.LARGEST) ** 2 + 25, quantised.LARGEST**2 + 25]


def test_jacobi_of_close_values():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    want = np.array([5, 5, 4, 3, 1, 1e-3, 1e-6, 1e-9, 0])
    sigma, v = whitening.jacobi(np.diag(want) @ q)
    assert np.allclose(sigma, want, rtol=1e-9, atol=1e-14) and np.allclose(v.T @ v, np.eye(9), atol=1e-13)
