"""The join of vectors writes each vector about once, however many it is compared with."""

import os

import numpy as np

from annalist.llm import common, vectors


def test_disk_grows_with_the_vectors(spark, monkeypatch):
    sizes, write = [], common.Scratch.write

    def told(self, df, name, partition_by=None):
        path = write(self, df, name, partition_by)
        sizes.append(sum(os.path.getsize(f"{at}/{f}") for at, _, names in os.walk(path.removeprefix("file:")) for f in names))
        return path

    monkeypatch.setattr(common.Scratch, "write", told)
    monkeypatch.setattr(vectors, "BLOCK", 256)
    x = np.random.default_rng(3).normal(size=(3000, 32)).astype(np.float32)  # in no groups: no cell can be ruled out
    x[1500:1510] = x[:10] + np.float32(1e-3)
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.range_join(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    assert {k: v for k, v in found.items() if v != (0, k)} == {k: (1, k % 1500) for k in (*range(10), *range(1500, 1510))}
    assert sum(sizes) < 3 * x.nbytes
