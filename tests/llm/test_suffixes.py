"""Repeated byte strings against plain loops."""

import hashlib
import random

import numpy as np
import pytest

from annalist.llm import suffixes

SCHEMA = "doc_id long, text string, key string, b long, at int, starts string, settled boolean"


def plain(rows, least=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, t in texts:
        for p in range(len(t) - least + 1):
            seen[t[p : p + least]] = seen.get(t[p : p + least], 0) + 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if seen[t[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def told(spark, rows):
    table = spark.createDataFrame([(i, t, "k", 1, 2, "s", True) for i, t in rows], SCHEMA)
    found = suffixes.remove_repeated_bytes(table.repartition(3)).collect()
    return sorted((str(r.doc_id), r.n_bytes, sum(x.end - x.begin for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in found)


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdé fghij 😀") for _ in range(n))
    passage, other = some(500), some(260)
    rows = [(k, some(rng.randrange(400)) + passage[rng.randrange(200) : 300 + rng.randrange(200)] + some(rng.randrange(300))) for k in range(25)]
    edited = [(100 + k, passage[: 100 + 13 * k] + "#" + passage[100 + 13 * k :]) for k in range(12)]
    return [*rows, *edited, (200, other), (200, other), (201, other + some(50)), (202, other[:199]), (203, other[:199]), (None, other[30:230] + "!"), (204, None), (205, ""), (206, "ab" * 300), (207, "x" * 1500), (208, "x" * 199),
            (209, passage + passage), (210, (some(70) + "=") * 6), (211, passage[:200] + passage[:200])]


@pytest.mark.parametrize(("hot", "together", "longest"), [(20_000, 1 << 19, 1024), (0, 1 << 19, 1024), (3, 700, 40)])
def test_against_loops(spark, monkeypatch, hot, together, longest):
    """``hot``: kinds of a bucket from which it is split level by level."""
    for name, value in (("HOT", hot), ("TOGETHER", together), ("LONGEST", longest)):
        monkeypatch.setattr(suffixes, name, value)
    rows = corpus(hot)
    assert told(spark, rows) == plain(rows)


def test_empty_and_short(spark):
    assert told(spark, []) == []
    assert [r[1:4] for r in told(spark, [(1, "a" * 199), (2, "a" * 199), (3, None)])] == [(199, 0, 0), (199, 0, 0), (0, 0, 0)]
    with pytest.raises(ValueError, match="least"):
        suffixes.remove_repeated_bytes(spark.createDataFrame([], SCHEMA), 100)


def test_hot_copies_are_dealt_out(spark, monkeypatch):
    import annalist.llm.common as common

    monkeypatch.setattr(common.hot_keys, "__defaults__", (5,))
    rows = [(k, "y" * 250) for k in range(40)] + [(k, f"{k} " * 100) for k in range(40, 60)]
    assert told(spark, rows) == plain(rows)


def test_identifiers_name_whole_strings():
    codes = np.frombuffer(b"abcabcabcabx" * 30, np.uint8)
    ids = suffixes.identifiers(codes, 23)
    strings = [bytes(codes[p : p + 23]) for p in range(len(codes) - 22)]
    assert len(ids) == len(strings) and len(set(zip(ids.tolist(), strings, strict=True))) == len(set(ids.tolist())) == len(set(strings))
    assert suffixes.window_min(ids, 7).tolist() == [min(ids[p : p + 7].tolist()) for p in range(len(ids) - 6)]
