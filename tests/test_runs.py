"""Model runs, prepared plans, evidence chains, projections and WebVTT ingest on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from annalist.operators import completion, evidence, mentions, prepared, projection
from annalist.sources import cues, ingest


def adapter_of(spark, answers):
    """Answers by (record, block, kind): (rows or text, finish reason)."""

    def adapter(requests):
        rows = [(r.request_sha256, r.record_id, r.block, r.kind) for r in requests.collect()]
        out = []
        for sha, *key in rows:
            if tuple(key) in answers:
                given, finish = answers[tuple(key)]
                out.append((sha, given if isinstance(given, str | None) else json.dumps({"results": [{"segment": s, "code": c} for s, c in given]}), finish))
        return spark.createDataFrame(out, "request_sha256 string, answer string, finish_reason string")

    return adapter


def test_one_supplement_or_nothing(spark, tmp_path):
    s = spark.createDataFrame([(r, i, "x") for r in range(1, 8) for i in range(5)], "record_id long, idx int, text string")
    full = lambda *ids: [(i, "A") for i in ids]
    answers = {}
    for r in range(1, 8):
        answers |= {(r, 0, "original"): (full(0, 1, 2), "stop"), (r, 1, "original"): (full(4, 3), "stop")}
    answers |= {(2, 0, "original"): (full(1), "stop"), (2, 0, "supplement"): (full(2, 0), "stop")}  # whole by one supplement
    answers |= {(3, 0, "original"): (full(1), "stop"), (3, 0, "supplement"): (full(2), "stop")}  # lacks again
    answers |= {(4, 1, "original"): (full(3), "length")}  # cut off, though sound
    answers |= {(5, 0, "original"): (full(0, 1), "stop"), (5, 0, "supplement"): (full(2, 1), "stop")}  # brings one twice
    answers |= {(6, 1, "original"): (full(3), "stop")}  # no second answer at all
    answers.pop((7, 0, "original"))
    done, outcomes = completion.run(s, adapter_of(spark, answers), f"{tmp_path}/run", ["A"] and None, 3)
    assert sorted(tuple(r) for r in outcomes.collect()) == [(1, 5, 0, None, None), (2, 5, 1, None, None), (3, 5, 1, 0, "supplement-incomplete"), (4, 5, 0, 1, "finish"), (5, 5, 1, 0, "supplement-ids"), (6, 5, 1, 1, "supplement-finish"), (7, 5, 0, 0, "finish")]
    rows = sorted(tuple(r) for r in done.collect())
    assert rows == [(r, i, "A", f"S{i + 1:03d}", r == 2 and i in (0, 2)) for r in (1, 2) for i in range(5)]
    assert completion.run(s.where("false"), adapter_of(spark, {}), f"{tmp_path}/none")[0].collect() == []


def test_models_are_asked_once(spark, tmp_path):
    """Answers are recorded: reading the results again asks nothing."""
    s, asked = spark.createDataFrame([(1, 0), (1, 1)], "record_id long, idx int"), []

    def adapter(requests):
        asked.append(requests.count())
        return requests.select("request_sha256", F.lit('{"results":[{"segment":0,"code":"A"}]}').alias("answer"), F.lit("stop").alias("finish_reason")).where("kind = 'original'")

    done, outcomes = completion.run(s, adapter, f"{tmp_path}/run")
    assert [outcomes.count(), outcomes.count(), done.count()] == [1, 1, 0] and asked == [1, 1]


REGISTER = "entity_type string, surface string, number long, seq long"
TYPES = ["P", "Q"]


def test_numbers_as_of_a_plan(spark):
    register = spark.createDataFrame([("P", "a", 1, 5), ("P", "b", 2, 10), ("Q", "a", 1, 12), ("P", "c", 3, 20)], REGISTER)
    plans = spark.createDataFrame([(1, 11, 10), (2, 30, 20), (3, 4, None), (4, 20, 12), (5, 11, 5)], "plan long, seq long, basis long")
    needs = spark.createDataFrame([(p, t, s) for p in range(1, 5) for t, s in [("P", "a"), ("P", "c"), ("P", "z"), ("Q", "a")]] + [(1, "P", "a")], "plan long, entity_type string, surface string")
    got = {(r.plan, r.entity_type, r.surface): r.number for r in prepared.allocated(plans, needs, register, TYPES).collect()}
    ids = {s: r.i for s in "acz" for r in spark.range(1).select(mentions.entity_id(F.lit("P"), F.lit(s)).alias("i")).collect()}
    c, z = (3, 4) if ids["c"] < ids["z"] else (4, 3)
    assert [got[1, *k] for k in [("P", "a"), ("P", "c"), ("P", "z"), ("Q", "a")]] == [1, c, z, 1]  # c comes later, so it is new
    assert [got[2, *k] for k in [("P", "a"), ("P", "c"), ("P", "z"), ("Q", "a")]] == [1, 3, 4, 1]
    order = sorted("acz", key=ids.get)
    assert [got[3, "P", s] for s in "acz"] == [order.index(s) + 1 for s in "acz"] and got[4, "P", "c"] in (3, 4)  # an entry of its own seq isn't before it
    right = spark.createDataFrame([(*k, v) for k, v in got.items() if k[0] != 5], "plan long, entity_type string, surface string, number long")
    assert [tuple(r) for r in prepared.findings(plans, needs, right, register, TYPES).collect()] == [(5, "moved", None, None, 10, 5)]
    wrong = right.where("not (plan = 1 and surface = 'a' and entity_type = 'Q')").withColumn("number", F.expr("if(plan = 2 and surface = 'z', 9, number)")).unionByName(spark.createDataFrame([(3, "Q", "new", 8)], right.schema))
    found = sorted(tuple(r) for r in prepared.findings(plans, needs, wrong, register, TYPES).where("finding <> 'moved'").collect())
    assert found == [(1, "lost", "Q", "a", 1, None), (2, "number", "P", "z", 4, 9), (3, "extra", "Q", "new", None, 8)]
    assert prepared.findings(plans.where("false"), needs.where("false"), right.where("false"), register, TYPES).collect() == []


def test_evidence_is_followed_link_by_link(spark):
    R, P, L, C = evidence.REVISION, evidence.PROJECTION, evidence.LANGUAGES, evidence.CONFIRM
    rows = [(1, 1, C, None, None), (1, 2, R, "a", None), (1, 3, C, None, None), (1, 4, P, "b", "x"), (1, 5, C, None, None), (1, 6, P, "a", "x"), (1, 7, C, None, None), (1, 8, L, "y", None), (1, 9, L, "x", None), (1, 10, C, None, None),
            (1, 11, P, "a", "y"), (1, 12, C, None, None), (1, 13, R, "b", None), (1, 14, L, "x", None), (1, 15, C, None, None), (1, 16, R, "c", None), (1, 17, C, None, None), (2, 18, L, "x", None), (2, 19, P, "a", None), (2, 20, R, "a", None), (2, 21, C, None, None)]
    e = spark.createDataFrame(rows, "record_id long, seq long, kind string, output string, assignment string")
    got = sorted(tuple(r)[1:] for r in evidence.chains(e.repartition(3)).collect())
    assert got == [(1, None, None, None, None, None, "revision"), (3, "a", 2, None, None, None, "projection"), (5, "a", 2, None, None, None, "projection"), (7, "a", 2, 6, "x", None, "languages"), (10, "a", 2, 6, "x", 9, None), (12, "a", 2, 11, "y", 8, None),
                   (15, "b", 13, 4, "x", 14, None), (17, "c", 16, None, None, None, "projection"), (21, "a", 20, 19, None, None, "languages")]
    assert evidence.chains(e.where("false")).collect() == []


TEXTS = [(1, 0, "Ärger 😀"), (1, 3, "two\nlines --> here"), (1, 9, "NOTE end"), (2, 0, "a\n\nb"), (3, 0, "x\r"), (4, 0, "WEBVTT")]


def test_projections_are_what_the_scanner_reads(spark):
    s = spark.createDataFrame(TEXTS, "record_id long, idx int, text string")
    docs = projection.project(s)
    assert {r.record_id: r.problem for r in docs.collect()} == {1: None, 2: "text", 3: "text", 4: None}
    files = docs.where("problem is null").select("record_id", F.lit("vtt").alias("format"), "source")
    read = {(r.record_id, r.cue_index): (r.start, r.end, r.source[r.start : r.end]) for r in cues.accepted(cues.scan(files)).join(files.select("record_id", "source"), "record_id").collect()}
    placed = {(r.record_id, r.cue): (r.doc_start, r.doc_start + len(r.text), r.text) for r in projection.places(s.where("record_id in (1, 4)")).collect()}
    assert read == placed and len(read) == 4


@pytest.mark.parametrize("seed", range(3))
def test_marks_there_and_back(spark, seed):
    """All marks of a small text: cut at segments, and back to the same characters."""
    texts = [t for r, _, t in TEXTS if r == 1]
    full = "\n".join(texts)
    s = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "record_id long, idx int, text string")
    placed = projection.places(s)
    pairs = [(a, b) for a in range(seed - 1, len(full) + 2, 3) for b in range(a, len(full) + 3, 2)]
    marks = spark.createDataFrame([(1, a, b, "PERSON") for a, b in pairs], "record_id long, start long, end long, entity_type string")
    spans = projection.to_cues(marks, placed)
    got = {}
    for r in projection.to_text(spans, placed).collect():
        assert texts[r.cue][r.start : r.end] == full[r.text_start : r.text_end]
        got.setdefault((r.mark_start, r.mark_end), set()).update(range(r.text_start, r.text_end))
    breaks = {len(texts[0]), len(texts[0]) + 1 + len(texts[1])}
    for a, b in pairs:
        assert got.get((a, b), set()) == {k for k in range(max(a, 0), min(b, len(full))) if k not in breaks}


def test_marks_bind(spark):
    s = spark.createDataFrame(TEXTS, "record_id long, idx int, text string").where("record_id in (1, 2)")
    placed, docs = projection.places(s), projection.project(s)
    spans = projection.to_cues(spark.createDataFrame([(1, 2, 14, "PERSON"), (2, 0, 1, "PERSON")], "record_id long, start long, end long, entity_type string"), placed)
    marked = projection.mark(spans, placed, docs)
    payloads = placed.join(docs.where("problem is null"), "record_id").select(F.col("document_sha256").alias("doc_sha256"), F.col("cue").alias("cue_index"), F.col("text").alias("payload"))
    found = mentions.bind(marked.withColumnRenamed("cue", "cue_index"), payloads).collect()
    assert sorted((r.record_id, r.cue_index, r.start, r.end, r.problem) for r in found) == [(1, 0, 2, 7, None), (1, 1, 0, 6, None)] and len({r.mention_id for r in found}) == 2
    outside = projection.to_text(spark.createDataFrame([(1, 0, 3, 99), (1, 7, 0, 1), (1, 0, 2, 2)], "record_id long, cue long, start long, end long"), placed)
    assert all(r.text_start is None for r in outside.collect())


def test_bad_webvtt_is_refused_whole(spark):
    good = "WEBVTT - title\n\nNOTE x\n\nid\n00:01.000 --> 00:02.000 align:start\nA: hi\n\n00:02.000 --> 01:00:03.000\nB\n"
    texts = {"good.vtt": good, "bom.VTT": "﻿" + good, "crlf.vtt": good.replace("\n", "\r\n"), "time.vtt": good.replace("00:02.000 --> 01", "00:02,000 --> 01"), "head.vtt": good[1:], "none.vtt": "WEBVTT\n\nNOTE only\n", "empty.vtt": "", "text.vtt": "no cue at all", "as.srt": good}
    files = spark.createDataFrame([(n, f"in/{k}", bytearray(t.encode())) for n, (k, t) in enumerate(texts.items())], "record_id long, path string, content binary")
    none = spark.createDataFrame([], "record_id long, runtime string"), spark.createDataFrame([], "record_id long, sha256 string")
    got = {r.name: (r.outcome, r.cues, r.media_type) for r in ingest.plan(files, *none, "mine").collect()}
    assert {k: v[0] for k, v in got.items()} == {"good.vtt": "new", "bom.VTT": "new", "crlf.vtt": "new", "time.vtt": "parse", "head.vtt": "parse", "none.vtt": "parse", "empty.vtt": "parse", "text.vtt": "parse", "as.srt": "parse"}
    assert got["good.vtt"][1:] == got["crlf.vtt"][1:] == (2, "text/vtt")
