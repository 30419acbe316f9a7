"""Files, settings and golden identities that no table of the fixtures reaches."""

import hashlib

import pytest
from pyspark.sql import functions as F

from annalist.operators import acts, mentions, planning, receipts, revision, status
from annalist.sources import config, ingest


def test_files_are_refused_whole(spark, tmp_path):
    good = "﻿1\n00:00:01,000 --> 00:00:02,000\nANNA: Guten\nTag\n"
    files = {"a.srt": good.encode(), "b.srt": (good + "\n2\nbad\nx\n").encode(), "c.srt": b"\xff\xfe", "d.mp3": b"x", "e.vtt": b"WEBVTT\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    f = ingest.files(spark, str(tmp_path)).withColumn("record_id", F.regexp_extract("path", r"(\w)\.\w+$", 1))
    none = spark.createDataFrame([], "record_id string, runtime string"), spark.createDataFrame([], "record_id string, sha256 string")
    p = ingest.plan(f, *none, "annalist").collect()
    assert {r.name: (r.outcome, r.cues) for r in p} == {"a.srt": ("new", 1), "b.srt": ("parse", None), "c.srt": ("utf8", None), "d.mp3": ("suffix", None), "e.vtt": ("parse", None)}
    assert {r.name: r.sha256 for r in p} == {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    seg = ingest.load_srt(f.where("record_id = 'a'")).first()
    assert (seg.speaker, seg.text, seg.problem) == ("ANNA", "Guten Tag", None)
    assert {r.record_id: r.problem for r in ingest.draft(ingest.load_srt(f.where("record_id in ('a', 'b')"))).collect()} == {"a": None, "b": "parse"}
    t = spark.createDataFrame([(1, b"e\xcc\x81"), (2, b" \n"), (3, b"a\rb"), (4, b"\xff"), (5, "é".encode())], "record_id long, content binary")
    assert {r.record_id: r.problem for r in ingest.fulltext(t).collect()} == {1: "nfc", 2: "empty", 3: "return", 4: "utf8", 5: None}


def test_speaker_stands_on_the_first_line(spark):
    from annalist.sources import srt

    d = spark.createDataFrame([(1, "00:00:01,0 --> 00:00:02,0\nHALLO\nWELT: Guten Tag\n\t\n00:00:03,0 --> 00:00:04,0\nWELT: x")], "record_id long, srt string")
    assert [(r.speaker, r.text) for r in srt.parse(d).orderBy("idx").collect()] == [(None, "HALLO WELT: Guten Tag"), ("WELT", "x")]


def test_golden_revision(spark):
    s = spark.createDataFrame([(1, 0, 0, 1500, "S1", "deu", "Guten Tag.")], "record_id long, idx long, start_ms long, end_ms long, speaker string, language string, text string")
    want = '{"domain":"transcript_revision","fulltext":"Guten Tag.","profile_id":"profile","projection_version":"seg-join-lf.v1","segments":[{"end_ms":1500,"index":0,"language":"deu","speaker":"S1","start_ms":0,"text":"Guten Tag."}],"v":1}'
    assert revision.revisions(s, "profile").first().revision_sha256 == hashlib.sha256(want.encode()).hexdigest()
    bad = s.withColumn("start_ms", F.lit(-1).cast("long"))
    assert revision.revisions(bad, "profile").first().problem == "type"


def test_profiles_are_closed():
    good = 'id = "p"\nrecord_prefix = "R"\nrecord_digits = 3\nproduction = false\npseudonymisation_required = true\npii_detection = "manual"\n[rules.DATE]\naction = "coarsen"\nvalue = "then"\n[rules.PERSON]\naction = "pseudonym"\nscope = "corpus"\n'
    assert config.policy(config.load_profile(good)) == {"DATE": ("coarsen", "then"), "PERSON": ("pseudonym", None)}
    for old, new in (('id = "p"\n', ""), ('"R"', "1"), ("= 3", "= true"), ('"manual"', '"none"'), ('value = "then"\n', ""), ('"corpus"', '"all"'), ("production", "other")):
        with pytest.raises(ValueError):
            config.load_profile(good.replace(old, new))


def test_model_hosts_are_loopback():
    good = 'host = "http://127.0.0.1:11434"\nmodel = "m"\nmodel_digest = "d"\ntemperature = 0.0\nseed = 1\nnum_ctx = 8\nnum_predict = 8\ntimeout = 5\n'
    assert config.load_model(good)["model"] == "m"
    for host in ("http://example.org", "https://127.0.0.1", "http://127.0.0.1.example.org", "http://x@localhost", "http://localhost/path"):
        with pytest.raises(ValueError):
            config.load_model(good.replace("http://127.0.0.1:11434", host))


def test_graph_bindings():
    text = '{"v":1,"profile_id":"p","graph_sha256":"g"}'
    assert [config.load_binding(text, *x) for x in (("p", "g"), ("p", "h"), ("q", "g"))] == ["bound", "moved", "foreign"]
    for bad in ('{"v":1,"v":1,"profile_id":"p","graph_sha256":"g"}', '{"v":true,"profile_id":"p","graph_sha256":"g"}', "[]", '{"v":1}', "x", " " * 70_000):
        with pytest.raises(ValueError):
            config.load_binding(bad, "p", "g")


def test_graphs_have_no_way_round_pseudonymisation():
    for profile in ("model", "manual"):
        steps = planning.build(profile)
        block = {s.name for s in planning.BLOCKS[profile]}
        assert all(planning.CONFIRMED not in s.requires or s.name in block for s in steps)
        assert planning.text_role(profile, "l1.suggest")[1] == "pseudonymisation.review"
    assert planning.text_role("none", "l1.suggest") == ("transcript.confirmed", "transcript.confirm", "transcript.revision")
    loop = (planning.Step("a", "x", ("q",), ("p",)), planning.Step("b", "x", ("p",), ("q",)))
    with pytest.raises(ValueError, match="cycle"):
        planning.ordered(loop)


def test_every_action_of_a_policy(spark):
    text = "ab 12 cd x@y.zz ef"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = [(1, 0, 2, "A", "ab", "m0"), (1, 3, 5, "B", "12", "m1"), (1, 6, 8, "C", "cd", "m2"), (1, 9, 15, "D", "x@y.zz", "m3")]
    found = spark.createDataFrame(rows, "doc_id long, start long, end long, entity_type string, surface string, mention_id string")
    report = mentions.entries(found, mentions.allocate(found), {"A": ("keep", None), "B": ("remove", None), "C": ("coarsen", "thing")})
    out = mentions.render(docs, report).first().rendered
    assert out == "ab  thing D-001 ef"
    assert all(out[r.result_start : r.result_end] == r.value for r in report.collect())
    groups = spark.createDataFrame([("g1", "m0"), ("g1", "m1"), ("g2", "m2"), ("g3", "m3")], "group_id string, mention_id string")
    got = mentions.regroup(groups, spark.createDataFrame([("g2", "g3")], "group_id string, into string"), spark.createDataFrame([("m1", "n1")], "mention_id string, group_id string"), spark.createDataFrame([("m0",)], "mention_id string"))
    assert sorted(map(tuple, got.collect())) == [("g3", "m2"), ("g3", "m3"), ("n1", "m1")]


def test_known_entities_keep_their_numbers(spark):
    schema = "entity_type string, surface string"
    old = mentions.allocate(spark.createDataFrame([("T", x) for x in "abc"], schema))
    new = mentions.allocate(spark.createDataFrame([("T", x) for x in "zyxabc"], schema), old)
    number = lambda d: {r.surface: r.number for r in d.collect()}
    assert number(old).items() <= number(new).items() and sorted(number(new).values()) == [1, 2, 3, 4, 5, 6]


def test_roll_ups_without_rows(spark):
    none = spark.createDataFrame([], "record_id long, status string, ordinal long, gate string")
    assert tuple(status.workspace(none).first()) == ("STOP", 0, 1)
    one = spark.createDataFrame([(1,)], "record_id long")
    assert status.conjunction(one, none).first().status == "STOP"
    odd = spark.createDataFrame([(1, "SOMETHING", 1, "g"), (1, "READY", 2, "h")], none.schema)
    assert tuple(status.conjunction(one, odd).first())[:3] == (1, "STOP", "g")


def test_receipts_are_not_granted_afterwards(spark):
    sha = "a" * 64
    r = spark.createDataFrame([(1, 5, f"REF@{sha[:12]}", sha, "2024-01-02T00:00:00Z")], "record_id long, seq long, authorisation string, subject string, started_at string")
    d = lambda seq, verdict, at: (1, seq, "REF", sha, verdict, "t", at)
    schema = "record_id long, seq long, reference string, subject_sha256 string, verdict string, artifact string, at string"
    expected = F.array(F.lit("t"))
    found = lambda *rows: receipts.bound(r, spark.createDataFrame(list(rows), schema), expected).first().binding
    assert found(d(1, "ACCEPT", "2024-01-01T00:00:00Z")) == "bound"
    assert found(d(6, "ACCEPT", "2024-01-01T00:00:00Z")) == "unknown"
    assert found(d(1, "ACCEPT", "2024-01-03T00:00:00Z")) == "early"
    assert found(d(1, "ACCEPT", "2024-01-01T00:00:00Z"), d(2, "REJECT", "2024-01-01T00:00:00Z")) == "verdict"
    assert {x[0] for x in spark.createDataFrame([("stop",), ("length",), (None,)], "f string").select(F.concat(F.coalesce("f", F.lit("")), receipts.truncated(F.col("f")).cast("string"))).collect()} == {"stopfalse", "lengthtrue", "true"}


def test_authority_needs_a_key(spark):
    got = spark.createDataFrame([(True,), (False,), (None,)], "k boolean").select(acts.authority(F.col("k")).alias("a")).collect()
    assert [set(r.a) for r in got] == [{True}, {False}, {False}]
