"""Cues, contracts, registers, freshness, stores and mappings on small fixtures and edge cases."""

import pytest
from pyspark.sql import functions as F

from annalist.operators import contracts, freshness, registers
from annalist.sources import cues, mappings, store

SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nGuten Tag --> so\r\n zwei\r\n\r\n00:00:02.000 --> 00:00:03.500 X1:5\r\ndrei"
VTT = "WEBVTT a\nKind: x\n\nSTYLE\n::cue{}\n\nNOTE\nnix\n\nid\n00:01.000 --> 00:02.000 align:start\neins 𝄞\n\n01:00:02.000 --> 01:00:03.000\n00:05.000 --> 00:06.000\n"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "record_id long, format string, source string")


def test_cues_of_both_formats(spark):
    f = files(spark, (1, "srt", SRT), (2, "vtt", VTT))
    got = cues.scan(f).join(f, "record_id").withColumn("p", cues.payload(F.col("source"))).orderBy("record_id", "cue_index").collect()
    assert [(r.record_id, r.cue_index, r.start_ms, r.end_ms, r.p, r.problem) for r in got] == [
        (1, 0, 1000, 2000, "Guten Tag --> so\r\n zwei", None), (1, 1, 2000, 3500, "drei", None),
        (2, 0, 1000, 2000, "eins 𝄞", None), (2, 1, 3602000, 3603000, "00:05.000 --> 00:06.000", None)]
    assert [SRT[r.start : r.end] for r in got[:2]] == [r.p for r in got[:2]] and VTT[got[2].start : got[2].end] == got[2].p


@pytest.mark.parametrize("cut", [3, 500])
def test_texts_of_cues_are_those_at_their_places(spark, monkeypatch, cut):
    monkeypatch.setattr(cues, "CUT", cut)
    more = ["WEBVTT\r\n\r\nid\r\n00:01.000 --> 00:02.000\r\na\r\r\nb\rc\r\n \t\r\n00:02.000 --> 00:03.000\r\nlast\r", "WEBVTT\n00:01.000 --> 00:02.000\nin the head\n\n\n\n00:01.000 --> 00:02.000\n𝄞\r\n\u2028x"]
    f = files(spark, (1, "srt", SRT), (2, "vtt", VTT), *[(n, "vtt", t) for n, t in enumerate(more, 3)], (5, "srt", "\n\r\n" + SRT[1:]), (6, "srt", "none"))
    found = cues.accepted(cues.scan(f, payloads=True))
    got = found.join(f, "record_id").select("record_id", "payload", cues.payload(F.col("source")).alias("p")).collect()
    assert len(got) == 9 and {r.record_id for r in got} == {1, 2, 3, 4, 5} and all(r.payload == r.p for r in got)
    both = cues.render(f, found.withColumn("other", F.concat(F.lit("<"), "payload", F.lit(">"))), {"again": "payload", "changed": "other"}).collect()
    assert len(both) == 6 and all(r.again == r.source for r in both)
    assert {r.record_id: r.changed for r in both}[1] == SRT.replace("Guten Tag --> so\r\n zwei", "<Guten Tag --> so\r\n zwei>").replace("drei", "<drei>")


@pytest.mark.parametrize("fmt, source, problems", [
    ("vtt", "", ["head"]), ("vtt", None, ["head"]), ("vtt", "WEBVTTx\n\n00:01.000 --> 00:02.000\na", ["head"]), ("vtt", "WEBVTT\n", ["none"]), ("srt", "\n\n", ["none"]),
    ("vtt", "\nWEBVTT\n\n00:01.000 --> 00:02.000\na", ["head", "line"]), ("srt", "x\n00:00:01,000 --> 00:00:02,000\na", ["line"]), ("srt", "1\n00:00:03,000 --> 00:00:02,000\na", ["time"]),
    ("srt", "1\n00:00:01,000 --> 00:00:02,000\n\nspoken", ["line", "text"]), ("srt", "1", ["time"]), ("vtt", "WEBVTT\n\nid\nnot a time --> at all\nx", ["line"])])
def test_refused_files(spark, fmt, source, problems):
    found = cues.scan(files(spark, (1, fmt, source)))
    assert sorted(r.problem for r in found.collect() if r.problem) == problems
    assert cues.accepted(found).count() == 0


def test_rendering_and_its_barrier(spark):
    f = files(spark, (1, "srt", SRT), (2, "srt", "none"))
    found = cues.accepted(cues.scan(f)).join(f, "record_id").withColumn("payload", cues.payload(F.col("source")))
    assert {r.record_id: r.source for r in cues.render(f, found).collect()} == {1: SRT, 2: "none"}
    changed = cues.render(f.where("record_id = 1"), found.withColumn("payload", F.lit("x"))).first().source
    assert changed == SRT.replace("Guten Tag --> so\r\n zwei", "x").replace("drei", "x")
    cases = [("a\nb", "c\nd", None), ("a", "a --> b", None), ("a", "a\rb", "lone_cr"), ("a", "﻿", "bom"), ("a\nb", "c", "line_ends"), ("a\nb", "c\r\nd", "line_ends"), ("a\nb", "c\n ", "blank_line"), ("a", "", "blank_line"), ("a", "b\x0bc", "line_breaking"), ("a", None, "null")]
    got = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)], "k int, o string, n string").select("k", cues.barrier(F.col("o"), F.col("n")).alias("b")).orderBy("k").collect()
    assert [r.b for r in got] == [c[2] for c in cases]


def test_event_contracts(spark):
    rows = [("artifact.state", "r", "{}", "forbidden"), ("x.y", "r", "{}", "unknown"), ("input.observed", "r", "[1]", "json"), ("input.observed", "r", None, "json"), ("input.observed", "r", '{"role":1,"role":2}', "json"),
            ("input.observed", "r", '{"text":1}', "plaintext:text"), ("input.observed", "r", '{"role":1}', "missing:sha256"), ("input.observed", "r", '{"role":1,"sha256":2,"b":1,"a":1}', "foreign:a,b"),
            ("input.observed", None, '{"role":1,"sha256":2}', "record"), ("input.observed", "", '{"role":1,"sha256":2}', "record"), ("instance.retired", "r", '{"coder_id":"c","reference":"x"}', "record"),
            ("record.registered", "r", '{"record_id":"q","profile":"p"}', "record"), ("record.registered", "r", '{"record_id":"r","profile":"p"}', None), ("instance.retired", None, '{"coder_id":"c","reference":"x"}', None)]
    e = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(rows)], "seq long, kind string, record_id string, payload string")
    assert [r.problem for r in contracts.payload_problems(e).orderBy("seq").collect()] == [r[3] for r in rows]


def test_metadata(spark):
    whole = '"record_id":"r","interview_date":"2024-02-29","interviewer":"i","accessRights":"closed","title":"t","language":"deu"'
    rows = [('{%s,"consent_status":"withdrawn","keywords":["a"],"timecoded_segments":[{"start":"x"}]}' % whole, []), ('{%s}' % whole, [("consent_status", "missing")]), (None, [(None, "json")]), ("nope", [(None, "json")]),
            ('{%s,"consent_status":"odd","keywords":"a","abstract":true,"zzz":null}' % whole, [("abstract", "type"), ("consent_status", "consent"), ("keywords", "list"), ("zzz", "unknown")])]
    d = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "record_id long, fields string")
    got = contracts.metadata_findings(d, ["broad"]).collect()
    for k, (_, want) in enumerate(rows):
        assert sorted([(r.field, r.finding) for r in got if r.record_id == k], key=str) == sorted(want, key=str)


def test_answers(spark):
    row = lambda *ids, code="A1": '{"results":[' + ",".join('{"segment":%s,"code":"%s"}' % (i, code) for i in ids) + "]}"
    cases = [(row(0, 1), "ok", "ids"), (row(0), "incomplete", "ok"), (row(), "ids", "ids"), (row(0, 0), "ids", "ids"), (row(0, 1, 2), "ids", "ids"), (row(0, 1, code=" "), "entry", "entry"), (row(0, 1, code="B1"), "code", "code"),
             (row("0.5", 1), "entry", "entry"), (row("true", 1), "entry", "entry"), ('{"results":[],"x":1}', "results", "results"), ("[]", "results", "results"), ('{"results":1}', "results", "results"),
             ('{"results":[{"segment":0,"code":"A1","code":"A1"}]}', "json", "json"), ("{", "json", "json"), (None, "json", "json")]
    d = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, a string").withColumn("e", F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    got = d.select("k", contracts.answer_outcome(F.col("a"), F.col("e"), ["A1"]).alias("whole"), contracts.answer_outcome(F.col("a"), F.col("e"), ["A1"], True).alias("part")).orderBy("k").collect()
    assert [(r.whole, r.part) for r in got] == [c[1:] for c in cases]


def test_freshness_goes_down_the_graph(spark):
    steps = [("c", "k", "b", "cc", False), ("a", "k", "", "aa", False), ("b", "k", "aa", "bb", False), ("d", "k", "bb cc", "dd", False)]
    steps[0] = ("c", "k", "bb", "cc", False)
    d = spark.createDataFrame([(1, {"aa": 1, "bb": 2, "cc": 3, "dd": 4}), (2, {"aa": 5, "bb": 2, "cc": 3, "dd": 4}), (3, None)], "record_id long, have map<string,bigint>")
    got = {(r.record_id, r.artifact): r.cause for r in freshness.evaluate(d, steps).collect()}
    assert [got[1, a] for a in ("aa", "bb", "cc", "dd")] == [None] * 4
    assert [got[2, a] for a in ("aa", "bb", "cc", "dd")] == [None, "older bb", "older bb", "older bb"]
    assert got[3, "dd"] == "absent aa"
    with pytest.raises(ValueError):
        freshness.topological([("x", "k", "q", "p", False), ("y", "k", "p", "q", False)])


def test_registers(spark):
    e = spark.createDataFrame([(1, "a", 0, "v"), (2, "a", 0, "w"), (3, "a", 0, "v"), (4, "a", 1, None), (5, "a", 1, None), (6, "a", 0, "v"), (7, "b", 1, None), (8, "b", 0, None), (9, "b", 2, None)], "seq long, coder_id string, what int, view string")
    args = e, F.col("what") == 0, F.col("what") == 1, F.col("view")
    assert [r.outcome for r in registers.instances(*args).orderBy("seq").collect()] == ["registered", "conflict", "repeat", "retired", "retired_before", "conflict", "unknown", "registered"]
    assert [tuple(r) for r in registers.active(*args).collect()] == [("b", None)]
    t = spark.createDataFrame([(1, 1, "old", "x"), (1, 2, "x", "y"), (1, 3, "x", "z"), (1, 4, "z", "w"), (2, 5, "new", "x")], "record_id long, seq long, giver string, taker string")
    assert sorted(map(tuple, registers.ownership(t, "old").collect())) == [(1, "y", 2, 3), (2, "old", None, 5)]
    v = spark.createDataFrame([("n", 1, None, "a"), ("n", 2, 1, "b"), ("n", 3, 1, "c"), ("m", 1, None, "d")], "name string, version long, parent long, ref string")
    assert sorted(map(tuple, registers.heads(v).collect())) == [("m", 1, "d", False), ("n", 3, "c", True)]
    one = lambda *x: spark.createDataFrame([(k,) for k in x], "member long")
    assert sorted(map(tuple, registers.partition_findings(one(1, 2, 3), one(2, 2, 3, 4)).collect())) == [(1, "missing"), (2, "repeated"), (4, "foreign")]
    assert sorted(map(tuple, registers.overlay_findings(one(1, 2), one(2), one(3), one(1, 4)).collect())) == [(3, "lost"), (4, "surplus")]


def test_store(spark, tmp_path):
    d = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    folder = str(tmp_path / "objects")
    assert [store.put(d, F.col("t"), folder), store.put(d, F.col("t"), folder)] == [2, 0]
    kept = spark.read.parquet(folder)
    broken = kept.withColumn("content", F.when(F.col("content") == F.lit("b").cast("binary"), F.lit("c").cast("binary")).otherwise(F.col("content")))
    named = spark.createDataFrame([("x",)], "address string").unionByName(kept.where("content = cast('b' as binary)").select("address"))
    assert sorted(r.finding for r in store.audit(broken, named).collect()) == ["corrupt", "dangling", "unused"]
    j, keys = str(tmp_path / "journal"), ["kind", "record"]
    first = spark.createDataFrame([(1, "k", "r"), (2, "k", "r"), (3, "k", "s")], "order long, kind string, record string")
    assert [store.append_journal(first, j, keys), store.append_journal(first.withColumn("record", F.lit("q")), j, keys), store.append_journal(first, j, keys)] == [2, 1, 0]
    assert sorted((r.seq, r.record) for r in spark.read.parquet(j).collect()) == [(1, "r"), (2, "s"), (3, "q")]
    out = str(tmp_path / "published")
    assert store.publish(first, out).startswith("3:")
    with pytest.raises(Exception):
        store.publish(first, out)
    sealed = d.where("t = 'b'").select(store.seal(F.col("t"), F.lit("0123456789abcdef").cast("binary"), F.lit("ctx").cast("binary")).alias("x"))
    opened = lambda key, ctx: store.unseal(F.col("x"), F.lit(key).cast("binary"), F.lit(ctx).cast("binary"))
    assert [bytes(v) if v else None for v in sealed.select(opened("0123456789abcdef", "ctx"), opened("0123456789abcdef", "other"), opened("0123456789abcdeX", "ctx")).first()] == [b"b", None, None]


def test_codes_mappings_and_toml(spark):
    raw = [b"und\nzxx\ndeu\n", b"und\nzxx", b"und\nund\nzxx\n", b"und\n\nzxx\n", b"deu\n", b"\xff\n", b"und\r\nzxx\n", None, b""]
    s = spark.createDataFrame([(k, bytearray(x) if x is not None else None) for k, x in enumerate(raw)], "release int, content binary")
    got = mappings.iso_codes(s).orderBy("release").collect()
    assert [r.problem for r in got] == [None, "bytes", "repeated", "line", "und", "bytes", "bytes", "bytes", "bytes"] and got[0].codes == ["deu", "und", "zxx"]
    draft = spark.createDataFrame([(1, 0, "aa"), (1, 1, "bb"), (1, 2, "cc"), (2, 0, "dd"), (3, 0, "ee")], "record_id long, idx long, segment_sha256 string")
    template = {r.record_id: r.tsv for r in mappings.mapping_template(draft).collect()}
    head = mappings.MAPPING_HEAD + "\n"
    assert template[1] == head + "0\taa\t\n1\tbb\t\n2\tcc\t\n"
    m = spark.createDataFrame([(1, head + "0\taa\tdeu\n1\tbb\tqqq\n2\tcx\tdeu\n"), (2, "x\n"), (3, head)], "record_id long, tsv string")
    codes = spark.createDataFrame([("deu",)], "language string")
    assert sorted(((r.record_id, r.idx, r.problem) for r in mappings.read_mapping(m, draft, codes).collect()), key=str) == [(1, 0, None), (1, 1, "language"), (1, 2, "segment"), (2, None, "head"), (3, 0, "missing")]
    assert mappings.toml("a = 1", {"a"}) == {"a": 1}
    for bad in ("b = 1", "a = 1\nc = 2", "a = 1\na = 2"):
        with pytest.raises(ValueError):
            mappings.toml(bad, {"a"})
    book = 'v = 1\n[rules]\npriority = []\n' + "".join(f'[[category]]\nid = "{i}"\nlabel = "l"\ndefinition = "d"\ninclude = "i"\nexclude = "e"\nexamples = ["x"]\n' for i in ("A1", "UNGEKLAERT"))
    assert [r.id for r in mappings.codebook(spark, book, {"v"}).collect()] == ["A1", "UNGEKLAERT"]
    with pytest.raises(ValueError):
        mappings.codebook(spark, book.replace("UNGEKLAERT", "A1"), {"v"})
