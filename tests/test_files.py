"""Structure of subtitle files, drafts, ledgers as files, and normalised texts with few blank lines."""

import hashlib
import json

from pyspark.sql import functions as F

from annalist.functions.text import normalized
from annalist.operators import profile
from annalist.sources import ledgers, srt

BLOCK = "{n}\n00:00:0{n},000 --> 00:00:0{n},900\n{text}\n"


def files(spark, texts):
    return spark.createDataFrame([(k, bytearray(t if isinstance(t, bytes) else t.encode())) for k, t in enumerate(texts)], "record_id long, content binary")


def test_structure_tells_no_words(spark):
    good = "\n".join(BLOCK.format(n=n, text=t) for n, t in [(1, "SPEAKER_1: hello there"), (2, "SPEAKER_2: a\nb"), (3, "no label")])
    named = good.replace("SPEAKER_2", "MRS SMITH")
    texts = [good, named, good.replace(" --> ", " > ", 1), b"\xc3\x28" + good.encode(), "", good + "\n" + BLOCK.format(n=4, text="NAME:"), "﻿" + good]
    got = {r.record_id: r for r in profile.structure(files(spark, texts), 2).collect()}
    assert {k: r.error for k, r in got.items()} == {0: None, 1: None, 2: "cues", 3: "cues", 4: "cues", 5: "metadata", 6: None}
    r = got[0]
    assert (r.cues, r.first_start, r.last_end, r.labels, r.occurrences, r.counts, r.characters, r.longest) == (3, "00:00:01,000", "00:00:03,900", 2, 2, {"SPEAKER_1": 1, "SPEAKER_2": 1}, 22, 11)
    assert [tuple(b) for b in r.blocks] == [(1, 2, 14), (2, 1, 8)] and r.sha256 == hashlib.sha256(good.encode()).hexdigest()
    assert got[1].counts is None and (got[1].labels, got[1].occurrences) == (2, 2) and got[2].sha256 is None and got[5].blocks is None
    assert profile.structure(files(spark, ["x"]).where("false")).collect() == []


def test_drafts_are_named_by_canonical_json(spark):
    text = BLOCK.format(n=1, text='A: say "é"') + "\n" + BLOCK.format(n=2, text="B: x\\y")
    f = files(spark, [text])
    made = profile.drafts(srt.parse(f.select("record_id", F.col("content").cast("string").alias("srt"))).withColumn("idx", F.col("idx").cast("long")), f)
    segments = [{"domain": "transcript_srt_draft_segment", "v": 1, "index": k, "start_ms": 1000 * (k + 1), "end_ms": 1000 * (k + 1) + 900, "text": t, "speaker": s} for k, (s, t) in enumerate([("A", 'say "é"'), ("B", "x\\y")])]
    canonical = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()
    digest = lambda x: hashlib.sha256(canonical(x)).hexdigest()
    whole = {"domain": "transcript_srt_draft", "v": 1, "srt_bytes_sha256": hashlib.sha256(text.encode()).hexdigest(), "parser_version": profile.PARSER, "profile_id": profile.PROFILE, "projection_version": profile.PROJECTION, "segments": segments}
    r = made.first()
    assert (r.segments_sha256, r.draft_sha256) == ([digest(s) for s in segments], digest(whole))
    rows = [(k, h, "deu") for k, h in enumerate(r.segments_sha256)]
    maps = spark.createDataFrame([(0, rows, "m"), (1, rows, "m")], "record_id long, rows array<struct<index:long,segment_sha256:string,language:string>>, content string")
    told = {x.record_id: x for x in profile.assignments(made, maps, "v" * 64).collect()}
    want = {"domain": "transcript_segment_language_assignment", "v": 1, "target_record_id": 0, "srt_bytes_sha256": whole["srt_bytes_sha256"], "parser_version": profile.PARSER, "draft_segments_sha256": r.draft_sha256, "mapping_bytes_sha256": hashlib.sha256(b"m").hexdigest(),
            "assignments": [{"index": k, "segment_sha256": h, "language": c} for k, h, c in rows], "iso6393_vocabulary_sha256": "v" * 64}
    assert (told[0].assignment_sha256, told[0].problem, told[1].problem) == (digest(want), None, "draft")
    short = profile.assignments(made, maps.withColumn("rows", F.slice("rows", 1, 1)), "v").where("record_id = 0").first()
    assert (short.assignment_sha256, short.problem) == (None, "segments")


def test_ledgers_there_and_back(spark):
    t = spark.createDataFrame([("a", 1, "R-1", "new", "old", "t1", "REF"), ("a", 0, "R-1", "old", "new", "t0", "é\"x"), ("b", 0, "R-2", "old", "new", "t", "REF")], "ledger string, n int, record_id string, from_runtime string, to_runtime string, at string, reference string")
    saved = ledgers.save(t, "old")
    assert sorted(tuple(r)[:7] for r in ledgers.load(saved, "old").collect()) == sorted(map(tuple, t.collect()))
    whole = json.loads(bytes(saved.where("ledger = 'a'").first().content))
    assert whole[ledgers.DERIVED] == {"R-1": "old"} and [x["at"] for x in whole["transfers"]] == ["t0", "t1"]
    ok = {"from": "old", "to": "new", "at": "t"}
    bad = {"none": "", "cut": '{"transfers":[', "list": "[]", "number": {"transfers": 3}, "null": {"transfers": None}, "text": {"transfers": ["x"]}, "lacks": {"transfers": [ok, {"from": "old", "to": "new"}]}, "typed": {"transfers": [ok | {"at": 5}]},
           "other": {"default_runtime": "new", "transfers": [ok]}, "owned": {"owners": {}, "transfers": [ok]}, "free": {"transfers": []}, "bare": {}, "good": {"default_runtime": "old", "transfers": [ok], "version": 1}}
    f = spark.createDataFrame([(k, bytearray((v if isinstance(v, str) else json.dumps(v)).encode())) for k, v in bad.items()], "ledger string, content binary")
    got = {r.ledger: (r.problem, r.n) for r in ledgers.load(f, "old").collect()}
    assert got == {"none": ("json", None), "cut": ("json", None), "list": ("json", None), "number": ("transfers", None), "null": ("transfers", None), "text": ("entry", None), "lacks": ("entry", None), "typed": ("entry", None), "other": ("default", None), "owned": ("owners", None), "good": (None, 0)}


def test_runs_of_blank_lines(spark):
    texts = ["\n\n\n\na\n \n\t\n\n\nb\n\n\nc\n\n\n", "", "\n\n\n\n", "a", "a\r\n\r\r\rb"]

    def plain(text, limit):
        lines, out, blanks = [x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")], [], 0
        for line in lines:
            blanks = blanks + 1 if line == "" else 0
            if not limit or blanks <= limit:
                out.append(line)
        return "\n".join(out).rstrip("\n") + "\n"

    for limit in (0, 1, 2):
        got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalized(F.col("t"), limit).alias("n")).collect()}
        assert got == {t: plain(t, limit) for t in texts}
