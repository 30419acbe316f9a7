import hashlib
import hmac

from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import anchors, graph, journal
from annalist.sources import srt
from annalist.streaming import journal as stream


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_digests_and_offsets(spark):
    d = one(spark, t="a \t\r\nbé\r\n\n", q="aXaXa")
    r = d.select(T.normalized(F.col("t")).alias("n"), T.hmac_sha256(b"k" * 80, F.col("t")).alias("h"), T.occurrences(F.col("q"), F.lit("aXa")).alias("o"),
                 T.codepoint_offset(F.lit("bé!"), F.lit(3)).alias("c"), T.codepoint_offset(F.lit("bé!"), F.lit(2)).alias("x")).first()
    assert r.n == "a\nbé\n"
    assert r.h == hmac.new(b"k" * 80, "a \t\r\nbé\r\n\n".encode(), hashlib.sha256).hexdigest()
    assert (r.o, r.c, r.x) == ([0, 2], 2, None)


def test_canonical_revision(spark):
    seg = F.array(F.struct(F.lit(1500).alias("end_ms"), F.lit(0).alias("index"), F.lit("deu").alias("language"), F.lit("S1").alias("speaker"), F.lit(0).alias("start_ms"), F.lit("Guten Tag.").alias("text")))
    canon = F.to_json(F.struct(F.lit("transcript_revision").alias("domain"), F.lit("Guten Tag.").alias("fulltext"), F.lit("profile").alias("profile_id"), F.lit("seg-join-lf.v1").alias("projection_version"), seg.alias("segments"), F.lit(1).alias("v")))
    want = '{"domain":"transcript_revision","fulltext":"Guten Tag.","profile_id":"profile","projection_version":"seg-join-lf.v1","segments":[{"end_ms":1500,"index":0,"language":"deu","speaker":"S1","start_ms":0,"text":"Guten Tag."}],"v":1}'
    assert spark.range(1).select(F.sha2(canon, 256)).first()[0] == hashlib.sha256(want.encode()).hexdigest()


def test_srt_problems(spark):
    text = "﻿1\r\n00:00:01,5 --> 00:00:02,000\r\nINTERVIEWER: Guten\r\n Tag\r\n\r\n2\r\n00:00:01,000 --> 00:00:03,000\r\nx\r\n\r\n00:99:00,000 --> 00:00:03,000\ny\n\n00:00:04,000 --> 00:00:05,000\nNARRATOR:\n\n00:00:09,000 --> 00:00:08,000\nz"
    got = srt.parse(one(spark, record_id=1, srt=text)).orderBy("idx").collect()
    assert [(r.start_ms, r.speaker, r.text, r.problem) for r in got] == [
        (1500, "INTERVIEWER", "Guten Tag", None), (1000, None, "x", "overlap"), (None, None, "y", "time"), (4000, "NARRATOR", "", "empty"), (9000, None, "z", "order")]


def test_reanchor(spark):
    cases = [("abcdef", 1, 3, "abcdef", "exact", 1), ("abcdef", 1, 3, "zzabcdef", "unique_move", 3), ("abcdef", 1, 3, "bczbc", "ambiguous", None), ("abcdef", 1, 3, "xyz", "missing", None),
             (None, 1, 3, "xyz", "missing", None), ("abcdef", 1, 3, None, "missing", None), ("xaay", 1, 3, "aa b aa", "ambiguous", None), ("a.\\E*b", 1, 5, "zz.\\E*", "unique_move", 2), ("pbcq", 1, 3, "bcz pbcq", "ambiguous", None)]
    d = spark.createDataFrame([c[:4] for c in cases], "o string, s int, e int, n string")
    got = [tuple(r) for r in d.select(anchors.reanchored(F.col("o"), F.col("s"), F.col("e"), F.col("n")).alias("r")).select("r.outcome", "r.new_start").collect()]
    assert got == [c[4:] for c in cases]


def test_occurrences_overlap_and_are_literal(spark):
    cases = [("aaaa", "aa", [0, 1, 2]), ("é😀aé😀", "é😀", [0, 3]), ("a.b", "a.", [0]), ("axb", "a.", []), ("", "a", []), ("ab", "", []), ("x\\Ey", "\\E", [1])]
    d = spark.createDataFrame([c[:2] for c in cases], "t string, q string")
    assert [r[0] for r in d.select(T.occurrences(F.col("t"), F.col("q"))).collect()] == [c[2] for c in cases]


def test_sealed_journal_tells_tampering(spark):
    e = spark.createDataFrame([(k, "a", 1 + k % 2, k) for k in range(1, 13)], "seq long, kind string, record_id long, payload long")
    j = journal.seal(e).cache()
    problems = lambda d: sorted((r.record_id, r.seq, r.problem) for r in journal.verify(d).collect() if r.problem)
    assert j.count() == 12 and problems(j) == []
    here = (F.col("record_id") == 1) & (F.col("seq") == 3)
    assert problems(j.withColumn("payload", F.when(here, 99).otherwise(F.col("payload")))) == [(1, 3, "altered")]
    assert problems(j.where(~here)) == [(1, 4, "gap")]
    assert problems(j.withColumn("digest", F.when(here, "x").otherwise(F.col("digest")))) == [(1, 3, "altered"), (1, 4, "link")]
    first = journal.GENESIS
    assert {r.prev for r in j.where("seq = 1").collect()} == {first} and journal.head(j).where("record_id = 2").first().seq == 6


def test_ready_rows_of_the_ladder(spark):
    from annalist.plans.workflow import status_truth_table

    found = [r.status for r in status_truth_table(spark, "").collect()]
    assert len(found) == 6 * 6 * 7 and found.count("READY") == 8
    unknown = spark.createDataFrame([(None, "current", "accepted"), ("bound", "other", "accepted"), ("bound", "current", None)], "b string, d string, c string")
    assert {r[0] for r in unknown.select(journal.ladder(F.col("b"), F.col("d"), F.col("c"), F.lit(True))).collect()} == {"STOP"}


def test_every_egress_path_has_a_gate(spark):
    assert all(r.gated for r in graph.egress_paths(spark).collect())


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(k, "ab"[k % 2], k % 3, k) for k in range(30)], "seq long, kind string, record_id long, payload long")
    e.repartition(5).write.parquet(str(tmp_path / "j"))
    s = stream.events(spark, str(tmp_path / "j"), e.schema)
    q = stream.latest(s, "record_id", "kind").writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, journal.latest(e, "record_id", "kind").collect()))
