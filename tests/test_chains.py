"""Chains, as-of inputs, protected acts, streaming replay and transactions on small hand-made journals."""

import hashlib
import hmac
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from annalist.operators import chain, journal, protected, timeline, views
from annalist.sources import commits
from annalist.streaming import replay

EVENTS = "journal long, order long, at string, kind string, record_id long, payload struct<a:string,n:long>, operation_intent_sha256 string"
KEY = b"k"


def events(spark, n, journals=1):
    return spark.createDataFrame([(k % journals, k, f"t{k}", "kind", None if k % 5 == 0 else k % 3, (f'x"é{k}', None if k % 4 == 0 else k), "i" if k % 2 else None) for k in range(n)], EVENTS)


def plain(rows, key):
    """The chain of rows in order, by plain loops over canonical JSON."""
    out, prev = [], chain.GENESIS
    for n, r in enumerate(rows, 1):
        body = {"at": r["at"], "kind": r["kind"], "payload": r["payload"].asDict(), "prev": prev, "record_id": r["record_id"], "seq": n}
        if r["operation_intent_sha256"] is not None:
            body["operation_intent_sha256"] = r["operation_intent_sha256"]
        blob = json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()
        told = hmac.new(key, blob, "sha256").hexdigest() if key else hashlib.sha256(blob).hexdigest()
        out.append((n, prev, told))
        prev = told
    return out


@pytest.mark.parametrize("key", [None, KEY])
def test_chain_is_canonical(spark, key):
    e = events(spark, 40, 3)
    rows = sorted(e.collect(), key=lambda r: r["order"])
    got = chain.seal(e.repartition(5), key).collect()
    for j in range(3):
        assert sorted((r.seq, r.prev, r.digest) for r in got if r.journal == j) == plain([r for r in rows if r["journal"] == j], key)
    whole = chain.seal(e.where("order < 20"), key).where("journal = 0").orderBy("seq").collect()
    rest = chain.seal(e.where("order >= 21 and journal = 0"), key, whole[-1].seq, whole[-1].digest).collect()
    assert sorted((r.seq, r.prev, r.digest) for r in [*whole, *rest]) == plain([r for r in rows if r["journal"] == 0], key)


@pytest.mark.parametrize(("journals", "part"), [(1, 10), (3, 7), (40, 9), (1, 1000)])
def test_no_task_sorts_a_long_chain(spark, monkeypatch, journals, part):
    monkeypatch.setattr(chain, "PART", part)
    e = events(spark, 120, journals)
    rows = sorted(e.collect(), key=lambda r: r["order"])
    sealed = chain.seal(e.repartition(5), KEY, 3, "f" * 64)
    got = sealed.collect()
    for j in range(journals):
        mine = sorted((r.seq, r.at, r.prev) for r in got if r.journal == j)
        assert [(n, a) for n, a, _ in mine] == [(n + 4, r["at"]) for n, r in enumerate(r for r in rows if r["journal"] == j)] and mine[0][2] == "f" * 64
    again = {(r.journal, r.seq): r.digest for r in chain.linked(e.withColumns({"front": chain.front(*map(F.col, ("at", "kind", "operation_intent_sha256", "payload"))), "back": chain.back(F.col("record_id"))}), "journal", "order", KEY, 3, "f" * 64).collect()}
    assert {(r.journal, r.seq): r.digest for r in got} == again
    most = sealed.groupBy(F.input_file_name().alias("file"), "journal").count().agg(F.max("count")).first()[0]
    assert most <= 2 * part


@pytest.mark.parametrize("block", [1 << 16, 4])
def test_breaks_are_named(spark, monkeypatch, block):
    monkeypatch.setattr(chain, "BLOCK", block)
    sealed = chain.seal(events(spark, 30), KEY)
    assert {r.problem for r in chain.verify(sealed, KEY).collect()} == {None}
    assert chain.verified_scan(sealed, KEY).count() == 30
    told = lambda j: {r.seq: r.problem for r in chain.verify(j, KEY).collect() if r.problem}
    assert told(sealed.where("seq <> 8")) == {9: "gap"}
    assert told(sealed.where("seq not between 8 and 17")) == {18: "gap"}  # whole blocks are gone
    assert told(sealed.where("seq > 1")) == {2: "gap"}
    assert told(sealed.withColumn("at", F.expr("if(seq = 12, 'later', at)"))) == {12: "altered"}
    assert told(sealed.withColumn("digest", F.expr("if(seq = 12, repeat('1', 64), digest)"))) == {12: "altered", 13: "link"}
    assert told(sealed.withColumn("operation_intent_sha256", F.expr("if(seq = 3, 'other', operation_intent_sha256)"))) == {3: "altered"}
    assert told(sealed.unionByName(sealed.where("seq = 8"))) == {8: "gap"}
    assert set(told(chain.seal(events(spark, 30), b"other")).values()) == {"altered"}
    with pytest.raises(chain.JournalBroken, match="journal 0, seq 9: gap"):
        chain.verified_scan(sealed.where("seq <> 8"), KEY)
    assert [tuple(r) for r in chain.breaks(chain.verify(sealed.where("seq <> 8"), KEY)).collect()] == [(0, 29, 9, "gap", 8)]


def test_no_single_partition_over_rows(spark):
    plan = chain.verify(spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("1 AS journal", "event_id AS seq", "'' AS at", "'' AS kind", "user_id AS record_id", "1L AS payload", "'' AS operation_intent_sha256", "'' AS prev", "'' AS digest"))
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()


def test_sealing_is_linear(spark):
    """One record of 300,000 events; the last round's fold took 35 s for 20,000."""
    e = spark.range(300_000).selectExpr("1 AS record_id", "id AS seq", "'kind' AS kind", "id AS payload")
    began = time.time()
    head = journal.head(journal.seal(e)).first()
    assert head.seq == 300_000 and time.time() - began < 60


@pytest.mark.parametrize(("limit", "block"), [(100, 7), (0, 7), (0, 1 << 16)])
def test_inputs_hold_from_the_next_event_on(spark, monkeypatch, limit, block):
    monkeypatch.setattr(timeline, "LIMIT", limit)
    monkeypatch.setattr(timeline, "BLOCK", block)
    inputs = [("p", 3, "a"), ("q", 5, "x"), ("p", 9, "b"), ("p", 9, "c"), ("other", 1, "z"), ("q", 30, None)]
    e = spark.createDataFrame([(k, f"v{k}") for k in [*range(0, 42, 3), 30]], "seq long, note string")
    got = sorted((r.seq, r.note, r.p and tuple(r.p), r.q and tuple(r.q)) for r in timeline.inputs_as_of(e, spark.createDataFrame(inputs, "role string, seq long, sha256 string"), ["p", "q"]).collect())

    def before(role, s):
        found = [(x[1], x[2] or "", x[2]) for x in inputs if x[0] == role and x[1] < s]
        return (max(found)[2], max(found)[0]) if found else None

    assert got == sorted((k, f"v{k}", before("p", k), before("q", k)) for k in [*range(0, 42, 3), 30])
    assert timeline.inputs_as_of(e, spark.createDataFrame([], "role string, seq long, sha256 string"), ["p"]).where("p is not null").count() == 0


ACTS = "record_id long, seq long, kind string, artifact string, sha256 string, plan string, phase string, basis array<struct<role:string,sha256:string,seq:long>>, actor string, actor_seq long, checkpoint string, session string, revision int, previous string"
NONE = dict.fromkeys(x.split()[0] for x in ["artifact", "sha256", "plan", "phase", "basis", "actor", "actor_seq", "checkpoint", "session", "revision", "previous"])


def act(record, seq, kind, **more):
    return {"record_id": record, "seq": seq, "kind": kind, **NONE, **more}


def prepared(record, seq, plan, basis, phase="review", artifact="r0", **more):
    return act(record, seq, protected.PREPARED, plan=plan, phase=phase, artifact=artifact, sha256=f"s{seq}", basis=[*basis, ("policy", "p1", 0)], actor=more.pop("actor", "ann"), actor_seq=1, **more)


def expanded(spark, rows, inputs=(("policy", 0, "p1"),), actors=(("ann", 1, True), ("bob", 1, False))):
    e = spark.createDataFrame([tuple(r[x.split(" ")[0]] for x in ["record_id", "seq", "kind", *NONE]) for r in rows], ACTS)
    found = protected.expand(e, spark.createDataFrame(list(inputs), "role string, seq long, sha256 string"), spark.createDataFrame(list(actors), "actor string, seq long, active boolean"), ["r0", "r1"])
    return sorted((r.record_id, r.seq, r.part, r.kind, r.artifact, r.sha256, r.finding) for r in found.collect())


def test_acts_make_what_they_were_prepared_for(spark):
    done = lambda seq, plan, record=1: act(record, seq, protected.COMPLETED, plan=plan)
    rows = [act(1, 10, protected.PRODUCED, artifact="source", sha256="b"), prepared(1, 11, "A", [("source", "b", 10)]), done(12, "A"), done(13, "A"),
            prepared(1, 14, "B", [("r0", "s11", 12)], "pseudonymise", "r1"), done(15, "B"), prepared(1, 16, "C", [("r0", "s11", 11)]), done(17, "C"), done(18, "missing"), done(19, "A", 2), done(20, "later"), prepared(1, 21, "later", []),
            prepared(1, 22, "D", [], actor="bob"), done(23, "D"), act(1, 24, protected.PRODUCED, artifact="r0", sha256="forged"), prepared(1, 25, "E", [("r0", "s11", 12)]), done(26, "E")]
    got = expanded(spark, rows)
    assert [x[1:3] + x[4:6] for x in got if x[2]] == [(12, 1, "r0", "s11"), (12, 2, "r0", "s11"), (12, 3, "r0", "s11"), (15, 1, "r1", "s14"), (15, 2, "r1", "s14"), (26, 1, "r0", "s25"), (26, 2, "r0", "s25"), (26, 3, "r0", "s25")]
    assert {x[1]: x[6] for x in got if x[6]} == {13: "twice", 17: "basis", 18: "unknown", 19: "unknown", 20: "unknown", 23: "actor", 24: "unprotected"}


def test_policies_checkpoints_and_actors_move(spark):
    done = lambda seq, plan: act(1, seq, protected.COMPLETED, plan=plan)
    point = lambda seq, digest, revision, previous, session="s", actor="ann": act(1, seq, protected.CHECKPOINT, phase="review", checkpoint=digest, session=session, revision=revision, previous=previous, actor=actor)
    rows = [point(10, "c1", 1, None), point(11, "c2", 2, "c1"), point(12, "bad", 4, "c2"), point(13, "bad", 3, "c2", actor="bob"), point(14, "bad", 2, None, "t"), prepared(1, 15, "A", [], checkpoint="c2"), done(16, "A"), prepared(1, 17, "B", [], checkpoint="c1"), done(18, "B"),
            prepared(1, 19, "C", []), done(40, "C"), prepared(1, 21, "D", []), done(22, "D")]
    got = expanded(spark, rows, [("policy", 0, "p1"), ("policy", 30, "p1")])
    assert {x[1]: x[6] for x in got if x[6]} == {12: "order", 13: "order", 14: "order", 18: "checkpoint", 40: "basis"}
    assert {x[1]: x[6] for x in expanded(spark, rows, actors=[("ann", 1, True), ("ann", 20, False)]) if x[6]} == {12: "order", 13: "order", 14: "order", 18: "checkpoint", 40: "actor", 22: "actor"}
    assert [x for x in expanded(spark, rows, []) if x[2]] == []  # without a policy nothing holds
    assert expanded(spark, []) == []


SHA = {n: hashlib.sha256(n.encode()).hexdigest() for n in "abc"}
NARROW = "record_id long, number long, seq long, kind string, artifact string, sha256 string, verdict string, undo_of long, human boolean, outcome string"


def history():
    """Two records: versions, decisions, a withdrawal with vain and valid undoing, broken events, anchors before and after bytes."""
    p, r, d, a = views.PRODUCED, views.RECEIPT, views.DECISION, views.ANCHOR
    one = [(a, "x", None, None, None, None, "exact"), (p, "x", "a"), (d, "x", "a", "ACCEPT"), (p, "x", "b"), (p, "x", "a"), (r, "x", "a"), (a, "x", None, None, None, None, "missing"), (a, "x", None, None, None, None, "odd"), (d, "x", "a", "WITHDRAW"),
           (d, "x", "a", "ACCEPT"), (d, "x", "a", "UNDO", 9, False), (d, "x", "a", "UNDO", 8, True), (d, "x", "a", "UNDO", 9, True), (d, "x", "b", "REJECT"), ("seen", None), (p, "y", "bad"), (d, "y", "c", "MAYBE")]
    two = [(p, "x", "c"), (d, "x", "c", "ACCEPT"), (d, "x", "c", "MAYBE"), (r, "x", "bad"), (p, "z", "a")]
    out = []
    for record, rows in ((1, one), (2, two)):
        for n, row in enumerate(rows, 1):
            kind, artifact, sha, verdict, undo, human, outcome = (*row, *[None] * (7 - len(row)))
            out.append((record, n, n, kind, artifact, SHA.get(sha, sha), verdict, undo, human, outcome))
    return out


WANT = [(1, "x", SHA["a"], 2, SHA["a"], SHA["b"], "REJECT", None, "missing", 14, 4, 17), (1, "y", None, 0, None, None, None, None, None, None, 4, 17),
        (2, "x", SHA["c"], 1, None, None, None, None, None, 2, 2, 5), (2, "z", SHA["a"], 1, None, None, None, None, None, 5, 2, 5)]


def test_views_in_windows(spark):
    assert sorted(map(tuple, views.views(spark.createDataFrame(history(), NARROW)).collect())) == WANT


@pytest.mark.parametrize("cuts", [[17], [1, 2, 9, 17], [8, 17]])
def test_stream_equals_views_over_restarts(spark, tmp_path, cuts):
    """Each slice is its own run from the checkpoint; the last comes twice, as a file that a writer sends again."""
    e = spark.createDataFrame(history(), NARROW)
    folder, before = str(tmp_path), 0
    for upto in [*cuts, cuts[-1]]:
        e.where(F.col("number").between(before + 1 if upto != before else 1, upto)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        replay.run(spark, f"{folder}/in", e.schema, f"{folder}/out", f"{folder}/checkpoint")
        before = upto
    told = replay.latest(spark.read.schema(views.SCHEMA.format("long")).parquet(f"{folder}/out"))
    assert sorted(map(tuple, told.select(*[x.split()[0] for x in views.SCHEMA.format("long").split(", ")]).collect())) == WANT


def test_a_gap_stops_the_stream(spark, tmp_path):
    e = spark.createDataFrame(history(), NARROW).where("number <> 3")
    e.write.parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="event 4 after 2"):
        replay.run(spark, f"{tmp_path}/in", e.schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint")


class Killed(Exception):
    pass


def test_transactions_count_once(spark, tmp_path):
    j = commits.Journal(spark, str(tmp_path / "j"), KEY)
    e = events(spark, 30)
    assert j.snapshot() is None and j.stable(lambda df: df) is None

    def die():
        raise Killed

    for step in range(3):
        batch = e.where(F.col("order") % 3 == step)
        with pytest.raises(Killed):
            j.append(batch, f"b{step}", before_publish=die)
        assert j.head()["version"] == step  # as if nothing had been written
        assert [j.append(batch, f"b{step}") for _ in range(2)] == [step + 1, step + 1]
    rows = [r for s in range(3) for r in sorted(e.collect(), key=lambda r: r["order"]) if r["order"] % 3 == s]
    want = [r.asDict() | {"operation_intent_sha256": hashlib.sha256(f"b{n // 10}".encode()).hexdigest()} for n, r in enumerate(rows)]
    assert sorted((r.seq, r.prev, r.digest) for r in j.snapshot().collect()) == plain(want, KEY)
    assert j.snapshot(2).count() == 20 and chain.verified_scan(j.snapshot().withColumn("journal", F.lit(0)), KEY).count() == 30
    assert j.append(e.where("false"), "none") == 4 and j.head()["seq"] == 30


def test_what_dead_writers_leave(spark, tmp_path):
    """Killed before the part, in it, and after it: recovery and a second run leave the journal of a writer that lived."""
    e, real = events(spark, 12), chain.seal
    batches = {f"b{n}": e.where(F.col("order") % 4 == n) for n in range(4)}
    lived = commits.Journal(spark, str(tmp_path / "lived"), KEY)
    for name, batch in batches.items():
        lived.append(batch, name)
    want = sorted(map(tuple, lived.snapshot().collect()))
    assert lived.recover(0) == []
    j = commits.Journal(spark, str(tmp_path / "j"), KEY)

    def die(*_, **__):
        raise Killed

    commits.chain.seal = die  # before anything of the part is there
    try:
        with pytest.raises(Killed):
            j.append(batches["b0"], "b0")
    finally:
        commits.chain.seal = real
    assert j.recover() == [] and j.recover(0) == [("b0", "partial")] and j.head()["version"] == 0

    def torn():  # its files are there, but not its end
        part = next((tmp_path / "j" / "parts").iterdir())
        (part / "_SUCCESS").unlink()
        raise Killed

    with pytest.raises(Killed):
        j.append(batches["b0"], "b0", before_publish=torn)
    assert j.recover(0) == [("b0", "partial")] and list((tmp_path / "j" / "parts").iterdir()) == []
    j.append(batches["b0"], "b0")
    with pytest.raises(Killed):
        j.append(batches["b1"], "b1", before_publish=die)
    assert j.recover(0) == [("b1", "finished")] and j.head()["version"] == 2 and j.append(batches["b1"], "b1") == 2
    with pytest.raises(Killed):
        j.append(batches["b2"], "b2", before_publish=die)
    j.append(batches["b2"], "b2")  # run again before anyone recovers
    with pytest.raises(Killed):
        j.append(batches["b3"], "b3", before_publish=die)
    j.append(e.where("false"), "between")
    assert sorted(j.recover(0)) == [("b2", "done"), ("b3", "moved")] and j.recover(0) == []
    j.append(batches["b3"], "b3")
    assert sorted(map(tuple, j.snapshot().collect())) == want and len(list((tmp_path / "j" / "parts").iterdir())) == 5


def test_of_two_writers_one_is_first(spark, tmp_path):
    j, e = commits.Journal(spark, str(tmp_path / "j")), events(spark, 20)
    mine = []

    def other():  # publishes while the first one's part is written
        if not mine:
            mine.append(commits.Journal(spark, str(tmp_path / "j")).append(e.where("order < 5"), "other"))

    assert j.append(e.where("order >= 5"), "first", before_publish=other) == 2 and mine == [1]
    assert chain.verified_scan(j.snapshot().withColumn("journal", F.lit(0))).count() == 20
    with pytest.raises(commits.Moved):
        j.append(e, "never", attempts=2, before_publish=lambda: commits.Journal(spark, str(tmp_path / "j")).append(e, str(time.time())))


def test_readers_never_see_half_a_batch(spark, tmp_path):
    j, e, seen, stop = commits.Journal(spark, str(tmp_path / "j")), events(spark, 60), [], threading.Event()

    def read():
        while not stop.is_set():
            df = j.snapshot()
            seen.append(0 if df is None else df.count())

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(4):
        j.append(e.where(F.col("order") % 4 == n), f"b{n}")
    stop.set()
    reader.join()
    assert set(seen) <= {0, 15, 30, 45, 60} and j.stable(lambda df: df.count()) == 60
    with pytest.raises(commits.Moved):
        j.stable(lambda df: j.append(e, str(time.time())))


def test_a_streams_batches_are_transactions(spark, tmp_path):
    e, j = events(spark, 30), commits.Journal(spark, str(tmp_path / "j"))
    for n in range(2):
        e.where(F.col("order") % 2 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(j.sink("q")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    j.sink("q")(e, 1)  # a batch that is run again
    assert j.head()["version"] == 2 and chain.verified_scan(j.snapshot().withColumn("journal", F.lit(0))).count() == 30


def test_a_record_is_told_from_rows_with_few_state_calls():
    """Rows, no frames a record; bytes that an artifact has now aren't looked up, and only changed artifacts are written."""
    from pyspark.sql import Row

    class State:
        def __init__(self):
            self.kept, self.calls = {}, []

        exists = lambda self: bool(self.kept)
        get = lambda self: self.kept[None]
        iterator = lambda self: iter(list(self.kept.items()))

        def update(self, value):
            self.kept[None] = value

        def containsKey(self, key):
            self.calls.append(("has", key))
            return key in self.kept

        def updateValue(self, key, value):
            self.calls.append(("put", key))
            self.kept[key] = value

    p = replay.Replay()
    p.head, p.facts, p.history = State(), State(), State()
    names = [x.split()[0] for x in NARROW.split(", ")]
    rows = [Row(**dict(zip(names, r, strict=True))) for r in history() if r[0] == 1]
    told = [*p.handleInputRows((1,), iter(rows[:4]), None), *p.handleInputRows((1,), iter(rows[4:]), None)]
    assert sorted(tuple(r) for r in told if r.upto == 17) == [w for w in WANT if w[0] == 1]
    p.facts.calls, p.history.calls = [], []
    again = Row(**dict(zip(names, (1, 18, 18, views.PRODUCED, "x", SHA["a"], None, None, None, None), strict=True)))
    assert len(list(p.handleInputRows((1,), iter([again]), None))) == 2
    assert p.facts.calls == [("put", ("x",))] and p.history.calls == []
