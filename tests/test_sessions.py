"""Edge cases of sessions: nulls, empty tables, ties and repeats."""

from pyspark.sql import functions as F

from annalist.operators import sessions

GROUPS = "group_id long, entity_type long, scope string, state string, members array<long>"


def groups(spark, *rows):
    return spark.createDataFrame([(g, t, "corpus", "RESOLVED", m) for g, t, m in rows], GROUPS)


def test_a_merge_of_nothing_is_few_and_a_good_one_is_named_by_its_members(spark):
    g = groups(spark, (1, 0, [3, 1]), (2, 0, [2]), (3, 1, [9]))
    acts = spark.createDataFrame([("a", [1, 2]), ("b", []), ("c", None), ("d", [1, 3]), ("e", [2, 1])], "act string, group_ids array<long>")
    got = {r.act: r for r in sessions.merge(g, acts).collect()}
    assert got["a"].members == [1, 2, 3] and got["a"].group_id == got["e"].group_id
    assert (got["b"].problem, got["c"].problem, got["d"].problem) == ("few", "few", "kinds")
    assert sessions.merge(g.limit(0), acts).where("problem is null").count() == 0


def test_excluding_all_members_removes_a_group_and_foreign_ones_change_nothing(spark):
    g = groups(spark, (1, 0, [1, 2]), (2, 0, [3]), (3, 0, [4]))
    m = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 77)], "group_id long, member long")
    got = sorted((r.group_id, r.state, r.members) for r in sessions.exclude(g, m).collect())
    assert got == [(1, "OPEN", [1]), (3, "RESOLVED", [4])]
    assert sessions.exclude(g, m.limit(0)).count() == 3


def test_split_covers_all_members_once(spark):
    g = groups(spark, (1, 0, [1, 2]), (2, 0, [3, 4]))
    parts = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 5)], "group_id long, part long, member long")
    assert sorted((r.group_id, r.problem, r.parts) for r in sessions.split(g, parts).collect()) == [(1, None, 2), (2, "cover", 0)]


def test_the_last_valid_state_holds(spark):
    acts = spark.createDataFrame([(1, 1, "DEFERRED"), (1, 2, "DONE"), (1, 3, None)], "group_id long, seq long, state string")
    assert [r.state for r in sessions.set_state(groups(spark, (1, 0, [1])), acts).collect()] == ["DEFERRED"]


def test_payloads_that_are_no_objects_break_their_keys(spark):
    d = spark.createDataFrame([("p4b.policy", None), ("p4b.policy", "[]"), ("p4b.policy", "no json"), ("p4c.prepared", "7"), (None, "{}")], "kind string, payload string").select("kind", F.try_parse_json("payload").alias("v"))
    at = (F.col("kind"), F.col("v"), F.lit("CUS-000001"), {"by-hand": ("CUS", 6)})
    assert [r[0] for r in d.select(sessions.editor_problem(*at)).collect()] == ["keys", "keys", "keys", "kind", "kind"]
    assert [r[0] for r in d.select(sessions.register_problem(*at)).collect()] == ["kind", "kind", "kind", "keys", "kind"]


def test_a_record_belongs_to_its_profile(spark):
    d = spark.createDataFrame([("CUS-000001", None), ("CUS-000001", "by-hand"), ("CUS-000001", "other"), ("CUS-1", None), (None, None), ("CUS-000001\n", None)], "r string, p string")
    assert [r[0] for r in d.select(sessions.manual_context(F.col("r"), F.col("p"), {"by-hand": ("CUS", 6)})).collect()] == [True, True, False, False, False, False]


def test_a_run_stops_at_gates_and_tells_what_waits(spark):
    have = spark.createDataFrame([(1, ["transcript.confirmed"], [], []), (2, [], [], []), (3, ["transcript.confirmed", "l1.suggestions"], ["l1.coverage"], [])], "record_id long, artifacts array<string>, failing array<string>, silent array<string>")
    handlers = {"ingest": ("INPUT", True), "l1.suggest": ("RUN", False), "l1.coverage": ("RUN", True), "l1.review": ("GATE", True)}
    got = {r.record_id: r for r in sessions.run_on(have, "none", handlers).collect()}
    assert (got[1].executed, got[1].deferred, got[1].inputs) == ("", "l1.suggest", "ingest")
    assert got[2].inputs == "ingest" and got[3].failure == "failed: l1.coverage" and got[3].inputs == ""
    told = {r.record_id: r for r in sessions.run_on(have, "none", handlers, confirm=True).collect()}
    assert told[1].executed == "l1.suggest,l1.coverage" and told[1].gates == "l1.review"


def test_no_findings_give_no_report(spark):
    d = spark.createDataFrame([("store", 2, "b"), ("store", 2, "b"), ("odd", None, "x")], "area string, record_id long, text string")
    assert sorted((r.area, r.rank, r.status, r.findings, r.shown) for r in sessions.doctor(d, 1).collect()) == [("odd", 8, "STOP", 1, "x"), ("store", 6, "STOP", 2, "b")]
    assert sessions.doctor(d.limit(0)).count() == 0


def test_no_source_is_null_for_all_records(spark):
    t = spark.createDataFrame([], "role string, seq long, sha256 string")
    assert [tuple(r) for r in sessions.side_inputs(spark.range(1).withColumnRenamed("id", "record_id"), t, ["x"]).collect()] == [(0, None)]
