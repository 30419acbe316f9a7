"""Queries on small tables with the ids that larger tables have, against DuckDB."""

import duckdb
import pytest

from annalist.plans import catalog


@pytest.fixture
def against_sql(spark, tmp_path):
    def compare(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(str(tmp_path / f"{t}.parquet"))
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        cur = con.execute(catalog.SQL[name])
        names = [d[0] for d in cur.description]
        want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
        got = [tuple(r[c] for c in cols) for r in df.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        return [dict(zip(cols, r, strict=True)) for r in got]

    return compare


def events(spark, users, each=1):
    return spark.range(len(users) * each).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 60) AS ts", f"element_at(array({','.join(map(str, users))}), int(id % {len(users)}) + 1) AS user_id",
        "element_at(array('signup', 'view', 'click', 'purchase', 'error'), int(id % 5) + 1) AS event_type", "double(id % 100) AS value", "'{\"k\": ' || id * 31 % 100 || '}' AS props")


def test_key_gate_of_records_with_four_digits(spark, against_sql):
    users = [f"{u}L" for u in (0, 7, 999, 1000, 1499, 90000)]
    found = against_sql("key_gate", events=events(spark, users, 100))
    assert {r["reason"] for r in found if r["seq"] % 6 > 2} > {None, "SCOPE_ID_CONTEXT_MISMATCH"}


def test_scalar_checks_of_pages_with_five_digits(spark, against_sql):
    pages = spark.createDataFrame([(n, f"https://a.example/{n}.html", "<p>x</p>") for n in (0, 1, 7, 9999, 10000, 10002, 12757, 100003)], "page_id long, url string, html string")
    found = {r["page_id"]: r["record"] for r in against_sql("scalar_checks", pages=pages)}
    assert found[7] == "REC-0007" and found[9999] == "REC-9999" and found[10000] == "REC-1000"


def test_files_of_cues_are_dealt_by_their_turns(spark, monkeypatch):
    from annalist.plans import evidence

    monkeypatch.setattr(evidence, "TURNS", 20, raising=False)
    files = evidence._files(spark, "/root/testdata/sf0.001")
    assert files.selectExpr("spark_partition_id() AS p").distinct().count() > 4  # more than shuffle partitions


@pytest.mark.parametrize("name", ["vtt_cues", "cue_render"])
def test_files_of_cues_are_scanned_once(spark, name):
    """Each further scan in the one stage of these queries was held by the same task beside the others."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["vtt_cues", "cue_render"])
def test_cues_of_a_record_without_id(spark, against_sql, name):
    rows = [(None, 0, "user", "one e"), (None, 1, "assistant", " two\n\n lines e "), (7, 0, "user", "three")]
    assert None in {r["record_id"] for r in against_sql(name, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))}


def test_bundles_are_not_sent_through_the_driver(spark):
    df = catalog.QUERIES["export_bundles"](spark, "/root/testdata/sf0.001")
    assert df.collect() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
