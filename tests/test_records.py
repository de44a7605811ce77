"""Queries of job records against their SQL, on a table whose part numbers hold 401 and 403."""

import duckdb
import pytest

from quillspar.operators import progress
from quillspar.plans import records

SF = "/root/testdata/sf0.01"
NAMES = ["file_transitions", "file_events", "failed_rows", "import_report", "session_log"]


@pytest.mark.parametrize("name", NAMES)
def test_query_by_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = records.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({records.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_import_report_without_failures(spark, monkeypatch):
    none = spark.createDataFrame([(1, "/a", "imported", None)], "file_id long, file_path string, status string, error string")
    monkeypatch.setattr(records, "_handled", lambda *a: (none, None))
    assert tuple(records.import_report(spark, SF).first()) == (1, 1, 0, 0, 0, 0, None)


def test_session_log_orders_failures_of_one_path(spark):
    files = spark.createDataFrame([(1, "/b", "failed", None, "old"), (1, "/b", "failed", "zeta", "m"), (1, "/b", "failed", "alpha", "m"), (1, "/a", "failed", None, "first")], "job_id long, file_path string, status string, error string, message string")
    jobs = spark.createDataFrame([(1, "/c", "failed", None, None, 0, 0, 0, 0, 4)], "job_id long, source_path string, status string, started_at timestamp, finished_at timestamp, imported int, updated int, skipped int, deleted int, failed int")
    entry = progress.session_log(jobs, files).first().entry
    assert [x.split(": ")[1] for x in entry.splitlines() if "原因" in x] == ["first", "alpha", "zeta", "old"]
