"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from quillspar.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, found):
    def text(v):
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert name in ("blake_embed", "stream_ingest") and got[1]
        return
    want = duck.execute(catalogue.ORACLE_SQL[name])
    assert got == rows([c[0] for c in want.description], want.fetchall())


def test_stream_equals_batch(spark):
    got, want = (catalogue.QUERIES[q](spark, SF).collect() for q in ("stream_ingest", "chunk_windows"))
    assert sorted(got) == sorted(want)


def test_vector_scan_reads_few_columns(spark):
    plan = catalogue.QUERIES["vec_topk_filtered"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan
