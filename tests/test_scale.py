"""Work is dealt over tasks, and done once."""

from pyspark.sql import functions as F

from quillspar.operators import parameters, progress, reports, search
from quillspar.plans import evidence, records, retrieval

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def per_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_sheets_of_one_small_file_are_made_by_all_tasks(spark):
    found = per_task(evidence.sheets(spark, SF).select("content"))
    assert len(found) == 4 and max(found) < 2 * min(found)


def test_only_the_wanted_kind_is_looked_for(spark):
    rows = evidence.sheets(spark, SF)
    for kind in (parameters.TABLE, parameters.PAIR):
        some, both = parameters.extract(rows, (kind,)), parameters.extract(rows).where(F.col("kind") == kind)
        assert some.count() == both.count() > 0 and some.exceptAll(both).isEmpty()


def test_comparison_extracts_once(spark):
    assert plan(evidence.compare_missing(spark, SF)).count("posexplode(") == 1


def test_keyword_scores_are_those_of_keyword_by_one_pass(spark, tmp_path):
    texts = ["range 100 m range", "accuracy 2 cm", "the range the", "the model", "range 100 m range", "", None]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0])]  # two rows alike
    spark.createDataFrame(rows, "k int, content string").write.parquet(str(tmp_path / "rows"))
    corpus = spark.read.parquet(str(tmp_path / "rows"))
    for key, query in (("k", "range the"), ("name", "range range model none"), ("k", "nothing"), ("k", " ,, ")):
        named = corpus.withColumn("name", F.concat(F.lit("a b#"), "k"))
        got, want = (f(named, query, 4, key).select(key, "score", "rank") for f in (search.keyword_scores, search.keyword))
        assert got.schema[key].dataType == want.schema[key].dataType and got.orderBy("rank").collect() == want.orderBy("rank").collect()
    found = search.keyword_scores(corpus, "100", 4, "k")
    assert len(found.collect()) == 3
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_results_cut_only_the_documents_found(spark):
    """One pass for the search, in which a filter of documents has no part, and one over the documents of the hits."""
    made = retrieval._results(spark, SF)
    text = plan(made).split("posexplode(")
    assert sum("wanted#" in x for x in text) and made.count() == 8


def test_import_summary_gathers_nothing(spark):
    rows = [(1, "/b", "failed", "second"), (1, "/a", "failed", None), (2, "/a", "failed", "first"), (2, "/a", "imported", None), (3, None, "updated", None)]
    files = spark.createDataFrame(rows, "job_id int, file_path string, status string, error string")
    assert tuple(progress.summary(files).first()) == (5, 1, 1, 0, 3, 3, "first")
    assert "collect_list" not in plan(records.import_report(spark, SF))


def test_only_files_in_progress_are_joined(spark):
    files = spark.createDataFrame([(1, "processing"), (1, "failed"), (2, "processing"), (None, "processing"), (1, None)], "job_id int, status string")
    lost = spark.createDataFrame([(1,), (1,), (None,)], "job_id int")
    out = reports.recover_files(files, lost)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "pending"), (1, "failed"), (2, "processing"), (None, "processing"), (1, None)], key=str)
    assert plan(out).split("Join")[0].startswith("Union")
