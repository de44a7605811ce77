import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspar.operators import answers, parameters, search, sync
from quillspar.operators.store import Store


def brute_bm25(texts, query):
    docs = [re.findall("[一-鿿]|[a-z0-9_./%+\\-]+", t.lower()) for t in texts]
    df = Counter(w for d in docs for w in set(d))
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if r < 0 else r for w, r in raw.items()}
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in query.lower().split()) for d in docs]


def corpus(spark, texts):
    return spark.createDataFrame([(f"c{k}", k, t) for k, t in enumerate(texts)], "chunk_id string, document_id int, content string")


def test_keyword_numbers(spark):
    texts = ["range 100 m range", "accuracy 2 cm", "the range the", "the model", "the weight of the part", "other"]
    for query in ("range the", "range range model", "nothing"):
        want = brute_bm25(texts, query)
        got = {r.chunk_id: r.score for r in search.keyword(corpus(spark, texts), query).collect()}
        best = max(want)
        assert got.keys() == {f"c{k}" for k, s in enumerate(want) if best > 0 and s > 0}
        assert all(abs(got[f"c{k}"] - s / best) < 1e-4 for k, s in enumerate(want) if f"c{k}" in got)
    assert search.keyword(corpus(spark, texts), " ,, ").collect() == []
    assert search.keyword(corpus(spark, texts[:1]), "range").collect() == []  # one chunk: no weight is over 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, document_id int, embedding array<float>, file_type string")


def test_search_modes_filters_and_visibility(spark):
    v = vectors(spark, [("c0", 0, [1.0, 0.0], "text"), ("c1", 1, [0.8, 0.6], "pdf"), ("c2", 2, [0.0, 1.0], "text"), ("c3", 3, [0.0, 0.0], "text"), ("c4", 4, [-1.0, 0.0], "text")])
    q = spark.createDataFrame([([1.0, 0.0],)], "query_vector array<float>")
    texts = corpus(spark, ["alpha beta", "gamma", "beta beta delta", "x", "y"]).withColumn("file_type", F.when(F.col("chunk_id") == "c1", "pdf").otherwise("text"))
    run = lambda *a, **k: [(r.chunk_id, round(r.score, 4)) for r in search.search(v, q, texts, *a, **k).orderBy("rank").collect()]
    assert run("beta", "SEMANTIC") == [("c0", 1.0), ("c1", 0.9), ("c2", 0.5), ("c3", 0.5), ("c4", 0.0)]
    assert run("beta", "semantic", 2, {"file_type": "text", "other": 5, "manufacturer": ""}) == [("c0", 1.0), ("c2", 0.5)]
    assert run("  ") == [] and len(run("beta", "keyword", 0)) == 2
    fused = dict(run("beta", "anything", 8))
    sem, kw = {"c0": 1.0, "c1": 0.9, "c2": 0.5, "c3": 0.5, "c4": 0.0}, {r.chunk_id: r.score for r in search.keyword(texts, "beta", 24).collect()}
    assert all(abs(fused[c] - (0.65 * s + 0.35 * kw.get(c, 0))) < 1e-3 for c, s in sem.items())
    docs = spark.createDataFrame([(0, "indexing"), (1, "imported"), (2, "imported")], "document_id int, status string")
    assert [r.chunk_id for r in search.semantic(search.visible(v, docs), q, 2).orderBy("rank").collect()] == ["c1", "c2"]
    assert search.semantic(v.limit(0), q).collect() == []


def test_parameters_need_evidence(spark):
    rows = spark.createDataFrame([("d", 0, "型号: LDR-100\n测距范围: 100 m\n这里没有数值", 1), ("d", 1, "测距范围: 100 M\n| Weight | 5 kg |", 1)], "document_id string, chunk_index int, content string, page_number int")
    found = parameters.dedupe(parameters.extract(rows))
    assert sorted((r.normalized_name, r.value, r.unit) for r in found.collect()) == [("model", "LDR-100", None), ("range", "100", "m")]
    docs = spark.createDataFrame([("d", "f.txt", None, ""), ("e", "g.txt", "B200", "Y")], "document_id string, filename string, sensor_model string, manufacturer string")
    cells = parameters.compare(parameters.with_model(found, docs), ["LDR-100", " B200 "])
    got = {(r.normalized_name, r.model): (r.value, r.source) for r in cells.collect()}
    assert got["range", "LDR-100"] == ("100 m", "f.txt p.1 / 测距范围: 100 m") and got["range", "B200"] == (parameters.MISSING, parameters.NO_SOURCE)
    assert {r.document_id: r.sensor_model for r in parameters.backfill(docs, found).collect()} == {"d": "LDR-100", "e": "B200"}
    with pytest.raises(ValueError):
        parameters.compare(found.withColumn("sensor_model", F.lit("x")), ["one"])
    reply = spark.createDataFrame([("测距范围", "100", 1, "accuracy")], "name string, value string, page_number int, normalized_name string")
    assert [(r.normalized_name, r.confidence) for r in parameters.confirm(found, reply).collect()] == [("accuracy", 0.85)]
    assert parameters.confirm(found, reply.limit(0)).count() == 2


def test_plan_and_moves(spark):
    p = sync.index_profile("text")
    docs = spark.createDataFrame([(1, "/r/a", "h1", "imported", p, 1), (2, "/r/b", "h2", "imported", p, 2), (3, "/r/c", "h3", "indexing", p, 3), (4, "/r/gone", "h4", "imported", p, 4), (5, "/r/gone2", "h4", "imported", p, 5), (6, "/other/z", "h9", "imported", p, 6), (7, "/r/bad", "h7", "imported", p, 7)], "document_id int, file_path string, file_hash string, status string, index_profile string, imported_at int")
    scan = spark.createDataFrame([("/r/a", "h1"), ("/r/b", "h2x"), ("/r/c", "h3"), ("/r/new", "h4"), ("/r/copy", "h1"), ("/r/fresh", "h8"), ("/r/bad", None)], "file_path string, file_hash string")
    chunks = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "document_id int")
    got = {r.file_path: (r.action, r.result) for r in sync.import_plan(scan, docs, chunks, p).collect()}
    assert got == {"/r/a": ("skip", "skipped"), "/r/b": ("update", "updated"), "/r/c": ("resume", "updated"), "/r/new": ("reuse", "skipped"), "/r/copy": ("reuse", "skipped"), "/r/fresh": ("import", "imported"), "/r/bad": ("fail", "failed")}
    moves = {r.document_id: (r.action, r.new_path) for r in sync.reconcile(scan, docs, "/r").collect()}
    assert moves == {4: ("move", "/r/new"), 5: ("delete", None)}


def test_answers(spark):
    rows = spark.createDataFrame([(2, "b.txt #0", None, "c2", "two", 5, 0.5), (1, "a.txt p.3 #1", 3, "c1", "x" * 2000, 4, 0.9)], "rank int, source string, page_number int, chunk_id string, content string, document_id int, score double")
    text = answers.context(rows).first().context
    assert text == f"[S1] a.txt p.3 #1 p.3\nchunk_id=c1\n{'x' * 1800}\n\n[S2] b.txt #0\nchunk_id=c2\ntwo"
    assert answers.answer("q?", rows, answers.NoModel()).startswith(answers.WITHOUT_MODEL[0] + "crs") and "q?" in answers.answer("q?", rows, answers.NoModel())
    assert answers.answer("q?", rows.limit(0), answers.NoModel()) == answers.NO_EVIDENCE

    class Broken:
        def chat(self, messages):
            yield "part"
            raise ValueError("lost")

    assert answers.answer("q", rows, Broken()) == f"part\n\n大模型问答失败：lost\n\n{answers.CHECK_SOURCES}"
    assert '"chunk_id":"c1"' in answers.history_row("q", "a", rows).first().sources_json


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, v string")
    assert not store.exists("documents")
    store.publish(documents=one, chunks=one)
    store.publish(documents=sync.upsert(store.read("documents"), spark.createDataFrame([(2, "c", 7)], "document_id int, v string, extra int"), "document_id"))
    assert sorted((r.document_id, r.v) for r in store.read("documents").collect()) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception):
        store.publish(documents=one.select(F.raise_error(F.lit("broken")).alias("v")))
    assert store.read("documents").count() == 2
    store.delete(one.where("document_id = 1"), "document_id", "documents", "chunks")
    assert [store.read(t).count() for t in ("documents", "chunks")] == [1, 1]
    meta = sync.update_metadata(one, spark.createDataFrame([(1, None), (2, "z")], "document_id int, v string"), "document_id")
    assert sorted(r.v for r in meta.collect()) == ["a", "z"]


def test_records(spark):
    """Pages as numbers, whole sliders, starts that a stop forbids, and stale vectors."""
    from quillspar.operators import metadata, progress

    rows = spark.createDataFrame([(" 3 ",), ("x",), ("",), (None,), ("4.5",)], "p string")
    assert [r[0] for r in rows.select(metadata.page_number(F.col("p"))).collect()] == [3, None, None, None, None]
    assert [r[0] for r in spark.range(1, 30, 14).select(progress.shown_k(F.col("id"))).collect()] == [3, 15, 20]
    jobs = spark.createDataFrame([("a", "queued"), ("b", "stopping"), ("c", "running")], "job_id string, status string")
    assert [r.status for r in progress.started(jobs, "b").collect()] == ["queued", "stopping", "running"]
    assert [r.status for r in progress.started(jobs, "a").collect()] == ["running", "stopping", "running"]
    assert [r.status for r in progress.stop_requested(jobs, "c").collect()] == ["queued", "stopping", "stopping"]
    assert progress.import_active(jobs).first().active is True and progress.import_active(jobs.limit(0)).first().active is False


def test_import_plan_takes_one_document_of_a_path(spark):
    documents = spark.createDataFrame([(2, "/a", "h", "imported", sync.index_profile("text")), (1, "/a", "h", "imported", sync.index_profile("text"))], "document_id long, file_path string, file_hash string, status string, index_profile string").withColumn("imported_at", F.lit(1))
    scan = spark.createDataFrame([("/a", "h")], "file_path string, file_hash string")
    chunks = spark.createDataFrame([(1, "1#0")], "document_id long, chunk_id string")
    got = sync.import_plan(scan, documents, chunks, sync.index_profile("text")).collect()
    assert [(r.action, r.document_id) for r in got] == [("skip", 1)]
