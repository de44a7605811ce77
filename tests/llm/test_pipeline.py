import random
import tempfile

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillspar.llm import common, decontamination, packing, simhash, substring, toxicity
from quillspar.llm.decontamination import op8_decontamination
from quillspar.llm.simhash import keep_one, near_copies
from quillspar.llm.substring import strip_repeats
from quillspar.llm.toxicity import op7_toxicity

SF = "/root/testdata/sf0.001"


def words(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghij", k=7)) for _ in range(n)]


def jaccard(a, b, k=5):
    cut = lambda t: {tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))}
    x, y = cut(a.split()), cut(b.split())
    return len(x & y) / len(x | y)


def test_near_copies_against_brute_force(spark):
    rows = []
    for g in range(30):
        base = words(g, 150)
        for c, changes in enumerate((0, 0, 1, 2, 6, 12)):
            copy = list(base)
            for at in random.Random(g * 10 + c).sample(range(150), changes):
                copy[at] = f"changed{g}x{c}"
            rows.append((g * 10 + c, " ".join(copy)))
    got = dict(near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for g in range(30):
        own = [r for r in rows if r[0] // 10 == g]
        for i, a in own:
            alike = max((jaccard(a, b) for j, b in own if j != i and got[j] == got[i]), default=1.0)
            assert alike >= 0.7
            for j, b in own:
                if jaccard(a, b) >= 0.9:
                    assert got[i] == got[j]
    assert len({got[g * 10] for g in range(30)}) == 30


def test_keep_one_edges(spark):
    rows = [(5, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (9, None), (7, ""), (None, "one two three four five six"), (1, "another text"), (3, "A SHORT one"), (4, "a short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x"))
    got = sorted((r.doc_id for r in keep_one(docs).collect()), key=lambda x: (x is None, x))
    assert got == [1, 2, 3, 7]  # the row of null id is a copy of 2
    assert keep_one(docs.limit(0)).collect() == []
    assert keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("blocks", [1, 5])
def test_strip_repeats_keeps_other_texts(spark, monkeypatch, blocks):
    monkeypatch.setattr(substring, "text_blocks", lambda *a: blocks)
    shared = " ".join(words(1, 60))
    rows = [(1, f"first\n{shared}", 0), (2, f"then {shared} end", 0), (3, "clean\n text", 7), (4, None, None), (None, shared, 1), (5, shared, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("block", F.lit(1)).withColumn("id", F.lit(2))
    out = strip_repeats(docs, "doc_id", "text", 50, "n_chars")
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("then end", 8) and got[3] == ("clean\n text", 7) and got[4] == (None, None) and got[5] == ("", 0) and got[None] == ("", 0)
    assert strip_repeats(docs.limit(0), "doc_id", "text", 50, "n_chars").collect() == []


def test_pipeline_runs_and_each_stage_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out["doc_id"]) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024
    assert out.groupby("doc_id")["length"].sum().eq(out.groupby("doc_id")["doc_tokens"].first()).all()


def test_stages_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(corpus_pipeline.drop_toxic(spark, docs, SF)) == ids(op7_toxicity(spark, SF).where("not toxic"))
    assert ids(corpus_pipeline.drop_leaks(spark, docs, SF)) == ids(op8_decontamination(spark, SF).where("not contaminated"))


def test_filters_with_nulls_and_clashing_columns(spark):
    rows = [(1, None, "x"), (None, "a vile text", "y"), (1, "a vile text", "z"), (2, "", "w"), (3, "fine", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumn("h", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("toxic", F.lit(0))
    labelled = [(f"{' '.join(words(i, 8))} {'vile' if i % 2 else 'fine'}", i % 2 == 1) for i in range(90)]
    train = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled)], "doc_id long, text string")
    chain = toxicity.train(train, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(labelled)], "doc_id long, toxic boolean"), ["toxic"])
    kept = toxicity.drop(docs, chain, "toxic")
    assert kept.columns == docs.columns and sorted(r.id for r in kept.collect()) == ["v", "w", "x"]
    item = "one two three four five six seven eight nine"
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(9, f"so {item} more", "u"), (None, item, "t"), (9, "clean", "s")], "doc_id long, text string, id string").withColumns({"h": F.lit(1), "c0": F.lit(2), "toxic": F.lit(0)}))
    kept = decontamination.drop_contaminated(more, bench)
    assert kept.columns == docs.columns and sorted(r.id for r in kept.collect()) == ["s", "v", "w", "x", "y", "z"]
    assert toxicity.drop(docs.limit(0), chain, "toxic").collect() == decontamination.drop_contaminated(docs.limit(0), bench).collect() == []


def test_near_copies_of_short_texts_are_verified(spark):
    """Texts of 5 to 30 words with 0 to 2 words appended, changed at the end or in the middle: linked at 0.8 exactly and above, and only there."""
    rows, pairs = [], []
    for n in range(5, 31):
        for draw in range(4):
            base = words(1000 * n + draw, n)
            for kind in range(1, 6):
                other = [*base, "more", "words"][: n + kind] if kind < 3 else [*base[: n - kind + 2], *["new", "end"][: kind - 2]] if kind < 5 else [*base[: n // 2], "x", *base[n // 2 + 1 :]]
                tag = [f"{w}{kind}" for w in base], [f"{w}{kind}" for w in other]
                pairs.append((len(rows), len(rows) + 1, jaccard(*map(" ".join, tag))))
                rows += [(len(rows), " ".join(tag[0])), (len(rows) + 1, " ".join(tag[1]))]
    got = dict(near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    wrong = [(i, j, s) for i, j, s in pairs if (got[i] == got[j]) != (s >= 0.8)]
    assert any(s == 0.8 for _, _, s in pairs) and len(wrong) <= len(pairs) // 200, wrong
    assert not [w for w in wrong if w[2] < 0.8]


def test_set_links_by_brute_force_and_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(np.concatenate((np.arange(40 * g, 40 * g + rng.integers(20, 40)), rng.integers(10_000, 20_000, rng.integers(0, 8))))).astype(np.uint64) for g in range(12) for _ in range(10)] + [np.zeros(0, dtype=np.uint64)]
    want = [(a, b) for a in range(len(sets)) for b in range(a) if (c := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - c) > 0]
    label = lambda links: simhash.stars(len(sets), *(np.array(x, dtype=np.int64) for x in zip(*links, strict=True))).tolist()
    assert label(simhash.set_links(sets, 0.8)) == label(want) != list(range(len(sets)))
    monkeypatch.setattr(simhash, "PART_ROWS", 3)
    base = words(7, 60)
    rows = [(i, " ".join([*base[:59], f"end{i}"])) for i in range(20)]
    assert {r.component for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_keep_one_judges_rows_of_one_id_by_their_texts(spark):
    a, b, c = (" ".join(words(k, 40)) for k in (1, 2, 3))
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, c, "u"), (3, c, "t"), (None, b, "n"), (None, "else", "m"), (None, "else", "l"), (4, f"{c} one", "v"), (5, None, "w"), (6, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = sorted((r.doc_id or 99, r.text) for r in keep_one(docs).collect())
    assert kept == sorted([(1, a), (1, b), (3, c), (5, None), (99, "else")], key=lambda r: (r[0], r[1] or ""))
    for _ in range(2):
        again = {r.id for r in keep_one(docs.repartition(7)).collect()}
        assert again == {r.id for r in keep_one(docs).collect()}


def test_many_near_fingerprints_need_no_pairs():
    """3000 fingerprints, all near one another, make stars before their 4.5 million pairs."""
    n = 3000
    fps = np.sort((np.arange(n) % 3).astype(np.uint64))
    near = simhash.popcount(fps ^ simhash.pivot_fingerprints()[0]).astype(np.int16)
    at = np.argsort(near, kind="stable")
    a, b = simhash.local_links(np.zeros(n, dtype=np.int64), near[at], fps[at], simhash.pivot_fingerprints(), 4)
    assert len(a) < n + (1 << 19) and not simhash.stars(n, a, b).any()


def test_pipeline_with_odd_rows_and_none(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, columns named like the operators' own; and a table without rows."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/odd/{name}.parquet")
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    one = docs.first()
    rows = [(None, "no id has this text", "en", "s", 3), (None, None, None, None, None), (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (one.doc_id, one.text, one.lang, one.source, one.n_chars), (10**6 + 2, "ab " * 200_000, "en", "s", 1), (10**6 + 3, one.text, None, None, None)]
    odd = docs.unionAll(spark.createDataFrame(rows, docs.schema))
    for c in ("id", "block", "h", "root", "c0", "label_id", "i", "toxic"):
        odd = odd.withColumn(c, F.lit(c))
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {r.doc_id for r in out}
    assert {10**6 + 2, None} <= ids and 10**6 + 3 not in ids
    pieces = {}
    for r in out:
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 for p in pieces.values())
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_driver_hands_memory_back_between_steps(spark, monkeypatch):
    """Garbage is collected once in PAUSE at most, native memory handed back after each step; both really run."""
    assert common.trim(spark)
    steps = []
    monkeypatch.setattr(common, "_in_one_process", lambda s: False)
    monkeypatch.setattr(common, "shared_dir", lambda s: None)
    monkeypatch.setattr(common, "release", lambda: steps.append("collected"))
    monkeypatch.setattr(common, "trim", lambda s: steps.append("trimmed"))
    spark.sparkContext._quillspar_collected = -common.PAUSE
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    assert common.cut(common.cut(spark.range(5))).count() == 5
    assert steps == ["collected", "trimmed", "trimmed"]


def test_executors_hand_memory_back_before_each_stage(spark, monkeypatch):
    """On a cluster each stage begins with a collection of the executors' garbage (here the one JVM's); on a local master nothing is collected."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collected = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = collected()
    common.empty_executors(spark)
    assert collected() == before
    monkeypatch.setattr(common, "_in_one_process", lambda s: False)
    common.empty_executors(spark)
    assert collected() > before
    begun = []
    monkeypatch.setattr(corpus_pipeline, "empty_executors", lambda s: begun.append(s))
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF).count() == 1 and begun == [spark]
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)


def test_packing_hands_memory_back_after_each_group(monkeypatch):
    class Rows:
        dtypes = [("id", "bigint")]

        def mapInArrow(self, run, schema):
            return run

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    freed = []
    monkeypatch.setattr(packing, "only", lambda *a, **k: Rows())
    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(packing, "give_free", lambda: freed.append(1))
    monkeypatch.setattr(packing, "GROUP", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["a few words"] * 9)], ["id", "text"])
    out = list(packing.pack(None)(iter([batch])))
    assert len(out) == 3 and len(freed) == 2 and sorted({i for b in out for i in b.column("id").to_pylist()}) == list(range(9))
