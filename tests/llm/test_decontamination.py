import duckdb

from quillspar.llm import decontamination as dc

SF = "/root/testdata/sf0.01"


def test_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = sorted(con.execute(dc.OP8_SQL).fetchall())
    out = dc.op8_decontamination(spark, SF)
    assert out.columns == ["doc_id", "contaminated", "n_windows", "items"]
    assert sorted(map(tuple, out.collect())) == want
    assert sum(w[1] for w in want) > 10


ITEM = "A train drives 120 km in 2 hours and then it stops at the old station of Anna Berg for 2 minutes while Anna eats"


def test_templates(spark):
    bench = spark.createDataFrame([(1, ITEM, 0), (2, "short item of five words", 0), (3, None, 0), (4, "12 13 14", 0)], "item_id long, text string, id int")
    moved = ITEM.replace("120 km", "300 miles").replace("2 ", "5 ").replace("Anna", "Otto")
    docs = [
        (1, f"Intro text. {ITEM}. More."),
        (2, f"x {ITEM.upper()} y"),
        (3, f"x {moved} y"),
        (4, "drives 120 km in 2 hours and then"),
        (5, "Some text without any passage of it, which goes on and on for long."),
        (6, "so: SHORT item, of five words!"),
        (7, None),
        (8, ""),
        (None, ITEM),
        (1, "another text under the same number"),
        (9, "filler words here " * 40_000 + ITEM),
    ]
    out = [(r.id, r.contaminated, r["items"]) for r in dc.contaminated(spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, h string"), bench).collect()]
    flagged = sorted((str(i), x) for i, c, x in out if c)
    assert flagged == [("1", [1]), ("2", [1]), ("3", [1]), ("6", [2]), ("9", [1]), ("None", [1])]  # 4 has but four plain words in a row
    assert len(out) == len(docs)
    assert not any(r.contaminated for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).collect())
    assert dc.contaminated(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0


def test_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, "take 3 of the red balls and 3 of the blue")], "item_id long, text string")
    docs = [(1, "take 7 of the red balls and 7 of the blue"), (2, "take 7 of the red balls and 9 of the blue")]
    out = {r.id: r.contaminated for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, window=10).collect()}
    assert out == {1: True, 2: False}


def test_items_without_a_window_are_found_word_for_word(spark):
    long = " ".join(f"{k} km" for k in range(30))
    bench = spark.createDataFrame([(1, "What is 12 times 7?"), (2, long), (3, "12 13 14"), (4, ITEM)], "item_id long, text string")
    docs = [(1, "He asked: what is 12 times 7? Nobody knew."), (2, "He asked what is 12 times 8 of them"), (3, "so " + " ".join(long.split()[7:27])), (4, "12 13 14"), (5, ITEM), (6, "1 km 5 km " * 10), (None, "What IS 12 times 7")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: r["items"] for r in dc.contaminated(rows, bench, exact=True).collect() if r.contaminated}
    assert got == {1: [1], 3: [2], 5: [4], None: [1]}
    assert sorted(r.doc_id for r in dc.drop_contaminated(rows, bench).collect()) == [2, 4, 6]
    assert (dc.unsearchable(bench), dc.unsearchable(bench, exact=True)) == (3, 1)
    assert dc.unsearchable(spark.read.parquet(f"{SF}/benchmark.parquet")) == 0


def test_a_long_word_is_judged_whole(spark):
    """A capital after the first million characters makes a word no name, however long it is."""
    word = "X" + "a" * (1 << 20) + "B"
    df = spark.createDataFrame([(f"see {word} here",)], "text string").select(dc.raw_tokens(dc.F.col("text")).alias("raw"))
    assert df.select(dc.canonical_tokens(dc.F.col("raw"))).first()[0] == ["see", word.lower(), "here"]


def test_items_that_share_a_window_are_counted_each(spark):
    """Boilerplate of all items meets a row once and counts for every item; slots of equal patterns share a row."""
    head = "please solve the following problem with great care now"
    items = [(k, f"{head} {k} of {k if k % 2 else k + 1} km") for k in range(1, 7)] + [(50, None), (None, head)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {head} and"), (2, f"{head} 9 of 9 km"), (3, f"{head} 9 of 8 km"), (4, "clean")], "doc_id long, text string")
    out = {r.id: (r.n_windows, list(r.items)) for r in dc.contaminated(docs, bench).collect()}
    assert out[4] == (0, []) and out[1] == (2 * 6, list(range(1, 7)))
    assert out[2][1] == out[3][1] == list(range(1, 7)) and out[2][0] > out[3][0] > out[1][0]
