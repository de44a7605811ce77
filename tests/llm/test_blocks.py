import numpy as np

from quillspar.llm import blocks


def test_order_and_groups_against_numpy():
    draw = np.random.default_rng(3)
    for keys in (np.zeros(0, dtype=np.uint64), draw.integers(0, 2**64, 1, dtype=np.uint64), draw.integers(0, 50, 999).astype(np.uint64), draw.integers(0, 2**64, 5000, dtype=np.uint64), draw.integers(2**63, 2**63 + 4000, 5000, dtype=np.uint64)):
        assert (blocks.order(keys) == np.argsort(keys, kind="stable")).all()
        assert (blocks.distinct(keys) == np.unique(keys)).all()
        for got, want in zip(blocks.grouped(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True):
            assert (got == want).all()


def test_hot_ids_and_nulls_lie_in_several_blocks(spark):
    rows = [(7, f"t{i}") for i in range(400)] + [(i, "x") for i in range(100)] + [(None, f"n{i}") for i in range(300)] + [((1 << 63) - 1, "last")]
    df = spark.createDataFrame(rows, "id long, text string")
    block, wide = blocks.id_blocks(df, "id", "text", 16)
    got = [(r.id, r.b) for r in df.select("id", block.alias("b")).collect()]
    own = blocks.owners(np.array([b for _, b in got]), wide)
    assert len({b for i, b in got if i == 7}) > 3 and len({b for i, b in got if i is None}) > 3
    assert len({o for (i, _), o in zip(got, own, strict=True) if i == 7}) == len({o for (i, _), o in zip(got, own, strict=True) if i is None}) == 1
    rising = sorted({((i is None, i or 0), o) for (i, _), o in zip(got, own.tolist(), strict=True)})
    assert [o for _, o in rising] == sorted(o for _, o in rising)
    assert not {b for i, b in got if i == 7} & {b for i, b in got if i != 7}


def test_block_numbers_of_many_cells_by_a_plan_of_one_size(spark):
    """As many blocks as 6 GB have: a branch for each cell took the driver over 500 MB more, and its code didn't compile."""
    ids = [3 * i - 9000 for i in range(6000)]
    df = spark.createDataFrame([(i, "x") for i in ids], "id long, text string")
    sizes = []
    for n in (40, 1700):
        block, wide = blocks.id_blocks(df, "id", "text", n)
        rows = df.select("id", block.alias("b"))
        got = [r.b for r in rows.orderBy("id").collect()]
        assert got == sorted(got) and n <= len(set(got)) <= 1.25 * n and wide[-1][0] > max(got)
        assert max(got.count(b) for b in set(got)) <= 2.5 * len(ids) / n + 2
        sizes.append(len(rows._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 40_000
