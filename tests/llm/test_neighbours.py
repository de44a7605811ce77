import numpy as np

from quillspar.llm import neighbours as nn


def brute(rows, k=5, every=50):
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    out = {}
    for i, v in rows:
        if i % every == 0:
            score = [(-nn.cosines(v[None], w[None])[0], j) for j, w in rows if j != i]
            out[i] = sorted(score)[:k]
    return out


def recall(spark, path):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {}
    for r in nn.op6_nearest(spark, path).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    vectors = dict(rows)
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        order = [(-found[k][1], found[k][0]) for k in range(1, 6)]
        assert order == sorted(order)
        for v, s in found.values():
            assert v != q and abs(s - nn.cosines(np.array([vectors[q]], float), np.array([vectors[v]], float))[0]) < 1e-12
        hit += len({v for v, _ in found.values()} & {j for _, j in want[q]})
    return hit / (5 * len(want))


def test_recall(spark):
    assert recall(spark, "/root/testdata/sf0.01") >= 0.9
    assert recall(spark, "/root/testdata/sf0.1") >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 1.0, 1.0]), (50, [1.0, 1.0]), (100, []), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, list int")
    out = nn.nearest(df, df.where("vec_id % 50 = 0"), 5).collect()
    got = {q: [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in out}}
    assert got == {0: [1, 3, 50, 2], 50: [0, 1, 2, 3]}
    assert nn.nearest(df.limit(0), df, 5).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0])] + [(i, [1.0, i / 10]) for i in range(1, 8)], "vec_id long, embedding array<double>")
    out = nn.nearest(twice, twice.where("vec_id = 0"), 5).collect()
    assert sorted((r.rank, r.vec_id) for r in out) == [(k, k) for k in range(1, 6) for _ in range(2)]
    far = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1e-201]), (2, [0.0, 1e300]), (3, [-1e308, 1e308])], "vec_id long, embedding array<double>")
    out = {r.vec_id: r.score for r in nn.nearest(far, far.where("vec_id = 0"), 5).collect()}
    assert abs(out[1] - 1 / 1.01**0.5) < 1e-12 and out[2] == 0 and abs(out[3] + 0.5**0.5) < 1e-12
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20_000)], "vec_id long, embedding array<float>")
    out = nn.nearest(same, same.where("vec_id = 100"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [0, 1, 2]
