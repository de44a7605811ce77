import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspar.llm import pitman_yor as py

SF = "/root/testdata/sf0.001"


def toks(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def test_base_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in toks(t))
    n, v = sum(c.values()), len(c)
    out = {r.doc_id: r for r in py.op10_lm_score(spark, SF.replace("0.001", "0.01")).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        w, r = toks(t), out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    gain = [sum(getattr(out[i], k) for i, _ in rows if held[i]) / sum(out[i].n_tokens for i, _ in rows if held[i]) for k in ("base_score", "score")]
    assert gain[1] > gain[0] + 0.1, gain


def test_edges(spark):
    rows = [(1, None, False), (2, "", True), (3, "a b a b", False), (None, "b a", False), (5, "q " * 50_000, True), (3, "a", False)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h boolean, block int")
    out = py.score_texts(df, F.col("h")).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 2, 3, 5, 50_001]
    assert {r.train_tokens for r in out} == {1 + 5 + 3 + 2}
    assert all(np.isfinite(r.score) for r in out)
    assert py.score_texts(df.limit(0), F.col("h")).count() == 0
    assert all(r.n_known == 0 for r in py.score_texts(df, F.lit(True)).collect())


TEXTS = ["a b c", "a b", "c a a b", "b c", "a b", "d a b", "c c a b d", "a"]


def exact_sampler(texts, turns, seed, ask, discount, root):
    """Mean predictive probabilities by seating one customer after the other, over many turns."""
    rng = np.random.default_rng(seed)
    customers = [(x, y) for t in texts for x, y in zip([0, *t.split()], [*t.split(), None], strict=True)]
    words = {y for _, y in customers}
    v = len(words)
    rooms, top = {}, {}
    count = lambda room: sum(sum(x) for x in room.values())
    tables = lambda room: sum(len(x) for x in room.values())

    def base(w):
        mine = top.get(w, [])
        return (max(sum(mine) - root * len(mine), 0) + (py.THETA_ROOT + root * tables(top)) / (v + 1)) / (py.THETA_ROOT + count(top))

    def sit(room, w, d, weight):
        mine = room.setdefault(w, [])
        p = np.array([n - d for n in mine] + [weight])
        k = rng.choice(len(p), p=p / p.sum())
        if k == len(mine):
            mine.append(0)
        mine[k] += 1
        return mine[k] == 1

    def rise(room, w):
        mine = room[w]
        k = rng.choice(len(mine), p=np.array(mine) / sum(mine))
        mine[k] -= 1
        if not mine[k]:
            del mine[k]
            return True
        return False

    def add(c, w):
        room = rooms.setdefault(c, {})
        if sit(room, w, discount, (py.THETA + discount * tables(room)) * base(w)):
            sit(top, w, root, (py.THETA_ROOT + root * tables(top)) / (v + 1))

    for c, w in customers:
        add(c, w)
    total = np.zeros(len(ask))
    for turn in range(turns):
        for c, w in customers:
            if rise(rooms[c], w):
                rise(top, w)
            add(c, w)
        if turn >= turns // 5:
            for k, (c, w) in enumerate(ask):
                room = rooms.get(c, {})
                mine = room.get(w, [])
                total[k] += (max(sum(mine) - discount * len(mine), 0) + (py.THETA + discount * tables(room)) * base(w)) / (py.THETA + count(room))
    return total / (turns - turns // 5)


def _asked(spark, words, samples):
    """Probabilities of each of ``words``, of an unknown word and of the end after 'a'."""
    rows = [(i, t, False) for i, t in enumerate(TEXTS)] + [(100 + k, f"a {w}".strip(), True) for k, w in enumerate([*words, "zzz", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    out = {r.id: r.token_scores for r in py.score_texts(df, F.col("h"), samples=samples, sweeps=6, with_tokens=True).collect()}
    return [10 ** out[100 + k][1] for k in range(len(words) + 2)]


def test_probabilities_sum_to_one(spark):
    """Over all continuations of 'a': the known words, one unknown word and the end."""
    assert math.isclose(sum(_asked(spark, "abcd", 2)), 1, rel_tol=1e-9)


def test_score_follows_an_exact_sampler(spark):
    got = _asked(spark, "abcd", 60)
    pairs = Counter((x, y) for t in TEXTS for x, y in zip([0, *t.split()], [*t.split(), None], strict=True))
    words = Counter(y for t in TEXTS for y in [*t.split(), None])
    of = lambda c: [0.0, 0.0, float(sum(x == 1 for x in c.values())), float(sum(x == 2 for x in c.values()))]
    root, discount = py.discounts(of(words) + of(pairs))
    want = exact_sampler(TEXTS, 1500, 1, [("a", w) for w in (*"abcd", "zzz", None)], discount, root)
    assert np.abs(np.log(got) - np.log(want)).max() < 0.1, (got, want.tolist())


def test_gamma_has_its_law():
    keys = np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shape in (0.05, 0.6, 1.0, 3.5, 400.0):
        x = py.gamma(keys, shape, 1, 2)
        assert abs(x.mean() - shape) < 0.02 * max(shape, shape**0.5) and abs(x.var() / shape - 1) < 0.05


def test_results_do_not_depend_on_the_blocks(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(30)), i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    one = {r.id: (r.base_score, r.score) for r in py.score_texts(df, F.col("h")).collect()}
    monkeypatch.setattr(py, "text_blocks", lambda *a: 7)
    many = {r.id: (r.base_score, r.score) for r in py.score_texts(df, F.col("h")).collect()}
    assert all(np.allclose(one[k], many[k], rtol=1e-9) for k in one)


def test_seating_follows_exact_distribution():
    """Three customers of one dish: the share of one, two or three tables by the exact weights of the arrangements."""
    n, a, d = 200_000, 0.7, 0.4
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tables = py.seat(keys, np.full(n, 3), np.full(n, a), d, 1)
    w = np.array([a * (1 - d) * (2 - d), 3 * a * a * (1 - d), a**3])
    got = np.bincount(tables, minlength=4)[1:4] / n
    assert np.abs(got - w / w.sum()).max() < 0.02


def test_many_customers_follow_the_same_law():
    """The shares of all numbers of tables at 13, 100 and 1000 customers by S(c, t) * weight**t, and the limit of very many customers."""
    n = 40_000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for d, a in ((0.7, 0.5), (0.7, 5.0), (0.3, 40.0), (0.9, 0.1)):
        logs = np.array([0.0])  # of S(c, t), t = 1..c
        for c in range(1, 1000):
            with np.errstate(divide="ignore"):
                joined = np.log(np.maximum(c - d * np.arange(1, c + 1), 0)) + logs
            logs = np.logaddexp(np.append(joined, -np.inf), np.append(-np.inf, logs))
            if c + 1 in (13, 100, 1000):
                p = logs + np.arange(1, c + 2) * math.log(a)
                p = np.exp(p - p.max())
                p /= p.sum()
                got = np.bincount(py.seat(keys, np.full(n, c + 1), np.full(n, a), d, 1), minlength=c + 2)[1:] / n
                assert np.abs(np.cumsum(got) - np.cumsum(p)).max() < 0.015, (d, a, c + 1)
    tables = py.seat(keys, np.full(n, 10**9), np.full(n, 5.0), 0.7, 1)
    assert abs(tables.mean() - 1 - 5 / 0.7) < 0.06 and abs(tables.var() - 5 / 0.7) < 0.3
    tables = [py.seat(keys, np.full(n, c), np.full(n, 60.0), 0.6, 1).mean() for c in (py.LARGE, py.LARGE + 1, 2 * py.LARGE)]
    assert abs(tables[1] - tables[0]) < 0.2 and 0 <= tables[2] - tables[0] < 3


def test_cut_rows_draw_what_whole_rows_draw(monkeypatch):
    """Rows end where no more tables can be told from none by the sums' rounding: the same draws as from all LARGE numbers of tables, from far fewer cells."""
    cells, exp, n, d = [], np.exp, 300, 0.7
    monkeypatch.setattr(np, "exp", lambda x, **k: cells.append(np.size(x)) or exp(x, **k))
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole, t = py._ratios(d, py.LARGE), np.arange(py.LARGE)
    ways = np.array([math.lgamma(y + 1) for y in t.tolist()])
    for x in (1e-6, 0.01, 0.5, 3.0, 12.0, 60.0, 900.0, 5000.0):
        for c in (13, 100, py.LARGE):
            p = whole[c] - ways + t * np.log(x * d / d)
            p = np.cumsum(exp(p - p.max()))
            cells.clear()
            got = py.seat(keys, np.full(n, c), np.full(n, x * d), d, 1)
            assert sum(cells) <= 1.25 * n * min(c, x + 9 * math.sqrt(x) + 20), (x, c, sum(cells) / n)
            assert (got == np.minimum(c, 1 + np.searchsorted(p[:-1], py.uniform(keys, 1, 0, 0) * p[-1]))).all(), (x, c)


def test_chains_share_their_dishes(monkeypatch):
    """A block's bigrams are placed and keyed once for all chains, whose draws differ and stay the same when drawn again."""
    calls, places = [], py.places
    monkeypatch.setattr(py, "places", lambda *a: calls.append(1) or places(*a))
    model = py.Model([900.0, 50.0, 20.0, 9.0, 900.0, 300.0, 200.0, 50.0], 3)
    model.add_round([300.0, 60.0, 250.0] * 3 + [5.0])
    words, counts = np.arange(1, 51, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2 + np.arange(200) % 40
    seen = np.tile([np.full(50, 6), np.full(50, 2), np.full(50, 5)], (3, 1))
    first, again = (list(model.draws(0, words, seen, np.arange(200) % 50, np.arange(200) // 4, counts)) for _ in range(2))
    assert len(calls) == 2 and len(first) == 3
    assert all((x == y).all() and (x >= 1).all() and (x <= counts).all() for x, y in zip(first, again, strict=True))
    assert (first[0] != first[1]).any() and (first[1] != first[2]).any()


def test_places_are_those_of_a_sorted_search():
    draw = np.random.default_rng(4)
    for size, n, m in ((1, 3, 1), (50, 20, 30), (1000, 0, 40), (9, 0, 0)):
        a, b = draw.integers(0, size, n), draw.integers(0, size, m)
        used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        found = py.places(size, a, b)
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(found, (used, *np.split(at, [n])), strict=True))
