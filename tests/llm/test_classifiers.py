import random
import zlib

import numpy as np

from quillspar.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = language.op2_language(spark, SF).collect()
    assert len(out) == len(truth) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r.lang_pred == truth[r.doc_id] for r in out if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_language_edges(spark):
    train = spark.createDataFrame([("der die das und", "de"), ("the of and is", "en"), (None, "fr"), ("x y", None)], "text string, lang string")
    model = language.train(train)
    assert model.languages == ["de", "en"]
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 !?", 0), (4, "die das", 0), (None, "the and " * 90_000, 0)], "doc_id long, text string, score int")
    out = {r.id: (r.lang_pred, r.score) for r in language.identify(df, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] == "de" and out[None][0] == "en"
    assert language.identify(df.limit(0), model).count() == 0
    assert language.train(train.limit(0)).predict("abc") == ("und", 0.0, False)


def test_codes_are_apart():
    for k in (3, 4, 7, 12, 30):
        code = language.code_matrix(k).astype(int)
        far = (code.shape[1] - code @ code.T) // 2
        np.fill_diagonal(far, 99)
        assert far.min() >= 2 ** (min(k, 7) - 2) if k <= 7 else far.min() >= 5


def test_toxicity_held_out(spark):
    """Rows of quality 0 in the small tables carry a toxic label at random, so they are not counted."""
    d = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    chain = toxicity.train(docs, toxicity.categories_of(labels.where("doc_id % 3 <> 0")), toxicity.CATEGORIES)
    truth = {r.doc_id: r.toxic == 1 for r in labels.where("doc_id % 3 = 0 and quality = 1").collect()}
    out = {r.id: r.toxic for r in toxicity.classify(docs, chain).collect() if r.id in truth}
    hits, toxic = sum(truth[i] and out[i] for i in truth), sum(truth.values())
    false = sum(out[i] and not truth[i] for i in truth)
    assert hits >= 0.9 * toxic and false <= 0.01 * (len(truth) - toxic), (hits, toxic, false, len(truth))


def test_toxicity_edges(spark):
    spell = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    rows = [(f"{' '.join(spell(7919 * i + k * k) for k in range(1, 9))} {'vile' if i % 2 else 'fine'}", False, i % 2 == 1) for i in range(90)] + [(None, True, True), ("odd", None, True)]
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(rows)] + [(None, "vile", "x")], "doc_id long, text string, labels string")
    labels = spark.createDataFrame([(i, j, t) for i, (_, j, t) in enumerate(rows)] + [(None, True, True), (7777, True, True)], "doc_id long, junk boolean, toxic boolean")
    chain = toxicity.train(docs, labels, ["junk", "toxic"])
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "something VILE!!", 1), (None, "fine " * 100_000, 1)], "doc_id long, text string, toxic int")
    out = {r.id: r.toxic for r in toxicity.classify(df, chain).collect()}
    assert out == {1: False, 2: False, 3: True, None: False}
    nothing = toxicity.train(docs, labels.limit(0), ["junk", "toxic"])
    assert [r.toxic for r in toxicity.classify(df, nothing).collect()] == [False] * 4


def test_language_repeated_rows_and_bounds(spark):
    rows = [("the of and is", "en")] * 5 + [("der die das und", "de")] * 4 + [(f"dirty{i}", f"x{i}") for i in range(30)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), classes=2)
    assert model.languages == ["de", "en"]
    df = spark.createDataFrame([(1, "die das"), (1, "die das"), (1, "the of")], "doc_id long, text string")
    assert sorted((r.id, r.lang_pred) for r in language.identify(df, model).collect()) == [(1, "de"), (1, "de"), (1, "en")]


def test_language_by_brute_force(spark):
    """Counts of byte n-grams, log odds for each split of the languages, and the nearest codeword, all in plain Python."""
    texts = [("the of and is it", "en"), ("der die das und", "de"), ("le la les et", "fr"), ("and the it of", "en"), ("und der das", "de")]
    model = language.train(spark.createDataFrame(texts, "text string, lang string"))

    def slots(text):
        data, out = f" {' '.join(text.lower().split())} ".encode(), []
        for n in language.ORDERS:
            for i in range(len(data) - n + 1):
                code = int.from_bytes(data[i : i + n], "big")
                out.append((code * 2654435761 % 2**32 >> 18) + language.SLOTS * language.ORDERS.index(n))
        return out

    langs, size = ["de", "en", "fr"], language.SLOTS * 3
    counts = {x: np.full(size, 0.5) for x in langs}
    for t, x in texts:
        np.add.at(counts[x], slots(t), 1)
    share = {x: counts[x] / counts[x].sum() for x in langs}
    words = [[1, 1, 1], [-1, 1, -1], [-1, -1, 1]]
    assert sorted(map(tuple, model.code.T.tolist())) == sorted(map(tuple, np.array(words).T.tolist()))
    for text in ("the and", "das und die", "les et la", "it is der"):
        margins, apart = [], []
        for bit in model.code.T:
            up, down = (np.mean([share[x] for x, b in zip(langs, bit, strict=True) if b == s], axis=0) for s in (1, -1))
            odds = np.log(up / down)
            margins.append(odds[slots(text)].sum() / len(slots(text)) ** 0.5)
            apart.append(np.mean([max(0, b * (share[x] * odds).sum()) for x, b in zip(langs, bit, strict=True)]))
        weight = np.array(apart) / np.mean(apart)
        loss = (weight * np.log1p(np.exp(-model.code * np.array(margins)))).sum(axis=1)
        p = np.exp(-loss) / np.exp(-loss).sum()
        found = model.predict(text)
        assert found[0] == langs[int(p.argmax())] and abs(found[1] - p.max()) < 1e-4


def test_toxicity_chain_by_brute_force(spark):
    """Each link's probability from its weights, one feature at a time; the second link sees the first one's probability and no shape."""
    spell = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    rows = [(i, f"{' '.join(spell(7919 * i + k * k) for k in range(1, 9))} {'vile' if i % 2 else 'fine'} {'!!!! ####' if i % 3 == 0 else ''}", i % 3 == 0, i % 2 == 1) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame([(i, j, t) for i, _, j, t in rows], "doc_id long, junk boolean, toxic boolean"), ["junk", "toxic"])
    asked = docs.unionAll(docs.limit(3))  # repeated rows are judged alike
    got = {}
    for r in toxicity.classify(asked, chain).collect():
        assert got.setdefault(r.id, r) == r
    for i, text, _, _ in rows[:40]:
        words = toxicity.terms(text)
        have, extra = toxicity.term_hashes(words), toxicity.dense(text.encode(), len(words))
        for link in chain.links:
            z = sum(link.weights[c] for h, c in link.columns.items() if h in have) + sum(w * x for w, x in zip(link.weights[len(link.columns) :], [*extra, 1.0], strict=True))
            p = 1 / (1 + np.exp(-z))
            assert abs(p - getattr(got[i], f"p_{link.name}")) < 1e-9 and getattr(got[i], link.name) == bool(p > link.threshold)
            extra = [p]


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} {'vile' if i % 2 else 'fine'}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(60)], "doc_id long, toxic boolean")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 0)
    assert [r.toxic for r in toxicity.classify(docs.limit(2), toxicity.train(docs, labels, ["toxic"])).collect()] == [False] * 2


def test_language_learns_every_language(spark):
    """Languages beyond those that the driver holds are learned too, rare ones like any other."""
    draws = [random.Random(k) for k in range(70)]
    rows = [(" ".join("".join(draws[k].choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)), f"l{k:02}") for k in range(70) for _ in range(1 if k else 3)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 70 > language.DENSE
    assert [model.predict(text)[0] for text, _ in rows] == [lang for _, lang in rows]


def test_language_models_are_alike(spark, monkeypatch):
    texts = [("the of and is it", "en"), ("der die das und", "de"), ("le la les et", "fr"), ("and the it of", "en"), ("und der das", "de"), ("12 34", "no letter"), (None, "null")]
    texts += [(f"word{chr(97 + k) * 3} other{chr(110 + k) * 2}", f"x{k}") for k in range(8)]
    df = spark.createDataFrame(texts, "text string, lang string")
    dense = language.train(df)
    monkeypatch.setattr(language, "DENSE", 1)
    spread = language.train(df)
    assert spread.languages == dense.languages and len(dense.languages) == 11
    assert (spread.code == dense.code).all()
    assert np.allclose(spread.weights, dense.weights, atol=1e-5) and np.allclose(spread.bit_weights, dense.bit_weights, atol=1e-9)


def test_codewords_of_many_languages_differ():
    code = language.code_matrix(2000)
    assert len(np.unique(code, axis=0)) == 2000 and (np.abs(code.astype(int).sum(axis=0)) < 2000).all()
