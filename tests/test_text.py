"""Expressions against their definitions in Python, with CJK text."""

import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from quillspar.functions import embedding, paths
from quillspar.functions import text as T
from quillspar.functions import values as V
from quillspar.operators import chunking

TEXTS = ["型号: LDR-100\n厂商: ACME Sensors\n测距范围: 100 m\n精度: ±2 cm", "", "  ", "a(b) c, d/e [x] 50% - ok!", "传感器 range 是 10m。", "x" * 300, "é ü　end", "one two\tthree\n\nfour"]


def column(spark, values, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def py_tokens(t):
    return re.findall(r"[一-鿿]|[A-Za-z0-9_./%+\-]+|[^\s]", t)


def py_join(tokens):
    out = ""
    han = lambda c: "一" <= c <= "鿿"
    for t in tokens:
        glue = not out or han(t[0]) or han(out[-1]) or t[0] in ",.!?;:%)]}" or out[-1] in "([{/-"
        out += t if glue else " " + t
    return out


def test_tokens_and_back(spark):
    assert column(spark, TEXTS, T.chunk_tokens) == [py_tokens(t) for t in TEXTS]
    df = spark.createDataFrame([(k, py_tokens(t)) for k, t in enumerate(TEXTS)], "k int, v array<string>")
    assert [r.x for r in df.select("k", T.untokenize(F.col("v")).alias("x")).orderBy("k").collect()] == [py_join(py_tokens(t)) for t in TEXTS]


def test_windows_overlap_and_keep_the_page(spark):
    long = " ".join(f"token{i}" for i in range(120))
    df = spark.createDataFrame([(1, long)], "d int, t string").select("d", F.array(chunking.segment(F.col("t"), page=F.lit(3)), chunking.segment(F.lit("| a |"), "table"), chunking.segment(F.lit(""), "code"), chunking.segment(F.lit(None).cast("string"))).alias("segments"))
    got = chunking.chunk(df, 48, 8).orderBy("chunk_index").collect()  # 48 is raised to 64
    assert [(r.chunk_index, r.token_offset, r.n_tokens, r.page_number, r.content_type) for r in got] == [(0, 0, 64, 3, "text"), (1, 56, 64, 3, "text"), (2, 0, 3, None, "table"), (3, 0, 0, None, "code")]
    assert got[1].content.split()[0] == "token56"


def test_models_and_makers(spark):
    texts = ["型号: LDR-100 激光", "Model: VLP-16 sensor", "符合 ISO9001 和 IP67", "USB3 RS232 GB2312", "符合 ISO9001 的型号 ABC-200 传感器", "P/N：X1", ""]
    assert column(spark, texts, T.sensor_model) == ["LDR-100", "VLP-16", None, None, "ABC-200", "X1", None]
    assert column(spark, ["厂商: ACME Sensors\n", "none"], T.manufacturer) == ["ACME Sensors", None]


def test_fields_and_values(spark):
    assert column(spark, ["Operating temperature range", "接口类型", " Part  Number", "x"], V.field_of) == ["range", "sensor_type", "model", None]
    samples = ["-40~+85 ℃", "±2 cm", "　 5 - 9 V", "IP67", "100"]
    assert column(spark, samples, V.value_of) == ["-40", "±2", "5 - 9", "IP67", "100"]
    assert column(spark, samples, V.unit_of) == ["~+85 ℃", "cm", "V", None, None]


def test_highlight_preview_and_table(spark):
    assert column(spark, ["The RANGE of LiDAR"], lambda c: T.highlight(c, "range lidar a")) == ['The <span class="highlight">RANGE</span> of <span class="highlight">LiDAR</span>']
    assert column(spark, ["abcdef", "ab"], lambda c: T.preview(c, 3)) == ["abc...", "ab"]
    df = spark.createDataFrame([([["a", None], [" ", None], ["b\nc", "d", "e"]],), ([[None]],)], "t array<array<string>>")
    assert [r[0] for r in df.select(T.table_to_markdown(F.col("t"))).collect()] == ["| a |  |  |\n| --- | --- | --- |\n| b c | d | e |", ""]


def test_exclusions(spark):
    mpeg = bytearray(400)
    mpeg[0] = mpeg[188] = mpeg[376] = 0x47
    rows = [("/a/x.txt", 1 << 20, b"t"), ("/a/x.txt", (1 << 20) + 1, b"t"), ("/a/x.csv", 1, b""), ("/a/x.db", 1, b""), ("/a/data/chroma/x.json", 1, b""), ("/manuals/chroma/x.json", 1, b"{}"), ("/a/x.md", 1, b"\xa1\xb2\xc3\xd4"), ("/a/x.bin", 1, b"ID3"), ("/a/x.ts", 1, bytes(mpeg)), ("/a/x.ts", 1, b"const x = 1"), ("/a/x.md", 1, b"\xff\xfb"), ("/a/x.md", 1, b"1234ftyp"), ("/a/.hidden", 1, None), ("/a/x.PDF", 1, None)]
    df = spark.createDataFrame(rows, "p string, n long, h binary")
    got = [r[0] for r in df.select(paths.exclusion_reason(F.col("p"), F.col("n"), F.col("h"))).collect()]
    r = paths.REASONS
    assert got == [None, r["size"], r["csv"], r["database"], r["database"], None, r["capture"], r["media"], r["media"], None, r["media"], r["media"], r["type"], None]


def test_hashed_vectors(spark):
    got = column(spark, ["a b a", "", None, "Ä b"], lambda c: embedding.embed(c, 64))
    want = [embedding.hashed_vector(t, 64) if t is not None else None for t in ["a b a", "", None, "Ä b"]]
    assert all((a is None and b is None) or np.allclose(a, b) for a, b in zip(got, want, strict=True))
    assert got[1] == [0.0] * 64


def test_strip_and_lines_know_all_white_space(spark):
    """As Java's patterns have it, from which Python's white space differs."""
    java = [c for c in map(chr, range(1, 0xD800)) if c in "\t\n\x0b\x0c\r \x85" or unicodedata.category(c) in ("Zs", "Zl", "Zp")]
    texts = [c + "a b" + c for c in map(chr, range(1, 0xD800))] + ["", " ", "　", "  x", "x\xa0 ", " é ", "\x1cx\x7f"]
    assert column(spark, texts, T.strip) == [t.strip("".join(java)) for t in texts]
    assert sorted(T.BLANKS) == sorted(java)
    texts = ["a\nb\r\nc\rd", "a\x0bb\x0c", "a b \x85", "a\n\nb\n", "", "one"]
    assert column(spark, texts, T.lines) == column(spark, texts, lambda c: F.split(c, r"\R"))


def test_pairs_are_those_of_their_pattern(spark):
    pattern = r"(?U)^([^:：]{2,60})\s*[:：]\s*(.{1,180})$"
    draw = random.Random(5)
    lines = ["".join(draw.choice("ab:： 　\xa0|;，é") for _ in range(draw.randint(0, 9))) for _ in range(3000)]
    lines += ["a" * n + " " * m + ":" + " " * k + "v" * z for n in (1, 2, 59, 60, 61) for m in (0, 1, 60) for k in (0, 3) for z in (0, 1, 180, 181, 240)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, v string").select("k", T.strip(F.col("v")).alias("v")).withColumn("colon", V.colon(F.col("v")))
    df = df.withColumns({"head": F.substring("v", F.lit(1), F.col("colon") - 1), "rest": F.substring("v", F.col("colon") + 1, F.length("v"))})
    fits = F.length("v").between(4, 300) & F.col("v").rlike(pattern)
    name, found = (F.when(fits, x) for x in (T.strip(F.regexp_extract("v", pattern, 1)), F.btrim(F.regexp_extract("v", pattern, 2), F.lit(T.TRIM))))
    rows = df.select("v", V.pair(F.col("v"), F.col("head"), F.col("rest")).alias("pair"), name.alias("name"), found.alias("found")).collect()
    assert [(r.v, r.pair and tuple(r.pair)) for r in rows] == [(r.v, None if r.name is None else (r.name, r.found)) for r in rows] and sum(r.pair is not None for r in rows) > 400
