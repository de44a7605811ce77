import io
import json
import zipfile

from quillspar.sources import files, parsers
from quillspar.streaming import ingest


def docx_bytes():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("First") + p(" ") + p("Second") + f"<w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{cell('a')}{cell('')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    put("a.txt", "Model: LDR-100".encode())
    put("sub/b.txt", "型号: LDR-200".encode("gb18030"))
    put("c.py", b"import os\nclass Driver:\n    pass\n\ndef read_sensor():\n    return 1\n")
    put("bad.py", b"def broken(:\n")
    put("d.docx", docx_bytes())
    put("broken.docx", b"nothing")
    put("e.csv", b"x")
    put("f.mp3", b"ID3")
    return str(tmp_path / "in")


def test_scan_and_parse(spark, tmp_path):
    root = folder(tmp_path)
    got = {r.filename: r for r in files.scan(spark, root).collect()}
    assert set(got) == {"a.txt", "b.txt", "c.py", "bad.py", "d.docx", "broken.docx"}
    assert got["a.txt"].file_type == "text" and got["a.txt"].file_path.startswith("/") and len(got["a.txt"].file_hash) == 32
    parsed = {r.file_path.rsplit("/", 1)[1]: r for r in files.parse(files.read_files(spark, root)).collect()}
    text = {k: [(s.content, s.content_type) for s in r.segments] if r.segments is not None else r.error for k, r in parsed.items()}
    assert text["a.txt"] == [("Model: LDR-100", "text")] and text["b.txt"] == [("型号: LDR-200", "text")]
    assert text["c.py"] == [("class Driver:\n    pass", "code"), ("def read_sensor():\n    return 1", "code")]
    assert text["bad.py"] == [("def broken(:\n", "code")]
    assert text["d.docx"] == [("First\nSecond", "text"), ("| k | v |\n| --- | --- |\n| a |  |", "table")]
    assert text["broken.docx"].startswith("BadZipFile")


def test_stream_takes_new_files_once(spark, tmp_path):
    root, out, state = folder(tmp_path), str(tmp_path / "out"), str(tmp_path / "state")
    for new in (None, "g.md"):
        if new:
            (tmp_path / "in" / new).write_text("# more")
        ingest.ingest(spark, root, out, state).awaitTermination()
    rows = [(r.file_path.rsplit("/", 1)[1], r.chunk_index) for r in spark.read.parquet(out).collect()]
    assert sorted(rows) == [("a.txt", 0), ("b.txt", 0), ("bad.py", 0), ("c.py", 0), ("c.py", 1), ("d.docx", 0), ("d.docx", 1), ("g.md", 0)]


def test_ocr_gate():
    assert parsers.ocr_pages(["", "x" * 90, "short", None], 80, 2) == [1, 3]
    assert parsers.ocr_pages(["", "x" * 90, "short", None], 80, 0) == [1, 3, 4]


def test_code_units_keep_their_names_and_lines():
    got = parsers.code("c.py", b"import os\nclass Driver:\n    pass\n\ndef read():\n    return 1\n")
    assert [json.loads(s["metadata"]) for s in got] == [{"symbol": "Driver", "start_line": 2, "end_line": 3}, {"symbol": "read", "start_line": 5, "end_line": 6}]
    assert parsers.code("c.c", b"int x;")[0]["metadata"] is None


def test_pages_with_a_recogniser():
    def read(page):
        if page == 3:
            raise RuntimeError("no model")
        return "seen\n\nseen\nmore"

    pages = [("long enough " * 10, [[["k", "v"], ["a", None]]]), ("short", []), ("", []), ("", [])]
    got = [(s["page_number"], s["content_type"], s["content"][:9]) for s in parsers.pages_to_segments(pages, read, 80, 2)]
    assert got == [(1, "text", "long enou"), (1, "table", "| k | v |"), (2, "text", "short"), (2, "text", "seen\nmore")]
    assert [s["page_number"] for s in parsers.pages_to_segments(pages)] == [1, 1, 2]
