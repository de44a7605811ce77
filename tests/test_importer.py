import json

from pyspark.sql import functions as F

from quillspar.functions.embedding import embed
from quillspar.operators import answers, progress
from quillspar.operators.importer import Importer
from quillspar.operators.model_client import WireClient
from quillspar.operators.store import Store
from quillspar.sources import files


def state(importer):
    docs = {r.filename: (r.status, r.sensor_model, r.document_id) for r in importer.read("documents").collect()}
    chunks = {(r.document_id, r.chunk_id) for r in importer.read("chunks").collect()}
    vectors = {(r.document_id, r.chunk_id) for r in importer.read("vectors").collect()}
    return docs, chunks, vectors


def test_import_update_move_delete_and_fail(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    put = lambda name, text: (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    for name, text in (("a.txt", "Model: LDR-100\nBrand: Acme"), ("b.md", "Model: LDR-200"), ("blank.txt", "  \n"), ("bad.docx", b"nothing"), ("x.csv", "1")):
        put(name, text)
    importer = Importer(spark, Store(spark, str(tmp_path / "store")), lambda t: embed(t, 8))
    report = importer.run(str(root), "j1").first()
    assert (report.scanned, report.imported, report.failed) == (4, 2, 2)
    assert [e.file_path.rsplit("/", 1)[1] for e in report.errors] == ["bad.docx", "blank.txt"]
    docs, chunks, vectors = state(importer)
    assert {k: v[:2] for k, v in docs.items()} == {"a.txt": ("imported", "LDR-100"), "b.md": ("imported", "LDR-200")} and chunks == vectors and len(chunks) == 2
    assert {r.status for r in importer.read("jobs").collect()} == {"completed_with_errors"} and importer.read("events").count() == 4

    put("a.txt", "Model: LDR-101")
    (root / "b.md").rename(root / "moved.md")
    put("copy.txt", "Model: LDR-300")
    put("blank.txt", "Model: LDR-400")
    importer.run(str(root), "j2")
    after, chunks, vectors = state(importer)
    assert {k: v[:2] for k, v in after.items()} == {"a.txt": ("imported", "LDR-101"), "moved.md": ("imported", "LDR-200"), "copy.txt": ("imported", "LDR-300"), "blank.txt": ("imported", "LDR-400")}
    assert chunks == vectors and {d for d, _ in chunks} == {v[2] for v in after.values()}

    put("again.txt", "Model: LDR-300")
    (root / "moved.md").unlink()
    put("a.txt", " ")
    report = importer.run(str(root), "j3").first()
    last, chunks, vectors = state(importer)
    assert "moved.md" not in last and last["again.txt"][1] == "LDR-300" and last["a.txt"] == after["a.txt"] and chunks == vectors
    assert {r.filename: json.loads(r.metadata_json).get("reused_from_document_id") for r in importer.read("documents").collect()}["again.txt"] == after["copy.txt"][2]
    assert {r.job_id: r.deleted for r in importer.read("jobs").collect()}["j3"] == 1
    assert progress.import_active(importer.read("jobs")).first().active is False
    importer.store.sweep()
    assert state(importer)[1] == chunks


def test_a_run_that_breaks_off_is_resumed(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("Model: LDR-100")

    class Late(progress.Stop):
        """Asks for a stop after the documents were published."""

        checks = 0

        def check(self):
            self.checks += 1
            self.asked = self.checks == 3
            super().check()

    importer = Importer(spark, Store(spark, str(tmp_path / "store")), lambda t: embed(t, 8))
    importer.run(str(root), "j1", Late(spark, "j1"))
    docs, chunks, vectors = state(importer)
    assert docs["a.txt"][0] == "indexing" and len(chunks) == 1 and not vectors
    assert importer.read("jobs").first().status == "interrupted"
    assert [r.action for r in importer.plan(importer.store.staged(files.scan(spark, str(root)))).collect()] == ["resume"]
    importer.run(str(root), "j1")
    docs, again, vectors = state(importer)
    assert docs["a.txt"][0] == "imported" and again == chunks == vectors
    assert importer.read("jobs").first().status == "completed"


def test_wire_client():
    sent = []

    def send(url, headers, body):
        sent.append((url, json.loads(body)))
        if url.endswith("responses"):
            return iter([b"event: x\n", b'data: {"type":"response.output_text.delta","delta":"a"}\n', b'data: {"type":"done"}\n', b"data: [DONE]\n"])
        return iter([b'data: {"choices":[{"delta":{"content":"b"}}]}\n', b'data: {"choices":[{"delta":{}}]}\n'])

    messages = [{"role": "system", "content": "rules"}, {"role": "user", "content": "q"}]
    assert list(WireClient("http://h/v1", "k", "m", "responses", send=send).chat(messages)) == ["a"]
    assert list(WireClient("http://h/v1/", "k", "m", send=send).chat(messages)) == ["b"]
    assert sent[0][1]["instructions"] == "rules" and sent[0][1]["input"] == "user: q" and sent[1][0] == "http://h/v1/chat/completions"
    whole = WireClient("http://h", "k", "m", "responses", stream=False, send=lambda *a: iter([b'{"output":[{"content":[{"text":"x"}]}]}']))
    assert list(whole.chat(messages)) == ["x"]
    for client, text in ((WireClient("", "", "m", provider="crs"), "CRS API key"), (WireClient("http://h", "k", "m", send=lambda *a: iter([b"data: no\n"])), "MODEL LLM call failed")):
        try:
            list(client.chat(messages))
            raise AssertionError
        except RuntimeError as error:
            assert text in str(error)


def test_answers_tell_of_failures_and_silence(spark):
    rows = spark.createDataFrame([(1, "doc", None, "c", "text")], "rank int, source string, page_number int, chunk_id string, content string")

    class Silent:
        def chat(self, messages):
            yield ""

    class Broken:
        def chat(self, messages):
            raise RuntimeError("connection lost")
            yield

    assert answers.answer("q", rows, Silent()) == answers.EMPTY
    told = answers.answer("q", rows, Broken())
    assert told.startswith("\n\n服务器连接或响应失败：connection lost") and told.endswith(answers.CHECK_SOURCES)
    assert answers.answer("q", rows.where(F.lit(False)), Silent()) == answers.NO_EVIDENCE
