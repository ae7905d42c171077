"""Cases in which results were wrong once."""

import http.server
import json
import threading
import zipfile

import numpy as np
import pytest

from gleaner.operators import bm25, figures, knn, rubric
from gleaner.plans import evaluate
from gleaner.sources import docx, store


def test_figures_of_one_name_in_two_documents(spark):
    found = spark.createDataFrame([(1, "figure_1", "Demand by month", "supply"), (2, "figure_1", "Cost by month", "demand")], "doc_id long, figure_id string, caption string, context string")
    asked = spark.createDataFrame([(7, "demand by"), (8, "cost")], "query_id long, text string")
    got = [(r["query_id"], r["doc_id"], r["figure_id"], r["score"], r["rank"]) for r in figures.relevant(found, asked).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, "figure_1", 4, 1), (7, 2, "figure_1", 3, 2), (8, 2, "figure_1", 2, 1)]


def test_queries_of_every_length_are_answered(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=2 + i % 3)]) for i in range(60)] + [(99, None), (98, [])]
    vectors = spark.createDataFrame(rows, "item long, vector array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in rows if i < 7] + [(7, [1.0] * 9), (8, None)], "query_id long, vector array<double>")
    got = {}
    for r in knn.neighbours(vectors, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["item"], r["score"]))
    assert set(got) == set(range(7))
    for q, hits in got.items():
        v = np.array(dict(rows)[q])
        want = sorted(((round(1 / (1 + ((np.array(w) - v) ** 2).sum()), 6), i) for i, w in rows if w is not None and len(w) == len(v)), key=lambda x: (-x[0], x[1]))[:4]
        assert [i for i, _ in hits] == [i for _, i in want] and [s for _, s in hits] == pytest.approx([s for s, _ in want], abs=1e-6)


def test_a_folder_of_many_kinds(spark, tmp_path):
    folder = tmp_path / "a.b" / "deep"
    folder.mkdir(parents=True)
    (folder / "one.TXT").write_bytes(b"first line\r\nsecond \xff line")
    (folder.parent / "two.md").write_text("# title\n\ntext")
    (folder / "three.xyz").write_text("?")
    (folder / "none").write_text("?")
    (folder / "four.pdf").write_text("%PDF")
    (folder / "bad.docx").write_text("?")
    with zipfile.ZipFile(folder / "five.DOCX", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body><w:p><w:r><w:t>in a document</w:t></w:r></w:p></w:body></w:document>')
    got = {}
    rows = docx.read_any(spark, f"file://{tmp_path}/a.b")
    assert rows.columns == list(docx.BLOCK_COLUMNS)
    for r in rows.orderBy("path", "block_idx").collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r["error"] or r["content"])
    assert got == {"one.TXT": ["first line", "second \ufffd line"], "two.md": ["# title", "", "text"], "three.xyz": ["no reader for .xyz"], "none": ["no reader for ."], "four.pdf": ["no reader for .pdf"], "bad.docx": ["BadZipFile: File is not a zip file"], "five.DOCX": ["in a document"]}

    class Broken:
        def pages(self, data):
            raise ValueError("not today")

    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    (row,) = docx.read_any(spark, f"file://{folder}/four.pdf", Broken()).collect()
    assert row["error"] == "ValueError: not today"


def test_the_quarantine_of_a_repeated_write(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = [("a", "text", "report"), ("", "no id", "report"), ("b", "", "criteria"), ("c", "fine", "criteria"), (None, None, "brief")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, document_type string")
    bad = lambda: sorted((r["document_type"], r["reason"]) for r in spark.read.parquet(f"{path}/quarantine").collect())
    for _ in range(2):
        store.write_chunks(chunks, path)
        assert bad() == [("brief", "no id"), ("criteria", "no content"), ("report", "no id")] and store.read_chunks(spark, path).count() == 2
    store.write_chunks(spark.createDataFrame([("", "other", "report"), ("", "no id", "report")], chunks.schema), path)
    assert bad() == [("brief", "no id"), ("criteria", "no content"), ("report", "no id"), ("report", "no id")]


def test_rubric_rows_without_a_leading_bar(spark):
    text = "KSB | Pass | Merit | Referral\n---|---|---|---\nK1 - Title | p | m | r\n| **S2** – Other | a | | c |\n| -- |\nno bar K3"
    texts = spark.createDataFrame([("M", text), ("F", "K4 - Free\npass: enough\nmerit: more"), ("N", None), ("B", "a | b")], "module string, text string")
    got = [(r["code"], r["title"], r["pass_criteria"], r["merit_criteria"], r["referral_criteria"]) for r in rubric.parse_table(texts).orderBy("line_no").collect()]
    assert got == [("K1", "Title", "p", "m", "r"), ("S2", "Other", "a", "", "c")]
    assert {(r["module"], r["code"], r["pass_criteria"]) for r in rubric.parse(texts).collect()} == {("M", "K1", "p"), ("F", "K4", "enough")}


def test_a_search_by_way_of_an_index_has_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = lambda: {tuple(r) for r in bm25.search(docs, asked, 5).select("query_id", "doc_id", "score", "rank").collect()}
    want = rows()
    monkeypatch.setattr(bm25, "QUERY_BYTES", 1000)
    assert rows() == want


class Server(http.server.BaseHTTPRequestHandler):
    answers: list = []
    asked: list = []

    def do_POST(self):
        Server.asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
        status, body = Server.answers.pop(0)
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b'{"models": [{"name": "small:7b"}]}')

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    made = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    Server.answers, Server.asked = [], []
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_answers_of_a_language_model(spark, server):
    client = evaluate.HttpClient(server, "small", retries=2, delay=0.01)
    Server.answers = [(200, '{\n  "response": "over\\nlines",\n  "done": true\n}')]
    assert client.generate("p", system="s") == "over\nlines"
    assert Server.asked[0] == ("/api/generate", {"model": "small", "prompt": "p", "stream": False, "options": {"temperature": 0.3, "num_predict": 1024}, "system": "s"})
    Server.answers = [(500, "no"), (200, '{"message": {"role": "assistant", "content": "hi"}}')]
    assert client.chat([{"role": "user", "content": "x"}]) == "hi"
    for wrong in ("[1]", "cut {", "", '{"error": "no such model"}'):
        Server.answers = [(200, wrong), (200, wrong)]
        with pytest.raises(OSError):
            client.generate("p")
    Server.answers = [(200, '{"response": "a"}\nnoise\n[2]\n{"response": "b", "done": true}\n{"response": "c"}\n')]
    assert list(client.stream("/api/generate", {"model": "small", "prompt": "p"})) == ["a", "b"] and Server.asked[-1][1]["stream"] is True
    Server.answers = [(200, '{"license": "none"}'), (404, "")]
    assert client.info() == {"license": "none"} and client.info() == {}
    assert client.available() and not evaluate.HttpClient(server, "large").available() and not evaluate.HttpClient("http://127.0.0.1:9", "small").available()
    Server.answers = [(200, '{"response": "seen"}')]
    assert client.look("what", b"image") == "seen" and Server.asked[-1][1]["images"] == ["aW1hZ2U="]
    Server.answers = [(200, '{"response": "Recommended Grade: PASS"}'), (500, "no"), (500, "no")]
    prompts = spark.createDataFrame([("K1", "one"), ("K2", "two")], "criterion string, prompt string").coalesce(1)
    assert [(r["criterion"], r["status"]) for r in evaluate.generate(prompts, client).collect()] == [("K1", "OK"), ("K2", "ERROR")]
