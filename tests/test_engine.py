"""Properties and plain-Python references of the operators that SQL checks less well."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import bm25, fusion, impacts, knn, scan, segment
from gleaner.plans import evaluate, report, retrieve
from gleaner.sources import docx, store
from gleaner.streaming import index

DATA = "/root/testdata/sf0.001"


def test_registry_has_all_queries():
    import __spark_entry__ as registry

    assert "bm25_topk" in registry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a query")], "item_id long, text string")
    assert bm25.search(docs, asked).count() == 0
    assert bm25.build_index(docs).corpus.first()["avg_len"] == 0


def test_bm25_counts_empty_texts_and_grows_with_frequency(spark):
    docs = spark.createDataFrame([(1, "cat"), (2, "cat cat"), (3, None), (4, "dog bird fish")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    rows = {r["doc_id"]: r["score"] for r in bm25.search(docs, asked).collect()}
    assert set(rows) == {1, 2} and rows[2] > 0 and rows[1] > 0
    assert bm25.build_index(docs).corpus.first()["n_docs"] == 4


def test_rrf_ignores_the_order_of_lists(spark):
    rows = [(1, d, r) for r, d in enumerate([5, 6, 7], 1)] + [(1, d, r) for r, d in enumerate([7, 5], 1)]
    a = fusion.rrf(spark.createDataFrame(rows, "query_id long, doc_id long, rank int")).collect()
    b = fusion.rrf(spark.createDataFrame(rows[::-1], "query_id long, doc_id long, rank int")).collect()
    assert {(r["doc_id"], round(r["score"], 12)) for r in a} == {(r["doc_id"], round(r["score"], 12)) for r in b}


def test_selection_skips_what_does_not_fit(spark):
    rng = random.Random(1)
    rows = [(q, d, rng.random(), rng.choice([None, 50, 900, 2000, 3100])) for q in range(20) for d in range(15)]
    got = fusion.select_budget(spark.createDataFrame(rows, "query_id long, doc_id long, score double, token_count int"), 0.2, 4)
    picked = {}
    for r in got.orderBy("query_id", "place").collect():
        picked.setdefault(r["query_id"], []).append(r["doc_id"])
    for q in range(20):
        used, want = 0, []
        for _, d, _, n in sorted((r for r in rows if r[0] == q and r[2] >= 0.2), key=lambda r: (-r[2], r[1])):
            n = 100 if n is None else n
            if len(want) < 4 and used + n <= 3000:
                used, want = used + n, [*want, d]
        assert picked.get(q, []) == want


def chunks_in_python(blocks, size=600, overlap=120):
    count = lambda t: int(len(t.split()) * 1.3)
    out, cur, used = [], [], 0
    for content, level in blocks:
        n = count(content)
        if cur and (used + n > size or level in (1, 2)):
            out.append("\n\n".join(cur))
            kept, total = [], 0
            for c in reversed(cur):
                if total + count(c) > overlap:
                    break
                kept, total = [c, *kept], total + count(c)
            cur, used = [*kept, content], total + n
        else:
            cur, used = [*cur, content], used + n
    return [*out, "\n\n".join(cur)] if cur else out


def test_report_chunks_with_headings_and_overlap(spark):
    rng = random.Random(2)
    docs = {d: [(" ".join(["word"] * rng.randint(1, 260)), rng.choice([None, None, None, 1, 3])) for _ in range(rng.randint(1, 30))] for d in range(25)}
    rows = [(d, i, c, lv) for d, bs in docs.items() for i, (c, lv) in enumerate(bs)]
    got = segment.report_chunks(spark.createDataFrame(rows, "doc_id long, block_idx int, content string, heading_level int"))
    found = {}
    for r in got.orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r["doc_id"], []).append(r["content"])
    assert found == {d: chunks_in_python(bs) for d, bs in docs.items()}


def test_criteria_chunks_follow_names(spark):
    lines = ["Intro text", "Data (K1, K2): store it well", "more on data", "Mentions K9 once", "Part 2: delivery", "done"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, block_idx int, content string")
    got = [(r["criterion_id"], r["content"].split("\n\n")) for r in segment.criteria_chunks(rows).orderBy("chunk_index").collect()]
    assert got == [("general", lines[:1]), ("K1,K2", lines[1:4]), ("Part 2", lines[4:])]


def test_sliding_windows_cover_the_text(spark):
    body = "Some words here, and more. " * 400
    rows = segment.sliding_windows(spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id long, text string")).orderBy("window_no").collect()
    assert {r["doc_id"] for r in rows} == {1}
    assert rows[0]["start"] == 0 and rows[-1]["end"] == len(body)
    assert all(a["end"] > b["start"] > a["start"] for a, b in zip(rows, rows[1:], strict=False))


def test_grades_in_both_readings(spark):
    rows = spark.createDataFrame([("**Recommended Grade:** MERIT",), ("",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(T.grade_of(F.col("t")), T.grade_of(F.col("t"), strict=True)).collect()]
    assert got == [("MERIT", "PASS"), ("UNKNOWN", "PASS"), ("UNKNOWN", "PASS")]


def test_threshold_scales(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta delta"), (3, "other words")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta", "")], "query_id long, text string, code string")
    assert retrieve.retrieve(docs, asked, "BALANCED", "raw").count() == 0
    assert {r["doc_id"] for r in retrieve.retrieve(docs, asked, "BALANCED").collect()} >= {1, 2}
    assert retrieve.retrieve(docs, asked, "SEMANTIC_ONLY").count() >= 1


def test_neighbours_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "item long, vector array<double>")
    asked = rows.selectExpr("item AS query_id", "vector")
    whole = {tuple(r) for r in knn.neighbours(rows, asked, 3).collect()}
    monkeypatch.setattr(scan, "QUERY_BYTES", 7 * 16)
    assert {tuple(r) for r in knn.neighbours(rows, asked, 3).collect()} == whole


def test_failed_calls_become_rows(spark):
    prompts = spark.createDataFrame([("K1", "fine"), ("K2", "bad one")], "criterion string, prompt string")
    graded = report.with_grades(evaluate.generate(prompts, evaluate.StubClient(fail_on="bad")))
    assert {(r["criterion"], r["status"]) for r in graded.collect()} == {("K1", "OK"), ("K2", "ERROR")}
    assert graded.filter("criterion = 'K2'").first()["grade"] == "ERROR"


def test_docx_blocks_and_images(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>1. Title</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="image" Target="media/image1.png"/></Relationships>')
        z.writestr("word/media/image1.png", b"png")
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    rows = docx.read_docx(spark, f"file://{tmp_path}").orderBy("block_idx").collect()
    assert [(r["block_type"], r["content"], r["style"]) for r in rows] == [("paragraph", "1. Title", "heading 1"), ("paragraph", "Body text", "Normal"), ("table", "a | b", None)]
    assert rows[2]["cells"] == [["a", "b"]]
    assert [(r["figure_id"], bytes(r["bytes"])) for r in docx.read_images(spark, f"file://{tmp_path}").collect()] == [("figure_1", b"png")]


def test_store_replaces_types_and_keeps_bad_rows(spark, tmp_path):
    schema = "chunk_id string, content string, document_type string"
    path = f"file://{tmp_path}/s"
    store.write_chunks(spark.createDataFrame([("a", "x", "criteria"), ("b", "y", "report"), ("", "z", "report")], schema), path)
    store.write_chunks(spark.createDataFrame([("c", "w", "report")], schema), path)
    assert {r["chunk_id"] for r in store.read_chunks(spark, path).collect()} == {"a", "c"}
    assert spark.read.parquet(f"{path}/quarantine").first()["reason"] == "no id"


def test_index_follows_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/in")
    index.follow(spark, f"file://{tmp_path}/in", docs.schema, f"file://{tmp_path}/ix", f"file://{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/ix/terms").filter("term = 'two'").first()["df"] == 2
    more = spark.createDataFrame([(3, "two four four")], "doc_id long, text string")
    more.write.mode("append").parquet(f"file://{tmp_path}/in")
    index.follow(spark, f"file://{tmp_path}/in", docs.schema, f"file://{tmp_path}/ix", f"file://{tmp_path}/cp").awaitTermination(60)
    asked = spark.createDataFrame([(1, "two four")], "item_id long, text string")
    wanted = bm25.query_terms(asked, "item_id", "text")
    got = impacts.search(index.followed(spark, f"file://{tmp_path}/ix"), wanted, 8)
    want = bm25.search(docs.union(more), asked)
    assert {tuple(r) for r in got.select("query_id", "doc_id", "score", "rank").collect()} == {tuple(r) for r in want.select("query_id", "doc_id", "score", "rank").collect()}


def naive_windows(text, size, overlap, least):
    """Windows by the definition: every position's worth is looked at for every cut."""

    def worth(pos):
        pair = text[pos : pos + 2]
        forms = [("\n\n", 100), ("\n", 50), *[(x + " ", 30) for x in ".!?"], *[(x + " ", 10) for x in ",;:"]]
        return next((w for form, w in forms if pair.startswith(form)), 0)

    def cut(target, reach):
        rated = [(worth(p) - abs(p - target) * 20 / reach, -p) for p in range(max(0, target - reach), min(len(text), target + reach))]
        score, neg = max(rated, default=(0, 0))
        return 1 - neg if score > 0 else target

    out, begin = [], 0
    while text:
        full = begin + 4 * size
        end = cut(full, 200) if full < len(text) else len(text)
        part = text[begin:end].strip()
        if begin == 0 or int(len(part.split()) * 1.3) >= least:
            out.append((begin, end, part))
        if end == len(text):
            break
        begin = max((x for x in (cut(end - 4 * overlap, 100), end) if x > begin), key=lambda x: x != end)
    return [(i, *w) for i, w in enumerate(out)]


def test_sliding_windows_by_their_definition(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60)
    odd = [(-1, ""), (-2, None), (-3, "x" * 5000), (-4, "a\n\n\nb. c, d " * 700), (-5, "word " * 900)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    for size, overlap, least in [(400, 50, 100), (120, 30, 20)]:
        got = {}
        for r in segment.sliding_windows(docs, size, overlap, least).collect():
            got.setdefault(r["doc_id"], []).append((r["window_no"], r["start"], r["end"], r["content"]))
        for r in docs.collect():
            assert sorted(got.get(r["doc_id"], [])) == naive_windows(r["text"] or "", size, overlap, least), r["doc_id"]
