"""The index of chunks, images, PDF lines, settings, and rows of the literal tables as they must be, written by hand."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner import queries as engine
from gleaner.operators import figures, rubric, segment
from gleaner.plans import index, report, retrieve
from gleaner.plans.settings import Settings
from gleaner.queries.literals import frame
from gleaner.sources import docx, images, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in engine.queries()[name](spark, "").collect())


def test_rows_by_hand(spark):
    assert rows(spark, "heading_detect", "id", "is_heading") == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, True), (7, True), (8, False), (9, False), (10, True), (11, True), (12, False)]
    assert [n for _, n in rows(spark, "section_number", "id", "number")] == ["1", "2.1", "3", "4", None, None, None, None, None, None, None, None]
    assert rows(spark, "extract_grade", "criterion", "grade", "strict_grade") == [
        ("B1", "MERIT", "MERIT"), ("B2", "UNKNOWN", "PASS"), ("K1", "MERIT", "MERIT"), ("K2", "PASS", "PASS"), ("S1", "REFERRAL", "PASS"), ("S2", "REFERRAL", "REFERRAL"),
    ]
    assert rows(spark, "module_criteria", "module", "n_criteria", "codes") == [("DATA", 1, "K7"), ("NONE", 0, None), ("OPS", 3, "K1,S12,B3")]
    assert rows(spark, "document_titles", "doc_id", "title") == [(1, "Annual Service Review"), (2, "Given title")]
    assert rows(spark, "criteria_chunk_names", "doc_id", "chunk_index", "criterion_id") == [("DATA", i, "general") for i in range(3)] + [("OPS", i, "general") for i in range(6)]
    assert rows(spark, "custom_settings", "id", "name") == [(0, "BALANCED"), (1, "CUSTOM"), (2, "SEMANTIC_ONLY"), (3, "CUSTOM"), (4, "invalid"), (5, "invalid"), (6, "invalid"), (7, "invalid")]
    assert rows(spark, "figure_relevance", "query_id", "doc_id", "figure_id", "score") == [(1, 1, "figure_1", 9), (1, 1, "figure_2", 9)]


def test_index_is_built_cleared_searched_and_fetched_from(spark, tmp_path):
    lines = [(1, 0, "1. Storage Plans", "heading", "1", 1), (1, 1, "backup disks and tapes hold records, see Figure 2", "text", "", None), (1, 2, "2. Garden Work", "heading", "2", 1), (1, 3, "roses tulips and spades", "text", "", None)]
    blocks = spark.createDataFrame(lines, "doc_id long, block_idx int, content string, block_type string, section_number string, heading_level int")
    chunks = index.report_chunks(blocks)
    path = f"file://{tmp_path}/store"
    index.build(chunks, path)
    kept = store.read_chunks(spark, path)
    got = {r["chunk_id"]: r for r in kept.collect()}
    assert set(got) == {"1_chunk_0", "1_chunk_1"}
    assert got["1_chunk_0"]["section_title"] == "1. Storage Plans" and got["1_chunk_0"]["has_figure_reference"] and not got["1_chunk_1"]["has_figure_reference"] and "garden" in got["1_chunk_1"]["keywords"].split(",")
    found = index.search_words(kept, ["roses", "tulips", "spades", "and", "garden", "work"], 1).first()
    assert found["chunk_id"] == "1_chunk_1"
    ids = spark.createDataFrame([("1_chunk_1", 1), ("gone", 2)], "chunk_id string, rank int")
    assert [(r["chunk_id"], r["rank"], r["section_number"]) for r in index.fetch(kept, ids).collect()] == [("1_chunk_1", 1, "2")]
    assert index.search(kept, spark.createDataFrame([(7, "tapes")], "query_id long, text string"), 5, section="2. Garden Work").count() == 1
    assert index.structure(kept) == "Report sections: 1. Storage Plans, 2. Garden Work"
    index.clear(spark, path, "report")
    assert not (tmp_path / "store/chunks/document_type=report").exists()


class PixMap:
    """A codec for one-line maps of grey values: P2 width height."""

    def shrink(self, data, most, formats):
        kind, width, height = data.decode().split()
        if kind != "P2":
            raise ValueError(kind)
        w, h = int(width), int(height)
        scale = min(1.0, most[0] / w, most[1] / h)
        return data, "png", int(w * scale), int(h * scale)


def test_images_are_shrunk_and_damaged_ones_dropped(spark):
    raw = spark.createDataFrame([(1, "figure_1", b"P2 2048 512"), (1, "figure_2", b"broken"), (1, "figure_3", b"P2 10 20")], "doc_id int, figure_id string, bytes binary")
    small = images.shrunk(raw, PixMap())
    both = figures.with_images(small, figures.captions(frame(spark, "blocks")))
    assert sorted((r["figure_id"], r["width"], r["height"], r["caption"]) for r in both.collect()) == [("figure_1", 800, 200, "Figure 1: Demand by month"), ("figure_3", 10, 20, None)]


class Pages:
    def pages(self, data):
        for page in data.decode().split("\f"):
            lines = page.split("\n")
            yield lines, [[[x for x in line.split("|")] for line in lines if "|" in line]] if "|" in page else []


def test_pdf_lines_tables_and_titles_run_through(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("1. Introduction To Testing\nA first line, which goes\non here, in a second.\nx|y\nx\n\fSecond page text, all of it.")
    got = docx.read_any(spark, f"file://{tmp_path}/a.pdf", Pages())
    assert [(r["block_type"], r["content"], r["page"]) for r in got.orderBy("block_idx").collect()] == [("heading", "1. Introduction To Testing", 1), ("text", "A first line, which goes on here, in a second. x|y", 1), ("text", "Second page text, all of it.", 2)]
    assert segment.titles(got.withColumnRenamed("path", "doc_id")).first()["title"] == "1. Introduction To Testing"
    (row,) = docx.read_any(spark, f"file://{tmp_path}/a.pdf").collect()
    assert row["error"] == "no reader for .pdf" and row["content"] is None


def test_broken_word_file_is_a_row(spark, tmp_path):
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (row,) = docx.read_docx(spark, f"file://{tmp_path}").collect()
    assert row["content"] is None and "BadZipFile" in row["error"]
    (row,) = docx.read_images(spark, f"file://{tmp_path}").collect()
    assert row["bytes"] is None and "BadZipFile" in row["error"]


def test_settings_have_bounds():
    assert Settings.preset("BALANCED").change(k=9).name == "CUSTOM" and Settings.preset("BALANCED").change(k=8).name == "BALANCED"
    assert Settings.preset("BALANCED").change(semantic=0.3).keyword == 0.7
    for wrong in ({"k": 2}, {"threshold": 0.51}, {"threshold": 0.03}, {"semantic": 1.1}, {"semantic": 0.25}):
        with pytest.raises(ValueError):
            Settings.preset("BALANCED").change(**wrong)


def test_unknown_modules_and_empty_criteria(spark):
    modules = spark.createDataFrame([("OPS", "Operations")], "module string, name string")
    known = rubric.registry(modules, frame(spark, "rubric"))
    assert rubric.criteria_of(known, "ops").count() == 3
    with pytest.raises(ValueError, match="OPS"):
        rubric.criteria_of(known, "x")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    none = spark.createDataFrame([], "query_id long, text string, code string")
    found = retrieve.retrieve_all(docs, none, "alpha beta gamma", Settings.preset("BALANCED").change(threshold=0.0))
    assert {r["query_id"] for r in found.collect()} == {0}
    assert tuple(retrieve.totals(found).first())[:1] == (1,)


def test_json_cuts_the_criterions_text(spark):
    made = report.json_results(spark.createDataFrame([("K1", "t" * 40, "x" * 600)], "criterion string, title string, criterion_text string"))
    back = made.select(F.from_json("json", "title string, criterion_text string").alias("j")).first()["j"]
    assert (len(back["title"]), len(back["criterion_text"])) == (40, 500)


def test_cache_embeds_new_texts_only(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    first = spark.createDataFrame([("one two",), ("three",), ("one two",), (None,)], "t string")
    assert {r["t"] for r in retrieve.embed_cached(first, "t", path).collect()} == {"one two", "three"}
    more = spark.createDataFrame([("three",), ("four five",)], "t string")
    got = {r["t"]: r["vector"] for r in retrieve.embed_cached(more, "t", path).collect()}
    assert set(got) == {"three", "four five"} and spark.read.parquet(path).count() == 3
    again = spark.read.parquet(path)
    again.write.mode("append").parquet(path)  # as a second writer, or a task that ran twice, leaves it
    twice = [(r["t"], r["vector"]) for r in retrieve.embed_cached(more, "t", path).collect()]
    assert len(twice) == 2 and dict(twice) == got
    want = retrieve.embed_distinct(more, "t").collect()
    assert {r["t"]: r["vector"] for r in want} == got
