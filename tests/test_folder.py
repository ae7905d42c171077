"""A folder as a data source: all kinds of files, partitions by bytes, filters on the suffix."""

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from gleaner.sources import docx, folder


@pytest.fixture
def mixed(tmp_path):
    deep = tmp_path / "a.b" / "c"
    deep.mkdir(parents=True)
    (deep / "one.TXT").write_bytes(b"first\r\nsecond \xff")
    (deep / "two.md").write_text("# title\n")
    (deep / "three.docx").write_bytes(docx.packed(["a < b & c", "", " d "]))
    (deep / "bad.docx").write_text("?")
    (tmp_path / "a.b" / "four.xyz").write_text("?")
    (tmp_path / "none").write_text("")
    return tmp_path


def test_every_file_has_rows(spark, mixed):
    got = {}
    for r in folder.documents(spark, f"file://{mixed}").orderBy("path", "block_idx").collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r["error"] or r["content"])
    assert got == {"one.TXT": ["first", "second �"], "two.md": ["# title", ""], "three.docx": ["a < b & c", "d"], "bad.docx": ["BadZipFile: File is not a zip file"], "four.xyz": ["ValueError: no reader for .xyz"], "none": ["ValueError: no reader for ."]}
    one = folder.documents(spark, f"{mixed}/a.b/c/two.md")
    assert one.count() == 2 and one.first()["path"] == f"{mixed}/a.b/c/two.md"
    (mixed / "empty").mkdir()
    assert folder.documents(spark, f"{mixed}/empty").count() == 0


def test_filters_on_the_suffix_are_pushed(spark, mixed):
    rows = folder.documents(spark, str(mixed))
    assert {r["suffix"] for r in rows.filter("suffix = 'docx' AND block_idx >= 0").collect()} == {"docx"}
    assert rows.filter("suffix IN ('md', 'txt')").count() == 4
    reader = folder.FolderReader({"path": str(mixed)})
    left = list(reader.pushFilters([In(("suffix",), ("docx", "md")), GreaterThan(("block_idx",), 1), EqualTo(("suffix",), "md")]))
    assert left == [GreaterThan(("block_idx",), 1)] and [p.paths for p in reader.partitions()] == [[f"{mixed}/a.b/c/two.md"]]


def test_partitions_by_bytes(tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.txt").write_text("x" * 100)
    (tmp_path / "9z.txt").write_text("x" * 1000)
    dealt = folder.FolderReader({"path": str(tmp_path), "partitionBytes": "300"}).partitions()
    assert [len(p.paths) for p in dealt] == [3, 3, 3, 1, 1]
