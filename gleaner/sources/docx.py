"""Word documents as blocks, with the standard library alone."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import Protocol
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.segment import assemble_paragraphs

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def text_of(element: ElementTree.Element) -> str:
    return "".join(e.text or "" if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" else "\n" if e.tag == f"{W}br" else "" for e in element.iter())


def styles(archive: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("word/styles.xml"))
    return {s.get(f"{W}styleId", ""): name.get(f"{W}val", "") for s in root.iter(f"{W}style") if (name := s.find(f"{W}name")) is not None}


def blocks(data: bytes) -> Iterator[tuple[str, str, str | None, int | None, list[list[str]] | None]]:
    """Kind (paragraph, table), content, style, outline level and cells of the body's elements, in their order."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        named = styles(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    for element in body if body is not None else []:
        if element.tag == f"{W}p":
            props = element.find(f"{W}pPr")
            style = props.find(f"{W}pStyle") if props is not None else None
            level = props.find(f"{W}outlineLvl") if props is not None else None
            key = style.get(f"{W}val", "") if style is not None else ""
            if text := text_of(element).strip():
                yield "paragraph", text, named.get(key, key) or "Normal", int(level.get(f"{W}val", "0")) if level is not None else None, None
        elif element.tag == f"{W}tbl":
            cells = [["\n".join(text_of(p) for p in c.iter(f"{W}p")).strip() for c in r.iter(f"{W}tc")] for r in element.iter(f"{W}tr")]
            yield "table", "\n".join(" | ".join(r) for r in cells), None, None, cells


def packed(lines: list[str]) -> bytes:
    """A Word document with a paragraph for each line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def images(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """Figure ids in the order of relationships, format and bytes of embedded images."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        if "word/_rels/document.xml.rels" not in names:
            return
        n = 0
        for rel in ElementTree.fromstring(archive.read("word/_rels/document.xml.rels")).iter(f"{R}Relationship"):
            target = "word/" + rel.get("Target", "")
            if "image" in rel.get("Target", "") and target in names:
                n += 1
                yield f"figure_{n}", target.rsplit(".", 1)[-1].lower(), archive.read(target)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, block_idx, block_type, content, style, outline, cells, error of all Word documents below a path.

    A file that cannot be read is one row with nothing but its path and error.
    """
    columns = ["path", "block_idx", "block_type", "content", "style", "outline", "cells", "error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list[tuple] = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(p, i, *b, None) for i, b in enumerate(blocks(data))]
                except Exception as error:  # whatever is wrong with one file is that file's row
                    rows.append((p, None, None, None, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=columns).astype({"outline": "Int32", "block_idx": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, block_idx int, block_type string, content string, style string, outline int, cells array<array<string>>, error string")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, figure_id, format, bytes, error of all images embedded in Word documents below a path.

    A file that cannot be read is one row with nothing but its path and error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list[tuple] = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(p, *x, None) for x in images(data)]
                except Exception as error:  # whatever is wrong with one file is that file's row
                    rows.append((p, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "figure_id", "format", "bytes", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, figure_id string, format string, bytes binary, error string")


class PdfDecoder(Protocol):
    """Whatever turns a PDF's bytes into pages; it is sent to the workers, so it must be picklable."""

    def pages(self, data: bytes) -> Iterator[tuple[list[str], list[list[list[str]]]]]:
        """Each page's lines and its tables (rows of cells)."""
        ...


def read_pdf_lines(spark: SparkSession, path: str, decoder: PdfDecoder) -> tuple[DataFrame, DataFrame]:
    """Lines (path, page, line_no, text, error) and table cells (path, page, cell) of all PDF files below a path; a file that cannot be read is a line with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = list(decoder.pages(data))
                except Exception as error:  # whatever is wrong with one file is that file's row
                    rows.append((p, None, None, None, False, f"{type(error).__name__}: {error}"))
                    continue
                for number, (lines, tables) in enumerate(found, 1):
                    rows += [(p, number, i, t, False, None) for i, t in enumerate(lines, 1)]
                    rows += [(p, number, 0, c, True, None) for table in tables for r in table for c in r]
            yield pd.DataFrame(rows, columns=["path", "page", "line_no", "text", "is_cell", "error"]).astype({"page": "Int32", "line_no": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path).select("path", "content")
    both = files.mapInPandas(run, "path string, page int, line_no int, text string, is_cell boolean, error string")
    return both.filter("NOT is_cell").drop("is_cell"), both.filter("is_cell").select("path", "page", F.col("text").alias("cell"))


#: Blocks of any kind of file.
BLOCK_COLUMNS = {"path": "string", "block_idx": "int", "block_type": "string", "content": "string", "style": "string", "outline": "int", "cells": "array<array<string>>", "page": "int", "error": "string"}


def read_any(spark: SparkSession, path: str, pdf: PdfDecoder | None = None) -> DataFrame:
    """Blocks (BLOCK_COLUMNS) of a file or of all files below a folder, each by its own suffix.

    Word documents give paragraphs and tables, text files their lines, PDF files paragraphs of their pages by the decoder given. A file of another kind, a PDF
    without a decoder and a file that cannot be read is one row with its path and error: no file is passed over.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    files = every.select("path").withColumn("suffix", suffix)
    kinds = {r["suffix"] for r in files.select("suffix").distinct().collect()}  # as many as there are suffixes
    known = {"docx", "txt", "md"} | ({"pdf"} if pdf is not None else set())
    refused = files.filter(~F.col("suffix").isin(sorted(known))).select("path", F.concat(F.lit("no reader for ."), "suffix").alias("error"))
    parts = [refused] if kinds - known else []
    if "docx" in kinds:
        parts.append(read_docx(spark, path))
    if kinds & {"txt", "md"}:
        text = F.make_valid_utf8(F.col("content").cast("string"))
        lines = every.filter(suffix.isin("txt", "md")).select("path", F.posexplode(F.split(text, "\r?\n")).alias("block_idx", "content"))
        parts.append(lines.withColumn("block_type", F.lit("paragraph")))
    if "pdf" in kinds & known:
        lines, cells = read_pdf_lines(spark, path, pdf)
        failed = lines.filter("error IS NOT NULL").select("path", "error")
        good = lines.filter("error IS NULL").drop("error")
        paragraphs = assemble_paragraphs(good.withColumnRenamed("path", "doc_id"), cells.withColumnRenamed("path", "doc_id"))
        order = Window.partitionBy("doc_id").orderBy("page", "para_no")
        parts += [paragraphs.select(F.col("doc_id").alias("path"), (F.row_number().over(order) - 1).alias("block_idx"), F.col("kind").alias("block_type"), "content", "page"), failed]
    out = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in BLOCK_COLUMNS.items()))
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
