"""Sequential operators over a document's blocks and lines: sections, paragraphs, chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bound_batches
from ..functions.bpe import vocabulary_count
from ..functions.fixed import CODE_FORM, CRITERIA_SIZE, LEAST_SIZE, NAMED_SECTION_FORM, NUMBERED_FORM, REPORT_MOST, REPORT_OVERLAP, REPORT_SIZE
from ..functions.text import figure_ids, is_heading, token_count


Count = Callable[[Column], Column]
#: Between the blocks of a chunk.
JOINT = "\n\n"


def line_blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, block_idx, content: the non-blank lines of each text."""
    lines = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("block_idx", "content"))
    return lines.filter(F.trim("content") != "")


def carry_section(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, block_idx, content, block_type, section_number. Adds section_title and section of the last heading."""
    upto = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("block_type") == "heading"
    return blocks.withColumn("section_title", F.last(F.when(heading, F.col("content")), True).over(upto)).withColumn("section", F.last(F.when(heading, F.col("section_number")), True).over(upto))


def section_structure(blocks: DataFrame) -> DataFrame:
    """doc_id, section_no, title, page_start, page_end: each heading and the pages of its blocks."""
    upto = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    parts = blocks.withColumn("section_no", F.sum((F.col("block_type") == "heading").cast("int")).over(upto)).filter("section_no > 0")
    return parts.groupBy("doc_id", "section_no").agg(F.min_by("content", "block_idx").alias("title"), F.min_by("page", "block_idx").alias("page_start"), F.max_by("page", "block_idx").alias("page_end"))


def page_estimates(blocks: DataFrame, chars_per_page: int = 2500) -> DataFrame:
    """Add page: from the characters of the blocks before."""
    before = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("page", (F.floor(F.coalesce(F.sum(F.length("content")).over(before), F.lit(0)) / chars_per_page) + 1).cast("int"))


def assemble_paragraphs(lines: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """lines: doc_id, page, line_no, text; cells: doc_id, page, cell. Paragraphs: doc_id, page, para_no, kind, content.

    Lines that equal a table cell of their page go; a blank line or a heading ends a paragraph, and so does a page.
    """
    if cells is not None:
        lines = lines.withColumn("_t", F.trim("text")).join(cells.select("doc_id", "page", F.trim("cell").alias("_t")).distinct(), ["doc_id", "page", "_t"], "left_anti").drop("_t")
    t = F.trim("text")
    marked = lines.withColumn("kind", F.when(t == "", "blank").when(is_heading(t), "heading").otherwise("text"))
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    breaks = (F.col("kind") != "text") | F.coalesce(F.lag("kind").over(order) != "text", F.lit(True))
    numbered = marked.withColumn("_b", breaks.cast("int"))
    numbered = numbered.withColumn("para_no", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("kind <> 'blank'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", t.alias("t")))), lambda x: x["t"]), " ")
    return numbered.groupBy("doc_id", "page", "para_no").agg(F.min("kind").alias("kind"), joined.alias("content"))


def _joined(count: Count, first: Column, last: Column) -> Column:
    """The tokens of a chunk from those of its blocks and joints, null where its text must be counted."""
    if not isinstance(count, vocabulary_count):
        return F.lit(None).cast("int")
    total = lambda blocks, field: F.aggregate(blocks, F.lit(0), lambda s, b: s + b[field])
    return total(F.slice("blocks", first + 1, last - first + 1), "tokens") + total(F.slice("blocks", first + 1, last - first), "more")


def _chunks(folded: DataFrame, extra: list[str], count: Count) -> DataFrame:
    """Ranges of blocks as chunks: content, token count and number. A document's blocks are not handed on with each of its chunks."""

    def chunk(r: Column) -> Column:
        part = F.slice("blocks", r["first"] + 1, r["last"] - r["first"] + 1)
        content = F.array_join(F.transform(part, lambda b: b["content"]), JOINT)
        page = [F.get("blocks", r["first"])["page"].alias("page_start"), F.get("blocks", r["last"])["page"].alias("page_end")]
        return F.struct(content.alias("content"), *page, *[r[c].alias(c) for c in extra], _joined(count, r["first"], r["last"]).alias("joined"))

    rows = folded.select("doc_id", F.posexplode_outer(F.transform("ranges", chunk)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")
    text = F.when(F.col("joined").isNull(), F.col("content"))
    return rows.withColumn("token_count", F.coalesce("joined", count(text))).drop("joined")


def _gather(blocks: DataFrame, count: Count, *fields: Column) -> DataFrame:
    page = F.col("page") if "page" in blocks.columns else F.lit(1).alias("page")
    gathered = lambda rows, *more: rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "content", page, *more))).alias("blocks"))
    if not isinstance(count, vocabulary_count):
        return gathered(blocks.withColumn("_tokens", count(F.col("content"))), F.col("_tokens").alias("tokens"), *fields)
    counted = gathered(blocks, *fields).withColumn("_counts", count.of_lines(F.col("blocks.content"), JOINT))
    joined = F.zip_with("blocks", "_counts", lambda b, c: b.withField("tokens", c["tokens"]).withField("more", c["more"]))
    return counted.select("doc_id", joined.alias("blocks"))


def _major() -> Column:
    return F.coalesce(F.col("heading_level").between(1, 2), F.lit(False)).alias("major")


def _packed(docs: DataFrame, size: int, overlap: int, most: int) -> DataFrame:
    """Add ranges of blocks: first, last, and the first that is not an overlap with the chunk before."""
    start = F.expr("named_struct('ranges', cast(array() AS array<struct<first:int,last:int,fresh:int>>), 'a', 0, 'used', 0, 'fresh', 0)")

    def back(a: Column, i: Column) -> Column:
        before = F.reverse(F.transform(F.slice("blocks", a + 1, i - a), lambda b: b["tokens"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("t"), F.lit(True).alias("go"))
        return F.aggregate(before, zero, lambda s, t: F.when(s["go"] & (s["t"] + t <= overlap), F.struct((s["n"] + 1).alias("n"), (s["t"] + t).alias("t"), F.lit(True).alias("go"))).otherwise(F.struct(s["n"].alias("n"), s["t"].alias("t"), F.lit(False).alias("go"))))

    def step(s: Column, i: Column) -> Column:
        block = F.get("blocks", i)
        split = (i > 0) & ((s["used"] + block["tokens"] > min(size, most)) | block["major"])
        kept = back(s["a"], i)
        cut = F.struct(F.concat(s["ranges"], F.array(F.struct(s["a"].alias("first"), (i - 1).alias("last"), s["fresh"].alias("fresh")))).alias("ranges"), (i - kept["n"]).alias("a"), (kept["t"] + block["tokens"]).alias("used"), i.alias("fresh"))
        return F.when(split, cut).otherwise(F.struct(s["ranges"].alias("ranges"), s["a"].alias("a"), (s["used"] + block["tokens"]).alias("used"), s["fresh"].alias("fresh")))

    def close(s: Column) -> Column:
        return F.concat(s["ranges"], F.array(F.struct(s["a"].alias("first"), (F.size("blocks") - 1).alias("last"), s["fresh"].alias("fresh"))))

    return docs.withColumn("ranges", F.aggregate(F.sequence(F.lit(0), F.size("blocks") - 1), start, step, close))


def report_chunks(blocks: DataFrame, size: int = REPORT_SIZE, overlap: int = REPORT_OVERLAP, most: int = REPORT_MOST, count: Count = token_count) -> DataFrame:
    """blocks: doc_id, block_idx, content, heading_level. Chunks: doc_id, chunk_index, content, pages, token_count.

    count gives the tokens of a text: an estimate by its words, or vocabulary_count's.

    Blocks are packed until the next would exceed the size; a heading of level 1 or 2 starts a chunk. A new chunk starts
    with the trailing blocks that fit in the overlap. Chunks are ranges of blocks, so the fold keeps positions alone.
    """
    return _chunks(_packed(_gather(blocks, count, _major()), size, overlap, most), [], count)


def report_records(blocks: DataFrame, size: int = REPORT_SIZE, overlap: int = REPORT_OVERLAP, most: int = REPORT_MOST, count: Count = token_count) -> DataFrame:
    """blocks as for report_chunks, with block_type and section_number. Chunks with what the store keeps of them.

    section_title and section_number are those in force at the chunk's end, parent_section the last heading of level 1 or 2 up
    to the block that ended the chunk. Its figures are those of the blocks from its first new one to the block that
    ended it, and its pages go from that first new block to its last. Keywords are the chunk's most frequent words.
    """
    upto = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    heading = (F.col("block_type") == "heading") | F.col("heading_level").isNotNull()
    state = {
        "title": F.when(heading, F.col("content")),
        "number": F.when(heading, F.nullif("section_number", F.lit(""))),
        "parent": F.when(F.coalesce(F.col("heading_level").between(1, 2), F.lit(False)), F.substring("content", 1, 100)),
    }
    carried = blocks.select("*", *[F.last(c, True).over(upto).alias(f"_{n}") for n, c in state.items()])
    fields = [F.col(f"_{n}").alias(n) for n in state]
    folded = _packed(_gather(carried, count, _major(), figure_ids(F.col("content")).alias("figures"), *fields), size, overlap, most)
    rows = folded.select("doc_id", "blocks", F.posexplode("ranges").alias("chunk_index", "r"))
    block = lambda i: F.get(F.col("blocks"), i)
    first, last, fresh = (F.col(f"r.{c}") for c in ("first", "last", "fresh"))
    end = F.least(last + 1, F.size("blocks") - 1)
    some = lambda a, b: F.slice("blocks", a + 1, b - a + 1)
    figures = F.flatten(F.transform(some(fresh, end), lambda b: b["figures"]))
    out = rows.select(
        "doc_id", "chunk_index", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.lit("report").alias("document_type"),
        F.array_join(F.transform(some(first, last), lambda b: b["content"]), "\n\n").alias("content"), block(fresh)["page"].alias("page_start"), block(last)["page"].alias("page_end"),
        block(last)["title"].alias("section_title"), block(last)["number"].alias("section_number"), block(end)["parent"].alias("parent_section"), figures.alias("figure_ids"),
    )
    return out.withColumn("has_figure_reference", F.size("figure_ids") > 0).withColumn("token_count", count(F.col("content")))


def record_stats(records: DataFrame) -> DataFrame:
    """records: chunk_id, document_type, token_count, has_figure_reference, keywords. One row: number, sizes, chunks with figures and with keywords, and
    the first one's type; without records the number is 0 and the sizes are null."""
    return records.agg(
        F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"), F.round(F.avg("token_count"), 6).alias("avg_tokens"), F.min("token_count").alias("least"), F.max("token_count").alias("most"),
        F.count_if("has_figure_reference").alias("with_figures"), F.count_if(F.size("keywords") > 0).alias("with_keywords"), F.min_by("document_type", "chunk_id").alias("first_type"),
    )


def titles(blocks: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """doc_id, title: the document's own title property (doc_id, title) if it has one, else its first heading of level 0 or 1.

    Blocks without a column heading_level come from pages: then it is the first heading on page 1.
    """
    wanted = F.col("heading_level").isin(0, 1) if "heading_level" in blocks.columns else (F.col("block_type") == "heading") & (F.col("page") == 1)
    first = blocks.groupBy("doc_id").agg(F.min_by(F.when(wanted, F.col("content")), F.when(wanted, F.col("block_idx"))).alias("title"))
    if properties is None:
        return first
    own = properties.select("doc_id", F.nullif(F.trim("title"), F.lit("")).alias("_own"))
    return first.join(own, "doc_id", "left").select("doc_id", F.coalesce("_own", "title").alias("title"))


def criterion_of(content: Column) -> tuple[Column, Column]:
    """The criterion a block names, and whether it may start a chunk (named section or two codes)."""
    codes = F.regexp_extract_all(content, F.lit(CODE_FORM), F.lit(1))
    named = F.regexp_extract(content, "(?i)" + NAMED_SECTION_FORM, 1)
    numbered = F.nullif(F.regexp_extract(content, "(?i)" + NUMBERED_FORM, 1), F.lit(""))
    by_code = F.when(F.size(codes) > 0, F.array_join(F.array_sort(F.array_distinct(codes)), ","))
    by_name = F.when(named != "", F.regexp_replace(F.regexp_replace(F.trim(named), ":+$", ""), "-+$", ""))
    return F.coalesce(by_code, by_name, numbered), (named != "") | (F.size(codes) >= 2)


def criteria_chunks(blocks: DataFrame, size: int = CRITERIA_SIZE, count: Count = token_count) -> DataFrame:
    """blocks: doc_id, block_idx, content. Chunks: doc_id, chunk_index, content, pages, criterion_id, token_count."""
    name, strong = criterion_of(F.col("content"))
    docs = _gather(blocks, count, name.alias("name"), strong.alias("strong"))
    start = F.expr("named_struct('ranges', cast(array() AS array<struct<first:int,last:int,criterion_id:string>>), 'a', 0, 'used', 0, 'name', cast(null AS string))")

    def range_(s: Column, last: Column) -> Column:
        return F.concat(s["ranges"], F.array(F.struct(s["a"].alias("first"), last.alias("last"), F.coalesce(s["name"], F.lit("general")).alias("criterion_id"))))

    def step(s: Column, i: Column) -> Column:
        block = F.get("blocks", i)
        fresh = block["name"].isNotNull() & block["strong"] & ~block["name"].eqNullSafe(s["name"])
        split = (i > 0) & (fresh | (s["used"] + block["tokens"] > size))
        named = F.when(fresh, block["name"]).otherwise(s["name"])
        cut = F.struct(range_(s, i - 1).alias("ranges"), i.alias("a"), block["tokens"].alias("used"), named.alias("name"))
        return F.when(split, cut).otherwise(F.struct(s["ranges"].alias("ranges"), s["a"].alias("a"), (s["used"] + block["tokens"]).alias("used"), named.alias("name")))

    folded = docs.withColumn("ranges", F.aggregate(F.sequence(F.lit(0), F.size("blocks") - 1), start, step, lambda s: range_(s, F.size("blocks") - 1)))
    return _chunks(folded, ["criterion_id"], count)


def best_splits(text: Column, targets: Column, window: int = 200) -> Column:
    """Where to cut near each target (characters from 0): after a blank line, line, sentence or clause end, closer ones first.

    A text is walked through once for all its targets. Targets of a null text stay.
    """

    def found(texts: pd.Series, asked: pd.Series) -> pd.Series:
        cuts = [None if t is None else Cuts(t) for t in texts]
        return pd.Series([None if a is None else [int(t) if c is None else c.near(int(t), window) for t in a] for c, a in zip(cuts, asked, strict=True)])

    bound_batches()
    return F.pandas_udf(found, "array<int>")(text, targets.cast("array<int>"))


#: Places where a text may be cut, found together with what follows them, and their worth: blank line, line, sentence, clause.
PLACES = re.compile(r"(?=(\n\n)|(\n)|([.!?] )|([,;:] ))")
WORTH = np.array([0.0, 100.0, 50.0, 30.0, 10.0])


class Cuts:
    """All places of a text with their worth, in order; a cut near a target is looked up among them."""

    def __init__(self, text: str) -> None:
        found = [(m.start(), m.lastindex) for m in PLACES.finditer(text)]
        self.at, kinds = np.array(found, np.int64).reshape(-1, 2).T
        self.worth, self.length = WORTH[kinds], len(text)

    def near(self, target: int, reach: int) -> int:
        """Behind the place within reach that is worth most, less 20 at the far end of the reach; the target if none is worth anything."""
        i, j = np.searchsorted(self.at, [target - reach, min(self.length, target + reach)])
        value = self.worth[i:j] - np.abs(self.at[i:j] - target) * (20 / reach)
        top = int(value.argmax()) if j > i else 0
        return int(self.at[i + top]) + 1 if j > i and value[top] > 0 else target


def window_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of the windows of a text: each ends at a cut near its full length and the next starts at one before that end."""
    cuts, begin, end = Cuts(text), 0, 0
    while end < len(text):
        full = begin + 4 * size
        end = max(begin + 1, cuts.near(full, 200)) if full < len(text) else len(text)
        yield begin, end
        again = cuts.near(end - 4 * overlap, 100)
        begin = again if again > begin else end


def sliding_windows(docs: DataFrame, size: int = CRITERIA_SIZE, overlap: int = 50, least: int = LEAST_SIZE) -> DataFrame:
    """doc_id, window_no, start, end, content: windows of about size tokens (4 characters each) cut at good places.

    Windows of fewer than `least` tokens are left out, but for a text's first. Each start depends on the cut before, so a
    text is walked through in order; texts travel in Arrow batches.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"].fillna(""), strict=True):
                windows = [(a, b, text[a:b].strip()) for a, b in window_spans(text, size, overlap)]
                kept = [w for w in windows if w[0] == 0 or int(len(w[2].split()) * 1.3) >= least]
                rows += [(doc, i, *w) for i, w in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["doc_id", "window_no", "start", "end", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, window_no int, start int, end int, content string")
