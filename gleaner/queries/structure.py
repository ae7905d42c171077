"""Documents' structure, chunks, rubrics, grades, figures, context and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.bpe import vocabulary_count
from ..functions.fixed import BOUNDARY_FORMS, GRADE_FORMS, HEADING_FORMS, SECTION_FORMS
from ..operators import figures, knn, rubric, segment, tables
from ..plans import evaluate, index, report
from ..plans.settings import Settings
from ..sources import docx, folder, store
from ..sources.scratch import shared_path
from .literals import frame, values
from .retrieval import STOP, TERMS, TOKENS, Query, table, tokenizer

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


HEADING = "(?i)" + "|".join(f"(?:{p})" for p in HEADING_FORMS)


def is_heading(x: str) -> str:
    title = rf"length({x}) < 100 AND regexp_matches({x}, '\p{{L}}') AND NOT regexp_matches({x}, '(^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches({x}, '\p{{L}}\p{{Lu}}')"
    capital = rf"length({x}) < 80 AND {x} = upper({x}) AND {x} <> lower({x}) AND len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')) > 1"
    return f"(regexp_matches({x}, '{HEADING}') OR ({title}) OR ({capital}))"


SECTION = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '(?i){p}', 1), '')" for p in SECTION_FORMS) + ")"


@query(f"SELECT id, {is_heading('line')} AS is_heading, CASE WHEN length(trim(line)) < 10 THEN NULL WHEN {is_heading('trim(line)')} AND length(trim(line)) < 150 THEN 'heading' ELSE 'text' END AS kind FROM {values('headings')}")
def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that read like headings, and the kind of block they make."""
    return frame(spark, "headings").select("id", T.is_heading(F.col("line")).alias("is_heading"), T.block_kind(F.col("line")).alias("kind"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE {is_heading("line")}) AS BIGINT) AS n_headings FROM l WHERE trim(line) <> '' GROUP BY doc_id"""
)
def heading_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and headings of every document."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    counted = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).filter(F.size("lines") > 0)
    return counted.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("lines", lambda x: T.is_heading(x))).cast("long").alias("n_headings"))


@query(
    f"""SELECT id, CASE WHEN contains(lower(style), 'heading') THEN coalesce(CAST(nullif(regexp_extract(style, '(\\d+)', 1), '') AS INTEGER), 1) WHEN contains(lower(style), 'title') THEN 0 ELSE outline + 1 END AS level FROM {values("headings")}"""
)
def heading_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading levels from styles and outline levels."""
    return frame(spark, "headings").select("id", T.heading_level(F.col("style"), F.col("outline")).alias("level"))


@query(f"SELECT id, {SECTION} AS number FROM {values('headings')}")
def section_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers at the start of headings."""
    return frame(spark, "headings").select("id", T.section_number(F.col("line")).alias("number"))


@query(f"SELECT id, array_to_string(list_distinct_ordered, ',') AS figures FROM (SELECT id, list_transform(regexp_extract_all(line, '[Ff]ig(?:ure\\s+|\\.?\\s*)(\\d+)', 1), lambda n: 'figure_' || n) AS f, list_filter(f, lambda x, i: list_position(f, x) = i) AS list_distinct_ordered FROM {values('headings')})")
def figure_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that lines refer to."""
    return frame(spark, "headings").select("id", F.array_join(T.figure_ids(F.col("line")), ",").alias("figures"))


@query(f"SELECT doc_id, arg_min(content, block_idx) AS title FROM {values('blocks')} WHERE block_type = 'heading' GROUP BY doc_id")
def title_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles: the first heading."""
    heads = frame(spark, "blocks").filter("block_type = 'heading'")
    return heads.groupBy("doc_id").agg(F.min_by("content", "block_idx").alias("title"))


@query(
    f"""SELECT doc_id, block_idx, last_value(CASE WHEN block_type = 'heading' THEN content END IGNORE NULLS) OVER w AS section_title, last_value(CASE WHEN block_type = 'heading' THEN section_number END IGNORE NULLS) OVER w AS section
    FROM {values("blocks")} WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def carry_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that each block is in."""
    return segment.carry_section(frame(spark, "blocks")).select("doc_id", "block_idx", "section_title", "section")


@query(
    f"""WITH p AS (SELECT *, CAST(sum(CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS BIGINT) AS section_no FROM {values("blocks")})
    SELECT doc_id, section_no, arg_min(content, block_idx) AS title, arg_min(page, block_idx) AS page_start, arg_max(page, block_idx) AS page_end FROM p WHERE section_no > 0 GROUP BY ALL"""
)
def section_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their first and last pages."""
    return segment.section_structure(frame(spark, "blocks"))


@query(
    """WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_idx FROM documents)
    SELECT doc_id, CAST(block_idx AS INTEGER) AS block_idx, CAST(coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2500 + 1 AS INTEGER) AS page FROM b WHERE trim(content) <> ''"""
)
def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated page of every line."""
    return segment.page_estimates(segment.line_blocks(table(spark, sf_dir, "documents"))).select("doc_id", "block_idx", "page")


LINES = f"""l AS (SELECT page_lines.*, trim(text) AS t FROM {values("page_lines")} WHERE NOT EXISTS (SELECT 1 FROM {values("table_cells")} WHERE table_cells.doc_id = page_lines.doc_id AND table_cells.page = page_lines.page AND trim(cell) = trim(text)))"""


@query(f"WITH {LINES} SELECT doc_id, page, line_no, text FROM l")
def table_line_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page that no table cell repeats."""
    cells = frame(spark, "table_cells").select("doc_id", "page", F.trim("cell").alias("t"))
    lines = frame(spark, "page_lines").withColumn("t", F.trim("text"))
    return lines.join(cells, ["doc_id", "page", "t"], "left_anti").select("doc_id", "page", "line_no", "text")


@query(
    f"""WITH {LINES}, k AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN {is_heading("t")} THEN 'heading' ELSE 'text' END AS kind FROM l),
    b AS (SELECT *, CASE WHEN kind <> 'text' OR coalesce(lag(kind) OVER (PARTITION BY doc_id, page ORDER BY line_no) <> 'text', true) THEN 1 ELSE 0 END AS b FROM k),
    n AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS para_no FROM b)
    SELECT doc_id, page, CAST(para_no AS BIGINT) AS para_no, min(kind) AS kind, string_agg(t, ' ' ORDER BY line_no) AS content FROM n WHERE kind <> 'blank' GROUP BY ALL"""
)
def assemble_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and headings from a page's lines, without table lines."""
    return segment.assemble_paragraphs(frame(spark, "page_lines"), frame(spark, "table_cells"))


BLOCKS = f"""b AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, {TOKENS.format("content")} AS t FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(content) <> '')"""


@query(
    f"""WITH RECURSIVE {BLOCKS}, s AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY i) - t AS before FROM b),
    o AS (SELECT x.doc_id, x.i, x.t, x.before, coalesce(min(y.i), x.i) AS back FROM s x LEFT JOIN s y ON y.doc_id = x.doc_id AND y.i < x.i AND x.before - y.before <= 120 GROUP BY x.doc_id, x.i, x.t, x.before),
    w AS (SELECT doc_id, i, i AS a, t::BIGINT AS used, 0::BIGINT AS done_a, 0::BIGINT AS done_b FROM o WHERE i = 1
      UNION ALL SELECT o.doc_id, o.i, CASE WHEN w.used + o.t > 600 THEN greatest(w.a, o.back) ELSE w.a END,
        CASE WHEN w.used + o.t > 600 THEN o.before - (SELECT z.before FROM o z WHERE z.doc_id = o.doc_id AND z.i = greatest(w.a, o.back)) + o.t ELSE w.used + o.t END,
        CASE WHEN w.used + o.t > 600 THEN w.a ELSE 0 END, CASE WHEN w.used + o.t > 600 THEN w.i ELSE 0 END FROM w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1),
    r AS (SELECT doc_id, done_a AS a, done_b AS z FROM w WHERE done_b > 0 UNION ALL SELECT doc_id, arg_max(a, i), max(i) FROM w GROUP BY doc_id),
    c AS (SELECT r.doc_id, r.a, string_agg(content, chr(10) || chr(10) ORDER BY i) AS content, r.z FROM r JOIN b ON b.doc_id = r.doc_id AND b.i BETWEEN r.a AND r.z GROUP BY ALL)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY z) - 1 AS INTEGER) AS chunk_index, md5(content) AS content_md5, {TOKENS.format("content")} AS token_count FROM c"""
)
def pack_report_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines packed into chunks with overlap."""
    blocks = segment.line_blocks(table(spark, sf_dir, "documents")).withColumn("heading_level", F.lit(None).cast("int"))
    return segment.report_chunks(blocks).select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), "token_count")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'docx' END AS suffix, count(*) AS n_lines, md5(string_agg(regexp_replace(line, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY n)) AS lines_md5
    FROM l WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id"""
)
def folder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a file of one of three kinds, and the folder read back as a data source: its lines by file."""
    path = shared_path(spark, "folder")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            fs, root, _ = folder.opened(path)
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                suffix = ("txt", "md", "docx")[doc % 3]
                fs.create_dir(f"{root}/{doc % 100}", recursive=True)
                with fs.open_output_stream(f"{root}/{doc % 100}/{doc}.{suffix}") as file:
                    file.write(docx.packed((text or "").split("\n")) if suffix == "docx" else (text or "").encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    rows = folder.documents(spark, path)
    line = F.regexp_replace("content", r"^\s+|\s+$", "")
    lines = rows.select(F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "suffix", "block_idx", line.alias("line")).filter("line <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "line"))), lambda x: x["line"])
    return lines.groupBy("doc_id", "suffix").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(ordered, "\n")).alias("lines_md5"))


@query(SQL["pack_report_chunks"])
def chunks_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a table function of SQL."""
    tables.register(spark)
    blocks = segment.line_blocks(table(spark, sf_dir, "documents"))
    made = spark.sql("SELECT * FROM report_chunks(TABLE({blocks}) PARTITION BY doc_id ORDER BY block_idx)", blocks=blocks)
    return made.select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), "token_count")


@query()
def vocabulary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines packed into chunks whose sizes are tokens of a byte-pair vocabulary."""
    blocks = segment.line_blocks(table(spark, sf_dir, "documents")).withColumn("heading_level", F.lit(None).cast("int"))
    chunks = segment.report_chunks(blocks, count=vocabulary_count(tokenizer()))
    return chunks.select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), "token_count")


@query(
    f"""WITH RECURSIVE {BLOCKS},
    w AS (SELECT doc_id, i, i AS a, t::BIGINT AS used, 0::BIGINT AS done_a, 0::BIGINT AS done_b FROM b WHERE i = 1
      UNION ALL SELECT b.doc_id, b.i, CASE WHEN w.used + b.t > 400 THEN b.i ELSE w.a END, CASE WHEN w.used + b.t > 400 THEN b.t ELSE w.used + b.t END,
        CASE WHEN w.used + b.t > 400 THEN w.a ELSE 0 END, CASE WHEN w.used + b.t > 400 THEN w.i ELSE 0 END FROM w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1),
    r AS (SELECT doc_id, done_a AS a, done_b AS z FROM w WHERE done_b > 0 UNION ALL SELECT doc_id, arg_max(a, i), max(i) FROM w GROUP BY doc_id),
    c AS (SELECT r.doc_id, r.z, string_agg(content, chr(10) || chr(10) ORDER BY i) AS content FROM r JOIN b ON b.doc_id = r.doc_id AND b.i BETWEEN r.a AND r.z GROUP BY r.doc_id, r.a, r.z)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY z) - 1 AS INTEGER) AS chunk_index, md5(content) AS content_md5, {TOKENS.format("content")} AS token_count FROM c"""
)
def pack_criteria_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines packed as criteria text; invented prose names no criterion, so sizes alone decide."""
    blocks = segment.line_blocks(table(spark, sf_dir, "documents"))
    return segment.criteria_chunks(blocks).select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), "token_count")


@query()
def criteria_chunk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of rubric lines with the criteria they name."""
    lines = segment.line_blocks(frame(spark, "rubric_text").withColumn("doc_id", F.col("module")))
    return segment.criteria_chunks(lines, 8).select("doc_id", "chunk_index", "criterion_id", "token_count")


#: Every thousandth character of every text, at least one place.
PLACES = "SELECT doc_id, text, unnest(range(1, greatest(1, CAST(ceil(length(text) / 1000) AS BIGINT)) + 1)) AS n FROM documents"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length("text") / 1000).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(each).alias("n"))


@query(
    f"""WITH p AS (SELECT doc_id, text, least(1000 * n, length(text)) AS target FROM ({PLACES})), x AS (SELECT doc_id, text, target, unnest(range(greatest(0, target - 200), least(length(text), target + 200))) AS pos FROM p),
    y AS (SELECT doc_id, target, pos, CASE WHEN text[pos + 1:pos + 2] = chr(10) || chr(10) THEN 100.0::DOUBLE WHEN text[pos + 1] = chr(10) THEN 50.0 WHEN regexp_matches(text[pos + 1:pos + 2], '^[.!?] $') THEN 30.0 WHEN regexp_matches(text[pos + 1:pos + 2], '^[,;:] $') THEN 10.0 ELSE 0.0 END - abs(pos - target)::DOUBLE / 200 * 20 AS score FROM x)
    SELECT doc_id, CAST(target AS INTEGER) AS target, CAST(CASE WHEN max(score) > 0 THEN arg_min(pos, (-score, pos)) + 1 ELSE target END AS INTEGER) AS cut FROM y GROUP BY doc_id, target"""
)
def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place to cut each text near every thousandth character."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 1000).cast("int"))
    targets = F.transform(F.sequence(F.lit(1), n), lambda i: F.least(i * 1000, F.length("text")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", targets.alias("targets"))
    made = docs.select("doc_id", F.explode(F.arrays_zip("targets", segment.best_splits(F.col("text"), F.col("targets")).alias("cuts"))).alias("p"))
    return made.select("doc_id", F.col("p.targets").alias("target"), F.col("p.cuts").alias("cut"))


@query()
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in overlapping windows cut at good places."""
    return segment.sliding_windows(table(spark, sf_dir, "documents")).select("doc_id", "window_no", "start", "end")


NEAR = "substr(text, greatest(pos - 49, 1), least(pos, 50) + 50)"


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, substr(text, pos + 1, 2) = chr(10) || chr(10) OR regexp_matches({NEAR}, '(?im){'|'.join(BOUNDARY_FORMS)}') AS boundary FROM (SELECT doc_id, text, least(1000 * n, length(text)) - 1 AS pos FROM ({PLACES}))")
def semantic_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text may be cut before every thousandth character."""
    targets = places(spark, sf_dir).withColumn("pos", F.least(F.col("n") * 1000, F.length("text")) - 1)
    return targets.select("doc_id", "pos", T.at_boundary(F.col("text"), F.col("pos")).alias("boundary"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents), t AS (SELECT doc_id, {TOKENS.format("content")} AS n FROM l WHERE trim(content) <> '')
    SELECT count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS avg_tokens, min(n) AS least, max(n) AS most FROM t"""
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all lines."""
    n = segment.line_blocks(table(spark, sf_dir, "documents")).select(T.token_count(F.col("content")).alias("n"))
    return n.agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("avg_tokens"), F.min("n").alias("least"), F.max("n").alias("most"))


RUBRIC = f"""l AS (SELECT module, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {values("rubric")}),
k AS (SELECT module, line_no, list_transform(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|'), lambda c: trim(c)) AS cells FROM l WHERE contains(line, '|') AND trim(line) NOT LIKE '|--%' AND trim(line) NOT LIKE '| --%' AND NOT (lower(line) LIKE '%ksb%' AND (lower(line) LIKE '%pass%' OR lower(line) LIKE '%merit%'))),
c AS (SELECT module, line_no, cells, nullif(regexp_extract(cells[1], '([KSB]\\d{{1,2}})', 1), '') AS code, regexp_extract(cells[1], '[KSB]\\d{{1,2}}\\*?\\*?\\s*[–-]\\s*(.+)', 1) AS tt FROM k WHERE len(cells) >= 4),
r AS (SELECT module, CAST(line_no AS INTEGER) AS line_no, code, CASE WHEN tt <> '' THEN regexp_replace(trim(tt), '^\\*+|\\*+$', '', 'g') ELSE cells[1] END AS title, cells[2] AS pass_criteria, cells[3] AS merit_criteria, cells[4] AS referral_criteria,
  CASE code[1] WHEN 'K' THEN 'Knowledge' WHEN 'S' THEN 'Skill' WHEN 'B' THEN 'Behaviour' ELSE 'Unknown' END AS category FROM c WHERE code IS NOT NULL)"""


@query(f"WITH {RUBRIC} SELECT module, line_no, code, title, code || ' – ' || title AS full_description, pass_criteria, merit_criteria, referral_criteria, category FROM r")
def parse_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of markdown rubrics, cells in their columns."""
    return rubric.parse_table(frame(spark, "rubric"))


@query(f"WITH {RUBRIC} SELECT module, code FROM r WHERE lower(category) = 'skill' OR upper(code) = 'K7'")
def filter_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria by category and by code, whatever their case."""
    rows = rubric.parse_table(frame(spark, "rubric"))
    return rubric.by_category(rows, "SKILL").union(rubric.by_code(rows, "k7")).select("module", "code")


def grade_sql(grade: str) -> str:
    """The first form that is found, lazily up to its end words: without lookahead, the end words are matched and left out."""
    found = ", ".join(f"nullif(regexp_extract(content, '(?is){start}[:\\s]+(.+?)(?:{end}|$)', 1), '')" for start, end in GRADE_FORMS[grade])
    return f"coalesce(regexp_replace(coalesce({found}), '^\\s+|\\s+$', '', 'g'), '')"


@query(
    f"""WITH l AS (SELECT module, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {values("rubric_text")}),
    c AS (SELECT *, nullif(regexp_extract(line, '\\*?\\*?([KSB]\\d{{1,2}})\\*?\\*?\\s*[–-]\\s*(.+?)(?:\\*\\*)?$', 1), '') AS code, trim(regexp_extract(line, '\\*?\\*?([KSB]\\d{{1,2}})\\*?\\*?\\s*[–-]\\s*(.+?)(?:\\*\\*)?$', 2)) AS title FROM l),
    p AS (SELECT *, count(code) OVER (PARTITION BY module ORDER BY n) AS part FROM c),
    g AS (SELECT module, part, max(code) AS code, max(CASE WHEN code IS NOT NULL THEN title END) AS title, coalesce(trim(string_agg(CASE WHEN code IS NULL THEN line END, chr(10) ORDER BY n)), '') AS content FROM p WHERE part > 0 GROUP BY ALL),
    x AS (SELECT *, {grade_sql("pass")} AS p_, {grade_sql("merit")} AS m_, {grade_sql("referral")} AS r_ FROM g)
    SELECT module, part, code, title, CASE WHEN p_ = '' AND m_ = '' AND r_ = '' THEN CASE WHEN content = '' THEN 'See assignment brief' ELSE content END WHEN p_ = '' THEN 'Meets basic requirements' ELSE p_ END AS pass_criteria,
      CASE WHEN m_ = '' THEN 'Exceeds basic requirements with strong evidence' ELSE m_ END AS merit_criteria, CASE WHEN r_ = '' THEN 'Does not meet minimum requirements' ELSE r_ END AS referral_criteria,
      CASE code[1] WHEN 'K' THEN 'Knowledge' WHEN 'S' THEN 'Skill' WHEN 'B' THEN 'Behaviour' ELSE 'Unknown' END AS category FROM x"""
)
def parse_rubric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of free text, with the texts of their grades."""
    return rubric.parse_text(frame(spark, "rubric_text"))


@query(
    f"""SELECT doc_id, part, max(id) AS id, max(CASE WHEN id IS NOT NULL THEN content END) AS title, coalesce(string_agg(CASE WHEN id IS NULL AND block_type <> 'table' THEN chr(10) || content END, '' ORDER BY block_idx), '') AS description,
      coalesce(string_agg(CASE WHEN id IS NULL AND block_type = 'table' THEN content END, chr(10) ORDER BY block_idx), '') AS descriptors, arg_min(page, block_idx) AS page
    FROM (SELECT *, count(id) OVER (PARTITION BY doc_id ORDER BY block_idx) AS part FROM (SELECT *, nullif(regexp_extract(content, '(?i)^(?:criterion|criteria|learning\\s+outcome|LO)\\s*(\\d+)', 1), '') AS id FROM {values("blocks")})) WHERE part > 0 GROUP BY doc_id, part"""
)
def criteria_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that a numbered criterion starts."""
    return rubric.criteria_sections(frame(spark, "blocks"))


@query(
    f"""WITH t AS (SELECT CASE WHEN section_number = '' THEN 'general' ELSE section_number END AS criterion_id, doc_id * 100 + block_idx AS o, content FROM {values("blocks")}),
    g AS (SELECT criterion_id, string_agg(content, chr(10) || chr(10) ORDER BY o) AS text FROM t GROUP BY ALL) SELECT criterion_id, text, CAST(row_number() OVER (ORDER BY criterion_id) AS INTEGER) AS place FROM g"""
)
def criteria_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of criteria from their chunks."""
    chunks = frame(spark, "blocks").select(F.col("section_number").alias("criterion_id"), (F.col("doc_id") * 100 + F.col("block_idx")).alias("chunk_index"), "content")
    return rubric.criteria_texts(chunks)


GRADE = """coalesce(nullif(upper(regexp_extract(text, '(?i)Recommended Grade[:\\s*]+(PASS|MERIT|REFERRAL)', 1)), ''), CASE WHEN contains(upper(text), 'REFERRAL') AND contains(upper(text), 'NOT MET') THEN 'REFERRAL'
  WHEN contains(upper(text), 'MERIT') AND contains(upper(text), 'EXCEEDS') THEN 'MERIT' WHEN regexp_matches(upper(text), 'PASS|MERIT|REFERRAL') THEN 'PASS' ELSE 'UNKNOWN' END)"""
STRICT = """coalesce(nullif(upper(regexp_extract(text, '(?i)Recommended Grade[:\\s]+\\*?\\*?(PASS|MERIT|REFERRAL)', 1)), ''), CASE WHEN contains(upper(text), 'REFERRAL') AND contains(upper(text), 'NOT MET') THEN 'REFERRAL'
  WHEN contains(upper(text), 'MERIT') AND contains(upper(text), 'EXCEEDS') THEN 'MERIT' ELSE 'PASS' END)"""


@query(f"SELECT criterion, {GRADE} AS grade, {STRICT} AS strict_grade FROM {values('evaluations')}")
def extract_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades that evaluations recommend, in both readings."""
    return frame(spark, "evaluations").select("criterion", T.grade_of(F.col("text")).alias("grade"), T.grade_of(F.col("text"), strict=True).alias("strict_grade"))


COUNTS = "count(*) AS n_total, count(*) FILTER (WHERE grade = 'MERIT') AS n_merit, count(*) FILTER (WHERE grade = 'PASS') AS n_pass, count(*) FILTER (WHERE grade = 'REFERRAL') AS n_referral"


@query(f"SELECT {COUNTS} FROM (SELECT {GRADE} AS grade FROM {values('evaluations')})")
def grade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many evaluations have each grade."""
    return report.grade_counts(report.with_grades(frame(spark, "evaluations")))


@query(f"SELECT category, {COUNTS} FROM (SELECT category, {GRADE} AS grade FROM {values('evaluations')}) GROUP BY category")
def grade_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by category."""
    return report.grade_counts(report.with_grades(frame(spark, "evaluations")), "category")


@query("SELECT lang AS category, count(*) AS n_total, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS n_pass, count(*) FILTER (WHERE toxic = 1) AS n_referral FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def label_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as outcomes, rolled up by language."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n_total"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("n_pass"), F.count_if(F.col("toxic") == 1).alias("n_referral"))


@query(f"SELECT string_agg(DISTINCT section_title, '; ' ORDER BY section_title) AS sections, count(*) AS n_hits FROM {values('evidence')}")
def section_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that evidence comes from."""
    return frame(spark, "evidence").agg(F.array_join(F.array_sort(F.collect_set("section_title")), "; ").alias("sections"), F.count("*").alias("n_hits"))


@query("SELECT source AS document_type, count(*) AS n_chunks FROM documents GROUP BY source")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of collections."""
    return store.stats(table(spark, sf_dir, "documents").withColumnRenamed("source", "document_type"))


@query(
    f"""WITH c AS (SELECT id, list_transform(string_split(cells, '/'), lambda r: list_transform(string_split(r, ';'), lambda x: trim(x))) AS rs FROM {values("ragged")}),
    f AS (SELECT id, list_filter(rs, lambda r: len(list_filter(r, lambda x: x <> '')) > 0) AS rs FROM c),
    p AS (SELECT id, len(rs[1]) AS w, list_transform(rs, lambda r: '| ' || array_to_string(list_resize(r, len(rs[1]), ''), ' | ') || ' |') AS ls FROM f)
    SELECT id, array_to_string(list_concat([ls[1]], ['| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |'], ls[2:]), chr(10)) AS markdown FROM p"""
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged tables as markdown."""
    rows = F.transform(F.split("cells", "/"), lambda r: F.split(r, ";"))
    return frame(spark, "ragged").select("id", T.table_markdown(rows).alias("markdown"))


FIGURES = f"""cap AS (SELECT doc_id, 'figure_' || row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS figure_id, content AS caption FROM {values("blocks")} WHERE contains(lower(style), 'caption') OR (lower(content) LIKE 'figure%' AND contains(content, ':'))),
ar AS (SELECT doc_id, block_idx, content, page, lag(content) OVER w AS b, lead(content) OVER w AS a FROM {values("blocks")} WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)),
ref AS (SELECT *, unnest(list_transform(regexp_extract_all(content, '[Ff]ig(?:ure\\s+|\\.?\\s*)(\\d+)', 1), lambda n: 'figure_' || n)) AS figure_id, concat_ws(' ... ', right(b, 200), content, left(a, 200)) AS ctx FROM ar),
fig AS (SELECT cap.doc_id, figure_id, caption, arg_min(ctx, block_idx) AS context, coalesce(arg_min(page, block_idx), 1) AS page FROM cap LEFT JOIN ref USING (doc_id, figure_id) GROUP BY ALL)"""


def figure_rows(spark: SparkSession) -> DataFrame:
    blocks = frame(spark, "blocks")
    return figures.with_context(figures.captions(blocks), blocks.withColumnRenamed("block_idx", "chunk_index"))


@query(f"WITH {FIGURES} SELECT * FROM fig")
def figure_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with the text around the first reference."""
    return figure_rows(spark)


WORDS = r"list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '\s+'), lambda x: x <> ''))"


@query(
    f"""WITH {FIGURES}, s AS (SELECT query_id, doc_id, figure_id, CAST(len(list_intersect({WORDS.format("q.text")}, {WORDS.format("caption")})) * 2 + len(list_intersect({WORDS.format("q.text")}, {WORDS.format("context")})) AS INTEGER) AS score
      FROM (SELECT 1 AS query_id, 'Demand by month and supply' AS text UNION ALL SELECT 2, 'nothing shared') q, fig),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, figure_id) AS INTEGER) AS rank FROM s) SELECT query_id, doc_id, figure_id, score, rank FROM r WHERE rank <= 3 AND score > 0"""
)
def figure_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that share words with criteria."""
    asked = spark.sql("SELECT 1 AS query_id, 'Demand by month and supply' AS text UNION ALL SELECT 2, 'nothing shared'")
    return figures.relevant(figure_rows(spark), asked)


PLACE = """CASE WHEN page_start = page_end THEN 'page ' || page_start ELSE 'pages ' || page_start || '-' || page_end END"""
WHERE = f"""concat_ws(' / ', {PLACE}, CASE WHEN section_number <> '' THEN 'Section ' || section_number WHEN section_title = '' THEN NULL WHEN regexp_extract(section_title, '^(\\d+(?:\\.\\d+)*)', 1) <> '' THEN 'Section ' || regexp_extract(section_title, '^(\\d+(?:\\.\\d+)*)', 1) ELSE 'Section: ' || left(section_title, 50) END)"""
LABEL = "CASE WHEN score > 0.5 THEN 'HIGH' WHEN score > 0.3 THEN 'MEDIUM' ELSE 'LOW' END"


@query(f"SELECT doc_id, {WHERE} AS place, {LABEL} AS relevance FROM {values('evidence')}")
def evidence_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where evidence stands and how relevant it is."""
    rows = frame(spark, "evidence")
    where = T.location(F.col("page_start"), F.col("page_end"), F.col("section_number"), F.col("section_title"))
    return rows.select("doc_id", where.alias("place"), T.relevance(F.col("score")).alias("relevance"))


@query(
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS place FROM {values("evidence")}),
    b AS (SELECT query_id, string_agg('Evidence ' || place || ' (' || {WHERE} || ') [Relevance: ' || {LABEL} || ']:' || chr(10) || content, '{report.RULE}' ORDER BY place) AS body FROM e GROUP BY ALL)
    SELECT q.query_id, CASE WHEN body IS NULL THEN '{report.NO_EVIDENCE}' ELSE 'Cite only the pages and sections shown here.' || chr(10) || chr(10) || 'Search strategy: hybrid | Query variations used: ' || n_variants || chr(10) || chr(10) || body END AS context
    FROM (SELECT 1 AS query_id, 4 AS n_variants UNION ALL SELECT 2, 7) q LEFT JOIN b USING (query_id)"""
)
def evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected evidence as the context of a prompt."""
    numbered = frame(spark, "evidence").withColumn("place", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC)"))
    return report.evidence_context(numbered, spark.sql("SELECT 1 AS query_id, 4 AS n_variants UNION ALL SELECT 2, 7"))


@query(f"SELECT criterion, '<criterion>' || chr(10) || criterion || ' ' || category || chr(10) || '</criterion>' || chr(10) || '<evidence>' || chr(10) || text || chr(10) || '</evidence>' || chr(10) || 'End with: Recommended Grade: PASS, MERIT or REFERRAL.' AS prompt FROM {values('evaluations')}")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for evaluations."""
    rows = frame(spark, "evaluations")
    return rows.select("criterion", report.evaluation_prompt(F.concat_ws(" ", "criterion", "category"), F.col("text")).alias("prompt"))


@query(
    f"""WITH g AS (SELECT criterion, category || ' of the work that was handed in' AS title, text, {GRADE} AS grade FROM {values("evaluations")})
    SELECT '# Assessment' || chr(10) || chr(10) || 'Date: 2024-01-01' || chr(10) || chr(10) || '| Criterion | Title | Grade |' || chr(10) || '| --- | --- | --- |' || chr(10)
      || string_agg('| ' || criterion || ' | ' || CASE WHEN length(title) > 35 THEN left(title, 35) || '...' ELSE title END || ' | ' || grade || ' |', chr(10) ORDER BY criterion) || chr(10) || chr(10)
      || string_agg('## ' || criterion || ' - ' || title || chr(10) || chr(10) || text, '{report.RULE}' ORDER BY criterion) || chr(10) AS report FROM g"""
)
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of all evaluations."""
    rows = report.with_grades(frame(spark, "evaluations")).withColumn("title", F.concat("category", F.lit(" of the work that was handed in")))
    return report.markdown_report(rows, "2024-01-01")


PROMPT = "'<criterion>' || chr(10) || criterion || chr(10) || '</criterion>' || chr(10) || '<evidence>' || chr(10) || text || chr(10) || '</evidence>' || chr(10) || 'End with: Recommended Grade: PASS, MERIT or REFERRAL.'"


@query(f"SELECT criterion, CASE WHEN contains(p, 'S2') THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN contains(p, 'S2') THEN 'ERROR' ELSE ['PASS', 'MERIT', 'REFERRAL'][length(p) % 3 + 1] END AS grade FROM (SELECT criterion, {PROMPT} AS p FROM {values('evaluations')})")
def evaluate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations by a stand-in for a language model, one of which fails."""
    rows = frame(spark, "evaluations").withColumn("prompt", report.evaluation_prompt(F.col("criterion"), F.col("text")))
    return report.with_grades(evaluate.generate(rows, evaluate.StubClient(fail_on="S2"))).select("criterion", "status", "grade")


EVALUATIONS = f"SELECT '<evaluations>' || chr(10) || string_agg('### Criterion ' || criterion || chr(10) || text, '{report.RULE}' ORDER BY criterion) || chr(10) || '</evaluations>' || chr(10) || 'Summarise strengths, gaps and next steps.' AS p FROM {values('evaluations')}"


@query(f"SELECT 'Recommended Grade: ' || ['PASS', 'MERIT', 'REFERRAL'][length(p) % 3 + 1] AS text, 'OK' AS status FROM ({EVALUATIONS})")
def overall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in's summary of all evaluations, which depends on their whole text."""
    return report.overall_summary(frame(spark, "evaluations"), evaluate.StubClient())


@query(f"SELECT '# Coursework Feedback Report' || chr(10) || chr(10) || '## Overall Assessment' || chr(10) || chr(10) || 'Well done.' || chr(10) || chr(10) || string_agg('---' || chr(10) || chr(10) || '## Criterion ' || criterion || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY criterion) AS report FROM {values('evaluations')}")
def feedback_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evaluations as feedback in Markdown."""
    return report.feedback_report(frame(spark, "evaluations"), "Well done.")


@query(
    f"""SELECT chr(10) || repeat('=', 60) || chr(10) || 'COURSEWORK FEEDBACK' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || '## Overall Assessment' || chr(10) || chr(10) || 'Well done.' || chr(10) || chr(10) || repeat('-', 60) || chr(10)
      || string_agg(chr(10) || '## Criterion ' || criterion || chr(10) || 'Evidence chunks: 3' || chr(10) || repeat('-', 40) || chr(10) || text || chr(10), '' ORDER BY criterion) AS report FROM {values("evaluations")}"""
)
def feedback_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a terminal."""
    return report.console_report(frame(spark, "evaluations").withColumn("evidence_count", F.lit(3)), "Well done.")


@query(
    f"""WITH g AS (SELECT criterion, text, {GRADE} AS grade FROM {values("evaluations")})
    SELECT '# Assessment' || chr(10) || chr(10) || 'Date: 2024-01-01' || chr(10) || chr(10) || 'Search settings:' || chr(10) || '- Mode: Semantic only' || chr(10) || '- Semantic weight: 1.0' || chr(10) || '- Keyword weight: 0.0' || chr(10) || '- Threshold: 0.3' || chr(10) || '- Results: 6'
      || chr(10) || chr(10) || '| Criterion | Title | Grade |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || criterion || ' | Title | ' || grade || ' |', chr(10) ORDER BY criterion) || chr(10) || chr(10)
      || string_agg('## ' || criterion || ' - Title' || chr(10) || chr(10) || text, '{report.RULE}' ORDER BY criterion) || chr(10) AS report FROM g"""
)
def report_with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that says which settings its evidence was searched with."""
    rows = report.with_grades(frame(spark, "evaluations")).withColumn("title", F.lit("Title"))
    return report.markdown_report(rows, "2024-01-01", Settings.preset("SEMANTIC_ONLY"))


@query("SELECT criterion, left(repeat(category || ' ', 100), 500) AS criterion_text, length(text) AS n FROM " + values("evaluations"))
def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations as JSON objects, read back."""
    rows = frame(spark, "evaluations").withColumn("criterion_text", F.repeat(F.concat("category", F.lit(" ")), F.lit(100)))
    back = report.json_results(rows).select("criterion", F.from_json("json", "criterion_text string, text string").alias("j"))
    return back.select("criterion", "j.criterion_text", F.length("j.text").alias("n"))


@query(f"WITH {RUBRIC}, m(module, name) AS (VALUES ('OPS', 'Operations'), ('DATA', 'Data'), ('NONE', 'Without a rubric')) SELECT module, name, count(code) AS n_criteria, string_agg(code, ',' ORDER BY line_no) AS codes FROM m LEFT JOIN r USING (module) GROUP BY ALL")
def module_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered modules and their criteria."""
    modules = spark.createDataFrame([("OPS", "Operations"), ("DATA", "Data"), ("NONE", "Without a rubric")], "module string, name string")
    rows = rubric.registry(modules, frame(spark, "rubric"))
    codes = F.transform(F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("line_no", "code")))), lambda x: x["code"])
    return rows.groupBy("module", "name").agg(F.count("code").alias("n_criteria"), F.nullif(F.array_join(codes, ","), F.lit("")).alias("codes"))


@query(f"WITH {RUBRIC} SELECT module, code, concat_ws(' ', code, title, pass_criteria) AS query FROM r")
def criterion_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What criteria are searched by."""
    rows = rubric.parse_table(frame(spark, "rubric"))
    return rows.select("module", "code", rubric.query_text(F.col("code"), F.col("title"), F.col("pass_criteria")).alias("query"))


@query(f"SELECT doc_id, block_idx FROM {values('blocks')} WHERE section_number = '2'")
def criterion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one criterion."""
    return knn.filtered(frame(spark, "blocks").withColumn("criterion_id", F.col("section_number")), criterion="2").select("doc_id", "block_idx")


LEVEL = "CASE WHEN contains(lower(style), 'heading') THEN coalesce(CAST(nullif(regexp_extract(style, '(\\d+)', 1), '') AS INTEGER), 1) WHEN contains(lower(style), 'title') THEN 0 END"


@query(f"WITH b AS (SELECT *, {LEVEL} AS level FROM {values('blocks')}), t AS (SELECT doc_id, arg_min(content, block_idx) FILTER (WHERE level IN (0, 1)) AS title FROM b GROUP BY doc_id) SELECT doc_id, CASE WHEN doc_id = 2 THEN 'Given title' ELSE title END AS title FROM t")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by the document's own property, else by its first heading of the top levels."""
    blocks = frame(spark, "blocks").withColumn("heading_level", T.heading_level(F.col("style"), F.lit(None)))
    given = spark.createDataFrame([(1, " "), (2, "Given title")], "doc_id int, title string")
    return segment.titles(blocks, given)


CHUNKS = f"""RECURSIVE {BLOCKS}, s AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY i) - t AS before FROM b),
    o AS (SELECT x.doc_id, x.i, x.t, x.before, coalesce(min(y.i), x.i) AS back FROM s x LEFT JOIN s y ON y.doc_id = x.doc_id AND y.i < x.i AND x.before - y.before <= 120 GROUP BY x.doc_id, x.i, x.t, x.before),
    w AS (SELECT doc_id, i, i AS a, t::BIGINT AS used, 0::BIGINT AS done_a, 0::BIGINT AS done_b FROM o WHERE i = 1
      UNION ALL SELECT o.doc_id, o.i, CASE WHEN w.used + o.t > 600 THEN greatest(w.a, o.back) ELSE w.a END,
        CASE WHEN w.used + o.t > 600 THEN o.before - (SELECT z.before FROM o z WHERE z.doc_id = o.doc_id AND z.i = greatest(w.a, o.back)) + o.t ELSE w.used + o.t END,
        CASE WHEN w.used + o.t > 600 THEN w.a ELSE 0 END, CASE WHEN w.used + o.t > 600 THEN w.i ELSE 0 END FROM w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1),
    r AS (SELECT doc_id, done_a AS a, done_b AS z FROM w WHERE done_b > 0 UNION ALL SELECT doc_id, arg_max(a, i), max(i) FROM w GROUP BY doc_id)"""


@query(
    f"""WITH {CHUNKS}, h AS (SELECT doc_id, i, content, {is_heading("content")} AS heading, i // 10 + 1 AS page, last_value(CASE WHEN {is_heading("content")} THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS title,
      last_value(CASE WHEN {is_heading("content")} THEN {SECTION.replace("line", "content")} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS number, len(regexp_extract_all(content, '[Ff]ig(?:ure\\s+|\\.?\\s*)(\\d+)', 1)) > 0 AS figure FROM b),
    k AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY z) + 1, 1) AS fresh, row_number() OVER (PARTITION BY doc_id ORDER BY z) - 1 AS n FROM r)
    SELECT k.doc_id || '_chunk_' || k.n AS chunk_id, CAST(k.n AS INTEGER) AS chunk_index, CAST(f.page AS INTEGER) AS page_start, CAST(l.page AS INTEGER) AS page_end, md5(l.title) AS title_md5, l.number AS section_number,
      EXISTS (SELECT 1 FROM h g WHERE g.doc_id = k.doc_id AND g.i BETWEEN k.fresh AND k.z + 1 AND g.figure) AS has_figure_reference
    FROM k JOIN h f ON f.doc_id = k.doc_id AND f.i = k.fresh JOIN h l ON l.doc_id = k.doc_id AND l.i = k.z"""
)
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chunks with their sections, pages and figures; ten lines make a page here."""
    rows = segment.report_records(document_blocks(spark, sf_dir))
    return rows.select("chunk_id", "chunk_index", "page_start", "page_end", F.md5("section_title").alias("title_md5"), "section_number", "has_figure_reference")


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines as blocks; ten make a page."""
    lines = segment.line_blocks(table(spark, sf_dir, "documents"))
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    content = F.col("content")
    blocks = lines.withColumn("page", F.floor(F.row_number().over(order) / 10).cast("int") + 1).withColumn("heading_level", F.lit(None).cast("int"))
    return blocks.withColumn("block_type", F.when(T.is_heading(content), "heading").otherwise("text")).withColumn("section_number", T.section_number(content))


@query(f"SELECT chunk_id, page_start, page_end, title_md5 FROM ({SQL['chunk_records']}) WHERE page_start >= 2 AND page_end <= 4 AND NOT has_figure_reference")
def chunk_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chunks on its pages 2 to 4 that refer to no figure: filters on pages and figures, both of which must hold."""
    rows = knn.filtered(segment.report_records(document_blocks(spark, sf_dir)), has_figures=False, pages=(2, 4))
    return rows.select("chunk_id", "page_start", "page_end", F.md5("section_title").alias("title_md5"))


@query(
    f"""WITH {CHUNKS}, c AS (SELECT r.doc_id, r.z, string_agg(content, chr(10) || chr(10) ORDER BY i) AS content FROM r JOIN b ON b.doc_id = r.doc_id AND b.i BETWEEN r.a AND r.z GROUP BY r.doc_id, r.a, r.z),
    t AS (SELECT {TOKENS.format("content")} AS n, len(list_filter({TERMS.format("content")}, lambda w: regexp_matches(w, '^[a-z]{{4,}}$') AND w NOT IN ('{STOP}'))) > 0 AS words FROM c)
    SELECT count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS avg_tokens, min(n) AS least, max(n) AS most, (SELECT count(*) FROM ({SQL["chunk_records"]}) WHERE has_figure_reference) AS with_figures,
      count(*) FILTER (words) AS with_keywords, 'report' AS first_type FROM t"""
)
def record_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all documents' chunks, and how many refer to a figure or have keywords."""
    return segment.record_stats(index.report_chunks(document_blocks(spark, sf_dir)))


SOME = "CASE WHEN coalesce({0}, '') = '' THEN '{1}' ELSE {0} END"


@query(
    f"""SELECT criterion, '<criterion>' || chr(10) || criterion || ' - ' || category || chr(10) || 'Pass: p' || chr(10) || 'Merit: m' || chr(10) || 'Referral: r' || chr(10) || '</criterion>' || chr(10) || '<evidence>' || chr(10) || text || chr(10) || '</evidence>' || chr(10) || 'End with: Recommended Grade: PASS, MERIT or REFERRAL.' AS graded,
      '<criteria>' || chr(10) || text || chr(10) || '</criteria>' || chr(10) || 'List each criterion with its levels.' AS extraction,
      '<caption>' || {SOME.format("text", "No caption")} || '</caption>' || chr(10) || '<context>' || left(repeat(category, 100), 500) || '</context>' || chr(10) || '<criterion>' || criterion || '</criterion>' AS figure FROM {values("evaluations")}"""
)
def prompt_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other prompts: with levels, for criteria to be listed, and for figures."""
    p, m, r = F.lit("p"), F.lit("m"), F.lit("r")
    return frame(spark, "evaluations").select(
        "criterion", report.graded_prompt(F.col("criterion"), F.col("category"), p, m, r, F.col("text")).alias("graded"), report.extraction_prompt(F.col("text")).alias("extraction"),
        report.figure_prompt(F.col("text"), F.repeat("category", F.lit(100)), F.col("criterion")).alias("figure"),
    )


@query("SELECT page_id, md5('data:image/png;base64,' || base64(encode(html))) AS uri_md5 FROM pages")
def data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' bytes as data URIs."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(report.data_uri(F.col("html").cast("binary"), F.lit("png"))).alias("uri_md5"))
