"""Rubrics: markdown tables, free text, registries of modules, criteria texts and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CRITERION_LINE_FORM, DEFAULT_TEXTS, NUMBERED_FORM, WHOLE_TEXT
from ..functions.text import category, criterion_code, criterion_title, grade_section


def parse_table(texts: DataFrame, positional: bool = True) -> DataFrame:
    """texts: module, text. Criteria: module, line_no, code, title, full_description, pass_, merit_, referral_criteria, category.

    Any line with a bar may be a row, but for rules and the header. positional keeps blank cells in their columns; without it they are
    dropped, as lenient readers do, and later cells move up.
    """
    lines = texts.select("module", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    lower = F.lower("line")
    header = lower.contains("ksb") & (lower.contains("pass") | lower.contains("merit"))
    lines = lines.filter(F.col("line").contains("|") & ~F.col("line").startswith("|--") & ~F.col("line").startswith("| --") & ~header)
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    if not positional:
        cells = F.filter(cells, lambda c: c != "")
    rows = lines.withColumn("cells", cells).filter(F.size("cells") >= 4)
    first = F.get("cells", F.lit(0))
    rows = rows.withColumn("code", criterion_code(first)).filter(F.col("code").isNotNull()).withColumn("title", criterion_title(first))
    grades = [F.get("cells", F.lit(i)).alias(f"{g}_criteria") for i, g in ((1, "pass"), (2, "merit"), (3, "referral"))]
    return rows.select("module", "line_no", "code", "title", F.concat("code", F.lit(" – "), "title").alias("full_description"), *grades, category(F.col("code")).alias("category"))


def parse_text(texts: DataFrame) -> DataFrame:
    """texts: module, text. Criteria of lines `code - title`; the lines up to the next one hold the grades' texts."""
    lines = texts.select("module", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    upto = Window.partitionBy("module").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("code", F.nullif(F.regexp_extract("line", CRITERION_LINE_FORM, 1), F.lit(""))).withColumn("title", F.trim(F.regexp_extract("line", CRITERION_LINE_FORM, 2)))
    lines = lines.withColumn("part", F.count("code").over(upto)).filter("part > 0")
    body = F.array_sort(F.collect_list(F.when(F.col("code").isNull(), F.struct("line_no", "line"))))
    parts = lines.groupBy("module", "part").agg(F.max("code").alias("code"), F.max(F.when(F.col("code").isNotNull(), F.col("title"))).alias("title"), F.trim(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("content"))
    grades = {g: grade_section(F.col("content"), g) for g in ("pass", "merit", "referral")}
    for g, col in grades.items():
        parts = parts.withColumn(g, col)
    none = (F.col("pass") == "") & (F.col("merit") == "") & (F.col("referral") == "")
    whole = F.when(F.col("content") == "", WHOLE_TEXT).otherwise(F.substring("content", 1, 500))
    rest = DEFAULT_TEXTS
    found = [F.when(none, whole).otherwise(F.when(F.col(g) == "", rest[g]).otherwise(F.col(g))) if g == "pass" else F.when(F.col(g) == "", rest[g]).otherwise(F.col(g)) for g in rest]
    return parts.select("module", "part", "code", "title", *[c.alias(f"{g}_criteria") for c, g in zip(found, rest, strict=True)], category(F.col("code")).alias("category"))


def parse(texts: DataFrame) -> DataFrame:
    """texts: module, text. Criteria of texts of either kind: those with a bar and a grade's name are tables, the others free text."""
    upper = F.upper("text")
    table = F.coalesce(F.col("text").contains("|") & (upper.contains("PASS") | upper.contains("MERIT")), F.lit(False))
    columns = ["module", "code", "title", "pass_criteria", "merit_criteria", "referral_criteria", "category"]
    return parse_table(texts.filter(table), positional=False).select(*columns).unionByName(parse_text(texts.filter(~table)).select(*columns))


def by_code(criteria: DataFrame, code: str) -> DataFrame:
    return criteria.filter(F.upper("code") == code.upper())


def by_category(criteria: DataFrame, name: str) -> DataFrame:
    return criteria.filter(F.lower("category") == name.lower())


def criteria_texts(chunks: DataFrame, natural: bool = False) -> DataFrame:
    """chunks: criterion_id, chunk_index, content. criterion_id, text, place: contents joined, in the order of ids as text or naturally."""
    named = chunks.withColumn("criterion_id", F.when(F.coalesce("criterion_id", F.lit("")) == "", "general").otherwise(F.col("criterion_id")))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    texts = named.groupBy("criterion_id").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("text"))
    number = F.nullif(F.regexp_extract("criterion_id", r"(\d+)", 1), F.lit("")).cast("int")
    order = [F.regexp_replace("criterion_id", r"\d.*", ""), number, F.col("criterion_id")] if natural else [F.col("criterion_id")]
    return texts.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # criteria are few: a rubric's rows


def criteria_sections(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, block_idx, content, block_type, page. Sections that start with `criterion n`: id, title, description, descriptors, page."""
    number = F.nullif(F.regexp_extract("content", "(?i)^" + NUMBERED_FORM, 1), F.lit(""))
    upto = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    parts = blocks.withColumn("id", number).withColumn("part", F.count("id").over(upto)).filter("part > 0")
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("block_idx", "content")))), lambda x: x["content"])
    table = F.col("block_type") == "table"
    body = ordered(F.col("id").isNull() & ~table)
    return parts.groupBy("doc_id", "part").agg(
        F.max("id").alias("id"), F.max(F.when(F.col("id").isNotNull(), F.col("content"))).alias("title"), F.array_join(F.transform(body, lambda c: F.concat(F.lit("\n"), c)), "").alias("description"),
        F.array_join(ordered(F.col("id").isNull() & table), "\n").alias("descriptors"), F.min_by("page", "block_idx").alias("page"),
    )


def registry(modules: DataFrame, texts: DataFrame) -> DataFrame:
    """modules: module, name; texts: module, text (markdown rubrics). Every module with its criteria; modules without any have null ones."""
    return modules.join(parse_table(texts), "module", "left")


def criteria_of(registered: DataFrame, module: str) -> DataFrame:
    """The criteria of a module, whatever the case of its code; an unknown one is an error."""
    mine = registered.filter(F.upper("module") == module.upper())
    if mine.isEmpty():
        known = ", ".join(sorted(r["module"] for r in registered.select("module").distinct().collect()))  # a registry's modules
        raise ValueError(f"unknown module {module}; known: {known}")
    return mine.filter("code IS NOT NULL")


def query_text(code: Column, title: Column, passed: Column) -> Column:
    """What a criterion is searched by."""
    return F.concat_ws(" ", code, title, passed)
