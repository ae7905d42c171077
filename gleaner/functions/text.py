"""Scalar text functions as columns: tokens, keywords, headings, figures, tables, rubric parts, grades, locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import BOUNDARY_FORMS, CELL_CODE_FORM, CELL_TITLE_FORM, CHARS_PER_PAGE, CONCEPT_FORMS, GRADE_FORMS, HEADING_FORMS, SECTION_FORMS

BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
EMPTY_STRINGS = "cast(array() AS array<string>)"


def token_count(text: Column) -> Column:
    """Words times 1.3, rounded down."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))
    return F.floor(words * F.lit(1.3)).cast("int")


def terms(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), lambda x: x.rlike("^[a-z0-9]+$"))


def page_estimate(chars_before: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.coalesce(chars_before, F.lit(0)) / CHARS_PER_PAGE) + 1).cast("int")


def is_title_case(x: Column) -> Column:
    return x.rlike(r"\p{L}") & ~x.rlike(r"(^|[^\p{L}])\p{Ll}") & ~x.rlike(r"\p{L}\p{Lu}")


def is_upper_case(x: Column) -> Column:
    return (x == F.upper(x)) & (x != F.lower(x))


def is_heading(line: Column) -> Column:
    form = "(?i)" + "|".join(f"(?:{p})" for p in HEADING_FORMS)
    words = F.size(F.filter(F.split(line, r"\s+"), lambda x: x != ""))
    return line.rlike(form) | ((F.length(line) < 100) & is_title_case(line)) | ((F.length(line) < 80) & is_upper_case(line) & (words > 1))


def block_kind(text: Column) -> Column:
    """heading, text, or null for a block of fewer than 10 characters."""
    t = F.trim(text)
    return F.when(F.length(t) < 10, None).when(is_heading(t) & (F.length(t) < 150), "heading").otherwise("text")


def heading_level(style: Column, outline: Column) -> Column:
    s = F.lower(F.coalesce(style, F.lit("")))
    number = F.nullif(F.regexp_extract(style, r"(\d+)", 1), F.lit("")).cast("int")
    return F.when(s.contains("heading"), F.coalesce(number, F.lit(1))).when(s.contains("title"), 0).otherwise(outline.cast("int") + 1)


def section_number(heading: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(heading, "(?i)" + p, 1), F.lit("")) for p in SECTION_FORMS])


def figure_ids(text: Column) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(r"[Ff]ig(?:ure\s+|\.?\s*)(\d+)"), F.lit(1))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("figure_"), n)))


def table_markdown(rows: Column, pad: bool = True) -> Column:
    """A header line, a rule and the other rows; with pad, rows get the header's width and empty rows go."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))))
    if pad:
        clean = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
        width = F.size(F.get(clean, 0))
        clean = F.transform(clean, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width))
    lines = F.transform(clean, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(F.get(clean, 0))), " | "), F.lit(" |"))
    return F.when(F.size(clean) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 30)), "\n"))


def criterion_code(cell: Column) -> Column:
    return F.nullif(F.regexp_extract(cell, CELL_CODE_FORM, 1), F.lit(""))


def criterion_title(cell: Column) -> Column:
    """What follows the code and a dash, without asterisks at its ends; the whole cell if there is no dash."""
    title = F.regexp_extract(cell, CELL_TITLE_FORM, 1)
    return F.when(title != "", F.regexp_replace(F.trim(title), r"^\*+|\*+$", "")).otherwise(cell)


def category(code: Column) -> Column:
    first = F.substring(code, 1, 1)
    return F.when(first == "K", "Knowledge").when(first == "S", "Skill").when(first == "B", "Behaviour").otherwise("Unknown")


def grade_section(text: Column, grade: str) -> Column:
    """The text that a grade's words introduce, up to the next grade's, at most 500 characters; empty if there is none."""
    found = [F.nullif(F.regexp_extract(text, rf"(?is){start}[:\s]+(.+?)(?={end}|$)", 1), F.lit("")) for start, end in GRADE_FORMS[grade]]
    return F.coalesce(F.substring(F.trim(F.regexp_replace(F.coalesce(*found), r"^\s+|\s+$", "")), 1, 500), F.lit(""))


def key_concepts(text: Column, most: int = 5) -> Column:
    """Named technologies, acronyms and measured numbers, by pattern and then position, each once."""
    found = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.trim(x)) for p in CONCEPT_FORMS])
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) > 1)), 1, most)


def grade_of(text: Column, strict: bool = False) -> Column:
    """The grade an evaluation recommends.

    strict keeps to the plain form, takes PASS where nothing is said, and so misses a bold label; otherwise asterisks
    may stand anywhere in the label and a text without any signal is UNKNOWN.
    """
    form = r"(?i)Recommended Grade[:\s]+\*?\*?(PASS|MERIT|REFERRAL)" if strict else r"(?i)Recommended Grade[:\s*]+(PASS|MERIT|REFERRAL)"
    said = F.nullif(F.upper(F.regexp_extract(text, form, 1)), F.lit(""))
    upper = F.upper(F.coalesce(text, F.lit("")))
    guess = F.when(upper.contains("REFERRAL") & upper.contains("NOT MET"), "REFERRAL").when(upper.contains("MERIT") & upper.contains("EXCEEDS"), "MERIT")
    rest = F.lit("PASS") if strict else F.when(upper.contains("PASS") | upper.contains("MERIT") | upper.contains("REFERRAL"), "PASS").otherwise("UNKNOWN")
    return F.coalesce(said, guess, rest)


def location(page_start: Column, page_end: Column, number: Column, title: Column) -> Column:
    pages = F.when(page_start == page_end, F.concat(F.lit("page "), page_start.cast("string"))).otherwise(F.concat(F.lit("pages "), page_start.cast("string"), F.lit("-"), page_end.cast("string")))
    lead = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)", 1)
    section = (
        F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("Section "), number))
        .when(F.coalesce(title, F.lit("")) == "", None)
        .when(lead != "", F.concat(F.lit("Section "), lead))
        .otherwise(F.concat(F.lit("Section: "), F.substring(title, 1, 50)))
    )
    return F.concat_ws(" / ", pages, section)


def relevance(score: Column) -> Column:
    return F.when(score > 0.5, "HIGH").when(score > 0.3, "MEDIUM").otherwise("LOW")


def at_boundary(text: Column, position: Column) -> Column:
    """Whether a blank line starts at the position (from 0), or a boundary form lies within 50 characters of it."""
    near = F.substring(text, F.greatest(position - 49, F.lit(1)), F.least(position, F.lit(50)) + 50)
    return (F.substring(text, position + 1, F.lit(2)) == "\n\n") | near.rlike("(?im)" + "|".join(BOUNDARY_FORMS))
