"""Small tables of our own text for structure that the large tables lack; the same VALUES run on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def cell(x: object) -> str:
    if x is None:
        return "CAST(NULL AS VARCHAR(100))"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(name: str) -> str:
    columns, rows = TABLES[name]
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS {name}({', '.join(columns)})"


def frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values(name)}")


TABLES: dict[str, tuple[list[str], list[tuple]]] = {
    "asked": (
        ["query_id", "text", "code"],
        [
            (1, "Cloud storage and data pipelines for ML training", "K2"),
            (2, 'Explain the "risk register" and cost of the GPU benchmark', "K16, S19"),
            (3, "Tested with Apache Kafka on 16 GB nodes via AWS within 20 seconds", ""),
            (4, "Reflect on practice", "B5"),
            (5, "API security", "Z9"),
        ],
    ),
    "headings": (
        ["id", "line", "style", "outline"],
        [
            (1, "1. Requirements and scope", "Heading 1", 0),
            (2, "2.1 Platform selection", "Heading 2", 1),
            (3, "Part 3 - Feasibility", "heading", 0),
            (4, "Section 4: Results", "Normal", 2),
            (5, "[5] Notes follow here", "Normal", 0),
            (6, "PROJECT OVERVIEW", "Title", 0),
            (7, "Costs And Benefits", "Normal", 1),
            (8, "we measured the throughput of the new cluster, twice.", "Normal", 3),
            (9, "Don't Panic About Names", "Normal", 0),
            (10, "Pass: the work is complete", "Normal", 0),
            (11, "short", "Normal", 0),
            (12, "See Figure 3 and (Fig. 4), then see fig 5 and figure 3.", "Normal", 0),
        ],
    ),
    "blocks": (
        ["doc_id", "block_idx", "content", "block_type", "section_number", "style", "page"],
        [
            (1, 0, "Annual Service Review", "heading", "", "Title", 1),
            (1, 1, "The review covers twelve months of operation.", "paragraph", "", "Normal", 1),
            (1, 2, "1. Demand", "heading", "1", "Heading 1", 1),
            (1, 3, "Demand grew in spring, as Figure 1 shows.", "paragraph", "", "Normal", 2),
            (1, 4, "Figure 1: Demand by month", "paragraph", "", "Caption", 2),
            (1, 5, "2. Supply", "heading", "2", "Heading 1", 3),
            (1, 6, "Supply followed with a delay; (Fig. 2) compares both.", "paragraph", "", "Normal", 3),
            (1, 7, "Figure 2: Supply and demand compared", "paragraph", "", "Normal", 4),
            (2, 0, "Criterion 1 Planning", "heading", "", "Heading 2", 1),
            (2, 1, "A plan with dates and owners is shown.", "paragraph", "", "Normal", 1),
            (2, 2, "| Pass | Merit |", "table", "", "Normal", 1),
            (2, 3, "Criterion 2 Delivery", "heading", "", "Heading 2", 2),
            (2, 4, "The product was delivered.", "paragraph", "", "Normal", 2),
            (2, 5, "Users confirmed it.", "paragraph", "", "Normal", 3),
        ],
    ),
    "page_lines": (
        ["doc_id", "page", "line_no", "text"],
        [
            (1, 1, 1, "1. Introduction To Testing"),
            (1, 1, 2, "The first line of a paragraph that is long"),
            (1, 1, 3, "continues on the next line, with more words."),
            (1, 1, 4, ""),
            (1, 1, 5, "A second paragraph, which follows a blank line."),
            (1, 1, 6, "alpha"),
            (1, 1, 7, "42"),
            (1, 2, 1, "the paragraph does not cross its page, ever."),
            (1, 2, 2, "RESULTS OF THE STUDY"),
            (1, 2, 3, "numbers went up, then down."),
        ],
    ),
    "table_cells": (["doc_id", "page", "cell"], [(1, 1, "alpha"), (1, 1, " 42 "), (1, 2, "beta")]),
    "ragged": (["id", "cells"], [(1, "Name;Value/a;1/b"), (2, "One;Two;Three/x;y;z;w/;/p;q;r"), (3, "Alone")]),
    "rubric": (
        ["module", "text"],
        [
            (
                "OPS",
                "| Code | Pass | Merit | Referral |\n|---|---|---|---|\n| **K1** – Plans the work | Plan shown | Plan justified | No plan |\n| S12 - Builds the service | Runs | Runs at scale | Broken |\n"
                "| B3 – Reflects | Some reflection | | None given |\n| no code here | a | b | c |",
            ),
            ("DATA", "| Code | Pass | Merit | Referral |\n| -- | -- | -- | -- |\n| K7 – Cleans data | Clean | Very clean | Dirty |"),
        ],
    ),
    "rubric_text": (
        ["module", "text"],
        [
            ("OPS", "Preface\n**K1** – Plans the work\nPass: a plan is shown\nMerit: the plan is justified\nReferral: no plan\nS2 - Measures results\nMinimum: numbers are given\nStrong: numbers are explained"),
            ("DATA", "B9 – Learns from others\nSome free text without grades\nK3 – Names sources"),
        ],
    ),
    "evaluations": (
        ["criterion", "category", "text"],
        [
            ("K1", "Knowledge", "Recommended Grade: MERIT\nGood use of sources."),
            ("K2", "Knowledge", "Recommended Grade: **PASS**"),
            ("S1", "Skill", "**Recommended Grade:** REFERRAL"),
            ("S2", "Skill", "This criterion is not met; referral advised."),
            ("B1", "Behaviour", "Exceeds what was asked, so merit it is."),
            ("B2", "Behaviour", ""),
        ],
    ),
    "ranked": (
        ["query_id", "variant", "modality", "doc_id", "rank"],
        [(1, v, m, d, r) for v, m, ds in ((0, "semantic", (11, 12, 13)), (0, "keyword", (12, 14)), (1, "semantic", (13, 11)), (1, "keyword", (12, 11, 15))) for r, d in enumerate(ds, 1)] + [(2, 0, "semantic", 21, 1), (2, 0, "keyword", 22, 1)],
    ),
    "hits": (
        ["query_id", "doc_id", "score", "token_count"],
        [(1, 11, 0.9, 1500), (1, 12, 0.8, 1400), (1, 13, 0.7, 900), (1, 14, 0.6, 100), (1, 15, 0.1, 10), (2, 21, 0.5, 3100), (2, 22, 0.4, 2900), (2, 23, 0.35, 100), (2, 24, 0.3, 1)],
    ),
    "evidence": (
        ["query_id", "doc_id", "content", "page_start", "page_end", "section_number", "section_title", "score"],
        [(1, 11, "The plan has dates.", 2, 2, "1", "1. Plan", 0.82), (1, 12, "Owners are named.", 3, 4, "", "2.1 Owners", 0.44), (1, 13, "Nothing else was found in the appendix.", 9, 9, "", "Appendix of further material and notes for the reader", 0.12)],
    ),
}
