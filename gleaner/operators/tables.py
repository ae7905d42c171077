"""Chunkers and the budgeted selection as table functions of SQL.

Each takes a table with PARTITION BY and ORDER BY, so that a document's rows, or a query's, come to one instance in order; Spark deals the partitions.
An instance holds no more than the chunk it is filling (report_chunks), one text (sliding_windows) or the number of tokens spent (budget_select).

    SELECT * FROM report_chunks(TABLE(blocks) PARTITION BY doc_id ORDER BY block_idx)
    SELECT * FROM sliding_windows(TABLE(documents) PARTITION BY doc_id)
    SELECT * FROM budget_select(TABLE(hits) PARTITION BY query_id ORDER BY (score DESC, doc_id), 0.2D, 8)

The rows equal those of the functions of the same names on DataFrames, with the estimate of tokens. A null content counts as empty; a table without rows
gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..functions.fixed import CONTEXT_TOKENS, CRITERIA_SIZE, LEAST_SIZE, REPORT_OVERLAP, REPORT_SIZE, TOKENS_UNKNOWN
from .segment import window_spans

#: White space as the SQL engine's expressions have it.
BLANK = re.compile("[ \t\n\x0b\f\r]+")


def estimate(text: str) -> int:
    """Words times 1.3, as token_count has it."""
    return int(sum(1 for w in BLANK.split(text) if w) * 1.3)


class ReportChunks:
    """doc_id, block_idx, content and, if there, heading_level and page. Blocks are packed until the next would exceed the size."""

    def __init__(self) -> None:
        self.held: list[tuple[str, int, int]] = []
        self.used, self.index, self.doc = 0, 0, None

    def chunk(self) -> tuple:
        content = "\n\n".join(text for text, _, _ in self.held)
        out = (self.doc, self.index, content, self.held[0][2], self.held[-1][2], estimate(content))
        self.index += 1
        return out

    def eval(self, row: Row, size: int = REPORT_SIZE, overlap: int = REPORT_OVERLAP) -> Iterator[tuple]:
        has = row.asDict()
        text = has["content"] or ""
        tokens, self.doc = estimate(text), has["doc_id"]
        if self.held and (self.used + tokens > size or has.get("heading_level") in (1, 2)):
            yield self.chunk()
            spent, first = 0, len(self.held)
            while first and spent + self.held[first - 1][1] <= overlap:
                first -= 1
                spent += self.held[first][1]
            self.held, self.used = self.held[first:], spent
        self.held.append((text, tokens, has.get("page") or 1))
        self.used += tokens

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield self.chunk()


class SlidingWindows:
    """doc_id, text. Windows of about size tokens (4 characters each), cut at good places; short ones but for a text's first are left out."""

    def eval(self, row: Row, size: int = CRITERIA_SIZE, overlap: int = 50, least: int = LEAST_SIZE) -> Iterator[tuple]:
        text, number = row["text"] or "", 0
        for start, end in window_spans(text, size, overlap):
            content = text[start:end].strip()
            if start == 0 or int(len(content.split()) * 1.3) >= least:
                yield row["doc_id"], number, start, end, content
                number += 1


class BudgetSelect:
    """query_id, doc_id, score, token_count, best first. Hits below the threshold or over what is left of the budget are skipped, until there are top_k."""

    def __init__(self) -> None:
        self.place, self.used = 0, 0

    def eval(self, row: Row, threshold: float, top_k: int, budget: int = CONTEXT_TOKENS) -> Iterator[tuple]:
        tokens = TOKENS_UNKNOWN if row["token_count"] is None else row["token_count"]
        if row["score"] is not None and row["score"] >= threshold and self.place < top_k and self.used + tokens <= budget:
            self.place, self.used = self.place + 1, self.used + tokens
            yield row["query_id"], row["doc_id"], float(row["score"]), tokens, self.place


def register(spark: SparkSession, key: str = "bigint") -> None:
    """Make the functions known to the session's SQL; key is the type of document and query ids."""
    spark.udtf.register("report_chunks", udtf(ReportChunks, returnType=f"doc_id {key}, chunk_index int, content string, page_start int, page_end int, token_count int"))
    spark.udtf.register("sliding_windows", udtf(SlidingWindows, returnType=f"doc_id {key}, window_no int, start int, end int, content string"))
    spark.udtf.register("budget_select", udtf(BudgetSelect, returnType=f"query_id {key}, doc_id {key}, score double, token_count bigint, place int"))
