"""Evidence as context, prompts, grade rollups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CONSOLE_INNER_WIDTH, CONSOLE_TITLE, CONSOLE_WIDTH, CRITERION_HEADING, EVALUATION_HEADING, EVIDENCE_LINE, FEEDBACK_TITLE, NO_EVIDENCE, OVERALL_HEADING
from ..functions.text import grade_of, location, relevance
from .evaluate import Client, generate
from .settings import Settings

RULE = "\n\n---\n\n"
SYSTEM = {
    "marker": "You assess work against criteria. Judge only by the evidence given and cite its pages.",
    "figure": "You describe figures and say what they show for a criterion.",
}


def system_prompt(task: str = "marker") -> str:
    return SYSTEM.get(task, SYSTEM["marker"])


def ordered_join(order: Column, text: Column, between: str) -> Column:
    """An aggregate: the group's texts joined in an order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), between)


def evidence_context(evidence: DataFrame, queries: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """evidence: query_id, place, content, pages, section_number, section_title, score; queries: query_id, n_variants. query_id, context."""
    where = location(F.col("page_start"), F.col("page_end"), F.col("section_number"), F.col("section_title"))
    block = F.concat(F.lit("Evidence "), F.col("place").cast("string"), F.lit(" ("), where, F.lit(") [Relevance: "), relevance(F.col("score")), F.lit("]:\n"), F.col("content"))
    body = evidence.groupBy("query_id").agg(ordered_join(F.col("place"), block, RULE).alias("body"))
    head = F.concat(F.lit(f"Cite only the pages and sections shown here.\n\nSearch strategy: {strategy} | Query variations used: "), F.col("n_variants").cast("string"), F.lit("\n\n"))
    return queries.join(body, "query_id", "left").select("query_id", F.when(F.col("body").isNull(), NO_EVIDENCE).otherwise(F.concat(head, F.col("body"))).alias("context"))


def evaluation_prompt(criterion: Column, evidence: Column) -> Column:
    return F.concat(F.lit("<criterion>\n"), criterion, F.lit("\n</criterion>\n<evidence>\n"), evidence, F.lit("\n</evidence>\nEnd with: Recommended Grade: PASS, MERIT or REFERRAL."))


def graded_prompt(code: Column, title: Column, passed: Column, merit: Column, referral: Column, evidence: Column) -> Column:
    levels = F.concat(F.lit("Pass: "), passed, F.lit("\nMerit: "), merit, F.lit("\nReferral: "), referral)
    return evaluation_prompt(F.concat(code, F.lit(" - "), title, F.lit("\n"), levels), evidence)


def summary_prompt(evaluations: Column) -> Column:
    return F.concat(F.lit("<evaluations>\n"), evaluations, F.lit("\n</evaluations>\nSummarise strengths, gaps and next steps."))


def extraction_prompt(criteria: Column) -> Column:
    return F.concat(F.lit("<criteria>\n"), criteria, F.lit("\n</criteria>\nList each criterion with its levels."))


def figure_prompt(caption: Column, context: Column, criterion: Column) -> Column:
    some = lambda c, d: F.when(F.coalesce(c, F.lit("")) == "", d).otherwise(c)
    return F.concat(F.lit("<caption>"), some(caption, "No caption"), F.lit("</caption>\n<context>"), F.substring(some(context, "No context"), 1, 500), F.lit("</context>\n<criterion>"), some(criterion, "General"), F.lit("</criterion>"))


def data_uri(image: Column, kind: Column) -> Column:
    """Bytes as a data URI; line breaks, which some settings put into long values, are taken out."""
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(image), r"\s", ""))


def with_grades(evaluations: DataFrame, strict: bool = False) -> DataFrame:
    """Add grade; evaluations that failed keep ERROR."""
    failed = F.col("status") == "ERROR" if "status" in evaluations.columns else F.lit(False)
    return evaluations.withColumn("grade", F.when(failed, "ERROR").otherwise(grade_of(F.col("text"), strict)))


def grade_counts(graded: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("grade") == g).alias(f"n_{g.lower()}") for g in ("MERIT", "PASS", "REFERRAL")]
    return graded.groupBy(*by).agg(F.count("*").alias("n_total"), *counts)


def evaluations_text(graded: DataFrame) -> DataFrame:
    """One row, evaluations: what every evaluation says, in the order of criteria."""
    section = F.concat(F.lit(EVALUATION_HEADING), F.col("criterion"), F.lit("\n"), F.col("text"))
    return graded.agg(ordered_join(F.col("criterion"), section, RULE).alias("evaluations"))


def overall_summary(graded: DataFrame, client: Client) -> DataFrame:
    """One row, text and status: the client's summary of all evaluations."""
    prompts = evaluations_text(graded).select(F.lit("overall").alias("criterion"), summary_prompt(F.col("evaluations")).alias("prompt"))
    return generate(prompts, client, system_prompt()).select("text", "status")


def settings_block(settings: Settings) -> str:
    mode = "Hybrid (BM25 + semantic)" if settings.hybrid else "Semantic only"
    parts = {"Mode": mode, "Semantic weight": settings.semantic, "Keyword weight": settings.keyword, "Threshold": settings.threshold, "Results": settings.k}
    return "Search settings:\n" + "\n".join(f"- {k}: {v}" for k, v in parts.items())


def markdown_report(graded: DataFrame, date: str, settings: Settings | None = None) -> DataFrame:
    """One row, report: the search settings, a table of grades and a section for each criterion, in the order of criteria."""
    title = F.when(F.length("title") > 35, F.concat(F.substring("title", 1, 35), F.lit("..."))).otherwise(F.col("title"))
    row = F.concat(F.lit("| "), F.col("criterion"), F.lit(" | "), title, F.lit(" | "), F.col("grade"), F.lit(" |"))
    section = F.concat(F.lit("## "), F.col("criterion"), F.lit(" - "), F.col("title"), F.lit("\n\n"), F.col("text"))
    parts = graded.agg(ordered_join(F.col("criterion"), row, "\n").alias("rows"), ordered_join(F.col("criterion"), section, RULE).alias("sections"))
    used = f"{settings_block(settings)}\n\n" if settings else ""
    return parts.select(F.concat(F.lit(f"# Assessment\n\nDate: {date}\n\n{used}| Criterion | Title | Grade |\n| --- | --- | --- |\n"), F.col("rows"), F.lit("\n\n"), F.col("sections"), F.lit("\n")).alias("report"))


def feedback_report(graded: DataFrame, summary: str) -> DataFrame:
    """One row, report: the overall assessment and every evaluation as Markdown, in the order of criteria."""
    section = F.concat(F.lit(f"---\n\n{CRITERION_HEADING}"), F.col("criterion"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"))
    body = graded.agg(ordered_join(F.col("criterion"), section, "").alias("body"))
    return body.select(F.concat(F.lit(f"{FEEDBACK_TITLE}\n\n{OVERALL_HEADING}\n\n{summary}\n\n"), F.col("body")).alias("report"))


def console_report(graded: DataFrame, summary: str) -> DataFrame:
    """One row, report: the same for a terminal, with the number of chunks that each evaluation read (evidence_count)."""
    lead, rule = F.lit(f"\n{CRITERION_HEADING}"), F.lit("\n" + "-" * CONSOLE_INNER_WIDTH + "\n")
    section = F.concat(lead, F.col("criterion"), F.lit(f"\n{EVIDENCE_LINE}"), F.col("evidence_count").cast("string"), rule, F.col("text"), F.lit("\n"))
    body = graded.agg(ordered_join(F.col("criterion"), section, "").alias("body"))
    thick, thin = "=" * CONSOLE_WIDTH, "-" * CONSOLE_WIDTH
    return body.select(F.concat(F.lit(f"\n{thick}\n{CONSOLE_TITLE}\n{thick}\n\n{OVERALL_HEADING}\n\n{summary}\n\n{thin}\n"), F.col("body")).alias("report"))


def json_results(graded: DataFrame, longest: int = 500) -> DataFrame:
    """criterion, json: an object for each evaluation, its criterion's text (criterion_text, where there is one) cut."""
    cut = graded.withColumn("criterion_text", F.substring("criterion_text", 1, longest)) if "criterion_text" in graded.columns else graded
    return cut.select("criterion", F.to_json(F.struct(*[F.col(c) for c in cut.columns])).alias("json"))
