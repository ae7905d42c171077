"""Reciprocal rank fusion, weighted sums, score scales and selection under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CONTEXT_TOKENS, RRF_K, TOKENS_UNKNOWN


def rrf(ranked: DataFrame, keys: tuple[str, ...] = ("query_id",), item: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """ranked: keys, item, rank (from 1) of any number of lists. Returns keys, item, score."""
    return ranked.groupBy(*keys, item).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def weighted(ranked: DataFrame, semantic: float, keyword: float, item: str = "doc_id", k: int = RRF_K, digits: int = 8) -> DataFrame:
    """ranked: query_id, modality (semantic, keyword), item, rank. Returns query_id, item, score of both, weighted."""
    weight = F.when(F.col("modality") == "semantic", semantic).otherwise(keyword)
    return ranked.groupBy("query_id", item).agg(F.round(F.sum(weight / (k + F.col("rank"))), digits).alias("score"))


def normalised(scores: DataFrame, variants: str = "n_variants", k: int = RRF_K) -> DataFrame:
    """Scores on a scale from 0 to 1: the most that as many variants can give is 1."""
    return scores.withColumn("score", F.col("score") * (k + 1) / F.col(variants))


def select_budget(hits: DataFrame, threshold: float, top_k: int, budget: int = CONTEXT_TOKENS, item: str = "doc_id") -> DataFrame:
    """hits: query_id, item, score, token_count. Those selected, with their order.

    In the order of scores, items below the threshold or over what is left of the budget are skipped, until there are
    top_k. This is sequential, so it folds over each query's sorted hits; a query's hits are bounded by its top lists.
    """
    row = F.struct((-F.col("score")).alias("neg"), F.col(item).alias("item"), F.coalesce("token_count", F.lit(TOKENS_UNKNOWN)).cast("long").alias("tokens"))
    sorted_hits = hits.filter(F.col("score") >= threshold).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))
    kind = dict(hits.dtypes)[item]
    none = F.expr(f"named_struct('picked', cast(array() AS array<struct<neg:double,item:{kind},tokens:bigint>>), 'used', cast(0 AS bigint))")

    def step(state, hit):  # noqa: ANN001, ANN202
        fits = (F.size(state["picked"]) < top_k) & (state["used"] + hit["tokens"] <= budget)
        return F.when(fits, F.struct(F.concat(state["picked"], F.array(hit)).alias("picked"), (state["used"] + hit["tokens"]).alias("used"))).otherwise(state)

    folded = sorted_hits.select("query_id", F.aggregate("hits", none, step)["picked"].alias("picked"))
    picked = folded.select("query_id", F.posexplode("picked").alias("at", "hit"))
    return picked.select("query_id", F.col("hit.item").alias(item), (-F.col("hit.neg")).alias("score"), F.col("hit.tokens").alias("token_count"), (F.col("at") + 1).alias("place"))


def ranks(scored: DataFrame, keys: tuple[str, ...], item: str = "doc_id") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(item))))
