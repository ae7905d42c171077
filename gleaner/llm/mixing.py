"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated up to a limit. A document's virtual finish
time is the number of its source's tokens up to and including it, divided by the source's target. All queues are then
sorted by finish time over the whole table and cut at the total budget. A long document at the cut keeps back all that is behind it, so that
what a source then lacks is filled with its documents that fit, short ones first: no source ends below its target by more than the
shortest document that it has left.

Defined cases: a null text has size 0; documents of size 0 are returned with nothing taken; null is a source of its own
and comes last; repeated rows and repeated ids are documents of their own; an empty table gives an empty table; other
columns, of whatever names, are ignored or kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored
from .prefix import running_totals

#: A table of sources up to this many rows is broadcast; a larger one is joined by its key.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fair_targets(sources: DataFrame, budget: int, repeats: int) -> DataFrame:
    """sources: _key, source_size, weight. Adds target: shares of the budget by weight, none above repeats * source_size.

    What sources over their limit give back is shared again by weight among the others, until none is above.
    """
    sources = sources.withColumn("_limit", (F.col("source_size") * repeats).cast("double")).withColumn("_weight", F.col("weight").cast("double"))
    # the level, in tokens for a unit of weight, rises until the shares make up the budget; sources are full one after the other
    full_at = F.col("_limit") / F.col("_weight")
    rising = running_totals(sources, [full_at, F.col("source_size"), F.col("_key")], {"_full": "_limit", "_heavy": "_weight"}, "mix-levels")
    all_weight = sources.agg(F.sum("_weight")).first()[0] or 0.0
    before, open_ = F.col("_full") - F.col("_limit"), all_weight - F.col("_heavy") + F.col("_weight")
    reached = rising.filter(before + full_at * open_ >= F.lit(float(budget)))
    level = reached.agg(F.min_by((F.lit(float(budget)) - before) / open_, F.struct(full_at, "source_size", "_key"))).first()[0]
    target = F.col("_limit") if level is None else F.least(F.col("_limit"), F.col("_weight") * F.lit(max(0.0, level)))
    return sources.withColumn("target", target).drop("_limit", "_weight")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, repeats: int = 3, seed: int = 17) -> DataFrame:
    """One row for each row of docs (doc_id, source, text): doc_id, source, size, source_size, target, taken, text_hash.

    weights repeat over the sources in code point order; share is the budget as a part of all sizes; repeats limits how
    often a document may be taken. The shuffle is a seeded hash, so that reruns agree.
    """
    spark = docs.sparkSession
    sized = stored(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
        .withColumn("_uid", F.monotonically_increasing_id())
        .withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
        .withColumn("_dice", F.xxhash64("doc_id", "text_hash", F.lit(seed))),
        "mix-sizes",
    )
    n, place = sized.count(), [F.col("source").asc_nulls_last()]
    sources = sized.groupBy("_key", "source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    sources = running_totals(sources, place, {"_rank": "_one", "_end": "source_size"}, "mix-sources")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    sources = sources.select("_key", "source_size", pick.alias("weight"), (F.col("_end") - F.col("source_size")).alias("_base"))
    seen = sources.agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    budget = int((seen["words"] or 0) * share)
    sources = fair_targets(sources, budget, repeats)
    if seen["n"] <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)

    queued = running_totals(sized, [*place, F.col("_dice"), F.col("doc_id"), F.col("_uid")], {"_seen": "size"}, "mix-queues", n)
    queued = queued.join(sources, "_key").withColumn("_cum", F.col("_seen") - F.col("_base"))
    turns = F.when(F.col("source_size") > 0, F.least(F.lit(repeats), F.floor(F.col("target") / F.col("source_size")) + 1)).otherwise(1)
    queued = queued.withColumn("_turn", F.explode(F.sequence(F.lit(0), turns.cast("int") - 1)))
    finish = F.when(F.col("target") > 0, (F.col("_turn") * F.col("source_size") + F.col("_cum")) / F.col("target")).otherwise(F.lit(0.0))
    queued = queued.withColumn("_finish", finish)
    order = [F.col("_finish"), F.col("_dice"), F.col("_turn"), F.col("doc_id"), F.col("_uid")]
    sent = running_totals(queued, order, {"_sent": "size"}, "mix-order", repeats * n)
    sent = sent.withColumn("_kept", F.col("_sent") <= budget)
    lacks = stored(sent.groupBy("_key").agg((F.first("target") - F.sum(F.when(F.col("_kept"), F.col("size")).otherwise(0))).alias("_lacks")), "mix-lacks", seen["n"])
    few = F.broadcast if seen["n"] <= BROADCAST_SOURCES else lambda table: table
    fitting = sent.filter("NOT _kept AND size > 0").join(few(lacks), "_key").filter(F.col("size") <= F.col("_lacks")).select("_key", "_uid", "doc_id", "_turn", "_dice", "size", "_lacks")
    filled = running_totals(fitting, [F.col("_key"), F.col("size"), F.col("_dice"), F.col("_turn"), F.col("doc_id"), F.col("_uid")], {"_filled": "size"}, "mix-fill", repeats * n)
    starts = filled.groupBy("_key").agg((F.min(F.col("_filled") - F.col("size"))).alias("_start"))
    more = filled.join(few(starts), "_key").filter(F.col("_filled") - F.col("_start") <= F.col("_lacks")).groupBy("_uid").agg(F.sum("size").alias("_more"))
    one = [F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target", "text_hash")]
    taken = sent.groupBy("_uid").agg(*one, F.sum(F.when(F.col("_kept"), F.col("size")).otherwise(0)).alias("_sure")).join(more, "_uid", "left")
    return taken.withColumn("taken", F.col("_sure") + F.coalesce("_more", F.lit(0))).drop("_uid", "_sure", "_more")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mixture itself: rows of docs, each as often as the mix takes it. Rows alike in id, source and text are merged first."""
    taken = mix(docs, **options)  # type: ignore[arg-type]
    copies = (
        taken.filter(F.col("taken") > 0)
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.sum(F.expr("taken div size")).cast("int").alias("_copies"))
        .select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text_hash").alias("_h"), "_copies")
    )
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.xxhash64("text").alias("_th"))
    same = F.col("_id").eqNullSafe(F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_th") == F.col("_h"))
    repeated = rows.dropDuplicates(["_id", "_source", "_th"]).join(copies, same).withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select("_row.*")
