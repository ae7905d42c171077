"""A stored BM25 index, searched without looking at texts again.

Below a path there are, by segment (a part of the corpus that was added at once):

- docs: doc_id, shard, dl, token_count, vector, terms, tfs - what any later search needs of a document, once;
- blocks, in folders by a hash of the term (bucket): shard, term, up to BLOCK postings (docs, tfs, dls) in falling order of impact, and the
  greatest impact among them (most). An impact is tf / (tf + norm), between 0 and 1, by the segment's mean length;
- terms, in the same folders: term, df, most;
- corpus: n_docs, length, mean, shards, buckets (one row).

A search reads its terms' folders alone. One shard is scored in full; its k-th best score of a query is a bound that the final k-th best cannot
be below. Elsewhere a query's weakest blocks stay unread: terms are cut at impacts so low that a document found in no block above the
cuts cannot reach the bound, and what is found but could still be missing a part is scored from its row in docs. Where cutting would save less than
half of a query's postings, all its blocks are read instead. The rows are the same either way.

When segments are added the mean length changes, and impacts with it: by a factor that is at most the ratio of the means, so that
bounds are raised by that ratio where the mean has grown.

Defined cases: null and empty texts are documents without terms, which no search finds; queries without known terms find nothing; ties go
to the smaller id; ids are those of one document each, so that one given twice to a segment is an error; an empty corpus has no hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.batches import bound_batches
from ..functions.fixed import K1, B
from ..functions.text import terms, token_count
from ..functions.vector import coded, embed_text, hashed_vectors
from .bm25 import top_k
from .scan import PRODUCT, Best, query_blocks, rounded

BLOCK = 256
BUCKETS = 256
#: Documents of one shard, about, and shards of a segment, at least.
SHARD_DOCS, LEAST_SHARDS = 5_000, 8
#: Postings that one task sorts into blocks, about.
SORT_ROWS = 4_000_000
#: Scores this close to a bound are looked at, as results are rounded.
MARGIN = 1e-4


def counted(docs: DataFrame, size: int = 64) -> DataFrame:
    """docs: doc_id, shard, token_count, words, and vector if it is not made of hashed terms. Each document's different terms and how often it has
    them, with dl and vector."""
    kept = ["doc_id", "shard", "token_count"]
    vector = docs.schema["vector"] if "vector" in docs.columns else T.StructField("vector", T.ArrayType(T.DoubleType()))
    schema = T.StructType([*[docs.schema[c] for c in kept], vector, *T.StructType.fromDDL("dl int, terms array<string>, tfs array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, codes, different = coded(words)
            n = max(1, len(different))
            cells, tfs = np.unique(row * n + codes, return_counts=True)
            vectors = batch.column("vector") if "vector" in batch.schema.names else hashed_vectors(row, codes, different, len(sizes), size)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(cells // n, minlength=len(sizes)))]), pa.int32())
            names = different.take(pa.array(cells % n)) if len(cells) else pa.array([], pa.string())
            lists = [pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], vectors, pa.array(sizes, pa.int32()), *lists], schema.names)

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def packed(postings: DataFrame) -> DataFrame:
    """postings in the order of bucket, shard, term and falling impact, as blocks of one shard and term."""
    kind = to_arrow_type(postings.schema["doc_id"].dataType)
    schema = T.StructType([*T.StructType.fromDDL("bucket int, shard int, term string").fields, T.StructField("docs", T.ArrayType(postings.schema["doc_id"].dataType)), *T.StructType.fromDDL("tfs array<int>, dls array<int>, n int, most double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, term = batch.column("shard").to_numpy(), batch.column("term").dictionary_encode().indices.to_numpy()
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (shard[1:] != shard[:-1])
            place = np.arange(len(term)) - np.maximum.accumulate(np.where(new, np.arange(len(term)), 0))
            first = np.flatnonzero(place % BLOCK == 0)
            ends = pa.array(np.append(first, len(term)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, batch.column(c).cast(t)) for c, t in (("doc_id", kind), ("tf", pa.int32()), ("dl", pa.int32()))]
            heads = batch.take(pa.array(first))
            columns = [heads.column("bucket"), heads.column("shard"), heads.column("term"), *lists, pa.array(np.diff(np.append(first, len(term))), pa.int32()), heads.column("impact")]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return postings.mapInArrow(run, schema)


def add(docs: DataFrame, path: str, segment: int = 0, doc: str = "doc_id", text: str = "text", embed: Callable[[Column], Column] = embed_text, buckets: int = BUCKETS) -> None:
    """Write a segment, or replace the one of that number. All segments of an index have the same number of buckets.

    embed makes vectors of texts, by default of hashed terms; a learned model's column does as well.
    """
    spark = docs.sparkSession
    shards = max(LEAST_SHARDS, -(-docs.count() // SHARD_DOCS))
    rows = docs.select(F.col(doc).alias("doc_id"), F.pmod(F.xxhash64(doc), F.lit(shards)).cast("int").alias("shard"), token_count(F.col(text)).alias("token_count"), terms(F.col(text)).alias("words"), *([] if embed is embed_text else [embed(F.col(text)).alias("vector")]))
    at = lambda name: f"{path}/{name}/segment={segment}"
    counted(rows).write.mode("overwrite").parquet(at("docs"))
    kept = spark.read.parquet(at("docs"))
    twice = kept.groupBy("doc_id").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"document {twice['doc_id']} is there {twice['count']} times")
    total = kept.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("mean"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    corpus = spark.createDataFrame([(total["n_docs"], total["length"], total["mean"], shards, buckets)], "n_docs long, length long, mean double, shards int, buckets int")
    corpus.write.mode("overwrite").parquet(at("corpus"))
    each = kept.select("doc_id", "shard", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("doc_id", "shard", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    impact = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (total["mean"] or 1.0)))
    placed = each.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).withColumn("impact", impact)
    order = [F.col("bucket"), F.col("shard"), F.col("term"), F.col("impact").desc(), F.col("doc_id")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["postings"] // SORT_ROWS)
    packed(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)).write.mode("overwrite").partitionBy("bucket").parquet(at("blocks"))
    blocks = spark.read.schema("term string, n int, most double, bucket int").parquet(at("blocks"))
    found = blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    found.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(at("terms"))


@dataclass
class Stored:
    """A stored index below a path, with the sums over its segments."""

    spark: SparkSession
    path: str

    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/docs")

    def blocks(self) -> DataFrame:
        kind = self.docs().schema["doc_id"].dataType.simpleString()
        return self.spark.read.schema(f"shard int, term string, docs array<{kind}>, tfs array<int>, dls array<int>, n int, most double, segment int, bucket int").parquet(f"{self.path}/blocks")

    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df long, most double, segment int, bucket int").parquet(f"{self.path}/terms")

    def corpus(self) -> list[Row]:
        """n_docs, length, mean, shards and buckets of each segment."""
        return self.spark.read.parquet(f"{self.path}/corpus").orderBy("segment").collect()

    def vectors(self) -> DataFrame:
        return self.docs().select(F.col("doc_id").alias("item"), "vector")


@dataclass
class Batch:
    """Some queries: their ids, each one's weights by term number, and the terms' names, folders, frequencies and greatest impacts; what bounds of
    each segment are raised by."""

    ids: list
    mean: float
    raised: dict[int, float]
    weights: list[dict[int, float]]
    names: list[str]
    buckets: list[int]
    df: np.ndarray
    most: np.ndarray
    asking: list[list[tuple[int, float]]] = field(default_factory=list)

    @classmethod
    def of(cls, index: Stored, wanted: list[Row], corpus: list[Row]) -> Batch:
        """wanted: query_id, term, qtf, bucket."""
        known = sorted({(r["term"], r["bucket"]) for r in wanted})
        names, folders = [t for t, _ in known], [b for _, b in known]
        number = {t: i for i, t in enumerate(names)}
        n, length = sum(c["n_docs"] for c in corpus), sum(c["length"] for c in corpus)
        mean, df, most = length / n if n else 0.0, np.zeros(len(names)), np.zeros(len(names))
        raised = {c["segment"]: max(1.0, mean / c["mean"]) if c["mean"] else 1.0 for c in corpus}
        batch = cls([], mean, raised, [], names, folders, df, most)
        if names:
            # as many rows as there are terms and segments
            for r in index.terms().filter(F.col("bucket").isin(sorted(set(folders)))).join(F.broadcast(batch.listed(index.spark)), ["bucket", "term"]).collect():
                df[r["at"]] += r["df"]
                most[r["at"]] = max(most[r["at"]], min(1.0, raised[r["segment"]] * r["most"]))
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1) * (K1 + 1)
        by_query: dict = {}
        for r in wanted:
            by_query.setdefault(r["query_id"], {})[number[r["term"]]] = float(r["qtf"] * idf[number[r["term"]]])
        batch.ids, batch.weights = list(by_query), [{t: w for t, w in q.items() if df[t]} for q in by_query.values()]
        batch.ask(range(len(batch.ids)))
        return batch

    def listed(self, spark: SparkSession, cuts: dict[int, float] | None = None) -> DataFrame:
        """bucket, term, at, cut of the terms asked for: as many rows as one block of queries has terms."""
        asked = [i for i, a in enumerate(self.asking) if a] if self.asking else range(len(self.names))
        return spark.createDataFrame([(self.buckets[i], self.names[i], i, (cuts or {}).get(i, 0.0)) for i in asked], "bucket int, term string, at int, cut double")

    def ask(self, queries: range | list[int]) -> Batch:
        """For each term which of these queries have it, and with what weight."""
        self.asking = [[] for _ in self.names]
        for q in queries:
            for t, w in self.weights[q].items():
                self.asking[t].append((q, w))
        return self

    def impacts(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf / (tf + K1 * (1 - B + B * dl / (self.mean or 1.0)))


def level(heights: np.ndarray, bound: float) -> float:
    """The greatest level at which the heights, each cut off there, sum up to no more than the bound."""
    up = np.sort(heights)
    if up.sum() <= bound:
        return float("inf")
    below = np.concatenate([[0.0], np.cumsum(up)[:-1]])
    levels = (bound - below) / np.arange(len(up), 0, -1)
    return max(0.0, float(levels[np.argmax(up >= levels)]))


def shard_scores(batch: Batch, parts: list[pa.RecordBatch], queries: list[int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """For some of the queries at a time: their numbers, the shard's documents, their scores from these blocks (documents x queries), and the sums
    of weights of those terms that a document was found with, each times the term's cut."""
    table = pa.Table.from_batches(parts).combine_chunks()
    sizes = table.column("n").to_numpy()
    flat = lambda c: table.column(c).combine_chunks().flatten()
    ids = flat("docs")
    docs, row = np.unique(ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=str), return_inverse=True)
    x = batch.impacts(flat("tfs").to_numpy(), flat("dls").to_numpy())
    ends = np.cumsum(sizes)
    at, cut = table.column("at").to_numpy(), table.column("cut").to_numpy()
    column = {q: i for i, q in enumerate(queries)}
    for i in range(0, len(queries), step := max(1, PRODUCT // max(1, len(docs)))):
        scores, seen = np.zeros((step, len(docs))), np.zeros((step, len(docs)))
        for end, size, term, low in zip(ends, sizes, at, cut, strict=True):
            here, value = row[end - size : end], x[end - size : end]
            for q, weight in batch.asking[term]:
                if i <= (j := column.get(q, -1)) < i + step:
                    scores[j - i, here] += weight * value
                    if low:
                        seen[j - i, here] += weight * low
        some = queries[i : i + step]
        yield some, docs, scores[: len(some)].T, seen[: len(some)].T


def wanted_blocks(index: Stored, batch: Batch, cuts: dict[int, float] | None = None) -> DataFrame:
    """The blocks of the terms asked for, from their folders, whose greatest impact can be above the term's cut."""
    folders = sorted({b for b, a in zip(batch.buckets, batch.asking, strict=True) if a})
    found = index.blocks().filter(F.col("bucket").isin(folders)).join(F.broadcast(batch.listed(index.spark, cuts)), ["bucket", "term"])
    raised = index.spark.createDataFrame(list(batch.raised.items()), "segment int, raised double")
    return found.join(F.broadcast(raised), "segment").filter("most * raised > cut")  # one row for each segment


def scored(blocks: DataFrame, batch: Batch, queries: list[int], k: int, digits: int, bounds: dict[int, float] | None = None, rest: dict[int, float] | None = None) -> DataFrame:
    """q, item, score: each shard's k best of every query. With bounds: all its documents that could reach a query's, given what the cuts leave (rest)."""
    item = blocks.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item", item), T.StructField("score", T.DoubleType())])

    def of_shard(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, docs, score, seen in shard_scores(batch, parts, queries):
            if bounds is None:
                value, best = rounded(score, digits), Best(len(some), k)
                best.add(np.where(value > 0, value, -np.inf), docs)
                col, items, value = best.query, best.item, best.score
            else:
                doc, col = np.nonzero((score > 0) & (score - seen >= np.array([bounds[q] - rest[q] for q in some])))
                items, value = docs[doc], score[doc, col]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(some)[col], pa.int32()), pa.array(items.tolist(), to_arrow_type(item)), pa.array(value)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            keys = list(zip(b.column("segment").to_pylist(), b.column("shard").to_pylist(), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
                if held and now != keys[i]:
                    yield from of_shard(held)
                    held = []
                now = keys[i]
                held.append(b.slice(i, j - i))
        if held:
            yield from of_shard(held)

    bound_batches(blocks.sparkSession)
    dealt = blocks.repartition("segment", "shard").sortWithinPartitions("segment", "shard")
    return dealt.select("segment", "shard", "docs", "tfs", "dls", "n", "at", "cut").mapInArrow(run, schema)


def completed(index: Stored, batch: Batch, found: DataFrame, digits: int) -> DataFrame:
    """q, item, score of the candidates found (q, item), scored in full from their rows in docs."""
    asked = found.groupBy("item").agg(F.collect_set("q").alias("qs"))  # at most the queries of one block
    rows = index.docs().select(F.col("doc_id").alias("item"), "dl", "terms", "tfs").join(asked, "item")
    weights = [{batch.names[t]: w for t, w in q.items()} for q in batch.weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, qs, score = [], [], []
            for i, (dl, words, tfs, asked_by) in enumerate(zip(*[b.column(c).to_pylist() for c in ("dl", "terms", "tfs", "qs")], strict=True)):
                x = dict(zip(words, batch.impacts(np.array(tfs), np.array(dl)).tolist(), strict=True))
                for q in asked_by:
                    row.append(i)
                    qs.append(q)
                    score.append(sum(w * x[t] for t, w in weights[q].items() if t in x))
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int32()), b.column("item").take(pa.array(row, pa.int64())), pa.array(rounded(np.array(score, float), digits))], ["q", "item", "score"])

    return rows.mapInArrow(run, T.StructType([T.StructField("q", T.IntegerType()), rows.schema["item"], T.StructField("score", T.DoubleType())]))


def cut_off(batch: Batch, sizes: dict[int, np.ndarray], bounds: dict[int, float]) -> tuple[list[int], dict[int, float]]:
    """The queries for which cutting their terms saves at least half of their postings, and the terms' cuts.

    sizes: for each term the number of postings whose block's greatest impact is in each 32nd of the range.
    """
    chosen, cuts = [], {}
    for q, bound in bounds.items():
        low = level(np.array([w * batch.most[t] for t, w in batch.weights[q].items()]), bound - MARGIN) if bound > MARGIN else 0.0
        own = {t: min(low / w, float(batch.most[t])) for t, w in batch.weights[q].items()}
        read = sum(int(sizes[t][int(c * 32) :].sum()) for t, c in own.items() if t in sizes and c < batch.most[t])
        if 2 * read <= sum(int(sizes[t].sum()) for t in own if t in sizes):
            chosen.append(q)
            for t, c in own.items():
                cuts[t] = min(cuts.get(t, c), c)
    return chosen, cuts


def searched(index: Stored, batch: Batch, corpus: list[Row], k: int, digits: int) -> DataFrame:
    """q, item, score, rank of one block of queries."""
    spark, queries = index.spark, [q for q, w in enumerate(batch.weights) if w]
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item", index.docs().schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    if not queries:
        return spark.createDataFrame([], schema.add("rank", T.IntegerType()))
    largest = max(corpus, key=lambda c: (c["n_docs"] / c["shards"], -c["segment"]))["segment"]
    sample = (F.col("segment") == largest) & (F.col("shard") == 0)
    # at most k rows of each query of a block
    first = top_k(scored(wanted_blocks(index, batch.ask(queries)).filter(sample), batch, queries, k, digits), k, by="q", item="item").collect()
    bounds = dict.fromkeys(queries, 0.0) | {r["q"]: r["score"] for r in first if r["rank"] == k}
    sizes: dict[int, np.ndarray] = {}
    heights = F.least(F.floor(F.col("most") * F.col("raised") * 32), F.lit(31)).cast("int").alias("height")
    # at most 32 rows of each term
    for r in wanted_blocks(index, batch).groupBy("at", heights).agg(F.sum("n").alias("n")).collect():
        sizes.setdefault(r["at"], np.zeros(32))[r["height"]] += r["n"]
    few, cuts = cut_off(batch, sizes, bounds)
    whole = sorted(set(queries) - set(few))
    out = spark.createDataFrame([(r["q"], r["item"], r["score"]) for r in first], schema)
    if whole:
        out = out.unionByName(scored(wanted_blocks(index, batch.ask(whole)).filter(~sample), batch, whole, k, digits))
    if few:
        rest = {q: sum(w * cuts[t] for t, w in batch.weights[q].items()) for q in few}
        found = scored(wanted_blocks(index, batch.ask(few), cuts).filter(~sample), batch, few, k, digits, {q: bounds[q] - MARGIN for q in few}, rest)
        out = out.unionByName(completed(index, batch, found.select("q", "item"), digits).filter("score > 0"))
    return top_k(out, k, by="q", item="item")


def search(index: Stored, wanted: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """wanted: query_id, term, qtf. query_id, doc_id, score, rank: the k best documents of each query that share a term with it."""
    corpus = index.corpus()
    folder = F.pmod(F.xxhash64("term"), F.lit(corpus[0]["buckets"] if corpus else BUCKETS)).cast("int")
    out = None
    for rows in query_blocks(wanted.select("query_id", "term", "qtf", folder.alias("bucket")), 256):
        batch = Batch.of(index, rows, corpus)
        ids = index.spark.createDataFrame(list(enumerate(batch.ids)), T.StructType([T.StructField("q", T.IntegerType()), wanted.schema["query_id"]]))
        found = searched(index, batch, corpus, k, digits).join(F.broadcast(ids), "q")  # one row for each query of a block
        found = found.select("query_id", F.col("item").alias("doc_id"), "score", "rank")
        out = found if out is None else out.unionByName(found)
    return out


def reads(index: Stored, wanted: DataFrame) -> dict[str, int]:
    """How many blocks, postings and files a search without cuts reads, and how many the index has."""
    corpus = index.corpus()
    folder = F.pmod(F.xxhash64("term"), F.lit(corpus[0]["buckets"])).cast("int")
    folders = [r["bucket"] for r in wanted.select(folder.alias("bucket")).distinct().collect()]  # at most as many as there are folders
    every = index.blocks().withColumn("file", F.input_file_name())
    count = [F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")]
    own = every.filter(F.col("bucket").isin(folders))
    read = own.join(wanted.select("term").distinct(), "term", "left_semi").agg(*count).first()
    all_ = every.agg(*count, F.countDistinct("file").alias("files")).first()
    return {"blocks_read": read["blocks"], "postings_read": read["postings"], "files_read": own.select("file").distinct().count(), **all_.asDict()}
