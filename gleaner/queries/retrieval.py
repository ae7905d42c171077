"""Search: BM25, vectors, expansion, fusion, selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bpe import vocabulary_count
from ..functions.fixed import CONCEPT_FORMS, CONTEXTS, PRESETS, STOPWORDS, SYNONYMS
from ..functions.text import key_concepts, page_estimate, relevance, terms, token_count
from ..functions.vector import embed_text
from ..operators import bm25, expand, fusion, impacts, knn, latent
from ..operators import vectors as vector_index
from ..operators.segment import line_blocks
from ..plans import index, retrieve
from ..plans.settings import Settings
from ..sources.scratch import shared_path
from .literals import frame, values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z0-9]+$'))"
TOKENS = r"CAST(floor(len(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')) * 1.3::DOUBLE) AS INTEGER)"
BM25 = f"""
d AS (SELECT doc_id, {TERMS.format("text")} AS ts FROM documents), dl AS (SELECT doc_id, ts, len(ts) AS dl FROM d),
c AS (SELECT count(*) AS n, avg(dl) AS avg_len FROM dl),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(ts) AS term FROM dl) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
      FROM q JOIN df USING (term) JOIN p USING (term), c GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)"""


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 8")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 best documents for each benchmark item."""
    return bm25.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {BM25} SELECT query_id, doc_id, round(least(score / 10, 1.0), 6) AS score FROM r WHERE rank <= 5")
def bm25_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword scores on a scale from 0 to 1."""
    found = bm25.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5)
    return found.select("query_id", "doc_id", F.round(F.least(F.col("score") / 10, F.lit(1.0)), 6).alias("score"))


@query(f"WITH p AS (SELECT DISTINCT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) SELECT term, count(*) AS df FROM p GROUP BY term")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every term."""
    return bm25.build_index(table(spark, sf_dir, "documents")).terms


@query(f"SELECT count(*) AS n_docs, round(avg(len({TERMS.format('text')})), 6) AS avg_len FROM documents")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents and their average length in terms."""
    return bm25.build_index(table(spark, sf_dir, "documents")).corpus.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(f"SELECT doc_id, {TOKENS.format('text')} AS token_count FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate tokens of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("token_count"))


def tokenizer() -> str:
    """The place of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query()
def vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by a byte-pair vocabulary."""
    return table(spark, sf_dir, "documents").select("doc_id", vocabulary_count(tokenizer())(F.col("text")).alias("token_count"))


@query("SELECT doc_id, CAST(greatest(1, n_chars // 2500 + 1) AS INTEGER) AS page FROM documents")
def page_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page on which a text of this many characters would end."""
    return table(spark, sf_dir, "documents").select("doc_id", page_estimate(F.col("n_chars")).alias("page"))


STOP = "', '".join(STOPWORDS)


@query(
    f"""WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {TERMS.format("text")} AS ws FROM documents)),
    k AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE regexp_matches(word, '^[a-z]{{4,}}$') AND word NOT IN ('{STOP}') GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM k)
    SELECT doc_id, word, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def keywords_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent words of each document, earlier ones first where counts are equal."""
    return retrieve.keywords(table(spark, sf_dir, "documents"))


def concept_sql(text: str) -> str:
    found = "list_concat(" + ", ".join(f"list_transform(regexp_extract_all({text}, '{p}', 1), lambda x: trim(x))" for p in CONCEPT_FORMS) + ")"
    return f"list_filter({found}, lambda x: length(x) > 1)"


@query(
    f"""WITH c AS (SELECT query_id, {concept_sql("text")} AS cs FROM {values("asked")}), e AS (SELECT query_id, unnest(cs) AS concept, generate_subscripts(cs, 1) AS pos FROM c),
    f AS (SELECT query_id, concept, min(pos) AS pos FROM e GROUP BY ALL), r AS (SELECT query_id, concept, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS INTEGER) AS place FROM f)
    SELECT * FROM r WHERE place < 5"""
)
def key_concepts_of_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies, acronyms and measures named in queries."""
    return frame(spark, "asked").select("query_id", F.posexplode(key_concepts(F.col("text"))).alias("place", "concept"))


def pairs_sql(name: str, table_: dict[str, list[str]]) -> str:
    rows = ", ".join(f"('{k}', {i}, '{t}', {j})" for i, (k, ts) in enumerate(table_.items()) for j, t in enumerate(ts))
    return f"{name}(key, key_no, term, term_no) AS (VALUES {rows})"


EXPANDED = """f0 AS (SELECT query_id, text, term, min((key_no, term_no)) AS o FROM asked JOIN syn ON list_contains(regexp_extract_all(lower(text), '\\b([a-z]+)\\b', 1), key) GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS n FROM f0),
    e AS (SELECT query_id, text AS query, (0, 0) AS o FROM asked
      UNION ALL SELECT query_id, term, (1, n) FROM f WHERE n <= 5 AND NOT contains(lower(text), term)
      UNION ALL SELECT query_id, any_value(text) || ' ' || string_agg(term, ' ' ORDER BY n), (2, 0) FROM f WHERE n <= 3 GROUP BY query_id
      UNION ALL SELECT query_id, term, (3, c.i * 10 + term_no) FROM (SELECT query_id, text, unnest(list_transform(string_split(upper(code), ','), lambda x: trim(x))) AS one, generate_subscripts(string_split(code, ','), 1) AS i FROM asked) c JOIN ctx ON one = key WHERE term_no < 3 AND NOT contains(lower(text), term)
      UNION ALL SELECT query_id, unnest(regexp_extract_all(text, '"([^"]+)"', 1)), (4, 0) FROM asked),
    u AS (SELECT query_id, lower(trim(query)) AS k, min(o) AS o, arg_min(query, o) AS query FROM e WHERE length(lower(trim(query))) > 2 GROUP BY query_id, k),
    x AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS INTEGER) AS variant, query FROM u)"""


@query(f"WITH {pairs_sql('syn', SYNONYMS)}, {pairs_sql('ctx', CONTEXTS)}, asked AS (SELECT * FROM {values('asked')}), {EXPANDED} SELECT * FROM x WHERE variant < 10")
def expand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variations of queries by synonyms, contexts and quoted phrases."""
    return expand.expanded(frame(spark, "asked"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"), "label")
    return rows, rows.filter("item % 20 = 0").select(F.col("item").alias("query_id"), "vector")


def knn_sql(score: str, where: str = "true", k: int = 8) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS item, round({score}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND {where}),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS INTEGER) AS rank FROM s) SELECT query_id, item, score, rank FROM r WHERE rank <= {k}"""


DOT = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
L2 = "1 / (1 + list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)))"


@query(knn_sql(DOT))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest unit vectors by dot product of every vector whose id is divisible by 20."""
    rows, asked = vectors(spark, sf_dir)
    return knn.neighbours(rows, asked, 8, "cosine").select("query_id", "item", "score", "rank")


@query(knn_sql(L2))
def l2_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors by squared distance, as a similarity, of every vector whose id is divisible by 20."""
    rows, asked = vectors(spark, sf_dir)
    return knn.neighbours(rows, asked, 8).select("query_id", "item", "score", "rank")


@query(knn_sql(L2, "v.label = 1", 5))
def filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors among all that pass a metadata filter, of every vector whose id is divisible by 20."""
    rows, asked = vectors(spark, sf_dir)
    rows = rows.withColumn("section_title", F.col("label").cast("string"))
    return knn.neighbours(knn.filtered(rows, section="1"), asked, 5).select("query_id", "item", "score", "rank")


def stored_vectors(spark: SparkSession, sf_dir: str) -> tuple:
    """All vectors in a stored index by list, with their labels, in a folder of its own."""
    path = shared_path(spark, "vectors")
    rows, asked = vectors(spark, sf_dir)
    vector_index.write(rows, path, ["label"], k=8)
    return *vector_index.read(spark, path), asked


@query()
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as l2_similarity_topk by a stored inverted file, which may miss a neighbour."""
    chunks, centres, probes, asked = stored_vectors(spark, sf_dir)
    return vector_index.search(chunks, centres, asked, 8, probes)


@query()
def ivf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as filtered_knn by a stored inverted file with bitmaps of the labels."""
    chunks, centres, probes, asked = stored_vectors(spark, sf_dir)
    return vector_index.search(chunks, centres, asked, 5, probes, {"label": [1]})


@query(SQL["filtered_knn"])
def listed_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filtered_knn by the same index with every list searched: the exact way."""
    chunks, centres, _, asked = stored_vectors(spark, sf_dir)
    return vector_index.search(chunks, centres, asked, 5, len(centres), {"label": [1]})


@query()
def latent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents nearest in meaning, by learned vectors, to every document whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents")
    path = shared_path(spark, "learned")
    latent.embedded(docs, latent.fit(docs)).select(F.col("doc_id").alias("item"), "vector").write.parquet(path)
    made = spark.read.parquet(path)  # as each block of queries reads it
    asked = made.filter("item % 20 = 0").select(F.col("item").alias("query_id"), "vector")
    return knn.neighbours(made, asked, 8, "cosine").select("query_id", "item", "score", "rank")


@query(f"SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)::DOUBLE), 8) AS score FROM {values('ranked')} GROUP BY ALL")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks summed over result lists."""
    return fusion.rrf(frame(spark, "ranked")).select("query_id", "doc_id", F.round("score", 8).alias("score"))


@query(f"SELECT query_id, doc_id, round(sum(CASE modality WHEN 'semantic' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END / (60 + rank)), 8) AS score FROM {values('ranked')} GROUP BY ALL")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modalities' reciprocal ranks, weighted."""
    return fusion.weighted(frame(spark, "ranked"), 0.6, 0.4)


@query(
    f"""WITH s AS (SELECT query_id, doc_id, sum(CASE modality WHEN 'semantic' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END / (60 + rank)) AS raw FROM {values("ranked")} GROUP BY ALL),
    n AS (SELECT query_id, count(DISTINCT variant) AS n FROM {values("ranked")} GROUP BY ALL)
    SELECT query_id, doc_id, round(raw, 6) AS raw, round(round(raw, 8) * 61 / n, 6) AS normalised, raw >= 0.2 AS raw_passes, round(raw, 8) * 61 / n >= 0.2 AS normalised_passes,
      CASE WHEN round(raw, 8) * 61 / n > 0.5 THEN 'HIGH' WHEN round(raw, 8) * 61 / n > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS relevance FROM s JOIN n USING (query_id)"""
)
def threshold_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a threshold means on raw and on normalised fusion scores, and the relevance labels."""
    ranked = frame(spark, "ranked")
    n = ranked.groupBy("query_id").agg(F.countDistinct("variant").alias("n_variants"))
    raw = fusion.weighted(ranked, 0.6, 0.4).join(n, "query_id").withColumn("raw", F.col("score"))
    both = fusion.normalised(raw)
    return both.select("query_id", "doc_id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("normalised"), (F.col("raw") >= 0.2).alias("raw_passes"), (F.col("score") >= 0.2).alias("normalised_passes"), relevance(F.col("score")).alias("relevance"))


ITEMS = "SELECT item_id AS query_id, 0 AS variant, text AS query FROM benchmark UNION ALL SELECT item_id, 1, split_part(text, '.', 1) FROM benchmark"


def hybrid_sql(asked: str, shortest: int = 3) -> str:
    """Common tables down to l: the result lists of both modalities for the queries asked (query_id, variant, query)."""
    return f"""v0 AS ({asked}),
v AS (SELECT * FROM v0 WHERE length(trim(query)) >= {shortest}),
d AS (SELECT doc_id, {TERMS.format("text")} AS ts FROM documents), dl AS (SELECT doc_id, ts, len(ts) AS dl FROM d), c AS (SELECT count(*) AS n, avg(dl) AS avg_len FROM dl),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(ts) AS term FROM dl) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT query_id, variant, unnest({TERMS.format("query")}) AS term FROM v), q AS (SELECT query_id, variant, term, count(*) AS qtf FROM qt GROUP BY ALL),
ks AS (SELECT query_id, variant, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 6) AS score FROM q JOIN df USING (term) JOIN p USING (term), c GROUP BY ALL),
slot AS (SELECT term, (ascii(term[1]) * 131 + ascii(term[length(term) // 2 + 1]) * 31 + ascii(term[-1]) * 7 + length(term) * 17) % 64 AS slot FROM (SELECT term FROM df UNION SELECT term FROM qt)),
dv AS (SELECT doc_id, slot, sum(tf) AS x FROM p JOIN slot USING (term) GROUP BY ALL), dn AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM dv GROUP BY ALL),
qv AS (SELECT query_id, variant, slot, sum(qtf) AS x FROM q JOIN slot USING (term) GROUP BY ALL), qn AS (SELECT query_id, variant, sqrt(sum(x * x)) AS norm FROM qv GROUP BY ALL),
dots AS (SELECT query_id, variant, doc_id, sum((qv.x / qn.norm) * (dv.x / dn.norm)) AS dot FROM qv JOIN dv USING (slot) JOIN dn USING (doc_id) JOIN qn USING (query_id, variant) GROUP BY ALL),
ss AS (SELECT v.query_id, v.variant, e.doc_id, round(1 / (1 + (CASE WHEN qn.norm IS NULL THEN 0 ELSE 1 END) + (CASE WHEN dn.norm IS NULL THEN 0 ELSE 1 END) - 2 * coalesce(dot, 0)), 6) AS score
  FROM v CROSS JOIN dl e LEFT JOIN dots USING (query_id, variant, doc_id) LEFT JOIN qn USING (query_id, variant) LEFT JOIN dn USING (doc_id)),
l AS (SELECT *, 'keyword' AS modality, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, doc_id) AS rank FROM ks WHERE score > 0
  UNION ALL SELECT *, 'semantic', row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, doc_id) FROM ss)"""


HYBRID = hybrid_sql(ITEMS)


def stored_index(spark: SparkSession, sf_dir: str) -> impacts.Stored:
    """All documents in a stored index, in a folder of its own."""
    path = shared_path(spark, "index")
    impacts.add(table(spark, sf_dir, "documents"), path)
    return impacts.Stored(spark, path)


@query(SQL["bm25_topk"])
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 best documents for each benchmark item, from a stored index."""
    wanted = bm25.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return impacts.search(stored_index(spark, sf_dir), wanted, 8)


def hybrid_lists(spark: SparkSession, sf_dir: str, k: int, indexed: bool = False) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    both = F.array(F.col("text"), F.split_part("text", F.lit("."), F.lit(1)))
    asked = items.select(F.col("item_id").alias("query_id"), F.posexplode(both).alias("variant", "query")).filter("length(trim(query)) > 2")
    return retrieve.result_lists(stored_index(spark, sf_dir) if indexed else table(spark, sf_dir, "documents"), asked, k)


@query(
    f"""WITH {HYBRID}, f AS (SELECT query_id, doc_id, round(sum(CASE modality WHEN 'semantic' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END / (60 + rank)), 8) AS score FROM l WHERE rank <= 10 GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 8"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector lists of two variants of each item, fused."""
    fused = fusion.weighted(hybrid_lists(spark, sf_dir, 10), 0.6, 0.4)
    return bm25.top_k(fused, 8).select("query_id", "doc_id", "score", "rank")


PRESET_ROWS = ", ".join(f"('{n}', {'true' if h else 'false'}, {s}::DOUBLE, {w}::DOUBLE, {k})" for n, (h, s, w, _, k) in PRESETS.items())


@query(
    f"""WITH {HYBRID}, ps(preset, hybrid, ws, wk, k) AS (VALUES {PRESET_ROWS}),
    f AS (SELECT preset, k, query_id, doc_id, round(sum(CASE modality WHEN 'semantic' THEN ws ELSE wk END / (60 + rank)), 8) AS score FROM l, ps WHERE rank <= k AND (hybrid OR modality = 'semantic') GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY preset, query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f) SELECT preset, query_id, doc_id, score, rank FROM r WHERE rank <= k"""
)
def hybrid_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search under all presets at once, each over lists as deep as its own k."""
    return retrieve.sweep(hybrid_lists(spark, sf_dir, max(k for *_, k in PRESETS.values())))


@query(SQL["hybrid_presets"])
def preset_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of every preset over a stored index."""
    return retrieve.sweep(hybrid_lists(spark, sf_dir, max(k for *_, k in PRESETS.values()), indexed=True))


@query(
    f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS i FROM {values("hits")} WHERE score >= 0.2),
    w AS (SELECT query_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS place, NULL::INTEGER AS doc_id, NULL::INTEGER AS token_count, false AS taken FROM (SELECT DISTINCT query_id FROM h)
      UNION ALL SELECT h.query_id, h.i, CASE WHEN w.used + h.token_count <= 3000 AND w.place < 3 THEN w.used + h.token_count ELSE w.used END, CASE WHEN w.used + h.token_count <= 3000 AND w.place < 3 THEN w.place + 1 ELSE w.place END,
        h.doc_id, h.token_count, w.used + h.token_count <= 3000 AND w.place < 3 FROM w JOIN h ON h.query_id = w.query_id AND h.i = w.i + 1)
    SELECT query_id, doc_id, CAST(token_count AS BIGINT) AS token_count, CAST(place AS INTEGER) AS place FROM w WHERE taken"""
)
def budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence above a threshold that fits a token budget, skipping what does not fit."""
    hits = frame(spark, "hits").withColumn("score", F.col("score").cast("double"))
    return fusion.select_budget(hits, 0.2, 3).select("query_id", "doc_id", "token_count", "place")


WORDS_ASKED = ["thonnd", "ernt", "reanth", "inner", "cloud", "storage"]


@query(f"WITH {hybrid_sql(f"SELECT 0 AS query_id, 0 AS variant, '{' '.join(WORDS_ASKED)}' AS query")} SELECT doc_id AS chunk_id, score, CAST(rank AS INTEGER) AS rank FROM l WHERE modality = 'semantic' AND rank <= 10")
def keyword_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose vectors are nearest to a list of keywords."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), embed_text(F.col("text")).alias("vector"))
    return index.search_words(docs, WORDS_ASKED)


@query(f"WITH {BM25} SELECT query_id, rank, doc_id AS chunk_id, source AS section_title, md5(text) AS content_md5 FROM r JOIN documents USING (doc_id) WHERE rank <= 16")
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and place of twice as many documents as an item's search returns, by their ids."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ids = bm25.search(docs, items, k=16).select("query_id", F.col("doc_id").alias("chunk_id"), "rank")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("section_title"))
    return index.fetch(chunks, ids).select("query_id", "rank", "chunk_id", "section_title", F.md5("content").alias("content_md5"))


TOTALS = """SELECT count(DISTINCT query_id) AS n_criteria, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_tokens, true AS any_figure FROM x"""


@query(SQL["budget_select"].replace("WITH RECURSIVE", "WITH RECURSIVE x AS (WITH RECURSIVE", 1) + f") {TOTALS}")
def retrieval_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retrieval selected in all."""
    return retrieve.totals(budget_select(spark, sf_dir), spark.sql("SELECT 12 AS doc_id"))


CHOICES = [("BALANCED", 0.2, 8, 0.6), ("BALANCED", 0.25, 8, 0.6), ("SEMANTIC_ONLY", 0.3, 6, 1.0), ("HIGH_RECALL", 0.5, 15, 0.0), ("HIGH_RECALL", 0.55, 12, 0.5), ("BALANCED", 0.2, 2, 0.6), ("KEYWORD_HEAVY", 0.15, 10, 0.45), ("KEYWORD_HEAVY", 0.12, 10, 0.4)]


@query(
    f"""WITH c(id, preset, threshold, k, semantic) AS (VALUES {", ".join(f"({i}, '{n}', {t}::DOUBLE, {k}, {w}::DOUBLE)" for i, (n, t, k, w) in enumerate(CHOICES))}),
    ps(preset, hybrid, ws, wk, th, pk) AS (VALUES {", ".join(f"('{n}', {h}, {s}::DOUBLE, {w}::DOUBLE, {t}::DOUBLE, {k})" for n, (h, s, w, t, k) in PRESETS.items())}),
    x AS (SELECT *, threshold BETWEEN 0 AND 0.5 AND abs(threshold * 20 - round(threshold * 20)) < 1e-9 AND k BETWEEN 3 AND 15 AND semantic BETWEEN 0 AND 1 AND abs(semantic * 10 - round(semantic * 10)) < 1e-9 AS valid FROM c JOIN ps USING (preset))
    SELECT id, CASE WHEN NOT valid THEN 'invalid' WHEN threshold = th AND k = pk AND semantic = ws THEN preset ELSE 'CUSTOM' END AS name, CASE WHEN valid THEN round(1 - semantic, 6) END AS keyword FROM x"""
)
def custom_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets with changed values: what they are called, and the keyword weight that follows."""
    rows = []
    for i, (name, threshold, k, semantic) in enumerate(CHOICES):
        try:
            changed = Settings.preset(name).change(threshold=threshold, k=k, semantic=semantic)
            rows.append((i, changed.name, round(changed.keyword, 6)))
        except ValueError:
            rows.append((i, "invalid", None))
    return spark.createDataFrame(rows, "id int, name string, keyword double")


CONCEPTS = f"""k0 AS (SELECT query_id, {concept_sql("text")} AS cs FROM asked), k1 AS (SELECT query_id, unnest(cs) AS query, generate_subscripts(cs, 1) AS pos FROM k0),
    k2 AS (SELECT query_id, query, min(pos) AS pos FROM k1 GROUP BY ALL), k3 AS (SELECT query_id, query, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM k2)"""
VARIANTS = "SELECT * FROM x WHERE variant < 10 UNION ALL SELECT query_id, CAST(least(10, (SELECT count(*) FROM x WHERE x.query_id = k3.query_id)) + n - 1 AS INTEGER), query FROM k3 WHERE n <= 5"


@query(
    f"""WITH RECURSIVE {pairs_sql("syn", SYNONYMS)}, {pairs_sql("ctx", CONTEXTS)}, asked AS (SELECT item_id AS query_id, left(text, 500) AS text, '' AS code FROM benchmark), {EXPANDED}, {CONCEPTS}, {hybrid_sql(VARIANTS, 0)},
    nv AS (SELECT query_id, count(*) AS n_variants FROM v GROUP BY query_id),
    fu AS (SELECT query_id, doc_id, round(sum(CASE modality WHEN 'semantic' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END / (60 + rank)), 8) AS raw FROM l WHERE rank <= 8 GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS i FROM fu),
    h AS (SELECT query_id, doc_id, raw * 61 / n_variants AS score, {TOKENS.format("text")} AS token_count, n_variants, row_number() OVER (PARTITION BY query_id ORDER BY raw * 61 / n_variants DESC, doc_id) AS i
      FROM best JOIN nv USING (query_id) JOIN documents USING (doc_id) WHERE i <= 16 AND raw * 61 / n_variants >= 0.2),
    w AS (SELECT query_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS place, NULL::BIGINT AS doc_id, NULL::DOUBLE AS score, NULL::BIGINT AS token_count, NULL::BIGINT AS n_variants, false AS taken FROM (SELECT DISTINCT query_id FROM h)
      UNION ALL SELECT h.query_id, h.i, CASE WHEN w.used + h.token_count <= 3000 AND w.place < 8 THEN w.used + h.token_count ELSE w.used END, CASE WHEN w.used + h.token_count <= 3000 AND w.place < 8 THEN w.place + 1 ELSE w.place END,
        h.doc_id, h.score, h.token_count, h.n_variants, w.used + h.token_count <= 3000 AND w.place < 8 FROM w JOIN h ON h.query_id = w.query_id AND h.i = w.i + 1)
    SELECT query_id, doc_id, round(score, 6) AS score, token_count, CAST(place AS INTEGER) AS place, n_variants FROM w WHERE taken"""
)
def retrieve_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole retrieval plan: expansion, concepts, both modalities, fusion and selection for every benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit("").alias("code"))
    return retrieve.retrieve(table(spark, sf_dir, "documents"), items, "BALANCED").withColumn("score", F.round("score", 6))


@query(SQL["retrieve_evidence"])
def indexed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole retrieval plan over a stored index."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit("").alias("code"))
    return retrieve.retrieve(stored_index(spark, sf_dir), items, "BALANCED").withColumn("score", F.round("score", 6))


@query(
    f"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), u AS (SELECT t, count(*) AS n FROM b WHERE trim(t) <> '' GROUP BY t)
    SELECT CAST(sum(n) AS BIGINT) AS n_texts, count(*) AS n_embedded, CAST(sum(CASE WHEN len({TERMS.format("t")}) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero FROM u"""
)
def embed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines embedded once for each different text."""
    lines = line_blocks(table(spark, sf_dir, "documents"))
    each = retrieve.embed_distinct(lines, "content")
    zero = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x) == 0
    return each.agg(F.sum("n").alias("n_texts"), F.count("*").alias("n_embedded"), F.sum(zero.cast("long")).alias("n_zero"))


@query(
    f"""WITH t AS (SELECT doc_id, {TERMS.format("text")} AS ts FROM documents), e AS (SELECT doc_id, unnest(ts) AS term FROM t),
    s AS (SELECT doc_id, (ascii(term[1]) * 131 + ascii(term[length(term) // 2 + 1]) * 31 + ascii(term[-1]) * 7 + length(term) * 17) % 64 AS slot, count(*) AS x FROM e GROUP BY ALL)
    SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS value FROM s"""
)
def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed unit vectors of the documents, without zeros."""
    v = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(embed_text(F.col("text"))).alias("slot", "value"))
    return v.filter("value > 0").select("doc_id", "slot", F.round("value", 6).alias("value"))


@query(f"SELECT doc_id, CAST(len({TERMS.format('text')}) AS INTEGER) AS n_terms, CAST(len(list_distinct({TERMS.format('text')})) AS INTEGER) AS n_distinct FROM documents")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and different terms of every document."""
    t = terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))
