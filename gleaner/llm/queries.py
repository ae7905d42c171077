"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, minhash, mixing, ogg, packing, pii, quality, suffixes, toxicity, trie, warc, webtext, whitening
from .common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text judged by rules whose cutoffs lose few good texts in any language."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, equal payloads as revisits, and the archives read back by byte ranges."""
    files = warc.write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    number = "CAST(regexp_extract({}, '^<urn:x-page:(-?[0-9]+)>$', 1) AS STRING)"
    long = lambda c: f"CAST(nullif({number.format(c)}, '') AS BIGINT)"
    read = warc.same_number(warc.read_warc(files).drop("url", "payload"), files)
    return read.selectExpr(f"{long('record_id')} AS page_id", "payload_bytes", "payload_digest", "record_type", f"{long('refers_to')} AS refers_to")


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an Ogg file and read back."""
    return ogg.media_features(ogg.store_documents(table(spark, sf_dir, "documents")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: fixed forms, and identifiers that their contexts give away."""
    return pii.find(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed with weights 1, 2, 3 repeating, over all words, at most three times each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by a convolutional network over its bytes."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id has, removed from every text."""
    return suffixes.strip(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over all texts."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tokens of a public vocabulary, packed into sequences of at most 4096."""
    import public_tokenizers

    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a classifier that weak supervision has trained."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that they share beginnings."""
    turns = trie.numbered(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(turns, trie.rebuilt_paths(turns))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the whitened principal components of all."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.components(whitening.whiten(rows, whitening.fit(rows)), "vec_id")


def op13_webtext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return webtext.main_text(pages, webtext.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_warc": op2_warc,
        "op3_ogg": op3_ogg,
        "op4_pii": op4_pii,
        "op5_mixing": op5_mixing,
        "op6_language": op6_language,
        "op7_suffixes": op7_suffixes,
        "op8_minhash": op8_minhash,
        "op9_packing": op9_packing,
        "op10_toxicity": op10_toxicity,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_whitening": op12_whitening,
        "op13_webtext": op13_webtext,
    }


WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base32 of SHA-1: five hexadecimal digits are four characters.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGEST = f"""list_aggregate(list_transform(range(32), lambda i: substr('{BASE32}', CAST((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')"""
OP2 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages), f AS (SELECT payload, min(page_id) AS first, count(*) AS n FROM p GROUP BY payload)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, {DIGEST} AS payload_digest, CASE WHEN n > 1 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND first <> page_id THEN first END AS refers_to FROM p JOIN f USING (payload)"""

#: Bytes are pairs of hexadecimal digits; position i of a text is its byte i, from 0.
OP7 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(CAST(length(h) // 2 - 49 AS BIGINT))) AS i, h FROM d WHERE length(h) >= 100), g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM s),
low AS (SELECT x, min(doc_id) AS least FROM g GROUP BY x HAVING min(doc_id) < max(doc_id)), hit AS (SELECT doc_id, i FROM g JOIN low USING (x) WHERE least < doc_id),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o), r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, run),
e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c, a FROM r UNION ALL SELECT d.doc_id, coalesce(max(b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT doc_id, sha256(unhex(coalesce(string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY c, a), ''))) AS kept_sha256 FROM e JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, kept_sha256 FROM d JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(CAST(len(ws) - 4 AS BIGINT)), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) WHEN len(ws) > 0 THEN ['#' || array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), reach AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.doc_id WHERE reach.root < e.y)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


#: The checksum of a conversation's decimal id, bit by bit; nodes are lists of turns, subtrees the nodes whose lists begin alike.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
OP11 = f"""WITH o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
p AS (SELECT c.conv_id, 0 AS side, pos, r, x FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND pos < h UNION ALL SELECT conv_id, 1, pos, r, x FROM o JOIN c USING (conv_id) WHERE pos >= h),
q AS (SELECT c.conv_id, coalesce(any_value(t), []) AS turns FROM c LEFT JOIN (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY side, pos) AS t FROM p GROUP BY conv_id) USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM q), k AS (SELECT conv_id, depth, turns[1:depth] AS node, len(turns) = depth AS at_end FROM m),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE length(node[-1].x) END AS chars, string_agg(CASE WHEN at_end THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM k GROUP BY node, depth),
u AS (SELECT n.*, n.node[1:n.depth - 1] AS up FROM n), ch AS (SELECT up, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY up),
a AS (SELECT n.node, n.depth, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS saved FROM n LEFT JOIN ch ON ch.up = n.node), b AS (SELECT node[1:d] AS top, saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS d FROM a)),
s AS (SELECT top, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM b GROUP BY top)
SELECT u.conv_id, CAST(u.depth AS BIGINT) AS depth, CASE WHEN u.depth > 0 THEN v.conv_id END AS parent_conv_id, u.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
FROM u JOIN n v ON v.node = u.up LEFT JOIN ch ON ch.up = u.node JOIN s ON s.top = u.node"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; tests compare the others with plain versions."""
    return {"op2_warc": OP2, "op7_suffixes": OP7, "op8_minhash": OP8, "op11_prefix_trie": OP11}
