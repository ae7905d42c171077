"""Near-duplicates by an inverted join over MinHash signature coordinates.

Texts with the same shingle set are one class. Each class has a signature; it is posted under its (coordinate, value)
pairs. A pair of sets at the similarity bound agrees in 48 of 64 coordinates on average, and in 30 or more but for
odds of 3.8e-7, one in 2.6 million. Collisions are counted first for each class: one with fewer than 30 coordinate
values that other classes have too cannot have a partner, and leaves; lists are then counted again without it. The lists of
the rest are merged under a prefix: with 30 agreements wanted, two classes share one of their 35 rarest values, so the
longest lists of a class are skipped, and looked up in the signature only for those that met in a short one.

A list is not paired out. Its members meet one leader, the member whose values are the most frequent ones, which in a family of
copies is the text they derive from; pairs that agree in 30 coordinates are confirmed on the full sets and give components. What
64 coordinates cannot tell is a pair at 0.7 from one at 0.75, and a large family has many of the former. So the exact
check of what is left works on the sets: of the classes with 30 coordinates in lists whose members lie in several components,
those of different components are compared that share a shingle in the part of their rarest shingles in which two
sets of their sizes must share one.

Defined cases: null and empty texts have the empty set, are linked with nothing and stay; texts of fewer words than a
shingle are one shingle; repeated rows and ids belong to one class; null ids join components but never name one unless
nothing else does; an empty table gives an empty table; other columns, of whatever names, are ignored or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_arrow, discard, slices, stored
from .components import connected_components
from .shingles import mix, shingle_sets

COORDINATES = 64
AGREE = 30
PREFIX = COORDINATES - AGREE + 1
SIMILAR = 75  # per cent
#: Classes up to this number are broadcast to fetch their texts; more are joined by their keys.
BROADCAST_CLASSES = 200_000
_rng = np.random.default_rng(7)
FLIPS = _rng.integers(0, 1 << 63, (COORDINATES, 1), dtype=np.uint64)
FACTORS = _rng.integers(0, 1 << 63, (COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 4096
#: Bytes of texts or sets that a worker turns into arrays at once; the arrays take some 30 times that.
TEXT_BYTES = 1 << 20


def signature(hashes: np.ndarray) -> np.ndarray:
    """The coordinates: upper halves of the smallest values under each of the hash functions."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        low = np.minimum(low, ((hashes[i : i + CHUNK] ^ FLIPS) * FACTORS).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a, set_b (both null for the empty set), signature for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                counts, a, b, coordinates = [], [], [], []
                for hashes in shingle_sets(part.column("text").to_pylist()):
                    counts.append(len(hashes))
                    some = len(hashes) > 0
                    a.append(int(hashes.sum().view(np.int64)) if some else None)
                    b.append(int(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)) if some else None)
                    coordinates.append(signature(hashes) if some else None)
                made = [pa.array(counts, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(coordinates, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *made], ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "signature"])

    bound_arrow(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_a long, set_b long, signature array<int>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, hashes (binary, sorted 64-bit numbers) for the classes wanted (cls, doc_id, text_hash of one member each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                sets = [h.tobytes() for h in shingle_sets(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(sets, pa.binary())], ["cls", "hashes"])

    bound_arrow(docs.sparkSession)
    w = wanted.select("cls", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    if wanted.count() <= BROADCAST_CLASSES:
        w = F.broadcast(w)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    found = texts.join(w, F.col("_th").eqNullSafe(F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    return found.select("cls", "text").mapInArrow(run, "cls long, hashes binary").dropDuplicates(["cls"])


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree in enough coordinates."""
    sides = pairs.join(classes.select(F.col("cls").alias("a"), F.col("signature").alias("_sa")), "a")
    sides = sides.join(classes.select(F.col("cls").alias("b"), F.col("signature").alias("_sb")), "b")
    same = F.aggregate(F.zip_with("_sa", "_sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return sides.filter(same >= AGREE).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """Those of the pairs whose full sets are similar enough."""

    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                out.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    bound_arrow(pairs.sparkSession)
    test = F.pandas_udf(linked, "boolean")
    sides = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("_ha")), "a")
    sides = sides.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("_hb")), "b")
    return sides.filter(test("_ha", "_hb")).select("a", "b")


def colliding(posted: DataFrame) -> DataFrame:
    """posted: cls, key. Of classes with AGREE keys or more that others have too, those keys: cls, key, n (classes with the key)."""
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    mine = Window.partitionBy("cls")  # as many rows as a class has coordinates
    return posted.join(shared, "key").withColumn("_shared", F.count("*").over(mine)).filter(F.col("_shared") >= AGREE).select("cls", "key", "n")


def postings(classes: DataFrame) -> DataFrame:
    """cls, key, rank (from 1, the rarest first), shared (keys of the class): coordinate values of classes that may have partners."""
    posted = classes.select("cls", F.posexplode("signature").alias("_at", "_value"))
    key = F.shiftleft(F.col("_at").cast("long"), 32).bitwiseOR(F.col("_value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    first = stored(colliding(posted.select("cls", key.alias("key"))).select("cls", "key"), "minhash-colliding")
    mine = Window.partitionBy("cls")
    again = colliding(first)
    ranked = again.withColumn("rank", F.row_number().over(mine.orderBy("n", "key"))).withColumn("shared", F.count("*").over(mine))
    out = stored(ranked.withColumn("weight", F.sum("n").over(mine)), "minhash-posts")
    discard(first)
    return out


def met_leaders(posts: DataFrame) -> DataFrame:
    """a, b: members of the lists under every class's prefix, each with its list's leader; values nobody else has fill the prefix first."""
    prefix = posts.filter(F.col("rank") + COORDINATES - F.col("shared") <= PREFIX).select("key", "cls", "weight")
    leaders = prefix.groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("_l"), F.min("cls").alias("_lo"), F.max("cls").alias("_hi"))
    leaders = leaders.filter("_lo < _hi").select("key", F.col("_l.cls").alias("lead"))
    met = prefix.join(leaders, "key").filter("cls <> lead")
    return met.select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()


def undecided(posts: DataFrame, parts: DataFrame) -> DataFrame:
    """cls, part of the classes with AGREE keys or more in lists whose members lie in several components."""
    named = posts.select("key", "cls").join(parts, "cls", "left").select("key", "cls", F.coalesce("part", "cls").alias("part"))
    lists = named.groupBy("key").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).filter("_lo < _hi")
    return named.join(lists, "key").groupBy("cls", "part").agg(F.count("*").alias("_n")).filter(F.col("_n") >= AGREE).select("cls", "part")


def shingle_postings(sets: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """sets: cls, part, hashes. cls, part, key, size, rest: every class under its rarest shingles, of which two similar sets must share one.

    rest counts the shingles from this one on, in the order from rare to frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "hashes", TEXT_BYTES):
                data = [np.frombuffer(h, np.int64) for h in part.column("hashes").to_pylist()]
                sizes = np.array([len(h) for h in data])
                columns = [pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in ("cls", "part")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(data)), pa.array(np.repeat(sizes, sizes))], ["cls", "part", "key", "size"])

    bound_arrow(sets.sparkSession)
    posted = sets.select("cls", "part", "hashes").mapInArrow(run, "cls long, part long, key long, size long")
    seen = posted.groupBy("key").agg(F.count("*").alias("_n"), F.min("part").alias("_lo"), F.max("part").alias("_hi")).filter("_n > 1")
    mine = Window.partitionBy("cls")  # the shingles of one text
    common = posted.join(seen, "key").withColumn("rest", F.count("*").over(mine) - F.row_number().over(mine.orderBy("_n", "key")) + 1)
    # sets this similar share at least percent of the larger one's shingles
    return common.filter((F.col("_lo") < F.col("_hi")) & (100 * F.col("rest") >= percent * F.col("size"))).select("cls", "part", "key", "size", "rest")


def met_rarely(posts: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """a, b of different components that share a posted shingle and, by their sizes and its place in both, can be similar.

    In each list the largest component's members meet the others only, so that a list of one family costs no square.
    """
    counts = posts.groupBy("key", "part").agg(F.count("*").alias("_n"))
    major = counts.groupBy("key").agg(F.max(F.struct("_n", "part"))["part"].alias("major"))
    listed = posts.join(major, "key")
    few = listed.filter("part <> major").select("key", "cls", "part", "size", "rest")
    every = listed.select("key", *[F.col(c).alias(f"_{c}") for c in ("cls", "part", "size", "rest", "major")])
    once = (F.col("_part") == F.col("_major")) | (F.col("cls") < F.col("_cls"))
    together = F.least("rest", "_rest") * (100 + percent) >= percent * (F.col("size") + F.col("_size"))
    alike = 100 * F.least("size", "_size") >= percent * F.greatest("size", "_size")
    met = few.join(every, "key").filter((F.col("part") != F.col("_part")) & once & together & alike)
    return met.select(F.least("cls", "_cls").alias("a"), F.greatest("cls", "_cls").alias("b")).distinct()


def components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, part for the classes that are linked with another: part is the smallest class reachable."""
    posts = postings(classes)
    near = stored(classes.join(posts.select("cls").distinct(), "cls", "left_semi").select("cls", "doc_id", "text_hash", "signature"), "minhash-near")
    n = near.count()
    sets = stored(full_sets(docs, near), "minhash-sets")
    links = stored(confirmed(agreeing(met_leaders(posts), near), sets), "minhash-links", n)
    parts = connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("part"))
    parts = stored(parts, "minhash-parts", n)
    discard(near, links)
    left = stored(sets.join(undecided(posts, parts), "cls"), "minhash-open")
    if n_left := left.count():
        lists = stored(shingle_postings(left), "minhash-shingles")
        more = stored(confirmed(met_rarely(lists), left), "minhash-links", n_left)
        if not more.isEmpty():
            named = left.select("cls", "part")
            ends = more.join(named.toDF("a", "_pa"), "a").join(named.toDF("b", "_pb"), "b").select(F.col("_pa").alias("a"), F.col("_pb").alias("b"))
            joined = connected_components(ends).select(F.col("node").alias("part"), F.col("component").alias("_new"))
            alone = joined.select(F.col("part").alias("cls"), "part").join(parts, "cls", "left_anti")  # classes that had no link before
            parts = stored(parts.unionByName(alone).join(joined, "part", "left").select("cls", F.coalesce("_new", "part").alias("part")), "minhash-parts", n)
        discard(lists, more)
    discard(posts, sets, left)
    return parts


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    rows = stored(signatures(docs), "minhash-rows")
    key = ["set_a", "set_b", "n_shingles"]
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_one")
    some = rows.filter("n_shingles > 0")
    classes = some.groupBy(*key).agg(one, F.first("signature").alias("signature"))
    classes = classes.select(*key, F.monotonically_increasing_id().alias("cls"), "_one.doc_id", "_one.text_hash", "signature")
    classes = stored(classes, "minhash-classes")
    parts = components(docs, classes)
    named = classes.select(*key, "cls", F.col("doc_id").alias("_first")).join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    names = named.groupBy("part").agg(F.min("_first").alias("_least"))
    named = named.join(names, "part").select(*key, "_least")
    linked = some.select("doc_id", "text_hash", *key).join(named, key, "left")
    bare = rows.filter("n_shingles = 0").select("doc_id", "text_hash", *key).withColumn("_least", F.lit(None).cast(docs.schema["doc_id"].dataType))
    component = F.coalesce("_least", "doc_id")
    out = linked.unionByName(bare)
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that of its smallest id, with all columns."""
    judged = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    kept = rows.join(judged, F.col("_th").eqNullSafe(F.col("_h")) & F.col("_id").eqNullSafe(F.col("_d")), "left_semi")
    return kept.dropDuplicates(["_id", "_th"]).select("_row.*")
