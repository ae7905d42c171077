"""A prefix trie of conversations.

A node is a distinct sequence of first turns. Every conversation's turns are put in order by a range sort and scanned in numpy, which
gives each prefix a polynomial fingerprint modulo two primes; a conversation that lies across partitions is carried on from one
to the next, so that neither a long conversation nor a common beginning meets in one task. Prefixes of equal length and fingerprint
are candidates for one node. Each group is then verified turn by turn: by induction over depth, its members agree if all have the parent
and the last turn of the representative, the smallest conversation. Turns copied from the same place agree as they stand, others are
compared as texts, equal ones merged first. Groups with a collision are split and verified again until there is none.

Sums over subtrees need no walk from level to level: a node counts for its representative, whose path leads through all the parents to
the root, so that sums from each path's end, added up by node, have handed every node's counts to all the nodes above it.

Defined cases: rows without conv_id are left out; null roles and texts count as empty; turns with equal numbers, nulls first, follow by
role and text; a repeated row is one more turn; an empty table has no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, discard, stored

#: Moduli of the fingerprints, primes below 2**31, so that a product of two residues fits a long.
PRIMES = (2_147_483_629, 2_147_483_587)
BASE = 1_000_003
#: Rows of one partition of a range sort, about, and ids of one block of a node's list.
WIDE_ROWS, NARROW_ROWS = 250_000, 4_000_000
BLOCK_IDS = 4096
KEY = ["depth", "print", "split"]
UP = ["up_print", "up_split"]


def powers(exponents: np.ndarray, prime: int) -> np.ndarray:
    """BASE to each exponent, modulo prime, by repeated squaring."""
    out, square, left = np.full(len(exponents), 1 % prime, np.uint64), BASE % prime, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(prime), out)
        square, left = square * square % prime, left >> np.uint64(1)
    return out


def segments(keys: np.ndarray, before: int | None, n_before: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row of its run of equal keys, and its place in that run, n_before later if the run goes on from before."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    place = np.arange(len(keys)) - first
    if len(keys) and before is not None and keys[0] == before:
        place[first == 0] += n_before
    return first, place


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of a range sort: those of any shuffle, or more where rows need them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // each)


def scan(rows: DataFrame, order: Sequence[Column], label: str, parts: int, sums: Sequence[str] = (), prints: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Sort rows by conv_id and the order given, and add running values within each conversation.

    n: the row's place from 1. Each of sums: running sum, in its column. For each entry of prints (name: value column, prime): the
    polynomial fingerprint up to this row, and `up_` + name, that up to the row before. Partitions are scanned on their own and stored;
    one row from each, on the driver, tells what the conversation at its start brings along.
    """
    spark, prints = rows.sparkSession, prints or {}
    running = ["n", *sums, *[p for name in prints for p in (name, f"up_{name}")]]
    kept = [f for f in rows.schema.fields if f.name not in running]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in running], T.StructField("_part", T.IntegerType())])
    names = rows.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, dict.fromkeys(running, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda name, b=batch: b.column(b.schema.names.index(name)).to_numpy(zero_copy_only=False)
            keys = col("conv_id")
            first, place = segments(keys, key, last["n"])
            goes_on = first == 0 if key is not None and keys[0] == key else np.zeros(len(keys), bool)
            out = {"n": place + 1}
            for name in sums:
                total = np.cumsum(col(name))
                out[name] = total - np.where(first > 0, total[first - 1], 0) + np.where(goes_on, last[name], 0)
            for name, (value, prime) in prints.items():
                p = np.uint64(prime)
                term = col(value).astype(np.uint64) % p * powers(place, prime) % p
                total = np.cumsum(term)
                total = total - np.where(first > 0, total[first - 1], np.uint64(0)) + np.where(goes_on, np.uint64(last[name]), np.uint64(0))
                out[name] = (total % p).astype(np.int64)
                out[f"up_{name}"] = ((total - term) % p).astype(np.int64)
            key, last = keys[-1], {c: int(v[-1]) for c, v in out.items()}
            old = [batch.column(names.index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*old, *[pa.array(out[c].astype(np.int64)) for c in running], batch.column(len(names))], schema.names)

    bound_arrow(spark)
    by = [F.col("conv_id"), *order]
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    table = stored(placed.mapInArrow(local, schema), label)
    ends = F.max_by(F.struct("n", *running[1:]), F.struct("conv_id", "n")).alias("at")
    carried = carry(table.groupBy("_part").agg(F.min("conv_id").alias("_first"), F.max("conv_id").alias("_last"), ends).orderBy("_part").collect(), list(sums), prints)
    brought = T.StructType([T.StructField(c, T.IntegerType() if c == "_part" else T.LongType()) for c in ["_part", "_first", "_n", *[f"_{s}" for s in sums], *[c for p in prints for c in (f"_{p}", f"_power_{p}")]]])
    # one row for each partition: a proven bound
    both = table.join(F.broadcast(spark.createDataFrame(carried, brought)), "_part")
    ours = F.col("conv_id") == F.col("_first")
    new = {"n": F.col("n") + F.col("_n"), **{s: F.col(s) + F.col(f"_{s}") for s in sums}}
    for name, (_, prime) in prints.items():
        for c in (name, f"up_{name}"):
            new[c] = (F.col(c) * F.col(f"_power_{name}") + F.col(f"_{name}")) % prime
    out = both.select(*[f.name for f in kept], *[F.when(ours, new[c]).otherwise(F.col(c)).alias(c) for c in running])
    out._stored_path = table._stored_path  # type: ignore[attr-defined]
    return out


def carry(parts: list, sums: list[str], prints: dict[str, tuple[str, int]]) -> list[tuple]:
    """What the conversation at each partition's start brings along: its rows so far, its sums, its fingerprints and the powers they have reached."""
    out, key, n = [], None, 0
    sum_of, print_of = dict.fromkeys(sums, 0), dict.fromkeys(prints, 0)
    for part in parts:
        if part["_first"] != key:
            n, sum_of, print_of = 0, dict.fromkeys(sums, 0), dict.fromkeys(prints, 0)
        power = {name: pow(BASE, n, prime) for name, (_, prime) in prints.items()}
        out.append((part["_part"], part["_first"], n, *sum_of.values(), *[v for name in prints for v in (print_of[name], power[name])]))
        at, same = part["at"], part["_first"] == part["_last"]
        sum_of = {s: at[s] + (sum_of[s] if same else 0) for s in sums}
        print_of = {name: (at[name] * power[name] + print_of[name]) % prime if same else at[name] for name, (_, prime) in prints.items()}
        key, n = part["_last"], at["n"] + (n if same else 0)
    return out


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role, text, hash and chars of every turn of conversations (conv_id, turn, role, text)."""
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", *filled, F.monotonically_increasing_id().alias("_tie"))
    turns = turns.withColumns({"hash": F.xxhash64("role", "text"), "chars": F.length("text").cast("long")})
    parts = partitions(conversations.sparkSession, conversations.count(), WIDE_ROWS)
    placed = scan(turns, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie")], "turns", parts)
    out = placed.select("conv_id", (F.col("n") - 1).alias("pos"), "role", "text", "hash", "chars")
    out._stored_path = placed._stored_path  # type: ignore[attr-defined]
    return out


def own_paths(turns: DataFrame) -> DataFrame:
    """The turns (see numbered) of every conversation as its path: conv_id, side and pos (in this order), the turn it is, its hash and chars."""
    return turns.select("conv_id", F.lit(1).alias("side"), "pos", F.col("conv_id").alias("from_conv"), F.col("pos").alias("from_pos"), "hash", "chars")


def rebuilt_paths(turns: DataFrame, most: int = 6) -> DataFrame:
    """Paths of conversations that begin with h turns of another one and go on with what their own has after its first h.

    The other one is the conversation whose id is a multiple of 100 just below (by truncation); h is the id's checksum modulo `most`.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    members = turns.filter("pos = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("from_conv"), h.alias("h"))
    heads = own_paths(turns.filter(f"conv_id % 100 = 0 AND pos < {most - 1}")).drop("conv_id", "side")
    copied = heads.join(members, "from_conv").filter("pos < h")
    own = own_paths(turns).filter(F.col("pos") >= h)
    return copied.select("conv_id", F.lit(0).alias("side"), "pos", "from_conv", "from_pos", "hash", "chars").unionByName(own)


def members(turns: DataFrame, paths: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row for each conversation and depth, the root's included: conv_id, KEY and UP (the node and its parent, by fingerprint), the turn, chars."""
    root = turns.filter("pos = 0").select("conv_id", F.lit(-1).alias("side"), F.lit(0).cast("long").alias("pos"), *[F.lit(None).cast("long").alias(c) for c in ("from_conv", "from_pos")], *[F.lit(0).cast("long").alias(c) for c in ("hash", "chars")])
    residues = {f"value_{i}": F.pmod("hash", F.lit(p)) for i, p in enumerate(primes)}
    rows = paths.unionByName(root).withColumns(residues).drop("hash")
    parts = partitions(turns.sparkSession, turns.count(), NARROW_ROWS)
    placed = scan(rows, [F.col("side"), F.col("pos")], "paths", parts, prints={f"print_{i}": (f"value_{i}", p) for i, p in enumerate(primes)})
    both = lambda up: (F.col(f"{up}print_0") * (1 << 31) + F.col(f"{up}print_1"))
    none = F.lit(0).cast("long")
    out = placed.select("conv_id", (F.col("n") - 1).alias("depth"), both("").alias("print"), none.alias("split"), F.when(F.col("n") == 1, -1).otherwise(both("up_")).alias("up_print"), none.alias("up_split"), "from_conv", "from_pos", "chars")
    out._stored_path = placed._stored_path  # type: ignore[attr-defined]
    return out


def verified(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """members' rows, with a split for those whose turn or parent is not that of their group's representative, until all groups are of one node.

    Only groups whose turns come from several places need their texts. A conversation moves from its first collision on; every round
    settles at least the first depth at which there is one.
    """
    while True:
        place, parent = F.struct("from_conv", "from_pos"), F.struct(*UP)
        doubtful = rows.filter("depth > 0").groupBy(*KEY).agg(F.min(place).alias("a"), F.max(place).alias("b"), F.min(parent).alias("c"), F.max(parent).alias("d"))
        doubtful = doubtful.filter("a <> b OR c <> d").select(*KEY)
        found = rows.join(doubtful, KEY).groupBy(*KEY, *UP, "from_conv", "from_pos").agg(F.min("conv_id").alias("low"))
        texts = turns.select(F.col("conv_id").alias("from_conv"), F.col("pos").alias("from_pos"), "role", "text")
        spelt = found.join(texts, ["from_conv", "from_pos"])
        kinds = spelt.groupBy(*KEY, *UP, "role", "text").agg(F.min("low").alias("of"))
        mixed = stored(kinds.groupBy(*KEY).agg(F.min("of").alias("least"), F.count("*").alias("kinds")).filter("kinds > 1"), "collisions")
        if mixed.isEmpty():
            discard(mixed)
            return rows
        kind = kinds.join(mixed, KEY)
        moved = spelt.join(kind, [*KEY, *UP, "role", "text"]).filter("of <> least").select(*KEY, *UP, "from_conv", "from_pos", "of")
        at = rows.join(moved, [*KEY, *UP, "from_conv", "from_pos"]).groupBy("conv_id").agg(F.min(F.struct("depth", F.xxhash64("split", "depth", "of").alias("to"))).alias("at"))
        both = rows.join(at, "conv_id", "left")
        beyond = lambda depth, old: F.when(F.col("at.depth") <= depth, F.col("at.to")).otherwise(F.col(old))
        new = stored(both.withColumns({"split": beyond(F.col("depth"), "split"), "up_split": beyond(F.col("depth") - 1, "up_split")}).drop("at"), "paths")
        discard(rows, mixed)
        rows = new


def ends_digests(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256: the checksum of each node's conv_ids, ascending and comma-joined.

    Ids are sorted over all partitions and packed into blocks; only blocks meet, and they are read one after the other.
    """
    order = [*KEY, "conv_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in held[0]] + [pa.array([",".join(str(r[-1]) for r in held)])], [*KEY, "first", "ids"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (row[:-1] != held[0][:-1] or len(held) == BLOCK_IDS):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], [*KEY, "ends_sha256"])
        for batch in batches:
            for *node, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key == node:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    yield done()
                key, state = node, hashlib.sha256(ids.encode())
        if key is not None:
            yield done()

    bound_arrow(ends.sparkSession)
    parts = partitions(ends.sparkSession, ends.count(), NARROW_ROWS)
    blocks = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "depth long, print long, split long, first long, ids string")
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth long, print long, split long, ends_sha256 string")


def prefix_trie(turns: DataFrame, paths: DataFrame | None = None, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row for each node: conv_id (its representative), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: see numbered; paths: see own_paths, which is the default. saved_tokens of a node adds up, over its subtree, the code points that
    repeating members spend on each node's last text.
    """
    rows = verified(members(turns, paths if paths is not None else own_paths(turns), primes), turns)
    nodes = stored(rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *[F.min(c).alias(c) for c in UP]), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_print").alias("print"), F.col("up_split").alias("split")).agg(F.count("*").alias("n_children"))
    nodes_of = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = stored(nodes_of, "nodes")
    # a node counts for its representative alone: (conv_id, depth) is unique on both sides
    own = known.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    paid = rows.select("conv_id", *KEY).join(own, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaf"])
    below = scan(paid, [F.col("depth").desc()], "below", partitions(rows.sparkSession, turns.count(), NARROW_ROWS), sums=["saved", "leaf"])
    sums = below.groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    digests = ends_digests(below.filter("n = 1"))
    root = known.filter("depth = 0").agg(F.min("conv_id")).first()[0]
    # the root is no one's match here: all first turns would meet at it
    known = known.withColumn("up_print", F.when(F.col("depth") == 1, -2 - F.col("conv_id")).otherwise(F.col("up_print")))
    parents = known.filter("depth > 0 AND n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("print").alias("up_print"), F.col("split").alias("up_split"), F.col("conv_id").alias("above"))
    out = known.join(sums, KEY).join(digests, KEY, "left").join(parents, ["depth", *UP], "left")
    parent = F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("above")).cast("long")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
