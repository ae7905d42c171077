"""The prefix trie against dictionaries of prefixes, with fingerprints that collide and with conversations across partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gleaner.llm import trie
from gleaner.llm.queries import queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, n long, depth string"


def ordered(rows):
    talks = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            talks[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in talks.items()}


def rebuilt(talks):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in talks}
    return {c: talks.get(c - c % 100, [])[: h[c]] + turns[h[c] :] for c, turns in talks.items()}


def plain(talks):
    members = defaultdict(list)
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            members[tuple(talks[c][:d])].append(c)
    out = set()
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        under = [m for m in members if m[: len(node)] == node]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in under if m)
        ends = ",".join(str(c) for c in convs if len(talks[c]) == len(node))
        out.add((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), children[node], sum(not children[m] for m in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, convs=140, words="abc"):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"]), "".join(rng.choices(words, k=rng.randint(0, 2)))) for c in range(convs) for t in range(rng.randint(1, 9))]
    return [(*r, 1, "x") for r in rows]


EDGE = [(5, None, None, None, None, None), (5, None, "user", "first", 1, "x"), (5, 1, "user", "é" * 200_000, 1, "x"), (5, 1, "user", "é" * 200_000, 1, "x"), (None, 1, "user", "lost", 1, "x"), (0, 0, "user", "a", 1, "x"), (7, 3, "bot", "", 1, "x"), (7, 2, None, "", 1, "x"), (9, 1, "user", "a", 1, "x")]


@pytest.mark.parametrize("primes", [trie.PRIMES, (7, 5), (3, 2)])
def test_rebuilt_conversations(spark, primes):
    rows = made(1) + [(300 + i, t, "user", "same", 1, "x") for i in range(60) for t in range(8)]
    turns = trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = trie.prefix_trie(turns, trie.rebuilt_paths(turns), primes)
    assert got.columns == COLUMNS
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rebuilt(ordered(rows)))


@pytest.mark.parametrize("primes", [trie.PRIMES, (3, 2)])
def test_one_conversation_over_all_partitions(spark, primes):
    rng = random.Random(2)
    rows = [(4, t, "user", rng.choice("ab"), 1, "x") for t in range(400)]
    rows += [(c, t, r, x, 1, "x") for c in (3, 6) for _, t, r, x, *_ in rows[: 250 + c]] + [(4, None, "user", "start", 1, "x"), (8, 0, "user", "start", 1, "x")]
    turns = trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert {tuple(r) for r in trie.prefix_trie(turns, None, primes).collect()} == plain(ordered(rows))


def test_defined_cases(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    turns = trie.numbered(df)
    assert {tuple(r) for r in trie.prefix_trie(turns).collect()} == plain(ordered(EDGE))
    assert {tuple(r) for r in trie.prefix_trie(turns, trie.rebuilt_paths(turns)).collect()} == plain(rebuilt(ordered(EDGE)))
    assert {r["conv_id"]: r["n"] for r in turns.groupBy("conv_id").agg({"*": "count"}).toDF("conv_id", "n").collect()} == {5: 4, 0: 1, 7: 2, 9: 1}
    none = trie.numbered(df.limit(0))
    assert trie.prefix_trie(none).count() == 0 and trie.prefix_trie(none, trie.rebuilt_paths(none)).count() == 0


def test_ids_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_IDS", 3)
    rows = [(c, 0, "user", "same", 1, "x") for c in range(-5, 115)]
    turns = trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert {tuple(r) for r in trie.prefix_trie(turns).collect()} == plain(ordered(rows))


def test_query(spark):
    data = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries()["op11_prefix_trie"](spark, data).collect()} == plain(rebuilt(ordered(rows)))
