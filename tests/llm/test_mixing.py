"""Weighted fair queueing against a plain version of it, on made documents and on the given tables."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing


def plain(rows, weights=(1, 2, 3), repeats=3):
    """rows: doc_id, source, size, dice. taken by document, and targets by source."""
    queues = defaultdict(list)
    for doc, source, size, dice in rows:
        queues[source].append((dice, doc, size))
    names = sorted(queues, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(x[2] for x in queues[s]) for s in names}
    budget, full = sum(total.values()), set()
    while True:
        left = budget - sum(repeats * total[s] for s in full)
        share = sum(w for s, w in weight.items() if s not in full)
        target = {s: float(repeats * total[s]) if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > repeats * total[s]}
        if not over:
            break
        full |= over
    events = []
    for s in names:
        seen = 0
        for dice, doc, size in sorted(queues[s]):
            seen += size
            for turn in range(min(repeats, int(target[s] // total[s]) + 1) if total[s] else 1):
                events.append(((turn * total[s] + seen) / target[s] if target[s] else 0.0, dice, turn, doc, s, size))
    sent, taken, got, rest = 0, defaultdict(int), defaultdict(int), defaultdict(list)
    for _, dice, turn, doc, s, size in sorted(events, key=lambda e: e[:4]):
        sent += size
        if sent <= budget:
            taken[doc] += size
            got[s] += size
        elif size:
            rest[s].append((size, dice, turn, doc))
    for s in names:
        lacks, used = target[s] - got[s], 0
        for size, _, _, doc in sorted(rest[s]):
            if size <= lacks and used + size <= lacks:
                used += size
                taken[doc] += size
    return taken, target


def compared(docs):
    dice = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(17))
    rows = [tuple(r) for r in docs.select("doc_id", "source", mixing.word_count(F.col("text")), dice).collect()]
    got = mixing.mix(docs).collect()
    taken, target = plain(rows)
    assert {r["doc_id"]: r["taken"] for r in got} == {r[0]: taken[r[0]] for r in rows}
    assert all(r["target"] == pytest.approx(target[r["source"]], rel=1e-9) for r in got)
    return got


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_tables_come_near_their_targets(spark, sf):
    got = compared(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    sums, left, target = defaultdict(int), defaultdict(list), {}
    for r in got:
        sums[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        if 0 < r["size"] and r["taken"] < r["size"]:
            left[r["source"]].append(r["size"])
    for s, words in sums.items():
        print(sf, s, words, round(target[s]))
        assert target[s] - words <= min(left[s], default=target[s]) and words - target[s] <= max(r["size"] for r in got if r["source"] == s)
        assert abs(words - target[s]) <= 0.02 * target[s] + 10


def test_made_documents(spark):
    rows = [(i, "w " * (i * 7919 % 53), ["a", "b", "c", None][i % 7 % 4]) for i in range(400)] + [(1000, "w " * 3000, "a"), (1001, "w " * 900, "d"), (1002, None, "e"), (1003, "", None)]
    compared(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
