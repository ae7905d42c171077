"""Bootstrapping to its fixed point."""

from gleaner.llm import pii


def test_what_is_found_leads_on_however_far(spark):
    sizes = [5120, 1280, 320, 80, 20, 5]  # of each generation; each shares a pattern with the one before
    rows, at = [], 0
    for g, n in enumerate(sizes):
        for i in range(n):
            for pattern in {g - 1, g} - {-1, len(sizes) - 1}:
                rows.append((at, 0, 5, g == 0, g == 0, False, 10_000 * g + i, pattern))
            at += 1
    # the last pattern also has what failed a test, and another one only that
    rows += [(at, 0, 5, False, False, True, 99_000, len(sizes) - 2), (at + 1, 0, 5, False, False, True, 99_001, 77), (at + 2, 0, 5, False, False, False, 99_002, 77)]
    tokens = spark.createDataFrame(rows, "row long, start long, end long, base boolean, seed boolean, failed boolean, instance long, pattern long")
    got = {r["row"] for r in pii.bootstrapped(tokens).collect()}
    assert got == set(range(sizes[0], at)) | {at}
