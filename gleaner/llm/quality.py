"""Quality rules with risk-controlled thresholds.

A rule rejects a text whose statistic lies above a cutoff. Labelled texts are split by a hash of the text, copies counted
once. One part, of bounded size, orders the cutoffs of all rules into one chain of joint settings, each a little stricter than
the one before: the cutoff that catches most bad texts for each good one lost comes next. The other part is the holdout: in
each stratum the settings are tested in the chain's order, and one is safe if the exact binomial tail says that a true loss of more
than `risk` of the good texts would hardly lose so few. Testing in a fixed order, on labels that had no part in it, needs no
further correction; the level is divided by the number of strata. Of the safe settings, the most lenient one is taken that catches nearly
as many bad texts of the holdout as the best. With probability 1 - level, every stratum loses at most `risk` of its good texts.

Defined cases: a null or empty text has zero counts and fails the base rule; a null stratum is a stratum of its own; null labels are left
out, repeated ones count once, a text with both labels counts as either; a stratum with too few labelled good texts (144 for 4
strata) gets no cutoff; repeated rows are judged alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound_arrow, discard, drawn, slices, stored

RISK = 0.03
LEVEL = 0.05
WINDOW = 5
#: Strata up to this number are broadcast with their cutoffs; more are joined by their key.
BROADCAST_STRATA = 10_000
#: A cutoff must catch this share of what the best safe one catches.
NEARLY = 0.98
#: One in so many labelled texts orders the settings, up to a number of texts; all others are the holdout.
FIT_SHARE = 5
FIT_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
FIND = re.compile(WORD)
LETTER = re.compile(r"[^\W\d_]")
#: Rules and their cutoffs, from lenient to strict; a text is rejected whose statistic is above the cutoff.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04],
    "repeat_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1],
    "dup_line_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "capital_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "mark_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "letterless_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "brevity": [1 / 3, 1 / 5, 1 / 8, 1 / 12, 1 / 16, 1 / 24],
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found at least twice in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    key, size = codes, len(number)
    done = 1
    while done < width:  # extend by one word; renumber where numbers would overflow
        if size * len(number) >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            size = len(seen)
        key = key[: len(codes) - done] * len(number) + codes[done:]
        size *= len(number)
        done += 1
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[:n] += again
    edge[width:] -= again
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def statistics(text: str) -> tuple:
    """The base counts, whether the base rule fails, and the rules' statistics."""
    words = FIND.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    letters = [w for w in words if LETTER.search(w)]
    capital = sum(map(str.isupper, letters))
    marks = sum(1 for w in words if w[-1] in "!?")
    some = max(1, n)
    rates = (symbols / max(1, chars), repeats / some, dup / max(1, len(lines)), capital / some, marks / some, (n - len(letters)) / some, 1 / some)
    return (n, chars, symbols, dup, repeats, failed, *map(float, rates))


def text_statistics(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum, text_hash, the counts, base_failed and a column for each rule, for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [(c, pa.int64()) for c in COUNTS] + [("base_failed", pa.bool_())] + [(r, pa.float64()) for r in RULES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                cols = zip(*(statistics(t or "") for t in part.column("text").to_pylist()), strict=True)
                made = [pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("stratum"), part.column("text_hash"), *made], ["doc_id", "stratum", "text_hash", *[n for n, _ in fields]])

    bound_arrow(docs.sparkSession)
    schema = f"doc_id {kind}, stratum string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{r} double" for r in RULES)
    named = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))
    return docs.select("doc_id", named.alias("stratum"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials of probability p, summed from the largest term down."""
    if k >= n:
        return 1.0
    top = min(k, int((n + 1) * p))
    first = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    total, term, i = 1.0, 1.0, top
    while i > 0 and term > 1e-18 * total:
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        i -= 1
    term, i = 1.0, top
    while i < k and term > 1e-18 * total:
        term *= (n - i) * p / ((i + 1) * (1 - p))
        total += term
        i += 1
    return min(1.0, math.exp(first + math.log(total)))


Chain = list[tuple[str, float]]


def order_settings(good: dict[str, np.ndarray], bad: dict[str, np.ndarray]) -> Chain:
    """good, bad: the rules' statistics of labelled texts. Every rule's cutoffs in the order in which they are to be tightened.

    Next comes the cutoff that rejects most further bad texts for each further good one, and of equal ones the most lenient.
    """
    rest = {"good": good, "bad": bad}
    open_ = {k: np.ones(len(next(iter(v.values()))), bool) for k, v in rest.items()}
    done = dict.fromkeys(RULES, 0)
    caught = dict.fromkeys(RULES, 0)
    chain: Chain = []
    while any(done[r] < len(cuts) for r, cuts in RULES.items()):
        options = []
        for r, cuts in RULES.items():
            for k in range(done[r], len(cuts)):
                b, g = (int(np.count_nonzero(open_[x] & (rest[x][r] > cuts[k]))) for x in ("bad", "good"))
                # without further bad texts, one notch of the rule that costs least and has caught most
                options.append((b == 0, -b / (g + 0.5) if b else g, -caught[r], k - done[r], r, k, b))
        _, _, _, _, r, k, b = min(options)
        chain += [(r, c) for c in RULES[r][done[r] : k + 1]]
        caught[r] += b
        done[r] = k + 1
        for x in open_:
            open_[x] &= ~(rest[x][r] > RULES[r][k])
    return chain


def safe_setting(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int:
    """good[i], bad[i]: texts that the first i + 1 cutoffs of the chain reject and fewer do not; the last entry, those that none rejects.

    The number of cutoffs to apply.
    """
    n = int(good.sum())
    lost, caught = np.cumsum(good[:-1]), np.cumsum(bad[:-1])
    safe = 0
    while safe < len(lost) and n and lost[safe] <= risk * n and tail(int(lost[safe]), n, risk) <= level:
        safe += 1
    if not safe or not caught[safe - 1]:
        return 0
    return int(np.argmax(caught[:safe] >= NEARLY * caught[safe - 1])) + 1


def rejected_at(chain: Chain) -> Column:
    """The place in the chain of the first cutoff that rejects the row; the chain's length if none does."""
    first = [F.lit(len(chain))]
    for r in RULES:
        step = None
        for i, (name, cut) in enumerate(chain):
            if name == r:
                step = F.when(F.col(r) > cut, i) if step is None else step.when(F.col(r) > cut, i)
        first.append(step.otherwise(len(chain)))
    return F.least(*first)


def judged_labels(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, quality and the rules' statistics of every labelled text that the base rule keeps, once for each stratum and label; fits says which part it is in."""
    known = labels.filter("quality IS NOT NULL").select("doc_id", "quality").join(stats.filter("NOT base_failed"), "doc_id")
    once = known.dropDuplicates(["stratum", "text_hash", "quality"])
    return once.select("stratum", "quality", "text_hash", *RULES, (F.pmod(F.xxhash64("text_hash"), F.lit(FIT_SHARE)) == 0).alias("fits"))


def fit_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, most: int = FIT_ROWS) -> DataFrame:
    """One row for each stratum: stratum and a cutoff for each rule (infinity: none). At most `most` texts order the settings."""
    judged = stored(judged_labels(stats, labels), "quality-labels")
    some = drawn(judged.filter("fits"), ["text_hash"], most, seed=1)
    rows = some.orderBy("_draw", "text_hash", "stratum", "quality").limit(most).select("quality", *RULES).toPandas()
    good, bad = ({r: x[r].to_numpy(float) for r in RULES} for x in (rows[rows["quality"] == 1], rows[rows["quality"] != 1]))
    chain = order_settings(good, bad)
    held = judged.filter("NOT fits")
    counted = held.groupBy("stratum", "quality", rejected_at(chain).alias("at")).count()
    counted = stored(counted, "quality-counts")  # strata x settings x labels at most
    strata = max(1, counted.select("stratum").distinct().count())
    discard(judged)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        good, bad = (np.bincount(x["at"], x["count"], len(chain) + 1).astype(np.int64) for x in (rows[rows["quality"] == 1], rows[rows["quality"] != 1]))
        taken = dict(chain[: safe_setting(good, bad, risk, level / strata)])
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]]} | {f"cut_{r}": [taken.get(r, math.inf)] for r in RULES})

    return counted.groupBy("stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, the counts, base_failed, kept and failed_rules for every row of docs (doc_id, text, the stratum's column)."""
    stats = stored(text_statistics(docs, stratum), "quality-statistics")
    cutoffs = stored(fit_cutoffs(stats, labels, risk, level), "quality-cutoffs")
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    both = stats.join(cutoffs, "stratum", "left")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), r) for r in RULES]), lambda x: x.isNotNull())
    both = both.withColumn("failed_rules", F.concat_ws(",", failed))
    return both.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")
