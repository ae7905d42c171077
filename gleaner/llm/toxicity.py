"""Toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (word beginnings) that a bounded sample of labelled training rows
suggests, plus a few patterns of style. A generative label model, in which the given label is one more voter that may
err, estimates by expectation maximisation how often each voter fires on toxic and on other texts, and how voters
correlate given the class; correlated voters share their weight. A linear classifier on the votes is then trained on
the posterior labels and scores every whole text.

Defined cases: null and empty texts have no votes and get the classifier's base score; without training rows of both classes
every score is the share of toxic rows (0 without any); null ids are never training rows and not held out; repeated
rows score alike; an empty table gives an empty table; other columns, of whatever names, are ignored or kept as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, drawn, slices

#: Labelled rows used for training, at most, those whose ids hash lowest, and the bytes of their texts.
SAMPLE = 8000
SAMPLE_BYTES = 64 << 20
#: Voters of each kind, at most.
VOTERS = 96
BEGINNINGS = (3, 4, 5, 6)
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
STYLE = ("shouting", "exclaiming", "short")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def style(text: str) -> list[str]:
    """Pattern voters that do not depend on words."""
    capitals = sum(map(str.isupper, text))
    return [name for name, on in zip(STYLE, (2 * capitals > len(text), 50 * text.count("!") > len(text), len(text) < 60), strict=True) if on]


def beginnings(words: set[str], lengths: tuple[int, ...]) -> set[str]:
    return {w[:n] for n in lengths for w in words if len(w) > n}


@dataclass
class Model:
    """Voters by number, the classifier's weights for their votes, for the log of the number of votes, and its offset."""

    words: dict[str, int]
    starts: dict[str, int]
    weights: np.ndarray
    offset: float

    def votes(self, text: str) -> list[int]:
        found = set(LETTERS.findall(text.lower()))
        out = [self.words[w] for w in found & self.words.keys()]
        if self.starts:
            out += [self.starts[p] for p in beginnings(found, tuple(sorted({len(p) for p in self.starts}))) & self.starts.keys()]
        base = len(self.words) + len(self.starts)
        return out + [base + STYLE.index(s) for s in style(text)]

    def score(self, text: str) -> float:
        votes = self.votes(text)
        z = self.offset + float(self.weights[votes].sum()) + float(self.weights[-1]) * np.log1p(sum(v < len(self.weights) - 1 - len(STYLE) for v in votes))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def suggest(texts: list[str], toxic: np.ndarray, lengths: tuple[int, ...], most: int) -> list[str]:
    """The words (no lengths) or beginnings that speak most clearly for the toxic class.

    Those that a chosen shorter one covers are left out. Features are counted in toxic texts first, and in the others
    only if they are frequent enough there.
    """

    def features(text: str) -> set[str]:
        found = set(LETTERS.findall(text.lower()))
        return beginnings(found, lengths) if lengths else found

    n_yes, n_no = int(toxic.sum()), int(len(toxic) - toxic.sum())
    least = max(3, round(0.01 * n_yes))
    yes: Counter[str] = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if y:
            yes.update(features(t))
    yes = Counter({f: k for f, k in yes.items() if k >= least})
    no: Counter[str] = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            no.update(features(t) & yes.keys())
    rated = []
    for f, k in yes.items():
        rate, other = k / n_yes, (no[f] + 0.5) / (n_no + 1)
        if rate > 8 * other:
            rated.append((-k * np.log(rate / other), len(f), f))
    chosen: list[str] = []
    for _, _, f in sorted(rated):
        if len(chosen) == most:
            break
        if not any(f.startswith(c) and 20 * (yes[c] - yes[f]) <= yes[c] or c.startswith(f) for c in chosen):
            chosen.append(f)
    return chosen


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 30, same: float = 0.3) -> np.ndarray:
    """Posterior of the toxic class for each row, from votes (rows x voters, 0 or 1) and the label as one more voter.

    Each voter fires with a rate of its own on either class, so that its silence counts as well, and the label errs with a rate of its own. What
    the classes leave unexplained gives the voters' correlations: those above `same` share the weight of one vote.
    """
    fired = np.asarray(votes, float)
    rows = len(fired)
    posterior = np.where(label == 1, 0.9, 0.1)
    for _ in range(rounds):
        n_yes, n_no = posterior.sum(), (1 - posterior).sum()
        on = np.clip((posterior @ fired + 0.5) / (n_yes + 1), 1e-4, 1 - 1e-4)
        off = np.clip(((1 - posterior) @ fired + 0.5) / (n_no + 1), 1e-4, 1 - 1e-4)
        rest = fired - np.outer(posterior, on) - np.outer(1 - posterior, off)
        rest /= np.sqrt((rest**2).mean(0)) + 1e-9
        together = rest.T @ rest / rows
        weight = 1 / np.maximum(1, np.where(together > same, together, 0).sum(1))
        hit = np.clip((posterior @ label + 0.5) / (n_yes + 1), 1e-3, 1 - 1e-3)
        slip = np.clip(((1 - posterior) @ label + 0.5) / (n_no + 1), 1e-3, 1 - 1e-3)
        given = np.where(label == 1, np.log(hit / slip), np.log((1 - hit) / (1 - slip)))
        voted = fired @ (weight * np.log(on / off)) + (1 - fired) @ (weight * np.log((1 - on) / (1 - off)))
        new = 1 / (1 + np.exp(-np.clip(np.log((n_yes + 0.5) / (n_no + 0.5)) + voted + given, -30, 30)))
        if np.abs(new - posterior).max() < 1e-6:
            break
        posterior = new
    return posterior


def linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.05, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft targets by Newton's method; the last weight is the offset and not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - target) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: list[str], labels: list[int]) -> Model:
    toxic = np.array(labels, int)
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < toxic.sum() < len(toxic):
        rest = np.log(max(share, 1e-9) / max(1 - share, 1e-9)) if share else -30.0
        return Model({}, {}, np.zeros(len(STYLE) + 1), float(rest))
    lexicon = suggest(texts, toxic, (), VOTERS)
    starts = suggest(texts, toxic, BEGINNINGS, VOTERS)
    model = Model({w: i for i, w in enumerate(lexicon)}, {p: i + len(lexicon) for i, p in enumerate(starts)}, np.zeros(0), 0.0)
    n = len(lexicon) + len(starts) + len(STYLE)
    votes = np.zeros((len(texts), n))
    for i, t in enumerate(texts):
        votes[i, model.votes(t)] = 1
    posterior = label_model(votes, toxic)
    fired = np.log1p(votes[:, : n - len(STYLE)].sum(1))
    w = linear(np.column_stack([votes, fired]), posterior)
    return Model(model.words, model.starts, w[:-1], float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text, toxic of at most `most` labelled rows that are not held out, in all `most_bytes` long.

    Of rows with one id, one text counts; texts are taken by the hash of their ids until the bytes are full.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = drawn(known.select("doc_id", "toxic").distinct(), ["doc_id"], most)
    chosen = F.broadcast(some.orderBy("_draw", "doc_id", "toxic").limit(most).drop("_draw"))  # at most `most` rows of two numbers
    found = docs.select("doc_id", "text").join(chosen, "doc_id")
    one = F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("hash")))
    sizes = found.groupBy("doc_id", "toxic").agg(one.alias("_one")).select("doc_id", "toxic", "_one.*").collect()
    sizes.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["toxic"]))
    taken, held = [], 0
    for r in sizes:
        if held + r["size"] <= most_bytes:
            held += r["size"]
            taken.append((r["doc_id"], r["toxic"], r["hash"]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(taken, f"doc_id {kind}, toxic int, _hash long")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).join(F.broadcast(wanted), ["doc_id", "_hash"])
    return texts.select("doc_id", "toxic", "text").dropDuplicates(["doc_id", "toxic"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, most).collect()
    rows.sort(key=lambda r: (r["text"] or "", r["toxic"]))
    return train([r["text"] or "" for r in rows], [int(r["toxic"]) for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = [model.score(t or "") for t in part.column("text").to_pylist()]
                toxic = [int(s >= threshold) for s in scores]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array(toxic, pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    bound_arrow(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array([model.score(t or "") < threshold for t in part.column("text").to_pylist()]))

    bound_arrow(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
