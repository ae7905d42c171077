"""Language identification with a byte-level convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's maximum over the window is
rectified, and a softmax layer gives the classes. The network is trained in numpy on windows of labelled texts (a
bounded sample) and applied to every window of every text; a text's score is the mean of its windows' probabilities,
weighted by their bytes.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything when nothing could be learned;
null languages and null ids are not learned from; null ids are not held out; repeated rows get equal results; an empty
table gives an empty table; other columns are ignored; long texts are classified in blocks of windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, drawn, slices, stored

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 24
DIM = 8
#: Training windows, at most, and windows that a single text may offer.
SAMPLE = 8192
EACH = 2
EPOCHS = 5
BATCH = 128
#: Windows convolved at once when texts are classified.
BLOCK = 128


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows(data: bytes) -> np.ndarray:
    """The text's bytes in rows of WINDOW, the last one filled with zeros."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    classes: list[str]
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # widest width * DIM x all filters; narrower ones are zero beyond their width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, rows: np.ndarray) -> np.ndarray:
        """(windows * positions) x (widest width * DIM): the embedded bytes below the filters at each position."""
        wide = max(WIDTHS)
        padded = np.zeros((len(rows), WINDOW + wide - 1), np.uint8)
        padded[:, :WINDOW] = rows
        x = self.embed[padded].reshape(len(rows), -1)
        view = np.lib.stride_tricks.as_strided(x, (len(rows), WINDOW, wide * DIM), (x.strides[0], DIM * x.itemsize, x.itemsize))
        return view.reshape(-1, wide * DIM)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(rows), BLOCK):
            part = rows[i : i + BLOCK]
            z = (self.patches(part) @ self.filters).reshape(len(part), WINDOW, -1).max(axis=1)
            out.append(softmax(np.maximum(z + self.bias, 0) @ self.out + self.out_bias))
        return np.concatenate(out)

    def slopes(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The weighted mean cross-entropy of windows of classes y, and its derivatives by embed, filters, bias, out and out_bias."""
        b, wide = len(rows), max(WIDTHS)
        patches = self.patches(rows)
        z = (patches @ self.filters).reshape(b, WINDOW, -1)
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias
        hidden = np.maximum(top, 0)
        p = softmax(hidden @ self.out + self.out_bias)
        loss = float(-(weight * np.log(p[np.arange(b), y])).mean())
        p[np.arange(b), y] -= 1
        delta = (p * weight[:, None] / b).astype(self.out.dtype)
        back = (delta @ self.out.T) * (top > 0)
        hit = patches.reshape(b, WINDOW, -1)[np.arange(b)[:, None], at]  # b x filters x wide * DIM
        g_filters = np.einsum("bf,bfk->kf", back, hit) * alive()
        padded = np.zeros((b, WINDOW + wide - 1), np.uint8)
        padded[:, :WINDOW] = rows
        under = padded[np.arange(b)[:, None, None], at[:, :, None] + np.arange(wide)]
        spread = (back[:, :, None] * self.filters.T[None]).reshape(-1, DIM)
        g_embed = np.stack([np.bincount(under.ravel(), spread[:, d], 256) for d in range(DIM)], axis=1)
        return loss, [g_embed, g_filters, back.sum(0), hidden.T @ delta, delta.sum(0)]


def alive() -> np.ndarray:
    """1 where a filter has a weight: narrower ones end before the widest."""
    out = np.zeros((max(WIDTHS) * DIM, FILTERS * len(WIDTHS)), np.float32)
    for k, w in enumerate(WIDTHS):
        out[: w * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: list[str], seed: int = 5, rate: float = 0.01) -> Network | None:
    """rows: windows x WINDOW bytes. Adam on cross-entropy, classes weighted by the root of their rarity."""
    classes = sorted(set(labels))
    if not classes:
        return None
    y = np.array([classes.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    wide, total, f32 = max(WIDTHS), FILTERS * len(WIDTHS), np.float32
    net = Network(classes, rng.normal(0, 0.5, (256, DIM)).astype(f32), (rng.normal(0, 0.3, (wide * DIM, total)) * alive()).astype(f32), np.zeros(total, f32), rng.normal(0, 0.1, (total, len(classes))).astype(f32), np.zeros(len(classes), f32))
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rarity = np.sqrt(len(y) / len(classes) / np.bincount(y, minlength=len(classes)))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick = order[i : i + BATCH]
            _, grads = net.slopes(rows[pick], y[pick], rarity[y[pick]])
            step += 1
            pace = rate * (1 - 0.8 * epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (pace * m / (np.sqrt(v) + 1e-8)).astype(f32)
    return net


def training_windows(docs: DataFrame, most: int = SAMPLE, each: int = EACH) -> DataFrame:
    """window, lang: at most `most` different windows of labelled texts that are not held out, up to `each` of a text.

    About twice as many texts are drawn by their hash; of their windows the ones whose checksums are lowest are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, langs, keys = [], [], []
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    data = text.encode("utf-8", "replace")
                    for k in range(each if len(data) > WINDOW else 1):
                        seed = zlib.crc32(data, k)
                        start = seed % max(1, len(data) - WINDOW + 1)
                        rows.append(data[start : start + WINDOW])
                        langs.append(lang)
                        keys.append(zlib.crc32(rows[-1], seed))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(langs, pa.string()), pa.array(keys, pa.int64())], ["window", "lang", "key"])

    bound_arrow(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    some = drawn(known.select("text", "lang"), ["text"], most).drop("_draw")
    offered = stored(some.mapInArrow(run, "window binary, lang string, key long").dropDuplicates(["window", "lang"]), "language-windows")
    return offered.orderBy("key", "window", "lang").limit(most)


def fit(docs: DataFrame, most: int = SAMPLE) -> Network | None:
    rows = training_windows(docs, most).collect()
    data = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        data[i, : len(r["window"])] = np.frombuffer(bytes(r["window"]), np.uint8)
    return train(data, [r["lang"] for r in rows])


def classify(texts: list[str | None], net: Network | None) -> list[tuple[str, float]]:
    """Language and score of each text; the texts' windows go through the network together."""
    known = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
    out = [("und", 0.0)] * len(texts)
    if not known:
        return out
    data = [texts[i].encode("utf-8", "replace") for i in known]
    counts = np.array([-(-len(x) // WINDOW) for x in data])
    weights = np.full(counts.sum(), float(WINDOW))
    ends = np.cumsum(counts)
    weights[ends - 1] = [len(x) - (n - 1) * WINDOW for x, n in zip(data, counts, strict=True)]
    p = net.probabilities(np.concatenate([windows(x) for x in data])) * weights[:, None]
    means = np.add.reduceat(p, ends - counts, axis=0) / np.array([len(x) for x in data])[:, None]
    for i, m in zip(known, means, strict=True):
        out[i] = (net.classes[int(m.argmax())], float(min(1.0, m.max())))
    return out


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                langs, scores = zip(*classify(part.column("text").to_pylist(), net), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    bound_arrow(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
