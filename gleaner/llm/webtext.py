"""The main text of web pages, by a recurrent labeller of blocks.

A page becomes its sequence of leaf blocks. A block is a vector of the tokens of its tag path (element names, class and
id parts, how long it is and how much of it is linked) and a vector of its hashed words, both sums of learned vectors. A bidirectional LSTM reads all
blocks of the page, so that each one is classified with the whole document in view.

The network is trained in numpy on a bounded sample of the table's pages. Their labels come from elements and names that say what they are
(FRAME, BODY); half of each training batch are pages put together anew, the sample's texts in other frames, so that layouts that the table has
nowhere are known too; names are left out and texts exchanged at random, so that no single one decides.

Defined cases: null and empty pages, and pages without any text, have the empty text; a page without markup is one block; unclosed, unopened
and broken markup is read as far as it goes; repeated rows get equal results; without any text in the sample nothing is main text; an empty
table gives an empty table; null ids and urls stay; other columns, of whatever names, are kept as they are.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, drawn, slices

#: Training pages, at most, and the bytes of each, at most.
SAMPLE = 400
SAMPLE_BYTES = 1 << 16
BUCKETS = 2048
DIM = 16
HIDDEN = 24
EPOCHS = 16
BATCH = 32
#: Blocks, with padding, that go through the network at once.
SLOTS = 1 << 15

#: Fixed values of the HTML standard: elements whose content is no text, that never have any, and that end at a block's edge.
RAW = {"script", "style", "title", "textarea", "template", "iframe", "noscript", "svg", "math", "object", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An element that starts closes open ones of these names, up to the nearest of the element's own scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "article", "section", "main", "div", "body"}

#: Names of elements, classes and ids that tell what a region is.
FRAME = {
    "header": "header banner masthead logo topbar brand",
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs pagination pager toc tabs",
    "aside": "aside sidebar related widget recommended trending tags tag share social rail complementary popular also",
    "footer": "footer copyright legal colophon imprint credits contentinfo bottom",
    "div": "ad ads advert adverts advertisement promo sponsor sponsored banner teaser",
    "section": "comments comment reply replies respond disqus discussion feedback commentlist",
    "form": "form newsletter subscribe signup login search subscription register contact field input button",
    "p": "cookie cookies consent notice notices alert gdpr popup modal warning message overlay disclaimer paywall",
}
BODY = {"article", "main", "content", "post", "entry", "story", "body", "text", "prose"}
TELLING = {name for names in FRAME.values() for name in names.split()} | {"label", "select", "option"}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[^\W_]+")


@dataclass
class Block:
    """One block: the tokens of its path, from the outermost element, its text and how many of its characters are linked."""

    path: list[str]
    text: str
    linked: int = 0

    def tokens(self) -> list[str]:
        leaf = next((t for t in reversed(self.path) if t[0] != "."), "")
        return [*dict.fromkeys(self.path), f"in={leaf}", f"size={len(self.text).bit_length()}", f"links={4 * self.linked // max(1, len(self.text))}"]


@dataclass
class Reader:
    """Open elements and the text since the last block's edge."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, list[str]]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def edge(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            self.blocks.append(Block([t for name, parts in self.open if name not in INLINE for t in (name, *parts)], text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def said(self, text: str) -> None:
        self.parts.append(text)
        if any(name == "a" for name, _ in self.open[-8:]):
            self.linked += len(text)

    def start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.edge()
            if name not in VOID and self.open:
                ends = {"p"} | CLOSES.get(name, set())
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in ends:
                        del self.open[i:]
                    elif self.open[i][0] in SCOPE:
                        break
                while self.open and self.open[-1][0] in INLINE:
                    self.open.pop()
        if name not in VOID:
            parts = ["." + p for m in NAMED.finditer(attributes) for p in PART.findall((m[2] or m[3] or m[4] or "").lower())] if attributes else []
            self.open.append((name, parts))

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.edge()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                return
            if name in INLINE and self.open[i][0] not in INLINE:
                return


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: text between edges of block elements, references decoded, white space made one space."""
    reader, at, n, quoted = Reader(), 0, len(page), True
    raw_end: dict[str, int] = {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            reader.said(page[at:])
            break
        if lt > at:
            reader.said(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            at = n if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
            continue
        m = TAG.match(page, lt) if quoted else None
        if m is None and (after.isalpha() or after == "/"):
            quoted = quoted and page.find(">", lt) < 0  # an open quote: from here on a tag ends at the next bracket
            m = LOOSE.match(page, lt)
            if m is None and page.find(">", lt) < 0 and after.isalpha():
                break  # the page ends within a tag
        if m is None:
            reader.said("<")
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            reader.end(name)
        elif name in RAW:
            if not m[3].endswith("/"):
                if raw_end.get(name, 0) <= at:  # where the next end tag of this name is, sought once
                    found = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                    raw_end[name] = found.start() if found else n
                close = page.find(">", raw_end[name])
                at = n if close < 0 else close + 1
        else:
            reader.start(name, m[3])
    reader.edge()
    return reader.blocks


def taught(page: list[Block]) -> list[int | None]:
    """What telling names say of each block: 1 main text, 0 not, None where nothing on the page is marked as its body."""
    marked = any("article" in b.path or "main" in b.path for b in page)
    out: list[int | None] = []
    for b in page:
        names = {t.lstrip(".") for t in b.path}
        inside = "article" in b.path or "main" in b.path
        out.append(0 if names & TELLING else 1 if inside else 0 if marked else None)
    return out


def made_page(rng: np.random.Generator, body: Sequence[str], rest: Sequence[str]) -> tuple[list[Block], list[int]]:
    """Texts of the sample in a new frame: regions around, before, after and within the main text."""
    one = lambda some: some[int(rng.integers(len(some)))]
    chance = lambda p: rng.random() < p
    page: list[Block] = []
    labels: list[int] = []

    def region(outer: list[str], kinds: Sequence[str] = tuple(FRAME)) -> None:
        kind = one(kinds)
        names = FRAME[kind].split()
        path = [*outer, kind if chance(0.5) else one(["div", "section", "aside", "ul"])]
        if path[-1] != kind or kind in ("div", "section", "p") or chance(0.5):
            path.append("." + one(names))
        leaf, links = one(["p", "li", "div", "span", "a", "span", "a", "h3", "button", "label"]), chance(0.5)
        for _ in range(int(rng.integers(1, 3 if chance(0.5) else 9))):
            text = one(body if kind == "section" or chance(0.4) else rest)
            page.append(Block([*path, *([] if leaf in INLINE else [leaf])], text, len(text) if links else 0))
            labels.append(0)

    shell = ["html", "body"] if chance(0.9) else []
    outer = [*shell, *(["div", "." + one(["container", "wrapper", "page", "site", "row", "layout", "app"])] if chance(0.4) else [])]
    inner = [*outer, *one([["article"], ["main"], ["main", "article"], ["div", "." + one(sorted(BODY))], ["section", "." + one(sorted(BODY))], ["td"], []])]
    for _ in range(int(rng.integers(0, 4))):
        region(outer)
    for i in range(int(rng.integers(1, 16))):
        leaf = "h1" if i == 0 and chance(0.6) else one(["p", "p", "p", "p", "h2", "li", "blockquote", "td", "pre", "div", ""])
        page.append(Block([*inner, *(["ul"] if leaf == "li" else ["table", "tr"] if leaf == "td" else []), *([leaf] if leaf else [])], one(rest if chance(0.1) else body)))
        labels.append(1)
        if chance(0.2):
            region(inner, ["div", "div", "aside", "section", "form", "p"])
    for _ in range(int(rng.integers(0, 4))):
        region(outer)
    return page, labels


def other_text(rng: np.random.Generator, texts: Sequence[str], text: str) -> str:
    """Mostly the text itself; at times another one, or a word that no text has, repeated."""
    chance = rng.random()
    if chance < 0.2:
        return texts[int(rng.integers(len(texts)))]
    return text if chance > 0.3 else " ".join([f"w{rng.integers(10**6)}"] * int(rng.integers(1, 40)))


_hashes: dict[str, int] = {}


def bucket(token: str) -> int:
    found = _hashes.get(token)
    if found is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        found = _hashes[token] = zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS
    return found


@dataclass
class Bags:
    """Hashed tokens of many blocks, end to end, the number of each block's and what their sum is multiplied by."""

    ids: np.ndarray
    counts: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, lists: list[list[str]], few: int | None = None) -> Bags:
        """few: divide by the number of tokens and as many more, so that short blocks say little; else by its root, so that one telling token stands out."""
        counts = np.array([len(x) for x in lists], np.int64)
        return cls(np.array([bucket(t) for tokens in lists for t in tokens], np.int64), counts, 1 / np.sqrt(counts) if few is None else 1 / (counts + few))

    def vectors(self, table: np.ndarray) -> np.ndarray:
        if not len(self.counts):
            return np.zeros((0, table.shape[1]), table.dtype)
        return np.add.reduceat(table[self.ids], np.cumsum(self.counts) - self.counts, axis=0) * self.scale[:, None].astype(table.dtype)

    def slopes(self, by_vector: np.ndarray) -> np.ndarray:
        each = np.repeat(by_vector * self.scale[:, None], self.counts, axis=0)
        return np.stack([np.bincount(self.ids, each[:, d], BUCKETS) for d in range(by_vector.shape[1])], axis=1)


@dataclass
class Pages:
    """Pages as a matrix of blocks: place by page, pages in falling order of length."""

    paths: Bags
    words: Bags
    lengths: np.ndarray

    @classmethod
    def of(cls, pages: list[list[Block]]) -> Pages:
        flat = [b for p in pages for b in p]
        return cls(Bags.of([b.tokens() for b in flat]), Bags.of([list(dict.fromkeys(b.text.lower().split())) for b in flat], few=3), np.array([len(p) for p in pages]))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Each block's place on its page and its page."""
        page = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return np.arange(len(page)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths), page

    def alive(self) -> np.ndarray:
        """How many pages have a block at each place."""
        return (self.lengths[None, :] > np.arange(self.lengths.max(initial=0))[:, None]).sum(axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lstm(x: np.ndarray, alive: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states for x (places x pages x inputs); page i takes part as long as i < alive[place]. keep: also what the derivatives need."""
    size = u.shape[0]
    h, c = np.zeros((x.shape[1], size), x.dtype), np.zeros((x.shape[1], size), x.dtype)
    out, steps = np.zeros((*x.shape[:2], size), x.dtype), []
    for t, n in enumerate(alive):
        z = x[t, :n] @ w + h[:n] @ u + b
        gates = sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        was_h, was_c = h[:n], c[:n]
        c = f * was_c + i * g
        th = np.tanh(c)
        h = o * th
        out[t, :n] = h
        if keep:
            steps.append((i, f, o, g, th, was_h, was_c))
    return out, steps


def lstm_slopes(d_out: np.ndarray, x: np.ndarray, steps: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Derivatives by x, and by w, u and b, of a function whose derivatives by the hidden states are d_out."""
    size = u.shape[0]
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], w.dtype), np.zeros_like(x)
    dh, dc = np.zeros((x.shape[1], size), x.dtype), np.zeros((x.shape[1], size), x.dtype)
    for t in range(len(steps) - 1, -1, -1):
        i, f, o, g, th, was_h, was_c = steps[t]
        n = len(i)
        to_h = dh[:n] + d_out[t, :n]
        to_c = dc[:n] + to_h * o * (1 - th * th)
        dz = np.concatenate([to_c * g * i * (1 - i), to_c * was_c * f * (1 - f), to_h * th * o * (1 - o), to_c * i * (1 - g * g)], axis=1)
        dw += x[t, :n].T @ dz
        du += was_h.T @ dz
        db += dz.sum(axis=0)
        dx[t, :n] = dz @ w.T
        dh[:n], dc[:n] = dz @ u.T, to_c * f
    return dx, [dw, du, db]


@dataclass
class Network:
    """Vectors of path tokens and of words; w, u and b of the forward and of the backward LSTM; the output's weights and offset."""

    params: list[np.ndarray]

    @classmethod
    def new(cls, rng: np.random.Generator, kind: type = np.float32) -> Network:
        fill = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        both = [p for _ in range(2) for p in (fill(2 * DIM, 4 * HIDDEN), fill(HIDDEN, 4 * HIDDEN), np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN))]
        return cls([p.astype(kind) for p in (rng.normal(0, 0.5, (BUCKETS, DIM)), rng.normal(0, 0.2, (BUCKETS, DIM)), *both, fill(2 * HIDDEN), np.zeros(1))])

    def states(self, pages: Pages, keep: bool = False) -> tuple:
        """The hidden states of both directions for every block, with what the derivatives need."""
        p = self.params
        place, page = pages.places()
        back = pages.lengths[page] - 1 - place
        both = np.concatenate([pages.paths.vectors(p[0]), pages.words.vectors(p[1])], axis=1)
        alive = pages.alive()
        shape = (len(alive), len(pages.lengths), 2 * DIM)
        forth, reverse = np.zeros(shape, p[0].dtype), np.zeros(shape, p[0].dtype)
        forth[place, page], reverse[back, page] = both, both
        out_f, steps_f = lstm(forth, alive, *p[2:5], keep=keep)
        out_b, steps_b = lstm(reverse, alive, *p[5:8], keep=keep)
        return np.concatenate([out_f[place, page], out_b[back, page]], axis=1), (place, page, back, forth, reverse, steps_f, steps_b)

    def probabilities(self, pages: Pages) -> np.ndarray:
        return sigmoid(self.states(pages)[0] @ self.params[8] + self.params[9])

    def slopes(self, pages: Pages, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross-entropy of blocks of classes y, and its derivatives by all parameters."""
        p = self.params
        h, (place, page, back, forth, reverse, steps_f, steps_b) = self.states(pages, keep=True)
        q = sigmoid(h @ p[8] + p[9])
        loss = float(-np.mean(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9)))
        delta = ((q - y) / len(y)).astype(p[0].dtype)
        d_h = delta[:, None] * p[8]
        d_f, d_b = np.zeros((*forth.shape[:2], HIDDEN), p[0].dtype), np.zeros((*forth.shape[:2], HIDDEN), p[0].dtype)
        d_f[place, page], d_b[back, page] = d_h[:, :HIDDEN], d_h[:, HIDDEN:]
        dx_f, g_f = lstm_slopes(d_f, forth, steps_f, p[2], p[3])
        dx_b, g_b = lstm_slopes(d_b, reverse, steps_b, p[5], p[6])
        d_both = dx_f[place, page] + dx_b[back, page]
        return loss, [pages.paths.slopes(d_both[:, :DIM]), pages.words.slopes(d_both[:, DIM:]), *g_f, *g_b, h.T @ delta, delta.sum(keepdims=True)]


def in_order(pages: list[list[Block]]) -> list[int]:
    return sorted(range(len(pages)), key=lambda i: -len(pages[i]))


def train(sample: list[str], seed: int = 13, rate: float = 0.01) -> Network | None:
    """A network from pages: those with a marked body as they are, and as many again put together from the texts of all."""
    rng = np.random.default_rng(seed)
    read = [p for p in map(blocks, sample) if p]
    known = [(p, t) for p, t in ((p, taught(p)) for p in read) if None not in t]
    body = [b.text for p, t in known for b, y in zip(p, t, strict=True) if y] or [b.text for p in read for b in p]
    rest = [b.text for p, t in known for b, y in zip(p, t, strict=True) if not y] or body
    if not body:
        return None
    both = body + rest
    net = Network.new(rng)
    first, second = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]
    step, total = 0, EPOCHS * max(8, -(-2 * len(known) // BATCH))
    while step < total:
        some: list[tuple[list[Block], list]] = [made_page(rng, body, rest) for _ in range(BATCH // 2 if known else BATCH)]
        some += [known[int(i)] for i in rng.integers(len(known), size=BATCH // 2)] if known else []
        pages = [[Block([t for t in b.path if rng.random() > 0.1], other_text(rng, both, b.text), b.linked) for b in p] for p, _ in some]
        order = in_order(pages)
        y = np.array([v for i in order for v in some[i][1]], np.float32)
        _, grads = net.slopes(Pages.of([pages[i] for i in order]), y)
        step += 1
        pace = rate * (1 - 0.9 * step / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for q, g, m, v in zip(net.params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= (pace * m / (np.sqrt(v) + 1e-8)).astype(q.dtype)
    return net


def label(pages: list[list[Block]], net: Network | None) -> list[np.ndarray]:
    """For each page, which of its blocks are main text. Pages of like length go through the network together."""
    out = [np.zeros(len(p), bool) for p in pages]
    order = [i for i in in_order(pages) if pages[i]] if net else []
    while order:
        n = max(1, min(len(order), SLOTS // len(pages[order[0]])))
        some, order = order[:n], order[n:]
        kept = net.probabilities(Pages.of([pages[i] for i in some])) >= 0.5
        ends = np.cumsum([len(pages[i]) for i in some])
        for i, part in zip(some, np.split(kept, ends[:-1]), strict=True):
            out[i] = part
    return out


def extract(pages: Sequence[str | None], net: Network | None) -> list[str]:
    read = [blocks(p or "") for p in pages]
    return [" ".join(b.text for b, k in zip(p, kept, strict=True) if k) for p, kept in zip(read, label(read, net), strict=True)]


def fit(pages: DataFrame, column: str = "html", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Network | None:
    """A network from at most `most` different pages of at most `most_bytes` each, drawn by a hash."""
    short = pages.filter(F.octet_length(column).between(1, most_bytes)).select(column)
    some = drawn(short, [column], most).dropDuplicates([column]).orderBy("_draw", column).limit(most)
    return train(sorted(r[0] for r in some.collect()))


def main_text(pages: DataFrame, net: Network | None, column: str = "html", name: str = "text") -> DataFrame:
    """All rows and columns of pages but `column`, and the main text of that column's page as `name` (which replaces a column of that name)."""
    kept = [f for f in pages.schema.fields if f.name not in (column, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_page"):
                texts = extract(part.column(len(kept)).to_pylist(), net)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string())], [f.name for f in kept] + [name])

    bound_arrow(pages.sparkSession)
    rows = pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").alias("_page"))
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.StringType())]))
