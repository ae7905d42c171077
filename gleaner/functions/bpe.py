"""Token counts by a byte-pair vocabulary: a text's pieces by a pattern, each one's bytes merged in the order of the vocabulary's ranks.

A vocabulary file has a line for each token: its bytes in base64 and its rank, which is its id. The file must be where the workers can
read it. Pieces recur, so that a worker remembers those it has seen, a bounded number of them. Where numbers of tokens are asked for, the new pieces of
a batch are merged side by side in numpy.

Defined cases: null and empty texts have no tokens; bytes that the vocabulary lacks are an error; every text is read whole, and a piece of n bytes takes
n log n steps, so that a text without spaces costs no square.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import bound_batches
from .fixed import PIECE_FORM

#: Pieces whose ids a worker remembers.
REMEMBERED = 200_000
#: Characters of texts whose new pieces are merged together.
TOGETHER = 1 << 18
#: Pieces of up to 64 bytes are merged side by side by these widths, CELLS bytes at once; longer ones, and fewer than FEW, each by a heap.
WIDTHS, CELLS, FEW = (8, 16, 32, 64), 1 << 17, 32
#: White space at a text's start and end, if there is something between.
EDGES = regex.compile(r"(\s*)\S(?:.*\S)?(\s*)", regex.DOTALL)
NO_RANK = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: of all neighbouring tokens those whose union ranks lowest become one, leftmost first, until no union has a rank.

    Tokens are known by where they start; ends tells where each ends and before where the one before it starts. A union on the heap holds
    as long as its two tokens are still there.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends, before, there = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, start, end = heappop(heap)
        middle = ends[start]
        if not there[start] or middle >= n or ends[middle] != end:
            continue
        ends[start], there[middle] = end, False
        if end < n:
            before[end] = start
            if (rank := ranks.get(piece[start : ends[end]])) is not None:
                heappush(heap, (rank, start, ends[end]))
        if (left := before[start]) >= 0 and (rank := ranks.get(piece[left:end])) is not None:
            heappush(heap, (rank, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Pairs:
    """The ranks of the unions of two tokens, by the ids of both; only for vocabularies that have every byte."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        cuts = ((ranks.get(t[:i]), ranks.get(t[i:]), rank) for t, rank in ranks.items() for i in range(1, len(t)))
        found = np.array([x for x in cuts if None not in x], np.int64).reshape(-1, 3)
        keys = found[:, 0] << 32 | found[:, 1]
        order = keys.argsort()
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(found[order, 2], NO_RANK)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self.keys.searchsorted(keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def sizes(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece. Pieces are rows of ids between columns of -1; each turn makes one union in every row that has one left, so
        that rows lose a column a turn."""
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), sizes.max() + 2), -1, np.int64)
        ids[:, 1:-1][np.arange(sizes.max()) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks, rows = self.rank(ids[:, :-1], ids[:, 1:]), np.arange(len(pieces))
        while True:
            at = ranks.argmin(1)
            low = ranks[np.arange(len(at)), at]
            left = low < NO_RANK
            if not left.any():
                return sizes
            ids, ranks, rows, at, low = ids[left], ranks[left], rows[left], at[left], low[left]
            sizes[rows] -= 1
            each = np.arange(len(rows))
            ids = ids[np.arange(ids.shape[1]) != at[:, None] + 1].reshape(len(rows), -1)
            ranks = ranks[np.arange(ranks.shape[1]) != at[:, None]].reshape(len(rows), -1)
            ids[each, at] = low
            ranks[each, at] = self.rank(low, ids[each, at + 1])
            ranks[each, at - 1] = self.rank(ids[each, at - 1], low)


class Vocabulary:
    """A byte-pair vocabulary with the pattern that parts texts into pieces."""

    def __init__(self, path: str, form: str = PIECE_FORM) -> None:
        self.ranks, self.form = read_ranks(path), regex.compile(form)
        self.known: dict[str, tuple[int, ...]] = {}
        self.sizes: dict[str, int] = {}
        self.pairs = Pairs(self.ranks) if all(bytes([b]) in self.ranks for b in range(256)) else None
        self.between = lru_cache(1024)(self._between)

    def of_piece(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            ids = self.known[piece] = tuple(merge(piece.encode("utf-8", "replace"), self.ranks))
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.form.findall(text) for i in self.of_piece(piece)]

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        out, some, held = [], [], 0
        for t in texts:
            some.append(t)
            held += len(t)
            if held >= TOGETHER:
                out += self._counts(some)
                some, held = [], 0
        return out + self._counts(some)

    def _counts(self, texts: list[str]) -> list[int]:
        parts, sizes = [self.form.findall(t) for t in texts], self.sizes
        self.learn(set(chain.from_iterable(parts)).difference(sizes))
        out = [sum(map(sizes.__getitem__, p)) for p in parts]
        if len(sizes) > REMEMBERED:
            sizes.clear()
        return out

    def learn(self, pieces: set[str]) -> None:
        """Remember the number of tokens of each piece."""
        found = sorted(((p.encode("utf-8", "replace"), p) for p in pieces), key=lambda x: len(x[0]))
        merged = [x for x in found if x[0] not in self.ranks] if self.pairs else []
        ends = [bisect_right(merged, w, key=lambda x: len(x[0])) for w in WIDTHS]
        for width, start, end in zip(WIDTHS, [0, *ends], ends):
            for i in range(start, end if end - start >= FEW else start, CELLS // width):
                some = merged[i : min(end, i + CELLS // width)]
                self.sizes.update(zip([p for _, p in some], self.pairs.sizes([b for b, _ in some]).tolist(), strict=True))
        self.sizes.update([(p, len(merge(b, self.ranks))) for b, p in found if p not in self.sizes])

    def _between(self, tail: str, joint: str, lead: str) -> int:
        """What a joint adds to the tokens of the texts around it, by the white space at their ends."""
        whole, before, after = self.counts([f"x{tail}{joint}{lead}x", f"x{tail}", f"{lead}x"])
        return whole - before - after


_read: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, form: str = PIECE_FORM) -> Vocabulary:
    """One vocabulary for each worker process."""
    if (path, form) not in _read:
        _read[path, form] = Vocabulary(path, form)
    return _read[path, form]


class vocabulary_count:  # noqa: N801
    """A function that counts a column's tokens by a vocabulary; chunkers take it in place of the estimate."""

    def __init__(self, path: str, form: str = PIECE_FORM) -> None:
        self.path, self.form = path, form

    def __call__(self, text: Column) -> Column:
        path, form = self.path, self.form

        def counted(texts: pa.Array) -> pa.Array:
            return pa.array(vocabulary(path, form).counts(texts.to_pylist()), pa.int32())

        bound_batches()
        return F.arrow_udf(counted, "int")(F.coalesce(text, F.lit("")))

    def of_lines(self, lines: Column, joint: str) -> Column:
        """For each of a list of texts its tokens, and what the joint between it and the next one adds (more) when they become one text; joint is white
        space that does not end in a space.

        No piece goes on from another character into white space, and only a single space goes on into a word; so what lies between the first and the
        last other character of a text has the same tokens alone and joined. more is null beside a null or blank text and where pieces have another form.
        """
        path, form = self.path, self.form

        def counted(lists: pa.Array) -> pa.Array:
            words, texts = vocabulary(path, form), lists.flatten().to_pylist()
            edges = [EDGES.fullmatch(t) if t and form == PIECE_FORM else None for t in texts]
            more = [words.between(a[2], joint, b[1]) if a and b else None for a, b in pairwise([*edges, None])]
            tokens = words.counts([t or "" for t in texts])
            ends = np.append(0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum())
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (tokens, more)], ["tokens", "more"]))

        bound_batches()
        return F.arrow_udf(counted, "array<struct<tokens:int,more:int>>")(lines)
