"""Word shingles as 64-bit hashes, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
U64 = np.uint64
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
STEP = U64(0x9E3779B97F4A7C15)
PLACE = _rng.integers(0, 1 << 63, WIDTH, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words (runs of bytes other than 32 and 9 to 13)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.empty_like(space)
    before[:1] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return starts, np.zeros(0, U64)
    last = np.empty_like(space)
    last[-1:] = True
    last[:-1] = space[1:]
    lengths = np.flatnonzero(~space & last) + 1 - starts
    offset = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = np.where(space, U64(0), BYTE[data])[starts[0] :]
    # a word's offsets run on into the space after it, where values are 0
    powers = np.multiply.accumulate(np.full(int(offset.max()) + 1, STEP, U64))
    return starts, mix(np.add.reduceat(value * powers[offset], starts - starts[0]) + lengths.astype(U64))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words, A-Z taken for a-z.

    A text of fewer words is one shingle; one without words has none.
    """
    data = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    starts, words = word_hashes(joined)
    ends = np.cumsum([len(x) + 1 for x in data])
    upto = np.searchsorted(starts, ends)
    n = len(words)
    runs = np.zeros(n, U64)
    for k in range(width):
        runs[: max(0, n - k)] += words[k:] * PLACE[k % WIDTH]
    runs = mix(runs)
    a = 0
    for b in upto.tolist():
        count = b - a
        if count >= width:
            yield np.unique(runs[a : b - width + 1])
        elif count:
            yield mix(np.array([(words[a:b] * PLACE[:count]).sum() + U64(count)], U64))
        else:
            yield np.zeros(0, U64)
        a = b
