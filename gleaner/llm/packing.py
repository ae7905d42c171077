"""Best-two-fit packing of token sequences.

Documents become token ids with an end mark; longer ones are cut into pieces of the sequence length. Which lengths share
a sequence is decided on the histogram of lengths alone, which has as many entries as a sequence has tokens, whatever
the size of the corpus: a bin is filled greedily with the longest piece that fits; then its shortest piece is replaced
by two unpacked ones that fit the gap it leaves more tightly, for as long as that helps. A bin's pattern is used as often as the
counts allow. Pieces of one length are interchangeable, so their rank within the length picks bin and offset.

Defined cases: a null or empty text is the end mark alone; repeated rows and ids are packed each for itself; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_arrow, slices, stored

LIMIT = 4096
END = 1
#: Words whose ids a worker remembers in each of two generations; a full young generation becomes the old one.
REMEMBERED = 100_000
#: Shares that the pieces of a length are dealt to, at most.
SHARES = 256
#: Vocabulary words, about, that the faster encoder must agree on before it is used.
CHECKED = 2000
#: Letters and marks that may go another way than through the tokenizer, if it agrees on each of them when a worker starts: Latin ones, and the
#: punctuation that goes with them. What any other character is, the tokenizer alone knows: its tables may be older or newer than Python's.
LETTERS = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha()]
MARKS = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xC0), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]) if not c.isalnum() and c not in "_'"]
#: White space as the tokenizer's patterns see it (the Unicode property), and what only Python's split() takes for it.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")


class LetterWords:
    """Ids of words that are letters alone, by a faster encoder with the same merges.

    Words are given to it with a mark in place of the vocabulary's end-of-word suffix. A last letter joins its mark
    first, as these are the pairs of the lowest rank; all other pairs have the rank of the token they make.
    """

    MARK = "\x01"

    def __init__(self, path: str, letters: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, mark = model["end_of_word_suffix"], self.MARK.encode()
        # the byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        ids = {}
        for token, number in model["vocab"].items():
            core = token.removesuffix(suffix)
            if all(c in byte for c in core):
                ids[bytes(byte[c] for c in core) + mark * (core != token)] = number
        first = [bytes([b]) for b in range(256)] + sorted((t for t in ids if len(t) == 2 and t.endswith(mark)), key=ids.__getitem__)
        order = first + sorted(ids.keys() - set(first), key=ids.__getitem__)
        self.ids = np.array([ids.get(t, 0) for t in order], "<u4")
        self.ends = np.array([len(t) > 1 and t.endswith(mark) for t in order])
        self.encoding = tiktoken.Encoding(letters, pat_str=f"[^{self.MARK}]*{self.MARK}", mergeable_ranks={t: k for k, t in enumerate(order)}, special_tokens={})

    def __call__(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        found = np.array(self.encoding.encode_ordinary(self.MARK.join(words) + self.MARK))
        data = self.ids[found].tobytes()
        ends = (4 * (np.flatnonzero(self.ends[found]) + 1)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class WordIds:
    """Token ids of whole texts from remembered ids of their words.

    The vocabulary's patterns drop white space and never join what it parts, so that a text's ids are those of its
    words one after the other; likewise letters and a run of marks after them are encoded each for itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if any(SPACE.search(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens with white space cannot be encoded word by word")
        self.letters = self.checked(LetterWords(path, "letters"))
        self.plain = self.agreed() if self.letters else frozenset()
        known = "".join(map(re.escape, self.parting() if self.letters else []))
        self.marked = re.compile(f"([^{known}]+)([{known}]+)") if known else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def checked(self, fast: LetterWords) -> LetterWords | None:
        """The faster encoder, if it gives the tokenizer's ids for words joined from every part of the vocabulary."""
        tokens = sorted(t.removesuffix("</w>") for t in self.tokenizer.get_vocab())
        plain = [t.lower() for t in tokens if t.isascii() and t.isalpha()][:: max(1, len(tokens) // CHECKED)]
        words = plain + [a + b for a, b in zip(plain, reversed(plain), strict=True)]
        return fast if fast(words) == self.slow(words) else None

    def agreed(self) -> frozenset[str]:
        """The letters that the faster encoder treats as the tokenizer does, alone, first, last and amid others."""
        forms = [[c, f"{c}ab", f"ab{c}", f"a{c}b"] for c in LETTERS]
        words = [w for f in forms for w in f]
        want, got = self.slow(words), self.letters([self.folded(w) for w in words])
        return frozenset(c for i, c in enumerate(LETTERS) if want[4 * i : 4 * i + 4] == got[4 * i : 4 * i + 4])

    def parting(self) -> list[str]:
        """The marks that the tokenizer parts from letters before them, alone and before each other."""
        pairs = [(c, d) for c in MARKS for d in ("", c, ".", "!", ")", "%")]
        whole, alone, stem = self.slow([f"ab{c}{d}" for c, d in pairs]), self.slow([c + d for c, d in pairs]), self.slow(["ab"])[0]
        wrong = {c for (c, _), a, b in zip(pairs, whole, alone, strict=True) if a != stem + b}
        return [c for c in MARKS if c not in wrong]

    @staticmethod
    def folded(word: str) -> str:
        return (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()

    def slow(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Have the ids of these words in the young generation."""
        odd, plain, stems, tails = [], [], [], []
        for w in words:
            ids = self.old.get(w)
            if ids is not None:
                self.young[w] = ids
                continue
            stem, tail = w, ""
            if self.marked and not self.plain.issuperset(w) and (m := self.marked.fullmatch(w)):
                stem, tail = m.groups()
            if self.plain.issuperset(stem):
                plain.append(w)
                stems.append(self.folded(stem))
                tails.append(tail)
            else:
                odd.append(w)
        if new := list({t for t in tails if t and t not in self.marks}):
            if len(self.marks) > REMEMBERED:
                self.marks = {}
                new = list({t for t in tails if t})
            self.marks |= zip(new, self.slow(new), strict=True)
        for w, ids, tail in zip(plain, self.letters(stems) if self.letters else [], tails, strict=True):
            self.young[w] = ids + self.marks[tail] if tail else ids
        self.young |= zip(odd, self.slow(odd), strict=True)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        words = [w for w in SPACE.split(text) if w] if NOT_SPACE.search(text) else text.split()
        found = list(map(self.young.get, words))
        if None in found:
            self.learn({w for w, ids in zip(words, found, strict=True) if ids is None})
            found = list(map(self.young.__getitem__, words))
            if len(self.young) > REMEMBERED:
                self.young, self.old = {}, self.young
        return b"".join(found)


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer for each worker process."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, and with_ids the ids themselves (binary)."""
    kind = docs.schema[id_col].dataType.simpleString()
    mark = np.array([end], "<u4").tobytes()
    schema = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for batch in batches:
            for part in slices(batch, "_text"):
                rows, at = [], []
                for i, text in enumerate(part.column("_text").to_pylist()):
                    ids = encode(text or "") + mark
                    for k, start in enumerate(range(0, len(ids), 4 * limit)):
                        cut = ids[start : start + 4 * limit]
                        rows.append((k, start // 4, len(cut) // 4, zlib.crc32(cut), cut)[: 4 + with_ids])
                        at.append(i)
                cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t) for _, t in schema]
                yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(at, pa.int64())), *cols], ["_id", *[n for n, _ in schema]])

    bound_arrow(docs.sparkSession)
    text = docs.selectExpr(f"`{id_col}` AS _id", "text AS _text")
    out = text.mapInArrow(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("_id", id_col)


def fill(counts: np.ndarray, limit: int) -> list[tuple[list[int], int]]:
    """Patterns of piece lengths and how many bins have each. counts[n]: pieces of length n, 0 < n <= limit."""
    left = counts.astype(np.int64).copy()
    lengths = np.arange(limit + 1)
    plan: list[tuple[list[int], int]] = []
    # below[n]: the longest length up to n of which a piece is left
    below = np.maximum.accumulate(np.where(left > 0, lengths, 0))
    while below[limit]:
        bin_, gap, used = [], limit, {}

        def take(n: int, k: int, bin_: list[int] = bin_, used: dict[int, int] = used) -> None:
            bin_.extend([n] * k)
            used[n] = used.get(n, 0) + k

        while gap:
            n = int(below[gap])
            while n and used.get(n, 0) >= left[n]:
                n = int(below[n - 1])
            if not n:
                break
            k = min(int(left[n]) - used.get(n, 0), gap // n)
            take(n, k)
            gap -= n * k
        while gap:
            small = min(bin_)
            room = gap + small
            free = left.copy()
            for n, k in used.items():
                free[n] -= k
            has = free > 0
            best = np.maximum.accumulate(np.where(has, lengths, 0))
            a = np.flatnonzero(has[: room + 1])
            b = best[np.minimum(a, room - a)]
            alone = (b == a) & (free[a] < 2)
            b = np.where(alone, best[np.maximum(np.minimum(a, room - a) - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            if not len(both) or both.max() <= small:
                break
            j = int(both.argmax())
            bin_.remove(small)
            used[small] -= 1
            take(int(a[j]), 1)
            take(int(b[j]), 1)
            gap = room - int(both[j])
        times = min(int(left[n]) // k for n, k in used.items() if k)
        plan.append((bin_, times))
        for n, k in used.items():
            left[n] -= k * times
        below = np.maximum.accumulate(np.where(left > 0, lengths, 0))
    return plan


def places(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """The plan as ranges of ranks: pieces of a length with ranks from first on go to bins from sequence on, at offset."""
    rows, rank, sequence = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            first = rank.get(n, 0)
            rows.append((n, first, sequence, offset))
            rank[n] = first + times
            offset += n
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(cut: DataFrame, limit: int = LIMIT, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to pieces (with length, 1 to limit, and the columns of order)."""
    spark = cut.sparkSession
    cut = stored(cut.withColumn("_uid", F.monotonically_increasing_id()), "pack-pieces")
    # ranks within a length: pieces are dealt to shares by a hash, so that a frequent length is no single group
    shares = max(1, min(SHARES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = cut.withColumn("_share", F.pmod(F.xxhash64(*order, "_uid"), F.lit(shares)).cast("int"))
    sums = dealt.groupBy("length", "_share").agg(F.count("*").alias("n")).toPandas()  # at most limit * SHARES rows
    dealt_counts = np.zeros((limit + 1, shares), np.int64)
    dealt_counts[sums["length"], sums["_share"]] = sums["n"]
    before = np.cumsum(dealt_counts, axis=1) - dealt_counts
    counts = dealt_counts.sum(axis=1)
    plan = places(fill(counts, limit))
    key = plan["length"].to_numpy(np.int64) << 40 | plan["first"].to_numpy(np.int64)
    first, sequence, offset = (plan[c].to_numpy(np.int64) for c in ("first", "sequence", "offset"))

    def place(length: pd.Series, share: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n = length.to_numpy(np.int64)
        r = rank.to_numpy(np.int64) + before[n, share.to_numpy(np.int64)]
        at = np.searchsorted(key, n << 40 | r, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + r - first[at], "offset": offset[at]})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    within = Window.partitionBy("length", "_share").orderBy(*order, "_uid")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).withColumn("_place", placed("length", "_share", "_rank"))
    keep = [c for c in cut.columns if c != "_uid"]
    return ranked.select(*keep, "_place.sequence_id", "_place.offset")
