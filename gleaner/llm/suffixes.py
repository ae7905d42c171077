"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte is removed if a string of SPAN bytes that covers it also starts in a document with a smaller id. To find these
strings it is enough to sort suffixes to depth SPAN, and only suffixes that can occur twice:

1. Every string of SPAN bytes has a minimiser, the smallest hash among its GRAM-byte pieces; equal strings have equal
   minimisers. Neighbouring strings mostly share theirs, so a text has few runs of them. Minimisers that occur in one
   document alone are left out: each block of documents asks for its own, by buckets of hashes, and gets a reply.
2. The remaining runs (a run's strings overlap, so it is a little longer than SPAN) go to the bucket of their
   minimiser, repeated ones once for each block, with the smallest id. There all suffixes of all runs are sorted:
   multikey quicksort by machine words to a shallow depth, then, in groups that still agree, blind tries, which
   branch at the first byte in which members differ from the group's first and put the branches in order. Equal suffixes
   stand side by side under one rank.
3. Every block gets the smallest id of each of its strings back, marks covered bytes, and hashes what is left.

Blocks and buckets have a bounded number of bytes, so that there are more of them as the input grows. With many blocks, a bucket's
asks are merged by groups of blocks first, as a frequent run comes from every block.

Defined cases: a null or empty text has no bytes; texts shorter than SPAN lose nothing; rows with equal ids count as one document;
a null id is larger than all others; an empty table gives an empty table; other columns are ignored; long texts are
taken through in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, open_path, scratch, slices, stored
from .shingles import PLACE, U64, mix

SPAN = 50
GRAM = 24
WINDOWS = SPAN - GRAM + 1  # pieces of a string, and strings of a run at most
WIDE = SPAN + WINDOWS - 1
SHALLOW = 24
PIECE = 1 << 20
#: Text bytes of a block, of a bucket of minimisers, and of a bucket of runs.
BLOCK_BYTES = 16 << 20
HASH_BYTES = 32 << 20
RUN_BYTES = 4 << 20
#: Blocks whose runs meet in one group of a bucket.
GROUP_BLOCKS = 4096
VALUE = (1 << 40) - 1
#: Shares between consecutive blocks of a partition.
STRIDE = 7919
NAMES = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
NO_ID = np.iinfo(np.int64).max


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one number."""
    n = len(data) - 7
    out = np.empty(max(0, n), U64)
    raw = data.tobytes()
    for j in range(min(8, max(0, n))):
        part = np.frombuffer(raw, "<u8", (len(raw) - j) // 8, j)
        out[j::8] = part[: len(out[j::8])]
    return out


class Runs:
    """Runs of strings with one minimiser in the texts of a batch: where they start, how many strings, of which text."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.begins = np.cumsum([0, *map(len, texts)])
        found = [self._piece(a, b) for a, b in self._pieces()]
        self.start, self.count, self.hash = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, U64 if i == 2 else np.int64) for i in range(3))
        self.text = np.searchsorted(self.begins, self.start, side="right") - 1

    def _pieces(self) -> Iterator[tuple[int, int]]:
        """Whole texts together, about PIECE bytes at once; a longer text in pieces that overlap by a string."""
        i = 0
        while i < len(self.texts):
            a, j = int(self.begins[i]), i + 1
            while j < len(self.texts) and self.begins[j + 1] - a <= PIECE:
                j += 1
            b = int(self.begins[j])
            yield from ((x, min(b, x + PIECE + SPAN - 1)) for x in range(a, max(a + 1, b - SPAN + 1), PIECE)) if j == i + 1 else [(a, b)]
            i = j

    def _piece(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = self.data[a:b]
        n = b - a - SPAN + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        w = words_at(data)
        grams = len(data) - GRAM + 1
        h = mix(w[:grams] * PLACE[0] + w[8 : 8 + grams] * PLACE[1] + w[16 : 16 + grams] * PLACE[2])
        width = 1
        while 2 * width <= WINDOWS:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < WINDOWS:
            h = np.minimum(h[: width - WINDOWS], h[WINDOWS - width :])
        inside = np.ones(n, bool)
        for end in self.begins[np.searchsorted(self.begins, a, side="right") : np.searchsorted(self.begins, b)].tolist():
            inside[max(0, end - SPAN + 1 - a) : end - a] = False
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | ~inside[:-1]
        at = np.flatnonzero(new & inside)
        stop = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1
        size = stop - at
        parts = -(-size // WINDOWS)
        which = np.repeat(np.arange(len(at)), parts)
        k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = at[which] + k * WINDOWS
        return start + a, np.minimum(WINDOWS, stop[which] - start), h[at][which]

    def bytes_of(self, pick: np.ndarray) -> np.ndarray:
        """The picked runs' bytes, filled with zeros to WIDE."""
        at = self.start[pick, None] + np.arange(WIDE)
        long = np.arange(WIDE) < (self.count[pick, None] + SPAN - 1)
        return np.where(long, self.data[np.minimum(at, len(self.data) - 1)], np.uint8(0))


def content_hash(runs: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes and length."""
    padded = np.zeros((len(runs), -(-WIDE // 8) * 8), np.uint8)
    padded[:, :WIDE] = runs
    words = padded.view("<u8").astype(U64)
    out = count.astype(U64)
    for k in range(words.shape[1]):
        out = mix(out * PLACE[3] + words[:, k])
    return out


def code(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash and its 40-bit value inside the bucket."""
    half = hashes >> U64(1)
    return (half % U64(buckets)).astype(np.int64), ((half // U64(buckets)) & U64(VALUE)).astype(np.int64)


def sorted_strings(runs: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, offset and rank of every string of SPAN bytes in the runs: how many strings sort before it; equal ones have equal ranks.

    Deep-shallow sorting: see the module's description. A group's number is the rank of its first string, so that groups stay in order
    as they are split.
    """
    run = np.repeat(np.arange(len(runs)), count)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    flat = np.ascontiguousarray(runs).ravel()
    base = run * WIDE + offset

    def word(who: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros(len(who), U64)
        for j in range(min(8, SPAN - depth)):
            out |= flat[base[who] + depth + j].astype(U64) << U64(56 - 8 * j)
        return out

    rank = np.zeros(len(run), np.int64)

    def starts(*keys: np.ndarray) -> np.ndarray:
        """Where the run of equal keys begins that each entry lies in."""
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return np.flatnonzero(new)[np.cumsum(new) - 1]

    def split(who: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """Order the groups of these strings by the keys; how many strings share each one's group now."""
        group = rank[who]
        part = starts(group, *keys)
        rank[who] = group + part - starts(group)
        return np.bincount(part, minlength=len(who))[part]

    tied = np.arange(len(run))
    for depth in range(0, SHALLOW, 8):  # multikey quicksort: sort what is tied by its next word
        if not len(tied):
            break
        key = word(tied, depth)
        order = np.lexsort((key, rank[tied]))
        who = tied[order]
        tied = who[split(who, key[order]) > 1]
    while len(tied):  # blind tries: a branch for each place at which members differ from the group's first, and each byte there
        who = tied[np.argsort(rank[tied], kind="stable")]
        first = who[starts(rank[who])]
        skip = np.full(len(who), SPAN, np.int64)
        left = np.arange(len(who))
        for depth in range(SHALLOW, SPAN, 8):
            a, b = word(who[left], depth), word(first[left], depth)
            differ = np.flatnonzero(a != b)
            if len(differ):
                x = a[differ] ^ b[differ]
                place = np.zeros(len(x), np.int64)
                for j in range(1, 8):
                    place += x < (U64(1) << U64(64 - 8 * j))
                skip[left[differ]] = depth + place
                left = np.delete(left, differ)
        at = np.minimum(skip, SPAN - 1)
        byte = flat[base[who] + at].astype(np.int64)
        side = np.sign(byte - flat[base[first] + at])
        # below the first: the sooner they leave it, the smaller; above it: the sooner, the larger
        turn = np.where(side < 0, skip, -skip)
        order = np.lexsort((byte, turn, side, rank[who]))
        who, side = who[order], side[order]
        size = split(who, side, turn[order], byte[order])
        tied = who[(size > 1) & (side != 0)]
    return run, offset, rank


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[list[bytes], np.ndarray, pa.RecordBatch]]]]:
    """Blocks in turn, each with its batches: texts, ids (none: NO_ID) and the batch itself."""
    parts = (p for batch in batches for p in cut_blocks(batch))
    part = next(parts, None)
    while part is not None:
        block = part[0]

        def own(block: int = block) -> Iterator[tuple[list[bytes], np.ndarray, pa.RecordBatch]]:
            nonlocal part
            while part is not None and part[0] == block:
                rows = part[1]
                yield [t or b"" for t in rows.column("text").to_pylist()], rows.column("id").to_numpy(zero_copy_only=False), rows
                part = next(parts, None)

        yield block, own()


def cut_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    block = batch.column("block").to_numpy()
    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
    for a, b in zip(edges, edges[1:], strict=False):
        for part in slices(batch.slice(a, b - a), "text", 4 << 20):
            if part.num_rows:
                yield int(block[a]), part


def blocks(docs: DataFrame) -> DataFrame:
    """Write docs in blocks of about BLOCK_BYTES: block, id, doc_id, text (bytes), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, number, np.int64)), *part.columns], ["block", *part.schema.names])
                held += part.column("text").nbytes
                if held >= BLOCK_BYTES:
                    number, held = number + 1, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("id"), "doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    bound_arrow(docs.sparkSession)
    return stored(rows.mapInArrow(run, f"block long, id long, doc_id {kind}, text binary, size long"), "suffix-blocks")


def keep_replies(replies: DataFrame, label: str) -> tuple[str, int]:
    """Write replies (block, ...) so that a task finds those of a block: a folder for each remainder, sorted by block."""
    spark = replies.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, label)
    place = F.shiftright("block", 24) + F.col("block").bitwiseAND((1 << 24) - 1) * STRIDE
    named = replies.withColumn("share", F.pmod(place, F.lit(shares)))
    named.repartition(shares, "share").sortWithinPartitions("share", "block").write.option("compression", "zstd").partitionBy("share").parquet(path)
    return path, shares


def share_of(block: int, shares: int) -> int:
    """As keep_replies deals blocks, which are numbered within their partitions."""
    return ((block >> 24) + (block & (1 << 24) - 1) * STRIDE) % shares


def replies_of(path: str, shares: int, block: int) -> list[dict]:
    fs, root = open_path(f"{path}/share={share_of(block, shares)}")
    if fs.get_file_info(root).type == pyarrow.fs.FileType.NotFound:
        return []
    files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.path.endswith(".parquet")]
    tables = [pyarrow.parquet.read_table(f, filesystem=fs, filters=[("block", "=", block)], partitioning=None) for f in files]
    return [row for t in tables for row in t.to_pylist()]


def shared_hashes(table: DataFrame, buckets: int) -> DataFrame:
    """block, codes: for each block and bucket the minimisers that occur in another document too."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in by_block(batches):
            hashes, ids = [], []
            for texts, own, _ in parts:
                runs = Runs(texts)
                hashes.append(runs.hash)
                ids.append(own[runs.text])
            h, i = np.concatenate(hashes), np.concatenate(ids)
            if not len(h):
                continue
            order = np.lexsort((i, h))
            h, i = h[order], i[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            several = i[first] != i[np.append(first[1:], len(h)) - 1]
            bucket, value = code(h[first], buckets)
            packed = (value << 1 | several).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]
            order = np.lexsort((value, bucket))
            bucket, packed = bucket[order], packed[order]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            blobs = [packed[a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(bucket)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array(np.full(len(edge), block, np.int64)), pa.array(blobs, pa.binary())], ["bucket", "block", "asked"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(x) // 6 for x in rows["asked"]])
        raw = np.zeros((int(sizes.sum()), 8), np.uint8)
        raw[:, :6] = np.frombuffer(b"".join(rows["asked"]), np.uint8).reshape(-1, 6)
        value = raw.view("<i8").ravel()
        several, value = value & 1, value >> 1
        who = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(value, kind="stable")
        v = value[order]
        same = np.zeros(len(v), bool)
        same[1:] |= v[1:] == v[:-1]
        same[:-1] |= v[1:] == v[:-1]
        yes = order[same | (several[order] > 0)]
        yes = yes[np.argsort(who[yes], kind="stable")]
        owner = who[yes]
        edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(yes) else np.zeros(0, np.int64)
        full = value[yes] * buckets + int(rows["bucket"].iloc[0])
        blobs = [full[a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(yes)], strict=True)]
        return pd.DataFrame({"block": rows["block"].to_numpy()[owner[edge]], "codes": blobs})

    asked = table.select("block", "id", "text").mapInArrow(ask, "bucket long, block long, asked binary")
    return asked.groupBy("bucket").applyInPandas(answer, "block long, codes binary")


def candidates(runs: Runs, codes: np.ndarray, buckets: int) -> np.ndarray:
    """Numbers of the runs whose minimiser is among the codes."""
    bucket, value = code(runs.hash, buckets)
    mine = value * buckets + bucket
    at = np.searchsorted(codes, mine)
    return np.flatnonzero(codes[np.minimum(at, len(codes) - 1)] == mine) if len(codes) else np.zeros(0, np.int64)


def block_codes(path: str, shares: int, block: int) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(r["codes"] for r in replies_of(path, shares, block)), np.int64))


def smallest_ids(table: DataFrame, asked: tuple[str, int], buckets: int, run_buckets: int) -> DataFrame:
    """block, keys, counts, ids: for runs of a block (by content hash) the smallest id that has each of their strings."""
    path, shares = asked

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in by_block(batches):
            codes = block_codes(path, shares, block)
            got: list[tuple[np.ndarray, ...]] = []
            for texts, own, _ in parts:
                runs = Runs(texts)
                pick = candidates(runs, codes, buckets)
                data = runs.bytes_of(pick)
                got.append((content_hash(data, runs.count[pick]), data, runs.count[pick], own[runs.text[pick]], (runs.hash[pick] % U64(run_buckets)).astype(np.int64)))
            key, data, count, ids, bucket = (np.concatenate(x) for x in zip(*got, strict=True))
            if not len(key):
                continue
            order = np.lexsort((ids, key, bucket))
            edge = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            first, last = order[edge], order[np.append(edge[1:], len(order)) - 1]
            b = bucket[first]
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            rows = [(int(b[x]), block, key[f].tobytes(), data[f].tobytes(), count[f].astype(np.uint8).tobytes(), ids[f].tobytes(), ids[g].tobytes()) for x, y in zip(cut, [*cut[1:], len(b)], strict=True) for f, g in [(first[x:y], last[x:y])]]
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["bucket", "block", "keys", "runs", "counts", "low", "high"])

    sent = table.select("block", "id", "text").mapInArrow(send, "bucket long, block long, keys binary, runs binary, counts binary, low binary, high binary")
    salts = -(-table.select("block").distinct().count() // GROUP_BLOCKS)
    if salts <= 1:
        return sent.groupBy("bucket").applyInPandas(lambda rows: replied(rows, *answered(rows)), REPLY)
    return salted_replies(sent, salts)


REPLY = "block long, keys binary, counts binary, ids binary"


def unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' runs, their string counts, and the smallest ids that have them."""
    counts, low = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in (("counts", np.uint8), ("low", np.int64)))
    return np.frombuffer(b"".join(rows["runs"]), np.uint8).reshape(-1, WIDE), counts.astype(np.int64), low


def lowest_ids(data: np.ndarray, counts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every string of different runs, one after the other, the smallest id of the runs that have it."""
    run, _, rank = sorted_strings(data, counts)
    order = np.argsort(rank, kind="stable")
    edge = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1]))
    lowest = np.minimum.reduceat(least[run[order]], edge)
    ids = np.empty(len(run), np.int64)
    ids[order] = np.repeat(lowest, np.diff(np.append(edge, len(order))))
    return ids


def answered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs asked for: which of the different ones each is, these ones' string counts, and the smallest id of each of their strings."""
    data, counts, low = unpacked(rows)
    keys = np.concatenate([np.frombuffer(x, U64) for x in rows["keys"]])
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    odd = np.flatnonzero((data != data[first[which]]).any(axis=1) | (counts != counts[first[which]]))
    which[odd] = len(first) + np.arange(len(odd))  # different bytes under one hash stay apart
    first = np.append(first, odd)
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, which, low)
    return which, counts[first], lowest_ids(data[first], counts[first], least)


def replied(rows: pd.DataFrame, which: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """A reply for each block: the runs of which some string has an id smaller than one that the block knows."""
    keys, high = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in (("keys", U64), ("high", np.int64)))
    owner = np.repeat(np.arange(len(rows)), [len(x) // 8 for x in rows["keys"]])
    begin = np.cumsum(counts) - counts
    useful = np.flatnonzero(np.minimum.reduceat(ids, begin)[which] < high)
    out = []
    for k in range(len(rows)):
        mine = useful[np.searchsorted(owner[useful], k) : np.searchsorted(owner[useful], k + 1)]
        if len(mine):
            n = counts[which[mine]]
            at = np.repeat(begin[which[mine]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append((int(rows["block"].iloc[k]), keys[mine].tobytes(), n.astype(np.uint8).tobytes(), ids[at].tobytes()))
    return pd.DataFrame(out, columns=["block", "keys", "counts", "ids"])


def different(data: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different run occurs first and which one each is, numbered by their bytes, whatever the rows' order."""
    wide = np.ascontiguousarray(np.column_stack([data, counts.astype(np.uint8)]))
    _, first, which = np.unique(wide.view([("", "u1", wide.shape[1])]).ravel().view(f"V{wide.shape[1]}"), return_index=True, return_inverse=True)
    return first, which


def salted_replies(sent: DataFrame, salts: int) -> DataFrame:
    """The same by groups of blocks, so that a run that all blocks have meets in no single task.

    Each group of a bucket's blocks first becomes one row of its different runs; the bucket sorts these rows; the answer goes
    back to the groups, which find their runs by the same numbers.
    """
    asked = stored(sent.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts))), "suffix-asked")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        data, counts, low = unpacked(rows)
        first, which = different(data, counts)
        least = np.full(len(first), NO_ID)
        np.minimum.at(least, which, low)
        return pd.DataFrame([(int(rows["bucket"].iloc[0]), int(rows["salt"].iloc[0]), data[first].tobytes(), counts[first].astype(np.uint8).tobytes(), least.tobytes())], columns=["bucket", "salt", "runs", "counts", "low"])

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        data, counts, low = unpacked(rows)
        first, which = different(data, counts)
        least = np.full(len(first), NO_ID)
        np.minimum.at(least, which, low)
        ids = lowest_ids(data[first], counts[first], least)
        begin = np.cumsum(counts[first]) - counts[first]
        at = np.repeat(begin[which] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        ends = np.cumsum(counts)[np.cumsum([len(x) for x in rows["counts"]]) - 1]
        parts = [x.tobytes() for x in np.split(ids[at], ends[:-1])]
        return pd.DataFrame({"bucket": rows["bucket"], "salt": rows["salt"], "ids": parts})

    def answer(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        data, counts, _ = unpacked(rows)
        first, which = different(data, counts)
        return replied(rows, which, counts[first], np.frombuffer(known["ids"].iloc[0], np.int64))

    merged = asked.groupBy("bucket", "salt").applyInPandas(merge, "bucket long, salt long, runs binary, counts binary, low binary")
    sorted_ = merged.groupBy("bucket").applyInPandas(sort, "bucket long, salt long, ids binary")
    return asked.groupBy("bucket", "salt").cogroup(sorted_.groupBy("bucket", "salt")).applyInPandas(answer, REPLY)


def removed(texts: list[bytes], own: np.ndarray, codes: np.ndarray, buckets: int, keys: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> tuple[Runs, np.ndarray]:
    """The batch's runs and, for each byte, whether it is removed."""
    runs = Runs(texts)
    pick = candidates(runs, codes, buckets)
    cover = np.zeros(len(runs.data) + 1, np.int32)
    if len(pick) and len(keys):
        content = content_hash(runs.bytes_of(pick), runs.count[pick])
        at = np.minimum(np.searchsorted(keys, content), len(keys) - 1)
        hit = keys[at] == content
        pick, at = pick[hit], at[hit]
        n = runs.count[pick]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        gone = ids[np.repeat(begin[at], n) + k] < np.repeat(own[runs.text[pick]], n)
        start = (np.repeat(runs.start[pick], n) + k)[gone]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + SPAN, -1)
    return runs, np.cumsum(cover[:-1]) > 0


def strip(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text); with_text: the bytes kept."""
    table = blocks(docs)
    total = table.agg(F.sum("size").alias("n")).first()["n"] or 0
    buckets, run_buckets = int(total // HASH_BYTES) + 1, int(total // RUN_BYTES) + 1
    asked = keep_replies(shared_hashes(table, buckets), "suffix-hashes")
    told = keep_replies(smallest_ids(table, asked, buckets, run_buckets), "suffix-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in by_block(batches):
            codes = block_codes(*asked, block)
            rows = replies_of(*told, block)
            keys = np.frombuffer(b"".join(r["keys"] for r in rows), U64)
            counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.uint8).astype(np.int64)
            ids = np.frombuffer(b"".join(r["ids"] for r in rows), np.int64)
            order = np.argsort(keys, kind="stable")
            keys, begin = keys[order], (np.cumsum(counts) - counts)[order]
            for texts, own, batch in parts:
                runs, gone = removed(texts, own, codes, buckets, keys, begin, ids)
                out = []
                for a, b in zip(runs.begins[:-1].tolist(), runs.begins[1:].tolist(), strict=True):
                    g = gone[a:b]
                    kept = runs.data[a:b][~g].tobytes()
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + bool(b > a and g[0])
                    out.append((b - a, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)[: 4 + with_text])
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)]], ["doc_id", *NAMES[: 4 + with_text]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return table.select("block", "id", "doc_id", "text").mapInArrow(run, schema)
