"""WARC archives: a writer with revisit records, and a splittable reader of compressed archives.

Every record is a gzip member of its own. A reading task gets a byte range of a file, looks for gzip's magic bytes, and
takes a candidate as a member if it decodes, checksum and length included, to a WARC header. Only the first one in a range may lie
within the stored bytes of another member: it is believed if another member or the file's end follows; if neither does, as with
padding between records, the members are walked from the file's start to see whether one begins there. A task owns the records
whose members start inside its range, and reads past the range's end to finish the last.

A record that contradicts itself is returned with what is wrong in `problem`; a digest that is not there is computed.

Defined cases: a null payload is empty; rows whose payload is equal and whose id is the smallest are all responses
(repeated rows), null ids never count as smallest, and revisit the smallest id if there is one; an empty table writes no
file and reads as an empty table, as does a folder without archives; other columns are ignored; a record may be longer than a range.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow, open_path, slices, stored

SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
OUT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
LINE = b"\r\n"
VERSION = b"WARC/1."
#: Reading tasks, at most; each then reads several ranges.
READERS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC digests have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(key: object) -> str:
    return f"<urn:x-page:{'none' if key is None else key}>"


def record(key: object, url: str | None, payload: bytes, first: object, date: str, level: int) -> bytes:
    """A response record, or with first (another id) a revisit record that refers to it, as a gzip member."""
    revisit = first is not None and first != key
    http = LINE.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    target = " ".join((url or "about:blank").split())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(first)}"]
    data = "\r\n".join(head).encode() + LINE + LINE + block + LINE + LINE
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def mark_revisits(pages: DataFrame, key: str, payload: str, at_least: int = 0) -> DataFrame:
    """Add _first: the smallest id among rows with an equal payload of at least at_least bytes, where there are several."""
    keyed = pages.withColumn("_sum", F.sha1(F.col(payload))).withColumn("_size", F.octet_length(payload))
    keyed = keyed.withColumn("_sum", F.when(F.col("_size") >= at_least, F.concat_ws("-", "_sum", "_size")))
    groups = keyed.filter(F.col("_sum").isNotNull()).groupBy("_sum").agg(F.min(key).alias("_first"), F.count("*").alias("_n"))
    return keyed.join(groups.filter("_n > 1").select("_sum", "_first"), "_sum", "left").drop("_sum", "_size")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write a record for each row below path, one file for each task; returns the stored list of files: file, bytes, records.

    A task that runs again writes a file of another name; only files in the list belong to the archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, out, records = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz", None, 0
        fs, root = open_path(path)
        for batch in batches:
            for part in slices(batch, "_payload"):
                rows = part.to_pydict()
                for k, u, p, f in zip(rows["_key"], rows["_url"], rows["_payload"], rows["_first"], strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(record(k, u, p, f, date, level))
                    records += 1
        if out is not None:
            out.close()
            size = fs.get_file_info(f"{root}/{name}").size
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["file", "bytes", "records"])

    bound_arrow(pages.sparkSession)
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_payload"))
    marked = mark_revisits(rows, "_key", "_payload", at_least).select("_key", "_url", "_payload", "_first")
    return stored(marked.mapInArrow(run, "file string, bytes long, records long"), "warc-files")


class Members:
    """The gzip members of a file that start inside [start, end)."""

    def __init__(self, source: pa.NativeFile, size: int, start: int, end: int) -> None:
        self.source, self.size, self.start, self.end = source, size, start, end
        self.base, self.data = start, bytearray()

    def fetch(self, upto: int) -> bool:
        """Have the bytes up to a position of the file; false if it ends before."""
        while self.base + len(self.data) < upto:
            self.source.seek(self.base + len(self.data))
            more = self.source.read(max(READ_BYTES, upto - self.base - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def forget(self, pos: int) -> None:
        """Let go of the bytes before a position."""
        del self.data[: pos - self.base]
        self.base = pos

    def magic_at(self, pos: int) -> bool:
        return self.fetch(pos + 4) and self.data[pos - self.base : pos - self.base + 3] == MAGIC and not self.data[pos - self.base + 3] & 0xE0

    def member(self, pos: int) -> tuple[bytes, int] | None:
        """Content and end of the member at pos, if one is there and holds a WARC record."""
        unpack, content, at = zlib.decompressobj(31), bytearray(), pos
        try:
            while not unpack.eof:
                if not self.fetch(at + 1):
                    return None
                chunk = self.data[at - self.base : at - self.base + READ_BYTES]
                content += unpack.decompress(chunk)
                at += len(chunk)
                if not VERSION.startswith(content[: len(VERSION)]):
                    return None
        except zlib.error:
            return None
        return (bytes(content), at - len(unpack.unused_data)) if len(content) > len(VERSION) and content.find(LINE + LINE) > 0 else None

    def begins_at(self, pos: int) -> bool:
        """Whether a member begins here, by all members before it."""
        return any(at == pos for at, _ in Members(self.source, self.size, 0, pos + 1))

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        # from the file's start on, or behind a member, no other member can be open
        pos, sure = self.base, self.start == 0
        while pos < self.end:
            if not self.magic_at(pos):
                if not self.fetch(pos + 4):
                    return
                found = self.data.find(MAGIC, pos - self.base + 1)
                pos = self.base + found if found >= 0 else max(pos + 1, self.base + len(self.data) - 2)
                self.forget(pos)
                continue
            got = self.member(pos)
            if got and (sure or got[1] >= self.size or self.magic_at(got[1]) or self.begins_at(pos)):
                yield pos, got[0]
                pos, sure = got[1], True
                self.forget(pos)
            else:
                pos += 1


def parse(content: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Header fields (names in lower case) and block of a record, and what is wrong with it."""
    cut = content.index(LINE + LINE)
    fields = {}
    for line in content[:cut].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    rest = len(content) - cut - 4
    length = fields.get("content-length", "")
    size = int(length) if length.isdecimal() else rest
    problem = None if length.isdecimal() else "no content length"
    if size > rest:
        problem = "shorter than its content length"
    return fields, content[cut + 4 : cut + 4 + size], problem


def same_number(records: DataFrame, files: DataFrame) -> DataFrame:
    """The stored records, if none has a problem and there are as many as the list of files says."""
    kept = stored(records, "warc-read")
    got, wrong = kept.agg(F.count("*"), F.count("problem")).first()
    due = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if got != due or wrong:
        raise ValueError(f"{due} records were written, {got} were read, {wrong} of them damaged")
    return kept


def http_payload(block: bytes) -> tuple[int, bytes]:
    """Length of the full payload as the HTTP header has it, and the payload that is there."""
    head, _, payload = block.partition(LINE + LINE)
    for line in head.split(LINE)[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), payload
    return len(payload), payload


def row_of(content: bytes) -> tuple | None:
    """A response or revisit record as a row of read_warc; none for records of other kinds."""
    fields, block, problem = parse(content)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    size, payload = http_payload(block)
    claimed = fields.get("warc-payload-digest")
    if kind == "response":
        got = digest(payload)
        if claimed is not None and claimed.removeprefix("sha1:").upper() != got and (claimed.startswith("sha1:") or ":" not in claimed):
            problem = problem or "payload digest differs"
        if size != len(payload):
            problem = problem or "payload length differs"
        claimed, size = got, len(payload)
    known = claimed.removeprefix("sha1:") if claimed is not None else None
    return fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), known, size, payload if kind == "response" else None, problem


def byte_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, bytes -> a row for each range: file, bytes, start, end."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    ranges = files.filter("bytes > 0").select("file", "bytes", starts)
    return ranges.withColumn("end", F.least(F.col("bytes"), F.col("start") + split_bytes))


def list_files(spark: SparkSession, path: str, suffix: str = ".warc.gz") -> DataFrame:
    """The archives below a folder of any file system that Spark knows: file, bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Response and revisit records of the files: record_id, record_type, url, refers_to, payload_digest, payload_bytes, payload, problem.

    Digest and length of a response are those of the payload that is there, and problem says where its header has
    others; a revisit has the digest and length of the payload it stands for.
    """
    names = ["record_id", "record_type", "url", "refers_to", "payload_digest", "payload_bytes", "payload", "problem"]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = open_path(r["file"])
                with fs.open_input_file(path) as source:
                    for _, content in Members(source, r["bytes"], r["start"], r["end"]):
                        row = row_of(content)
                        if row is None:
                            continue
                        rows.append(row)
                        held += len(content)
                        if held >= OUT_BYTES or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    ranges = byte_ranges(files, split_bytes)
    bound_arrow(files.sparkSession)
    # dealt round and to a number of tasks that is given, so that small rows with much work behind them are not merged
    spread = ranges.repartition(max(1, min(READERS, ranges.count())))
    return spread.mapInArrow(run, "record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary, problem string")
