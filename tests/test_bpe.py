"""Byte-pair counts against a published implementation of the same vocabulary."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from gleaner import queries as engine
from gleaner.functions import bpe

DATA = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def published():
    return tiktoken.Encoding("published", pat_str=bpe.PIECE_FORM, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_every_document(spark, published, texts):
    got = {r["doc_id"]: r["token_count"] for r in engine.queries()["vocabulary_counts"](spark, DATA).collect()}
    assert got == {k: len(published.encode_ordinary(t or "")) for k, t in texts.items()}


def test_ids_of_odd_texts(published):
    words, rng = bpe.Vocabulary(PATH), random.Random(1)
    odd = ["", " ", "\n\n \t x", "don't we'll I'M", "aaaaaaaaaaaaaaaaa", "𝔘𝔫𝔦 中文字符 é́ ‍\xa0", "x" * 5000, "ab" * 3000 + "c", "  indent\n\n\n", "12345678901234567890", "!?!?!?!...", "\ud800"[:0]]
    odd += ["".join(rng.choices("abcdeABC 12.,\n'é中́\U0001f600", k=rng.randint(1, 200))) for _ in range(3000)]
    odd += ["".join(chr(c) for c in range(start, min(start + 64, 0x110000)) if not 0xD800 <= c <= 0xDFFF) for start in range(0, 0x30000, 64)]
    for t in odd:
        assert words.encode(t) == published.encode_ordinary(t), repr(t[:80])
        assert words.count(t) == len(words.encode(t))


def test_long_pieces_cost_no_square(published):
    rng = random.Random(2)
    piece = "".join(rng.choices("abcdefghij", k=300_000))
    assert bpe.merge(piece.encode(), bpe.read_ranks(PATH)) == published.encode_ordinary(piece)


def test_no_more_pieces_are_remembered_than_allowed(monkeypatch, published):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    words = bpe.Vocabulary(PATH)
    text = " ".join(f"word{i}" for i in range(100))
    assert words.encode(text) == published.encode_ordinary(text) and len(words.known) <= 10


def test_chunks_by_a_vocabulary(spark, published, texts):
    size = lambda t: len(published.encode_ordinary(t))
    want = {}
    for doc, text in texts.items():
        held, used, chunks = [], 0, []
        for line in (x for x in (text or "").split("\n") if x.strip(" ")):
            n = size(line)
            if held and used + n > 600:
                chunks.append(held)
                kept, total = [], 0
                for x in reversed(held):
                    if total + size(x) > 120:
                        break
                    kept, total = [x, *kept], total + size(x)
                held, used = kept, total
            held, used = [*held, line], used + n
        for i, lines in enumerate([*chunks, held] if held else chunks):
            content = "\n\n".join(lines)
            want[doc, i] = (hashlib.md5(content.encode()).hexdigest(), size(content))
    got = {(r["doc_id"], r["chunk_index"]): (r["content_md5"], r["token_count"]) for r in engine.queries()["vocabulary_chunks"](spark, DATA).collect()}
    assert got == want


def test_null_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "id long, t string")
    assert [r["n"] for r in rows.select(bpe.vocabulary_count(PATH)(rows["t"]).alias("n")).collect()] == [0, 0, 2]
