"""Counts by a vocabulary: pieces merged side by side, and chunks counted by their blocks."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from gleaner.functions import bpe
from gleaner.operators import segment

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Ends of lines, with what is white space for Python and not for the pattern, and the other way round.
ENDS = ["", "", " ", "  ", "\t", "\r", "\xa0", " \t ", "\t  ", "\x1c", " ", "\x85"]


@pytest.fixture(scope="module")
def published():
    encoding = tiktoken.Encoding("published", pat_str=bpe.PIECE_FORM, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def test_new_pieces_are_not_merged_one_by_one(monkeypatch, published):
    rng, called, merge = random.Random(3), [], bpe.merge
    text = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 60))) for _ in range(5000))
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: called.append(piece) or merge(piece, ranks))
    assert bpe.Vocabulary(PATH).count(text) == published(text)
    assert len(called) < 200


def test_pieces_side_by_side(published):
    rng = random.Random(4)
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 150))) for letters in ("ab", "aA1 ", "éß中\U0001f600", "abcdefghij 0123456789'.,\n\t", "e ") for _ in range(600)]
    assert bpe.Vocabulary(PATH).counts(texts) == [published(t) for t in texts]


@pytest.mark.parametrize(("name", "value"), [("TOGETHER", 1), ("TOGETHER", 500), ("CELLS", 200), ("REMEMBERED", 5), ("FEW", 1)])
def test_bounds_change_no_count(monkeypatch, published, name, value):
    monkeypatch.setattr(bpe, name, value)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh xyz", k=rng.randint(0, 300))) for _ in range(200)]
    words = bpe.Vocabulary(PATH)
    assert words.counts(texts) == [published(t) for t in texts]
    assert len(words.sizes) <= bpe.REMEMBERED


def test_a_vocabulary_without_every_byte(tmp_path):
    lines = [line for line in open(PATH, "rb") if not line.startswith(b"eg== ")]  # z
    (tmp_path / "some").write_bytes(b"".join(lines))
    words = bpe.Vocabulary(str(tmp_path / "some"))
    text = " ".join(f"word{i}" for i in range(100))
    assert words.count(text) == len(words.encode(text))
    with pytest.raises(KeyError):
        words.count("qz")


def odd_blocks(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["it's", "'s", "'", "12", "é́", "word", "a b", "x\ny", "...", "中文"])
    rows = [(d, i, rng.choice([*["".join([rng.choice(ENDS), word(), rng.choice([" ", ""]), word(), rng.choice(ENDS)])] * 6, "\t", "\r\xa0", "", None])) for d in range(150) for i in range(rng.randint(1, 25))]
    return spark.createDataFrame(rows, "doc_id long, block_idx int, content string").withColumn("heading_level", F.lit(None).cast("int"))


@pytest.mark.parametrize("make", [lambda b, count: segment.report_chunks(b, 20, 8, count=count), lambda b, count: segment.criteria_chunks(b, 20, count=count)])
def test_chunks_of_odd_lines(spark, published, make):
    rows = make(odd_blocks(spark), bpe.vocabulary_count(PATH)).collect()
    assert len(rows) > 300
    assert [(r["content"], r["token_count"]) for r in rows] == [(r["content"], published(r["content"])) for r in rows]


def test_another_form_of_pieces(spark):
    form = r"\S+\s*"
    words = bpe.Vocabulary(PATH, form)
    rows = segment.report_chunks(odd_blocks(spark), 20, 8, count=bpe.vocabulary_count(PATH, form)).collect()
    assert [r["token_count"] for r in rows] == [words.count(r["content"]) for r in rows]


def test_a_chunk_is_not_counted_again(spark, published):
    class Once(bpe.vocabulary_count):
        def __call__(self, text):
            return F.when(text.isNotNull(), F.raise_error(F.lit("counted again")).cast("int")).otherwise(0)

    docs = spark.createDataFrame([(1, "\n".join(f"line {i} of a text" for i in range(300))), (2, "one"), (3, None)], "doc_id long, text string")
    blocks = segment.line_blocks(docs).withColumn("heading_level", F.lit(None).cast("int"))
    rows = segment.report_chunks(blocks, count=Once(PATH)).collect()
    assert len(rows) > 3
    assert [r["token_count"] for r in rows] == [published(r["content"]) for r in rows]


def test_lines_of_a_slice(spark):
    lists = pa.array([["dropped"], ["a b", " c"], [], ["d\t", None]])
    got = spark.createDataFrame([(x.as_py(),) for x in lists[1:]], "x array<string>").select(bpe.vocabulary_count(PATH).of_lines(F.col("x"), "\n\n").alias("c"))
    assert [[c["tokens"] for c in r["c"]] for r in got.collect()] == [[2, 1], [], [2, 0]]
