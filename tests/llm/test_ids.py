"""Token ids word by word against the tokenizer, over code points and over letters with marks."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    tokenizer, words = Tokenizer.from_file(PATH), packing.WordIds(PATH)

    def differing(texts):
        want = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [t for t, ids in zip(texts, want, strict=True) if words(t) != ids]

    return words, differing


def test_code_points(both):
    words, differing = both
    assert len(words.plain) > 400 and words.marked  # most Latin letters go the faster way
    named = [*range(1, 0x3400), *range(0x4DC0, 0x4E10), *range(0xA000, 0xAC10), *range(0xD7B0, 0xD800), *range(0xE000, 0xE010), *range(0xF900, 0x12000), *range(0x16000, 0x17000), *range(0x1B000, 0x20010), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200), 0x10FFFF]
    points = [chr(c) for c in named]
    assert differing([f"ab{c} {c}cd {c}" for c in points]) == []
    assert differing([f"a{a}{b}c" for a, b in zip(points, points[1:], strict=False)]) == []


def test_letters_with_marks(both):
    _, differing = both
    marks = [chr(c) for c in [*range(0x300, 0x370), 0x345, 0x1AB0, 0x20D0, 0xFE20, 0x200D, 0xAD, 0x2019, 0x27]]
    assert differing([f"x{c}{m} {m}{c}." for c in "aAeéÉoöOİıßſÅåΣσςdžDž" for m in marks]) == []
    rng = random.Random(4)
    alphabet = [*packing.LETTERS[::7], *packing.MARKS, *marks[::9], *"abcde012_' \t\n", "中", "Ᲊ", "Ɤ"]
    assert differing(["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(5000)]) == []
