"""The stages of the pipeline against plain versions, each on the stage before it."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import mixing, pii, toxicity
from gleaner.llm.common import stored

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, the source tables first."""
    out = {"documents": spark.read.parquet(f"{DATA}/documents.parquet")}
    docs = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, DATA), "test-pipeline")
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxicity_drops_what_the_model_rejects(spark, stages):
    docs = stages["documents"].collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    learned = sorted((r["text"], labels[r["doc_id"]]) for r in docs if labels.get(r["doc_id"]) is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1)
    model = toxicity.train([t for t, _ in learned], [y for _, y in learned])
    want = Counter(tuple(r) for r in docs if model.score(r["text"]) < toxicity.THRESHOLD)
    assert rows(stages["toxicity"]) == want and 0 < len(docs) - want.total() < len(docs) / 4


def test_near_duplicates_keep_the_smallest_of_each_component(stages):
    docs = stages["toxicity"].collect()
    sets = {}
    for r in docs:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), r["text"]))
        sets[r["doc_id"]] = frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])
    part = {d: d for d in sets}
    met = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            met[x].add(d)
    pairs = {p for ds in met.values() for p in itertools.combinations(sorted(ds), 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((part[a], part[b]))
            part = {d: low if p == high else p for d, p in part.items()}
    assert rows(stages["near_duplicates"]) == Counter(tuple(r) for r in docs if part[r["doc_id"]] == r["doc_id"])


def test_personal_data_is_replaced_and_nothing_else(stages):
    before = {r["doc_id"]: r for r in stages["near_duplicates"].collect()}
    spans = {r["doc_id"]: r["spans"] for r in pii.find(stages["near_duplicates"]).collect()}
    changed = 0
    for r in stages["personal_data"].collect():
        old = before[r["doc_id"]]
        marks = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans[r["doc_id"]].split(",") if s))
        out, at = [], 0
        while marks:
            a, b, kind = marks.pop(0)
            while marks and marks[0][0] < b:
                b = max(b, marks.pop(0)[1])
            out += [old["text"][at:a], f"[{kind.upper()}]"]
            at = b
        text = "".join(out) + old["text"][at:]
        changed += text != old["text"]
        assert (r["text"], r["n_chars"], r["lang"], r["source"]) == (text, len(text) if at else old["n_chars"], old["lang"], old["source"])
    assert changed > 20 and len(before) == stages["personal_data"].count()


def test_mixture_repeats_rows_as_often_as_they_are_taken(stages):
    docs = stages["personal_data"]
    taken = {(r["doc_id"], r["source"]): r["taken"] // r["size"] if r["size"] else 0 for r in mixing.mix(docs).collect()}
    want = Counter()
    for r in docs.collect():
        want[tuple(r)] += taken[r["doc_id"], r["source"]]
    assert rows(stages["mixing"]) == +want
    assert stages["mixing"].columns == stages["documents"].columns


def test_packing_has_every_token_once(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [(r["doc_id"], r["text"]) for r in stages["mixing"].collect()]
    want = Counter()
    for (doc, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        ids = [*e.ids, 1]
        for k in range(0, len(ids), 4096):
            cut = np.asarray(ids[k : k + 4096], "<u4").tobytes()
            want[doc, k // 4096, k, len(cut) // 4, zlib.crc32(cut)] += 1
    got = stages["packing"].collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1
