"""Corpus operators that SQL cannot express, against plain versions of what they compute."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from gleaner.llm import language, minhash, ogg, pii, quality, shingles, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def plain_feature(payload):
    levels = [b - 128 for b in payload]
    mean = sum(levels) / len(levels)
    rms = math.sqrt(sum(x * x for x in levels) / len(levels))
    changes = sum((a >= 0) != (b >= 0) for a, b in zip(levels, levels[1:], strict=False))
    return f"packets={-(-len(payload) // 3072)};seconds={len(payload) / 8000:.6f};mean={mean:.4f};rms={rms:.4f};changes={changes}"


def test_ogg_columns(spark, documents):
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é" * 100_000)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").limit(40).union(extra).cache()
    stored = {r["doc_id"]: bytes(r["media"]) for r in ogg.store_documents(docs).collect()}
    got = {r["doc_id"]: r for r in ogg.media_features(ogg.store_documents(docs)).collect()}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        g, media = got[r["doc_id"]], stored[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (g["tail_crc32"], g["media_bytes"], g["media_sha256"]) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert g["feature"] == plain_feature(payload)


def small_network(seed=3):
    rng = np.random.default_rng(seed)
    total = language.FILTERS * len(language.WIDTHS)
    shapes = [(256, language.DIM), (max(language.WIDTHS) * language.DIM, total), (total,), (total, 3), (3,)]
    embed, filters, bias, out, out_bias = (rng.normal(0, 0.4, x) for x in shapes)
    return language.Network(["a", "b", "c"], embed, filters * language.alive(), bias, out, out_bias)


def test_forward_pass_is_a_convolution():
    net = small_network()
    rows = np.random.default_rng(4).integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    got = net.probabilities(rows)
    for row, p in zip(rows, got, strict=True):
        hidden = []
        for k, width in enumerate(language.WIDTHS):
            for f in range(k * language.FILTERS, (k + 1) * language.FILTERS):
                best = -math.inf
                for start in range(language.WINDOW):
                    value = 0.0
                    for j in range(width):
                        byte = row[start + j] if start + j < language.WINDOW else 0
                        value += float(net.embed[byte] @ net.filters[j * language.DIM : (j + 1) * language.DIM, f])
                    best = max(best, value)
                hidden.append(max(0.0, best + net.bias[f]))
        z = np.array(hidden) @ net.out + net.out_bias
        assert p == pytest.approx(np.exp(z) / np.exp(z).sum(), abs=1e-9)


def test_slopes_are_the_loss_functions_derivatives():
    net = small_network()
    rng = np.random.default_rng(5)
    rows, y, weight = rng.integers(97, 123, (6, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2]), rng.uniform(0.5, 2, 6)
    _, grads = net.slopes(rows, y, weight)
    for param, grad in zip([net.embed, net.filters, net.bias, net.out, net.out_bias], grads, strict=True):
        for i in rng.choice(np.flatnonzero(np.abs(grad) > 1e-4), 8):
            flat = param.reshape(-1)
            old, ends = flat[i], []
            for h in (1e-6, -1e-6):
                flat[i] = old + h
                ends.append(net.slopes(rows, y, weight)[0])
            flat[i] = old
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(grad.reshape(-1)[i], rel=2e-3, abs=1e-7)


def test_quality_keeps_what_no_cutoff_rejects(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    known = docs.join(labels.select("doc_id").distinct(), "doc_id")
    cuts = {r["stratum"]: {n: r[f"cut_{n}"] for n in quality.RULES} for r in quality.fit_cutoffs(quality.text_statistics(known, "lang"), labels).collect()}
    assert all(min(c.values()) < math.inf for c in cuts.values()) and len(cuts) == 4
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(known, labels).collect()}
    mark = {r["doc_id"]: r["quality"] for r in labels.collect()}
    lost = {}
    for r in known.collect():
        stats = quality.statistics(r["text"] or "")
        failed = stats[5]
        rates = dict(zip(quality.RULES, stats[6:], strict=True))
        passed = all(rates[x] <= c for x, c in cuts["=" + r["lang"]].items())
        assert kept[r["doc_id"]] == (failed, not failed and passed)
        if not failed and mark[r["doc_id"]] == 1:
            lost.setdefault(r["lang"], []).append(not passed)
    assert all(np.mean(x) <= quality.RISK for x in lost.values())
    caught = [not k for d, (failed, k) in kept.items() if not failed and mark[d] == 0]
    assert np.mean(caught) > 0.9


def test_settings_are_nested_and_hold_on_fresh_labels():
    rng = np.random.default_rng(6)

    def draw(n, bad):
        stats = {r: rng.beta(1, 30, n) for r in quality.RULES}
        stats["symbol_share"] = rng.beta(8, 12, n) if bad else rng.beta(1, 60, n)
        return stats

    chain = quality.order_settings(draw(400, False), draw(60, True))
    assert sorted(chain) == sorted((r, c) for r, cuts in quality.RULES.items() for c in cuts)
    for r, cuts in quality.RULES.items():
        assert [c for name, c in chain if name == r] == cuts  # each rule from lenient to strict
    assert chain[0][0] == "symbol_share"


def naive_label_model(votes, label, rounds):
    """The label model by loops over rows and voters, correlations included."""
    rows, voters, fired = len(votes), len(votes[0]), votes
    post = [0.9 if y else 0.1 for y in label]
    clip = lambda x, e: min(1 - e, max(e, x))
    for _ in range(rounds):
        yes, no = sum(post), rows - sum(post)
        on = [clip((sum(p * f[j] for p, f in zip(post, fired, strict=True)) + 0.5) / (yes + 1), 1e-4) for j in range(voters)]
        off = [clip((sum((1 - p) * f[j] for p, f in zip(post, fired, strict=True)) + 0.5) / (no + 1), 1e-4) for j in range(voters)]
        rest = [[f[j] - p * on[j] - (1 - p) * off[j] for j in range(voters)] for p, f in zip(post, fired, strict=True)]
        size = [math.sqrt(sum(r[j] ** 2 for r in rest) / rows) + 1e-9 for j in range(voters)]
        weight = []
        for j in range(voters):
            near = [sum(r[j] * r[k] for r in rest) / rows / size[j] / size[k] for k in range(voters)]
            weight.append(1 / max(1, sum(x for x in near if x > 0.3)))
        hit = clip((sum(p * y for p, y in zip(post, label, strict=True)) + 0.5) / (yes + 1), 1e-3)
        slip = clip((sum((1 - p) * y for p, y in zip(post, label, strict=True)) + 0.5) / (no + 1), 1e-3)
        z = [math.log((yes + 0.5) / (no + 0.5)) + sum(w * (math.log(a / b) if x else math.log((1 - a) / (1 - b))) for w, x, a, b in zip(weight, f, on, off, strict=True)) + (math.log(hit / slip) if y else math.log((1 - hit) / (1 - slip))) for f, y in zip(fired, label, strict=True)]
        post = [1 / (1 + math.exp(-min(30, max(-30, x)))) for x in z]
    return post


def test_label_model_by_loops():
    rng = np.random.default_rng(7)
    truth = rng.random(120) < 0.3
    votes = np.array([[rng.random() < (0.7 if t else 0.05) for _ in range(5)] for t in truth]).astype(int)
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0]])  # copies of a voter
    label = np.where(rng.random(120) < 0.1, ~truth, truth).astype(int)
    for rounds in (1, 4):
        assert toxicity.label_model(votes, label, rounds) == pytest.approx(naive_label_model(votes.tolist(), label.tolist(), rounds), abs=1e-8)
    found = toxicity.label_model(votes, label) > 0.5
    assert np.mean(found == truth) > np.mean(label == truth)  # posteriors mend wrong labels


def test_fits_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, toxic int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert language.fit(docs) is None
    assert toxicity.fit(docs, labels).score("x") < 0.01
    full = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    assert toxicity.score(full, toxicity.fit(full, labels)).first()["predicted"] == 0
    assert quality.judge(full, labels).first()["kept"] is False  # fewer than ten words


def test_training_rows_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(60)] + [(i, "y" * 10) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert {r["text"][0] for r in rows} == {"y"} and len(rows) == len({i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1})
    assert toxicity.training_rows(docs, labels, most_bytes=100).count() == 10
    assert toxicity.training_rows(docs, labels, most=5).count() == 5


def long_number(rng, card):
    """A number of 16 digits whose check digit is right or wrong."""
    digits = str(rng.integers(10**14, 10**15))
    odd = sum(int(c) if k % 2 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(digits[::-1]))
    return digits + str((-odd + (not card)) % 10)


def test_pii_finds_planted_identifiers(spark):
    """Identifiers without a base form, planted beside words that seeds have too, in the texts of the test table."""
    rng = np.random.default_rng(8)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    planted = {}
    made = []
    for n, (doc, text) in enumerate(docs):
        words = text.split(" ")
        at = int(rng.integers(0, len(words)))
        if n % 20 == 0:  # seeds: keys and addresses behind words that give them away
            words.insert(at, f"secret key {rng.bytes(20).hex()} ." if n % 40 else f"reached host {rng.integers(1, 255)}.{rng.integers(1, 255)}.0.9 .")
        elif n % 40 == 1:  # in the same places: too short for a key
            planted[doc] = f"k{rng.integers(100, 999)}z{rng.integers(100, 999)}q{rng.integers(100, 999)}b"
            words.insert(at, f"secret key {planted[doc]} .")
        elif n % 200 == 21:  # out of range for an address
            planted[doc] = f"{rng.integers(300, 999)}.{rng.integers(300, 999)}.0.9"
            words.insert(at, f"reached host {planted[doc]} .")
        elif n % 20 == 2:  # numbers that are nobody's
            words.insert(at, f"chapter {rng.integers(100, 999)} of {rng.integers(100, 999)} .")
        elif n % 20 == 3:  # long numbers of which half are cards: no sign of one
            words.insert(at, f"total sum {long_number(rng, n % 40 == 3)} .")
        made.append((doc, " ".join(words)))
    texts = dict(made)
    clean = {d for n, (d, _) in enumerate(made) if n % 20 == 2}
    found = {}
    for r in pii.find(spark.createDataFrame(made, "doc_id long, text string")).collect():
        parts = [s.split(":") for s in r["spans"].split(",") if s.startswith("id:")]
        found[r["doc_id"]] = [texts[r["doc_id"]][int(a) : int(b)] for _, a, b in parts]
    recall = np.mean([w in found[d] for d, w in planted.items()])
    keys = {w for d in texts for w in found[d] if len(w.strip('"#$%&*!., ')) >= 32}
    new = [(d, w) for d in texts for w in found[d] if w not in keys]
    precision = np.mean([planted.get(d) == w for d, w in new])
    print(f"planted identifiers: recall {recall:.3f}, precision {precision:.3f} of {len(new)}")
    assert recall >= 0.9 and precision >= 0.9 and not any(any(w[:3].isdigit() and len(w) == 3 for w in found[d]) for d in clean)


def test_minhash_recall_against_brute_force(spark):
    """Every text whose id is divisible by 20 against all texts: are its partners in its component?"""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = dict(zip([r["doc_id"] for r in docs], shingles.shingle_sets([r["text"] for r in docs]), strict=True))
    part = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs)).collect()}
    hits = []
    for a in (d for d in sets if d % 20 == 0):
        for b, other in sets.items():
            if a != b and len(sets[a]) and len(other):
                both = len(np.intersect1d(sets[a], other, assume_unique=True))
                if 100 * both >= 75 * (len(sets[a]) + len(other) - both):
                    hits.append(part[a] == part[b])
    print(f"near-duplicates of every twentieth text: recall {np.mean(hits):.3f} of {len(hits)}")
    assert len(hits) > 3 and all(hits)
