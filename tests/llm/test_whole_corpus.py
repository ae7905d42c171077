"""Corpus operators must read whole texts and every record."""

import gzip
import random
from math import comb

import pytest

from gleaner.llm import minhash, pii, toxicity, warc
from gleaner.llm.common import open_path


def spans(spark, texts):
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: r["spans"] for r in rows}


def luhn_card(i):
    digits = f"411111111111{i:03d}"
    odd = sum(int(c) if k % 2 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(digits[::-1]))
    digits += str(-odd % 10)
    return " ".join(digits[k : k + 4] for k in range(0, 16, 4))


def test_pii_mail_without_digits_is_a_seed(spark):
    seeds = [f"please mail {n}@example.com today" for n in ("jane", "john", "anna", "peter", "maria", "paul")]
    got = spans(spark, seeds + ["please mail (rené@example.com), today", "see user@host there"])
    assert got[6] == "id:13:29" and got[7] == ""


def test_pii_card_in_groups_of_four_is_a_seed(spark):
    seeds = [f"card number {luhn_card(i)} expires" for i in range(6)]
    got = spans(spark, seeds + ["card number 4111 1111 1111 1112 expires", "card number (4111 1111 1111 1112), expires", "card number 5 expires"])
    assert got[0] == "card:12:31" and got[6] == "id:12:31" and got[7] == "id:13:32" and got[8] == ""


def test_pii_spaced_phone_has_words_on_both_sides(spark):
    seeds = [f"call +1 (407) 555-02{i} {w}" for i, w in enumerate(("now", "later", "soon", "often", "today", "again"), 71)]
    got = spans(spark, seeds + ["call +1 (407) 55-02 please"])
    assert got[0] == "phone:5:22" and got[6] == "id:5:19"


def test_shouting_reads_every_character():
    assert toxicity.style("Hello friend") == ["short"]
    assert "shouting" in toxicity.style("aBBBBBB" * 20)
    assert "shouting" not in toxicity.style("Abbbbbb" * 20)


def test_toxicity_trains_on_8000_rows(spark):
    docs = spark.range(13_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(13_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    assert toxicity.training_rows(docs, labels).count() == 8000


def test_warc_long_url_is_read_back(spark, tmp_path):
    url = "http://x/" + random.Random(5).randbytes(100_000).hex()
    pages = spark.createDataFrame([(1, "http://x/1", "a"), (2, url, "b"), (3, "http://x/3", "c")], "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(pages, f"file://{tmp_path}/w")
    for split in (1000, 1 << 24):
        assert {(r["record_id"], r["url"]) for r in warc.read_warc(files, split).collect()} == {(warc.urn(r["page_id"]), r["url"]) for r in pages.collect()}


def test_warc_lost_records_raise(spark, tmp_path):
    files = warc.write_warc(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    read = warc.read_warc(files)
    assert warc.same_number(read, files).count() == 2
    with pytest.raises(ValueError):
        warc.same_number(read.limit(1), files)


def test_minhash_states_its_odds():
    missed = sum(comb(64, i) * 0.75**i * 0.25 ** (64 - i) for i in range(minhash.AGREE))
    assert f"{missed:.1e}".replace("e-0", "e-") in minhash.__doc__


def members(path, split):
    fs, name = open_path(f"file://{path}")
    size = path.stat().st_size
    found = []
    for start in range(0, size, split):
        with fs.open_input_file(name) as source:
            found += [pos for pos, _ in warc.Members(source, size, start, min(size, start + split))]
    return found


def test_warc_padding_between_and_after_members(tmp_path):
    first, second = (warc.record(i, "u", random.Random(i).randbytes(400), None, "2024-01-01T00:00:00Z", 6) for i in (1, 2))
    for pad in (bytes(16), b"\n", b"junk\x1f\x8b\x08\x00junk"):
        (tmp_path / "f").write_bytes(first + pad + second + pad)
        for split in (40, 100, 1 << 20):
            assert members(tmp_path / "f", split) == [0, len(first) + len(pad)], (pad, split)
    (tmp_path / "f").write_bytes(first + bytes(16))
    assert members(tmp_path / "f", 1 << 20) == members(tmp_path / "f", 50) == [0]


def test_warc_archive_within_a_record(tmp_path):
    inner = warc.record(7, "u", b"inner", None, "2024-01-01T00:00:00Z", 6)
    outer = warc.record(1, "u", inner + bytes(9), None, "2024-01-01T00:00:00Z", 0)
    (tmp_path / "f").write_bytes(outer + bytes(7) + inner)
    for split in (30, 64, 1 << 20):
        assert members(tmp_path / "f", split) == [0, len(outer) + 7]


def test_warc_records_as_crawls_have_them(spark, tmp_path):
    def packed(*lines, block=b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"):
        return gzip.compress("\r\n".join(["WARC/1.0", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    (tmp_path / "a.warc.gz").write_bytes(
        packed("WARC-Type: warcinfo", "Content-Length: 4", block=b"a: b")
        + packed("WARC-Type: response", "WARC-Record-ID: <1>", "Content-Length: 41")
        + packed("WARC-Type: response", "WARC-Record-ID: <2>", "Content-Length: 41", "WARC-Payload-Digest: sha1:WRONG")
        + packed("WARC-Type: response", "WARC-Record-ID: <3>", "Content-Length: 99999")
        + packed("WARC-Type: response", "WARC-Record-ID: <4>", "Content-Length: 41", "WARC-Payload-Digest: sha256:ff")
        + packed("WARC-Type: response", "WARC-Record-ID: <5>", "Content-Length: 41", block=b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc")
    )
    rows = {r["record_id"]: r for r in warc.read_warc(warc.list_files(spark, f"file://{tmp_path}")).collect()}
    assert {k: r["problem"] for k, r in rows.items()} == {
        "<1>": None, "<2>": "payload digest differs", "<3>": "shorter than its content length", "<4>": None, "<5>": "payload length differs",
    }
    assert rows["<1>"]["payload"] == b"abc" and {r["payload_digest"] for k, r in rows.items() if k != "<3>"} == {warc.digest(b"abc")}


def test_warc_empty_tables_long_payloads_and_clashing_columns(spark, tmp_path):
    schema = "page_id long, url string, html string, _first string, _key string, _payload int, bytes int, file string"
    none = spark.createDataFrame([], schema)
    files = warc.write_warc(none, f"file://{tmp_path}/none")
    assert files.count() == warc.read_warc(files).count() == 0
    (tmp_path / "empty").mkdir()
    assert warc.list_files(spark, f"file://{tmp_path}/empty").count() == 0
    long = "".join(map(chr, random.Random(2).choices(range(97, 123), k=3_000_000)))
    rows = [(1, "u", long, "x", "y", 1, 2, "z"), (2, None, long, "x", "y", 1, 2, "z"), (3, "u", None, None, None, None, None, None)]
    files = warc.write_warc(spark.createDataFrame(rows, schema), f"file://{tmp_path}/some")
    for split in (100_000, 1 << 24):
        got = {r["record_id"]: (r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read_warc(files, split).collect()}
        assert got == {warc.urn(1): ("response", 3_000_000, None), warc.urn(2): ("revisit", 3_000_000, warc.urn(1)), warc.urn(3): ("response", 0, None)}
    assert warc.read_warc(files, 100_000).rdd.getNumPartitions() == warc.byte_ranges(files, 100_000).count() > 10
