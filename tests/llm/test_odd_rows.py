"""Very long texts, nulls, repeated rows, empty tables and columns whose names operators use themselves."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import decontaminate, linededup, quality, simhash, urlfilter, warc
from sluice.llm.shared import Scratch

CLASHES = ("id", "fp", "words", "row", "h", "key", "line", "marks", "win", "n_words", "rule", "payload", "start")
PASSAGE = " ".join(f"passage{i}" for i in range(20))


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(21)
    lines = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(700)]
    return "\n".join([*lines, lines[0], "z" * 30_000, PASSAGE])


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(1, long_text), (2, None), (2, None), (3, ""), (4, "a few words only"), (4, "a few words only"), (None, "no id at all"), (5, long_text + " end"), (6, "z" * 29_998 + "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text2", F.lit("x"))
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def test_simhash(docs, long_text):
    found = simhash.near_duplicates(docs)
    rows = {r["id"]: r for r in found.collect()}
    words = long_text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    assert rows[1]["fp"] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert rows[2]["fp"] == rows[3]["fp"] == 0 and rows[3]["component_id"] == 2 and rows[5]["component_id"] == 1
    assert found.count() == 9 and sorted(simhash.keep_one(docs).columns) == sorted(docs.columns)


def test_quality(docs, long_text):
    rows = {r["id"]: r for r in quality.quality(docs).collect()}
    words = long_text.split()
    seen, repeated = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeated.update(p + k for p in places for k in range(5))
    assert (rows[1]["n_words"], rows[1]["word_chars"], rows[1]["n_dup_lines"], rows[1]["n_repeat_words"]) == (len(words), sum(map(len, words)), 1, len(repeated))
    assert rows[2]["n_words"] == 0 and rows[2]["base_failed"] and not rows[2]["kept"]
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_thresholds(spark):
    base = "the cat and the dog sat on the mat in the sun for a while"
    texts = {
        **{"plain": base, "few": "the cat sat", "symbols": base + " # $ % & | < >", "no stop words": " ".join(f"zorgon{i}" for i in range(20)), "long words": " ".join([f"{'x' * 30}{i}" for i in range(12)] + ["the"])},
        **{"same lines": "\n".join([base] * 3), "ellipsis": "\n".join(f"{base} {i} ..." for i in range(3)), "bullets": "\n".join(f"- {base} {i}" for i in range(3))},
    }
    got = {r["id"]: (r["base_failed"], r["kept"]) for r in quality.quality(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert got["plain"] == (False, True) and got["few"] == (True, False) and got["same lines"][0]
    assert all(got[k] == (False, False) for k in ("symbols", "no stop words", "long words"))
    # repeated words of lines that differ in a number only fail the base rule first
    assert got["ellipsis"][1] is False and got["bullets"][1] is False


def test_decontamination(spark, docs, long_text):
    bench = spark.createDataFrame([(7, PASSAGE), (8, None), (9, "")], "item_id long, text string").withColumns({c: F.lit("clash") for c in CLASHES})
    rows = {(r["id"], r["n_words"]): r for r in decontaminate.contamination(docs, bench).collect()}
    assert rows[1, len(long_text.split())]["n_hit"] == 20 and rows[1, len(long_text.split())]["items"] == ["7"]
    assert rows[2, 0]["n_hit"] == 0 and rows[4, 4]["n_hit"] == 0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 9  # the passage is under a twentieth of the long texts


def test_lines(docs):
    rows = {r["id"]: r for r in linededup.line_report(docs).collect()}
    assert rows[1]["n_lines"] == 703 and rows[1]["n_dup_lines"] == 1 and rows[1]["n_near_lines"] == 0
    assert rows[6]["n_near_lines"] == 1 and list(rows[6]["first_ids"]) == [1] and rows[2]["n_lines"] == 0
    kept = linededup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == 9


def test_urls(spark):
    long_path = "/" + "p" * 50_000
    pages = spark.createDataFrame([(1, f"http://x.net{long_path}"), (1, f"http://x.net{long_path}"), (2, None), (None, "http://y.com/de/")], "page_id long, url string").withColumns({c: F.lit("clash") for c in CLASHES})
    listed = spark.createDataFrame([(f"https://www.x.net{long_path}/",)], "url string")
    got = urlfilter.judge(pages, listed).collect()
    assert sorted((r["id"] or 0, r["verdict"], r["listed"]) for r in got) == [(0, "block", False), (1, "block", True), (1, "block", True), (2, "allow", False)]


def test_archives(spark):
    payload = "WARC/1.1\r\n" * 9 + "é" * 150_000 + "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = spark.createDataFrame([(1, "u", payload), (2, "v", payload), (3, None, None)], "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASHES if c != "url"})
    path = Scratch(spark, "odd").new_path("warc")
    warc.write_archives(pages, path)
    got = {r["id"]: r for r in warc.read_archives(spark, path, with_payload=True).collect()}
    assert got[2]["payload"].decode() == payload and got[2]["payload_digest"] == got[1]["payload_digest"] == hashlib.sha1(payload.encode()).hexdigest()
    assert got[1]["refers_to"] == 2 and got[3]["payload_bytes"] == 0 and got[2]["intact"]
    empty = Scratch(spark, "odd").new_path("warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0
