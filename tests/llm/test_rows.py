"""Row-wise operators: archives, rules, mixtures, languages, shards, URL filters, token counts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import langid, mixing, quality, sharding, tokens, urlfilter, warc
from sluice.llm.shared import Scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("with_payload", [False, True])
def test_archives_round_trip(spark, small_splits, with_payload):
    rng = random.Random(1)
    large = "x" * 1500
    whole = "pre WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 77\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n tail"
    nested = "a" * 1200 + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\n é" + "b" * 3000
    rows = [(1, "http://a/é\r\nX", large), (2, None, large), (3, "u", None), (4, "u", ""), (5, "u", whole), (6, "u", nested), (7, "u", nested)]
    rows += [(None, "u", large), (None, None, "ü" * 700), (9, "u", "y" * 999), (10, "u", "y" * 999)]
    rows += [(100 + i, f"u{i}", "é" * rng.randrange(900) + "WARC/1." * rng.randrange(3)) for i in range(30)]
    path = Scratch(spark, "archives").new_path("warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    expected = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        revisit = len(body) >= 1000 and bool(same) and (page is None or page < max(same))
        expected.append((page, "revisit" if revisit else "response", max(same) if revisit else None, len(body), hashlib.sha1(body).hexdigest(), True) + (((None if revisit else body),) if with_payload else ()))
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.read_archives(spark, path, with_payload=with_payload).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_broken_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nbody\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\ncut")
    with pytest.raises(ValueError, match="file's end"):
        warc.read_archives(spark, str(tmp_path))
    assert [r["payload_bytes"] for r in warc.read_archives(spark, str(tmp_path), strict=False).collect()] == [4]


def brute_quality(text):
    import re

    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "#* $a\n#* $a\n\n", "one", "\x0b\x0cx\x85y é\r\n"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) + rng.choice(["", "\nx y\nx y", "\r\nq"]) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, "a b")], "doc_id long, text string").withColumn("words", F.lit(1))
    got = quality.quality(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["id"] is not None:
            n, chars, symbols, dups, repeats = brute_quality(texts[r["id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeats)
            assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
            assert not (r["base_failed"] and r["kept"])
    assert quality.quality(df.limit(0)).count() == 0


def test_quality_rules_keep_prose_and_reject_junk(spark):
    prose = "The cat sat on the mat and looked at the dog. It was a fine day for a walk in the park with friends."
    junk = "### $$$ %%% &&& *** ||| <<< >>> ### $$$ word %%% &&& here"
    got = {r["id"]: r["kept"] for r in quality.quality(spark.createDataFrame([(1, prose), (2, junk)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_exponent_meets_its_target():
    counts = {"a": 1000, "b": 100, "c": 10, "none": 0}
    for limit in (1.0, 2.0, 4.0):
        shares = mixing.weights(counts, mixing.exponent_for(counts, 1110, limit))
        assert mixing.repeats(counts, shares, 1110) <= limit * (1 + 1e-9)
        assert math.isclose(sum(shares.values()), 1)
    flat = mixing.exponent_for(counts, 1110, None, 0.8)
    assert math.isclose(mixing.entropy(mixing.weights(counts, flat)), 0.8, rel_tol=1e-6)
    assert mixing.weights({}, 0.5) == {}


def mixed_by_hand(spark, df, rows, max_repeats, blocks):
    """The mixture by plain loops over the rows; hashes are Spark's."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn")
    hashed = df.select("doc_id", "text", mixing._source(df, "source").alias("source"), mixing._key(df, "doc_id", "text").alias("key"), turn)
    hashed = hashed.select("*", mixing._place(F.col("key"), 0, F.col("turn")).alias("place"), mixing._rank_key(F.col("key"), 0, F.col("turn")).alias("order")).collect()
    count = lambda t: len([w for w in (t or "").split() if w])
    tokens = Counter()
    for _, text, source in rows:
        tokens[source or ""] += count(text)
    sources = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    planned = {r["source"]: r for r in mixing.plan(sources, None, max_repeats).collect()}
    shares = mixing.weights(tokens, mixing.exponent_for(tokens, sum(tokens.values()), max_repeats))
    assert all(planned[s]["weight"] == pytest.approx(w, abs=1e-9) for s, w in shares.items())
    out = []
    for source, total in tokens.items():
        uses = planned[source]["repeats"]
        for turn in range(max(1, math.ceil(uses))):
            own = sorted((r for r in hashed if r["source"] == source and r["turn"] == turn), key=lambda r: r["place"])
            for r in own:
                share = turn + (sum(count(o["text"]) for o in own if o["place"] < r["place"]) / total if total else 0.0)
                if share < uses:
                    out.append([r["doc_id"], source, turn, min(blocks - 1, math.floor(share / uses * blocks)), r["order"]])
                elif turn == 0:
                    out.append([r["doc_id"], source, None, None, None])
    for block in range(blocks):
        for position, row in enumerate(sorted((r for r in out if r[3] == block), key=lambda r: r[4])):
            row[4] = position
    return out


@pytest.mark.parametrize(("local", "parts"), [(100_000, 256), (0, 1)])
def test_mixture_equals_a_plain_loop(spark, monkeypatch, local, parts):
    monkeypatch.setattr(mixing, "LOCAL_SOURCES", local)
    monkeypatch.setattr(mixing, "PARTS", parts)
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randrange(1, 40)), rng.choice(["big"] * 12 + ["mid"] * 3 + ["tiny", None])) for i in range(500)]
    rows += [(None, None, "big"), (5, "", "empty"), (6, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("weight", F.lit("clash")).withColumn("turn", F.lit("x"))
    got = mixing.mixture(df, max_repeats=3.0, blocks=8).collect()
    want = mixed_by_hand(spark, df, rows, 3.0, 8)
    assert Counter((r["id"], r["source"], r["copy"], r["block"], r["position"]) for r in got) == Counter(map(tuple, want))
    assert len({(r["block"], r["position"]) for r in got if r["copy"] is not None}) == sum(r["copy"] is not None for r in got)
    mixed = mixing.mix(df, max_repeats=3.0, blocks=8)
    assert mixed.columns == df.columns
    order = [r["doc_id"] for r in mixed.collect()]
    assert order == [r[0] for r in sorted((w for w in want if w[3] is not None), key=lambda r: (r[3], r[4]))]


def test_mixture_keeps_weights_and_odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randrange(1, 60)), rng.choice(["big"] * 12 + ["mid"] * 3 + ["tiny"])) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(df, max_repeats=3.0).collect()
    whole = sum(len(t.split()) for _, t, _ in rows)
    for source in ("big", "mid", "tiny"):
        own = [r for r in got if r["source"] == source]
        used = sum(r["n_tokens"] for r in own if r["copy"] is not None)
        assert own[0]["weight"] * whole - 1e-6 <= used <= own[0]["weight"] * whole + 60
        assert {r["id"] for r in own} == {i for i, _, s in rows if s == source}
    same = spark.createDataFrame([(1, "a b", "s")] * 3 + [(None, None, None)] * 2, df.schema)
    assert sorted((r["id"] or 0, r["copy"]) for r in mixing.mixture(same).collect() if r["copy"] is not None) == [(1, 0)] * 3
    assert mixing.mixture(same).count() == 5 and mixing.mix(same).count() == 3
    assert mixing.mixture(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    turns = {}
    for r in mixing.mixture(df.where("source = 'tiny'"), budget=3 * sum(len(t.split()) for _, t, s in rows if s == "tiny"), max_repeats=3.0).collect():
        turns.setdefault(r["copy"], []).append((r["block"], r["position"], r["id"]))
    orders = [tuple(i for *_, i in sorted(v)) for v in turns.values()]
    assert len(orders) == 3 and len(set(orders)) == 3


def texts_by_language(n):
    rng = random.Random(8)
    stems = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "quick brown fox jumps over".split(), "cc": "über straße grün schön".split()}
    return [(i, " ".join(rng.choice(stems[k]) for _ in range(rng.randrange(5, 40))), k) for i in range(n) for k in [rng.choice(sorted(stems))]]


def test_language_accuracy_and_odd_texts(spark):
    rows = [*texts_by_language(600), (900, None, "aa"), (901, "123 ½ _", "bb"), (902, "lorem ipsum", None), (None, "quick fox", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["id"]: r for r in langid.predict(df, langid.train(df)).collect()}
    out = [r for r in rows if r[0] is not None and r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == k for i, _, k in out) >= 0.98 * len(out)
    assert all(got[i]["held_out"] for i, *_ in out) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[None]["lang_pred"] == "bb"
    kept = langid.keep_known(df.withColumn("score", F.lit("clash")), langid.train(df))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and {900, 901}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(df, langid.train(df)).collect()} == {("und", 0.0)}
    assert langid.predict(df.limit(0), langid.train(df.limit(0))).count() == 0


def test_language_long_text_is_read_whole():
    model = langid.fit([(*langid._counted(t), k) for _, t, k in texts_by_language(200)], langid.np.ones(langid.DIMENSIONS))
    assert model.predict("lorem ipsum " * 40_000 + "quick brown fox " * 200_000)[0] == "bb"


def test_language_counts_every_ngram_once(monkeypatch):
    text = "Ünd so weiter, " * 40
    index, count = langid._counted(text)
    monkeypatch.setattr(langid, "_CHUNK", 7)
    cut = langid._counted(text)
    assert (index == cut[0]).all() and (count == cut[1]).all() and count.sum() == 3 * len(text) - 3


def test_language_learns_rare_labels(spark):
    rare = [(10_000 + i, f"zorg blip {'qwax ' * (i % 4 + 1)}", "zz") for i in range(12)]
    df = spark.createDataFrame([*texts_by_language(900), *rare], "doc_id long, text string, lang string")
    model = langid.train(df, fit_rows=60)
    assert model.labels == ["aa", "bb", "cc", "zz"] and model.predict("zorg blip qwax qwax")[0] == "zz"
    assert langid.quotas({"a": 1000, "b": 3, "c": 500}, 60) == {"b": 3, "c": 28, "a": 29}


@pytest.mark.parametrize("n", [0, 1, 39, 41, 1000])
def test_shards_are_even(spark, n):
    df = spark.createDataFrame([(i if i % 3 else 7, "é" * (i % 50) if i % 9 else None) for i in range(n)], "doc_id long, text string").withColumn("shard", F.lit("x"))
    rows = sharding.shard(df).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == n and set(counts) <= set(range(40))
    assert max([counts.get(s, 0) for s in range(40)]) - min([counts.get(s, 0) for s in range(40)]) <= 1
    for s, k in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k))
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())


def test_a_further_shard_moves_few_rows(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before = {r["id"]: r["shard"] for r in sharding.shard(df, shards=10, slack=0.25).collect()}
    after = {r["id"]: r["shard"] for r in sharding.shard(df, shards=11, slack=0.25).collect()}
    assert max(Counter(after.values()).values()) <= math.ceil(4000 * 1.25 / 11)
    assert sum(before[i] != after[i] for i in before) < 0.25 * 4000
    even, grown = ({r["id"]: r["shard"] for r in sharding.shard(df, shards=n).collect()} for n in (40, 41))
    assert sum(even[i] != grown[i] for i in even) < 0.15 * 4000


def clockwise(spark, rows, shards):
    """Shard counts and places by walking the ring row by row: arcs in order, rows of an arc by hash and mark."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = df.select("doc_id", F.xxhash64(F.lit("key"), F.col("doc_id").cast("string")).alias("h"), F.xxhash64(F.lit("row"), F.col("doc_id").cast("string"), "text").alias("m")).collect()
    nodes, bits = sharding.ring(spark, shards), sharding.ring_bits(shards)
    room = sharding.capacities(len(rows), shards)
    out = []
    for r in sorted(hashes, key=lambda r: ((r["h"] % 2**64) >> (64 - bits), r["h"], r["m"])):
        arc = (r["h"] % 2**64) >> (64 - bits)
        at = next((k for k, node in enumerate(nodes) if node[0] >= arc), 0)
        while room[nodes[at % len(nodes)][1]] == 0:
            at += 1
        shard = nodes[at % len(nodes)][1]
        room[shard] -= 1
        out.append((r["doc_id"], shard))
    return Counter(out)


@pytest.mark.parametrize(("at_once", "partitions"), [(200_000, 1), (200_000, 7), (4, 3)])
def test_shards_equal_a_walk_on_the_ring(spark, monkeypatch, at_once, partitions):
    monkeypatch.setattr(sharding, "ROWS_AT_ONCE", at_once)
    rows = [(i, f"t{i % 5}") for i in range(300)] + [(7, f"other {i}") for i in range(40)] + [(8, "same")] * 60 + [(None, None)] * 3
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions), shards=9).collect()
    if at_once > 1000:
        assert Counter((r["id"], r["shard"]) for r in found) == clockwise(spark, rows, 9)
    counts = Counter(r["shard"] for r in found)
    assert len(found) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in found if r["shard"] == s) == list(range(k)) for s, k in counts.items())


@pytest.mark.parametrize("at_once", [200_000, 4])
def test_shards_do_not_depend_on_partitions(spark, monkeypatch, at_once):
    monkeypatch.setattr(sharding, "ROWS_AT_ONCE", at_once)
    rows = [(i % 400, f"text {i % 390}") for i in range(1000)] + [(7, f"t{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, seven = (Counter(map(tuple, sharding.shard(df.repartition(n)).collect())) for n in (1, 7))
    assert one == seven


def test_urls(spark):
    urls = ["https://WWW.Example.org/es/1?x=1", "http://a.example.org/en/12", "https://org/", "http://x.org", "https://b.com/fr/a", "https://b.com/de/", "https://notexample.net/es/1", None, "no scheme", "http://Bad.net/a/?utm_source=f&b=2&a=1#t", "http://bad.net/a"]
    pages = spark.createDataFrame(list(enumerate([*urls, urls[0]])), "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("http://www.bad.net:80/a?a=1&b=2",), (None,), ("http://www.bad.net/a?b=2&a=1",)], "url string")
    got = {r["id"]: tuple(r)[1:] for r in urlfilter.judge(pages, listed).collect()}
    assert got[0] == got[11] == ("www.example.org", "/es/1", "example.org/es/", False, "block")
    assert got[1][2:] == ("example.org/en/1", False, "block") and got[2][2:] == ("org/", False, "allow")
    assert got[3][:3] == ("x.org", "", None) and got[4][4] == "allow" and got[5][4] == "block"
    assert got[6][2:] == (None, False, "allow") and got[7][:2] == got[8][:2] == ("", "")
    assert got[9][3:] == (True, "block") and got[10][3:] == (False, "allow")
    assert urlfilter.judge(pages, listed.limit(0)).where("listed").count() == 0 and urlfilter.judge(pages.limit(0), listed).count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), F.col("id").cast("string")).alias("url"))
    found = urlfilter.judge(pages, pages.where("page_id % 3 = 0").select("url"), bits_a_url=4)
    assert found.where("listed").count() == 1000 and found.where("listed and id % 3 <> 0").count() == 0


def test_token_counts(spark):
    rng = random.Random(9)
    prose = " ".join(rng.choice(["Don't", "stop", "naïve", "x<|endoftext|>y", "  gap", "12,5", "日本", "\n\n tab\t"]) for _ in range(3000))
    texts = [None, "", "<|endoftext|>", "  ", prose, "a" * 5000, prose * 3, "é" * 3000]
    library = Tokenizer.from_file(TOKENIZER)
    exact = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert tokens.count_tokens([(t or "").encode() for t in texts], TOKENIZER, 1000, 200) == exact
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(df, TOKENIZER).collect()}
    assert got == {i: (len((t or "").encode()), n, n > 1024) for i, (t, n) in enumerate(zip(texts, exact, strict=True))}
    assert tokens.token_counts(df.limit(0), TOKENIZER).count() == 0


def test_pieces_make_the_text():
    text = b"word " * 1000 + "日本 und so ".encode() * 50
    assert b"".join(tokens.pieces(text, 64)) == text and max(map(len, tokens.pieces(text, 64))) < 100


def test_batches_are_balanced_by_bytes():
    texts = ["日本語" * 100, "a" * 900, "b c " * 900, "", "é" * 450] * 5
    found = list(tokens.batches([t.encode() for t in texts], 2000, 1000))
    assert all(sum(map(len, batch)) <= 2000 for _, batch in found)
    assert all(sum(map(len, one[1])) + len(other[1][0]) > 2000 for one, other in zip(found, found[1:], strict=False))
    whole = [b""] * len(texts)
    for owners, batch in found:
        for i, piece in zip(owners, batch, strict=True):
            whole[i] += piece
    assert [w.decode() for w in whole] == texts
