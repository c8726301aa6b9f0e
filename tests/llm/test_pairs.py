"""SimHash groups, near lines and benchmark passages against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import components, decontaminate, linededup, simhash
from sluice.llm.shared import Scratch

WORDS = ["alpha", "beta", "Gamma", "delta", "é", "the", "of", "zeta", "eta", "theta"]


def ascii_low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", ascii_low(text or ""))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + 4]).encode(), 42) for i in range(max(1, len(found) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, items):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def documents(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        if rows and rng.random() < 0.5:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 200)))))
    return [*rows, (500, None), (501, ""), (502, " \t\n"), (503, "A b"), (504, "a\x0bB")]


@pytest.mark.parametrize("segments", [None, 2, 3, 4, 5])
def test_groups_equal_brute_force(spark, segments):
    rows = documents(1)
    prints = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = union(near, ids)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df, n_segments=segments, block=8).collect()}
    assert got == {i: (prints[i], roots[i]) for i in ids}


def test_groups_of_odd_rows(spark):
    schema = "doc_id long, text string, fp string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "same words here now", "x"), (7, "same words here now", "y"), (7, "same words here now", "z"), (None, "lonely words of none", "q"), (None, "lonely words of none", "r")]
    df = spark.createDataFrame(rows, schema)
    got = simhash.near_duplicates(df).collect()
    assert sorted((r["component_id"] is None, r["component_id"]) for r in got if r["component_id"] is not None) == [(False, 7)] * 3
    kept = simhash.keep_one(df)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "lonely words of none"), (7, "same words here now")]


def test_keep_one_keeps_the_smallest_id(spark):
    rows = documents(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r["id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted(set(groups.values()))


def test_plans_of_every_size_have_a_ball():
    for rows in (0, 10, 1_000, 100_000, 10**7, 10**9, 10**11):
        assert any(radius for *_, radius in simhash.segment_plan(simhash.segments_for(rows)))


def test_fingerprint_of_a_very_long_text():
    rng = random.Random(12)
    text = " ".join(f"{rng.choice(WORDS)}{rng.randrange(9)}" for _ in range(120_000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_segment_plan_finds_every_distance(segments):
    rng = random.Random(segments)
    plan = simhash.segment_plan(segments)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any((flips >> s & (1 << w) - 1).bit_count() <= r for s, w, r in plan)


def test_components_of_a_long_chain_and_a_star(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300)]
    rng.shuffle(chain)
    found = components.components(spark, spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "t")).read()
    assert {(r["u"], r["v"]) for r in found.collect()} == {(i, 0) for i in range(1, 61)} | {(i, 100) for i in range(101, 180)}
    assert components.components(spark, spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).read().count() == 0


def brute_contamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_low(t or ""))
    windows = [(i, w[k : k + min(13, len(w))]) for i, w in ((i, split(t)) for i, t in items) for k in range(max(1, len(w) - 12)) if w]
    out = {}
    for d, text in docs:
        words, hit, ids = split(text), set(), set()
        for item, window in windows:
            for s in range(len(words) - len(window) + 1):
                if words[s : s + len(window)] == window:
                    hit.update(range(s, s + len(window)))
                    ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out[d] = (len(words), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_equals_brute_force(spark, limit):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "Cc", "É", "x9", "dd", "e-e"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(12)] + [(90, None), (91, ""), (92, "-- ,")]
    items.append((200, items[3][1]))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"zz {rng.choice(items)[1]}, {' '.join(word() for _ in range(9))} {rng.choice(items)[1]} yy") for i in range(25)]
    docs += [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("fp", F.lit(1))
    found = decontaminate.digest(decontaminate.contamination(df, bench, broadcast_bytes=limit))
    assert {r["id"]: tuple(r)[1:] for r in found.collect()} == brute_contamination(docs, items)


def test_contamination_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "three"), (None, "one two")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, none).collect()) == [(1, 0, []), (2, 0, []), (2, 0, [])]
    bench = spark.createDataFrame([(None, "one two")], "item_id long, text string")
    assert sorted(r["n_hit"] for r in decontaminate.contamination(docs, bench).collect()) == [0, 2, 2]
    assert [r["text"] for r in decontaminate.clean(docs, bench).collect()] == ["three"]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(chars) + 1), rng.randrange(3)
        if kind == 0:
            chars.insert(at, rng.choice("abcé"))
        elif at < len(chars):
            chars[at : at + 1] = [] if kind == 1 else [rng.choice("abcé")]
    return "".join(chars)


def test_banded_distance(spark):
    rng = random.Random(4)
    pairs = [(t, mutated(rng, t, rng.randrange(5))) for t in ("".join(rng.choice("abcé") for _ in range(rng.randrange(40))) for _ in range(300))]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        true = edit_distance(r["a"], r["b"])
        assert r["d"] == (true if true <= 2 else None)


def near_lines(unique, chars_an_edit):
    most = lambda a, b: min(2, min(len(a), len(b)) // chars_an_edit)
    return [(a, b) for i, a in enumerate(unique) for b in unique[:i] if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= most(a, b)]


@pytest.mark.parametrize(("chars_an_edit", "hot", "block"), [(5, 64, 1024), (5, 3, 4), (1, 3, 4), (2, 64, 1024)])
def test_near_lines_equal_brute_force(spark, monkeypatch, chars_an_edit, hot, block):
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "BLOCK", block)
    rng = random.Random(6)
    lines = []
    for k in range(40):
        base = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 40) if k % 2 else rng.randrange(0, 11))) + "z"
        lines += [base, *(mutated(rng, base, rng.randrange(4)) for _ in range(3))]
    lines += ["hello world", "hello worlt", *(f"Listing number 0{rng.randrange(1000):03d} of the page" for _ in range(40))]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(8)))) for i in range(90)] + [(200, None), (201, ""), (202, "\n \n")]
    places = [(i, k, t) for i, text in docs for k, t in enumerate((text or "").split("\n")) if t.strip(" \t\n\r\x0b\f")]
    unique = sorted({t for *_, t in places})
    roots, first = union(near_lines(unique, chars_an_edit), unique), {}
    for i, k, t in sorted(places):
        first.setdefault(roots[t], (i, k))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit("clash"))
    got = {r["id"]: (r["n_lines"], r["n_dup_lines"], list(r["first_ids"])) for r in linededup.line_report(df, chars_an_edit=chars_an_edit).collect()}
    for i, _ in docs:
        own = [(k, t) for j, k, t in places if j == i]
        dups = [first[roots[t]][0] for k, t in own if first[roots[t]] != (i, k)]
        assert got[i] == (len(own), len(dups), sorted(set(dups)))
    if hot == 64:
        kept = linededup.without_repeats(df, chars_an_edit=chars_an_edit).collect()
        assert sum(1 for r in kept for t in (r["text"] or "").split("\n") if t.strip()) == len(first)
        assert linededup.line_report(df.limit(0)).count() == 0


def test_many_lines_that_share_segments(spark):
    """20,000 lines of one form are one class; as many that share only their start stay apart. Pairs would be 400 million."""
    form = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Listing number "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" of the catalogue page")).alias("text"))
    apart = spark.range(20_000).select((F.col("id") + 50_000).alias("doc_id"), F.concat(F.lit("Copyright of the works: "), F.md5(F.col("id").cast("string"))).alias("text"))
    found = linededup.line_classes(form.unionByName(apart)).groupBy("first_id").agg(F.count(F.lit(1)).alias("n"))
    assert {(r["n"] > 1, r["first_id"] if r["n"] > 1 else None) for r in found.collect()} == {(True, 0), (False, None)}
