"""Groups by shared shingles against brute-force Jaccard similarity."""

import random

import corpus_pipeline

from sluice.llm import overlap

SF = "/root/testdata/sf0.001"


def smallest(pairs, items):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def shingle_sets(rows):
    words = {i: t.lower().split() for i, t in rows}
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}


def test_near_duplicates_equal_brute_force_jaccard(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        else:
            words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 140))]
        rows.append((i, " ".join(words)))
    rows += [(300, ""), (301, " \n")]
    sets = shingle_sets(rows)
    close = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)]
    roots = smallest(close, sorted(sets))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    assert kept == sorted(set(roots.values())) and any(sets[a] != sets[b] for a, b in close)
    got = overlap.near_duplicates(df, block=8).collect()
    assert {r["id"]: r["component_id"] for r in got} == roots
