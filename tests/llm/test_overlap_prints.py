"""Candidates by fingerprints in the groups by shared shingles."""

import random

from sluice.llm import overlap, simhash


def _rows():
    rng = random.Random(5)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows.append((2 * i, " ".join(words)))
        for _ in range(1 + i % 4):
            words[rng.randrange(len(words))] = "new"
        rows.append((2 * i + 1, " ".join(words)))
    return [*rows, (500, ""), (501, None), (502, rows[0][1] + " " + rows[0][1]), (503, rows[0][1] + " " + rows[0][1])]


def _brute(rows, linked):
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_fingerprints_find_candidates_without_bands(spark):
    rows = _rows()
    texts = {i: (t or "").encode() for i, t in rows}
    sets = {i: set(overlap.shingles(t).tolist()) for i, t in texts.items()}
    prints = {i: simhash.fingerprint(t, 5) for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    near = [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 4]
    same = {(a, b) for a, b in pairs if sets[a] == sets[b]}
    alike = [(a, b) for a, b in pairs if (a, b) in same or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    # candidates are the pairs within a component of fingerprints
    chain = _brute(rows, near)
    by_print = [(a, b) for a, b in alike if (a, b) in same or chain[a] == chain[b]]
    assert any(p not in same for p in by_print) and len(by_print) < len(alike)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in overlap.near_duplicates(df, bands=0).collect()}
    assert got == _brute(rows, by_print)
    assert {r["id"]: r["component_id"] for r in overlap.near_duplicates(df).collect()} == _brute(rows, alike)
