"""The pipeline's stages on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from sluice.llm import decontaminate, mixing

SF = "/root/testdata/sf0.001"


def kept_by_hand(rows):
    """The smallest id of each group of documents whose five-word shingles overlap by 0.8, by comparing all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        words = [w for w in re.split(r"[ \t-\r]+", (text or "").translate(lower)) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in sets})


def test_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "shards"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, first = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept[name] = (before, docs)
    before, after = kept["near_duplicates"]
    assert sorted(r["doc_id"] for r in after.collect()) == kept_by_hand([(r["doc_id"], r["text"]) for r in before.collect()])
    before, after = kept["decontamination"]
    found = decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["id"] for r in found.where(~decontaminate.contaminated()).collect())
    assert kept["language"][1].count() >= 0.95 * first.count()
    before, after = kept["mixture"]
    copies = Counter(r["id"] for r in mixing.mixture(before).where("copy is not null").collect())
    assert copies and Counter(r["doc_id"] for r in after.collect()) == copies
    shards = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    sizes = [r["n"] for r in shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1


def test_empty_input_goes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_stages_take_odd_rows(spark):
    """Null text, ids, sources and labels, empty and repeated rows, and columns whose names the operators use themselves."""
    long = "der lange text und noch ein wort " * 3000
    rows = [(1, "the cat sat on the mat and the dog", "en", "a"), (1, "the cat sat on the mat and the dog", "en", "a"), (2, None, "en", None), (3, "", None, "b"), (None, "the dog sat on the cat", "en", None), (4, long, "de", "c"), (5, "ein hund und eine katze im haus", "de", "c")]
    rows += [(10 + i, f"the {w} of the {w} is on the mat" if i % 2 else f"der {w} und das {w} ist im haus", "en" if i % 2 else "de", "a") for i, w in enumerate(["cat", "hund", "tree", "baum"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("fp", "words", "key", "row", "copies", "block", "score", "place", "h", "__extra"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        if name != "shards":
            assert found.columns == docs.columns
            kept = {r["doc_id"] for r in found.collect()}
            assert kept <= {r[0] for r in rows} and (4 in kept or name == "mixture")
        else:
            assert found.count() == len(rows)
