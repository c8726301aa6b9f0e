"""Duplicates among rows whose row ids repeat or are null."""

import pytest

from sluice.operators import dedupe, events
from sluice.plans.policy import make_policy

ROWS = [(1, "a", 1.0), (1, "a", 1.0), (2, "a", 1.0), (3, "b", 2.0), (3, "b", 2.0), (3, "b", 2.0), (4, None, None), (4, None, None), (None, "c", 5.0), (None, "c", 5.0), (7, "c", 5.0), (None, "d", 1.0), (None, "d", 1.0)]


def _kept(spark, own):
    df = spark.createDataFrame(ROWS, "_row_id long, k string, v double").repartition(3)
    return sorted(events.kept(dedupe.deduplicate(events.start(df), make_policy({"deduplication": own}))).collect(), key=str)


def test_exact_duplicates_with_one_row_id(spark):
    kept = _kept(spark, {})
    assert sorted((str(r["k"]), r["_row_id"]) for r in kept) == [("None", 4), ("a", 1), ("b", 3), ("c", 7), ("d", None)]


@pytest.mark.parametrize("strategy", ["keep_first", "keep_last", "keep_max", "keep_min"])
def test_one_row_a_key_with_one_row_id(spark, strategy):
    kept = _kept(spark, {"keys": ["k"], "strategy": strategy, "order_by": "v" if strategy in ("keep_max", "keep_min") else None, "exact_row_duplicates": "keep"})
    assert sorted((str(r["k"]), r["_row_id"]) for r in kept) == [("None", 4), ("a", 2 if strategy == "keep_last" else 1), ("b", 3), ("c", 7), ("d", None)]
