"""Detailed logs pass through the driver without being held there."""

import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from sluice.operators import events
from sluice.plans import contracts, registry
from sluice.sources import tables

MOST = 4 << 20


@pytest.fixture(scope="module")
def many_orders(spark, tmp_path_factory):
    """Orders of which a log has some 12,600 lines, about 2.5 MB of text."""
    folder = tmp_path_factory.mktemp("orders")
    spark.range(60_000).select(
        *(F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice")),
        *(F.lit("1995-01-02").cast("timestamp_ntz").alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority")),
    ).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def _peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_audit_log_is_not_held_on_the_driver(spark, many_orders):
    found, most = _peak(lambda: registry.queries()["audit_log"](spark, many_orders))
    assert most < MOST
    rows = found.orderBy("line").collect()
    assert [r["line"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 6000 + 6667 + 1
    assert rows[-1]["event_type"] == "job_summary" and [r["event_type"] for r in rows].count("job_summary") == 1
    assert [(r["column"], r["row_id"]) for r in rows[:-1]] == sorted((r["column"], r["row_id"]) for r in rows[:-1])


def test_lines_written_by_tasks_are_those_of_json_line(spark):
    schema = "event_type string, row_id long, column string, old_value string, new_value string, reason string, policy_section string, timestamp string, violation_count long"
    odd = 'a"\\ é\n\t'
    found = spark.createDataFrame([("x", 2, "b", odd, None, None, "s", "t", None), ("y", None, "a", None, "", "r", "s", "t", 3)], schema)
    lines = [json.loads(r["value"]) for r in events.json_lines(found).collect()]
    rows = [r.asDict() for r in found.orderBy("column").collect()]
    assert lines == [tables.plain({k: v for k, v in r.items() if v is not None or k.endswith("value")}) for r in rows]
    assert [list(line) for line in lines] == [sorted(line) for line in lines]


def test_odd_values_keep_a_log_valid(spark, tmp_path):
    schema = "event_type string, row_id long, column string, old_value string, new_value string, reason string, policy_section string, timestamp string"
    found = spark.createDataFrame([("x", i, "c", "p q\x85r\x1ds\n", None, "r", "s", "t") for i in range(5)], schema)
    events.write_audit(found, tmp_path / "a.jsonl", "detailed")
    contracts.validate_audit_log(tmp_path / "a.jsonl")
    assert not list(tmp_path.glob(".*"))
    events.write_audit(found.limit(0), tmp_path / "a.jsonl", "detailed")
    contracts.validate_audit_log(tmp_path / "a.jsonl")
    for bad in ("", "\n".join((tmp_path / "a.jsonl").read_text().splitlines() * 2)):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(ValueError):
            contracts.validate_audit_log(tmp_path / "b.jsonl")


def test_contracts_hold_no_log_on_the_driver(spark, many_orders):
    found, most = _peak(lambda: registry.queries()["contracts"](spark, many_orders))
    assert most < MOST
    assert {r["what"] for r in found.collect() if r["valid"]} == {"audit", "profile", "report"}
