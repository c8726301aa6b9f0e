"""More registered queries: details of parsing, profiles, inference, audit, reports, sources and sinks, streams and the command line.

Files that a query needs are made from the fixture tables in the shared scratch folder; small records lie on the driver.
"""

from __future__ import annotations

import json
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.columns import ROW_ID
from sluice.operators import events, impute, profile
from sluice.plans import contracts, infer, pipeline, registry, report
from sluice.plans.learning import LearningStore
from sluice.plans.policy import PolicyError, make_policy, save_policy, unknown_columns
from sluice.plans.registry import CLOCK, ORDERS_POLICY, Query
from sluice.sources import tables
from sluice.sources.scratch import Scratch
from sluice.streaming.apply import correct_stream

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_ORDERS, _EVENTS = registry.ORDERS_SQL, registry.EVENTS_SQL
_PRICE, _TOKENS = registry._PRICE, registry._TOKENS


def _query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _values(*rows: tuple) -> str:
    """A SQL table of fixed rows with columns given by the first one."""
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    names = ", ".join(f'"{n}"' for n in rows[0])
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows[1:])}) AS t({names})"


# Details of parsing: one dirty column of orders each.
_M = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)"
_D = {p: f"lpad(CAST(extract({p} FROM o_orderdate) AS STRING), 2, '0')" for p in ("day", "month")}
_DAY = "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)"
_SMALL = "CAST(o_orderkey % 100 AS STRING)"
_PARSED: dict[str, tuple[str, str, dict[str, Any], str]] = {
    "parse_commas": (f"concat(substr({_M}, 1, length({_M}) - 6), CASE WHEN length({_M}) > 6 THEN ',' ELSE '' END, substr({_M}, greatest(length({_M}) - 5, 1)))", "float", {}, f"CAST({_M} AS DOUBLE)"),
    "parse_spaced": (f"concat(substr({_M}, 1, length({_M}) - 6), CASE WHEN length({_M}) > 6 THEN ' ' ELSE '' END, substr({_M}, greatest(length({_M}) - 5, 1)))", "float", {}, f"CAST({_M} AS DOUBLE)"),
    "parse_suffixes": (
        f"concat({_SMALL}, '.5', CASE o_orderkey % 4 WHEN 0 THEN 'k' WHEN 1 THEN ' M' WHEN 2 THEN 'b' ELSE 'T' END)",
        *("float", {}, "(o_orderkey % 100 + 0.5) * CASE o_orderkey % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 ELSE 1e12 END"),
    ),
    "parse_signs": (
        f"concat(CASE o_orderkey % 4 WHEN 0 THEN '–' WHEN 1 THEN '+' WHEN 2 THEN '++' ELSE '(' END, {_SMALL}, CASE WHEN o_orderkey % 4 = 3 THEN ')' ELSE '' END)",
        *("float", {}, "CAST(CASE o_orderkey % 4 WHEN 1 THEN o_orderkey % 100 WHEN 2 THEN NULL ELSE -(o_orderkey % 100) END AS DOUBLE)"),
    ),
    "parse_percent_kept": (f"concat({_SMALL}, ' %')", "float", {"numeric": {"percent_scale": "0_100"}}, "CAST(o_orderkey % 100 AS DOUBLE)"),
    "parse_codes": (f"CASE o_orderkey % 3 WHEN 0 THEN concat('rs. ', {_SMALL}) WHEN 1 THEN concat({_SMALL}, 'chf') ELSE concat('kr ', {_SMALL}) END", "float", {"currency_symbols": ["kr"]}, "CAST(o_orderkey % 100 AS DOUBLE)"),
    "parse_formats": (f"concat({_D['day']}, '.', {_D['month']}, '.', substr(CAST(extract(year FROM o_orderdate) AS STRING), 3, 2))", "date", {"datetime": {"allowed_formats": ["%d.%m.%y"]}}, _DAY),
    "parse_day_first": (f"concat({_D['day']}, '/', {_D['month']}, '/', CAST(extract(year FROM o_orderdate) AS STRING))", "date", {"datetime": {"dayfirst": True}}, _DAY),
    "parse_zones": ("concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:30:00+02:00')", "timestamp", {}, f"{_DAY} + INTERVAL 8 HOUR + INTERVAL 30 MINUTE"),
    "parse_bounds": (
        "CASE o_orderkey % 3 WHEN 0 THEN '1600-01-01' WHEN 1 THEN '2300-06-30' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
        *("date", {}, f"CASE WHEN o_orderkey % 3 = 2 THEN {_DAY} END"),
    ),
    "parse_own_words": (
        "CASE o_orderkey % 3 WHEN 0 THEN ' Aye' WHEN 1 THEN 'nay' ELSE 'yes' END",
        *("boolean", {"boolean_columns": {"v": {"true_values": ["aye"], "false_values": ["nay"]}}}, "CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END"),
    ),
}


def _parsed(expression: str, kind: str, rules: dict[str, Any]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"o_orderkey AS {ROW_ID}", "o_orderkey", f"{expression} AS v")
        out = pipeline.correct(df, registry._policy(parsing={"column_types": {"v": kind}} | rules), CLOCK).table()
        return out.withColumn("v", F.round("v", 6)) if kind == "float" else out

    return run


for _name, (_dirty, _kind, _rules, _meaning) in _PARSED.items():
    QUERIES[_name] = _parsed(_dirty, _kind, _rules)
    ORACLES[_name] = f"SELECT o_orderkey, {f'round({_meaning}, 6)' if _kind == 'float' else _meaning} AS v FROM orders"


@_query(
    "parse_bounds_events",
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 = 3 THEN 'invalid_datetime' ELSE 'datetime_out_of_bounds' END AS reason FROM orders WHERE o_orderkey % 4 <> 2) GROUP BY reason",
)
def parse_bounds_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE o_orderkey % 4 WHEN 2 THEN '2001-02-03' WHEN 3 THEN '2001-99-99' ELSE '1600-01-01' END"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"o_orderkey AS {ROW_ID}", f"{text} AS v")
    found = pipeline.correct(df, registry._policy(parsing=registry._types(v="date")), CLOCK).events()
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# Profiles and scores.
_BAD_PRICE = "(price = 'twelve' OR price LIKE '(%' OR price LIKE '% EUR' OR price LIKE '%K')"


@_query(
    "profile_failures",
    f"""SELECT 'price' AS "column", count(*) FILTER ({_BAD_PRICE}) AS n FROM ({_ORDERS}) UNION ALL SELECT 'day', count(*) FILTER (day = 'unknown day') FROM ({_ORDERS})
    UNION ALL SELECT 'urgent', count(*) FILTER (urgent = 'maybe') FROM ({_ORDERS})""",
)
def profile_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present values that do not read as the policy's type by the profile's simpler rules."""
    policy = make_policy({"parsing": {"column_types": {"price": "float", "day": "date", "urgent": "boolean"}}})
    found = profile.profile(registry._orders(spark, sf_dir, "price", "day", "urgent"), policy, CLOCK)
    return spark.createDataFrame([(n, c["invalid_count"]) for n, c in found["columns"].items()], "column string, n long")


_KEPT_RAW = {"parsing": {"column_types": {"price": "float"}, "numeric": {"on_failure": "keep_raw"}}, "roles": {"critical_columns": ["price"], "protected_columns": ["status"], "droppable_columns": ["urgent"]}}
_MIXED = f"(SELECT avg(CASE WHEN {_PRICE} IS NULL THEN 0.0 ELSE 1 END) BETWEEN 0.0500001 AND 0.9499999 AS m, count(*) AS n FROM ({_ORDERS}) WHERE price <> 'N/A')"


def _raw_kept(spark: SparkSession, sf_dir: str) -> dict[str, Any]:
    policy = make_policy({"standardization": registry._policy().to_dict()["standardization"]} | _KEPT_RAW)
    df = registry._orders(spark, sf_dir, "price", "status", "urgent")
    kept = pipeline.correct(df, policy, CLOCK).rows.drop("_events", "_dropped", "_violations")
    return profile.profile(kept, policy, CLOCK)


@_query(
    "profile_shape",
    f"""SELECT c AS "column", r AS role, x.m AND c = 'price' AS mixed, (SELECT count(*) FROM orders) AS n_rows, 3::BIGINT AS n_columns
    FROM (VALUES ('price', 'critical'), ('status', 'protected'), ('urgent', 'droppable')) AS t(c, r), {_MIXED} x""",
)
def profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles, rows and columns, and columns of which some values parse and some do not."""
    found = _raw_kept(spark, sf_dir)
    meta = found["metadata"]
    rows = [(n, c["role"], c["is_mixed_type"], meta["row_count"], meta["col_count"]) for n, c in found["columns"].items()]
    return spark.createDataFrame(rows, "column string, role string, mixed boolean, n_rows long, n_columns long")


@_query("readiness_consistency", f"SELECT round(10.0 * (CASE WHEN m THEN 2 ELSE 3 END) / 3, 2) AS points FROM {_MIXED}")
def readiness_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_raw_kept(spark, sf_dir)["readiness"]["breakdown"]["consistency"],)], "points double")


_FULL = f"""SELECT d.o_orderkey, round({_PRICE}, 6) AS price, CASE WHEN day = 'unknown day' THEN NULL ELSE {_DAY} END AS day, d.o_orderpriority,
  CASE WHEN d.o_orderkey % 9 = 0 THEN NULL ELSE o.o_orderstatus END AS status, CASE WHEN urgent IN ('Yes', ' T ') THEN true WHEN urgent = 'no' THEN false END AS urgent
  FROM ({_ORDERS}) d JOIN orders o ON d.o_orderkey = o.o_orderkey WHERE price NOT IN ('N/A', 'twelve', '+inf')"""


@_query(
    "full_correction",
    f"""WITH k AS ({_FULL}), m AS (SELECT status AS m FROM k WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey, price, day, o_orderpriority, coalesce(status, m) AS status, urgent FROM k, m""",
)
def full_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phases over dirty orders."""
    return pipeline.correct(registry._orders(spark, sf_dir), make_policy(ORDERS_POLICY), CLOCK).table().withColumn("price", F.round("price", 6))


_SHARE = "round(avg(CASE WHEN {} THEN 1.0 ELSE 0 END), 4)"
_DELTA = f"""WITH b AS (SELECT {_SHARE.format("price = 'N/A'")} AS pm, {_SHARE.format("trim(status) = 'nan'")} AS sm, {_SHARE.format("urgent = ''")} AS um,
    {_SHARE.format(_BAD_PRICE)} AS pb, {_SHARE.format("day = 'unknown day'")} AS db, {_SHARE.format("urgent = 'maybe'")} AS ub FROM ({_ORDERS})),
  a AS (SELECT {_SHARE.format("day IS NULL")} AS dm, {_SHARE.format("urgent IS NULL")} AS um FROM ({_FULL})),
  s AS (SELECT round(40 * (2 * (1 - pm) + (1 - sm) + (1 - b.um) + 3) / 7 + 30 * (3 - pb - db - ub) / 3 + 30 - 10 * (CASE WHEN pm > 0 OR pb > 0 THEN 1 ELSE 0 END), 2) AS raw,
    round(40 * (2 + 1 + (1 - dm) + 1 + (1 - a.um) + 1) / 7 + 60, 2) AS optimized FROM a, b)"""


@_query("readiness_delta", f"{_DELTA} SELECT raw, optimized, round(optimized - raw, 2) AS delta FROM s")
def readiness_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score before and after a full correction."""
    found = pipeline.compare(registry._orders(spark, sf_dir), make_policy(ORDERS_POLICY), CLOCK)["readiness"]["transformation"]
    return spark.createDataFrame([(found["raw"], found["optimized"], found["delta"]["score"])], "raw double, optimized double, delta double")


_ONE = "CASE WHEN {} THEN 1 ELSE 0 END"
_TOUCHED = {
    "price": ["price LIKE '  %'", "price IN ('twelve', '+inf')", "price IN ('twelve', '+inf')"],
    "day": ["day = 'unknown day'", "day = 'unknown day'"],
    "status": ["status <> trim(status)", "status LIKE '%  x %'", "upper(status) <> status", "status LIKE '%  x %'", "trim(status) = 'nan' AND price NOT IN ('N/A', 'twelve', '+inf')"],
    "urgent": ["urgent = ' T '", "urgent IN ('Yes', 'no', 'maybe')", "urgent = 'maybe'"],
}
_TOP = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", sum({' + '.join(_ONE.format(t) for t in tests)})::BIGINT AS count FROM ({_ORDERS})" for c, tests in _TOUCHED.items())


@_query("report_top_columns", _TOP)
def report_top_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a full correction changes most."""
    return report.top_columns(pipeline.correct(registry._orders(spark, sf_dir), make_policy(ORDERS_POLICY), CLOCK).events())


# Imputation beyond single values.
_EMPTY = registry._EMPTY_TYPE


@_query(
    "impute_plan",
    f"""SELECT 'event_type' AS "column", 'constant' AS strategy, 'Unknown' AS fill, round(avg(CASE WHEN {_EMPTY} THEN 1.0 ELSE 0 END), 6) AS missing, false AS skipped FROM ({_EVENTS})
    UNION ALL SELECT 'value', 'median', NULL, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6), true FROM ({_EVENTS})""",
)
def impute_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What imputation decides: columns without gaps are not listed, one is over its limit, one is filled."""
    rules = {"numeric": {"default": "median", "allow_if_missing_pct_leq": 0.05}, "categorical": {"default": "constant", "allow_if_missing_pct_leq": 0.9}}
    rows = events.start(registry._events(spark, sf_dir, "event_id", "user_id", "event_type", "value"))
    steps = impute.plan(rows, registry._policy(missing_data={"imputation": rules}))
    return spark.createDataFrame([(s["column"], s["strategy"], s["fill"], round(s["missing_pct"], 6), s["skipped"]) for s in steps], "column string, strategy string, fill string, missing double, skipped boolean")


@_query("impute_events", f"SELECT count(*) AS n, min(event_id) AS first_row, 'imputation_constant' AS reason, 'x' AS new_value, count(event_type) AS with_old FROM ({_EVENTS}) WHERE {_EMPTY}")
def impute_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"categorical": {"default": "constant", "constants": {"event_type": "x"}, "allow_if_missing_pct_leq": 1.0}}
    found = pipeline.correct(registry._events(spark, sf_dir, "event_type"), registry._policy(missing_data={"imputation": rules}), CLOCK).events()
    return found.groupBy("reason", "new_value").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.count("old_value").alias("with_old"))


@_query("impute_given", f"SELECT event_id, round(coalesce(value, 12.5), 6) AS value FROM ({_EVENTS})")
def impute_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of an earlier run instead of the table's own."""
    policy = registry._policy(missing_data={"imputation": {"numeric": {"default": "median", "allow_if_missing_pct_leq": 1.0}}})
    return pipeline.correct(registry._events(spark, sf_dir, "event_id", "value"), policy, CLOCK, {"value": {"median": 12.5}}).table().withColumn("value", F.round("value", 6))


@_query("impute_datetime", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN TIMESTAMP '2000-01-02 00:00:00' ELSE ts END AS ts FROM events")
def impute_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(f"event_id AS {ROW_ID}", "event_id", "CASE WHEN event_id % 6 <> 0 THEN ts END AS ts")
    policy = registry._policy(missing_data={"imputation": {"datetime": {"default": "constant", "constants": {"ts": "2000-01-02"}, "allow_if_missing_pct_leq": 1.0}}})
    return pipeline.correct(df, policy, CLOCK).table()


# Inference and learning.
def _sampled(column: str, tests: dict[str, str]) -> str:
    names = ("number", "datetime", "boolean")
    shares = ", ".join(f"round(avg(CASE WHEN {tests.get(n, 'false')} THEN 1.0 ELSE 0 END), 6) AS {n}" for n in names)
    inner = f"SELECT * FROM ({_ORDERS}) WHERE lower(trim({column})) NOT IN ('', 'n/a', 'nan') ORDER BY _row_id LIMIT {infer.SAMPLE}"
    return f"SELECT '{column}' AS \"column\", count(*) AS n, {shares} FROM ({inner})"


_EVIDENCE = " UNION ALL ".join(
    (_sampled("price", {"number": f"{_PRICE} IS NOT NULL"}), _sampled("day", {"datetime": "day <> 'unknown day'"}), _sampled("urgent", {"boolean": "urgent <> 'maybe'"}), _sampled("status", {}))
)


@_query("infer_evidence", _EVIDENCE)
def infer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the sample that read as numbers, dates and truth values."""
    names = ("price", "day", "urgent", "status")
    seen = infer.evidence(infer.samples(registry._orders(spark, sf_dir, *names), list(names)))
    # years and plain numbers may be read both ways; each column is compared on its own kind
    own = {"price": "number", "day": "datetime", "urgent": "boolean"}
    rows = [(c, e["n"], *(round(e[k], 6) if own.get(c) == k else 0.0 for k in ("number", "datetime", "boolean"))) for c, e in seen.items()]
    return spark.createDataFrame(rows, "column string, n long, number double, datetime double, boolean double")


@_query("infer_types", f"SELECT \"column\", CASE WHEN boolean >= 0.8 THEN 'boolean' WHEN number >= 0.5 THEN 'float' ELSE 'datetime' END AS type FROM ({_EVIDENCE}) WHERE boolean >= 0.8 OR number >= 0.5 OR datetime >= 0.4")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that inference gives the columns of dirty orders."""
    found = infer.infer_policy(registry._orders(spark, sf_dir, "price", "day", "status", "urgent"), "orders")
    return spark.createDataFrame(sorted(found["parsing"]["column_types"].items()), "column string, type string")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {
        **{"c_custkey": "c_custkey", "c_name": "c_name", "reach": "concat('u', CAST(c_custkey AS STRING), '@x.org')", "zip_area": "CAST(c_custkey AS STRING)", "salary": "concat('$', CAST(c_nationkey AS STRING))"},
        **{"city": "c_mktsegment", "tag": "c_name", "hotline": "concat('(030) ', CAST(1000000 + c_nationkey AS STRING))", "story": "concat('a long tale of ', c_mktsegment, ' and more')"},
    }
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*[f"{e} AS {n}" for n, e in text.items()])


@_query(
    "infer_roles",
    _values(
        ("column", "critical", "protected", "type", "rule"),
        *(("c_custkey", True, True, None, None), ("c_name", True, True, None, None), ("reach", True, True, None, None), ("zip_area", False, False, "text", None), ("salary", False, False, "float", "range")),
        *(("city", False, False, None, None), ("tag", True, True, None, None), ("hotline", False, True, None, None), ("story", False, True, None, None)),
    ),
)
def infer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by name or by distinct values, protected names, personal content, postal codes and money."""
    df = _people(spark, sf_dir)
    found = infer.infer_policy(df, "people")
    roles, types, rules = found["roles"], found["parsing"]["column_types"], found.get("validity_rules", {})
    rule = lambda c: "range" if c in rules.get("ranges", {}) else "regex" if c in rules.get("regex", {}) else None
    rows = [(c, c in roles["critical_columns"], c in roles["protected_columns"], types.get(c), rule(c)) for c in df.columns]
    return spark.createDataFrame(rows, "column string, critical boolean, protected boolean, type string, rule string")


@_query("infer_title_case", "SELECT c_custkey, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS city FROM customer")
def infer_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a city gets title case."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(f"c_custkey AS {ROW_ID}", "c_mktsegment AS city")
    found = infer.infer_policy(df, "cities")
    return pipeline.correct(df, make_policy({"standardization": found["standardization"]}), CLOCK).table(keep_row_id=True).select(F.col(ROW_ID).alias("c_custkey"), "city")


_LESSON = {
    "parsing": {"currency_symbols": ["kr", "$"], "boolean_columns": {"paid": {"true_values": ["aye"], "false_values": ["nay"]}}, "column_types": {"paid": "boolean"}},
    "roles": {"protected_columns": ["the_secret"]},
    "missing_data": {"imputation": {"numeric": {"default": "mean"}}},
}
_FACTS = (("mark", "kr"), ("protected_word", "secret"), ("yes", "aye"), ("no", "nay"), ("column_type", "paid=boolean"), ("fill", "numeric=mean"))


@_query("learn_facts", _values(("kind", "fact", "times"), *((*f, 1) for f in _FACTS)))
def learn_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy teaches, once however often it is learned, as read again from the store."""
    with tempfile.TemporaryDirectory() as folder:
        for _ in range(2):
            LearningStore(f"{folder}/s.json").learn(_LESSON)
        store = LearningStore(f"{folder}/s.json")
        rows = [(k, v, store.lessons) for k, v in store.facts]
    return spark.createDataFrame(rows, "kind string, fact string, times int")


@_query("learn_use", "SELECT o_orderkey, CAST(o_orderkey % 100 AS DOUBLE) AS fee_amount, o_orderkey % 2 = 0 AS settled FROM orders")
def learn_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learned mark and learned words let inference type columns that it could not type before."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"o_orderkey AS {ROW_ID}", f"concat('kr ', {_SMALL}) AS fee_amount", "CASE WHEN o_orderkey % 2 = 0 THEN 'aye' ELSE 'nay' END AS settled")
    with tempfile.TemporaryDirectory() as folder:
        store = LearningStore(f"{folder}/s.json")
        store.learn(_LESSON)
        found = infer.infer_policy(df, "orders", store)
    return pipeline.correct(df, make_policy(found), CLOCK).table(keep_row_id=True).withColumnRenamed(ROW_ID, "o_orderkey")


# Audit and reports.
def _audited(spark: SparkSession, sf_dir: str) -> pipeline.Result:
    policy = registry._policy(roles={"critical_columns": ["status"]}, parsing=registry._types(urgent="boolean"))
    return pipeline.correct(registry._orders(spark, sf_dir, "status", "urgent"), policy, CLOCK)


_AUDITED = f"""SELECT 'parsing_failure' AS event_type, 'urgent' AS "column", 'invalid_boolean' AS reason, _row_id AS row_id, urgent AS old_value FROM ({_ORDERS}) WHERE urgent = 'maybe'
  UNION ALL SELECT 'row_dropped', '__row__', 'missing_critical_column', _row_id, 'row_present' FROM ({_ORDERS}) WHERE lower(trim(status)) = 'nan'"""


@_query("audit_samples", f"SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY row_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM ({_AUDITED})) WHERE r <= {events.SAMPLES}")
def audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first events of each group, by row id."""
    found = events.summary(_audited(spark, sf_dir).events())
    return found.select("event_type", "column", "reason", F.col("count").alias("n"), F.explode("samples").alias("s")).select("event_type", "column", "reason", "n", "s.row_id", "s.old_value")


def _write_log(spark: SparkSession, sf_dir: str, folder: str, detail: str) -> Path:
    path = Path(folder, "a.jsonl")
    events.write_audit(_audited(spark, sf_dir).events(), path, detail, {"job": "x"}, CLOCK)
    contracts.validate_audit_log(path)
    return path


@_query("audit_log", f'SELECT row_number() OVER (ORDER BY "column", row_id) AS line, event_type, "column", row_id FROM ({_AUDITED}) UNION ALL SELECT count(*) + 1, \'job_summary\', NULL, NULL FROM ({_AUDITED})')
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a detailed log in their order, the footer last; the log is read by tasks."""
    with tempfile.TemporaryDirectory() as folder:
        shared = Scratch(spark, "log").put(_write_log(spark, sf_dir, folder, "detailed"), "a.jsonl")
    lines = tables.with_row_ids(spark.read.text(shared))
    record = lines.select(F.col(ROW_ID).alias("line"), F.from_json("value", "type string, event_type string, column string, row_id long").alias("r"))
    return record.select("line", F.coalesce("r.event_type", "r.type").alias("event_type"), "r.column", "r.row_id")


@_query("audit_log_summary", f'SELECT event_type, "column", count(*) AS n, least(count(*), {events.SAMPLES}) AS samples FROM ({_AUDITED}) GROUP BY 1, 2 UNION ALL SELECT \'job_summary\', NULL, count(*), NULL FROM ({_AUDITED})')
def audit_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        path = _write_log(spark, sf_dir, folder, "summary")
        found = [json.loads(line) for line in path.read_text(encoding="utf-8").splitlines()]
    rows = [(r["event_type"], r["column"], r["count"], len(r["samples"])) for r in found[:-1]] + [("job_summary", None, found[-1]["total_events"], None)]
    return spark.createDataFrame(rows, "event_type string, column string, n long, samples long")


def _report(spark: SparkSession, sf_dir: str) -> dict[str, Any]:
    quiet = registry._policy().to_dict()["standardization"]
    policy = make_policy(
        {
            **{"standardization": quiet, "roles": {"critical_columns": ["status"], "protected_columns": ["o_orderkey"]}, "parsing": registry._types(urgent="boolean", price="float")},
            **{"validity_rules": {"ranges": {"o_orderkey": {"max": 100}}}, "missing_data": {"imputation": {"numeric": {"default": "mean", "allow_if_missing_pct_leq": 0.01}}}},
        }
    )
    df = registry._orders(spark, sf_dir, "o_orderkey", "status", "urgent", "price")
    result = pipeline.correct(df, policy, CLOCK).written()
    made = report.build_report(profile.profile(df, policy, CLOCK), profile.profile(result.table(True), policy, CLOCK), result.events(), policy, result.steps)
    contracts.validate_report(made)
    return made


_KINDS = f"""SELECT 'imputation_skipped_threshold' AS kind, 1::BIGINT AS n UNION ALL SELECT 'validity_flag', 1
  UNION ALL SELECT 'row_dropped', count(*) FROM ({_ORDERS}) WHERE lower(trim(status)) = 'nan' UNION ALL SELECT 'parsing_failure', count(*) FILTER (urgent = 'maybe') + count(*) FILTER (price IN ('twelve', '+inf')) FROM ({_ORDERS})"""


@_query("report_actions", _KINDS)
def report_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run by kind, as the report counts them."""
    return spark.createDataFrame(list(_report(spark, sf_dir)["actions"]["event_counts"].items()), "kind string, n long")


@_query(
    "report_compliance",
    f"""SELECT 'fail' AS status, 'o_orderkey' AS violated, 'price' AS skipped, (SELECT count(*) FROM orders) AS rows_raw, count(*) AS rows_optimized,
    round(avg(CASE WHEN price IN ('N/A', 'twelve', '+inf') THEN 1.0 ELSE 0 END), 4) AS missing FROM ({_ORDERS}) WHERE lower(trim(status)) <> 'nan'""",
)
def report_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected columns that a rule touched, columns that were not filled, rows before and after."""
    made = _report(spark, sf_dir)
    kept, meta = made["compliance"], made["metadata"]
    skipped = kept["skipped_imputation_columns"][0]
    row = (kept["protected_columns"]["status"], kept["protected_columns"]["violations"][0]["column"], skipped["column"], meta["rows_raw"], meta["rows_optimized"], skipped["missing_pct"])
    return spark.createDataFrame([row], "status string, violated string, skipped string, rows_raw long, rows_optimized long, missing double")


@_query("report_markdown", f"SELECT '- ' || kind || ': **' || n || '**' AS line FROM ({_KINDS})")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = report.markdown(_report(spark, sf_dir)).splitlines()
    at = lines.index("### Event Counts")
    return spark.createDataFrame([(line,) for line in lines[at + 2 : lines.index("", at + 2)]], "line string")


@_query("contracts", _values(("what", "valid"), ("audit", True), ("audit without reason", False), ("profile", True), ("profile without columns", False), ("report", True), ("report without readiness", False)))
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the validators say of records as they are made and of records that lack a key."""
    made = _report(spark, sf_dir)
    found = profile.profile(registry._orders(spark, sf_dir, "status"), make_policy(), CLOCK)
    with tempfile.TemporaryDirectory() as folder, _write_log(spark, sf_dir, folder, "detailed").open(encoding="utf-8") as log:
        line = json.loads(next(log))
    cases = {
        **{"audit": (contracts.validate_audit_record, line), "audit without reason": (contracts.validate_audit_record, {k: v for k, v in line.items() if k != "reason"})},
        **{"profile": (contracts.validate_profile, found), "profile without columns": (contracts.validate_profile, {k: v for k, v in found.items() if k != "columns"})},
        **{"report": (contracts.validate_report, made), "report without readiness": (contracts.validate_report, {k: v for k, v in made.items() if k != "readiness"})},
    }

    def valid(check, record) -> bool:
        try:
            check(record)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(what, valid(*case)) for what, case in cases.items()], "what string, valid boolean")


_BAD_POLICIES = {
    "type": {"parsing": {"column_types": {"a": "money"}}},
    "protected fill": {"roles": {"protected_columns": ["a"], "fillable_columns": ["a"]}},
    "order of keep_max": {"deduplication": {"strategy": "keep_max"}},
    "quantiles": {"outliers": {"cap_quantiles": [0.9, 0.1]}},
    "share": {"missing_data": {"drop_thresholds": {"row_missing_pct_gt": 2}}},
    "time column": {"dataset": {"time_column": {"column": None, "mode": "use_only"}}},
    "protected mapping": {"roles": {"protected_columns": ["a"]}, "standardization": {"mappings": {"a": {"x": "y"}}}},
    "none": {},
}


@_query("policy_checks", _values(("what", "valid"), *((k, k == "none") for k in _BAD_POLICIES)))
def policy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies that are refused before any plan is built."""

    def valid(given: dict[str, Any]) -> bool:
        try:
            make_policy(given)
        except PolicyError:
            return False
        return True

    return spark.createDataFrame([(k, valid(v)) for k, v in _BAD_POLICIES.items()], "what string, valid boolean")


@_query("policy_against_table", _values(("warning",), ("roles.critical_columns: no column 'x'",), ("parsing.column_types: no column 'y'",), ("deduplication.keys: no column 'z'",), ("dataset.time_column.column: no column 't'",)))
def policy_against_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of a column that the table lacks."""
    policy = make_policy(
        {"roles": {"critical_columns": ["x", "o_orderkey"]}, "parsing": {"column_types": {"y": "float"}}, "deduplication": {"keys": ["z"]}, "dataset": {"time_column": {"column": "t", "mode": "infer_or_use"}}}
    )
    found = unknown_columns(policy, spark.read.parquet(f"{sf_dir}/orders.parquet").columns)
    return spark.createDataFrame([(w,) for w in found], "warning string")


# Sources and sinks.
def _messy_csv(spark: SparkSession, sf_dir: str) -> str:
    """Orders as a CSV file with a mark, spaces, quoted commas, short lines and lines that are too long."""
    line = """concat(CAST(o_orderkey AS STRING), ', ', CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE o_orderstatus END,
        CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat(',"', o_orderpriority, ', x"') END, CASE WHEN o_orderkey % 7 = 0 THEN ',1,2,3' ELSE '' END)"""
    body = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", f"{line} AS value")
    head = spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("﻿ o_orderkey , status,priority").alias("value"))
    path = Scratch(spark, "csv").new_path("messy") + ".csv"
    head.unionByName(body).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


_LONG = "(o_orderkey % 7 = 0 AND o_orderkey % 6 <> 0) OR (o_orderkey % 42 = 0)"
_SCANNED = f"""SELECT row_number() OVER (ORDER BY o_orderkey) AS _row_id, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority || ', x' END AS priority
  FROM orders WHERE NOT ({_LONG})"""


@_query("csv_scan", _SCANNED)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cleaned, null tokens, short lines padded, long lines dropped, dense row ids, types by values."""
    return tables.read_csv(spark, _messy_csv(spark, sf_dir)).select(ROW_ID, "o_orderkey", "status", "priority")


@_query("csv_limit", f"SELECT * FROM ({_SCANNED}) WHERE _row_id <= 100")
def csv_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_csv(spark, _messy_csv(spark, sf_dir), limit=100).select(ROW_ID, F.col("o_orderkey").cast("long").alias("o_orderkey"), "status", "priority")


@_query("row_ids_given", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderkey END AS id FROM orders")
def row_ids_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row id column of the table becomes whole numbers."""
    text = "CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN concat(CAST(o_orderkey AS STRING), '.7') ELSE CAST(o_orderkey AS STRING) END"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", f"{text} AS {ROW_ID}")
    return tables.with_row_ids(df).select("o_orderkey", F.col(ROW_ID).alias("id"))


@_query("scan_formats", "SELECT form, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS price, count(*) AS ids FROM orders, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) AS t(form) GROUP BY form")
def scan_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows through each kind of file, written by the sinks and read by suffix."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    scratch, out = Scratch(spark, "formats"), None
    for form in ("parquet", "orc", "json", "csv"):
        path = f"{scratch.new_path(form)}.{form}"
        if form in ("parquet", "csv"):
            tables.write_output(df, path, form)
        else:
            df.write.format(form).save(path)
        read = tables.read_table(spark, path)
        one = read.agg(F.lit(form).alias("form"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("long").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.countDistinct(ROW_ID).alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("json_record", "SELECT 'max' AS key, max(o_totalprice)::VARCHAR AS value FROM orders UNION ALL SELECT 'nan', NULL UNION ALL SELECT 'inf', NULL")
def json_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record on disk has no number that JSON lacks."""
    most = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_totalprice")).first()[0]
    with tempfile.TemporaryDirectory() as folder:
        tables.write_json({"max": most, "nan": float("nan"), "inf": float("inf")}, f"{folder}/r.json")
        read = tables.read_json(f"{folder}/r.json")
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in read.items()], "key string, value string")


# Streams.
_STREAM_POLICY = {"parsing": {"column_types": {"price": "float"}}, "validity_rules": {"on_violation": "null", "ranges": {"price": {"min": 0}}}}


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Dirty orders through a stream of several batches."""
    scratch = Scratch(spark, "stream")
    source, out, audit, check = (scratch.new_path(n) for n in ("in", "out", "audit", "check"))
    df = registry._orders(spark, sf_dir, "o_orderkey", "price")
    df.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(source)
    correct_stream(stream, make_policy(_STREAM_POLICY), out, audit, check, [{"column": "price", "bucket": "numeric", "strategy": "median", "fill": 1.5, "missing_pct": 0.1, "skipped": False}], CLOCK).awaitTermination()
    return out, audit


@_query("stream_correct", f"SELECT o_orderkey, round(CASE WHEN {_PRICE} >= 0 THEN {_PRICE} ELSE 1.5 END, 6) AS price FROM ({_ORDERS})")
def stream_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row-local phases on a stream, with an imputation plan made before."""
    return spark.read.parquet(_streamed(spark, sf_dir)[0]).select("o_orderkey", F.round("price", 6).alias("price"))


@_query(
    "stream_events",
    f"""SELECT 'parsing_failure' AS event_type, count(*) AS n FROM ({_ORDERS}) WHERE price IN ('twelve', '+inf') UNION ALL SELECT 'standardization_change', count(*) FROM ({_ORDERS}) WHERE price LIKE '  %'
    UNION ALL SELECT 'imputation_fill', count(*) FROM ({_ORDERS}) WHERE coalesce({_PRICE}, -1) < 0 UNION ALL SELECT 'validity_null', count(*) FROM ({_ORDERS}) WHERE {_PRICE} < 0""",
)
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all batches; those of validity rules carry counts."""
    found = spark.read.json(_streamed(spark, sf_dir)[1])
    return found.groupBy("event_type").agg(F.sum(F.coalesce("violation_count", F.lit(1))).cast("long").alias("n"))


# The command line.
def _command(spark: SparkSession, sf_dir: str, folder: str, command: str, policy: dict[str, Any] | None, *more: str) -> str:
    from sluice import cli

    scratch = Scratch(spark, "cli")
    source, out = scratch.new_path("in"), scratch.new_path("out") if command == "correct" else f"{folder}/out"
    registry._orders(spark, sf_dir).write.parquet(source)
    if policy is not None:
        save_policy(policy, f"{folder}/p.yaml")
    args = [command, "--input", source, "--out", out, "--store", f"{folder}/s.json", "--quiet", *(["--policy", f"{folder}/p.yaml"] if policy is not None else []), *more]
    if code := cli.main(args, spark):
        raise RuntimeError(f"the command ended with {code}")
    return out


@_query("cli_correct", ORACLES["full_correction"])
def cli_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        out = _command(spark, sf_dir, folder, "correct", ORDERS_POLICY, "--audit", f"{folder}/a.jsonl", "--report", f"{folder}/r.json", "--report-md", f"{folder}/r.md", "--clock", CLOCK)
        contracts.validate_audit_log(f"{folder}/a.jsonl")
        contracts.validate_report(tables.read_json(f"{folder}/r.json"))
    return spark.read.parquet(out).withColumn("price", F.round("price", 6))


@_query("cli_profile", f"{_DELTA} SELECT raw, optimized FROM s")
def cli_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        found = tables.read_json(_command(spark, sf_dir, folder, "profile", ORDERS_POLICY, "--compare", "--clock", CLOCK))["readiness"]["transformation"]
    return spark.createDataFrame([(found["raw"], found["optimized"])], "raw double, optimized double")


@_query("cli_infer", ORACLES["infer_types"])
def cli_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.plans.policy import load_policy

    with tempfile.TemporaryDirectory() as folder:
        types = load_policy(_command(spark, sf_dir, folder, "infer", None)).parsing.column_types
    return spark.createDataFrame(sorted(types.items()), "column string, type string")


@_query("cli_learn", _values(("kind", "facts"), ("column_type", 3), ("fill", 2), ("mark", 0), ("no", 0), ("protected_word", 1), ("yes", 0), ("lessons", 1)))
def cli_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a correction by a policy leaves in the store."""
    with tempfile.TemporaryDirectory() as folder:
        _command(spark, sf_dir, folder, "correct", ORDERS_POLICY, "--audit", f"{folder}/a.jsonl")
        rows = sorted(LearningStore(f"{folder}/s.json").summary().items())
    return spark.createDataFrame(rows, "kind string, facts int")
