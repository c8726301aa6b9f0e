"""Queries over the fixture tables, with DuckDB SQL for the same rows.

The tables are clean, so each query first dirties columns with expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.columns import ROW_ID
from sluice.operators import dedupe, events, impute, profile
from sluice.plans import pipeline
from sluice.plans.policy import make_policy

FLAGSHIP = "readiness_orders"
CLOCK = "2000-01-01T00:00:00Z"

Query = Callable[[SparkSession, str], DataFrame]

_MONEY = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)"
#: Orders with prices in many spellings, dates in three formats and tokens for nothing.
DIRTY_ORDERS = {
    "_row_id": "CAST(o_orderkey AS BIGINT)",
    "o_orderkey": "o_orderkey",
    "price": f"""CASE WHEN o_orderkey % 17 = 0 THEN 'N/A' WHEN o_orderkey % 19 = 0 THEN 'twelve' WHEN o_orderkey % 23 = 0 THEN '+inf'
        WHEN o_orderkey % 11 = 0 THEN concat('$', {_MONEY}) WHEN o_orderkey % 7 = 0 THEN concat('(', {_MONEY}, ')')
        WHEN o_orderkey % 5 = 0 THEN concat({_MONEY}, ' EUR') WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_orderkey AS STRING), '.5K')
        WHEN o_orderkey % 2 = 0 THEN concat('  ', {_MONEY}, '%') ELSE {_MONEY} END""",
    "day": """CASE WHEN o_orderkey % 13 = 0 THEN 'unknown day' WHEN o_orderkey % 3 = 0 THEN concat(CAST(extract(year FROM o_orderdate) AS STRING), '/', CAST(extract(month FROM o_orderdate) AS STRING), '/', CAST(extract(day FROM o_orderdate) AS STRING))
        WHEN o_orderkey % 3 = 1 THEN concat(CAST(extract(month FROM o_orderdate) AS STRING), '/', CAST(extract(day FROM o_orderdate) AS STRING), '/', CAST(extract(year FROM o_orderdate) AS STRING))
        ELSE concat(CAST(extract(year FROM o_orderdate) AS STRING), '-', CAST(extract(month FROM o_orderdate) AS STRING), '-', CAST(extract(day FROM o_orderdate) AS STRING)) END""",
    "status": "CASE WHEN o_orderkey % 9 = 0 THEN ' nan ' WHEN o_orderkey % 4 = 0 THEN concat(' ', lower(o_orderstatus), '  x ') ELSE o_orderstatus END",
    "urgent": "CASE WHEN o_orderkey % 10 = 0 THEN 'maybe' WHEN o_orderpriority LIKE '1%' THEN 'Yes' WHEN o_orderpriority LIKE '2%' THEN ' T ' WHEN o_orderpriority LIKE '3%' THEN '' ELSE 'no' END",
    "o_orderpriority": "o_orderpriority",
}
DIRTY_EVENTS = {
    "_row_id": "event_id",
    "event_id": "event_id",
    "user_id": "user_id",
    "event_type": "CASE WHEN event_id % 8 = 0 THEN 'None' WHEN event_id % 9 = 0 THEN NULL ELSE event_type END",
    "value": "CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 7 = 0 THEN -value ELSE value END",
    "ts": "ts",
}


def _dirty(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}"


ORDERS_SQL, EVENTS_SQL = _dirty(DIRTY_ORDERS, "orders"), _dirty(DIRTY_EVENTS, "events")

#: What a numeric cell of DIRTY_ORDERS means, in SQL.
_PRICE = """CASE WHEN price = 'N/A' OR price IN ('twelve', '+inf') THEN NULL WHEN price LIKE '$%' THEN CAST(substr(price, 2) AS DOUBLE)
  WHEN price LIKE '(%' THEN -CAST(substr(price, 2, length(price) - 2) AS DOUBLE) WHEN price LIKE '% EUR' THEN CAST(replace(price, ' EUR', '') AS DOUBLE)
  WHEN price LIKE '%K' THEN CAST(replace(price, 'K', '') AS DOUBLE) * 1000 WHEN price LIKE '%\\%' ESCAPE '\\' THEN CAST(trim(replace(price, '%', '')) AS DOUBLE) / 100
  ELSE CAST(price AS DOUBLE) END"""
_TOKENS = "('', 'nan', 'null', 'none', 'na', 'n/a', 'inf', '-inf', 'infinity', '-infinity')"


def _orders(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return df.selectExpr(*[f"{DIRTY_ORDERS[n]} AS {n}" for n in (ROW_ID, *(names or list(DIRTY_ORDERS)[1:]))])


def _events(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.selectExpr(*[f"{DIRTY_EVENTS[n]} AS {n}" for n in (ROW_ID, *(names or list(DIRTY_EVENTS)[1:]))])


def _policy(**sections: Any):
    """A policy in which only the named sections act."""
    quiet = {"standardization": {"global_trim_whitespace": False, "global_collapse_whitespace": False, "strip_nonprinting": False}}
    return make_policy(quiet | sections)


def _types(**types: str) -> dict[str, Any]:
    return {"column_types": types}


ORDERS_POLICY: dict[str, Any] = {
    "dataset": {"name": "orders", "primary_key": {"columns": ["o_orderkey"]}},
    "roles": {"critical_columns": ["price"], "protected_columns": ["o_orderpriority"]},
    "parsing": {"column_types": {"price": "float", "day": "date", "urgent": "boolean"}},
    "standardization": {"casefold": "upper", "mappings": {"status": {"O X": "O", "F X": "F", "P X": "P"}}},
    "missing_data": {"imputation": {"numeric": {"default": "median"}, "categorical": {"default": "mode"}}},
}

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from sluice.plans import registry_more

    return QUERIES | registry_more.QUERIES


def oracles() -> dict[str, str]:
    from sluice.plans import registry_more

    return ORACLES | registry_more.ORACLES


@_query(
    "readiness_orders",
    f"""WITH d AS (SELECT *, {_PRICE} AS v FROM ({ORDERS_SQL})), m AS (SELECT median(v) AS m FROM d)
    SELECT o_orderpriority, count(*) AS n, round(avg(coalesce(v, m)), 4) AS avg_price, round(sum(coalesce(v, m)), 2) AS sum_price FROM d, m GROUP BY o_orderpriority""",
)
def readiness_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parses prices in many spellings, fills the rest with the median, and sums by priority."""
    policy = _policy(parsing=_types(price="float"), missing_data={"imputation": {"numeric": {"default": "median", "allow_if_missing_pct_leq": 1.0}}})
    table = pipeline.correct(_orders(spark, sf_dir, "price", "o_orderpriority"), policy, CLOCK).table()
    return table.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 4).alias("avg_price"), F.round(F.sum("price"), 2).alias("sum_price"))


@_query("parse_numeric", f"SELECT o_orderkey, round({_PRICE}, 6) AS price FROM ({ORDERS_SQL})")
def parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(spark, sf_dir, "o_orderkey", "price")
    return pipeline.correct(df, _policy(parsing=_types(price="float")), CLOCK).table().select("o_orderkey", F.round("price", 6).alias("price"))


@_query(
    "parse_failures",
    f"""SELECT 'price' AS "column", CASE price WHEN 'twelve' THEN 'invalid_numeric' ELSE 'infinite_or_nan_value' END AS reason, count(*) AS n FROM ({ORDERS_SQL}) WHERE price IN ('twelve', '+inf') GROUP BY 2
    UNION ALL SELECT 'day', 'invalid_datetime', count(*) FROM ({ORDERS_SQL}) WHERE day = 'unknown day'
    UNION ALL SELECT 'urgent', 'invalid_boolean', count(*) FROM ({ORDERS_SQL}) WHERE urgent = 'maybe'""",
)
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(spark, sf_dir, "price", "day", "urgent")
    result = pipeline.correct(df, _policy(parsing=_types(price="float", day="date", urgent="boolean")), CLOCK)
    return result.events().where("event_type = 'parsing_failure'").groupBy("column", "reason").agg(F.count(F.lit(1)).alias("n"))


@_query("parse_boolean", f"SELECT o_orderkey, CASE WHEN urgent IN ('Yes', ' T ') THEN true WHEN urgent = 'no' THEN false END AS urgent FROM ({ORDERS_SQL})")
def parse_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.correct(_orders(spark, sf_dir, "o_orderkey", "urgent"), _policy(parsing=_types(urgent="boolean")), CLOCK).table()


@_query("parse_drop_rows", f"SELECT o_orderkey FROM ({ORDERS_SQL}) WHERE price NOT IN ('twelve', '+inf')")
def parse_drop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = _policy(parsing=_types(price="float") | {"numeric": {"on_failure": "drop_row"}})
    return pipeline.correct(_orders(spark, sf_dir, "o_orderkey", "price"), policy, CLOCK).table().select("o_orderkey")


@_query("parse_keep_raw", f"SELECT o_orderkey, price, round({_PRICE}, 6) AS parsed FROM ({ORDERS_SQL})")
def parse_keep_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = _policy(parsing=_types(price="float") | {"numeric": {"on_failure": "keep_raw"}})
    table = pipeline.correct(_orders(spark, sf_dir, "o_orderkey", "price"), policy, CLOCK).table()
    return table.select("o_orderkey", "price", F.round("price__parsed", 6).alias("parsed"))


@_query("parse_datetime", f"SELECT k.o_orderkey, CASE WHEN day = 'unknown day' THEN NULL ELSE CAST(CAST(o.o_orderdate AS DATE) AS TIMESTAMP) END AS day FROM ({ORDERS_SQL}) k JOIN orders o ON k.o_orderkey = o.o_orderkey")
def parse_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.correct(_orders(spark, sf_dir, "o_orderkey", "day"), _policy(parsing=_types(day="date")), CLOCK).table()


def _dirty_text(flag: str):
    text = F.col("text")
    return {"trim": F.concat(F.lit("\t "), text, F.lit(" \n")), "strip": F.concat(F.lit("a​"), text, F.lit("\x07 b"))}.get(flag, text)


def _standardize(flag: str, key: str, value: Any = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias(ROW_ID), "doc_id", _dirty_text(flag).alias("text"))
        off = {"global_trim_whitespace": False, "global_collapse_whitespace": False, "strip_nonprinting": False}
        return pipeline.correct(df, make_policy({"standardization": off | {key: value}}), CLOCK).table()

    return run


_SPACE = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STEPS = {
    "std_trim": ("trim", "global_trim_whitespace", True, rf"regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')"),
    "std_collapse": ("collapse", "global_collapse_whitespace", True, rf"regexp_replace(text, '{_SPACE}+', ' ', 'g')"),
    "std_strip_nonprinting": ("strip", "strip_nonprinting", True, "'a' || regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') || ' b'"),
    "std_asciify": ("asciify", "asciify", True, "strip_accents(text)"),
    "std_casefold_lower": ("lower", "casefold", "lower", "lower(text)"),
    "std_casefold_upper": ("upper", "casefold", "upper", "replace(upper(text), 'ẞ', 'SS')"),
}
for _name, (_flag, _key, _value, _sql) in _STEPS.items():
    QUERIES[_name] = _standardize(_flag, _key, _value)
    if _sql:
        ORACLES[_name] = f"SELECT doc_id, {_sql} AS text FROM documents"


@_query("std_casefold_title", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS p_name FROM part")
def std_casefold_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias(ROW_ID), "p_partkey", "p_name")
    return pipeline.correct(df, _policy(standardization={"casefold": "title"}), CLOCK).table()


@_query("std_mapping", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'F' WHEN 'F' THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def std_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries are not mapped again: O becomes F, and F becomes P."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias(ROW_ID), "o_orderkey", "o_orderstatus")
    return pipeline.correct(df, _policy(standardization={"mappings": {"o_orderstatus": {"O": "F", "F": "P"}}}), CLOCK).table()


_CHANGES = f"""SELECT 'trim_whitespace' AS reason, count(*) AS n FROM ({ORDERS_SQL}) WHERE status <> trim(status)
  UNION ALL SELECT 'collapse_whitespace', count(*) FROM ({ORDERS_SQL}) WHERE trim(status) LIKE '%  %'
  UNION ALL SELECT 'casefold_lower', count(*) FROM ({ORDERS_SQL}) WHERE lower(status) <> status"""


@_query("std_change_counts", f"SELECT * FROM ({_CHANGES}) WHERE n > 0")
def std_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = pipeline.correct(_orders(spark, sf_dir, "status"), make_policy({"standardization": {"casefold": "lower"}}), CLOCK)
    return pipeline.change_counts(result).select("reason", F.col("count").alias("n"))


def _valid(action: str, **rules: Any):
    return _policy(validity_rules={"on_violation": action} | rules)


@_query("validity_range_null", "SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 5000 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def validity_range_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias(ROW_ID), "c_custkey", "c_acctbal")
    return pipeline.correct(df, _valid("null", ranges={"c_acctbal": {"min": 0, "max": 5000}}), CLOCK).table()


@_query("validity_drop", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND regexp_matches(c_name, '^Customer#0*[1-9]')")
def validity_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias(ROW_ID), "c_custkey", "c_acctbal", "c_mktsegment", "c_name")
    rules = {"non_negative_columns": ["c_acctbal"], "allowed_values": {"c_mktsegment": ["BUILDING", "MACHINERY"]}, "regex": {"c_name": "Customer#0*[1-9]"}}
    return pipeline.correct(df, _valid("drop_row", **rules), CLOCK).table().select("c_custkey")


@_query(
    "validity_flag_counts",
    """SELECT * FROM (SELECT 'c_acctbal' AS "column", 'non_negative: Value must be >= 0 (' || count(*) || ' rows)' AS reason, count(*) AS n FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 'c_acctbal', 'range_max: Value > 5000 (' || count(*) || ' rows)', count(*) FROM customer WHERE c_acctbal > 5000
    UNION ALL SELECT 'c_mktsegment', 'allowed_values: Value not in allowed list (' || count(*) || ' rows)', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING') WHERE n > 0""",
)
def validity_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias(ROW_ID), "c_acctbal", "c_mktsegment")
    policy = _valid("flag", non_negative_columns=["c_acctbal"], ranges={"c_acctbal": {"max": 5000}}, allowed_values={"c_mktsegment": ["BUILDING"]})
    return pipeline.correct(df, policy, CLOCK).events().select("column", "reason", F.col("violation_count").alias("n"))


@_query("critical_drop", f"SELECT o_orderkey FROM ({ORDERS_SQL}) WHERE lower(trim(status)) NOT IN {_TOKENS} AND lower(trim(urgent)) NOT IN {_TOKENS}")
def critical_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = _policy(roles={"critical_columns": ["status", "urgent"]})
    return pipeline.correct(_orders(spark, sf_dir, "o_orderkey", "status", "urgent"), policy, CLOCK).table().select("o_orderkey")


def _imputed(bucket: str, default: str, name: str, constants: dict[str, Any] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = {"default": default, "constants": constants or {}, "allow_if_missing_pct_leq": 1.0}
        policy = _policy(missing_data={"imputation": {bucket: own}})
        out = pipeline.correct(_events(spark, sf_dir, "event_id", name), policy, CLOCK).table()
        return out.withColumn(name, F.round(name, 6)) if bucket == "numeric" else out

    return run


_EMPTY_TYPE = f"(event_type IS NULL OR lower(trim(event_type)) IN {_TOKENS})"
for _name, _query_run, _sql in (
    ("impute_mean", _imputed("numeric", "mean", "value"), f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM ({EVENTS_SQL}))), 6) AS value FROM ({EVENTS_SQL})"),
    ("impute_median", _imputed("numeric", "median", "value"), f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM ({EVENTS_SQL}))), 6) AS value FROM ({EVENTS_SQL})"),
    ("impute_number", _imputed("numeric", "none", "value", {"value": -1}), f"SELECT event_id, round(coalesce(value, -1), 6) AS value FROM ({EVENTS_SQL})"),
    (
        "impute_mode",
        _imputed("categorical", "mode", "event_type"),
        f"WITH m AS (SELECT event_type AS m FROM ({EVENTS_SQL}) WHERE NOT {_EMPTY_TYPE} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT event_id, CASE WHEN {_EMPTY_TYPE} THEN m ELSE event_type END AS event_type FROM ({EVENTS_SQL}), m",
    ),
    ("impute_unknown", _imputed("categorical", "constant", "event_type"), f"SELECT event_id, CASE WHEN {_EMPTY_TYPE} THEN 'Unknown' ELSE event_type END AS event_type FROM ({EVENTS_SQL})"),
):
    QUERIES[_name], ORACLES[_name] = _query_run, _sql


@_query("impute_threshold", f"SELECT 'value' AS \"column\", 'missing_pct_' || printf('%.4f', avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END)) || '_gt_0.0500' AS reason FROM ({EVENTS_SQL})")
def impute_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column with too many missing values is left alone, and says so."""
    policy = _policy(missing_data={"imputation": {"numeric": {"default": "mean", "allow_if_missing_pct_leq": 0.05}}})
    return pipeline.correct(_events(spark, sf_dir, "value"), policy, CLOCK).events().select("column", "reason")


@_query(
    "profile_columns",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", round(avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0 END), 4) AS null_pct,
        round(avg(CASE WHEN {n} IS NULL{f" OR lower(trim({n})) IN ('', 'nan', 'null', 'none', 'na', 'n/a')" if n == "event_type" else ""} THEN 1.0 ELSE 0 END), 4) AS missing_pct,
        round(count(DISTINCT {n}) / count(*), 4) AS unique_pct FROM ({EVENTS_SQL})"""
        for n in ("event_id", "user_id", "event_type", "value")
    ),
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.profile(_events(spark, sf_dir, "event_id", "user_id", "event_type", "value"), make_policy(), CLOCK)
    rows = [(n, c["null_missing_pct"], c["effective_missing_pct"], c["unique_pct"]) for n, c in found["columns"].items()]
    return spark.createDataFrame(rows, "column string, null_pct double, missing_pct double, unique_pct double")


@_query(
    "profile_numbers",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", round(min({n}), 6) AS min, round(max({n}), 6) AS max, round(avg({n}), 6) AS mean, round(stddev_samp({n}), 6) AS std, round(median({n}), 6) AS median FROM lineitem"""
        for n in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def profile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("l_quantity", "l_extendedprice", "l_discount")
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*names)
    found = profile.profile(df, make_policy({"parsing": {"column_types": dict.fromkeys(names, "float")}}), CLOCK)
    stats = ("min", "max", "mean", "std", "median")
    rows = [(n, *(round(float(found["columns"][n]["stats"][s]), 6) for s in stats)) for n in names]
    return spark.createDataFrame(rows, "column string, min double, max double, mean double, std double, median double")


@_query("profile_frequent", 'SELECT \'event_type\' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, value LIMIT 5')
def profile_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type")
    top = profile.frequent_values(profile.value_counts(df, ["event_type"]))
    return top.select("column", F.explode("top").alias("t")).select("column", "t.value", "t.n")


@_query("profile_lengths", "SELECT min(length(text)) AS min_len, max(length(text)) AS max_len, round(avg(length(text)), 6) AS avg_len FROM documents")
def profile_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    stats = profile.profile(df, make_policy(), CLOCK)["columns"]["text"]["stats"]
    return spark.createDataFrame([(stats["min_len"], stats["max_len"], round(stats["avg_len"], 6))], "min_len long, max_len long, avg_len double")


@_query("profile_dates", "SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S+00:00') AS min, strftime(max(ts), '%Y-%m-%dT%H:%M:%S+00:00') AS max FROM events")
def profile_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts")
    stats = profile.profile(df, make_policy({"parsing": {"column_types": {"ts": "timestamp"}}}), CLOCK)["columns"]["ts"]["stats"]
    return spark.createDataFrame([(stats["min"], stats["max"])], "min string, max string")


@_query(
    "duplicates",
    """SELECT (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity))::BIGINT AS exact_rows,
    (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus))::BIGINT AS key_rows""",
)
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity")
    found = (profile.duplicate_rows(df, df.columns), profile.duplicate_rows(df, ["l_returnflag", "l_linestatus"]))
    return spark.createDataFrame([found], "exact_rows long, key_rows long")


_SCORE = f"""WITH d AS (SELECT * FROM ({ORDERS_SQL})), p AS (SELECT
  round(avg(CASE WHEN lower(trim(price)) IN ('', 'nan', 'null', 'none', 'na', 'n/a') THEN 1.0 ELSE 0 END), 4) AS price_missing,
  round(avg(CASE WHEN lower(trim(status)) IN ('', 'nan', 'null', 'none', 'na', 'n/a') THEN 1.0 ELSE 0 END), 4) AS status_missing,
  round(avg(CASE WHEN urgent = '' THEN 1.0 ELSE 0 END), 4) AS urgent_missing,
  round(avg(CASE WHEN urgent = 'maybe' THEN 1.0 ELSE 0 END), 4) AS urgent_bad FROM d)
SELECT round(40 * (2 * (1 - price_missing) + (1 - status_missing) + (1 - urgent_missing)) / 4 + 30 * (1 - urgent_bad) + 20 * (1 - dup) + 10 - 10 * (CASE WHEN price_missing > 0 THEN 1 ELSE 0 END), 2) AS score
FROM p, (SELECT sum(n - 1) / sum(n) AS dup FROM (SELECT count(*) AS n FROM d GROUP BY price, status, urgent))"""


@_query("readiness_score", _SCORE)
def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = make_policy({"roles": {"critical_columns": ["price"]}, "parsing": {"column_types": {"urgent": "boolean"}}})
    found = profile.profile(_orders(spark, sf_dir, "price", "status", "urgent"), policy, CLOCK)
    return spark.createDataFrame([(found["readiness"]["score"],)], "score double")


_SUMMARY = f"""SELECT 'parsing_failure' AS event_type, 'urgent' AS "column", 'invalid_boolean' AS reason, count(*) AS n FROM ({ORDERS_SQL}) WHERE urgent = 'maybe'
  UNION ALL SELECT 'row_dropped', '__row__', 'missing_critical_column', count(*) FROM ({ORDERS_SQL}) WHERE lower(trim(status)) = 'nan'"""


@_query("audit_summary", _SUMMARY)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = _policy(roles={"critical_columns": ["status"]}, parsing=_types(urgent="boolean"))
    found = pipeline.correct(_orders(spark, sf_dir, "status", "urgent"), policy, CLOCK).events()
    return events.summary(found).select("event_type", "column", "reason", F.col("count").alias("n"))


@_query("audit_footer", f'SELECT sum(n)::BIGINT AS total, count(DISTINCT "column") FILTER ("column" <> \'__row__\') AS columns_touched FROM ({_SUMMARY})')
def audit_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = _policy(roles={"critical_columns": ["status"]}, parsing=_types(urgent="boolean"))
    last = events.footer(pipeline.correct(_orders(spark, sf_dir, "status", "urgent"), policy, CLOCK).events())
    return spark.createDataFrame([(last["total_events"], last["unique_columns_touched"])], "total long, columns_touched long")


def _deduped(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias(ROW_ID), "event_id", "user_id", "value")
        own = {"keys": ["user_id"], "strategy": strategy, "order_by": "value" if strategy in ("keep_max", "keep_min") else None, "exact_row_duplicates": "keep"}
        return events.kept(dedupe.deduplicate(events.start(df), make_policy({"deduplication": own}))).select("event_id", "user_id")

    return run


for _name, _order in (("keep_first", "event_id"), ("keep_last", "event_id DESC"), ("keep_max", "value DESC, event_id"), ("keep_min", "value, event_id")):
    QUERIES[f"dedupe_{_name}"] = _deduped(_name)
    ORACLES[f"dedupe_{_name}"] = f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_order}) AS r FROM events) WHERE r = 1"


@_query("dedupe_exact", "SELECT min(l_orderkey * 10 + l_linenumber) AS id, l_quantity, l_returnflag FROM lineitem GROUP BY l_quantity, l_returnflag")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(ROW_ID), "l_quantity", "l_returnflag")
    return events.kept(dedupe.deduplicate(events.start(df), make_policy())).withColumnRenamed(ROW_ID, "id")


def _outliers(method: str, action: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias(ROW_ID), "o_orderkey", F.expr(_SPIKES).alias("v"))
        policy = make_policy({"outliers": {"method": method, "action": action, "apply_to_columns": ["v"]}})
        return events.kept(dedupe.outliers(events.start(df), policy)).select("o_orderkey", F.round("v", 4).alias("v"))

    return run


_SPIKES = "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20 ELSE o_totalprice END"
_IQR = f"(SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, quantile_cont(v, 0.01) AS l, quantile_cont(v, 0.99) AS h, avg(v) AS m, stddev_samp(v) AS s FROM (SELECT {_SPIKES} AS v FROM orders))"
for _method, _low, _high in (("iqr", "a - 1.5 * (b - a)", "b + 1.5 * (b - a)"), ("zscore", "m - 3 * s", "m + 3 * s")):
    QUERIES[f"outlier_{_method}_drop"], QUERIES[f"outlier_{_method}_cap"] = _outliers(_method, "drop_row"), _outliers(_method, "cap")
    _inside = f"v BETWEEN {_low} AND {_high}"
    ORACLES[f"outlier_{_method}_drop"] = f"SELECT o_orderkey, round(v, 4) AS v FROM (SELECT o_orderkey, {_SPIKES} AS v FROM orders), {_IQR} q WHERE {_inside}"
    ORACLES[f"outlier_{_method}_cap"] = f"SELECT o_orderkey, round(CASE WHEN {_inside} THEN v ELSE least(greatest(v, l), h) END, 4) AS v FROM (SELECT o_orderkey, {_SPIKES} AS v FROM orders), {_IQR} q"


@_query("drop_rows_missing_pct", f"SELECT event_id FROM ({EVENTS_SQL}) WHERE (CASE WHEN value IS NULL THEN 1 ELSE 0 END + CASE WHEN {_EMPTY_TYPE} THEN 1 ELSE 0 END) / 3.0 <= 0.5")
def drop_rows_missing_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = make_policy({"missing_data": {"drop_thresholds": {"row_missing_pct_gt": 0.5}}})
    return events.kept(impute.drop_sparse_rows(events.start(_events(spark, sf_dir, "event_id", "event_type", "value")), policy)).select("event_id")


@_query("drop_columns_missing_pct", f"SELECT event_id, event_type FROM ({EVENTS_SQL})")
def drop_columns_missing_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column value has a sixth of its values missing, which is over the limit."""
    df = _events(spark, sf_dir, "event_id", "event_type", "value")
    policy = make_policy({"missing_data": {"drop_thresholds": {"col_missing_pct_gt": 0.15}}, "roles": {"protected_columns": ["event_type"]}})
    return df.drop(ROW_ID, *impute.sparse_columns(events.start(df), policy))
