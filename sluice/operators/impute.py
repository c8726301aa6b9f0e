"""Phases 4 and 5: rows without critical values go; missing values get a column's statistic or constant."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.columns import DROPPED, RESERVED, col, is_number, is_text, is_time
from sluice.functions.missing import missing
from sluice.operators import events
from sluice.operators.parse import PARSED
from sluice.operators.quantiles import modes, quantiles
from sluice.plans.policy import NUMBERS, TIMES, Policy

BUCKETS = ("numeric", "datetime", "categorical")
#: Fills text columns whose strategy is a constant that the policy does not name.
UNKNOWN = "Unknown"


def drop_critical(df: DataFrame, policy: Policy) -> DataFrame:
    config = policy.missing_data
    names = [n for n in sorted(policy.roles.critical_columns) if n in df.columns]
    if not config.enabled or not config.drop_if_missing_critical or not names:
        return df
    test = reduce(lambda a, b: a | b, [missing(n, df.schema[n].dataType) for n in names])
    return events.drop_rows(df, test, "missing_critical_column", "missing_data.drop_if_missing_critical")


def drop_sparse_rows(df: DataFrame, policy: Policy) -> DataFrame:
    """Rows whose share of missing values is over ``row_missing_pct_gt``."""
    most = policy.missing_data.drop_thresholds.get("row_missing_pct_gt")
    names = _data_columns(df)
    if not policy.missing_data.enabled or most is None or not names:
        return df
    share = sum((missing(n, df.schema[n].dataType).cast("int") for n in names), F.lit(0)) / len(names)
    return events.drop_rows(df, share > float(most), "row_missing_pct", "missing_data.drop_thresholds.row_missing_pct_gt")


def sparse_columns(df: DataFrame, policy: Policy) -> list[str]:
    """Columns whose share of missing values is over ``col_missing_pct_gt``; protected, critical and key columns stay."""
    most = policy.missing_data.drop_thresholds.get("col_missing_pct_gt")
    if not policy.missing_data.enabled or most is None:
        return []
    stay = {*policy.roles.protected_columns, *policy.roles.critical_columns, *policy.dataset.primary_key.get("columns", [])}
    names = [n for n in _data_columns(df) if n not in stay]
    shares = missing_shares(df, names)
    return [n for n in names if shares[n] > float(most)]


def _data_columns(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n not in RESERVED and not n.endswith(PARSED)]


def missing_shares(df: DataFrame, names: list[str]) -> dict[str, float]:
    """The share of missing values of each column over the rows that are kept, in one aggregation."""
    if not names:
        return {}
    row = df.where(~F.col(DROPPED)).agg(*[F.avg(missing(n, df.schema[n].dataType).cast("double")).alias(str(i)) for i, n in enumerate(names)]).first()
    return {n: row[i] or 0.0 for i, n in enumerate(names)}


def bucket_of(name: str, kind: T.DataType, policy: Policy) -> str | None:
    """numeric, datetime, categorical, or None for booleans: by the policy's type, else by the column's."""
    typed = policy.parsing.column_types.get(name)
    if typed:
        return "numeric" if typed in NUMBERS else "datetime" if typed in TIMES else None if typed == "boolean" else "categorical"
    if is_number(kind) or isinstance(kind, T.BooleanType):
        return "numeric"
    return "datetime" if is_time(kind) else "categorical" if is_text(kind) else None


def _constant(bucket: str, value: Any, kind: T.DataType) -> Any:
    if bucket == "datetime" and is_time(kind):
        return F.lit(str(value)).cast("timestamp").cast("timestamp_ntz").cast(kind)
    return F.lit(value).cast(kind)


def known_value(statistics: dict[str, dict[str, Any]] | None, name: str, strategy: str) -> Any:
    return (statistics or {}).get(name, {}).get(strategy)


def _fillable(df: DataFrame, policy: Policy) -> list[tuple[str, str, Any]]:
    """(column, bucket, rules) of every column that the policy may fill."""
    config = policy.missing_data
    if not config.enabled:
        return []
    protected = set(policy.roles.protected_columns)
    todo = []
    for name in sorted(n for n in _data_columns(df) if n not in protected):
        bucket = bucket_of(name, df.schema[name].dataType, policy)
        own = getattr(config.imputation, bucket) if bucket else None
        if own and (own.default != "none" or own.constants):
            todo.append((name, bucket, own))
    return todo


def needs_statistics(df: DataFrame, policy: Policy, statistics: dict[str, dict[str, Any]] | None = None) -> bool:
    """Whether a plan reads the rows more than once: it does for medians and modes that are not given."""
    wanted = [(n, own.default) for n, _, own in _fillable(df, policy) if own.default in ("mean", "median", "mode") and n not in own.constants]
    return any(known_value(statistics, n, s) is None for n, s in wanted)


def plan(df: DataFrame, policy: Policy, statistics: dict[str, dict[str, Any]] | None = None) -> list[dict[str, Any]]:
    """What to do with each column. One aggregation over all rows gives shares and means, as a row on the driver; medians
    and modes come from ``quantiles``.

    Statistics of an earlier run may be given instead, by column and strategy.
    """
    todo = _fillable(df, policy)
    if not todo:
        return []
    rows = df.where(~F.col(DROPPED))
    aggs, medians, most = [], {}, {}
    for i, (name, bucket, own) in enumerate(todo):
        kind = df.schema[name].dataType
        empty = missing(name, kind)
        present = F.when(~empty, col(name))
        aggs.append(F.avg(empty.cast("double")).alias(f"share{i}"))
        if name in own.constants or known_value(statistics, name, own.default) is not None:
            continue
        if own.default == "mean" and is_number(kind):
            aggs.append(F.avg(present).alias(f"mean{i}"))
        elif own.default == "median" and is_number(kind):
            medians[name] = (present, [0.5])
        elif own.default == "mode" and bucket == "categorical":
            most[name] = present
    row = rows.agg(*aggs).first().asDict()
    # only columns with something to fill need their order or their counts
    filled = {name for i, (name, _, own) in enumerate(todo) if row[f"share{i}"] and row[f"share{i}"] <= own.allow_if_missing_pct_leq}
    found = {n: v[0] for n, v in quantiles(rows, {n: m for n, m in medians.items() if n in filled}).items()}
    found |= modes(rows, {n: m for n, m in most.items() if n in filled})
    steps = []
    for i, (name, bucket, own) in enumerate(todo):
        share, stat = row[f"share{i}"] or 0.0, row.get(f"mean{i}", found.get(name))
        known = known_value(statistics, name, own.default)
        step = {"column": name, "bucket": bucket, "strategy": own.default, "fill": None, "missing_pct": share, "skipped": False}
        if not share:
            continue
        if share > own.allow_if_missing_pct_leq:
            step |= {"skipped": True, "reason": f"missing_pct_{share:.4f}_gt_{own.allow_if_missing_pct_leq:.4f}"}
        elif own.constants.get(name) is not None:
            step |= {"strategy": "constant", "fill": own.constants[name]}
        elif own.default == "constant":
            step["fill"] = UNKNOWN if bucket == "categorical" else None
        else:
            step["fill"] = known if known is not None else stat
        if step["skipped"] or step["fill"] is not None:
            steps.append(step)
    return steps


def impute(df: DataFrame, steps: list[dict[str, Any]]) -> DataFrame:
    """Fills by the plan, with one event for each value."""
    for step in steps:
        if step["skipped"]:
            continue
        name = step["column"]
        kind = df.schema[name].dataType
        empty, fill = missing(name, kind), _constant(step["bucket"], step["fill"], kind)
        section = f"missing_data.imputation.{step['bucket']}"
        old = F.when(~col(name).cast("string").isin("NaN"), col(name).cast("string"))
        df = df.withColumns({"__fill": fill, "__empty": empty & ~F.col(DROPPED)})
        df = events.add(df, [(col("__empty"), events.event("imputation_fill", name, old, F.lit(str(step["fill"])), f"imputation_{step['strategy']}", section))])
        df = df.withColumn(name, F.when(col("__empty"), col("__fill")).otherwise(col(name))).drop("__fill", "__empty")
    return df


def skipped_events(df: DataFrame, steps: list[dict[str, Any]], clock: str) -> DataFrame:
    rows = [("imputation_skipped_threshold", s["column"], s["reason"], f"missing_data.imputation.{s['bucket']}", clock) for s in steps if s["skipped"]]
    return df.sparkSession.createDataFrame(rows, "event_type string, column string, reason string, policy_section string, timestamp string")
