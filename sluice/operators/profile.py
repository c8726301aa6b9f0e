"""Profiles: row and column statistics of a table by aggregations alone."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import numbers
from sluice.functions.columns import RESERVED, col, is_number, text_of
from sluice.functions.missing import missing_in_profile, null_like, stripped
from sluice.operators.parse import PARSED, parse_boolean, with_datetime
from sluice.operators.quantiles import quantiles
from sluice.plans.policy import NUMBERS, TIMES, Policy
from sluice.plans.score import readiness

TOP = 5
MIXED_BELOW = 0.95
_PARTS = 64


def data_columns(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n not in RESERVED and not n.endswith(PARSED)]


def duplicate_rows(df: DataFrame, names: list[str]) -> int:
    """Rows that equal an earlier row in these columns; nulls are equal."""
    if not names:
        return 0
    # 128 bits stand for a row, nulls marked, so wide rows are not shuffled
    cells = [c for n in names for c in (col(n), col(n).isNull())]
    groups = df.groupBy(F.xxhash64(F.lit(1), *cells).alias("__h"), F.xxhash64(F.lit(2), *cells).alias("__i")).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0]


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows (column, value, n) of all columns from one shuffle; values as text, null included."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), text_of(n, kinds[n]).alias("value")) for n in names])
    return df.select(F.explode_outer(pairs).alias("p")).select("p.column", "p.value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def frequent_values(counts: DataFrame, k: int = TOP) -> DataFrame:
    """Rows (column, unique, top): distinct values without null, and the k most frequent, ties by value.

    The k best of each salted part come first, so a column with very many values is no single group.
    """
    order = [F.col("n").desc(), F.col("value").asc_nulls_last()]
    parts = counts.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(_PARTS)))
    best = parts.withColumn("r", F.row_number().over(W.partitionBy("column", "part").orderBy(*order))).where(F.col("r") <= k)
    best = best.withColumn("r", F.row_number().over(W.partitionBy("column").orderBy(*order))).where(F.col("r") <= k)
    top = best.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("r", "value", "n"))).alias("top"))
    unique = counts.groupBy("column").agg(F.count("value").alias("unique"))
    return unique.join(top, "column")


def parse_check(name: str, kind: T.DataType, target: str, policy: Policy):
    """Whether a present value reads as the target type by the profile's rules; None for types without rules."""
    text = text_of(name, kind)
    config = policy.parsing
    if target == "boolean":
        if isinstance(kind, T.BooleanType):
            return F.lit(True)
        return parse_boolean(text, config.boolean_for(name)).isNotNull()
    if target in NUMBERS:
        if is_number(kind):
            return F.lit(True)
        flat = F.lower(stripped(text))
        read = numbers.profile_number(text, config.numeric.allow_commas, config.numeric.allow_currency_symbols, config.numeric.allow_percent_symbol)
        return read.isNotNull() | flat.isin("inf", "-inf", "+inf", "infinity", "-infinity", "+infinity")
    return None


def _column_aggregates(df: DataFrame, names: list[str], policy: Policy) -> dict[str, Any]:
    aggs, medians = [F.count(F.lit(1)).alias("rows")], {}
    for i, n in enumerate(names):
        if policy.parsing.column_types.get(n) in TIMES:
            df = with_datetime(df, n, policy, f"__time{i}")
    for i, n in enumerate(names):
        kind, target = df.schema[n].dataType, policy.parsing.column_types.get(n)
        empty = missing_in_profile(n, kind)
        aggs += [F.count_if(null_like(n, kind)).alias(f"null{i}"), F.count_if(empty).alias(f"empty{i}")]
        test = F.col(f"__time{i}").isNotNull() if target in TIMES else parse_check(n, kind, target, policy) if target else None
        if target:
            bad = F.lit(False) if test is None else ~F.coalesce(test, F.lit(False))
            aggs.append(F.count_if(~empty & bad).alias(f"bad{i}"))
        if target in NUMBERS:
            value = col(n).cast("double") if is_number(kind) else numbers.profile_number(text_of(n, kind), policy.parsing.numeric.allow_commas, policy.parsing.numeric.allow_currency_symbols, policy.parsing.numeric.allow_percent_symbol)
            value = F.when(~empty, value)
            aggs += [f(value).alias(f"{a}{i}") for a, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))]
            medians[i] = (value, [0.5])
        elif target in TIMES:
            value = F.when(~empty, F.col(f"__time{i}"))
            aggs += [F.date_format(f(value), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias(f"{a}{i}") for a, f in (("min", F.min), ("max", F.max))]
        length = F.when(~empty, F.length(text_of(n, kind)))
        aggs += [F.min(length).alias(f"minlen{i}"), F.max(length).alias(f"maxlen{i}"), F.avg(length).alias(f"avglen{i}")]
        if n + PARSED in df.columns:
            aggs.append(F.avg(F.when(~empty, col(n + PARSED).isNotNull().cast("double"))).alias(f"parsed{i}"))
    return df.agg(*aggs).first().asDict() | {f"median{i}": m[0] for i, m in quantiles(df, medians).items()}


def _stats(row: dict[str, Any], i: int, target: str | None) -> dict[str, Any]:
    out: dict[str, Any] = {}
    if target in NUMBERS and row.get(f"count{i}"):
        out = {k: row[f"{k}{i}"] for k in ("min", "max", "mean", "std", "median")}
        out["std"] = out["std"] if row[f"count{i}"] > 1 else 0.0
    elif target in TIMES and row.get(f"min{i}") is not None:
        out = {k: row[f"{k}{i}"] for k in ("min", "max")}
    if row[f"minlen{i}"] is not None:
        out |= {"min_len": row[f"minlen{i}"], "max_len": row[f"maxlen{i}"], "avg_len": row[f"avglen{i}"]}
    return out


def role_of(name: str, policy: Policy) -> str:
    """The last role in fixed order that names the column, so protected wins over critical."""
    found = "none"
    for role in ("critical", "protected", "standardize", "fillable", "droppable"):
        if name in getattr(policy.roles, f"{role}_columns"):
            found = role
    return found


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def profile(df: DataFrame, policy: Policy, clock: str | None = None) -> dict[str, Any]:
    """Metadata, duplicates, a record for each column, and the readiness score.

    Aggregations read the table: scalar statistics, value counts, exact duplicates, key duplicates, and a few for the
    medians. The driver receives a row for each column, and a bounded number of values around each median.
    """
    names = data_columns(df)
    row = _column_aggregates(df, names, policy)
    rows = row["rows"]
    share = lambda n: round(n / rows, 4) if rows else 0.0
    counted = {r["column"]: r for r in frequent_values(value_counts(df, names)).collect()} if names else {}
    keys = [c for c in policy.dataset.primary_key.get("columns", []) if c in names]
    columns = {}
    for i, n in enumerate(names):
        target = policy.parsing.column_types.get(n)
        bad, parsed = row.get(f"bad{i}"), row.get(f"parsed{i}")
        top = counted.get(n)
        columns[n] = {
            "role": role_of(n, policy),
            "inferred_dtype": df.schema[n].dataType.simpleString(),
            "null_missing_pct": share(row[f"null{i}"]),
            "effective_missing_pct": share(row[f"empty{i}"]),
            "unique_pct": share(top["unique"]) if top else 0.0,
            "is_mixed_type": parsed is not None and max(parsed, 1 - parsed) < MIXED_BELOW,
            "is_parseable": None if bad is None else bad == 0,
            "invalid_count": bad,
            "invalid_type_pct": None if bad is None else share(bad),
            "frequent_values": [{"value": "nan" if v["value"] is None else v["value"], "count": v["n"]} for v in (top["top"] if top else [])],
            "stats": _stats(row, i, target),
        }
    found = {
        "metadata": {"dataset_name": policy.dataset.name, "policy_hash": policy.reproducibility.policy_hash, "timestamp": clock or now(), "row_count": rows, "col_count": len(names)},
        "duplicates": {"exact_row_dupe_count": duplicate_rows(df, names), "pk_dupe_count": duplicate_rows(df, keys) if keys else None},
        "columns": columns,
    }
    found["readiness"] = readiness(found)
    return found


__all__ = ["data_columns", "duplicate_rows", "frequent_values", "parse_check", "profile", "role_of", "value_counts"]
