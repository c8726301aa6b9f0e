"""Duplicates and outliers: policy sections that act on whole rows or on numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions.columns import DROPPED, RESERVED, ROW_ID, col, is_number
from sluice.operators import events
from sluice.operators.quantiles import quantiles
from sluice.plans.policy import Policy
from sluice.sources.scratch import Scratch

#: A number of its own for every row, also where row ids repeat.
PLACE = "__place"


def _mark(df: DataFrame, names: list[str], best: DataFrame, reason: str) -> DataFrame:
    """Drops rows that are not the one of ``best`` for their key. Keys are joined null-safe on a hash and on their values."""
    key = F.xxhash64(*[col(n) for n in names])
    left = df.withColumn("__key", key)
    same = left["__key"] == best["__best_key"]
    for i, n in enumerate(names):
        same = same & left[f"`{n}`"].eqNullSafe(best[f"__k{i}"])
    joined = left.join(best, same, "left").drop("__best_key", "__key", *[f"__k{i}" for i in range(len(names))])
    other = ~F.col(DROPPED) & F.col("__keep").isNotNull() & (F.col(PLACE) != F.col("__keep"))
    return events.drop_rows(joined, other, reason, "deduplication").drop("__keep")


def _best(df: DataFrame, names: list[str], pick) -> DataFrame:
    rows = df.where(~F.col(DROPPED))
    key = F.xxhash64(*[col(n) for n in names]).alias("__best_key")
    own = rows.select(key, *[col(n).alias(f"__k{i}") for i, n in enumerate(names)], F.col(ROW_ID).alias("__id"), PLACE, *pick[1])
    grouped = own.groupBy("__best_key", *[f"__k{i}" for i in range(len(names))]).agg(pick[0].alias("__keep"), F.count(F.lit(1)).alias("__n"))
    return grouped.where("__n > 1").drop("__n")


def _first(*order: Column) -> Column:
    """The place of the row that is first by the order, then by row id (null ids last), then by place."""
    return F.min_by(PLACE, F.struct(*order, F.col("__id").isNull(), F.col("__id"), F.col(PLACE)))


def deduplicate(df: DataFrame, policy: Policy) -> DataFrame:
    """Exact duplicates keep their first row; keys keep the first, last, greatest or least row by the policy.

    The row to keep is a partial aggregate and comes back by a join, so a key with very many rows is no window in one
    task. Ties in the ordering keep the first row; null orderings are the last choice. Row ids may repeat or be null:
    rows are told apart by a place of their own, for which they are written once.
    """
    config = policy.deduplication
    if not config.enabled:
        return df
    names = [n for n in df.columns if n not in RESERVED]
    exact = config.exact_row_duplicates == "drop" and bool(names)
    keys = [n for n in config.keys if n in df.columns]
    by_key = bool(keys) and len(keys) == len(config.keys) and (config.strategy in ("keep_first", "keep_last") or config.order_by in df.columns)
    if not exact and not by_key:
        return df
    df = Scratch(df.sparkSession, "placed").save(df.withColumn(PLACE, F.monotonically_increasing_id()), "rows").read()
    if exact:
        df = _mark(df, names, _best(df, names, (_first(), [])), "exact_duplicate")
    if by_key:
        if config.strategy == "keep_first":
            pick = (_first(), [])
        elif config.strategy == "keep_last":
            pick = (F.max_by(PLACE, F.struct(F.col("__id"), -F.col(PLACE))), [])
        else:
            order = col(config.order_by).alias("__order")
            greatest = F.max_by(PLACE, F.struct(F.col("__order").isNotNull(), F.col("__order"), F.col("__id").isNotNull(), -F.col("__id"), -F.col(PLACE)))
            pick = (greatest if config.strategy == "keep_max" else _first(F.col("__order").isNull(), F.col("__order")), [order])
        df = _mark(df, keys, _best(df, keys, pick), f"duplicate_key_{config.strategy}")
    return df.drop(PLACE)


def ranked(df: DataFrame, keys: list[str], order: str = ROW_ID) -> DataFrame:
    """Rows numbered within their key, for callers that want ranks and not drops."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*[col(k) for k in keys]).orderBy(col(order))))


def outlier_limits(df: DataFrame, policy: Policy) -> dict[str, tuple[float, float]]:
    """(low, high) of each column: quartiles and 1.5 ranges, or mean and three deviations; caps by quantiles, where the policy caps."""
    config = policy.outliers
    protected = set(policy.roles.protected_columns) if config.exclude_protected else set()
    names = [n for n in config.apply_to_columns if n in df.columns and n not in protected and is_number(df.schema[n].dataType)]
    if not config.enabled or not names:
        return {}
    rows = df.where(~F.col(DROPPED))
    values = {n: F.nanvl(col(n).cast("double"), F.lit(None).cast("double")) for n in names}
    shares = [*((0.25, 0.75) if config.method == "iqr" else ()), *(config.cap_quantiles if config.action == "cap" else ())]
    found = quantiles(rows, {n: (v, shares) for n, v in values.items()}) if shares else {}
    row = {}
    if config.method != "iqr":
        row = rows.agg(*[f(v).alias(f"{a}{i}") for i, v in enumerate(values.values()) for a, f in (("a", F.avg), ("b", F.stddev_samp))]).first()
    out = {}
    for i, n in enumerate(names):
        a, b = found[n][:2] if config.method == "iqr" else (row[f"a{i}"], row[f"b{i}"])
        if a is None or b is None:
            continue
        spread = 1.5 * (b - a) if config.method == "iqr" else 3 * b
        low, high = a - spread, (b if config.method == "iqr" else a) + spread
        out[n] = (low, high, *(found[n][-2:] if config.action == "cap" else (low, high)))
    return out


def outliers(df: DataFrame, policy: Policy) -> DataFrame:
    """Flags, caps to the policy's quantiles, or drops rows outside the limits, with an event for each."""
    config = policy.outliers
    drop = F.lit(False)
    for name, (low, high, least, most) in outlier_limits(df, policy).items():
        kind = df.schema[name].dataType
        df = df.withColumn("__out", F.coalesce((col(name) < low) | (col(name) > high), F.lit(False)))
        capped = F.least(F.greatest(col(name), F.lit(least)), F.lit(most)).cast(kind)
        new = capped if config.action == "cap" else col(name)
        df = events.add(df, [(col("__out"), events.event(f"outlier_{config.action}", name, col(name), new, f"outlier_{config.method}", "outliers"))])
        if config.action == "cap":
            df = df.withColumn(name, F.when(col("__out") & ~F.col(DROPPED), capped).otherwise(col(name)))
        elif config.action == "drop_row":
            drop = drop | F.coalesce((col(name) < low) | (col(name) > high), F.lit(False))
    df = df.drop("__out")
    return events.drop_rows(df, drop, "outlier_drop_row", "outliers") if config.action == "drop_row" and config.apply_to_columns else df
