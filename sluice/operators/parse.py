"""Phase 2: tolerant parsing of the columns that the policy types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import dates, numbers
from sluice.functions.columns import DROPPED, col, is_text, is_time
from sluice.functions.missing import missing, stripped
from sluice.operators import events
from sluice.plans.policy import NUMBERS, TIMES, BooleanParsing, Policy

#: Beside a column that keeps raw values, this column has the parsed ones.
PARSED = "__parsed"


def typed_columns(df: DataFrame, policy: Policy, kinds: tuple[str, ...]) -> list[str]:
    """Columns of these types that the table has and that are not protected, by name."""
    protected, types = set(policy.roles.protected_columns), policy.parsing.column_types
    return sorted(n for n in df.columns if types.get(n) in kinds and n not in protected)


def _finish(df: DataFrame, name: str, value: Column, reason: Column, on_failure: str, section: str, empty: Column) -> DataFrame:
    """Puts parsed values in place; reason is null where a value parsed or was missing."""
    df = df.withColumns({"__value": value, "__reason": reason, "__missing": empty})
    failed = col("__reason").isNotNull()
    df = events.add(df, [(failed, events.event("parsing_failure", name, col(name), F.lit(None), col("__reason"), section))])
    if on_failure == "keep_raw":
        raw = col(name).cast("string")
        df = df.withColumns({name: raw, name + PARSED: col("__value")})
    else:
        df = df.withColumn(name, col("__value"))
        if on_failure == "drop_row":
            df = df.withColumn("__drop", (col("__drop") | failed) if "__drop" in df.columns else failed)
    return df.drop("__value", "__reason", "__missing")


def parse_boolean(text: Column, config: BooleanParsing) -> Column:
    token = F.lower(stripped(text))
    yes, no = ([str(v).strip().lower() for v in values] for values in (config.true_values, config.false_values))
    return F.when(token.isin(*yes) if yes else F.lit(False), True).when(token.isin(*no) if no else F.lit(False), False)


def _booleans(df: DataFrame, policy: Policy) -> DataFrame:
    for name in typed_columns(df, policy, ("boolean",)):
        kind, config = df.schema[name].dataType, policy.parsing.boolean_for(name)
        empty = missing(name, kind)
        value = F.when(~empty, parse_boolean(col(name).cast("string"), config))
        reason = F.when(~empty & value.isNull(), F.lit("invalid_boolean"))
        df = _finish(df, name, value, reason, config.on_failure, "parsing.boolean", empty)
    return df


def with_number(df: DataFrame, name: str, policy: Policy, out: str = "__number", why: str = "__why") -> DataFrame:
    """Adds the parsed number of a column and the reason of a failure, step by step so that no step is written out twice."""
    config, kind = policy.parsing.numeric, df.schema[name].dataType
    if not is_text(kind):
        return df.withColumns({out: F.when(~missing(name, kind), col(name).try_cast("double")), why: F.lit(None).cast("string")})
    s = "__step"
    df = df.withColumns({"__empty": missing(name, kind), s: stripped(col(name))})
    df = df.withColumn("__pct", numbers.percent(col(s)) if config.allow_percent_symbol else F.lit(False))
    if config.allow_percent_symbol:
        df = df.withColumn(s, numbers.without_percent(col(s)))
    if config.allow_commas:
        df = df.withColumn(s, numbers.without_commas(col(s)))
    if config.allow_currency_symbols:
        df = df.withColumn(s, numbers.without_symbols(col(s), policy.parsing.currency_symbols)).withColumn(s, numbers.without_code(col(s)))
    df = df.withColumns({"__stem": numbers.stem(col(s)), "__times": numbers.multiplier(col(s)), "__signed": numbers.signed(col(s))})
    read = F.when(col("__stem").isNotNull(), numbers.to_double(col("__stem")) * col("__times")).otherwise(numbers.to_double(col("__signed")))
    df = df.withColumn("__read", F.when(~col("__empty"), read))
    endless = numbers.not_finite(col("__signed")) | (F.abs(col("__read")) == F.lit(float("inf")))
    df = df.withColumn("__endless", F.coalesce(endless, F.lit(False)))
    scaled = F.when(col("__pct") & F.lit(config.percent_scale != "0_100"), col("__read") / 100).otherwise(col("__read"))
    reason = F.when(col("__empty"), F.lit(None)).when(col("__endless"), "infinite_or_nan_value").when(col("__read").isNull(), "invalid_numeric")
    df = df.withColumns({out: F.when(~col("__endless"), scaled), why: reason})
    return df.drop("__empty", s, "__pct", "__stem", "__times", "__signed", "__read", "__endless")


def _numbers(df: DataFrame, policy: Policy) -> DataFrame:
    for name in typed_columns(df, policy, NUMBERS):
        empty = missing(name, df.schema[name].dataType)
        df = with_number(df, name, policy)
        df = _finish(df, name, col("__number"), col("__why"), policy.parsing.numeric.on_failure, "parsing.numeric", empty).drop("__number", "__why")
    return df


def with_datetime(df: DataFrame, name: str, policy: Policy, out: str = "__time") -> DataFrame:
    """Adds the parsed datetime of a column; missing and unreadable values are null."""
    config, kind = policy.parsing.datetime, df.schema[name].dataType
    empty = missing(name, kind)
    if is_time(kind):
        return df.withColumn(out, F.when(~empty, col(name).cast("timestamp_ntz")))
    text = F.when(~empty, col(name).cast("string"))
    return dates.parse(df, text, out, config.allowed_formats, config.dayfirst, config.yearfirst)


def _datetimes(df: DataFrame, policy: Policy) -> DataFrame:
    for name in typed_columns(df, policy, TIMES):
        kind = df.schema[name].dataType
        empty = missing(name, kind)
        df = with_datetime(df, name, policy)
        outside = col("__time").isNotNull() & ~dates.in_range(col("__time"))
        failed = ~empty & col("__time").isNull()
        df = df.withColumns({"__failed": failed, "__outside": outside})
        df = events.add(df, [(col("__outside"), events.event("parsing_failure", name, col(name), F.lit(None), "datetime_out_of_bounds", "parsing.datetime"))])
        reason = F.when(col("__failed"), F.lit("invalid_datetime"))
        df = _finish(df, name, F.when(~col("__outside"), col("__time")), reason, policy.parsing.datetime.on_failure, "parsing.datetime", empty)
        df = df.drop("__time", "__failed", "__outside")
    return df


def parse(df: DataFrame, policy: Policy) -> DataFrame:
    """Booleans, numbers and datetimes, each by name; rows that a policy drops for failures go once, at the end."""
    df = _datetimes(_numbers(_booleans(df, policy), policy), policy)
    if "__drop" in df.columns:
        test = col("__drop") & ~F.col(DROPPED)
        df = events.drop_rows(df, test, "parsing_on_failure_drop_row", "parsing.on_failure.drop_row").drop("__drop")
    return df
