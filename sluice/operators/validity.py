"""Phase 3: validity rules; one event for each rule that rows break."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.columns import DROPPED, VIOLATIONS, col, is_number
from sluice.operators import events
from sluice.plans.policy import Policy


def java_pattern(pattern: str) -> str:
    """A Python pattern for Spark, matched at the start only; ValueError for what Java's syntax lacks."""
    if re.search(r"\(\?P=|\(\?\(", pattern):
        raise ValueError(f"unsupported pattern {pattern!r}")
    return "^(?:" + pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z") + ")"


def rules(df: DataFrame, policy: Policy) -> Iterator[tuple[str, str, str, Column]]:
    """(column, code, message, test for a violation) of every rule that applies, in the order in which they act."""
    config = policy.validity_rules
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name in sorted(config.non_negative_columns):
        if name in kinds and is_number(kinds[name]):
            yield name, "non_negative", "Value must be >= 0", col(name) < 0
    for name, limits in config.ranges.items():
        if name in kinds and is_number(kinds[name]):
            if limits.get("min") is not None:
                yield name, "range_min", f"Value < {limits['min']}", col(name) < F.lit(limits["min"])
            if limits.get("max") is not None:
                yield name, "range_max", f"Value > {limits['max']}", col(name) > F.lit(limits["max"])
    for name, allowed in config.allowed_values.items():
        if name in kinds:
            same = [col(name) == F.lit(v).cast(kinds[name]) for v in allowed]
            test = F.lit(True)
            for one in same:
                test = test & ~F.coalesce(one, F.lit(False))
            yield name, "allowed_values", "Value not in allowed list", test
    for name, pattern in config.regex.items():
        if name in kinds:
            yield name, "regex_mismatch", f"Value does not match pattern '{pattern}'", ~col(name).cast("string").rlike(java_pattern(pattern))


def validate(df: DataFrame, policy: Policy) -> DataFrame:
    """Adds the codes of broken rules to ``_violations`` and acts on them: flag, null (later rules see the null) or drop.

    Protected columns are not exempt, as the compliance report is to show. NaN never violates a rule.
    """
    df = df.withColumn(VIOLATIONS, F.array().cast("array<int>"))
    if not policy.validity_rules.enabled:
        return df
    action = policy.validity_rules.on_violation
    for i, (name, *_, test) in enumerate(list(rules(df, policy))):
        kind = df.schema[name].dataType
        present = col(name).isNotNull() & (~F.isnan(col(name)) if kind.typeName() in ("double", "float") else F.lit(True))
        df = df.withColumn("__bad", present & test & ~F.col(DROPPED))
        df = df.withColumn(VIOLATIONS, F.when(col("__bad"), F.array_append(VIOLATIONS, F.lit(i))).otherwise(F.col(VIOLATIONS)))
        if action == "null":
            df = df.withColumn(name, F.when(~col("__bad"), col(name)))
    if action == "drop_row":
        df = df.withColumn(DROPPED, events.sealed(F.col(DROPPED) | (F.size(VIOLATIONS) > 0)))
    return df.drop("__bad")


def violation_events(df: DataFrame, named: list[tuple[str, str, str]], policy: Policy, clock: str) -> DataFrame:
    """One row for each broken rule with its count, and one for dropped rows; ``named`` lists rules as ``rules`` did."""
    action = policy.validity_rules.on_violation
    codes = df.select(F.explode_outer(VIOLATIONS).alias("rule")).where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("violation_count"))
    names = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(f"{c}: {m}").alias("text")) for n, c, m in named]) if named else F.array().cast("array<struct<column:string,text:string>>")
    one = F.get(names, F.col("rule"))
    found = codes.select(
        F.lit(f"validity_{action}").alias("event_type"),
        one["column"].alias("column"),
        F.concat(one["text"], F.lit(" ("), F.col("violation_count").cast("string"), F.lit(" rows)")).alias("reason"),
        F.lit("validity_rules").alias("policy_section"),
        F.lit(clock).alias("timestamp"),
        "violation_count",
        F.lit(None).cast("long").alias("count"),
    )
    if action != "drop_row":
        return found
    dropped = df.agg(F.count_if(F.size(VIOLATIONS) > 0).alias("n")).where("n > 0")
    total = dropped.select(
        F.lit("validity_drop").alias("event_type"),
        F.lit(None).cast("string").alias("column"),
        F.concat(F.lit("Dropped "), F.col("n").cast("string"), F.lit(" rows due to validity violations")).alias("reason"),
        F.lit("validity_rules").alias("policy_section"),
        F.lit(clock).alias("timestamp"),
        F.lit(None).cast("long").alias("violation_count"),
        F.col("n").alias("count"),
    )
    return found.unionByName(total)
