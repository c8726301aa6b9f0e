"""Phase 1: text steps over every unprotected string column, each with its own audit events."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.functions.columns import RESERVED, col, is_text
from sluice.operators import events
from sluice.plans.policy import Policy
from sluice.sources.scratch import BROADCAST_BYTES

SECTION = "standardization"


def text_columns(df: DataFrame, policy: Policy) -> list[str]:
    protected = set(policy.roles.protected_columns)
    return [f.name for f in df.schema.fields if is_text(f.dataType) and f.name not in protected and f.name not in RESERVED]


def _step(df: DataFrame, names: list[str], change: Callable[[str], Column], reason: str, section: str) -> DataFrame:
    """Changes columns and adds an event wherever a value became another."""
    if not names:
        return df
    after = {n: f"__new_{i}" for i, n in enumerate(names)}
    df = df.withColumns({after[n]: change(n) for n in names})
    found = [(~col(n).eqNullSafe(col(after[n])), events.event("standardization_change", n, col(n), col(after[n]), reason, section)) for n in names]
    df = events.add(df, found)
    return df.withColumns({n: col(after[n]) for n in names}).drop(*after.values())


def standardize(df: DataFrame, policy: Policy) -> DataFrame:
    """Strip, trim, collapse, asciify, fold and map, in this order."""
    config = policy.standardization
    names = text_columns(df, policy)
    steps: list[tuple[bool, Callable[[Column], Column], str]] = [
        (config.strip_nonprinting, text.strip_nonprinting, "strip_nonprinting"),
        (config.global_trim_whitespace, text.trim, "trim_whitespace"),
        (config.global_collapse_whitespace, text.collapse, "collapse_whitespace"),
        (config.asciify, text.asciify, "asciify_accents"),
        (config.casefold != "none", lambda c: text.casefold(c, config.casefold), f"casefold_{config.casefold}"),
    ]
    for wanted, change, reason in steps:
        if wanted:
            df = _step(df, names, lambda n, f=change: f(col(n)), reason, f"{SECTION}.{reason}")
    mapped = [n for n in df.columns if n in config.mappings and n not in policy.roles.protected_columns]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name in mapped:
        entries = config.mappings[name]
        if len(entries) > text.LITERAL_ENTRIES:
            df = _joined(df, name, entries)
            df = _step(df, [name], lambda n: F.when(col("__hit"), col("__entry").cast(kinds[n])).otherwise(col(n)), "value_mapping", f"{SECTION}.mappings").drop("__entry", "__hit")
        elif entries:
            df = _step(df, [name], lambda n, e=entries: text.mapped(col(n).cast("string"), e).cast(kinds[n]), "value_mapping", f"{SECTION}.mappings")
    return df


def _joined(df: DataFrame, name: str, entries: Mapping[str, str]) -> DataFrame:
    """Adds the entry of each value of a long mapping. The side is broadcast if its text is small enough."""
    table = df.sparkSession.createDataFrame(list(entries.items()), "__of string, __entry string").withColumn("__hit", F.lit(True))
    small = sum(len(k) + len(v) for k, v in entries.items()) <= BROADCAST_BYTES // 4
    return df.join(F.broadcast(table) if small else table, col(name).cast("string") == F.col("__of"), "left").drop("__of")
