"""The whole correction: five phases and the policy's extensions as one lazy chain, with its audit and scores."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.columns import DROPPED, EVENTS, ROW_ID, VIOLATIONS
from sluice.operators import dedupe, events, impute, parse, profile, standardize, validity
from sluice.plans.policy import Policy, against_columns
from sluice.plans.score import delta
from sluice.sources.scratch import Scratch


@dataclass
class Result:
    """A corrected table and what happened to it; both frames are lazy over the same chain."""

    rows: DataFrame
    policy: Policy
    clock: str
    steps: list[dict[str, Any]] = field(default_factory=list)
    rules: list[tuple[str, str, str]] = field(default_factory=list)
    dropped_columns: list[str] = field(default_factory=list)

    def written(self) -> Result:
        """The same result over rows that are written once: table, events, profile and report then read them, and no step runs again."""
        return replace(self, rows=Scratch(self.rows.sparkSession, "corrected").save(self.rows, "rows").read())

    def table(self, keep_row_id: bool = False) -> DataFrame:
        out = events.kept(self.rows).drop(VIOLATIONS, *self.dropped_columns)
        return out if keep_row_id else out.drop(ROW_ID)

    def events(self) -> DataFrame:
        """Every audit event: those of values and rows, of validity rules, and of skipped columns."""
        found = events.events(self.rows, self.clock)
        if self.rules:
            found = found.unionByName(validity.violation_events(self.rows, self.rules, self.policy, self.clock), allowMissingColumns=True)
        if any(s["skipped"] for s in self.steps):
            found = found.unionByName(impute.skipped_events(self.rows, self.steps, self.clock), allowMissingColumns=True)
        return found


def cleaned(df: DataFrame, policy: Policy) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Phases 1 to 4, which look at one row at a time (duplicates, a policy's own section, excepted): no job runs."""
    df = parse.parse(standardize.standardize(events.start(df), policy), policy)
    named = [r[:3] for r in validity.rules(df, policy)] if policy.validity_rules.enabled else []
    return impute.drop_critical(validity.validate(df, policy), policy), named


def correct(df: DataFrame, policy: Policy, clock: str | None = None, statistics: dict[str, dict[str, Any]] | None = None, extensions: bool = False) -> Result:
    """Standardise, parse, validate, drop rows without critical values, impute.

    ``df`` has the row ids of ``sources.tables``. Imputation statistics come from the rows that earlier phases keep,
    unless they are given; where there are any, those rows are written first, so that they are cleaned once. With
    ``extensions`` the policy's sections for duplicates, outliers and missing shares act too, after parsing and
    before imputation.
    """
    errors, _ = against_columns(policy, df.columns)
    if errors:
        raise ValueError("; ".join(errors))
    rows, named = cleaned(df, policy)
    absent: list[str] = []
    if extensions or impute.needs_statistics(rows, policy, statistics):
        rows = Scratch(df.sparkSession, "cleaned").save(rows, "rows").read()
    if extensions:
        rows = impute.drop_sparse_rows(rows, policy)
        rows = dedupe.outliers(dedupe.deduplicate(rows, policy), policy)
        absent = impute.sparse_columns(rows, policy)
    steps = impute.plan(rows.drop(*absent), policy, statistics)
    return Result(impute.impute(rows, steps), policy, clock or profile.now(), steps, named, absent)


def compare(df: DataFrame, policy: Policy, clock: str | None = None) -> dict[str, Any]:
    """The raw profile with the score of the corrected table beside it."""
    before = profile.profile(df, policy, clock)
    after = profile.profile(correct(df, policy, clock).written().table(keep_row_id=True), policy, clock)
    before["readiness"]["transformation"] = {"raw": before["readiness"]["score"], "optimized": after["readiness"]["score"], "delta": delta(before["readiness"], after["readiness"])}
    return before


def row_local(df: DataFrame, policy: Policy, steps: list[dict[str, Any]] | None = None, clock: str = "") -> Result:
    """Phases 1 to 4 and a given imputation plan: no aggregation over rows, so it also fits a stream's batches."""
    rows, named = cleaned(df, policy)
    return Result(impute.impute(rows, steps or []), policy, clock, steps or [], named)


def change_counts(result: Result) -> DataFrame:
    return result.rows.select(F.explode_outer(EVENTS).alias("e")).where("e is not null").groupBy("e.event_type", "e.column", "e.reason").agg(F.count(F.lit(1)).alias("count"))


__all__ = ["DROPPED", "Result", "change_counts", "cleaned", "compare", "correct", "row_local"]
