"""The correction report: scores, actions and compliance, as a mapping and as Markdown."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.events import ROW
from sluice.plans.policy import Policy
from sluice.plans.score import delta

TOP_COLUMNS = 10
LISTED = {"json": 50, "violations": 10, "skipped": 20}


def top_columns(events: DataFrame, k: int = TOP_COLUMNS) -> DataFrame:
    """The k columns with most events, ties by name."""
    named = events.where(F.col("column").isNotNull() & (F.col("column") != "") & (F.col("column") != ROW))
    return named.groupBy("column").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "column").limit(k)


def build_report(before: dict[str, Any], after: dict[str, Any], events: DataFrame, policy: Policy, steps: list[dict[str, Any]] | None = None) -> dict[str, Any]:
    """From two profiles and the events of a run; the driver gets one row a kind of event.

    Columns that were not filled come from the imputation plan; without one, from the raw profile and the policy's limits.
    """
    groups = events.groupBy("event_type", "column", "reason").agg(F.count(F.lit(1)).alias("n")).collect()
    kinds, reasons, columns = {}, {}, {}
    for g in groups:
        kinds[g["event_type"]] = kinds.get(g["event_type"], 0) + g["n"]
        if g["event_type"] == "row_dropped":
            reasons[g["reason"]] = reasons.get(g["reason"], 0) + g["n"]
        if g["column"] not in (None, "", ROW):
            columns[g["column"]] = columns.get(g["column"], 0) + g["n"]
    top = sorted(columns.items(), key=lambda c: (-c[1], c[0]))[:TOP_COLUMNS]
    drops = {"total": sum(reasons.values()), "by_reason": dict(sorted(reasons.items()))}
    protected = set(policy.roles.protected_columns)
    hits = sorted(({"event_type": g["event_type"], "column": g["column"], "reason": g["reason"]} for g in groups if g["column"] in protected), key=str)
    return {
        "metadata": {
            "dataset_name": before["metadata"]["dataset_name"],
            "policy_hash": before["metadata"]["policy_hash"],
            "timestamp_raw": before["metadata"]["timestamp"],
            "timestamp_optimized": after["metadata"]["timestamp"],
            "rows_raw": before["metadata"]["row_count"],
            "rows_optimized": after["metadata"]["row_count"],
        },
        "readiness": {"raw": before["readiness"], "optimized": after["readiness"], "delta": delta(before["readiness"], after["readiness"])},
        "actions": {"event_counts": dict(sorted(kinds.items())), "top_impacted_columns": [{"column": c, "count": n} for c, n in top], "row_drops": drops},
        "compliance": {
            "protected_columns": {"status": "fail" if hits else "pass", "protected_count": len(protected), "violations": hits[: LISTED["json"]]},
            "skipped_imputation_columns": _skipped(before, policy, steps),
            "critical_row_drops": drops,
        },
    }


def _skipped(before: dict[str, Any], policy: Policy, steps: list[dict[str, Any]] | None) -> list[dict[str, Any]]:
    fill = policy.missing_data.imputation
    if steps is not None and any(s["skipped"] for s in steps):
        return [{"column": s["column"], "bucket": s["bucket"], "missing_pct": round(s["missing_pct"], 4), "threshold": getattr(fill, s["bucket"]).allow_if_missing_pct_leq} for s in steps if s["skipped"]]
    from sluice.plans.policy import NUMBERS, TIMES

    out = []
    for name, stats in before["columns"].items():
        typed = policy.parsing.column_types.get(name)
        if typed and typed != "boolean":
            bucket = "numeric" if typed in NUMBERS else "datetime" if typed in TIMES else "categorical"
            most = getattr(fill, bucket).allow_if_missing_pct_leq
            if stats["effective_missing_pct"] > most:
                out.append({"column": name, "bucket": bucket, "missing_pct": stats["effective_missing_pct"], "threshold": most})
    return out


def markdown(report: dict[str, Any]) -> str:
    meta, ready, actions, kept = report["metadata"], report["readiness"], report["actions"], report["compliance"]
    lines = ["# Correction Report", "", "## Job Summary", ""]
    lines += [f"- Dataset: **{meta['dataset_name']}**", f"- Policy hash: `{meta['policy_hash']}`", f"- Rows (raw → optimized): **{meta['rows_raw']} → {meta['rows_optimized']}**", ""]
    lines += ["## Readiness Impact", ""]
    lines += [f"- Raw score: **{ready['raw']['score']}**", f"- Optimized score: **{ready['optimized']['score']}**", f"- Delta: **{ready['delta']['score']}**", ""]
    lines += ["## Actions", "", "### Event Counts", "", *(f"- {k}: **{n}**" for k, n in actions["event_counts"].items()), ""]
    lines += ["### Top Impacted Columns", "", *(f"- {c['column']}: **{c['count']}**" for c in actions["top_impacted_columns"]), ""]
    drops = actions["row_drops"]
    lines += ["### Critical Row Drops", "", f"- Total rows dropped: **{drops['total']}**", *(f"- {k}: **{n}**" for k, n in drops["by_reason"].items()), ""]
    status = kept["protected_columns"]
    lines += ["## Policy Compliance", "", f"- Protected columns status: **{status['status']}**"]
    if status["violations"]:
        lines += ["", "### Protected Column Violations (sample)", ""]
        lines += [f"- column={v['column']} event={v['event_type']} reason={v['reason']}" for v in status["violations"][: LISTED["violations"]]]
    lines += ["", "### Skipped Imputation Columns", ""]
    lines += [f"- {s['column']} ({s['bucket']}): missing_pct={s['missing_pct']} > threshold={s['threshold']}" for s in kept["skipped_imputation_columns"][: LISTED["skipped"]]] or ["- None"]
    return "\n".join([*lines, ""])
