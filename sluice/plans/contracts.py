"""Shapes that profiles, audit logs and reports must have."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

# Required keys of each record.
DETAILED = ("timestamp", "event_type", "reason", "policy_section")
AGGREGATE = ("type", "event_type", "column", "reason", "count", "samples")
FOOTER = ("type", "detail", "total_events", "event_type_counts", "unique_columns_touched", "job_context")
PROFILE = ("dataset_name", "timestamp", "row_count", "col_count")


def _need(record: Any, keys: tuple[str, ...], what: str) -> None:
    if not isinstance(record, dict):
        raise ValueError(f"{what} is no mapping")
    if absent := [k for k in keys if k not in record]:
        raise ValueError(f"{what} lacks {absent}")


def validate_profile(profile: Any) -> None:
    _need(profile, ("metadata", "readiness", "columns"), "profile")
    _need(profile["metadata"], PROFILE, "profile metadata")
    _need(profile["readiness"], ("score", "breakdown"), "profile readiness")
    _need(profile["columns"], (), "profile columns")
    for name, record in profile["columns"].items():
        _need(record, (), f"column {name!r}")


def validate_audit_record(record: Any) -> None:
    _need(record, (), "audit record")
    kind = record.get("type", "detailed")
    if kind not in ("detailed", "summary_aggregate", "job_summary"):
        raise ValueError(f"unknown audit record {kind!r}")
    _need(record, {"detailed": DETAILED, "summary_aggregate": AGGREGATE, "job_summary": FOOTER}[kind], f"{kind} record")
    if kind == "summary_aggregate" and not isinstance(record["samples"], list):
        raise ValueError("samples are no list")
    if kind == "job_summary":
        _need(record["event_type_counts"], (), "event_type_counts")
        _need(record["job_context"], (), "job_context")


def validate_audit_log(path: str | Path) -> None:
    """Every line is a record, and the footer is the last one and the only one. One line is held at a time."""
    kind, n = None, 0
    with Path(path).open(encoding="utf-8", newline="\n") as lines:
        for n, line in enumerate(lines, 1):
            if kind == "job_summary":
                raise ValueError("the job summary is not the last line alone")
            record = json.loads(line)
            validate_audit_record(record)
            kind = record.get("type")
    if not n:
        raise ValueError("the audit log is empty")
    if kind != "job_summary":
        raise ValueError("the job summary is not the last line alone")


def validate_report(report: Any) -> None:
    _need(report, ("metadata", "readiness", "actions", "compliance"), "report")
    _need(report["metadata"], ("rows_raw", "rows_optimized"), "report metadata")
    _need(report["readiness"], ("raw", "optimized", "delta"), "report readiness")
    _need(report["actions"], ("event_counts", "row_drops"), "report actions")
    _need(report["compliance"], ("protected_columns",), "report compliance")
    _need(report["compliance"]["protected_columns"], ("status",), "protected columns")
