"""The readiness score of a profile, 0 to 100."""

from __future__ import annotations

from typing import Any

#: Points of each part, and what a faulty critical column costs.
POINTS = {"completeness": 40.0, "validity": 30.0, "uniqueness": 20.0, "consistency": 10.0}
CRITICAL_PENALTY = 10.0


def _mean(pairs: list[tuple[float, float]]) -> float:
    weight = sum(w for _, w in pairs)
    return sum(v * w for v, w in pairs) / weight if weight else 1.0


def readiness(profile: dict[str, Any]) -> dict[str, Any]:
    """Present values (critical columns twice), values of the right type, rows that are no duplicates, columns of one type."""
    rows, columns = profile["metadata"]["row_count"], list(profile["columns"].values())
    if not rows:
        return {"score": 0.0, "breakdown": dict.fromkeys(POINTS, 0.0)}
    repeats = profile["duplicates"]
    parts = {
        "completeness": _mean([(1 - c["effective_missing_pct"], 2.0 if c["role"] == "critical" else 1.0) for c in columns]),
        "validity": _mean([(1 - c["invalid_type_pct"], 1.0) for c in columns if c["invalid_type_pct"] is not None]),
        "uniqueness": 1 - max(repeats["exact_row_dupe_count"], repeats["pk_dupe_count"] or 0) / rows,
        "consistency": _mean([(0.0 if c["is_mixed_type"] else 1.0, 1.0) for c in columns]),
    }
    score = sum(parts[k] * p for k, p in POINTS.items())
    if any(c["role"] == "critical" and (c["effective_missing_pct"] or c["invalid_type_pct"]) for c in columns):
        score -= CRITICAL_PENALTY
    return {"score": round(min(100.0, max(0.0, score)), 2), "breakdown": {k: round(v * POINTS[k], 2) for k, v in parts.items()}}


def delta(before: dict[str, Any], after: dict[str, Any]) -> dict[str, Any]:
    old, new = before.get("breakdown", {}), after.get("breakdown", {})
    return {
        "score": round(after.get("score", 0.0) - before.get("score", 0.0), 2),
        "breakdown": {k: round(new.get(k, 0.0) - old.get(k, 0.0), 2) for k in sorted({*old, *new})},
    }
