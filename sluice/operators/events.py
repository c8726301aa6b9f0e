"""Audit events: collected beside each row while it is cleaned, exploded or summed up afterwards."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions.columns import DROPPED, EVENTS, ROW_ID, col
from sluice.sources.scratch import Scratch, join_text

#: One event inside a row; the row id is the row's.
EVENT = "struct<event_type:string,column:string,old_value:string,new_value:string,reason:string,policy_section:string>"
ROW = "__row__"
SAMPLES = 25


def event(kind: str, column: str, old: Column, new: Column, reason: Column | str, section: str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    made = F.struct(
        F.lit(kind).alias("event_type"), F.lit(column).alias("column"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), reason.alias("reason"), F.lit(section).alias("policy_section")
    )
    return made.cast(EVENT)


def start(df: DataFrame) -> DataFrame:
    """Adds the columns that phases write to."""
    return df.withColumns({EVENTS: F.array().cast(f"array<{EVENT}>"), DROPPED: F.lit(False)})


def add(df: DataFrame, found: list[tuple[Column, Column]]) -> DataFrame:
    """Appends each (condition, event) to rows that are still kept, in order."""
    if not found:
        return df
    new = F.filter(F.array(*[F.when(test & ~F.col(DROPPED), made) for test, made in found]), lambda e: e.isNotNull())
    return df.withColumn(EVENTS, F.concat(EVENTS, new))


def drop_rows(df: DataFrame, test: Column, reason: str, section: str) -> DataFrame:
    """Marks rows as dropped, each with one event."""
    found = event("row_dropped", ROW, F.lit("row_present"), F.lit(None), reason, section)
    return add(df, [(test, found)]).withColumn(DROPPED, sealed(F.col(DROPPED) | test))


def sealed(test: Column) -> Column:
    """The same truth value, but not to be pushed below the projection that computes it.

    A filter on a late column would otherwise be rewritten in terms of the scan's columns, with every step of every
    phase written out at each mention, which grows exponentially with the number of steps.
    """
    return test & (F.monotonically_increasing_id() >= 0)


def events(df: DataFrame, clock: str) -> DataFrame:
    """One row for each event of the rows, dropped rows included."""
    # the outer form: for the inner one Spark pushes a filter on the whole array down to the scan
    one = df.select(F.col(ROW_ID).alias("row_id"), F.explode_outer(EVENTS).alias("e")).where("e is not null")
    return one.select("e.event_type", "row_id", "e.column", "e.old_value", "e.new_value", "e.reason", "e.policy_section", F.lit(clock).alias("timestamp"))


def kept(df: DataFrame) -> DataFrame:
    return df.where(~F.col(DROPPED)).drop(EVENTS, DROPPED)


def summary(found: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Count and first samples (by row id) for each event type, column and reason.

    Counts are partial sums. Samples are cut within salted parts of a group first, so a group's events never meet in one task.
    """
    keys = ["event_type", "column", "reason"]
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("row_id").asc_nulls_last(), "old_value"]
    parts = found.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(32)))
    first = parts.withColumn("n", F.row_number().over(W.partitionBy(*keys, "part").orderBy(*order))).where(F.col("n") <= samples)
    first = first.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= samples)
    fields = ["row_id", "old_value", "new_value", "policy_section", "timestamp"]
    taken = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", *fields))).alias("samples"))
    same = [counts[k].eqNullSafe(taken[k]) for k in keys]
    joined = counts.join(taken, same[0] & same[1] & same[2], "left")
    return joined.select(*[counts[k] for k in keys], "count", F.transform("samples", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("samples"))


def footer(found: DataFrame, detail: str = "summary", context: dict[str, Any] | None = None, clock: str | None = None) -> dict[str, Any]:
    """Totals of a run; the driver gets one row an event type and column."""
    rows = found.groupBy("event_type", "column").agg(F.count(F.lit(1)).alias("n")).collect()
    by_type: dict[str, int] = {}
    for r in rows:
        by_type[r["event_type"]] = by_type.get(r["event_type"], 0) + r["n"]
    return {
        "type": "job_summary",
        "detail": detail,
        "total_events": sum(by_type.values()),
        "event_type_counts": dict(sorted(by_type.items())),
        "unique_columns_touched": len({r["column"] for r in rows} - {None, "", ROW}),
        "timestamp_start": clock if rows else None,
        "timestamp_end": clock if rows else None,
        "job_context": dict(sorted((context or {}).items())),
    }


def json_line(record: dict[str, Any]) -> str:
    from sluice.sources.tables import plain

    return json.dumps(plain(record), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def json_lines(found: DataFrame) -> DataFrame:
    """The events as lines of ``json_line``, in the order of a log: null fields are left out, null values stay."""
    fields = []
    for name in sorted(found.columns):
        one = F.to_json(F.struct(col(name)), {"ignoreNullFields": "false" if name.endswith("value") else "true"})
        fields.append(F.substr(one, F.lit(2), F.length(one) - 2))
    line = F.concat(F.lit("{"), F.array_join(F.array_remove(F.array(*fields), ""), ","), F.lit("}"))
    return found.orderBy("column", "row_id", "event_type", "reason").select(line.alias("value"))


def write_audit(found: DataFrame, path: str | Path, detail: str = "summary", context: dict[str, Any] | None = None, clock: str | None = None) -> dict[str, Any]:
    """One JSONL file on the driver's disk, footer last. Detailed lines are written by tasks and copied there file by file, so none is held."""
    last = footer(found, detail, context, clock)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if detail == "detailed":
        scratch = Scratch(found.sparkSession, "audit")
        parts = scratch.new_path("lines")
        json_lines(found).write.text(parts)
        join_text(found.sparkSession, parts, path)
        scratch.drop()
    else:
        Path(path).write_text("", encoding="utf-8")
    with Path(path).open("a", encoding="utf-8") as out:
        if detail != "detailed":
            for row in summary(found).orderBy("event_type", "column", "reason").collect():
                record = row.asDict(recursive=True)
                shared = {k: record[k] for k in ("event_type", "column", "reason")}
                record["samples"] = [shared | s for s in record["samples"] or []]
                out.write(json_line({"type": "summary_aggregate"} | record) + "\n")
        out.write(json_line(last) + "\n")
    return last


def write_events(found: DataFrame, path: str) -> None:
    """Detailed events as distributed JSON files, for tables too large for one file."""
    found.write.mode("overwrite").json(path)


__all__ = ["EVENT", "ROW", "add", "col", "drop_rows", "event", "events", "footer", "json_lines", "kept", "start", "summary", "write_audit", "write_events"]
