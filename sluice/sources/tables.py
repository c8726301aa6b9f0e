"""Scans and sinks."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.columns import ROW_ID, col
from sluice.functions.missing import CSV_TOKENS
from sluice.functions.numbers import GRAMMAR

_CORRUPT = "_corrupt_line"


def clean_name(name: str) -> str:
    return name.replace("﻿", "").strip()


def distinct_names(names: list[str]) -> list[str]:
    """Cleaned names; repeats get .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in map(clean_name, names):
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
    return out


def read_csv(spark: SparkSession, path: str, limit: int | None = None, row_ids: bool = True, types: bool = True, separator: str = ",", multiline: bool = False) -> DataFrame:
    """A CSV file with header as text columns, then typed as its values allow.

    Marks and spaces around names go, spaces before values go, empty and other null tokens become null. Lines with
    too few fields are padded, lines with too many are dropped. Files are split among tasks; with ``multiline``
    quoted fields may hold line ends, and each file is read by one task.
    """
    header = spark.read.csv(path, header=False, multiLine=multiline, sep=separator, escape='"', ignoreLeadingWhiteSpace=True).first()
    if header is None:
        return spark.createDataFrame([], T.StructType([]))
    names = distinct_names([v or f"Unnamed: {i}" for i, v in enumerate(header)])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("__over", T.StringType()), T.StructField(_CORRUPT, T.StringType())])
    options = {"header": True, "enforceSchema": True, "multiLine": multiline, "sep": separator, "escape": '"', "ignoreLeadingWhiteSpace": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "nullValue": ""}
    df = spark.read.schema(schema).options(**options).csv(path)
    # one more field than the header has marks a line that is too long
    df = df.where(F.col("__over").isNull()).drop("__over", _CORRUPT)
    tokens = F.array(*[F.lit(t) for t in CSV_TOKENS])
    df = df.select(*[F.when(~F.array_contains(tokens, F.col(f"c{i}")), F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
    df = with_row_ids(df) if row_ids else df
    if limit is not None:
        df = df.where(F.col(ROW_ID) <= limit) if row_ids else df.limit(limit)
    return typed_by_values(df) if types else df


def read_table(spark: SparkSession, path: str, row_ids: bool = True, multiline: bool = False) -> DataFrame:
    """Any source by suffix: CSV, Excel, JSON lines, ORC, else Parquet."""
    low = path.lower()
    if low.endswith((".csv", ".txt", ".tsv")):
        return read_csv(spark, path, row_ids=row_ids, separator="\t" if low.endswith(".tsv") else ",", multiline=multiline)
    if low.endswith((".xlsx", ".xls")):
        df = read_excel(spark, path)
    elif low.endswith((".json", ".jsonl")):
        df = spark.read.json(path)
    else:
        df = spark.read.orc(path) if low.endswith(".orc") else spark.read.parquet(path)
    df = df.toDF(*distinct_names(df.columns))
    return with_row_ids(df) if row_ids else df


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A sheet by pandas on the driver; sheets have a bounded size. Needs an Excel reader of pandas."""
    import pandas as pd

    frame = pd.read_excel(path, dtype=str)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"`{c}` string" for c in frame.columns))


def with_row_ids(df: DataFrame) -> DataFrame:
    """Row ids: a column of that name as whole numbers, else dense numbers from 1 in reading order.

    Dense numbers need the rows of the partitions before: one count a partition, joined by broadcast.
    """
    if ROW_ID in df.columns:
        return df.withColumn(ROW_ID, F.floor(col(ROW_ID).cast("string").try_cast("double")).cast("long"))
    marked = df.withColumn("__place", F.monotonically_increasing_id())
    part = F.shiftright("__place", 33)
    counts = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    # one row a partition, so its running sum is small and so is the broadcast
    before = F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = F.broadcast(counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before")))
    names = [col(c) for c in df.columns]
    joined = marked.join(starts, part == F.col("__part"), "left")
    return joined.select(*names, (F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1).alias(ROW_ID))


def typed_by_values(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text columns whose values are all numbers become long or double, all truth values boolean. One aggregation."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not names:
        return df
    aggs = []
    for i, n in enumerate(names):
        value = col(n)
        aggs += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.isNull()).alias(f"null{i}"),
            F.count_if(value.rlike(GRAMMAR) & ~value.contains("_")).alias(f"number{i}"),
            F.count_if(value.rlike(r"^[+-]?\d{1,18}$")).alias(f"whole{i}"),
            F.count_if(value.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(f"truth{i}"),
        ]
    row = df.agg(*aggs).first()
    kinds = {}
    for i, n in enumerate(names):
        count = row[f"n{i}"]
        if count and row[f"whole{i}"] == count and not row[f"null{i}"]:
            kinds[n] = "long"
        elif count and row[f"number{i}"] == count:
            kinds[n] = "double"
        elif count and row[f"truth{i}"] == count and not row[f"null{i}"]:
            kinds[n] = "boolean"
    return df.withColumns({n: col(n).try_cast(k) for n, k in kinds.items()}) if kinds else df


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV files with headers below a folder; ``single`` makes one part, for small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_output(df: DataFrame, path: str, form: str) -> None:
    """By the policy's output format."""
    {"csv": write_csv, "parquet": write_parquet}[form](df, path)


def plain(value: Any) -> Any:
    """A value that JSON has: numbers that are not finite become null, keys text, odd types text."""
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def write_json(record: Mapping[str, Any], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain(record), sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n", encoding="utf-8")


def read_json(path: str | Path) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit lines as rows; lines that are no JSON are left out."""
    lines = spark.read.text(path).select(F.col("value"))
    schema = "type string, event_type string, row_id long, column string, old_value string, new_value string, reason string, policy_section string, timestamp string, count long, violation_count long, detail string, total_events long"
    return lines.select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok")).where("ok").select("r.*")
