"""Column names as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_row_id"
EVENTS = "_events"
DROPPED = "_dropped"
VIOLATIONS = "_violations"
RESERVED = (ROW_ID, EVENTS, DROPPED, VIOLATIONS)


def col(name: str) -> Column:
    """The column of exactly that name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def text_of(name: str, kind: T.DataType) -> Column:
    """A value as text for audits and lengths; whole doubles keep one decimal."""
    if isinstance(kind, T.BooleanType):
        return F.initcap(col(name).cast("string"))
    return col(name).cast("string")
