"""The three notions of a missing value, kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.columns import col, is_text

# Tokens that stand for a missing value.
PROFILE_TOKENS = ("", "nan", "null", "none", "na", "n/a")
ENGINE_TOKENS = (*PROFILE_TOKENS, "inf", "-inf", "infinity", "-infinity")
SAMPLE_TOKENS = (
    *("", " ", "null", "none", "n/a", "na", "nan", "nil", "-", "--", ".", "?", "undefined", "missing", "unknown"),
    *("#n/a", "#ref!", "#value!", "#null!", "not available"),
)
#: What a CSV scan turns into null.
CSV_TOKENS = (
    *("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA"),
    *("NULL", "NaN", "None", "n/a", "nan", "null"),
)

_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(text: Column) -> Column:
    """Text without Unicode white space at its ends."""
    return F.regexp_replace(text, _EDGES, "")


def _token(text: Column, tokens: tuple[str, ...]) -> Column:
    return F.lower(stripped(text)).isin(*tokens)


def _floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def missing(name: str, kind: T.DataType) -> Column:
    """Missing for parsing, dropping and imputing: null, NaN, infinite, or a token in any letter case."""
    value = col(name)
    if is_text(kind):
        return F.coalesce(_token(value, ENGINE_TOKENS), F.lit(True))
    if _floating(kind):
        return value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return value.isNull()


def missing_in_profile(name: str, kind: T.DataType) -> Column:
    """Missing for profiles: null, NaN, or in text columns a token; infinities count as present."""
    value = col(name)
    if is_text(kind):
        return F.coalesce(_token(value, PROFILE_TOKENS), F.lit(True))
    return value.isNull() | F.isnan(value) if _floating(kind) else value.isNull()


def null_like(name: str, kind: T.DataType) -> Column:
    value = col(name)
    return value.isNull() | F.isnan(value) if _floating(kind) else value.isNull()
