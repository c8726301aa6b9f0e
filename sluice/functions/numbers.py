"""Tolerant numbers: steps that turn text like ``(1,234.50)``, ``USD 5``, ``1.5K`` or ``12 %`` into doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.missing import stripped

# Currency signs and codes, in the order in which they are tried.
SYMBOLS = ("$", "€", "£", "₹", "¥")
CODES = ("USD", "EUR", "GBP", "INR", "JPY", "AUD", "CAD", "CHF", "CNY", "MXN", "BRL", "KRW", "SGD", "HKD", "NZD", "RS.", "RS")

#: What counts as a number once it is cleaned; underscores between digits are allowed.
GRAMMAR = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_NOT_FINITE = ("nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def _any_code() -> str:
    return "|".join(c.replace(".", r"\.") for c in CODES)


def percent(text: Column) -> Column:
    return F.contains(text, F.lit("%"))


def without_percent(text: Column) -> Column:
    """Text with a percent sign anywhere loses it, and its white space runs become spaces."""
    flat = stripped(F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "), "%", ""))
    return F.when(percent(text), flat).otherwise(text)


def without_commas(text: Column) -> Column:
    return F.regexp_replace(text, ",", "")


def without_symbols(text: Column, more: Sequence[str] = ()) -> Column:
    """Without currency signs; signs of the policy may have several characters."""
    out = F.translate(text, "".join(SYMBOLS), "")
    for symbol in more:
        out = F.replace(out, F.lit(symbol), F.lit(""))
    return stripped(out)


def without_code(text: Column) -> Column:
    """Without one currency code before or else after the number, if something remains."""
    before = rf"(?i)^(?:{_any_code()})\s*(?=\S)"
    return F.when(text.rlike(before), F.regexp_replace(text, before, "")).otherwise(F.regexp_replace(text, rf"(?i)(?<=\S)\s*(?:{_any_code()})$", ""))


def stem(text: Column) -> Column:
    """What stands before a final K, M, B or T, if that is a number; else null."""
    found = F.regexp_extract(stripped(text), r"(?s)^(.*)[KMBTkmbt]$", 1)
    return F.when(stripped(found).rlike(GRAMMAR), stripped(found))


def multiplier(text: Column) -> Column:
    last = F.upper(F.substr(stripped(text), F.lit(-1)))
    return F.when(last == "K", 1e3).when(last == "M", 1e6).when(last == "B", 1e9).when(last == "T", 1e12)


def signed(text: Column) -> Column:
    """Parentheses and long dashes as minus, without a leading plus, without single spaces between digits."""
    out = F.regexp_replace(stripped(text), r"(?s)^\((.*)\)$", "-$1")
    out = F.regexp_replace(out, "^[–—]", "-")
    out = F.regexp_replace(out, r"^\+(?=[^+])", "")
    return F.regexp_replace(out, r"(?<=\d) (?=\d)", "")


def to_double(text: Column) -> Column:
    """The value of text in the number grammar, else null; too large exponents give infinity."""
    clean = stripped(text)
    return F.when(clean.rlike(GRAMMAR), F.regexp_replace(clean, "_", "").try_cast("double"))


def not_finite(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, " ", "")).isin(*_NOT_FINITE)


def profile_number(text: Column, commas: bool = True, currency: bool = True, percents: bool = True) -> Column:
    """The simpler reading of profiles: a final percent sign is dropped and not applied, no codes, suffixes or parentheses."""
    out = stripped(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    if percents:
        out = stripped(F.regexp_replace(out, "%$", ""))
    if commas:
        out = F.regexp_replace(out, ",", "")
    if currency:
        out = F.translate(out, "".join(SYMBOLS), "")
    return to_double(out)
