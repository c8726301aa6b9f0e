"""Tolerant dates: a ladder of patterns, then pandas for what the ladder leaves."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.missing import stripped
from sluice.session import importable

#: strptime directives as Spark patterns; days and months take one or two digits.
_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS", "p": "a",
    "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "z": "[XXX][XX][X]", "Z": "z", "j": "D",
}

_CLOCKS = (" H:m:s", " H:m", " h:m:s a", " h:m a")

#: Shapes of values for the directives of a format; other directives take anything.
_SHAPES = {"Y": r"\d{4,}", "y": r"\d{2}", "m": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "I": r"\d{1,2}", "M": r"\d{1,2}", "S": r"\d{1,2}", "b": r"\p{L}{3}", "B": r"\p{L}+"}
#: The first and last moment of a 64-bit count of nanoseconds.
EARLIEST, LATEST = "1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775"


def pattern(strptime: str) -> str:
    """A strptime format as a Spark pattern; ValueError for a directive that has none."""
    out, literal, at = [], [], 0

    def flush() -> None:
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append(f"'{text}'" if re.search("[A-Za-z]", text) else text)
            literal.clear()

    while at < len(strptime):
        char = strptime[at]
        if char == "%" and at + 1 < len(strptime):
            at += 1
            if strptime[at] == "%":
                literal.append("%")
            elif strptime[at] in _DIRECTIVES:
                flush()
                out.append(_DIRECTIVES[strptime[at]])
            else:
                raise ValueError(f"no pattern for %{strptime[at]}")
        else:
            literal.append(char)
        at += 1
    flush()
    return "".join(out)


#: Two-digit years after this one are of the century before.
LAST_SHORT_YEAR = 2068


def _try(text: Column, form: str) -> Column:
    found = F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")
    if "yy" not in form.replace("yyyy", ""):
        return found
    return let(found, lambda t: F.when(F.year(t) > LAST_SHORT_YEAR, (t - F.make_ym_interval(F.lit(100))).cast("timestamp_ntz")).otherwise(t))


def shape(strptime: str) -> str:
    """A regular expression that every value of a format matches; a failed parse is dear, a failed match is not."""
    pieces = re.findall(r"%.|[^%]+", strptime)
    return "^" + "".join(_SHAPES.get(p[1], ".+") if p[0] == "%" and p != "%%" else re.escape(p.replace("%%", "%")) for p in pieces) + "$"


def _ladder(dayfirst: bool, yearfirst: bool) -> list[tuple[str, list[str]]]:
    """(shape, patterns to try in order) of common dates; a value has one shape, so it is parsed once or twice."""
    order = (lambda forms: forms[::-1]) if dayfirst else (lambda forms: forms)
    out = [(r"^\d{8}$", ["yyyyMMdd"])]
    for mark in "-/.":
        at = re.escape(mark)
        out.append((rf"^\d{{4}}{at}\d{{1,2}}{at}\d{{1,2}}$", [mark.join(("yyyy", "M", "d"))]))
        out.append((rf"^\d{{1,2}}{at}\d{{1,2}}{at}\d{{4}}$", order([mark.join(("M", "d", "yyyy")), mark.join(("d", "M", "yyyy"))])))
    out.append((r"^\d{1,2}/\d{1,2}/\d{2}$", [*(["yy/M/d"] if yearfirst else []), *order(["M/d/yy", "d/M/yy"])]))
    out.append((r"^[A-Za-z]{3} \d", ["MMM d, yyyy", "MMM d yyyy", "MMM yyyy"]))
    out.append((r"^[A-Za-z]{4,} \d", ["MMMM d, yyyy", "MMMM d yyyy", "MMMM yyyy"]))
    out.append((r"^\d{1,2} [A-Za-z]{3} ", ["d MMM yyyy"]))
    out.append((r"^\d{1,2} [A-Za-z]{4,} ", ["d MMMM yyyy"]))
    out.append((r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ["d-MMM-yyyy"]))
    out.append((r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", ["d-MMM-yy"]))
    return out


def _by_shape(text: Column, dayfirst: bool, yearfirst: bool) -> Column:
    out = F.lit(None).cast("timestamp_ntz")
    for pattern_of, forms in reversed(_ladder(dayfirst, yearfirst)):
        out = F.when(text.rlike(pattern_of), F.coalesce(*[_try(text, form) for form in forms])).otherwise(out)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _clock(text: Column) -> Column:
    """Seconds since midnight of a time of day; 0 for no text, null for what is none."""
    times = [F.unix_timestamp(F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), text), F.lit(f"yyyy-MM-dd{c}"))) for c in _CLOCKS]
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.coalesce(*times))


def _patterns(plain: Column, dayfirst: bool, yearfirst: bool) -> Column:
    """A date by the ladder, with or without a time of day after it."""
    clock = r"( \d{1,2}:\d{2}(?::\d{2})?(?: ?[AaPp][Mm])?)$"
    day = let(F.regexp_replace(plain, clock, ""), lambda t: _by_shape(t, dayfirst, yearfirst))
    time = F.regexp_replace(F.upper(stripped(F.regexp_extract(plain, clock, 1))), r"(?<=\d)([AP]M)$", " $1")
    return (day + F.make_interval(secs=let(time, _clock).cast("decimal(18,6)"))).cast("timestamp_ntz")


def ladder(text: Column, formats: Sequence[str] = (), dayfirst: bool = False, yearfirst: bool = False) -> Column:
    """Text as timestamp_ntz: the given strptime formats in order, ISO with or without zone, then common patterns."""

    def read(clean: Column) -> Column:
        steps = [F.when(clean.rlike(shape(f)), _try(clean, pattern(f))) for f in formats]
        steps.append(F.when(clean.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}.*)?$"), clean.try_cast("timestamp").cast("timestamp_ntz")))
        plain = F.regexp_replace(clean, r"(?i)(?<=\d)(st|nd|rd|th)\b", "")
        steps.append(F.when(clean.rlike(r"\d"), let(plain, lambda p: _patterns(p, dayfirst, yearfirst))))
        return F.coalesce(*steps)

    return let(stripped(text), read)


def parse(df: DataFrame, text: Column, out: str, formats: Sequence[str] = (), dayfirst: bool = False, yearfirst: bool = False) -> DataFrame:
    """Adds the column ``out``: the ladder's value, or what pandas makes of text that the ladder leaves.

    Zoned values become UTC. Relative forms (``today``, a time alone) are no dates. Values that the ladder reads
    reach pandas as null.
    """
    df = df.withColumns({out: ladder(text, formats, dayfirst, yearfirst), "__clean": stripped(text)})
    clean = F.col("__clean")
    rest = F.when(F.col(out).isNull() & clean.rlike(r"\d{4}|\d[/.\- ]\d") & ~clean.rlike(r"^[\d:. ]*$"), clean)
    return df.withColumn(out, F.coalesce(F.col(out), _residue(dayfirst, yearfirst)(rest).cast("timestamp_ntz"))).drop("__clean")


def _residue(dayfirst: bool, yearfirst: bool):
    importable()

    @F.pandas_udf(T.TimestampType())
    def run(values: pd.Series) -> pd.Series:
        def one(value):
            found = pd.to_datetime(value, errors="coerce", dayfirst=dayfirst, yearfirst=yearfirst)
            return found.tz_localize("UTC") if found is not pd.NaT and found.tzinfo is None else found

        read = {v: one(v) for v in values.dropna().unique()}
        return pd.to_datetime(values.map(lambda v: read.get(v, pd.NaT)), utc=True)

    return run


def in_range(value: Column) -> Column:
    return value.between(F.lit(EARLIEST).cast("timestamp_ntz"), F.lit(LATEST).cast("timestamp_ntz"))
