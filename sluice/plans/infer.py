"""A policy from the data: evidence for each column from one aggregation over a bounded sample, then one decision a column.

Numbers and dates of the sample are read by the parser itself, so a type is given only to columns that it can parse.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions.columns import ROW_ID, col, is_text
from sluice.functions.missing import SAMPLE_TOKENS, stripped
from sluice.operators import parse
from sluice.plans.learning import LearningStore, name_words
from sluice.plans.policy import make_policy

#: Values of each column that are looked at, of these for personal content, and those whose length tells an id.
SAMPLE, CONTENT, SHORT = 200, 50, 20
_PARTS = 32

# Shares of a sample from which a column is taken to be of a kind, and the least sample.
LEAST = {"boolean": 0.80, "number": 0.50, "datetime": 0.40, "format": 0.10, "email": 0.30, "phone": 0.30, "distinct": 0.90}
FEW, LONG_TEXT, ID_CHARS = 5, 20, 50

# Words for yes and no.
YES = ("yes", "y", "true", "t", "1", "on", "active", "enabled", "si", "ja", "oui", "da", "affirmative", "yep", "yeah")
NO = ("no", "n", "false", "f", "0", "off", "inactive", "disabled", "non", "nein", "nah", "nope", "negative")

# Words in column names that mark protected data.
PROTECTED = {
    "persons": ("name", "first name", "last name", "full name", "middle name", "nickname", "surname", "given name"),
    "contacts": ("email", "e mail", "phone", "mobile", "cell", "telephone", "fax", "contact"),
    "documents": ("ssn", "social security", "passport", "driver license", "driver licence", "national id", "tax id"),
    "banking": ("bank", "account", "routing", "iban", "swift", "credit card", "card number"),
    "work": ("emergency", "manager", "supervisor", "department", "job", "position", "role"),
    "health": ("medical", "health", "diagnosis", "diagnoses", "diagnostic", "allergy", "allergies", "allergic", "prescription", "insurance"),
    "free text": ("review", "comment", "note", "memo", "description", "about", "content", "internal", "remark", "feedback"),
    "links": ("link", "url", "img", "image", "photo", "avatar", "website", "user id"),
}
# Parts of names of ids, of postal codes, of measures, of money and of cities.
PARTS = {
    "id": ("_id", "id", "code", "key", "ref"),
    "postal": ("zip", "postal", "cep"),
    "measure": ("pay", "wage", "salary", "amount", "price", "cost", "total", "date", "created", "updated", "time", "at", "on"),
    "money": ("price", "cost", "amount", "pay", "wage", "salary"),
    "city": ("city", "municipio", "town", "suburb"),
}

#: What a store need not learn: the words that inference knows anyway.
BUILTIN = (*(("yes", w) for w in YES), *(("no", w) for w in NO))

EMAIL = r"[^@\s]+@[^@\s]+\.[^@\s.]{2,}"
PHONE = r"\+?\(?\d(?:[\s().-]{0,2}\d){7,14}"

#: What a field of a date format may hold; formats are the parser's orders of fields with each separator.
_FIELDS = {"%Y": r"\d{4}", "%y": r"\d{2}", "%m": "(?:0?[1-9]|1[0-2])", "%d": r"(?:0?[1-9]|[12]\d|3[01])", "%b": "[A-Za-z]{3}", "%B": "[A-Za-z]{3,}"}
_ORDERS = (("%Y", "%m", "%d"), ("%m", "%d", "%Y"), ("%d", "%m", "%Y"))
FORMATS = (*(mark.join(order) for order in _ORDERS for mark in "-/."), "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d-%b-%y")
#: Formats that every inferred policy accepts.
ALWAYS = ("%Y-%m-%d", "%m/%d/%Y")


def format_pattern(form: str) -> str:
    """A regular expression for the values of a date format."""
    return "".join(_FIELDS.get(piece, re.escape(piece)) for piece in re.findall("%.|.", form))


def named(name: str, part: str) -> bool:
    return any(p in name.lower() for p in PARTS[part])


def protected_name(name: str, learned: Sequence[str] = ()) -> bool:
    """Whether words of the name, alone or side by side, are on the list; two words also match when written as one."""
    words = name_words(name)
    flat = f" {' '.join(words)} "
    listed = (*(p for group in PROTECTED.values() for p in group), *learned)
    return any(f" {p} " in flat or p.replace(" ", "") in words for p in listed)


def samples(df: DataFrame, names: list[str], size: int = SAMPLE) -> DataFrame:
    """Rows (column, r, v): up to ``size`` present values of each column, those of the least row ids where the table has them.

    The first values of each salted part come first, so that a column is no single group.
    """
    tokens = F.array(*[F.lit(t) for t in SAMPLE_TOKENS])
    order = col(ROW_ID) if ROW_ID in df.columns else F.monotonically_increasing_id()
    cells = F.array(*[F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("v")) for n in names])
    long = df.select(order.alias("o"), F.explode(cells).alias("c")).select("o", "c.column", "c.v")
    rows = long.where(F.col("v").isNotNull() & ~F.array_contains(tokens, F.lower(F.trim("v")))).withColumn("part", F.pmod(F.xxhash64("o"), F.lit(_PARTS)))
    for keys in (["column", "part"], ["column"]):
        rows = rows.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("o"))).where(F.col("r") <= size)
    return rows.select("column", "r", "v")


def _whole(value: Column, pattern: str) -> Column:
    return stripped(value).rlike(f"^(?:{pattern})$")


def evidence(taken: DataFrame, yes: Sequence[str] = YES, no: Sequence[str] = NO, marks: Sequence[str] = ("R$",)) -> dict[str, dict[str, Any]]:
    """What the sample of each column shows: counts and shares, as one row a column on the driver."""
    rules = make_policy({"parsing": {"column_types": {"v": "float"}, "currency_symbols": list(marks), "datetime": {"allowed_formats": list(FORMATS)}}})
    read = parse.with_datetime(parse.with_number(taken, "v", rules), "v", rules)
    value, word = F.col("v"), F.lower(stripped(F.col("v")))
    first = F.col("r") <= CONTENT
    share = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("double"))
    found = read.groupBy("column").agg(
        *(F.count(F.lit(1)).alias("n"), share(F.col("__number").isNotNull()).alias("number"), share(F.col("__time").isNotNull() & value.rlike(r"\d")).alias("datetime")),
        *(share(word.isin(*yes, *no)).alias("boolean"), F.sort_array(F.collect_set(F.when(word.isin(*yes), word))).alias("yes"), F.sort_array(F.collect_set(F.when(word.isin(*no), word))).alias("no")),
        *(F.avg(F.when(first, _whole(value, p).cast("double"))).alias(k) for k, p in (("email", EMAIL), ("phone", PHONE))),
        *(F.avg(F.length(value)).alias("length"), F.max(F.when(F.col("r") <= SHORT, F.length(value))).alias("longest")),
        F.array(*[F.struct(F.lit(f).alias("format"), share(_whole(value, format_pattern(f))).alias("share")) for f in FORMATS]).alias("formats"),
        F.array(*[F.struct(F.lit(m).alias("mark"), F.max(value.contains(m)).alias("seen")) for m in marks]).alias("marks"),
    )
    return {r["column"]: r.asDict(recursive=True) for r in found.collect()}


def distinct_shares(df: DataFrame, names: list[str]) -> dict[str, float]:
    """Distinct values a row of each text column, by sketches in one aggregation."""
    texts = [n for n in names if is_text(df.schema[n].dataType)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.approx_count_distinct(col(n), 0.01).alias(f"d{i}") for i, n in enumerate(texts)]).first()
    return {n: row[f"d{i}"] / max(row["rows"], 1) for i, n in enumerate(texts)}


def is_id(name: str, distinct: float | None, longest: int | None) -> bool:
    """By name, or a text column of short values of which over nine tenths differ."""
    if named(name, "postal"):
        return False
    by_value = distinct is not None and distinct > LEAST["distinct"] and (longest or 0) < ID_CHARS and not named(name, "measure")
    return named(name, "id") or by_value


def kind_of(name: str, seen: dict[str, Any] | None, distinct: float | None) -> str:
    """The first kind that the evidence supports."""
    if seen is None or seen["n"] < FEW:
        return "few"
    tests = (
        ("id", is_id(name, distinct, seen["longest"])),
        ("boolean", bool(seen["yes"] and seen["no"]) and seen["boolean"] >= LEAST["boolean"]),
        ("postal", named(name, "postal")),
        *((k, seen[k] >= LEAST[k]) for k in ("number", "datetime", "email", "phone")),
        ("long", seen["length"] > LONG_TEXT),
    )
    return next((k for k, holds in tests if holds), "plain")


#: The parsed type of each kind that has one.
TYPE_OF = {"boolean": "boolean", "postal": "text", "number": "float", "datetime": "datetime"}


def infer_policy(df: DataFrame, name: str = "auto", store: LearningStore | None = None) -> dict[str, Any]:
    """A policy mapping that ``make_policy`` accepts. Facts of a store come before the evidence."""
    known = (lambda kind: store.known(kind)) if store else (lambda kind: [])
    names = [c for c in df.columns if c != ROW_ID]
    marks = tuple(dict.fromkeys(("R$", *known("mark"))))
    seen = evidence(samples(df, names), (*YES, *known("yes")), (*NO, *known("no")), marks) if names else {}
    distinct = distinct_shares(df, names) if names else {}
    kinds = {c: kind_of(c, seen.get(c), distinct.get(c)) for c in names}
    marked = {c for c in names if protected_name(c, known("protected_word"))}
    ids = {c for c, k in kinds.items() if k == "id" or k == "few" and is_id(c, None, None)}
    private = {c for c, k in kinds.items() if k in ("email", "phone", "long")}
    dates = [c for c, k in kinds.items() if k == "datetime"]
    formats = [f["format"] for c in dates for f in seen[c]["formats"] if f["share"] >= LEAST["format"]]
    numbers = [c for c, k in kinds.items() if k == "number"]
    fills = {"numeric": "median", "categorical": "constant", "datetime": "none"} | (store.mapping("fill") if store else {})
    found: dict[str, Any] = {
        "dataset": {"name": name},
        "roles": {
            "critical_columns": sorted({c for c, k in kinds.items() if k == "id"} | ({ROW_ID} & set(df.columns))),
            "protected_columns": sorted((marked - set(dates)) | ids | private),
        },
        "standardization": {"asciify": True, "casefold": "title" if any(named(c, "city") for c in names) else "none"},
        "parsing": {
            "column_types": {c: TYPE_OF[k] for c, k in kinds.items() if k in TYPE_OF},
            "currency_symbols": [m for m in marks if any(x["mark"] == m and x["seen"] for c in numbers for x in seen[c]["marks"])],
            "boolean_columns": {c: {"true_values": seen[c]["yes"], "false_values": seen[c]["no"]} for c, k in kinds.items() if k == "boolean"},
            "datetime": {"allowed_formats": list(dict.fromkeys([*formats, *ALWAYS])) if dates else []},
        },
        "missing_data": {"imputation": {bucket: {"default": strategy} for bucket, strategy in fills.items()}},
    }
    regexes = {c: f"^{EMAIL}$" for c, k in kinds.items() if k == "email"}
    ranges = {c: {"min": 0} for c in numbers if named(c, "money")}
    if regexes or ranges:
        found["validity_rules"] = {"regex": regexes, "ranges": ranges, "on_violation": "flag" if regexes else "null"}
    return found
