"""Text steps of standardisation as expressions over one string column."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.missing import stripped
from sluice.session import importable

_NOT_ASCII = r"[^\x00-\x7F]"
_DELETED = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\u200B-\u200F\u2028\u2029\uFEFF\u2060-\u2064]"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfd(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFD", v), na_action="ignore")


def _beyond_ascii(udf, text: Column) -> Column:
    """The function for values beyond ASCII only: others reach it as null and keep their value."""
    importable()
    return F.coalesce(udf(F.when(text.rlike(_NOT_ASCII), text)), text)


def strip_nonprinting(text: Column) -> Column:
    """NFKC, then without control characters (tab and line ends stay) and zero-width characters; odd spaces become spaces."""
    return F.regexp_replace(F.translate(_beyond_ascii(_nfkc, text), "\u00a0\u2009", "  "), _DELETED, "")


def trim(text: Column) -> Column:
    return stripped(text)


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")


def asciify(text: Column) -> Column:
    """Without combining marks, accents included."""
    return F.regexp_replace(_beyond_ascii(_nfd, text), r"\p{Mn}", "")


def title(text: Column) -> Column:
    """Every run of cased letters starts in upper case and goes on in lower case, also after digits and punctuation."""
    parts = F.split(text, r"(?<=[^\p{Lu}\p{Ll}\p{Lt}])")

    def one(part: Column) -> Column:
        first = F.upper(F.substring(part, 1, 1))
        rest = F.lower(F.substr(part, F.lit(2)))
        return F.concat(F.substring(first, 1, 1), F.lower(F.substr(first, F.lit(2))), rest)

    return F.array_join(F.transform(parts, one), "")


def casefold(text: Column, mode: str) -> Column:
    return {"lower": F.lower, "upper": F.upper, "title": title}[mode](text)


#: Up to so many entries a mapping is a literal map; longer ones are joined (``standardize``).
LITERAL_ENTRIES = 1000


def mapped(text: Column, mapping: Mapping[str, str]) -> Column:
    """Each value that is a key becomes its entry, once: entries are not mapped again."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    table = F.create_map(*pairs)
    return F.when(F.map_contains_key(table, text), F.element_at(table, text)).otherwise(text) if mapping else text
