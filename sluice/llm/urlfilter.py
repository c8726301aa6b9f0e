"""URL filter: host and path rules, then a blocked Bloom filter before an exact join with listed URLs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch, ascii_lower

#: A block is eight longs; each listed URL has so many bits of one block, and so many bits of the filter in all.
BLOCK_LONGS = 8
BITS_SET = 8
BITS_A_URL = 12


@dataclass(frozen=True)
class Rule:
    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule(True, "org", "/"),
    Rule(False, "example.org", "/es/"),
    Rule(False, "example.org", "/en/1"),
    Rule(True, "com", "/fr/"),
    Rule(False, "com", "/de/"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for a null URL or one without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_name(hosts: Column, paths: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule whose host is the URL's or a parent domain and whose path starts the URL's; null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((hosts == rule.host) | hosts.endswith(f".{rule.host}")) & paths.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """Scheme-free form: host without www. and default port, path without final slashes, query without tracking fields, no fragment."""
    hosts = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    paths = F.regexp_replace(path(url), r"/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    fields = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"))
    rest = F.array_join(F.array_sort(fields), "&")
    return F.concat(hosts, paths, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))


def _words(key: Column) -> list[Column]:
    """The bits of a URL in its block, as eight longs."""
    second = F.xxhash64(F.lit("bits"), key)
    places = [F.shiftrightunsigned(second, 6 * i + 1).bitwiseAND(63) for i in range(BITS_SET)]
    longs = [F.shiftrightunsigned(second, 49 + i).bitwiseAND(BLOCK_LONGS - 1) for i in range(BITS_SET)]
    out = []
    for w in range(BLOCK_LONGS):
        word = F.lit(0).cast("long")
        for place, long in zip(places, longs, strict=True):
            word = word.bitwiseOR(F.when(long == w, _bit(place)).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks).cast("long"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, w0 to w7): the blocked Bloom filter of column ``key``; blocks without bits have no row."""
    words = listed.select(_block(F.col("key"), blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col("key")))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_LONGS)])


def judge(
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    rules: Sequence[Rule] = RULES,
    bits_a_url: int = BITS_A_URL,
) -> DataFrame:
    """Rows (id, host, path, rule, listed, verdict): one per page.

    The verdict is that of the longest rule that fits; without one, block if the page's canonical URL is listed, else
    allow. A page tests its URL against one block of the Bloom filter; only possible hits are joined with the list,
    which removes false positives. The filter is broadcast if its written size allows, else joined on the block.

    Null URLs and URLs without ``://``: empty host and path, no rule, never listed. Null and repeated ids keep their
    rows; repeated listed URLs count once, null ones not at all. Empty tables give empty results or an empty list.
    Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url")
    keys = listed.select(canonical(listed[listed_col].cast("string")).alias("key"), listed[listed_col].alias("raw"))
    keys = scratch.save(keys.where(F.col("raw").isNotNull() & (F.col("key") != "")).select("key").distinct(), "listed")
    count = keys.read().count()
    blocks = max(1, math.ceil(count * bits_a_url / (64 * BLOCK_LONGS)))
    filled = scratch.save(bloom(keys.read(), blocks), "bloom")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    rows = rows.select("id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("key"))
    rows = rows.withColumn("rule", rule_name(F.col("host"), F.col("path"), rules)).withColumn("of", _block(F.col("key"), blocks))
    tested = rows.join(filled.fitting(), F.col("of") == F.col("block"), "left")
    holds = F.lit(True)
    for i, word in enumerate(_words(F.col("key"))):
        holds = holds & (F.coalesce(f"w{i}", F.lit(0).cast("long")).bitwiseAND(word) == word)
    tested = tested.select("id", "host", "path", "rule", "key", (holds & (F.col("key") != "")).alias("maybe"))
    possible = tested.where("maybe").select("id", "host", "path", "rule", "key")
    exact = possible.join(keys.fitting().withColumnRenamed("key", "have"), F.col("key") == F.col("have"), "left")
    exact = exact.select("id", "host", "path", "rule", F.col("have").isNotNull().alias("listed"))
    others = tested.where("not maybe").select("id", "host", "path", "rule", F.lit(False).alias("listed"))
    allowed = [r.name for r in rules if r.allow]
    verdict = F.when(F.col("rule").isNull(), ~F.col("listed")).otherwise(F.col("rule").isin(allowed))
    return exact.unionByName(others).withColumn("verdict", F.when(verdict, "allow").otherwise("block"))
