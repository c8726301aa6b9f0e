"""Exact quantiles and modes by aggregations whose partial results stay small."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketches that narrow a quantile down, and how many of their errors are left on either side.
ACCURACY, MARGIN = 5000, 3

#: Values around a quantile that come to the driver, as (value, count) rows, once it is narrowed down to them.
NEAR = 20_000


@dataclass
class _Search:
    """One rank of one column: it is known to lie between two values, ``below`` values being less than the lower one."""

    name: str
    rank: int
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    inside: int = 0


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float | None]]:
    """Exact quantiles, interpolated, of number columns: {name: (value, shares)} to {name: quantiles}; None without values.

    Each round narrows every rank down by mergeable sketches of the values that may still be it, and counts what lies
    below; a round leaves about one in 800 values. At last the few values around each rank come to the driver. No task
    holds the values of a column. Null and NaN are no values.
    """
    values = {n: F.nanvl(v.cast("double"), F.lit(None).cast("double")) for n, (v, _) in wanted.items()}
    if not values:
        return {}
    named = {n: f"v{i}" for i, n in enumerate(values)}
    rows = df.select(*[v.alias(named[n]) for n, v in values.items()])
    counts = rows.agg(*[F.count(c).alias(c) for c in named.values()]).first()
    sizes = {n: counts[c] for n, c in named.items()}
    places = {n: [q * (sizes[n] - 1) for q in wanted[n][1]] if sizes[n] else [] for n in wanted}
    ranks = sorted({(n, r) for n, ps in places.items() for p in ps for r in (math.floor(p), math.ceil(p))})
    todo = [_Search(n, r, inside=sizes[n]) for n, r in ranks]
    while wide := [s for s in todo if s.inside > NEAR]:
        _narrow(rows, named, wide)
    found = _pick(rows, named, todo)
    out: dict[str, list[float | None]] = {}
    for n, (_, shares) in wanted.items():
        if not sizes[n]:
            out[n] = [None] * len(shares)
            continue
        ends = [(found[n, math.floor(p)], found[n, math.ceil(p)], p - math.floor(p)) for p in places[n]]
        out[n] = [a if a == b else a + (b - a) * part for a, b, part in ends]
    return out


def _between(column: str, s: _Search) -> Column:
    return F.col(column).between(F.lit(s.low), F.lit(s.high)) if s.low > -math.inf or s.high < math.inf else F.col(column).isNotNull()


def _narrow(rows: DataFrame, named: dict[str, str], wide: list[_Search]) -> None:
    """Closer bounds for every rank. Bounds are values of the column; their own runs are told from what lies between, so each round gets on."""
    shares, aggs = [], []
    for i, s in enumerate(wide):
        at = (s.rank - s.below) / max(s.inside - 1, 1)
        ends = (max(0.0, at - MARGIN / ACCURACY), min(1.0, at + MARGIN / ACCURACY))
        shares.append(ends)
        value = F.when(_between(named[s.name], s), F.col(named[s.name]))
        aggs += [F.percentile_approx(value, F.array(*[F.lit(e) for e in ends]), F.lit(ACCURACY)).alias(f"e{i}"), F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}")]
    row = rows.agg(*aggs).first()
    ends = [(row[f"min{i}"] if least == 0.0 else row[f"e{i}"][0], row[f"max{i}"] if most == 1.0 else row[f"e{i}"][1]) for i, (least, most) in enumerate(shares)]
    tests = []
    for i, (s, (low, high)) in enumerate(zip(wide, ends, strict=True)):
        value = F.col(named[s.name])
        counted = (("below", value < F.lit(low)), ("low", value == F.lit(low)), ("inside", value.between(F.lit(low), F.lit(high))), ("high", value == F.lit(high)))
        tests += [F.count_if(test).alias(f"{what}{i}") for what, test in counted]
    row = rows.agg(*tests).first()
    for i, (s, (low, high)) in enumerate(zip(wide, ends, strict=True)):
        below, inside, lows, highs = (row[f"{what}{i}"] for what in ("below", "inside", "low", "high"))
        if not below <= s.rank < below + inside:
            raise ArithmeticError(f"a sketch of {s.name} misses its error bound")
        if s.rank < below + lows:
            s.low, s.high, s.below, s.inside = low, low, below, 1
        elif s.rank >= below + inside - highs:
            s.low, s.high, s.below, s.inside = high, high, below + inside - highs, 1
        else:
            s.low, s.high, s.below, s.inside = math.nextafter(low, math.inf), math.nextafter(high, -math.inf), below + lows, inside - lows - highs


def _pick(rows: DataFrame, named: dict[str, str], todo: list[_Search]) -> dict[tuple[str, int], float]:
    """The value at each rank from counts of the values around it, at most ``NEAR`` a rank."""
    if not todo:
        return {}
    wanted = F.array_compact(F.array(*[F.when(_between(named[s.name], s), F.struct(F.lit(i).alias("i"), F.col(named[s.name]).alias("v"))) for i, s in enumerate(todo)]))
    counted = rows.select(F.explode(wanted).alias("e")).groupBy("e.i", "e.v").agg(F.count(F.lit(1)).alias("n")).collect()
    near: dict[int, list[tuple[float, int]]] = {}
    for r in counted:
        near.setdefault(r["i"], []).append((r["v"], r["n"]))
    out = {}
    for i, s in enumerate(todo):
        before = s.below
        for value, n in sorted(near[i], key=lambda x: (x[0] != x[0], x[0])):
            before += n
            if before > s.rank:
                out[s.name, s.rank] = value
                break
    return out


def modes(df: DataFrame, wanted: dict[str, Column]) -> dict[str, str | None]:
    """The most frequent value of each text column, the least of several; counts are partial sums, no task holds a column's values."""
    if not wanted:
        return {}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in wanted.items()])
    counts = df.select(F.explode(pairs).alias("p")).select("p.name", "p.value").where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
    found = {r["name"]: r["best"]["value"] for r in best.collect()}
    return {n: found.get(n) for n in wanted}
