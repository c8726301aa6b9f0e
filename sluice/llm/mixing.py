"""Mixing sources to target weights: temperature from a target, then budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch

#: A document is used at most so many times, as a mean over its source.
MAX_REPEATS = 4.0

#: Blocks of the mixture; each has every source in its weight.
BLOCKS = 64

#: Parts of each source's permutation, and of each block's order; running sums and ranks are taken within parts.
PARTS = 256

#: Up to so many sources the bisection runs on the driver; beyond, each of its steps is an aggregation of the sources' totals.
LOCAL_SOURCES = 100_000

#: Bits of a random place.
PLACE_BITS = 60

_STEPS = 60
_GRID = 31
_MOST_EXPONENT = 2.0**40


def weights(tokens: Mapping[str, int], exponent: float) -> dict[str, float]:
    """Shares to the power of the exponent, normalised. Sources without tokens have weight zero."""
    whole = sum(tokens.values())
    base = max(tokens.values(), default=0) if exponent > 1 else whole  # high powers of shares would all vanish
    raw = {s: (t / base) ** exponent if t else 0.0 for s, t in sorted(tokens.items())} if whole else {}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def entropy(shares: Mapping[str, float]) -> float:
    return -sum(w * math.log(w) for w in shares.values() if w > 0)


def repeats(tokens: Mapping[str, int], shares: Mapping[str, float], budget: float) -> float:
    """The largest number of times that any source's tokens are used."""
    return max((shares[s] * budget / t for s, t in tokens.items() if t), default=0.0)


Measures = list[tuple[float, float]]


def _search(measure: Callable[[list[float]], Measures], max_repeats: float | None, target_entropy: float | None, points: int = 1) -> float:
    """The exponent, by bisection (or by grids of several points a step); ``measure`` gives (entropy, most repeats) for each exponent."""

    def fits(exponents: list[float]) -> list[bool]:
        return [e <= target_entropy if target_entropy is not None else r <= max_repeats for e, r in measure(exponents)]

    if target_entropy is None and max_repeats is None:
        return 1.0
    if fits([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    if target_entropy is None and measure([1.0])[0][1] > max_repeats * (1 + 1e-9):
        raise ValueError(f"the budget repeats sources over {max_repeats} times in every mixture")
    while target_entropy is not None and not fits([high])[0]:
        low, high = high, 2 * high
        if high > _MOST_EXPONENT:
            raise ValueError(f"no mixture has an entropy as low as {target_entropy}")
    for _ in range(math.ceil(_STEPS / math.log2(points + 1))):
        middle = [low + (high - low) * k / (points + 1) for k in range(1, points + 1)]
        first = next((k for k, fit in enumerate(fits(middle)) if fit), points)
        ends = [low, *middle, high]
        low, high = ends[first], ends[first + 1]
    return high


def exponent_for(tokens: Mapping[str, int], budget: float, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None) -> float:
    """The exponent, by bisection: in [0, 1], or above if the target entropy is below that of the shares.

    With a target entropy: where the mixture has it (entropy falls as the exponent grows). Else: the least exponent,
    the flattest mixture, whose repetition keeps the limit. With neither: 1, the shares as they are.
    """

    def measure(exponents: list[float]) -> Measures:
        found = [weights(tokens, x) for x in exponents]
        return [(entropy(w), repeats(tokens, w, budget)) for w in found]

    return _search(measure, max_repeats, target_entropy)


def exponent_over(sources: DataFrame, budget: float, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None) -> float:
    """``exponent_for`` over rows (source, tokens) that stay on the executors: a step needs three sums of all sources."""
    total = sources.where("tokens > 0").agg(F.sum("tokens").alias("whole"), F.max("tokens").alias("most")).first()

    def measure(exponents: list[float]) -> Measures:
        aggs = []
        for i, x in enumerate(exponents):
            power = F.log(F.col("tokens") / F.lit(float(total["most"] if x > 1 else total["whole"]))) * F.lit(x)
            aggs += [F.sum(F.exp(power)).alias(f"z{i}"), F.sum(F.exp(power) * power).alias(f"e{i}"), F.max(F.exp(power) / F.col("tokens")).alias(f"r{i}")]
        row = sources.where("tokens > 0").agg(*aggs).first()
        return [(math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"], row[f"r{i}"] * budget / row[f"z{i}"]) for i in range(len(exponents))]

    return _search(measure, max_repeats, target_entropy, _GRID) if total["whole"] else 1.0


def plan(sources: DataFrame, budget: float | None = None, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None) -> DataFrame:
    """Rows (source, tokens, weight, repeats) from rows (source, tokens). Sources without tokens have no part in the mixture."""
    total = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("whole"), F.max("tokens").alias("most")).first()
    whole = total["whole"]
    budget = whole if budget is None else budget
    if not whole:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("repeats"))
    if total["n"] <= LOCAL_SOURCES:
        exponent = exponent_for({r["source"]: r["tokens"] for r in sources.collect()}, budget, max_repeats, target_entropy)
    else:
        exponent = exponent_over(sources, budget, max_repeats, target_entropy)
    base = float(total["most"] if exponent > 1 else whole)
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(base), F.lit(exponent))).otherwise(0.0)
    norm = sources.agg(F.sum(raw)).first()[0]
    weight = raw / F.lit(norm)
    # rounded, so that a source at its limit is not over it by the last bit of a sum
    uses = F.round(weight * F.lit(float(budget)) / F.col("tokens"), 9)
    return sources.select("source", "tokens", weight.alias("weight"), F.when(F.col("tokens") > 0, uses).otherwise(0.0).alias("repeats"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _source(docs: DataFrame, source_col: str) -> Column:
    return F.coalesce(docs[source_col].cast("string"), F.lit(""))


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What a row's places follow from; rows equal in id and text share it."""
    parts = [F.coalesce(docs[c].cast("string"), F.lit("")) for c in (id_col, text_col)]
    return F.md5(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary"))


def _drawn(what: str, key: Column, seed: int, turn: Column) -> Column:
    """A number of ``PLACE_BITS`` bits drawn for a key and a turn, by a hash that other engines have too."""
    text = F.concat(F.lit(f"{what}:{seed}:"), turn.cast("string"), F.lit(":"), key)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long")


def _place(key: Column, seed: int, turn: Column) -> Column:
    """A row's place in the permutation of one turn through its source, drawn anew for every turn."""
    return _drawn("place", key, seed, turn)


def _rank_key(key: Column, seed: int, turn: Column) -> Column:
    """A copy's place in its block, among all sources."""
    return _drawn("order", key, seed, turn)


def _part(place: Column) -> Column:
    return F.shiftright(place, PLACE_BITS - int(math.log2(PARTS))).cast("int")


def _turns() -> Column:
    """Turns through a source, from 0; the last one may be cut short. There is always one, so that no row is lost."""
    return F.sequence(F.lit(0), F.greatest(F.ceil("repeats").cast("int") - 1, F.lit(0)))


def _copies(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str, tokens: Column | None, budget, max_repeats, target_entropy, blocks: int, seed: int) -> DataFrame:
    """Rows (id, source, n_tokens, key, weight, turn, place, block): every document once for each turn through its source; block is null beyond the budget.

    Offsets are running sums of tokens in the order of places, taken within parts; those of parts come from the small table
    of their sums.
    """
    count = word_count(docs[text_col]) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    rows = scratch.save(docs.select(docs[id_col].alias("id"), _source(docs, source_col).alias("source"), count.alias("n_tokens"), _key(docs, id_col, text_col).alias("key")), "rows").read()
    sources = scratch.save(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources").read()
    table = scratch.save(plan(sources, budget, max_repeats, target_entropy), "shares")
    turned = rows.join(table.fitting(), "source").withColumn("turn", F.explode(_turns()))
    turned = turned.withColumn("place", _place(F.col("key"), seed, F.col("turn"))).withColumn("part", _part(F.col("place")))
    turned = scratch.save(turned, "turns").read()
    keys = ["source", "turn", "part"]
    sums = turned.groupBy(*keys).agg(F.sum("n_tokens").alias("sum"))
    before = F.sum("sum").over(W.partitionBy("source", "turn").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = scratch.save(sums.select(*keys, F.coalesce(before, F.lit(0)).alias("base")), "base")
    upto = F.sum("n_tokens").over(W.partitionBy(*keys).orderBy("place").rangeBetween(W.unboundedPreceding, -1))
    placed = turned.withColumn("upto", F.coalesce(upto, F.lit(0))).join(base.fitting(), keys)
    share = F.col("turn") + F.when(F.col("tokens") > 0, (F.col("base") + F.col("upto")) / F.col("tokens")).otherwise(0.0)
    block = F.when(share < F.col("repeats"), F.least(F.lit(blocks - 1), F.floor(share / F.col("repeats") * blocks).cast("int")))
    return placed.select("id", "source", "n_tokens", "key", "weight", "turn", "place", block.alias("block"))


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokens: Column | None = None,
    budget: float | None = None,
    max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None,
    blocks: int = BLOCKS,
    seed: int = 0,
) -> DataFrame:
    """Rows (id, source, n_tokens, weight, copy, block, position): every copy of a document in the mixture with its place there.

    Sources weigh as their token shares to an exponent, found by bisection for a target entropy or for a repetition
    limit. A source of weight w and T tokens fills w * budget tokens: turns through all of its documents, each in a new
    random order, the last until its budget is used. The mixture is cut into blocks of equal budget, in which every
    source has its weight: a copy's block is its share of the source's budget that went before. Within a block, copies
    of all sources are permuted; ``position`` counts them from 0. A document that the mixture leaves out has one row
    without copy, block and position, so that every document has a row.

    Tokens are words unless a column is given; the budget defaults to all tokens. Null sources are one source, the
    empty string. Null text has no tokens; it is taken with its place. Sources without tokens have weight 0 and
    are left out. Rows equal in id and text share their places: they are taken together, and their positions may be
    exchanged. An empty table gives an empty result. Only the four columns are read, texts of any length whole.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    copies = _copies(docs, scratch, id_col, text_col, source_col, tokens, budget, max_repeats, target_entropy, blocks, seed)
    order = _rank_key(F.col("key"), seed, F.col("turn"))
    copies = scratch.save(copies.where("block is not null or turn = 0").withColumn("order", order).withColumn("part", _part(order)), "copies").read()
    taken = copies.where("block is not null")
    sums = taken.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("block").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = scratch.save(sums.select("block", "part", F.coalesce(before, F.lit(0)).alias("base")), "block-base")
    rank = F.row_number().over(W.partitionBy("block", "part").orderBy("order", "source", "id", "turn")) - 1
    ranked = taken.withColumn("rank", rank).join(base.fitting(), ["block", "part"])
    found = ranked.select("id", "source", "n_tokens", "weight", F.col("turn").alias("copy"), "block", (F.col("base") + F.col("rank")).alias("position"))
    out = copies.where("block is null").select("id", "source", "n_tokens", "weight", *[F.lit(None).cast(k).alias(n) for n, k in (("copy", "int"), ("block", "int"), ("position", "long"))])
    return found.unionByName(out)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokens: Column | None = None,
    budget: float | None = None,
    max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None,
    blocks: int = BLOCKS,
    seed: int = 0,
) -> DataFrame:
    """The mixture itself: the copies of ``mixture`` with the columns of ``docs``, sorted by block and place in the block.

    Blocks are where a source's permutation passes certain places; those are a small table of one row for each source
    and turn, so texts meet it by broadcast and are shuffled once, by range, into their order. Odd rows are as in ``mixture``.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    copies = _copies(docs, scratch, id_col, text_col, source_col, tokens, budget, max_repeats, target_entropy, blocks, seed)
    starts = copies.where("block is not null").groupBy("source", "turn", "block").agg(F.min("place").alias("from"), F.max("place").alias("until"))
    starts = starts.groupBy("source", "turn").agg(F.sort_array(F.collect_list(F.struct("from", "block"))).alias("starts"), F.max("until").alias("until"))
    table = starts.groupBy(F.col("source").alias("__sl_source")).agg(F.collect_list(F.struct("turn", "starts", "until")).alias("__sl_turns"))
    table = scratch.save(table, "starts")
    names = docs.columns
    keyed = docs.select("*", _source(docs, source_col).alias("__sl_of"), _key(docs, id_col, text_col).alias("__sl_key"))
    joined = keyed.join(table.fitting(), F.col("__sl_of") == F.col("__sl_source")).withColumn("__sl_turn", F.explode("__sl_turns"))
    joined = joined.withColumn("__sl_place", _place(F.col("__sl_key"), seed, F.col("__sl_turn.turn"))).where("__sl_place <= __sl_turn.until")
    passed = F.filter("__sl_turn.starts", lambda s: s["from"] <= F.col("__sl_place"))
    joined = joined.withColumns({"__sl_block": F.element_at(passed, -1)["block"], "__sl_order": _rank_key(F.col("__sl_key"), seed, F.col("__sl_turn.turn"))})
    return joined.repartitionByRange("__sl_block", "__sl_order").sortWithinPartitions("__sl_block", "__sl_order", "__sl_of").select(*[F.col(f"`{c}`") for c in names])
