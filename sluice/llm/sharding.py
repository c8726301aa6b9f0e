"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch, Table, utf8_bytes

SHARDS = 40
VIRTUAL_NODES = 64

#: The ring has a power of two of arcs, at least so many for each virtual node; counts and places are planned for arcs.
ARCS_A_NODE = 16

#: Arcs with more rows than this, and four times the mean, are ranked in parts.
ROWS_AT_ONCE = 200_000

#: Parts of such an arc by the bits of id and text, and parts of rows that are equal in both.
ARC_PARTS = 64

#: Added to each text for its record's frame.
FRAME_BYTES = 16


@dataclass(frozen=True)
class Segment:
    """Rows ``low`` to ``high`` (exclusive) of an arc go to a shard, from slot ``slot`` on."""

    arc: int
    low: int
    high: int
    shard: int
    slot: int


def ring_bits(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> int:
    return max(12, (ARCS_A_NODE * shards * virtual_nodes - 1).bit_length())


def _arc(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES, bits: int | None = None) -> list[tuple[int, int]]:
    """(arc, shard) of each virtual node, clockwise. Nodes depend on the shard's number only, so a further shard adds nodes and moves none."""
    bits = bits or ring_bits(shards, virtual_nodes)
    nodes = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("node"))
    nodes = nodes.select(F.xxhash64(F.lit("node"), "shard", "node").alias("hash"), "shard")
    rows = nodes.select(_arc(F.col("hash"), bits).alias("arc"), F.shiftrightunsigned("hash", 1).alias("place"), "shard").collect()  # shards * virtual_nodes rows
    return [(r["arc"], r["shard"]) for r in sorted(rows, key=lambda r: (r["arc"], r["place"], r["shard"]))]


def plan(counts: dict[int, int], nodes: list[tuple[int, int]], capacities: list[int]) -> list[Segment]:
    """Places the rows of each arc, arcs in order: at the next node clockwise, and what finds its shard full at the nodes after it."""
    room, used = list(capacities), [0] * len(capacities)
    after = list(range(len(nodes)))  # the next node of a shard with room, from each node on

    def open_node(at: int) -> int:
        path = []
        while room[nodes[at][1]] == 0 or after[at] != at:
            path.append(at)
            at = after[at] if after[at] != at else (at + 1) % len(nodes)
        for p in path:
            after[p] = at
        return at

    out, first = [], 0
    for arc in sorted(counts):
        while first < len(nodes) and nodes[first][0] < arc:
            first += 1
        low, left = 0, counts[arc]
        while left:
            at = open_node(first % len(nodes))
            shard = nodes[at][1]
            take = min(left, room[shard])
            out.append(Segment(arc, low, low + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
            low += take
            left -= take
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold. Without slack they add up to all rows and differ by one at most."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    slack: float = 0.0,
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot): every document on a shard, slots gapless from 0 in each.

    A document hashes by id to an arc of the ring and belongs to the next virtual node clockwise; where that node's
    shard is full it continues clockwise. Without slack, shards hold numbers of rows that differ by one at most;
    with slack s they hold at most (1 + s) times the mean, and fewer rows move when a shard is added. Arc counts
    (as many as the ring has arcs, however many rows) are planned on the driver. Ranks within an arc follow from id
    and text alone, so places don't depend on how files or partitions are cut; rows equal in both are interchangeable.
    Arcs with very many rows, also of one id, are ranked in parts.

    Null text: no bytes. Null and repeated ids are placed like others. An empty table gives an empty result.
    Texts of any length are hashed whole. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    bits = ring_bits(shards, virtual_nodes)
    text = docs[text_col].cast("string")
    rows = docs.select(
        docs[id_col].alias("id"),
        (utf8_bytes(text) + FRAME_BYTES).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit("key"), docs[id_col].cast("string")).alias("hash"),
        F.xxhash64(F.lit("row"), docs[id_col].cast("string"), text).alias("mark"),
    )
    slim = scratch.save(rows.withColumn("arc", _arc(F.col("hash"), bits)), "rows")
    arcs = scratch.save(slim.read().groupBy("arc").agg(F.count(F.lit(1)).alias("n")), "arcs")
    counts = {r["arc"]: r["n"] for r in arcs.read().collect()}  # at most one row an arc
    total = sum(counts.values())
    segments = plan(counts, ring(spark, shards, virtual_nodes, bits), capacities(total, shards, slack))
    placed = scratch.save_rows(((s.arc, s.low, s.high, s.shard, s.slot) for s in segments), "arc int, low long, high long, shard int, first long", "segments")
    ranked = _ranked(slim, arcs, scratch, max(ROWS_AT_ONCE, 4 * total // max(1, len(counts))))
    # the table of segments has a size fixed by the ring, not by the rows
    found = ranked.join(F.broadcast(placed.read().withColumnRenamed("arc", "of")), F.expr("arc = of and rank >= low and rank < high"))
    return found.select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"))


def _ranked(slim: Table, arcs: Table, scratch: Scratch, most: int) -> DataFrame:
    """The rows with their rank from 0 in their arc. Units are what is sorted at once: arcs, parts of large ones, and parts of their equal rows."""
    order = ("hash", "mark", "id", "text_crc32")
    large = scratch.save(arcs.read().where(F.col("n") > most).select(F.col("arc").alias("large")), "large")
    rows = slim.read()
    if large.read().isEmpty():
        return rows.withColumn("rank", F.row_number().over(W.partitionBy("arc").orderBy(*order)) - 1)
    marked = rows.join(large.fitting(), F.col("arc") == F.col("large"), "left")
    equal = marked.where("large is not null").groupBy("mark").agg(F.count(F.lit(1)).alias("equal")).where(F.col("equal") > most // ARC_PARTS)
    equal = scratch.save(equal.select(F.col("mark").alias("often"), "equal"), "equal")
    marked = marked.join(equal.fitting(), F.col("mark") == F.col("often"), "left")
    part = F.when(F.col("large").isNotNull(), F.pmod(F.col("mark"), F.lit(ARC_PARTS))).otherwise(0)
    # rows equal in id and text may be numbered in any order
    turn = F.when(F.col("often").isNotNull(), 1 + F.floor(F.rand(0) * F.ceil(F.col("equal") * ARC_PARTS / most))).otherwise(0)
    unit = F.struct(part.cast("long").alias("part"), F.coalesce("often", F.lit(0)).alias("often"), turn.cast("long").alias("turn"))
    units = scratch.save(marked.withColumn("unit", unit).drop("large", "often", "equal"), "units").read()
    sums = units.groupBy("arc", "unit").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("arc").orderBy("unit").rowsBetween(W.unboundedPreceding, -1))
    base = scratch.save(sums.select("arc", "unit", F.coalesce(before, F.lit(0)).alias("before")), "base")
    rank = F.row_number().over(W.partitionBy("arc", "unit").orderBy(*order)) - 1
    return units.withColumn("rank", rank).join(base.fitting(), ["arc", "unit"]).withColumn("rank", F.col("rank") + F.col("before"))
