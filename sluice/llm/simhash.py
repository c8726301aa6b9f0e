"""SimHash fingerprints and near-duplicate groups found by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.components import components
from sluice.llm.shared import Scratch, Table
from sluice.session import importable

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
HASH_SEED = 42

#: Fingerprints that are compared with one another in one piece of work; larger buckets are dealt out in blocks.
BLOCK = 1024
_CHUNK = 1 << 15
_LAGS = 32


def fingerprint(text: bytes, n: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of UTF-8 text: A-Z lower-cased, n-word shingles with repeats, XXH64 with seed 42.

    A bit is set if more than half of the shingle hashes have it. A text of fewer words is one
    shingle, a text without words has fingerprint zero.
    """
    found = text.lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(n)), strict=False)) if len(found) >= n else iter([b" ".join(found)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED))
    total, ones = 0, np.zeros(64, np.int64)
    most = max(1, len(found) - n + 1)
    while total < most:
        part = np.fromiter(hashes, np.uint64, min(_CHUNK, most - total))
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py() or b"", n) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (id, fp): the fingerprint of each whole text as a signed long. A null text has no words."""
    importable(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(n), "id long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def segment_plan(n_segments: int, distance: int = MAX_DISTANCE) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment.

    With distance = radius * segments + rest, fingerprints within the distance agree to within
    ``radius`` in one of the first rest + 1 segments or to within radius - 1 in another one.
    """
    radius, rest = divmod(distance, n_segments)
    plan, shift = [], 0
    for i in range(n_segments):
        width = 64 // n_segments + (i >= n_segments - 64 % n_segments)
        own = radius if i <= rest else radius - 1
        if own >= 0:
            plan.append((shift, width, own))
        shift += width
    return plan


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]


def segments_for(rows: int, distance: int = MAX_DISTANCE) -> int:
    """The number of segments with the least probes plus expected chance matches a fingerprint; every number finds all links.

    At most as many segments as bits of distance, so at every size some segment is looked up by a Hamming ball.
    """

    def cost(m: int) -> float:
        plan = segment_plan(m, distance)
        return sum((1 + len(_ball(w, r)) / 2) + rows * (1 + len(_ball(w, r))) / 2**w for _, w, r in plan)

    return min(range(2, max(3, distance + 1)), key=cost)


def _entries(plan: list[tuple[int, int, int]]):
    """Arrow function from (fp) to (key, fp): each fingerprint at home in the table of each segment, and at the larger
    values of its Hamming ball there. Of two segment values only the smaller looks for the larger, so no pair meets twice in a table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, (shift, width, radius) in enumerate(plan):
                value = ((fps.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                keys, owners = [value], [fps]
                for mask in _ball(width, radius):
                    other = value ^ mask
                    larger = other > value
                    keys.append(other[larger])
                    owners.append(fps[larger])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) | (i << 40)), pa.array(np.concatenate(owners))], names=["key", "fp"])

    return run


def _links_in(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the distance in one bucket: a spanning forest, never all pairs."""
    left = np.arange(len(fps))
    us, vs = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            for at in range(0, len(front), 256):
                near = np.bitwise_count(fps[front[at : at + 256], None] ^ fps[None, left]) <= distance
                new = near.any(axis=0) & (parent < 0)
                parent[new] = front[at + near[:, new].argmax(axis=0)]
            hit = parent >= 0
            us.append(fps[left[hit]])
            vs.append(fps[parent[hit]])
            front, left = left[hit], left[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _verify(distance: int):
    """Arrow function over rows (key, i, j, fp) sorted by bucket: rows (u, v) of verified links."""

    def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1)])
        sizes = np.diff(np.r_[starts, len(fps)])
        us, vs = [], []
        for at, size in zip(starts[sizes > _LAGS], sizes[sizes > _LAGS], strict=True):
            u, v = _links_in(np.unique(fps[at : at + size]), distance)
            us.append(u)
            vs.append(v)
        group = np.repeat(np.where(sizes > _LAGS, -1 - np.arange(len(sizes)), np.arange(len(sizes))), sizes)
        small = group >= 0
        group, fps = group[small], fps[small]
        for lag in range(1, min(_LAGS, len(fps))):
            same = np.flatnonzero(group[lag:] == group[:-lag])
            if not len(same):
                break
            near = same[np.bitwise_count(fps[same] ^ fps[same + lag]) <= distance]
            us.append(fps[near])
            vs.append(fps[near + lag])
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *us]), np.concatenate([none, *vs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            keys = np.concatenate([keys, np.stack(cols[:3], axis=1)])
            fps = np.concatenate([fps, cols[3].view(np.uint64)])
            if not len(fps):
                continue
            # the last bucket may go on in the next batch
            open_at = len(fps) - int(np.argmin(np.r_[np.all(keys[::-1] == keys[-1], axis=1), False]))
            u, v = links(keys[:open_at], fps[:open_at]) if open_at else (fps[:0], fps[:0])
            keys, fps = keys[open_at:], fps[open_at:]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
        if len(fps):
            u, v = links(keys, fps)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


def buckets(entries: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Rows (key, i, j, fp). Buckets over the block size are dealt out as pairs of blocks, so no task holds a large bucket."""
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = scratch.save(sizes.where(F.col("n") > block).select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")), "hot")
    dealt = entries.join(hot.fitting(), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    return dealt.withColumn("own", own).select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = MAX_DISTANCE,
    n: int = SHINGLE_WORDS,
    n_segments: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Rows (id, fp, component_id, root): every document with its fingerprint, the smallest id and a fingerprint of its near-duplicate group.

    Documents are linked when their fingerprints differ in at most ``distance`` bits; groups are the connected
    components of these links. Equal fingerprints meet first, so copies cost one row. Different fingerprints meet by
    multi-index hashing: the 64 bits are cut into segments, each fingerprint looks up the small Hamming ball of its
    value in each segment's table, and every match is verified on all 64 bits. Buckets are compared inside Arrow
    functions that return spanning links only, in blocks of a fixed size.

    Null text: no words, fingerprint zero, linked like any other. Null id: the document has a row and links, but
    its id is no candidate for a component id; a group of null ids only has a null component id. Repeated ids give
    repeated rows. An empty table gives an empty result. Texts of any length are hashed whole, in pieces of bounded
    size. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    marked = scratch.save(fingerprints(docs, id_col, text_col, n), "fingerprints")
    reps = scratch.save(marked.read().groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    groups = _link(reps, scratch, distance, n_segments, block)
    return named(marked, reps, groups, scratch)


def named(marked: Table, reps: Table, groups: Table, scratch: Scratch) -> DataFrame:
    """Rows (id, fp, component_id, root) of marked documents, from components (u, v) of their marks."""
    in_group = groups.read().select(F.col("u").alias("fp"), F.col("v").alias("root"))
    in_group = in_group.unionByName(in_group.select(F.col("root").alias("fp"), "root").distinct())
    members = in_group.join(reps.read().select("fp", "rep"), "fp")
    least = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    merged = scratch.save(members.select("fp", "root").join(least, "root"), "merged")
    own = F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("component_id"))
    names = reps.read().join(merged.read(), "fp", "left").select("fp", own.alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return marked.read().join(names, "fp", "left").select("id", "fp", "component_id", "root")


def _link(reps: Table, scratch: Scratch, distance: int, n_segments: int | None, block: int) -> Table:
    spark = reps.spark
    rows = reps.read().count()
    plan = segment_plan(n_segments or segments_for(rows, distance), distance)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / 50_000))
    entries = reps.read().select("fp").repartition(parts, "fp").mapInArrow(_entries(plan), "key long, fp long")
    dealt = buckets(scratch.save(entries, "entries").read(), scratch, block)
    sorted_rows = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "fp")
    return components(spark, sorted_rows.mapInArrow(_verify(distance), "u long, v long"), scratch)


def _with_fingerprint(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py() or b"", n) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["row", "id", "fp"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS, similarity: float | None = None, **options) -> DataFrame:
    """The documents without near-duplicates: one of each group stays, the one with the smallest id.

    Groups are those of fingerprints within the distance, or with ``similarity`` those of documents whose sets of
    shingles have at least that Jaccard similarity (``overlap``): a bound on shared shingles is met by few pairs of
    close fingerprints, and by none that segment tables of 64 bits can find at a bearable size. Columns and types are those of ``docs``. Of several rows with that id one stays (that of the smallest
    fingerprint); a group of null ids keeps one row.
    """
    if similarity is not None:
        from sluice.llm import overlap

        return overlap.keep_one(docs, id_col, text_col, n=n, similarity=similarity, **options)
    return keep_smallest(docs, near_duplicates(docs, id_col, text_col, n=n, **options), _with_fingerprint(n), id_col, text_col)


def keep_smallest(docs: DataFrame, groups: DataFrame, with_mark, id_col: str, text_col: str) -> DataFrame:
    """One document of each group; ``with_mark`` is the Arrow function from (row, id, text) to (row, id, fp)."""
    scratch = Scratch(docs.sparkSession, "keep")
    own = groups.where(F.col("id").eqNullSafe(F.col("component_id")))
    keep = scratch.save(own.groupBy("root").agg(F.min("fp").alias("fp"), F.first("id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "kept")
    plain = keep.read().where("n = 1 and keep_id is not null").select("keep_id")
    kept = docs.join(plain, docs[id_col] == plain["keep_id"], "left_semi")
    odd = keep.read().where("n > 1 or keep_id is null")
    if odd.isEmpty():
        return kept
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    rows = rows.join(odd.select("keep_id").distinct(), rows["id"].eqNullSafe(F.col("keep_id")), "left_semi")
    schema = T.StructType([rows.schema["row"], T.StructField("id", T.LongType()), T.StructField("fp", T.LongType())])
    marked = rows.mapInArrow(with_mark, schema)
    chosen = odd.select("keep_id", F.col("fp").alias("keep_fp"))
    hits = marked.join(chosen, marked["id"].eqNullSafe(F.col("keep_id")) & (marked["fp"] == F.col("keep_fp")))
    return kept.unionByName(hits.groupBy("id", "fp").agg(F.first("row").alias("row")).select("row.*"))
