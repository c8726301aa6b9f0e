"""Near-duplicate groups by shared word shingles: SimHash fingerprints and, for pairs further apart, MinHash bands find
candidates; exact Jaccard similarity links them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import simhash
from sluice.llm.components import components
from sluice.llm.shared import Scratch, Table
from sluice.session import importable

SHINGLE_WORDS = 5
SIMILARITY = 0.8

#: A pair of similarity s shares a band's key with probability s ** ROWS; at 0.8, all BANDS miss 7 in 100,000 pairs.
BANDS = 24
ROWS = 5

_CHUNK = 2048
_RANDOM = np.random.default_rng(simhash.HASH_SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def shingles(text: bytes, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different n-word shingles, words as in ``simhash.fingerprint``."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(found[i:] for i in range(n)), strict=False)) if len(found) >= n else iter([b" ".join(found)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(simhash.HASH_SEED)), np.uint64))


def _mark(hashes: np.ndarray) -> int:
    """A hash of the whole set as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), simhash.HASH_SEED)).view(np.int64))


def band_keys(hashes: np.ndarray, bands: int = BANDS) -> list[int]:
    """A key for each of the first bands of the set's MinHash signature; none for an empty set."""
    if not len(hashes) or not bands:
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        low = np.minimum(low, ((hashes[at : at + _CHUNK, None] ^ _MASKS) * _FACTORS).min(axis=0))
    low = low.reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(low[b].tobytes(), b)).view(np.int64)) for b in range(bands)]


def _marked(n: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [shingles(t.as_py() or b"", n) for t in texts]
            prints = np.fromiter((simhash.fingerprint(t.as_py() or b"", n) for t in texts), np.uint64, batch.num_rows)
            keys = pa.array([band_keys(s, bands) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_mark(s) for s in found], pa.int64()), pa.array(prints.view(np.int64)), keys], names=["id", "fp", "print", "keys"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingles(t.as_py() or b"", n) for t in batch.column(0).slice(at, 512)]
                values = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([_mark(s) for s in found], pa.int64()), values], names=["fp", "shingles"])

    return run


def _links_in(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join what is similar in one bucket, by position: a spanning forest, never all pairs."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner, ends = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes)
    member, alive, values = np.zeros(len(codes), bool), np.ones(len(sets), bool), codes
    out = []
    for first in range(len(sets)):
        front = [first] if alive[first] else []
        alive[first] = False
        while front and alive.any():
            one = front.pop()
            own = codes[ends[one] - sizes[one] : ends[one]]
            member[own] = True
            shared = np.bincount(owner[member[values]], minlength=len(sets))
            member[own] = False
            hit = np.flatnonzero(alive & (shared / (sizes + sizes[one] - shared) >= similarity))
            out += [(int(i), one) for i in hit]
            front += hit.tolist()
            alive[hit] = False
            if 2 * np.count_nonzero(still := alive[owner]) < len(owner):
                values, owner = values[still], owner[still]
    return out


def _verify(similarity: float):
    """Arrow function over rows (key, i, j, fp, shingles) sorted by bucket: rows (u, v) of verified links."""

    def links(fps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(fps[a], fps[b]) for a, b in _links_in(sets, similarity)]

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, sets = None, [], []
        for batch in batches:
            found = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            values, ends = batch.column(4).values.to_numpy().view(np.uint64), batch.column(4).offsets.to_numpy()
            for at, (*key, fp) in enumerate(rows):
                if key != now:
                    found += links(fps, sets)
                    now, fps, sets = key, [], []
                fps.append(fp)
                sets.append(values[ends[at] : ends[at + 1]].copy())
            yield out(found)
        yield out(links(fps, sets))

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    block: int = simhash.BLOCK,
    distance: int = simhash.MAX_DISTANCE,
    bands: int = BANDS,
) -> DataFrame:
    """Rows (id, fp, component_id, root) as those of ``simhash.near_duplicates``; fp is a hash of the set of shingles.

    Documents are linked when the Jaccard similarity of their sets of n-word shingles is at least ``similarity``;
    groups are the connected components. Equal sets meet first. Different ones meet where chains of SimHash fingerprints
    within ``distance`` bits join them, found by multi-index hashing as in ``simhash``, and in the buckets of the first
    ``bands`` bands of their MinHash signatures, since most pairs of that similarity have fingerprints further apart; of
    buckets with the same members one is compared, inside Arrow functions that return spanning links only, in blocks of a
    fixed size. Candidates by bands come with a probability, links are exact.

    Null text: no words; texts without words are one group. Null and repeated ids are as in ``simhash.near_duplicates``.
    """
    spark = docs.sparkSession
    importable(spark)
    scratch = Scratch(spark, "overlap")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    marked = scratch.save(texts.mapInArrow(_marked(n, bands), "id long, fp long, print long, keys array<long>"), "marked")
    reps = scratch.save(marked.read().groupBy("fp").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "reps")
    groups = _link(texts, reps, _print_keys(marked, scratch, distance, block), scratch, n, similarity, block)
    return simhash.named(marked, reps, groups, scratch)


def _print_keys(marked: Table, scratch: Scratch, distance: int, block: int) -> DataFrame:
    """Rows (fp, key): a key for each component of fingerprints within the distance that a set's documents are in."""
    own = marked.read().select("fp", "print").distinct()
    prints = scratch.save(own.select(F.col("print").alias("fp")).distinct(), "prints")
    linked = simhash._link(prints, scratch, distance, None, block).read().select(F.col("u").alias("print"), F.col("v").alias("root"))
    found = own.join(linked, "print", "left")
    return found.select("fp", F.xxhash64(F.lit("print"), F.coalesce("root", "print")).alias("key")).distinct()


def _link(texts: DataFrame, reps: Table, more: DataFrame, scratch: Scratch, n: int, similarity: float, block: int) -> Table:
    spark = reps.spark
    entries = reps.read().select("fp", F.explode("keys").alias("key")).unionByName(scratch.save(more, "print-keys").read())
    # a pair shares most of its bands: of all buckets with the same members one is enough
    same = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum(F.xxhash64("fp", F.lit(1)).bitwiseAND(0xFFFFFFFFFF)).alias("s"))
    chosen = entries.groupBy("key").agg(*same).where("n > 1").groupBy("n", "x", "s").agg(F.min("key").alias("key"))
    chosen = scratch.save(chosen.select("key"), "chosen")
    entries = scratch.save(entries.join(chosen.fitting(), "key", "left_semi").select("key", "fp"), "entries").read()
    needed = scratch.save(reps.read().join(entries.select("fp").distinct(), "fp", "left_semi").select("fp", "rep"), "needed")
    own = texts.join(needed.fitting().select("rep"), F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    sets = own.select("text").mapInArrow(_sets(n), "fp long, shingles array<long>")
    sets = scratch.save(sets.join(needed.fitting().select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "sets").read()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(reps.read().count() / 50_000))
    rows = simhash.buckets(entries, scratch, block).join(sets, "fp").select("key", "i", "j", "fp", "shingles")
    rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return components(spark, rows.mapInArrow(_verify(similarity), "u long, v long"), scratch)


def _with_mark(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([_mark(shingles(t.as_py() or b"", n)) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=["row", "id", "fp"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS, **options) -> DataFrame:
    """The documents without near-duplicates, as ``simhash.keep_one``: one of each group stays, the one with the smallest id."""
    return simhash.keep_smallest(docs, near_duplicates(docs, id_col, text_col, n=n, **options), _with_mark(n), id_col, text_col)
