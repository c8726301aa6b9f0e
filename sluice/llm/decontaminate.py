"""Benchmark decontamination by winnowed word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import BROADCAST_BYTES, Scratch, Table, ascii_lower

#: Words of a window that counts as contamination, and of the grams that are winnowed.
WINDOW = 13
GRAM = 10

#: The gram of a mark that stands for the document itself and meets one benchmark row of no words.
_SELF = 0

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def match_words(text: Column) -> Column:
    """Words for matching: A-Z lower-cased, runs of ASCII letters, digits and all characters beyond ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), ascii_lower(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, _GAPS, -1), "")


def _at(array: str, start: Column, n: int) -> list[Column]:
    """Elements one by one: a slice would copy the whole array at every place."""
    return [F.get(array, start + i) for i in range(n)]


def _gram(hashes: str, start: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *_at(hashes, start, n))


def _short_gram(hashes: str, start: Column, n: int) -> Column:
    return F.xxhash64(F.lit(-n), *_at(hashes, start, n))


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def _greatest(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def _upto(last: Column, make) -> Column:
    """make(i) for i from 0 to last, nothing if last is negative."""
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), make)


def benchmark_windows(benchmark: DataFrame, scratch: Scratch, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[Table, Table]:
    """Rows (wid, fp, at, n, words): each different window once, its least gram hash and where that gram is; rows (wid, item): the items that have it.

    Items of fewer words than a window are one window, of their own length, with the hash of all their words.
    Items without words have no row. ``wid`` is 128 bits of the window's words, which hold no space.
    """
    items = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item"), match_words(benchmark[text_col]).alias("words"))
    items = items.where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    items = items.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("start"))
    cut = items.select("item", F.slice("words", F.col("start") + 1, window).alias("words"))
    pairs = scratch.save(cut.select(F.unhex(F.md5(F.array_join("words", " ").cast("binary"))).alias("wid"), "item", "words"), "windows-of-items").read()
    unique = pairs.groupBy("wid").agg(F.first("words").alias("words"))
    unique = unique.withColumn("n", F.size("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    grams = F.array(*[_gram("h", F.lit(i), gram) for i in range(window - gram + 1)])
    whole = F.col("n") == window
    unique = unique.withColumn("least", F.when(whole, F.array_min(grams))).withColumn("place", F.when(whole, F.array_position(grams, F.col("least")) - 1))
    fp = F.coalesce("least", *[F.when(F.col("n") == n, _short_gram("h", F.lit(0), n)) for n in range(1, window)])
    windows = scratch.save(unique.select("wid", fp.alias("fp"), F.coalesce("place", F.lit(0)).cast("int").alias("at"), "n", "words"), "windows")
    return windows, scratch.save(pairs.select("wid", "item").distinct(), "items")


def _short_mark(n: int):
    return lambda i: F.struct(_short_gram("h", i, n).alias("fp"), i.alias("pos"))


def _marks(docs: DataFrame, short: list[int], window: int, gram: int) -> DataFrame:
    """Adds marks: array of (fp, pos) with the winnowed grams of the text, all grams of the short lengths, and one mark for the row itself."""
    docs = docs.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("g", _upto(F.size("h") - gram, lambda i: _gram("h", i, gram)))
    width = window - gram + 1
    docs = docs.withColumn("m", _upto(F.size("g") - width, lambda i: _least(_at("g", i, width))))

    def marked(p: Column) -> Column:
        """A gram is marked if it is the least of any window that holds it."""
        return p["fp"] == _greatest(_at("m", p["pos"] - (width - 1), width))

    pairs = F.transform("g", lambda x, at: F.struct(x.alias("fp"), at.alias("pos")))
    marks = [F.array(F.struct(F.lit(_SELF).cast("long").alias("fp"), F.lit(-1).alias("pos"))), F.filter(pairs, marked)]
    marks += [_upto(F.size("h") - n, _short_mark(n)) for n in short]
    return docs.withColumn("marks", F.concat(*marks))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows (row, id, n_words, n_hit, items): for each document its words, those inside occurrences of benchmark windows, and the items.

    Winnowing: of each run of ``window - gram + 1`` neighbouring grams the least hash is marked, in texts and in
    benchmark windows, so every shared run of ``window`` words shares a mark. Marks are joined on the hash and each
    match is extended to the whole window and compared word by word. Windows of a benchmark that is written in at most
    ``broadcast_bytes`` are broadcast, and nothing but matches leaves the scan; beyond that marks are shuffled without
    texts, and only documents with matching marks get their words again.

    Null text: no words. Null and repeated ids: each row counts on its own (``row`` tells them apart). Null item ids
    count as the empty string; equal items count once by id. Empty tables give empty results or no hits.
    Texts of any length are searched whole; a match carries its window's id, and items are looked up once for each
    document and window. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    windows, of = benchmark_windows(benchmark, scratch, item_id_col, item_text_col, window, gram)
    short = sorted(r["n"] for r in windows.read().where(F.col("n") < window).select("n").distinct().collect())  # lengths below a window
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), match_words(docs[text_col]).alias("words"))
    own = spark.range(1).select(F.lit(None).cast("binary").alias("wid"), F.lit(_SELF).cast("long").alias("fp"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("words"))
    table = windows.read().unionByName(own).select("wid", "fp", "at", "n", F.col("words").alias("other"))
    small = windows.bytes() <= broadcast_bytes
    if small:
        # the outer form: for the inner one Spark adds a filter on the array and pushes it, inlined, below the projections that make it
        marked = _marks(rows, short, window, gram).select("row", "id", "words", F.explode_outer("marks").alias("mark"))
        met = marked.join(F.broadcast(table), F.col("mark.fp") == F.col("fp")).select("row", "id", "words", F.col("mark.pos").alias("pos"), "wid", "at", "n", "other")
    else:
        rows = scratch.save(rows, "words").read()
        marked = _marks(rows, short, window, gram).select("row", F.explode_outer("marks").alias("mark")).select("row", "mark.fp", "mark.pos")
        near = scratch.save(marked.join(table, "fp").select("row", "pos", "wid", "at", "n", "other"), "near")
        met = rows.join(near.read(), "row")
    start = F.col("pos") - F.col("at")
    true = (F.col("pos") >= 0) & (F.col("n") > 0) & (start >= 0)
    same = F.forall(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", start + i).eqNullSafe(F.get("other", i)))
    true = F.when(true, same).otherwise(False)
    # no filter here: it would be pushed into the join and keep it from being compiled with the scan
    met = met.select("row", "id", F.size("words").cast("long").alias("n_words"), F.when(true, F.struct(start.alias("start"), F.col("n").alias("n"))).alias("span"), F.when(true, F.col("wid")).alias("wid"))
    grouped = met.groupBy("row", "id").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("wid").alias("wids"))
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))

    def cover(s, x):
        end = x["start"] + x["n"]
        return F.struct((s["sum"] + F.greatest(F.lit(0), end - F.greatest(s["end"], x["start"]))).cast("long").alias("sum"), F.greatest(s["end"], end).alias("end"))

    hit = F.aggregate("spans", state, cover, lambda s: s["sum"])
    found = scratch.save(grouped.select("row", "id", "n_words", hit.alias("n_hit"), "wids"), "found")
    pairs = found.read().where(F.size("wids") > 0).select("row", F.explode("wids").alias("wid")).join(of.fitting(broadcast_bytes), "wid")
    items = scratch.save(pairs.groupBy(F.col("row").alias("in")).agg(F.sort_array(F.collect_set("item")).alias("items")), "items-met")
    joined = found.read().join(items.fitting(), F.col("row") == F.col("in"), "left")
    return joined.select("row", "id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    """The contamination rule over the columns of ``contamination``: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """``contamination`` rows as (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    return found.select(
        "id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``.

    Rows are told apart by a hash of id and text, so repeated ids with other texts are judged on their own.
    """
    names = docs.columns
    key = F.xxhash64(docs[id_col].cast("string"), docs[text_col])
    keyed = docs.select("*", key.alias("__sl_key"))
    found = contamination(keyed, benchmark, "__sl_key", text_col, **options)
    bad = Scratch(docs.sparkSession, "contaminated").save(found.where(contaminated()).select(F.col("id").alias("__sl_bad")).distinct(), "keys")
    return keyed.join(bad.fitting(), F.col("__sl_key") == F.col("__sl_bad"), "left_anti").select(*[F.col(f"`{c}`") for c in names])
