"""WARC archives: writing with revisit records, and reading in splits with boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch
from sluice.session import importable

#: Payloads from this size on are written once; later equal ones become revisit records.
REVISIT_BYTES = 1000

#: What every record starts with; the reader cuts files at each of these, also inside payloads.
MAGIC = "WARC/1."
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*$")
_VERSION = re.compile(rb"^[01]\r\n")


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id, F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends inside a value are encoded."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes one record for each row to WARC files below ``path``, one file a task.

    Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, those with the largest id are response records
    (all of them, if that id repeats), the others are revisit records that refer to it by digest and id. Payloads are
    not shuffled: digests are, and the groups with several rows come back to the rows by broadcast if they are few.

    Null payload: empty. Null URL: no target field. Null id: no id field; it is never the largest. An empty table
    writes no record.
    """
    scratch = Scratch(pages.sparkSession, "warc-write")
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    large = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    groups = scratch.save(large.where("rows > 1 and first is not null").select(F.col("digest").alias("of"), "first"), "groups")
    rows = rows.join(groups.fitting(), F.col("digest") == F.col("of"), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("first"))), F.lit(False))
    rows = rows.withColumn("revisit", revisit)
    id_text = F.col("id").cast("string")
    head = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(_name(id_text), F.lit("<urn:page:none>"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Page-ID", id_text),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("n").cast("string")),
        F.when(F.col("revisit"), F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _name(F.col("first").cast("string"))))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
    )
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload").cast("string"))
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", END).text(path)


def parse_head(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields (lower-case names) of what follows the magic, and the header's bytes; None if it is no WARC header."""
    if not _VERSION.match(piece):
        return None
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[3:end].split(b"\r\n"):
        found = _FIELD.match(line)
        if not found:
            return None
        fields[found[1].decode("ascii").lower()] = found[2].decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


_PIECES = "file string, block long, file_size long, rel long, size long, reach long, id long, type string, refers_to long, said string, n long, digest string"


def _page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _describe(piece: bytes) -> tuple:
    """reach (bytes from the magic to the successor; None if no record can start here), fields, payload length and digest if the record is whole in the piece."""
    found = parse_head(piece)
    if found is None:
        return (None,) * 7
    fields, head = found
    length = int(fields["content-length"])
    whole = head + length + 4 == len(piece) and piece.endswith(b"\r\n\r\n")
    kind, said = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    page = fields.get("warc-page-id", "")
    n = digest = None
    if kind == "revisit":
        declared = fields.get("warc-payload-length", "")
        n, digest = int(declared) if declared.isdigit() else None, said
    elif whole:
        n, digest = length, hashlib.sha1(piece[head : head + length]).hexdigest()
    reach = len(MAGIC) + head + length + 4
    return reach, int(page) if re.fullmatch(r"-?\d+", page) else None, kind, _page_of(fields.get("warc-refers-to")), said, n, digest


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each piece in reading order; rel counts bytes from the first piece of the same file and split."""
    names = [f.split()[0] for f in _PIECES.split(", ")]
    at, rel = None, 0
    for batch in batches:
        files, blocks, sizes = (batch.column(i).to_pylist() for i in (1, 2, 3))
        out: list[list] = [[] for _ in names]
        for i, (file, block, file_size) in enumerate(zip(files, blocks, sizes, strict=True)):
            piece = batch.column(0)[i].as_py()
            if (file, block) != at:
                at, rel = (file, block), 0
            for column, value in zip(out, (file, block, file_size, rel, len(piece), *_describe(piece)), strict=True):
                column.append(value)
            rel += len(piece) + len(MAGIC)
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in _PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, rel = None, 0
    for batch in batches:
        places, values = [], batch.column(0)
        for file, block, piece in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), values, strict=True):
            if (file, block) != at:
                at, rel = (file, block), 0
            places.append(rel)
            rel += len(piece.as_buffer()) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(places, pa.int64()), values], names=["file", "block", "rel", "piece"])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    importable(spark)
    rows = spark.read.option("lineSep", MAGIC).text(path)
    meta = [F.col(f"_metadata.{m}").alias(n) for m, n in (("file_path", "file"), ("file_block_start", "block"), ("file_size", "file_size"))]
    return rows.select(F.col("value").cast("binary").alias("piece"), *meta)


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split first leaves the split."""
    rows = rows.sort_values("start", ascending=False)
    exits: dict[int, int] = {}
    for start, nxt in zip(rows["start"], rows["next"], strict=True):
        exits[start] = exits.get(nxt, nxt)
    rows["exit"] = [exits[s] for s in rows["start"]]
    return rows[["file", "block", "start", "exit"]]


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split on the chain from its entry."""
    rows = rows.sort_values("start")
    want, keep = int(rows["entry"].iloc[0]), []
    for start, nxt in zip(rows["start"], rows["next"], strict=True):
        keep.append(start == want)
        if start == want:
            want = nxt
    return rows.loc[keep, ["file", "start", "next"]]


def _reached(spark: SparkSession, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries (file, entry) that the chain from the file's start reaches, by pointer jumping over the splits' exits."""
    exits = scratch.save(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, block long, start long, exit long"), "exits").read()
    entries = exits.select("file", F.col("exit").alias("start")).distinct().unionByName(exits.select("file", F.lit(0).cast("long").alias("start")).distinct()).distinct()
    jump = scratch.save(exits.join(entries, ["file", "start"], "left_semi").select("file", "start", "exit"), "jump").read()
    reached = scratch.save(exits.where("start = 0").select("file", F.col("start").alias("entry")).distinct(), "reached").read()
    count = reached.count()
    while True:
        step = reached.join(jump, (reached["file"] == jump["file"]) & (reached["entry"] == jump["start"])).select(reached["file"], jump["exit"].alias("entry"))
        reached = scratch.save(reached.unionByName(step).distinct(), "reached").read()
        now = reached.count()
        if now == count:
            return reached
        count = now
        then = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("far"))
        jump = scratch.save(jump.join(then, ["file", "exit"], "left").select("file", "start", F.coalesce("far", "exit").alias("exit")), "jump").read()


def _index(spark: SparkSession, path: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pieces with their magic's offset ``start``; those that start a record, with ``next``)."""
    found = scratch.save(_pieces(spark, path).mapInArrow(_scan, _PIECES), "pieces").read()
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))
    placed = found.join(blocks, ["file", "block"]).withColumn("start", F.col("base") + F.col("rel") - len(MAGIC))
    placed = scratch.save(placed.where("start >= 0"), "placed").read()
    candidates = placed.where("reach is not null").select("file", "block", "start", (F.col("start") + F.col("reach")).alias("next"))
    reached = _reached(spark, candidates, scratch)
    # a split has one entry at most: the first reached place in it
    entered = candidates.join(reached, (candidates["file"] == reached["file"]) & (candidates["start"] == reached["entry"])).select(candidates["file"], candidates["block"], "entry")
    entered = entered.groupBy("file", "block").agg(F.min("entry").alias("entry"))
    chain = candidates.join(entered, ["file", "block"]).groupBy("file", "block").applyInPandas(_walk, "file string, start long, next long")
    chain = scratch.save(chain, "chain").read()
    return placed, chain


def read_archives(spark: SparkSession, path: str, with_payload: bool = False, strict: bool = True) -> DataFrame:
    """Rows (id, record_type, refers_to, payload_bytes, payload_digest, intact[, payload]): one for each record.

    Files are read in splits and cut at every record magic. Each piece with a header is a candidate with the offset of
    its successor; chains are followed within a split, and pointer jumping over the splits from the start of each file
    keeps the reachable records, so magic and whole records inside payloads are payload. Records whose payload holds
    magic, or all if the payload is asked for, are put together from their pieces in a second scan.

    intact: a response's payload has the digest that its header states. With ``strict``, a file whose chain does not
    end at its last byte is an error; otherwise its reachable whole records are returned. Files are uncompressed.
    """
    scratch = Scratch(spark, "warc-read")
    placed, chain = _index(spark, path, scratch)
    if strict:
        ends = chain.groupBy("file").agg(F.max("next").alias("end"))
        sizes = placed.groupBy("file").agg(F.max("file_size").alias("file_size"))
        broken = sizes.join(ends, "file", "left").where("end is null or end <> file_size").limit(3).collect()
        if broken:
            raise ValueError(f"archives whose records do not reach the file's end: {[r['file'] for r in broken]}")
    records = placed.join(chain, ["file", "start"]).where("next <= file_size")
    out = ["id", F.col("type").alias("record_type"), "refers_to", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), ((F.col("type") == "revisit") | (F.col("digest") == F.col("said"))).alias("intact")]
    none = [F.lit(None).cast("binary").alias("payload")] if with_payload else []
    split = records.where("digest is null" if not with_payload else "type <> 'revisit'")
    rest = records.where("digest is not null" if not with_payload else "type = 'revisit'").select(*out, *none)
    if split.isEmpty():
        return rest
    # pieces of the records that are to be put together, by the last record start before each piece
    starts = chain.select("file", "start", F.col("start").alias("begun"))
    owned = scratch.save(placed.join(starts, ["file", "start"], "left").select("file", "block", "rel", "start", "begun"), "begun").read()
    # a split's first pieces belong to the last record that began in a split before it; there is one row a split
    last = owned.groupBy("file", "block").agg(F.max("begun").alias("last"))
    earlier = F.max("last").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    earlier = last.select("file", "block", earlier.alias("earlier"))
    here = F.max("begun").over(W.partitionBy("file", "block").orderBy("start").rowsBetween(W.unboundedPreceding, 0))
    owned = owned.join(earlier, ["file", "block"]).select("file", "block", "rel", "start", F.coalesce(here, "earlier").alias("owner"))
    keys = split.select("file", F.col("start").alias("owner"))
    needed = scratch.save(owned.join(keys, ["file", "owner"]), "needed")
    raw = _pieces(spark, path).mapInArrow(_raw, "file string, block long, rel long, piece binary")
    parts = raw.join(needed.fitting(), ["file", "block", "rel"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["piece"].cast("string")), MAGIC).cast("binary")
    joined = parts.select("file", F.col("owner").alias("start"), text.alias("whole"))
    full = split.join(joined, ["file", "start"])
    head = F.instr(F.col("whole").cast("string"), END)
    # the header is ASCII but for the URL, so its bytes are counted on the part before the payload
    head_bytes = F.octet_length(F.substring(F.col("whole").cast("string"), F.lit(1), head - 1)) + 4
    payload = F.substring("whole", head_bytes + 1, (F.col("reach") - len(MAGIC) - head_bytes - 4).cast("int"))
    full = full.withColumn("payload", payload).withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    return rest.unionByName(full.select(*out, *(["payload"] if with_payload else [])))
