"""Token counts of whole texts by the tokenizers library, in byte-balanced Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import importable

#: UTF-8 bytes that go to the tokenizer at once, and the length in bytes from which a text is cut.
BATCH_BYTES = 1 << 19
CUT_BYTES = 1 << 16

#: Between a letter and a space before a letter, a byte-level tokenizer always starts a new piece at the space.
_SAFE = re.compile(b"(?<=[A-Za-z])(?= [A-Za-z])")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    # the library's store of merged words costs more than it saves where most words are rare; counts don't depend on it
    if resize := getattr(found.model, "_resize_cache", None):
        resize(1)
    return found


def pieces(text: bytes, most: int = CUT_BYTES) -> list[bytes]:
    """UTF-8 text in order, cut at the first safe boundary after every ``most`` bytes; uncut where none follows."""
    out, at = [], 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def batches(texts: Iterable[bytes], batch_bytes: int = BATCH_BYTES, cut_bytes: int = CUT_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(numbers of texts, pieces) in batches of at most ``batch_bytes``, however many texts these are; a larger piece is one of its own."""
    owners: list[int] = []
    batch: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        for piece in pieces(text, cut_bytes):
            if batch and held + len(piece) > batch_bytes:
                yield owners, batch
                owners, batch, held = [], [], 0
            owners.append(i)
            batch.append(piece)
            held += len(piece)
    if batch:
        yield owners, batch


def count_tokens(texts: Sequence[bytes], path: str, batch_bytes: int = BATCH_BYTES, cut_bytes: int = CUT_BYTES) -> list[int]:
    """Tokens of each UTF-8 text."""
    encode = _tokenizer(path).encode_batch_fast
    counts = [0] * len(texts)
    for owners, batch in batches(texts, batch_bytes, cut_bytes):
        for owner, found in zip(owners, encode([p.decode("utf-8", "replace") for p in batch], add_special_tokens=False), strict=True):
            counts[owner] += len(found)
    return counts


def _counter(path: str, batch_bytes: int, cut_bytes: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            counts = count_tokens(texts, path, batch_bytes, cut_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    batch_bytes: int = BATCH_BYTES,
    cut_bytes: int = CUT_BYTES,
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit): one per document, in one pass without a shuffle.

    Counts are those of the library for the whole text, without special tokens added; special strings inside a text
    are handled as the library's default has it. Only lengths leave the Python worker. Long texts are cut where a
    byte-level tokenizer starts a new piece in any case, so cuts don't change counts. ``cut_bytes`` suits tokenizers
    with a byte-level pre-tokenizer; set it above the longest text for any other.

    Batches are balanced by bytes, so memory follows neither the number of texts nor their script. A long text without
    such a boundary is one piece.

    Null text: counts as empty, zero bytes and tokens. Null and repeated ids keep their rows. An empty table gives
    an empty result; other columns are not read. ``tokenizer_path`` is a file that every executor has.
    """
    importable(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").cast("binary").alias("text"))
    counted = rows.mapInArrow(_counter(tokenizer_path, batch_bytes, cut_bytes), "id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
