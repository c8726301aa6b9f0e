"""Helpers that several corpus operators use: shared scratch tables and word rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.sources.scratch import BROADCAST_BYTES, Scratch, Table, path_bytes, remove, scratch_dir, write_text

__all__ = ["BROADCAST_BYTES", "SPACES", "Scratch", "Table", "ascii_lower", "path_bytes", "remove", "scratch_dir", "utf8_bytes", "words", "write_text"]

#: Words are runs without ASCII white space; the class lists its six characters.
SPACES = " \t\n\x0b\f\r"


def words(text):
    """Array of the runs without ASCII white space; empty for a null text."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " ", -1), "")


def ascii_lower(text):
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8_bytes(text):
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
