"""Quality rules: a threshold table compiled into one projection over text measures."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a window whose repetition counts.
WINDOW = 5

#: Frequent function words of the languages that the rules serve, in lower case.
STOP_WORDS = (
    *("the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "a", "for", "on", "as", "was"),
    *("der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "nicht", "ein", "eine", "des", "dem", "sich", "auf"),
    *("le", "la", "les", "de", "et", "un", "une", "que", "qui", "dans", "pour", "est", "du", "en", "au", "par"),
    *("el", "los", "las", "y", "se", "del", "por", "con", "una", "su", "al", "lo", "como", "más", "o", "no"),
)

#: measure: (least, most); None leaves a side open. A document fails if any measure lies outside.
RULES: dict[str, tuple[float | None, float | None]] = {
    "n_words": (10, None),
    "mean_word_chars": (2.0, 15.0),
    "symbol_ratio": (None, 0.10),
    "stop_ratio": (0.02, None),
    "dup_line_ratio": (None, 0.50),
    "bullet_line_ratio": (None, 0.90),
    "ellipsis_line_ratio": (None, 0.50),
}

_SPACE = r"[ \t-\r]"
_WORD = r"[^ \t-\r]"


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, n_bullet_lines, n_ellipsis_lines).

    Every measure covers the whole text and stays in its row: no shuffle, no user function. Repeated windows are found
    by 64-bit hashes of their words: texts with as many different windows as windows have none; for the others the
    hashes are sorted with their positions, equal neighbours mark windows, and their spans are added up.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    found = docs.select(
        docs[id_col].alias("id"),
        F.array_remove(F.split(text, f"{_SPACE}+", -1), "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(_WORD)).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    hashed = found.select(
        "id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(rf"^{_SPACE}*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(rf"(\.\.\.|…){_SPACE}*$"))).cast("long").alias("n_ellipsis_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    none = F.array().cast("array<bigint>")
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda at: F.xxhash64(*[F.get("h", at + i) for i in range(WINDOW)]))
    plain = [c for c in hashed.columns if c != "h"]
    hashed = hashed.select(*plain, F.when(F.size("h") >= WINDOW, windows).otherwise(none).alias("win"))
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    ordered = F.sort_array(F.transform("win", lambda x, at: F.struct(x.alias("x"), at.alias("at"))))
    hashed = hashed.select(*plain, F.when(repeats, ordered).alias("win"))
    equal = F.filter("win", lambda w, at: (w["x"] == F.get("win", at - 1)["x"]) | (w["x"] == F.get("win", at + 1)["x"]))
    starts = F.sort_array(F.transform(equal, lambda w: w["at"]))
    hashed = hashed.select(*plain, F.when(F.col("win").isNotNull(), starts).alias("starts"))
    spans = F.transform("starts", lambda s, at: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", at + 1) - s, F.lit(WINDOW))))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda total, span: total + span)
    return hashed.select(*plain, F.coalesce(F.when(F.col("starts").isNotNull(), covered), F.lit(0).cast("long")).alias("n_repeat_words"))


def _derived() -> dict[str, Column]:
    words, lines = F.col("n_words"), F.col("n_lines")
    return {
        "n_words": words,
        "mean_word_chars": _ratio(F.col("word_chars"), words),
        "symbol_ratio": _ratio(F.col("n_symbols"), words),
        "stop_ratio": _ratio(F.col("n_stop"), words),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), lines),
        "bullet_line_ratio": _ratio(F.col("n_bullet_lines"), lines),
        "ellipsis_line_ratio": _ratio(F.col("n_ellipsis_lines"), lines),
    }


def verdict(rules: Mapping[str, tuple[float | None, float | None]] = RULES) -> Column:
    """The rule table as one boolean expression over the columns of ``measures``."""
    have = _derived()
    tests = [F.lit(True)]
    for name, (least, most) in rules.items():
        if least is not None:
            tests.append(have[name] >= least)
        if most is not None:
            tests.append(have[name] <= most)
    return reduce(lambda a, b: a & b, tests)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Mapping[str, tuple[float | None, float | None]] = RULES) -> DataFrame:
    """``measures`` with base_failed (under 10 words, or over a fifth of them in repeated windows) and kept.

    kept is false if base_failed, else whether every rule of the table holds. Null and empty texts have no words and
    fail. Null and repeated ids keep their rows; an empty table gives an empty result; texts of any length are measured
    whole; other columns are not read.
    """
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
