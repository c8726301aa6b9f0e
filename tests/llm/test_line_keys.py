"""Keys of lines: none that near lines need is missing, and making them takes no sort and no method that the JVM does not compile."""

import itertools
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.llm import linededup
from sluice.llm.shared import Scratch

#: The JVM interprets methods with more bytes of code.
COMPILED = 8000


def neighbours(line, letters):
    """Lines one edit away."""
    for i in range(len(line) + 1):
        yield from (line[:i] + c + line[i:] for c in letters)
        if i < len(line):
            yield line[:i] + line[i + 1 :]
            yield from (line[:i] + c + line[i + 1 :] for c in letters)


@pytest.mark.parametrize(("edits", "chars_an_edit"), [(2, 1), (2, 2), (2, 4), (1, 2), (3, 1), (3, 2)])
def test_all_near_lines_share_a_key(spark, monkeypatch, edits, chars_an_edit):
    monkeypatch.setattr(linededup, "HOT", 1 << 30)
    lines = ["".join(p) for n in range(1, 10) for p in itertools.product("aé", repeat=n)]
    table = spark.createDataFrame([(t,) for t in lines], "line string")
    ids = {r["line"]: bytes(r["id"]) for r in table.select("line", linededup._line_id(F.col("line")).alias("id")).collect()}
    homes, every = defaultdict(set), defaultdict(set)
    found, _ = linededup._candidates(table, Scratch(spark, "keys"), edits, chars_an_edit)
    for r in found.collect():
        every[bytes(r["line_id"])].add(r["key"])
        if r["home"]:
            homes[bytes(r["line_id"])].add(r["key"])
    checked = 0
    for a in lines:
        seen, last = {a}, {a}
        for apart in range(1, edits + 1):
            last = {b for m in last for b in neighbours(m, "aé")} - seen
            seen |= last
            for b in last & ids.keys():
                if apart <= min(len(a), len(b)) // chars_an_edit:
                    checked += 1
                    assert homes[ids[a]] & every[ids[b]] or every[ids[a]] & homes[ids[b]], (a, b)
    assert checked > 1000


def test_keys_are_made_without_sorts_and_by_compiled_code(spark, monkeypatch):
    plans = {}
    save = Scratch.save

    def recorded(self, df, name):
        plans.setdefault(name, df._jdf.queryExecution())
        if name == "lines":
            plans["code"] = spark._jvm.PythonSQLUtils.explainString(plans[name], "codegen")
            plans["text"] = plans[name].executedPlan().toString()
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", recorded)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(1, "one line of text\nhello world"), (2, "hello worlt\nhéllo world")], "doc_id long, text string")
        got = {r["id"]: (r["n_lines"], r["n_dup_lines"], r["n_near_lines"]) for r in linededup.line_report(docs).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == {1: (2, 0, 0), 2: (2, 2, 2)}
    assert "SortAggregate" not in plans["text"]
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plans["code"])]
    assert sizes and max(sizes) <= COMPILED
