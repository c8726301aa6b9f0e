"""Near-duplicate lines by a segment-partition edit join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import components
from sluice.llm.shared import BROADCAST_BYTES, Scratch, Table

#: Lines are linked up to so many edits of one character.
EDITS = 2

#: One edit needs so many characters of the shorter line: five make near lines at least 0.8 alike.
CHARS_AN_EDIT = 5

#: Keys with more lines are refined by further segments before any pair is made.
HOT = 400

#: Entries that are compared with one another in one piece of work, where refining is at its end.
BLOCK = 1024

#: A line is met by broadcast if it is over one in so many of all lines; there are at most as many of these.
HOT_LINES = 256

_SPACE = r"[^ \t-\r]"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def allowed(length: Column, edits: int = EDITS, chars_an_edit: int = CHARS_AN_EDIT) -> Column:
    """Edits that may lie between two lines, the shorter of which has that length."""
    return F.least(F.lit(edits), F.floor(length / F.lit(chars_an_edit)).cast("int"))


def _cut(length: Column, i: int, edits: int | Column) -> Column:
    """Characters before segment ``i`` of a line of that length cut into edits + 1 even segments."""
    parts = F.lit(edits + 1) if isinstance(edits, int) else edits + 1
    return F.call_function("div", length.cast("long") * i, parts).cast("int")


def _shifts(i: int, less: int, edits: int) -> range:
    """How far segment ``i`` of a line may lie from its place in one that is ``less`` characters longer: as many edits as fit on either side."""
    return range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)


def _probes(length: Column, target: Column, less: int, edits: int) -> list[tuple[int, bool, Column, Column, Column]]:
    """(segment, whether unshifted, first character, characters, whether inside) of the substrings of a line that can equal a segment of one of the target length.

    The line is ``less`` characters longer. One of them equals its segment for every such line within the edits.
    """
    out = []
    for i in range(edits + 1):
        first = _cut(target, i, edits) + 1
        n = _cut(target, i + 1, edits) + 1 - first
        for shift in _shifts(i, less, edits):
            start = first + shift
            out.append((i, less == 0 and shift == 0, start, n, (start >= 1) & (start + n - 1 <= length)))
    return out


def _key(parent: Column, target: Column, i: int, text: Column) -> Column:
    return F.xxhash64(parent, target.cast("int"), F.lit(i), text)


def _sized(lines: DataFrame, edits: int, chars_an_edit: int) -> DataFrame:
    """Rows (line_id, line, length, edits0.., cut0_1..) of lines.

    For lines as long or ``less`` characters shorter, ``edits<less>`` are the edits that may lie between, and
    ``cut<less>_<i>`` the characters before segment ``i`` there. As columns they are computed once, not in every key.
    """
    sized = lines.select(_line_id(F.col("line")).alias("line_id"), "line", F.length("line").alias("length"))
    whole = [F.greatest(F.col("length") - less, F.lit(0)) for less in range(edits + 1)]
    sized = sized.select("*", *[allowed(n, edits, chars_an_edit).alias(f"edits{less}") for less, n in enumerate(whole)])
    return sized.select("*", *[_cut(n, i, F.col(f"edits{less}")).alias(f"cut{less}_{i}") for less, n in enumerate(whole) for i in range(edits + 2)])


def _piece(start: Column, n: Column) -> Column:
    """Bytes of a substring of a line. Characters are counted only where some take more bytes than one."""
    plain = F.octet_length("line") == F.col("length")
    return F.when(plain, F.substring(F.col("line").cast("binary"), start, n)).otherwise(F.substring("line", start, n).cast("binary"))


def _line_probes(edits: int) -> list[tuple[int, bool, Column, Column, Column, Column]]:
    """(less, home, fits, key, start, n) of the own segments of a sized line, and of its probes for lines as long or ``less`` characters shorter.

    Fewer edits have some of the same segments and shifts. Of two lines of one length either can find the other. Up to two
    edits, shifts to the right are enough for that: if no segment is the same at its own place in both lines, there is an
    insertion on one side of the middle segment and a deletion on the other, and the middle segment of one of the lines
    lies one character further right in the other.
    """
    out = []
    for less in range(edits + 1):
        target, t = F.col("length") - less, F.col(f"edits{less}")
        for i in range(edits + 1):
            start, end = F.col(f"cut{less}_{i}"), F.col(f"cut{less}_{i + 1}")
            for shift in _shifts(i, less, edits):
                least = next(e for e in range(max(i, less, 1), edits + 1) if shift in _shifts(i, less, e))
                if less == 0 and shift < 0 and edits <= 2:
                    continue
                inside = (t >= least) & (start + shift >= 0) & (end + shift <= F.col("length"))
                n, first = end - start, start + (shift + 1)
                out.append((less, less == 0 and shift == 0, inside, _key(F.lit(0).cast("long"), target, i, _piece(first, n)), first, n))
    return out


def _line_entries(edits: int) -> Column:
    """The entries (key, home, start, n, edits, rest_chars) of a sized line."""
    made = [
        F.when(fits, F.struct(key.alias("key"), F.lit(home).alias("home"), start.alias("start"), n.alias("n"), F.col(f"edits{less}").alias("edits"), (F.col("length") - less - n).alias("rest_chars")))
        for less, home, fits, key, start, n in _line_probes(edits)
    ]
    return F.array_compact(F.array(*made))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _common(a: Column, b: Column, part) -> Column:
    """Characters that two strings share at the start (part = left) or at the end (right), by halving."""
    most = F.least(F.length(a), F.length(b))
    start = F.struct(F.lit(0).alias("low"), most.alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        same = part(a, middle) == part(b, middle)
        return F.struct(F.when(same, middle).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(middle - 1).alias("high"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int"))
    return F.aggregate(rounds, start, step, lambda s: s["low"])


def _banded(a: Column, b: Column, edits: int) -> Column:
    """Edit distance up to ``edits`` of two non-empty strings, else null.

    One word for each number of errors holds the diagonals that can be reached; a character of ``b`` moves all
    diagonals of the band at once by word operations.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits).alias(f"r{e}") for e in range(edits + 1)])

    def lookup(x: Column, y: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            match = F.lit(0)
            for bit in range(width):
                match = match + F.when(F.get(x, j + (bit - edits)) == F.get(y, j), 1 << bit).otherwise(0)

            def rows(m: Column) -> Column:
                new = [s["r0"].bitwiseAND(m)]
                for e in range(1, edits + 1):
                    before = s[f"r{e - 1}"]
                    moved = before.bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
                    new.append(s[f"r{e}"].bitwiseAND(m).bitwiseOR(moved).bitwiseAND(F.lit(mask)))
                return F.struct(*[n.alias(f"r{e}") for e, n in enumerate(new)])

            return _let(match, rows)

        def finish(s: Column) -> Column:
            bit = F.size(x) - F.size(y) + edits
            reached = [F.when(F.shiftright(s[f"r{e}"], 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), bit)) != 0, e) for e in range(edits + 1)]
            return F.coalesce(*reached)

        return F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), start, step, finish)

    return _let(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda c: lookup(c["x"], c["y"]))


def distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two strings if at most ``edits``, else null. Common ends are cut off before the banded part."""

    def middle(p: Column, x: Column, y: Column) -> Column:
        x2, y2 = F.substr(x, p + 1), F.substr(y, p + 1)

        def inner(q: Column) -> Column:
            m, n = F.length(x) - p - q, F.length(y) - p - q
            rest = _banded(F.left(x2, m), F.left(y2, n), edits)
            return F.when((m == 0) | (n == 0), F.greatest(m, n)).otherwise(rest)

        return _let(_common(x2, y2, F.right), inner)

    close = F.abs(F.length(a) - F.length(b)) <= edits
    found = _let(_common(a, b, F.left), lambda p: middle(p, a, b))
    return F.when(close, F.when(found <= edits, found))


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (row, id, at, line): every line, and one row without a place for a text without lines."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.select("row", "id", F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "line"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines that have a word."""
    return _split(docs, id_col, text_col).where(F.col("line").rlike(_SPACE))


def _line_id(line: Column) -> Column:
    """128 bits of the line's text."""
    return F.unhex(F.md5(line.cast("binary")))


def _letters(line: Column) -> list[Column]:
    """How often each letter and all else occur: an edit changes the sum of these counts' differences by two at most."""
    plain = [(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).alias(f"n{i}") for i, c in enumerate(_ALPHABET)]
    return [*plain, F.length(F.translate(line, _ALPHABET, "")).alias(f"n{len(_ALPHABET)}")]


def _refined(entries: DataFrame, scratch: Scratch, edits: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(tables of entries (key, line_id, home) to be paired, tables of links (u, v)) from entries of hot keys.

    Lines of a key share one segment; what is left of them (``rest``) is at most the same number of edits apart. In
    each round a key's rests lose the ends that all of them share, and are cut into segments again. A key's lines are
    paired once they are few. Where no more characters than edits are left at the same places of all home lines, these
    are near one another without a look at any pair, and each is linked with one of them. Keys with equal
    entries are followed once. Rests get shorter in every round, so rounds end.
    """
    ready, links = [], []
    fields = ("key", "line_id", "home", "edits", "rest_chars", "rest")
    while True:
        size = F.length("rest")
        stats = entries.groupBy("key").agg(
            *(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("low"), F.max("line_id").alias("high"), F.max("home").alias("any_home"), F.min(size).alias("least")),
            *(F.min("rest").alias("a"), F.max("rest").alias("b"), F.min(F.reverse("rest")).alias("c"), F.max(F.reverse("rest")).alias("d")),
        )
        stats = stats.where("any_home and low <> high").withColumn("front", _common(F.col("a"), F.col("b"), F.left))
        stats = stats.withColumn("back", F.least(F.col("least") - F.col("front"), _common(F.col("c"), F.col("d"), F.left)))
        short = F.substr("rest", F.col("front") + 1, size - F.col("front") - F.col("back"))
        cleared = entries.join(stats.select("key", "front", "back"), "key").select("key", "line_id", "home", "edits", (F.col("rest_chars") - F.col("front") - F.col("back")).alias("rest_chars"), short.alias("rest"))
        cleared = scratch.save(cleared, "cleared")
        mark = F.xxhash64("line_id", "rest", "home")
        same = cleared.read().groupBy("key").agg(F.first("edits").alias("edits"), F.first("rest_chars").alias("left"), F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftrightunsigned(mark, 24)).alias("s"))
        same = scratch.save(same.groupBy("edits", "left", "n", "x", "s").agg(F.min("key").alias("key")), "followed")
        one = same.read()
        last = F.col("left") <= F.col("edits")
        ready.append(cleared.read().join(one.where((F.col("n") <= HOT) | last).select("key"), "key", "left_semi").select("key", "line_id", "home"))
        star = cleared.read().where("home").join(one.where(last).select("key"), "key", "left_semi")
        low = star.groupBy("key").agg(F.min("line_id").alias("v"))
        links.append(star.join(low, "key").where("line_id <> v").select(F.col("line_id").alias("u"), "v"))
        go = one.where((F.col("n") > HOT) & ~last).select("key")
        if go.isEmpty():
            return ready, links
        less, found = size - F.col("rest_chars"), []
        for t in range(1, edits + 1):
            for by in range(t + 1):
                fits = (F.col("edits") == t) & (less == by)
                for i, home, start, n, inside in _probes(size, F.col("rest_chars"), by, t):
                    key = _key(F.col("key"), F.col("rest_chars"), i, F.substring("rest", start, n))
                    found.append(F.when(fits & inside, F.struct(key.alias("key"), (F.col("home") & F.lit(home)).alias("home"), start.alias("start"), n.alias("n"))))
        parts = cleared.read().join(go, "key", "left_semi").select("line_id", "edits", "rest_chars", "rest", F.explode(F.array_compact(F.array(*found))).alias("e"))
        rest = F.concat(F.left("rest", F.col("e.start") - 1), F.substr("rest", F.col("e.start") + F.col("e.n")))
        parts = parts.select(F.col("e.key").alias("key"), "line_id", F.col("e.home").alias("home"), "edits", (F.col("rest_chars") - F.col("e.n")).alias("rest_chars"), rest.alias("rest"))
        entries = scratch.save(parts.select(*fields).distinct(), "entries").read()


def _candidates(lines: DataFrame, scratch: Scratch, edits: int, chars_an_edit: int) -> tuple[DataFrame, Table | None]:
    """(entries (key, line_id, home) of keys that different lines share, one of them by its own segment; links that need no pair, if any)."""
    probes = sorted(_line_probes(edits), key=lambda p: not p[1])
    # _let keeps Spark from making one method of this projection, which would be too long for the JVM to compile
    line_id = _let(F.col("line_id"), lambda x: x).alias("line_id")
    keyed = _sized(lines, edits, chars_an_edit).select(line_id, *[F.when(fits, key).alias(f"k{j}") for j, (_, _, fits, key, _, _) in enumerate(probes)])
    # equal lines have equal keys; a maximum of numbers, unlike arrays, needs no sort
    keyed = keyed.groupBy("line_id").agg(*[F.max(f"k{j}").alias(f"k{j}") for j in range(len(probes))])
    own, other = (F.array(*[f"k{j}" for j, p in enumerate(probes) if p[1] is home]) for home in (True, False))
    unique = scratch.save(keyed.select("line_id", F.concat(own, F.array_except(other, own)).alias("keys")), "lines").read()
    # a line has a key once, so keys with two rows have two lines
    unique = unique.select("line_id", F.posexplode("keys").alias("at", "key")).where("key is not null").select("line_id", "key", (F.col("at") <= edits).alias("home"))
    shared = unique.groupBy("key").agg(F.max("home").alias("any_home"), F.count(F.lit(1)).alias("n"))
    shared = scratch.save(shared.where("any_home and n > 1").select("key", "n"), "keys")
    cold = unique.join(shared.fitting().where(F.col("n") <= HOT).select("key"), "key")
    hot = shared.fitting().where(F.col("n") > HOT).select("key")
    if hot.isEmpty():
        return scratch.save(cold, "candidates").read(), None
    needed = scratch.save(unique.join(hot, "key", "left_semi").select("line_id").distinct(), "hot-lines")
    texts = lines.select(_line_id(F.col("line")).alias("line_id"), "line").join(needed.fitting(), "line_id", "left_semi").groupBy("line_id").agg(F.first("line").alias("line"))
    parts = _sized(texts.select("line"), edits, chars_an_edit).select("line_id", "line", F.explode(_line_entries(edits)).alias("e"))
    rest = F.concat(F.left("line", F.col("e.start") - 1), F.substr("line", F.col("e.start") + F.col("e.n")))
    parts = parts.select("e.key", "line_id", "e.home", "e.edits", "e.rest_chars", rest.alias("rest")).join(hot, "key", "left_semi").distinct()
    ready, links = _refined(scratch.save(parts, "hot-entries").read(), scratch, edits)
    for more in ready:
        cold = cold.unionByName(more)
    stars = reduce(DataFrame.unionByName, links).distinct()
    return scratch.save(cold, "candidates").read(), scratch.save(stars, "stars")


def _unjoined(found: DataFrame, stars: Table, scratch: Scratch) -> DataFrame:
    """Entries with the class of their line by known links, without keys all of whose lines are in one class."""
    known = scratch.save(_classes(components(stars.spark, stars.read(), scratch).read()), "joined")
    classed = found.join(known.fitting(), "line_id", "left").withColumn("class", F.coalesce("root", "line_id")).drop("root")
    several = scratch.save(classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key"), "several")
    return scratch.save(classed.join(several.fitting(), "key", "left_semi"), "paired").read()


def _dealt(entries: DataFrame, scratch: Scratch, refined: bool) -> tuple[DataFrame, DataFrame]:
    """(home entries, all entries) with a block: those of keys over the block size are dealt out, so that no task pairs a whole one.

    Only refining can leave such keys.
    """
    if not refined:
        with_block = entries.withColumn("block", F.lit(0))
        return with_block.where("home"), with_block
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = scratch.save(sizes.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks")), "large")
    if large.read().isEmpty():
        with_block = entries.withColumn("block", F.lit(0))
        return with_block.where("home"), with_block
    dealt = entries.join(large.fitting(), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("line_id"), F.col("blocks").cast("long")).cast("int")
    copies = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.where("home").withColumn("block", own).drop("blocks"), copies.drop("blocks")


def links(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars_an_edit: int = CHARS_AN_EDIT) -> DataFrame:
    """Rows (u, v): ids of different lines within the edits. Chains of links join all lines that chains of near lines join.

    Keys are counted before any pair is made; those with many lines are refined first (``_refined``). Lines that its
    links join already are not paired again. Only lines that share a key get their texts and letter counts, and pairs
    whose counts differ too much never leave the join.
    """
    # bytes are no fewer than characters, and need no look at the line
    lines = _lines(docs, id_col, text_col).select("line").where(F.octet_length("line") >= chars_an_edit)
    found, stars = _candidates(lines, scratch, edits, chars_an_edit)
    found = _unjoined(found, stars, scratch) if stars else found.withColumn("class", F.col("line_id"))
    needed = scratch.save(found.select("line_id").distinct(), "needed")
    texts = lines.select(_line_id(F.col("line")).alias("line_id"), "line").join(needed.fitting(), "line_id", "left_semi")
    texts = scratch.save(texts.groupBy("line_id").agg(F.first("line").alias("line")), "texts").read()
    counts = scratch.save(texts.select("line_id", F.length("line").alias("length"), *_letters(F.col("line"))), "counts").read()
    names = ["class", "length", *[f"n{i}" for i in range(len(_ALPHABET) + 1)]]
    home, every = _dealt(found.join(counts, "line_id"), scratch, stars is not None)
    one = home.select("key", "block", F.col("line_id").alias("u"), *[F.col(n).alias(f"u_{n}") for n in names])
    other = every.select(F.col("key").alias("of"), F.col("block").alias("in"), F.col("line_id").alias("v"), *[F.col(n).alias(f"v_{n}") for n in names])
    apart = sum((F.abs(F.col(f"u_{n}") - F.col(f"v_{n}")) for n in names[2:]), F.lit(0))
    close = (F.col("u_class") != F.col("v_class")) & (F.abs(F.col("u_length") - F.col("v_length")) <= edits) & (apart <= 2 * edits)
    near = one.join(other, (F.col("key") == F.col("of")) & (F.col("block") == F.col("in")) & close)
    near = scratch.save(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs").read()
    pairs = near.join(texts.select(F.col("line_id").alias("u"), F.col("line").alias("a")), "u").join(texts.select(F.col("line_id").alias("v"), F.col("line").alias("b")), "v")
    most = allowed(F.least(F.length("a"), F.length("b")), edits, chars_an_edit)
    verified = pairs.where(F.coalesce(distance(F.col("a"), F.col("b"), edits) <= most, F.lit(False))).select("u", "v")
    return verified.unionByName(stars.read()) if stars else verified


def _classes(stars: DataFrame) -> DataFrame:
    """Rows (line_id, root) of all members of components, roots included."""
    member = stars.select(F.col("u").alias("line_id"), F.col("v").alias("root"))
    return member.unionByName(member.select(F.col("root").alias("line_id"), "root").distinct())


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars_an_edit: int = CHARS_AN_EDIT) -> DataFrame:
    """Rows (row, id, at, first_id, dup, near): every line that has a word, and a row without place for each text without such lines.

    Classes join equal lines and lines that are near, directly or by others: at most ``edits`` edits apart, and at most
    one for every ``chars_an_edit`` characters of the shorter line. The first line of a class is that with the least
    id, then place; dup marks all others, near those whose text is not the first line's. Equal lines meet by their
    hash. Different ones meet when one of the edits + 1 segments of the one equals a substring of the other, probed by
    length and place; pairs are verified by a banded bit-parallel edit distance.

    Null text has no lines. Null ids come last; repeated ids keep their rows. An empty table gives an empty result.
    Lines of any length are compared whole. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    line = F.when(F.col("line").rlike(_SPACE), F.col("line"))
    split = _split(docs, id_col, text_col).select("row", "id", F.when(line.isNotNull() | (F.col("at") == 0), F.col("at")).alias("at"), _line_id(line).alias("line_id"))
    occurrences = scratch.save(split.where("line_id is not null or at is null or at = 0"), "occurrences").read()
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")
    firsts = scratch.save(occurrences.where("line_id is not null").groupBy("line_id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "firsts").read()
    member = _classes(components(spark, links(docs, scratch, id_col, text_col, edits, chars_an_edit), scratch).read())
    own = member.join(firsts, "line_id")
    least = own.groupBy("root").agg(F.min("first").alias("class_first"))
    named = scratch.save(own.join(least, "root").select("line_id", "class_first"), "classes").read()
    table = firsts.join(named, "line_id", "left").select("line_id", "n", "first", F.coalesce("class_first", "first").alias("class_first"))
    # lines that occur once and are near no other need no look-up
    special = scratch.save(table.where((F.col("n") > 1) | (F.col("first") != F.col("class_first"))), "special")
    found = _looked_up(occurrences.where("line_id is not null"), special)
    is_first = (F.col("row") == F.col("class_first.row")) & (F.col("at") == F.col("class_first.at"))
    other = F.col("class_first").isNotNull()
    found = found.select(
        *("row", "id", "at", F.when(other, F.col("class_first.id")).otherwise(F.col("id")).alias("first_id"), F.when(other, ~is_first).otherwise(False).alias("dup")),
        F.when(other, F.col("first") != F.col("class_first")).otherwise(False).alias("near"),
    )
    none = occurrences.where("line_id is null").select("row", "id", F.lit(None).cast("int").alias("at"), F.lit(None).cast(found.schema["first_id"].dataType).alias("first_id"), F.lit(False).alias("dup"), F.lit(False).alias("near"))
    return found.unionByName(none)


def _looked_up(occurrences: DataFrame, special: Table) -> DataFrame:
    """Occurrences with first and class_first of their line. Very frequent lines, of which there are few, are met by broadcast."""
    if special.bytes() <= BROADCAST_BYTES // 4:  # rows are several times as large as written
        return occurrences.join(F.broadcast(special.read().drop("n")), "line_id", "left")
    rows = occurrences.count()
    often = F.col("n") > rows // HOT_LINES
    hot = F.broadcast(special.read().where(often).select("line_id", "first", "class_first"))
    rest = special.read().where(~often).select("line_id", "first", "class_first")
    one = occurrences.join(hot, "line_id")
    other = occurrences.join(hot.select("line_id"), "line_id", "left_anti").join(rest, "line_id", "left")
    return one.unionByName(other)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars_an_edit: int = CHARS_AN_EDIT) -> DataFrame:
    """Rows (id, n_lines, n_dup_lines, n_near_lines, first_ids): every document with its repeated lines and the documents that have them first."""
    lines = line_classes(docs, id_col, text_col, edits, chars_an_edit)
    counted = lines.groupBy("row", "id").agg(
        F.count("at").alias("n_lines"), F.count_if("dup").alias("n_dup_lines"), F.count_if("near").alias("n_near_lines"), F.sort_array(F.collect_set(F.when(F.col("dup"), F.col("first_id")))).alias("first_ids")
    )
    return counted.drop("row")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars_an_edit: int = CHARS_AN_EDIT) -> DataFrame:
    """The documents with every line but the first of its class taken out of their texts; other columns stay."""
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "unrepeated")
    held = scratch.save(docs.withColumn("__sl_row", F.monotonically_increasing_id()), "documents").read()
    keyed = held.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col("__sl_row").alias("key")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    dups = line_classes(keyed, "id", "text", edits, chars_an_edit).where("dup").groupBy(F.col("id.key").alias("__sl_of")).agg(F.collect_set("at").alias("__sl_at"))
    marked = held.join(scratch.save(dups, "dups").read(), F.col("__sl_row") == F.col("__sl_of"), "left")
    text = F.col(f"`{text_col}`")
    kept = F.filter(F.split(text, "\n", -1), lambda _, at: ~F.array_contains("__sl_at", at))
    new = F.when(F.col("__sl_at").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return marked.withColumn(text_col, new).select(*[F.col(f"`{c}`") for c in names])
