"""Where texts lie in what they were taken from: matches and shown texts with places (code points, from 0, end exclusive) in the raw text.

What is shown leaves marks out and white space at the ends; it is a subsequence of the raw text, so the runs of kept characters map it back: their
substrings, one after the other, are what is shown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text cleaning takes it, and marks of placed objects and cells: fixed values, as they are written in a character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MARKS = r"\x01\x07"
#: The same characters, one by one.
_WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_MARKED = "\x01\x07"

_RUNS = "array<struct<start:int,end:int>>"


def running(values: Column) -> Column:
    """Sums up to each entry of an array of ints, by doubling steps: n log n for n entries."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, values, lambda acc, p: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), p)), F.lit(0))))


def named(value: Column, then) -> Column:
    """then(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def matches(text: Column, pattern: str, group: int = 1, hint: str | None = None) -> Column:
    """array<struct<start, end, value>> of the leftmost matches, which do not overlap; value: the group's text. hint: a faster pattern that every text with a match matches."""

    def of(x: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(x["t"], pattern, -1), 1, F.size(x["hits"])), x["hits"], lambda g, h: F.length(g) + F.length(h))
        placed = F.zip_with(x["hits"], running(sizes), lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end")))
        return F.zip_with(placed, F.regexp_extract_all(x["t"], F.lit(pattern), F.lit(group)), lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))

    found = named(F.struct(text.alias("t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), of)
    return F.when(text.rlike(hint or pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]."""
    return F.substring(text, start + 1, end - start)


def shown(text: Column) -> Column:
    """The text without marks, and without white space around it."""
    return F.btrim(F.translate(F.coalesce(text, F.lit("")), _MARKED, ""), F.lit(_WHITE))


def shown_runs(piece: Column, at: Column | int = 0, block: Column | None = None) -> Column:
    """array<struct<start, end>>: where the characters of shown(piece) lie in the text that has the piece at `at`; with a block, array<struct<block, start, end>>.

    Most pieces have no mark inside and are one run; only the others are taken apart.
    """
    rest = F.ltrim(piece, F.lit(_WHITE + _MARKED))
    core = F.rtrim(rest, F.lit(_WHITE + _MARKED))
    first = F.length(piece) - F.length(rest) + at
    of = lambda a, z: F.struct(*([] if block is None else [block.alias("block")]), a.cast("int").alias("start"), z.cast("int").alias("end"))

    def taken(x: Column) -> Column:
        parts = F.split(x["t"], f"[{MARKS}]", -1)
        ends = running(F.transform(parts, lambda p: F.length(p) + 1))  # a mark behind each
        found = F.zip_with(parts, ends, lambda p, e: F.struct((x["a"] + e - 1 - F.length(p)).cast("int").alias("start"), (x["a"] + e - 1).cast("int").alias("end")))
        found = F.filter(found, lambda r: r["start"] < r["end"]).cast(_RUNS)
        return found if block is None else F.transform(found, lambda r: of(r["start"], r["end"]))

    marked = F.contains(rest, F.lit(_MARKED[0])) | F.contains(rest, F.lit(_MARKED[1]))
    one = F.array_repeat(of(first, first + F.length(core)), F.when(core != "", 1).otherwise(0))
    return F.when(marked, named(F.struct(core.alias("t"), first.cast("int").alias("a")), lambda x: F.when(x["t"] == "", F.array_repeat(of(F.lit(0), F.lit(0)), 0)).otherwise(taken(x)))).otherwise(one)


def said(text: Column, runs: Column) -> Column:
    """The substrings at runs, one after the other."""
    return F.array_join(F.transform(runs, lambda r: cut(text, r["start"], r["end"])), "")
