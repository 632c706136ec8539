"""Segmentation of ordered blocks and lines by markers, with running windows per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals


def segments(blocks: DataFrame, document: str, order: str, starts: Column, text: str) -> DataFrame:
    """document, segment (from 1; blocks before the first start are 0), first, last, n_blocks, body: from one start marker to the next."""
    w = Window.partitionBy(document).orderBy(order)
    marked = blocks.withColumn("segment", F.sum(F.coalesce(starts, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n")
    return marked.groupBy(document, "segment").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_blocks"), body.alias("body"))


def carry(rows: DataFrame, document: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with `name`: the last value that was not null up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def lines_of(documents: DataFrame, document: str, text: str) -> DataFrame:
    """document, line (from 0), raw."""
    return documents.select(document, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line", "raw"))


def line_states(lines: DataFrame, document: str, kinds: Sequence[tuple[str, str]], item_kind: str, number: str | None = None) -> DataFrame:
    """lines with kind (the first of `kinds` whose pattern matches, else text or blank), item (running count of item_kind lines) and
    status: live, quarantined (a repeated number, or anything under one) or header (before the first item)."""
    kind = F.when(F.trim("raw") == "", "blank").otherwise("text")
    for name, pattern in reversed(kinds):
        kind = F.when(F.col("raw").rlike(pattern), name).otherwise(kind)
    w = Window.partitionBy(document).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("kind", kind)
    is_item = F.col("kind") == item_kind
    out = out.withColumn("item", F.sum(is_item.cast("long")).over(w))
    if number:
        out = out.withColumn("number", F.when(is_item, F.regexp_extract("raw", number, 1)))
        first = F.row_number().over(Window.partitionBy(document, "number").orderBy("line"))
        out = out.withColumn("_again", F.when(is_item, first > 1)).withColumn("_bad", F.last("_again", ignorenulls=True).over(w))
    else:
        out = out.withColumn("_bad", F.lit(False))
    return out.withColumn("status", F.when(F.col("item") == 0, "header").when(F.col("_bad"), "quarantined").otherwise("live")).drop("_again", "_bad")


def owners(marks: DataFrame, ranges: DataFrame, document: str, at: str, first: str, next_: str, owner: str) -> DataFrame:
    """marks with owner and assignment: one owner whose range holds the place: assigned; none: unassigned; several: ambiguous."""
    met = intervals.places_in_ranges(marks.select(document, at).distinct(), ranges.select(document, first, next_, owner), [document], at, first, next_)
    found = met.groupBy(document, at).agg(F.min(owner).alias("_least"), F.max(owner).alias("_most"))
    out = marks.join(found, [document, at], "left")
    one = F.col("_least") == F.col("_most")
    return out.withColumns({owner: F.when(one, F.col("_least")), "assignment": F.when(one, "assigned").when(F.col("_least").isNotNull(), "ambiguous").otherwise("unassigned")}).drop("_least", "_most")


def overlapping_removed(spans: DataFrame, shown: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spans (start, end) that overlap no span of `shown` with equal keys."""
    return intervals.not_overlapping(spans, shown, keys)


def pair_answers(questions: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """questions with their answer; a key with several answers is ambiguous and gets none."""
    per = answers.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("answer").alias("_a"))
    out = questions.join(per, list(keys), "left")
    return out.withColumns({"answer": F.when(F.col("_n") == 1, F.col("_a")), "pairing": F.when(F.col("_n") == 1, "paired").when(F.col("_n") > 1, "ambiguous").otherwise("unanswered")}).drop("_n", "_a")
