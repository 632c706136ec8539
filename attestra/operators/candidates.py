"""Candidates for the bank: reasons against review, findings of mechanical checks, and what a table must hold before an insert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Item types without options.
PLAIN_TYPES = ("填空题", "计算题", "解答题", "证明题", "综合题", "应用题")
CHOICE = "选择题"


def review_reasons(fields: Mapping[str, Column], number: Column, most: int = 20) -> Column:
    """The names of the fields that are empty, in order, and whether the number lies outside the first batch."""
    empty = lambda c: F.coalesce(F.length(F.trim(c.cast("string"))), F.lit(0)) == 0
    named = [F.when(empty(c), F.lit(f"missing {name}")) for name, c in fields.items()]
    named.append(F.when(number.cast("int") > most, "outside first objective-question batch"))
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def consistency(kind: Column, options: Column, answer: Column) -> Column:
    """array<struct<check, passed>>: an answer is there; a choice has two options or more, and its answer's letter is one of theirs; other known
    types have none; a type is known. options: null if they cannot be read."""
    there = F.coalesce(F.length(F.trim(answer)), F.lit(0)) > 0
    letters = F.transform(options, lambda o: F.regexp_extract(o, r"^\s*([A-F])[.．、]", 1))
    finding = lambda name, ok: F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"))
    enough = F.coalesce(F.size(options) >= 2, F.lit(False))
    first = F.substring(F.trim(F.coalesce(answer, F.lit(""))), 1, 1)
    second = F.when(kind == CHOICE, F.when(enough, finding("choice_answer_matches_option", (first != "") & F.array_contains(letters, first))).otherwise(finding("choice_options", F.lit(False))))
    second = second.when(kind.isin(*PLAIN_TYPES), finding("non_choice_options", F.size(options) == 0)).otherwise(finding("question_type", F.lit(False)))
    return F.array(finding("answer_present", there), second)


def keys_agree(expected: DataFrame, found: DataFrame, group: str, key: str) -> DataFrame:
    """group, expected, found, agree: whether both have the same keys, each as often."""
    count = lambda df, n: df.groupBy(group, key).agg(F.count(F.lit(1)).alias(n))
    both = count(expected, "_e").join(count(found, "_f"), [group, key], "full").na.fill(0, ["_e", "_f"])
    return both.groupBy(group).agg(F.sum("_e").alias("expected"), F.sum("_f").alias("found"), F.bool_and(F.col("_e") == F.col("_f")).alias("agree"))


def insert_guard(rows: DataFrame, key: str, guards: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """key, reason of rows that lack what must exist before them: each guard is (reason, rows that must exist, columns that must be equal)."""
    out = None
    for reason, must, on in guards:
        part = rows.join(must.select(*on).distinct(), list(on), "left_anti").select(F.col(key), F.lit(reason).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def grade_matches(grade: str, equivalents: Mapping[str, str | Sequence[str]], stage: Column, level: Column) -> Column:
    """A grade that stands for a stage matches all of it, one that bridges levels any of these, any other itself."""
    same = equivalents.get(grade)
    return stage == same if isinstance(same, str) else level.isin(*same) if same else level == grade


def quality_status(*gates: Column) -> Column:
    """passed only if all gates pass; anything missing blocks."""
    good = F.lit(True)
    for g in gates:
        good = good & F.coalesce(g == "pass", F.lit(False))
    return F.when(good, "passed").otherwise("blocked")
