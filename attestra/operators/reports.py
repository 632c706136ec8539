"""Coverage, readiness and count reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = ("pass", "fail", "unsupported")


def coverage(rows: DataFrame, dimensions: Sequence[str], verdict: str) -> DataFrame:
    """dimension, value, total and n_<verdict>: one group per value of each dimension, and one for all rows, in one pass."""
    sets = [[d] for d in dimensions] + [[]]
    out = rows.groupingSets([[F.col(x) for x in s] for s in sets], *(F.col(d) for d in dimensions)).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(verdict) == b).alias(f"n_{b}") for b in BUCKETS))
    n = len(dimensions)
    name, value = F.lit("all"), F.lit("")
    for i, d in enumerate(dimensions):
        here = F.col("_g") == (1 << n) - 1 - (1 << n - 1 - i)
        name, value = F.when(here, d).otherwise(name), F.when(here, F.col(d).cast("string")).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), "total", *(f"n_{b}" for b in BUCKETS))


def coverage_verdict(rows: DataFrame) -> DataFrame:
    """rows (file_type, status, coverage, expected_hash, observed_hash; status null: no evidence) with coverage_class and verdict."""
    f = F.col
    no_evidence = f("status").isNull() & f("coverage").isNull()
    unequal = (f("expected_hash").isNotNull() | f("observed_hash").isNotNull()) & ~F.coalesce((F.trim("expected_hash") != "") & (F.lower("expected_hash") == F.lower("observed_hash")), F.lit(False))
    invalid = ~no_evidence & (unequal | ~F.coalesce(f("coverage").isin("full", "partial", "none"), F.lit(False)))
    known = F.lower("file_type").isin("pdf", "doc", "docx", "image")
    verdict = F.when(invalid, "fail").when(~F.coalesce(known, F.lit(False)), "unsupported").when(no_evidence, "fail").when(f("status").isin(*BUCKETS), f("status")).otherwise("fail")
    return rows.withColumns({"coverage_class": F.when(no_evidence, "unknown").when(invalid, "invalid").otherwise(f("coverage")), "verdict": verdict})


def blockers(parts: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """blocker, n of the (name, frame, condition) parts that have rows under their condition."""
    out = None
    for name, df, cond in parts:
        one = df.where(cond).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("blocker"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")
