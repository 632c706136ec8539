"""Integrity as queries: every function returns (rule, key) rows of what is violated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import spread


def _rows(df: DataFrame, rule: str, keys: Sequence[str]) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    return _rows(spread(df.select(*keys), *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), rule, keys)


def orphans(df: DataFrame, column: str, parents: DataFrame, parent: str, keys: Sequence[str], rule: str) -> DataFrame:
    own, known = df.where(F.col(column).isNotNull()).select(column, *(k for k in keys if k != column)), parents.select(F.col(parent).alias("_p"))
    rows = own.count() + known.count()
    return _rows(spread(own, column, rows=rows).join(spread(known, "_p", rows=rows), F.col(column) == F.col("_p"), "left_anti"), rule, keys)


def failed_checks(df: DataFrame, checks: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """Rows for which a check is false; null passes, as for CHECK constraints. One pass for all checks."""
    named = F.filter(F.array(*(F.when(~c, F.lit(r)) for r, c in checks.items())), lambda x: x.isNotNull())
    return df.select(F.explode(named).alias("rule"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"))


def drift(before: DataFrame, after: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Append-only: rows that were there before and are changed or gone."""
    hashed = lambda df, n: df.select(*keys, F.sha2(F.to_json(F.struct(*payload)), 256).alias(n))
    both = hashed(before, "_b").join(hashed(after, "_a"), list(keys), "left")
    return _rows(both.where("_a IS NULL"), "deleted", keys).unionByName(_rows(both.where("_a <> _b"), "updated", keys))


def illegal_transitions(log: DataFrame, key: str, order: str, state: str, allowed: Sequence[tuple[str, str]], escapes: Sequence[str] = ()) -> DataFrame:
    """key, at (order), source, target of each step that is neither allowed, nor into an escape state, nor to the same state."""
    w = Window.partitionBy(key).orderBy(order)
    steps = log.withColumn("source", F.lag(state).over(w)).where(F.col("source").isNotNull() & (F.col("source") != F.col(state)))
    legal = F.concat_ws(">", "source", state).isin(*(f"{a}>{b}" for a, b in allowed)) | F.col(state).isin(*escapes)
    return steps.where(~legal).select(key, F.col(order).alias("at"), "source", F.col(state).alias("target"))


def several_active(df: DataFrame, key: str, active: Column, rule: str) -> DataFrame:
    """At most one active row a key."""
    return _rows(spread(df.where(active).select(key), key).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), rule, [key])
