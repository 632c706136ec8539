"""Current rows of append-only logs: one aggregation per key, no window over whole keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """The last row of each key by the given order, which must be total. `order` names the rule: ("seq",), or ("at", "seq") where
    back-dated rows must not win. Aggregates partially before its one shuffle."""
    values = [c for c in (values or log.columns) if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in values))


def first_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    return log.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in values))


def current(rows: DataFrame, heads: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows that the head pointer of their key names."""
    return rows.join(heads.select(*keys, version), [*keys, version], "left_semi")


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Insert-if-absent: incoming rows whose key is new; of several rows of a new key the first by `order` and then by all values."""
    values = [c for c in incoming.columns if c not in keys]
    first = first_per_key(incoming, keys, [*order, *(v for v in values if v not in order)], values) if values else incoming.distinct()
    return first.select(*incoming.columns).join(existing.select(*keys), list(keys), "left_anti")


def collisions(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys that both have with different values (nulls are equal)."""
    e, i = existing.alias("e"), incoming.alias("i")
    on = [F.col(f"e.{k}") == F.col(f"i.{k}") for k in keys]
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.col(f"e.{v}").eqNullSafe(F.col(f"i.{v}"))
    return e.join(i, on).where(differ).select(*(F.col(f"e.{k}").alias(k) for k in keys))


def replace_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Insert-or-replace: incoming rows win over existing ones of their key; of several, the last by `order` and then by all values."""
    values = [c for c in incoming.columns if c not in keys]
    last = latest_per_key(incoming, keys, [*order, *(v for v in values if v not in order)], values) if values else incoming.distinct()
    return existing.join(incoming.select(*keys), list(keys), "left_anti").unionByName(last)


def reasons(**codes: Column) -> Column:
    """The sorted names of the conditions that hold; a null condition does not."""
    named = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in codes.items()]
    return F.array_sort(F.filter(F.array(*named), lambda x: x.isNotNull()))
