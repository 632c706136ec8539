"""Selection under class history: what may still be given, how many are short, and what was used least."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import spread


def not_delivered(items: DataFrame, usage: DataFrame, authorised: DataFrame, item: str, audience: str) -> DataFrame:
    """items (with item and audience) without those delivered to the audience, unless an active authorisation allows them again."""
    barred = usage.join(authorised.select(audience, item), [audience, item], "left_anti").select(audience, item)
    return items.join(barred, [audience, item], "left_anti")


def select_items(candidates: DataFrame, item: str, order: Sequence[str], count: int) -> DataFrame:
    """The first `count` distinct items, with 1-based positions."""
    if count < 1:
        raise ValueError("count must be at least 1")
    top = candidates.dropDuplicates([item]).orderBy(*order, item).limit(count)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order, item)).cast("long"))  # `count` rows


def shortage(demand: DataFrame, supply: DataFrame, bucket: Sequence[str], wanted: str) -> DataFrame:
    """bucket, wanted, found, shortage, status: ready if nothing is short."""
    found = supply.groupBy(*bucket).agg(F.count(F.lit(1)).alias("found"))
    out = demand.join(found, list(bucket), "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.select(*bucket, wanted, "found", F.greatest(F.col(wanted) - F.col("found"), F.lit(0)).cast("long").alias("shortage"), F.when(F.col("found") >= F.col(wanted), "ready").otherwise("blocked").alias("status"))


def least_used(items: DataFrame, usage: DataFrame, item: str, limit: int) -> DataFrame:
    """The items used least so far (never used first), ties by item, with used_count."""
    used = usage.groupBy(item).agg(F.count(F.lit(1)).alias("used_count"))
    return items.join(used, item, "left").withColumn("used_count", F.coalesce("used_count", F.lit(0)).cast("long")).orderBy("used_count", item).limit(limit)


def matching(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Rows for which every given condition holds; None is no condition, null is no match."""
    for c in conditions:
        if c is not None:
            df = df.where(F.coalesce(c, F.lit(False)))
    return df


def usage_completeness(documents: DataFrame, bound: DataFrame, used: DataFrame, document: str, item: str) -> DataFrame:
    """document, n_missing, n_extra, n_duplicate, complete: one usage row for each bound item, no other."""
    # Documents, bound and used items pass one shuffle together; null items match nothing.
    marked = lambda df, kind, i: df.select(F.col(document), i.alias(item), F.lit(kind).alias("_kind"))
    none = F.lit(None).cast(bound.schema[item].dataType)
    rows = marked(documents, 0, none)
    for kind, df in ((1, bound), (2, used)):
        rows = rows.unionByName(marked(df.where(F.col(document).isNotNull()), kind, F.col(item)))
    kinds = [F.count_if(F.col("_kind") == k).alias(c) for k, c in enumerate(("_d", "_b", "_n"))]
    per = spread(rows, document).groupBy(document, item).agg(*kinds)
    lone = lambda mine, other: F.count_if((F.col(mine) > 0) & (F.col(item).isNull() | (F.col(other) == 0)))
    out = per.groupBy(document).agg(F.max("_d").alias("_d"), lone("_b", "_n").alias("n_missing"), lone("_n", "_b").alias("n_extra"), F.count_if(F.col("_n") > 1).alias("n_duplicate")).where("_d > 0").drop("_d")
    return out.withColumn("complete", (F.col("n_missing") + F.col("n_extra") + F.col("n_duplicate")) == 0)
