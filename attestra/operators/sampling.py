"""Deterministic samples: the order is md5 of seed and id, which any engine can repeat."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def per_stratum(df: DataFrame, stratum: Column | str, key: str, n: Column | int, seed: str) -> DataFrame:
    """n rows a stratum, with pick (1-based)."""
    w = Window.partitionBy(stratum).orderBy(draw(F.col(key), seed), key)
    return df.withColumn("pick", F.row_number().over(w).cast("long")).where(F.col("pick") <= n)


def priority_strata(df: DataFrame, strata: Sequence[tuple[str, Column]], key: str, n: int, seed: str, total: int | None = None) -> DataFrame:
    """n rows of each stratum, of rows that no earlier stratum holds; then, up to `total` rows, any that are left (stratum fill), in drawing order."""
    which = F.lit(None).cast("string")
    for name, cond in reversed(strata):
        which = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(which)
    named = df.withColumn("stratum", which)
    picked = per_stratum(named.where("stratum IS NOT NULL"), "stratum", key, n, seed)
    if total is None:
        return picked
    room = max(0, total - picked.count())
    left = df.join(picked.select(key), key, "left_anti").orderBy(draw(F.col(key), seed), key).limit(room).withColumn("stratum", F.lit("fill"))
    return picked.unionByName(per_stratum(left, "stratum", key, room, seed))


def allocation(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """stratum, n, quota: proportional shares of `total` (of all rows, if it is more), largest remainders first; none is above its stratum's size."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    all_ = sizes.agg(F.sum("n").alias("_all"))
    # In whole numbers: the remainder of total * n by the total of all rows.
    exact = sizes.crossJoin(F.broadcast(all_)).withColumns({"_total": F.least(F.lit(total).cast("long"), "_all")}).withColumns({"_floor": F.expr("(n * _total) div _all"), "_rest": F.expr("(n * _total) % _all")})  # one row
    left = F.col("_total") - F.sum("_floor").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), stratum))  # a row a stratum
    return exact.withColumns({"_left": left, "_place": place}).select(stratum, "n", F.least(F.col("n"), F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("long")).alias("quota"))


def at_least_ratio(df: DataFrame, stratum: str, key: str, ratio_percent: int, seed: str) -> DataFrame:
    """ceil(ratio * n) rows of each stratum, one at least."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("_n") * ratio_percent / 100))
    return per_stratum(df.join(sizes, stratum), stratum, key, wanted, seed).drop("_n")


def two_level(df: DataFrame, stratum: str, reason: str, key: str, targets: Mapping[str, int], seed: str) -> DataFrame:
    """Rows of each named stratum, as many as its target, shared over its reasons in proportion to their rows (largest remainders first, ties by
    reason), with pick (1-based within stratum and reason). A stratum of fewer rows is taken whole; one without a target not at all."""
    wanted = F.create_map(*(F.lit(x) for pair in targets.items() for x in pair))
    w = Window.partitionBy(stratum)  # a row a reason
    sizes = df.where(F.col(stratum).isin(*targets)).groupBy(stratum, reason).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.sum("_n").over(w))
    shared = sizes.withColumn("_total", F.least(wanted[F.col(stratum)].cast("long"), "_all")).withColumns({"_floor": F.expr("(_n * _total) div _all"), "_rest": F.expr("(_n * _total) % _all")})
    place = F.row_number().over(w.orderBy(F.desc("_rest"), reason))
    quota = shared.withColumns({"_left": F.col("_total") - F.sum("_floor").over(w), "_place": place}).select(F.col(stratum).alias("_s"), F.col(reason).alias("_r"), (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("long")).alias("_quota"))
    met = df.join(quota, (F.col(stratum) == F.col("_s")) & F.col(reason).eqNullSafe(F.col("_r"))).drop("_s", "_r")
    return per_stratum(met, F.struct(stratum, reason), key, F.col("_quota"), seed).drop("_quota")
