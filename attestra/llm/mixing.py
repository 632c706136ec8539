"""Mixing sources to target weights, with DataFrame functions only: iterative proportional fitting.

Tokens are summed per cell of the margins (source, language, topic). The cells' weights are raked to each margin's target
shares in turn until all hold; a document is then kept with its cell's calibrated probability, by a hash of its id. The table
of cells is the only thing that is fitted; it stays a distributed table, whatever the number of sources.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, drop_written, release, unused, written

#: Cells up to which their table is broadcast; beyond, documents meet it in a join with salted keys.
FEW_CELLS = 50_000
SALTS = 32


def words(text: Column) -> Column:
    """Words between ASCII white space, as a count of tokens."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def genre(text: Column, tokens: Column) -> Column:
    """A topic for tables without one: tables, lists, short, long or other prose."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("\n- ")) | F.contains(text, F.lit("\n* ")), "list").when(tokens < 50, "short").when(tokens > 2000, "long").otherwise("prose")


def rake(cells: DataFrame, margins: Mapping[str, float], rounds: int = 200, tolerance: float = 1e-6) -> tuple[DataFrame, str, float]:
    """(cells (the margins' columns, tokens) with `factor`, how the targets stand, by which share one is off at most). After weighting by the factor, each margin's
    shares are proportional to its own token shares to the given power (1: as they are; 0: all alike), and the total stays.

    Stand: `hold`; `cannot_hold` (cells that are empty forbid it: the last margin's hold, and rounds of steps over all margins no longer bring others
    nearer); `not_yet` (they still come nearer, but `rounds` are over). A warning says the latter two.

    A factor is a product of one number a margin and category. Each step joins the cells with the other margins' numbers and sums them by category,
    with partial sums, so no category gathers in one task; its table of numbers is written.
    """
    spark, cells, numbers = cells.sparkSession, written(cells, "cells"), {}
    for name, power in margins.items():
        own = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("_own"))
        all_ = own.where("_own > 0").agg(F.sum("_own").alias("_all"), F.sum(F.pow("_own", F.lit(power))).alias("_norm"))
        to = F.when(F.col("_own") > 0, F.pow("_own", F.lit(power)) / F.col("_norm") * F.col("_all"))
        numbers[name] = written(own.crossJoin(F.broadcast(all_)).select(name, to.alias(f"_to_{name}"), F.lit(1.0).alias(f"_f_{name}"), F.lit(0.0).alias(f"_off_{name}")), f"margin-{name}")  # one row

    def joined(names: list[str]) -> DataFrame:
        out = cells
        for name in names:
            out = out.join(numbers[name].select(name, f"_f_{name}"), name)
        return out

    before, off, stand = math.inf, 0.0, "not_yet"
    for turn in range(rounds):
        for name in margins:
            others = [m for m in margins if m != name]
            weight = F.col("tokens")
            for m in others:
                weight = weight * F.col(f"_f_{m}")
            now = joined(others).select(name, weight.alias("_w")).groupBy(name).agg(F.sum("_w").alias("_now"))
            old = numbers[name]
            to, f = F.col(f"_to_{name}"), F.col(f"_f_{name}")
            next_ = old.join(now, name).select(name, to, F.when(F.col("_now") > 0, to / F.col("_now")).otherwise(f).alias(f"_f_{name}"), F.coalesce(F.abs(F.col("_now") * f / to - 1), F.lit(0.0)).alias(f"_off_{name}"))
            numbers[name] = written(next_, f"margin-{name}")
            drop_written(old)
        if turn and turn % 4 != 3 and turn < rounds - 1:
            continue
        off = max((numbers[name].agg(F.max(f"_off_{name}")).first()[0] or 0.0 for name in margins), default=0.0)
        if off < tolerance or (turn and off > 0.98 * before):
            stand = "hold" if off < tolerance else "cannot_hold"
            break
        before = off if turn else math.inf
    if stand != "hold":
        warnings.warn(f"the margins' targets {'cannot all hold' if stand == 'cannot_hold' else 'do not hold yet'}: one is off by {off:.2%}", stacklevel=2)
    factor = F.lit(1.0)
    for name in margins:
        factor = factor * F.col(f"_f_{name}")
    release(spark)
    return joined(list(margins)).select(*margins, "tokens", factor.alias("factor")), stand, float(off)


def mix_to_targets(docs: DataFrame, margins: Mapping[str, tuple[Column, float]], id_col: str = "doc_id", text_col: str = "text", budget: float = 1.0, seed: int = 23) -> DataFrame:
    """Every row of docs with its columns, and tokens, one mix_<margin> column a margin, probability, kept, and how the targets stand, as rake says:
    targets (hold, cannot_hold or not_yet) and targets_off (by which share a category of a margin is off at most).

    margins: name -> (category of a row, power of its token shares that is the target). Null categories are one category of their own.
    probability is the raked factor of the row's cell, scaled so that the largest is 1 and the expected tokens are `budget` of
    all at most: kept documents then have the target shares in every margin. Null and empty texts have no tokens: they weigh nothing
    and share the probability of their cell (scaled 1 if all of it is empty). Rows that repeat an id are kept or
    dropped together; rows with a null id draw by their text. Columns with the names of added ones are replaced, any others are free (a
    margin may use `tokens`, the count of words). Very long texts are counted whole. Empty tables give no rows.
    """
    added = ["tokens", "probability", "kept", "targets", "targets_off", *(f"mix_{m}" for m in margins)]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added))
    rows = docs.withColumn("tokens", words(F.col(text_col)))
    rows = rows.withColumns({f"mix_{m}": F.coalesce(c.cast("string"), F.lit("\u0000null")) for m, (c, _) in margins.items()})
    names = [f"mix_{m}" for m in margins]
    cells = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    factors, stand, off = rake(cells, {f"mix_{m}": p for m, (_, p) in margins.items()})
    fitted = written(factors, "fitted")
    told = {"targets": F.lit(stand), "targets_off": F.lit(off)}
    if fitted.isEmpty():
        return rows.withColumns({"probability": F.lit(0.0), "kept": F.lit(False), **told})
    top = fitted.where("tokens > 0").agg(F.max("factor").alias("most"), F.sum(F.col("tokens") * F.col("factor")).alias("sum"), F.sum("tokens").alias("all")).first()
    scale = min(1 / top["most"], budget * top["all"] / top["sum"]) if top["most"] else 0.0
    chances = fitted.select(*names, F.least(F.lit(1.0), F.col("factor") * scale).alias("probability"))
    if fitted.count() <= FEW_CELLS:
        met = rows.join(F.broadcast(chances), names)
    else:
        salt, = unused(rows, "salt")
        salted = chances.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn(salt, F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int")).join(salted, [*names, salt])
    what = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), what)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return met.withColumns({"kept": draw < F.col("probability"), **told}).select(*docs.columns, *added)
