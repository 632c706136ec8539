"""Views over append-only ledgers that are kept up to date: from a batch of new rows the touched keys are found through every join of the view, those
alone are worked out anew, and what changed is appended as signed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key
from .tables import written

#: Rows up to which touched keys are broadcast to the ledgers; beyond, both are shuffled.
FEW = 1_000_000


class Ledger(NamedTuple):
    """A table that only grows. Of the rows of equal keys the last by `order` (which must be total) is current."""

    name: str
    keys: tuple[str, ...]
    order: tuple[str, ...]


class Must(NamedTuple):
    """What a row needs: a current row of source (a ledger, or what stands of a view) with equal columns (own -> source's); absent: that there is none."""

    source: Ledger | View
    on: Mapping[str, str]
    absent: bool = False


class View(NamedTuple):
    """The current rows of a ledger for which the SQL condition holds and that have all they need."""

    base: Ledger
    where: str | None = None
    needs: tuple[Must, ...] = ()


def _base(source: Ledger | View) -> Ledger:
    return source.base if isinstance(source, View) else source


def _near(rows: DataFrame, keys: DataFrame, on: Mapping[str, str], null_safe: bool = False) -> DataFrame:
    """rows whose columns equal those of keys (a written table: broadcast if its counted rows are few)."""
    side = keys.select(*(F.col(theirs).alias(f"_{k}_near") for k, theirs in enumerate(on.values())))
    equal = [F.col(mine).eqNullSafe(F.col(f"_{k}_near")) if null_safe else F.col(mine) == F.col(f"_{k}_near") for k, mine in enumerate(on)]
    return rows.join(F.broadcast(side) if keys.count() <= FEW else side, reduce(lambda a, b: a & b, equal), "left_semi")


def _with_keys(rows: DataFrame, keys: DataFrame, ledger: Ledger) -> DataFrame:
    return _near(rows, keys, {k: k for k in ledger.keys}, null_safe=True)


def standing(source: Ledger | View, tables: Mapping[str, DataFrame], keys: DataFrame | None = None) -> DataFrame:
    """The rows that stand; keys (a written table): only those of these keys of the base. Then every other ledger is read for what they join with alone."""
    base = _base(source)
    rows = tables[base.name] if keys is None else _with_keys(tables[base.name], keys, base)
    now = latest_per_key(rows, base.keys, base.order).select(*rows.columns)
    if isinstance(source, Ledger):
        return now
    now = now.where(source.where) if source.where else now
    if keys is not None and source.needs:
        now = written(now, "near")
    for must in source.needs:
        theirs = _base(must.source)
        of = None
        if keys is not None:
            # All versions of the other side's rows, since an older one may have had other columns.
            wanted = written(now.select(*must.on).distinct(), "wanted")
            of = written(_near(tables[theirs.name], wanted, {b: a for a, b in must.on.items()}).select(*theirs.keys).distinct(), "keys")
        held = standing(must.source, tables, of).select(*(F.col(b).alias(f"_{k}_must") for k, b in enumerate(must.on.values())))
        equal = [F.col(a) == F.col(f"_{k}_must") for k, a in enumerate(must.on)]
        now = now.join(held, reduce(lambda a, b: a & b, equal), "left_anti" if must.absent else "left_semi")
    return now


def touched(source: Ledger | View, after: Mapping[str, DataFrame], batch: Mapping[str, DataFrame]) -> DataFrame | None:
    """The keys of the base whose standing the batch may change (a written table; None: none can). after: the ledgers with the batch in them."""
    base = _base(source)
    found = [batch[base.name].select(*base.keys)] if base.name in batch else []
    for must in source.needs if isinstance(source, View) else ():
        moved = touched(must.source, after, batch)
        if moved is not None:
            theirs = _base(must.source)
            met = written(_with_keys(after[theirs.name], moved, theirs).select(*must.on.values()).distinct(), "met")
            found.append(_near(after[base.name], met, must.on).select(*base.keys))
    return written(reduce(DataFrame.unionByName, found).distinct(), "touched") if found else None


def changes(view: View, state: DataFrame, before: Mapping[str, DataFrame], batch: Mapping[str, DataFrame]) -> DataFrame:
    """The view's columns and sign: 1 for a row that stands since the batch, -1 for one that no longer does.

    state: what stood before (`current` of all changes so far). before: the ledgers without the batch; batch: new rows by ledger. Rows of the batch that a ledger has
    already change nothing, so a batch may come again. Ledgers are semi-joined with the touched keys before anything is shuffled or aggregated; a batch that touches nothing runs
    no join. Null join columns meet nothing; null keys are keys of their own.
    """
    after = {n: t.unionByName(batch[n]) if n in batch else t for n, t in before.items()}
    keys = touched(view, after, batch)
    columns = state.columns
    if keys is None:
        return state.limit(0).withColumn("sign", F.lit(1))
    was = _with_keys(state, keys, view.base).withColumn("sign", F.lit(-1))
    now = standing(view, after, keys).select(*columns).withColumn("sign", F.lit(1))
    return was.unionByName(now).groupBy(*columns).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def current(log: DataFrame) -> DataFrame:
    """What stands after all changes of a log (columns and sign)."""
    columns: Sequence[str] = [c for c in log.columns if c != "sign"]
    return log.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign > 0").select(*columns)
