"""Joins over ranges [first, end) of whole numbers, by dyadic bins.

A range is the disjoint union of few bins whose widths are powers of two (two a width at most, widths up to its own length); a place lies in one
bin of each width. So "this place lies in that range" is an equality of bins that holds for exactly one bin of the range: no pair is met
twice, none is met in vain, and no join needs more than hashing or sorting by (keys, bin). A frequent key is spread over its bins. Two ranges
overlap where one begins inside the other, or both begin at one place. Work is linear in ranges, times their bins, plus what is found.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import written

_LEVELS = "array<int>"


def _floor(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def bins_of_range(first: Column, end: Column) -> Column:
    """array<struct<level, bin>>: the bins that a range consists of; none if it is empty."""
    first, end = first.cast("long"), end.cast("long")
    size = F.greatest(end - first, F.lit(1))
    levels = F.sequence(F.lit(0), F.floor(F.log2(size.cast("double"))).cast("int") + 1)
    up = lambda x, level: -_floor(-x, level)
    node = lambda level, bin_: F.struct(level.alias("level"), bin_.alias("bin"))

    def of_level(level: Column) -> Column:
        a, z = up(first, level), _floor(end, level)
        left = F.when((a < z) & (F.pmod(a, F.lit(2)) == 1), node(level, a))
        right = F.when((a < z) & (F.pmod(z, F.lit(2)) == 1), node(level, z - 1))
        return F.array(left, right)

    found = F.filter(F.flatten(F.transform(levels, of_level)), lambda x: x.isNotNull())
    return F.when(first < end, found)


def bins_of_place(at: Column, levels: Column) -> Column:
    """array<struct<level, bin>>: the bins of these widths that a place lies in."""
    return F.transform(levels, lambda level: F.struct(level.alias("level"), _floor(at.cast("long"), level).alias("bin")))


def _with_bins(rows: DataFrame, bins: Column) -> DataFrame:
    return rows.withColumn("_b", F.explode(bins)).withColumns({"_level": F.col("_b.level"), "_bin": F.col("_b.bin")}).drop("_b")


def _binned(ranges: DataFrame, places: DataFrame, first: Column, end: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """ranges and places with a row a bin; places only have bins of widths that ranges have."""
    ranges = _with_bins(ranges, bins_of_range(first, end))
    levels = ranges.agg(F.collect_set("_level").alias("_levels"))  # one row, of 64 numbers at most
    return ranges, _with_bins(places.crossJoin(F.broadcast(levels)), bins_of_place(at, F.col("_levels"))).drop("_levels")


def places_in_ranges(places: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, first: str, end: str) -> DataFrame:
    """Each place with each range of equal keys that holds it (first <= at < end): the columns of both. Null keys and bounds meet nothing."""
    ranges, places = _binned(ranges, places.where(F.col(at).isNotNull()), F.col(first), F.col(end), F.col(at))
    return places.join(ranges, [*keys, "_level", "_bin"]).drop("_level", "_bin")


def _sides(left: DataFrame, right: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """left and right with a row a bin and _kind: where left's start meets a range of right's, right's start one of left's, or both start at one place."""
    proper = lambda df: df.where(F.col(start) < F.col(end))
    valid = lambda df: df.where(F.col(start) <= F.col(end))
    inner = F.col(start).cast("long") + 1
    ranges_r, places_l = _binned(proper(right), valid(left), inner, F.col(end), F.col(start))
    ranges_l, places_r = _binned(proper(left), valid(right), inner, F.col(end), F.col(start))
    same = lambda df: proper(df).withColumns({"_level": F.lit(-1), "_bin": F.col(start).cast("long")})
    kind = lambda df, k: df.withColumn("_kind", F.lit(k))
    l_ = kind(places_l, 0).unionByName(kind(ranges_l, 1)).unionByName(kind(same(left), 2))
    r_ = kind(ranges_r, 0).unionByName(kind(places_r, 1)).unionByName(kind(same(right), 2))
    return l_, r_


_ON = ["_kind", "_level", "_bin"]


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", prefix: str = "other_") -> DataFrame:
    """Each pair of ranges of equal keys with left.start < right.end and right.start < left.end, once: left's columns, and right's but for the keys
    with `prefix`. An empty range (start = end) overlaps what begins before and ends behind it; ranges that end before they start, and those with null
    bounds or keys, overlap nothing."""
    l_, r_ = _sides(left, right, start, end)
    more = [c for c in right.columns if c not in keys]
    r_ = r_.select(*keys, *_ON, *(F.col(c).alias(prefix + c) for c in more))
    return l_.join(r_, [*keys, *_ON]).select(*left.columns, *(prefix + c for c in more))


#: Fixed value: positions of one key are swept in chunks of 2^20.
_CHUNK = 20


def overlaps_among(ranges: DataFrame, keys: Sequence[str], id_col: str, start: str = "start", end: str = "end", prefix: str = "other_") -> DataFrame:
    """Each pair of ranges of one table with equal keys and different ids that overlap, as `overlap_pairs` has it, once: the one that begins first, then (with `prefix`)
    the other's columns but for the keys; of two that begin at one place the smaller id comes first.

    Ranges are shuffled once and swept in order; only those that meet another go on to bins, and only as what they meet it as.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    held = ranges.where(known & (F.col(start) <= F.col(end))).withColumn("_chunk", F.shiftright(F.col(start).cast("long"), _CHUNK))
    # What reaches into a chunk from those before it; in a chunk, ranges that only may meet another pass.
    chunks = held.groupBy(*keys, "_chunk").agg(F.max(F.col(end)).alias("_to"))
    before = F.max("_to").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    first = F.shiftleft("_chunk", _CHUNK)
    carried = chunks.withColumn("_to", before).where(F.col("_to") > first).select(*keys, (first - 1).cast(held.schema[start].dataType).alias(start), F.col("_to").alias(end), "_chunk")
    swept = held.withColumn("_real", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_chunk").orderBy(start)
    a, z, next_ = F.col(start), F.col(end), F.lead(start).over(w)
    inside = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) > a, F.lit(False))
    holds = (a < z) & (F.coalesce(next_, F.shiftleft(F.col("_chunk") + 1, _CHUNK)) < z)
    same = (a < z) & F.coalesce((next_ == a) | (F.lag(start).over(w) == a), F.lit(False))
    met = swept.select(*ranges.columns, "_real", inside.alias("_inside"), holds.alias("_holds"), same.alias("_same")).where("_real AND (_inside OR _holds OR _same)")
    met = written(met.drop("_real"), "met")
    more = [c for c in ranges.columns if c not in keys]
    renamed = lambda df, *own: df.select(*keys, *own, *(F.col(c).alias(prefix + c) for c in more))
    columns = [*ranges.columns, *(prefix + c for c in more)]
    later = places_in_ranges(renamed(met.where("_inside")), met.where("_holds").withColumn("_inner", F.col(start).cast("long") + 1), keys, prefix + start, "_inner", end)
    together = met.where("_same").join(renamed(met.where("_same"), start), [*keys, start])
    return later.where(F.col(id_col) != F.col(prefix + id_col)).select(columns).unionByName(together.where(F.col(id_col) < F.col(prefix + id_col)).select(columns))


def places_swept(places: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, first: str, end: str) -> DataFrame:
    """What `places_in_ranges` returns, for ranges few of which overlap (keys and columns apart, their names must differ from those of places).

    Places and ranges are shuffled once, and swept in order chunk by chunk: of the ranges that begin at or before a place, the last one alone can hold it if all others
    end before. Only places that an earlier range holds too, and ranges longer than a chunk, go on to bins. A range that reaches into the next chunk is in both.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    more = [c for c in ranges.columns if c not in keys]
    columns = [*places.columns, *more]
    held, asked = ranges.where(known & (F.col(first) < F.col(end))), places.where(known & F.col(at).isNotNull())
    long_ = F.col(end).cast("long") - F.col(first).cast("long") > 1 << _CHUNK
    chunk = lambda c: F.shiftright(c.cast("long"), _CHUNK)
    one = held.where(~long_).withColumn("_chunk", F.explode(F.array_distinct(F.array(chunk(F.col(first)), chunk(F.col(end) - 1)))))
    one = one.select(*keys, "_chunk", F.col(first).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col(end).cast("long").alias("_to"), F.struct(*more).alias("_range"))
    rows = asked.select(*keys, chunk(F.col(at)).alias("_chunk"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*places.columns).alias("_row"))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_at", "_kind")
    swept = one.unionByName(rows, allowMissingColumns=True).withColumn("_before", F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    range_ = F.when(F.col("_kind") == 0, F.struct("_to", "_before", "_range"))
    swept = swept.withColumn("_last", F.last(range_, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    several = F.coalesce(F.col("_last._before") > F.col("_at"), F.lit(False))
    met = swept.where((F.col("_kind") == 1) & (several | (F.col("_last._to") > F.col("_at"))))
    met = written(met.select(several.alias("_several"), "_row", F.when(~several, F.col("_last._range")).alias("_range")), "swept")
    out = met.where("NOT _several").select("_row.*", "_range.*").select(columns)
    if not met.where("_several").isEmpty():
        out = out.unionByName(places_in_ranges(met.where("_several").select("_row.*"), held.where(~long_), keys, at, first, end).select(columns))
    if not held.where(long_).isEmpty():
        out = out.unionByName(places_in_ranges(asked, held.where(long_), keys, at, first, end).select(columns))
    return out


def not_overlapping(spans: DataFrame, others: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The rows of spans that overlap no range of others, as `overlap_pairs` has it; no pair and no bin is listed.

    A span overlaps some range if, of those that begin before its end, the one that ends last ends behind its start: one running maximum over both, by where ranges
    begin and spans end. A key's positions are swept chunk by chunk, each chunk knowing the maximum of those before it, so that no key is one task's work.
    """
    held = lambda df: df.where(F.col(start) <= F.col(end))
    chunk = F.shiftright("_at", _CHUNK).alias("_chunk")
    known = [F.col(k).isNotNull() for k in keys]
    ranges = held(others).where(reduce(lambda a, b: a & b, known)).groupBy(*keys, F.col(start).cast("long").alias("_at")).agg(F.max(F.col(end).cast("long")).alias("_to")).select(*keys, "_at", chunk, "_to")
    none = F.lit(None).cast("long").alias("_to")
    at = spans.select(*keys, F.col(end).cast("long").alias("_at"), F.struct(*spans.columns).alias("_row"))
    swept = at.select(*keys, "_at", chunk, none, "_row")
    chunks = ranges.select(*keys, "_chunk", "_to").unionByName(swept.select(*keys, "_chunk", "_to")).groupBy(*keys, "_chunk").agg(F.max("_to").alias("_to"))
    before = F.max("_to").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    carried = chunks.withColumn("_to", before).where("_to IS NOT NULL").select(*keys, (F.shiftleft("_chunk", _CHUNK) - 1).alias("_at"), "_chunk", "_to")
    every = ranges.unionByName(carried).unionByName(swept, allowMissingColumns=True)
    furthest = F.max("_to").over(Window.partitionBy(*keys, "_chunk").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1))
    own = lambda c: F.col("_row")[c]
    met = F.coalesce((own(start) <= own(end)) & (furthest > own(start)), F.lit(False))
    return every.withColumn("_met", met).where("_row IS NOT NULL AND NOT _met").select("_row.*")


def overlapping(spans: DataFrame, others: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The different (keys, start, end) of spans that overlap some range of others; the pairs are not listed."""
    own = spans.select(*keys, start, end).distinct()
    return own.exceptAll(not_overlapping(own, others, keys, start, end))
