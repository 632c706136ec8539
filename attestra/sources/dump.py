"""JSON dumps: documents that each hold rows of many tables, loaded as tables, with what is wrong in them as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..operators import closure


class Table(NamedTuple):
    """columns as in SQL; key: the one that tells rows apart; keep: `first` (a row that comes again is ignored) or `last` (it replaces)."""

    columns: str
    key: str
    keep: str = "last"


class Reference(NamedTuple):
    table: str
    column: str
    parent: str


def order_of(tables: Sequence[str], references: Sequence[Reference]) -> tuple[list[str], list[str]]:
    """(tables, parents before those that refer to them; tables that refer to each other in a circle or rest on such). References of a table to itself do not count."""
    rest, out = {t: {r.parent for r in references if r.table == t and r.parent != t} for t in tables}, []
    while free := sorted(t for t, parents in rest.items() if parents <= set(out)):
        out += free
        rest = {t: p for t, p in rest.items() if t not in free}
    return out, sorted(rest)


def read_dump(spark: SparkSession, path: str, tables: Mapping[str, Table], one_document: bool = False) -> dict[str, DataFrame]:
    """The tables of the documents at path: a document a line, or one a file if one_document. Each has an array of rows a table; tables it lacks
    are empty, columns too. Of rows with equal keys one is kept, as the table says, in the order of documents (by file, then by place) and rows."""
    kinds = {n: spark.createDataFrame([], t.columns).schema for n, t in tables.items()}
    schema = StructType([StructField(n, ArrayType(k)) for n, k in kinds.items()])
    documents = spark.read.schema(schema).option("multiLine", one_document).json(path).withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    out = {}
    for name, t in tables.items():
        rows = documents.select("_file", "_at", F.posexplode(name).alias("_row", "x")).select("_file", "_at", "_row", "x.*").where(F.col(t.key).isNotNull())
        best = (F.min if t.keep == "first" else F.max)(F.struct("_file", "_at", "_row"))
        kept = rows.groupBy(t.key).agg(best.alias("_p")).select(F.col(t.key).alias("_k"), "_p")
        out[name] = rows.withColumn("_mine", F.struct("_file", "_at", "_row")).join(kept, (F.col(t.key) == F.col("_k")) & (F.col("_mine") == F.col("_p"))).select(*kinds[name].names)
    return out


def problems(loaded: Mapping[str, DataFrame], tables: Mapping[str, Table], references: Sequence[Reference]) -> DataFrame:
    """table, key, column, value and problem of what does not fit: orphan (the parent is not there), row_cycle (a row of a table that refers to itself is its own
    ancestor, or rests on one that is) and table_cycle (tables refer to each other in a circle, so none can be loaded first; key and value are null)."""
    spark = next(iter(loaded.values())).sparkSession
    circle = order_of(list(tables), references)[1]
    out = [spark.createDataFrame([(r.table, None, r.column, None, "table_cycle") for r in references if r.table in circle and r.parent in circle and r.table != r.parent], "table string, key string, column string, value string, problem string")]
    text = lambda c: F.col(c).cast("string")
    for r in references:
        key, parent_key = tables[r.table].key, tables[r.parent].key
        rows = loaded[r.table].select(text(key).alias("key"), text(r.column).alias("value"))
        known = loaded[r.parent].select(text(parent_key).alias("value")).distinct()
        told = lambda df, problem, r=r: df.select(F.lit(r.table).alias("table"), "key", F.lit(r.column).alias("column"), "value", F.lit(problem).alias("problem"))
        orphans = rows.where("value IS NOT NULL").join(known, "value", "left_anti")
        out.append(told(orphans, "orphan"))
        if r.table == r.parent:
            # What hangs on no root: children are followed from rows without a parent, or with one that is not there.
            tops = rows.where("value IS NULL").select("key").unionByName(orphans.select("key"))
            edges = rows.where("value IS NOT NULL").select(F.lit("").alias("kind"), F.col("value").alias("id"), F.lit("").alias("to_kind"), F.col("key").alias("to_id"))
            held = closure.reached(tops.select(F.lit("").alias("kind"), F.col("key").alias("id"), F.col("key").alias("cause")), edges).select(F.col("id").alias("key"))
            out.append(told(rows.join(held, "key", "left_anti"), "row_cycle"))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every
