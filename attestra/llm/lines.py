"""Line dedup, with DataFrame functions only.

Normalised lines are exploded as fixed-size hashes with their positions, distinct documents are counted per hash, and the documents get
back the positions of the lines they lose. Line texts are never shuffled; each text is once, to meet its list of
lost positions, and is put together again in line order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, unused, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WS)), _UPPER, _UPPER.lower())


def _hash(key: Column) -> Column:
    """96 bits and the length: one in 2**90 pairs of different lines of one length would meet."""
    return F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b"), F.length(key).alias("n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Every row of docs, with all its columns; text_col loses the lines whose key has min_chars code points or more and is found
    in min_docs documents or more, except in the document of the largest id among those holding it. Three columns are added:
    n_lines (before), n_dropped and kept_text.

    Null and empty texts are one empty line. Documents are told apart by their id: rows that repeat an id count as one
    document and lose the same lines. Rows with a null id count for no line and lose none. text_col itself is left as
    it was. Columns of docs named n_lines, n_dropped or kept_text are replaced; any other names are free. Very long texts are
    taken whole, in time linear in their lines. Empty tables give no rows.

    A key that a third of all documents hold: its rows are first spread by (key, document), counted with partial sums,
    and met with its one total in a join whose large side AQE may split.
    """
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    keys = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key"))), lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(keys, lambda x: F.struct(x["pos"].alias("pos"), _hash(x["key"]).alias("h")))
    # Rows are known by id and text, as rows that repeat an id may differ in text.
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    held = rows.where(F.col("doc").isNotNull() & (F.length("text") >= min_chars)).select("doc", "th", F.explode(hashed).alias("x")).select("doc", "th", F.col("x.pos").alias("pos"), F.col("x.h.a").alias("a"), F.col("x.h.b").alias("b"), F.col("x.h.n").alias("n"))
    # Both written: the join then reads two tables, and Spark may split a frequent line's rows.
    held = written(held, "lines")
    common = held.select("doc", "a", "b", "n").distinct().groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= min_docs).drop("docs")
    common = written(common, "common-lines")
    mine, its, lost_at = unused(docs, "doc", "th", "lost")
    lost = held.join(common, ["a", "b", "n"]).where(F.col("doc") < F.col("last")).groupBy(F.col("doc").alias(mine), F.col("th").alias(its)).agg(F.collect_list("pos").alias(lost_at))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    own = [F.col(f"`{c}`") for c in names]
    joined = docs.select(*own).join(lost.hint("shuffle_hash"), (F.col(f"`{id_col}`") == F.col(mine)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(its)), "left")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    # Positions that stay, and the lines there; named once, so that the text is split once.
    named = F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("l"), F.col(lost_at).alias("x"))), lambda s: F.struct(s["l"].alias("l"), F.array_except(F.sequence(F.lit(0), F.size(s["l"]) - 1), s["x"]).alias("k")))
    kept = F.element_at(F.transform(named, lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["l"], i)), "\n")), 1)
    dropped = F.coalesce(F.size(F.array_distinct(F.col(lost_at))), F.lit(0)).cast("long")
    return joined.select(*own, n_lines.cast("long").alias("n_lines"), F.when(F.col(lost_at).isNull(), 0).otherwise(dropped).alias("n_dropped"), F.when(F.col(lost_at).isNull(), text).otherwise(kept).alias("kept_text"))
