"""Intermediate tables in the folder that driver and executors share, and what tables can do."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder of this driver if it runs all tasks itself (tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="attestra-work-"))
        path = _own[0]
    return path.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the work folder, read again: cuts the lineage, and lost executors lose nothing of it."""
    path = f"{work_folder(df.sparkSession)}/attestra-engine/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that one task is given by `spread`, about.
ROWS = 1 << 19


def spread(df: DataFrame, *keys: Column | str, rows: int | None = None) -> DataFrame:
    """df shuffled by keys into as many partitions as its rows ask for, so that what a task holds of them does not grow with the table. rows: how many
    there are, counted if not given."""
    return df.repartition((df.count() if rows is None else rows) // ROWS + 1, *keys)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python by bytes and by fewer rows, so that long texts cannot add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # not in this version
        pass


def require_columns(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    """df itself; an error that names all columns it lacks."""
    if lacking := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{table} lacks {', '.join(lacking)}")
    return df


def column_or_null(df: DataFrame, column: str, kind: str = "string") -> Column:
    """The column, or null where df does not have it."""
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)
