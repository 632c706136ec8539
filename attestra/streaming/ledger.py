"""The append-only ledger as a stream: idempotent ingestion, and latest states kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, path: str, schema, out: str, checkpoint: str, key: str, at: str, late: str = "30 days") -> None:
    """Appends the rows of new files under path to out, each key once (within the watermark), until no file is left."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(rows: DataFrame, at: str, width: str, kind: str, late: str = "1 hour") -> DataFrame:
    """Counts by kind in tumbling windows; works on streams and tables."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))
