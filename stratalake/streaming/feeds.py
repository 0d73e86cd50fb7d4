"""Structured Streaming over event files: keyed appends to a table, and sessions for coverage gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.sources.store import TableStore


def append_keyed(spark: SparkSession, store: TableStore, source: str, schema: str, table: str, keys: list[str], order: list[str], checkpoint: str):
    """Takes in the Parquet files of a folder that haven't been taken in yet, and stops; rows whose key the table holds are left out, so a repeated batch adds nothing."""
    feed = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        store.append_new(table, batch, keys, order)

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(feed: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key, closed by a gap: begin, end and number of events; rows later than `late` are dropped once their session is out."""
    return feed.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begins_at"), F.col("w.end").alias("ends_at"), "n")
