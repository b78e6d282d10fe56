"""Incremental ingest: drop repeated articles and count them by ISO week and publication.

The same functions serve batch and stream; `run_once` takes what has landed so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Repeats are recognised, and weeks stay open, for so long.
LATENESS = "40 days"


def deduplicated(articles: DataFrame) -> DataFrame:
    """The first of the rows with one id: within the watermark where articles stream in."""
    if articles.isStreaming:
        return articles.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["id"])
    return articles.dropDuplicates(["id"])


def counts(articles: DataFrame) -> DataFrame:
    """week (its Monday), publication, n; the epoch was a Thursday, so weeks start four days after it."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return articles.groupBy(week.alias("w"), "publication").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("week"), "publication", "n")


def run_once(spark: SparkSession, source: str, schema: T.StructType, state: str, name: str = "weekly_counts") -> DataFrame:
    stream = spark.readStream.schema(schema).parquet(source)
    query = counts(deduplicated(stream)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
