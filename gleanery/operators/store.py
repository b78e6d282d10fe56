"""Table maintenance: results of upserts, deletes and appends as DataFrames, and sinks that write beside and then swap."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_value(df: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """Key-value scan: a later duplicate wins."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def last_n(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def first_alias(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns that exist, else empty."""
    there = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(""))


def upsert(table: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New values for keys that exist, new keys besides."""
    n = new.select(F.col(key), F.col(value).alias("_new"))
    return table.select(key, value).join(n, key, "full_outer").select(key, F.coalesce("_new", value).alias(value))


def replace_run(table: DataFrame, new: DataFrame, run: str) -> DataFrame:
    """The table without rows of the runs that new has, and new."""
    return table.join(new.select(run).distinct(), run, "left_anti").select(*table.columns).unionByName(new)


def insert_absent(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.unionByName(new.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti").select(*table.columns))


def delete_first(table: DataFrame, matches: Column, order: str = "ord") -> DataFrame:
    """Without the first row that matches."""
    first = table.where(matches).agg(F.min(order).alias("_first"))
    return table.join(F.broadcast(first), F.col(order) == F.col("_first"), "left_anti")


def updated(table: DataFrame, matches: Column, column: str, value: Column) -> DataFrame:
    return table.withColumn(column, F.when(matches, value).otherwise(F.col(column)))


def ragged(df: DataFrame) -> DataFrame:
    """Without rows that are blank everywhere; missing cells are empty."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns if c.strip()]
    out = df.select(*cells)
    return out.where(F.concat_ws("", *[F.trim(F.col(f"`{c}`")) for c in out.columns]) != "")


def numbered_ids(number: Column, day: str) -> Column:
    return F.concat(F.lit(f"article-{day}-"), number.cast("string"))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with its place (from 1) in an order, without bringing all rows together.

    Rows are sorted by range and written with their place in their partition; each partition's first
    number is the sum of the sizes before it, of which there is one for each partition."""
    spark = df.sparkSession
    path = work_path(spark, "numbered")
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(starts), "_part").withColumn(name, number).select(*df.columns, name)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where none is set and the master is local."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = "file:///tmp/checkpoints/gleanery"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite_runs(df: DataFrame, path: str, run: str) -> None:
    """Replace-by-run sink: only the partitions of df's runs are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report_line(title: Column, url: Column, author: Column, summary: Column) -> Column:
    return F.concat(F.lit("* ["), F.coalesce(title, F.lit("")), F.lit("]("), F.coalesce(url, F.lit("")), F.lit(") by "), F.coalesce(author, F.lit("Unknown")), F.lit(" - "), F.coalesce(summary, F.lit("")))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
