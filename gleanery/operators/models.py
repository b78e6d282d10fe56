"""Seams for models: each has a deterministic default, and takes a factory that is called once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import text


def summarized(df: DataFrame, column: str = "content", factory: Callable[[], Callable[[str], str | None]] | None = None, cut: int = 4000) -> DataFrame:
    """df with summary; rows for which the model fails or says nothing are dropped. Default: leading sentences."""
    if factory is None:
        return df.withColumn("summary", text.lead_summary(F.col(column), cut=cut)).where("summary <> ''")

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()

        def one(t: str) -> str | None:
            try:
                return model(t)
            except Exception:  # a failed summary drops its row, by the rule
                return None

        for batch in batches:
            yield batch.map(one, na_action="ignore")

    udf = F.pandas_udf(each, "string")
    return df.withColumn("summary", udf(F.left(column, F.lit(cut)))).where("summary is not null and summary <> ''")


def embedded(df: DataFrame, vectors: DataFrame, key: str, vector_key: str = "vec_id") -> DataFrame:
    """df with the precomputed embedding of each row; null where there is none."""
    return df.join(vectors.select(F.col(vector_key).alias(key), "embedding"), key, "left")


def sized_topics(df: DataFrame, topic: str = "topic", least: int | None = None) -> DataFrame:
    """Topics of fewer than `least` rows become -1 (3 below 60 rows, else 5); with over 75 % of at least 20 rows
    as outliers, topics of 2 rows are let in again."""
    whole = Window.partitionBy(F.lit(0))
    counts = df.groupBy(topic).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(whole)
    bound = F.lit(least) if least is not None else F.when(total < 60, 3).otherwise(5)
    out = F.sum(F.when((F.col("_n") < bound) | (F.col(topic) == -1), F.col("_n")).otherwise(0)).over(whole)
    retry = (out / total > 0.75) & (total >= 20)
    kept = counts.withColumn("_kept", F.when((F.col(topic) != -1) & (F.col("_n") >= F.when(retry, 2).otherwise(bound)), F.col(topic)).otherwise(-1))
    return df.join(kept.select(topic, "_kept"), topic).withColumn(topic, F.col("_kept")).drop("_kept")
