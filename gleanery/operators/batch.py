"""The whole run: collect, summarise, append, and say in a key-value table how far it came."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import models, ranking, store


@dataclass(frozen=True)
class Run:
    """The tables that a run has written: articles, and state (key, value, ord)."""

    articles: DataFrame
    state: DataFrame


def run(spark: SparkSession, candidates: DataFrame, feeds: DataFrame, texts: DataFrame, articles_path: str, state_path: str, factory: Callable | None = None, **rule) -> Run:
    """candidates and feeds as ranking.collected_with_feeds takes them; texts: publication, url, ord, content.

    Articles are appended with their scores rounded to two digits and a summary; those without one are dropped.
    An error is kept in the state, cut to 200 characters, and raised."""
    step = 0

    def say(**values: str) -> None:
        nonlocal step
        step += 1
        store.append(spark.createDataFrame([(k, v, step) for k, v in values.items()], "key string, value string, ord long").coalesce(1), state_path)

    try:
        say(status="initializing", progress="0/4")
        say(status="collecting", progress="1/4")
        kept = ranking.collected_with_feeds(candidates, feeds, **rule)
        say(status="summarizing", progress="2/4")
        rows = models.summarized(kept.join(texts, ["publication", "url", "ord"]), "content", factory)
        out = rows.select("publication", "url", "ord", F.round("score", 2).alias("score"), "rank", F.lit("Unknown").alias("journalist"), "summary")
        store.append(out, articles_path)
        written = spark.read.schema(out.schema).parquet(articles_path)
        say(status="complete", progress="4/4", rows_written=str(written.count()))
    except Exception as e:
        say(status="failed", message=f"Pipeline failed: {str(e)[:200]}")
        raise
    return Run(written, spark.read.schema("key string, value string, ord long").parquet(state_path))
