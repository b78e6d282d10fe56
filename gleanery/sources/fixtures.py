"""Views of the test tables that stand for the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.operators.scoring import Lexicon

LEXICON = Lexicon(
    ["queen", "tion", "mentoi", "étion", "ring", "other", "with the", "thorin thention ringer"],
    {"queen": 3.0, "tion": 2.0, "mentoi": 4.0, "étion": 2.5, "ring": 1.0, "with the": 1.5, "thorin thention ringer": 2.0},
    [(("queen", "tion"), 1.0), (("étion", "mentoi"), 0.8)],
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_add("MINUTE", F.col("doc_id") * 7919 % 43200, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return d.select(F.col("doc_id").alias("ord"), F.concat(F.lit("article-"), F.col("doc_id").cast("string")).alias("id"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.left("text", F.lit(200)).alias("summary"), F.col("source").alias("publication"), F.col("text").alias("content"), at.alias("collected_at"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("signature"), F.col("event_type").alias("publication"), F.concat(F.lit("event://"), F.col("event_id").cast("string")).alias("url"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("ord"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("ord"), "url", urls.host(F.col("url")).alias("publication"), F.when(F.col("page_id") % 3 != 0, "sitemap").otherwise("rss").alias("candidate_source"), (F.col("page_id") * 37 % 101 / 10.0).alias("score"), "html")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    what = F.when(F.col("event_type") == "error", "http_403").when(F.col("event_type") == "signup", "low_score").otherwise("accepted")
    return e.select(F.col("user_id").alias("publication"), F.col("event_id").alias("ord"), what.alias("outcome"), F.col("value").alias("score"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("ord"))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return c.where("ord % 4 = 0").select("ord", urls.article_id(F.col("url")).alias("article_id"), F.concat(F.lit("2024-W0"), (F.col("ord") % 3 + 1).cast("string")).alias("week_key"), F.when(F.col("ord") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit(" u"), (F.col("ord") % 2).cast("string"))).alias("user"))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return c.select("ord", F.when(F.col("ord") % 7 == 0, "").otherwise(F.concat(F.lit("List "), (F.col("ord") % 5).cast("string"))).alias("list_name"), "publication", urls.base(F.col("url")).alias("base_url"), F.when(F.col("ord") % 4 == 0, F.lit(None)).when(F.col("ord") % 4 == 1, "").when(F.col("ord") % 4 == 2, "true").otherwise("FALSE").alias("active"))
