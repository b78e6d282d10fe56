"""Catalogs of sources and lexicons as data files: JSON lines in any folder that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.operators.scoring import Lexicon

SOURCE = "topic string, publication string, base_url string, sitemap_url string, rss_feeds array<string>"
#: A line is a keyword with its weight, or a combination (terms) with its bonus.
ENTRY = "topic string, keyword string, weight double, terms array<string>, bonus double"


def sources(spark: SparkSession, path: str, topic: str | None = None, subset: list[str] | None = None) -> DataFrame:
    """Sources of a catalog by topic and name, in the order of the file's names; a name counts once, the last entry wins.

    Unknown names of a subset are skipped; addresses get a slash at the end, missing feeds are none."""
    rows = spark.read.schema(SOURCE).json(path).withColumn("ord", F.monotonically_increasing_id())
    rows = rows.where("trim(publication) <> ''") if topic is None else rows.where((F.trim("publication") != "") & (F.col("topic") == topic))
    rows = rows.where(F.col("publication").isin(*subset)) if subset else rows
    last = Window.partitionBy("topic", "publication").orderBy(F.desc("ord"))
    rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.select("topic", "publication", F.concat(F.rtrim("base_url", F.lit("/")), F.lit("/")).alias("base_url"), F.coalesce("sitemap_url", F.lit("")).alias("sitemap_url"), F.coalesce("rss_feeds", F.array().cast("array<string>")).alias("rss_feeds"))


def lexicon(spark: SparkSession, path: str, topic: str, most: int = 10_000) -> Lexicon:
    """The lexicon of a topic, in the order of its lines; it is unrolled into expressions, so it has `most` lines at most."""
    rows = spark.read.schema(ENTRY).json(path).where(F.col("topic") == topic).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon of over {most} lines")
    words = [r for r in rows if r["keyword"]]
    return Lexicon([r["keyword"] for r in words], {" ".join(r["keyword"].lower().split()): r["weight"] for r in words if r["weight"] is not None}, [(tuple(r["terms"]), r["bonus"] or 0.0) for r in rows if r["terms"]])
