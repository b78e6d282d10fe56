"""Trends: counts of a window against preceding windows of equal length."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import urls
from gleanery.operators import store


def slice_of(ts: Column, start: dt.date, days: int) -> Column:
    """0 in [start, start + days), i in the i-th window before it, negative after it."""
    origin = F.lit(dt.datetime.combine(start, dt.time())).cast("timestamp_ntz")
    gap = F.timestamp_diff("MICROSECOND", origin, ts)
    return -F.floor(gap / F.lit(days * 86_400_000_000))


def windowed(mentions: DataFrame, start: dt.date, days: int, slices: int) -> DataFrame:
    """Mentions (signature, publication, url, ts, ord) in the window or its history, with slice; a range on ts that scans can use."""
    low, high = (F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz") for d in (start - dt.timedelta(days=days * slices), start + dt.timedelta(days=days)))
    return mentions.where((F.col("ts") >= low) & (F.col("ts") < high)).withColumn("slice", slice_of(F.col("ts"), start, days))


def counted(mentions: DataFrame, slices: int) -> DataFrame:
    """signature, count_current, history (sum over slices), baseline, publication_count: one shuffle, pre-aggregated."""
    now = F.col("slice") == 0
    publication = F.when(now, F.nullif(F.trim("publication"), F.lit("")))
    return mentions.groupBy("signature").agg(F.count_if(now).alias("count_current"), F.count_if(~now).alias("history"), F.countDistinct(publication).alias("publication_count")).withColumn("baseline", F.col("history") / F.lit(float(slices)))


def supporting_urls(mentions: DataFrame, n: int = 3) -> DataFrame:
    """signature, supporting_urls: the first n distinct urls of the window in input order."""
    seen = mentions.where("slice = 0 and url <> ''").groupBy("signature", "url").agg(F.min("ord").alias("ord"))
    first = seen.withColumn("n", F.row_number().over(Window.partitionBy("signature").orderBy("ord"))).where(F.col("n") <= n)
    return first.groupBy("signature").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"]), " | ").alias("supporting_urls"))


def measured(df: DataFrame) -> DataFrame:
    c, b = F.col("count_current"), F.col("baseline")
    lift = (c + 1) / (b + 1)
    return df.withColumn("lift", lift).withColumn("pct_change", (c - b) / (b + 1) * 100).withColumn("score", lift * F.log1p(c.cast("double")))


def gate(df: DataFrame, min_mentions: int = 2, min_lift: float = 1.2, min_publications: int = 1) -> DataFrame:
    """df with reason: pass, or the first gate that fails."""
    return df.withColumn("reason", F.when(F.col("count_current") < min_mentions, "mentions").when(F.col("publication_count") < min_publications, "publications").when(F.col("lift") < min_lift, "lift").otherwise("pass"))


def trends(mentions: DataFrame, start: dt.date, days: int, slices: int = 4, min_mentions: int = 2, min_lift: float = 1.2, min_publications: int = 1, top_n: int | None = 25) -> DataFrame:
    inside = windowed(mentions, start, days, max(1, slices))
    passing = gate(measured(counted(inside, max(1, slices))), min_mentions, min_lift, min_publications).where("reason = 'pass'")
    out = passing.join(supporting_urls(inside), "signature", "left").select(
        "signature", "count_current", F.round("baseline", 3).alias("baseline"), F.round("pct_change", 2).alias("pct_change"), F.round("score", 4).alias("trend_score"), "publication_count", F.coalesce("supporting_urls", F.lit("")).alias("supporting_urls")
    )
    return out if top_n is None else out.orderBy(F.desc("trend_score"), F.desc("count_current"), "signature").limit(top_n)


def article_trends(articles: DataFrame, words: DataFrame, start: dt.date, days: int, slices: int, run_id: str, week_key: str, hosts: DataFrame | None = None, stopwords: Sequence[str] = (), min_mentions: int = 2, min_lift: float = 1.2, min_publications: int = 1, top_n: int = 25, window_mode: str = "custom") -> DataFrame:
    """Trend rows of articles (ord, url, publication, ts, topic) with the words (topic, words) of their topics.

    Only articles of the list's hosts count; topics whose first words without stopwords agree are one signature, shown
    by its first topic's label; where over 75 % of the rows have no topic (-1), one mention less is needed, one at
    least; where nothing passes, a row __NO_TRENDS__ says so."""
    kept = articles if hosts is None else articles.withColumn("_host", urls.host(F.col("url"))).join(hosts.select(F.col("host").alias("_host")), "_host", "left_semi").drop("_host")
    inside = windowed(kept, start, days, max(1, slices))
    clean = F.filter("words", lambda w: ~w.isin(*stopwords)) if stopwords else F.col("words")
    named = words.where("topic <> -1").select("topic", signature(clean).alias("signature"), label(clean).alias("label"))
    labels = named.groupBy("signature").agg(F.min_by("label", "topic").alias("keyword"))
    mentions = inside.join(named.select("topic", "signature"), "topic")
    bound = inside.agg(F.coalesce(F.count_if(F.col("topic") == -1) / F.count("*") > 0.75, F.lit(False)).alias("sparse"))
    # one row joined to all: a scalar
    counts = measured(counted(mentions, max(1, slices))).join(F.broadcast(bound), F.lit(True))
    least = F.when(F.col("sparse"), max(1, min_mentions - 1)).otherwise(min_mentions)
    passing = counts.where((F.col("count_current") > 0) & (F.col("count_current") >= least) & (F.col("publication_count") >= min_publications) & (F.col("lift") >= min_lift))
    out = passing.join(supporting_urls(mentions), "signature", "left").join(labels, "signature").select(
        F.lit(run_id).alias("trend_run_id"), F.lit(week_key).alias("week_key"), "keyword", "count_current", F.round("baseline", 3).alias("baseline_4wk"), F.round("pct_change", 2).alias("pct_change"), F.round("score", 4).alias("trend_score"),
        "publication_count", F.coalesce("supporting_urls", F.lit("")).alias("supporting_urls"), F.lit("trending").alias("status"), F.lit(window_mode).alias("window_mode"),
    )
    best = out.orderBy(F.desc("trend_score"), F.desc("count_current"), "keyword").limit(top_n)
    none = articles.sparkSession.range(1).select(*[F.lit(v).cast(out.schema[c].dataType).alias(c) for c, v in zip(out.columns, (run_id, week_key, "__NO_TRENDS__", 0, 0.0, 0.0, 0.0, 0, "", "no_trends", window_mode), strict=True)])
    return best.unionByName(none.join(best.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti"))


def topic_words(docs: DataFrame, topic: str = "topic", text: str = "text", stopwords: tuple[str, ...] = ("the", "of", "and", "to", "in", "a"), min_df: int = 2, n: int = 8) -> DataFrame:
    """topic, words: the n best 1- and 2-grams by class-based tf * ln(1 + A / f).

    The texts are read once: counts by topic and word are written and read again for the sums over words and topics."""
    token = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda t: (F.length(t) > 1) & ~t.isin(*stopwords))
    tokens = docs.select(F.col(topic).alias("topic"), token.alias("t"))
    pairs = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    grams = tokens.select("topic", F.array_sort(F.concat("t", pairs)).alias("g"))
    # a document's first copy of a word counts the document
    marked = F.transform("g", lambda w, i: F.struct(w.alias("word"), F.when((i > 0) & (w == F.try_element_at("g", i)), 0).otherwise(1).alias("new")))
    each = grams.select("topic", F.explode(marked).alias("x")).select("topic", "x.word", "x.new")
    path = store.work_path(docs.sparkSession, "topic-words")
    each.groupBy("topic", "word").agg(F.count("*").alias("tf"), F.sum("new").alias("df")).write.parquet(path)
    per_topic = docs.sparkSession.read.parquet(path)
    words = per_topic.groupBy("word").agg(F.sum("tf").alias("f"), F.sum("df").alias("docs")).where(F.col("docs") >= min_df)
    average = per_topic.groupBy("topic").agg(F.sum("tf").alias("words")).agg(F.avg("words").alias("average"))
    # one row joined to all: a scalar
    scored = per_topic.join(words, "word").join(F.broadcast(average), F.lit(True)).withColumn("weight", F.col("tf") * F.log1p(F.col("average") / F.col("f")))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 6)), "word"))).where(F.col("rank") <= n)
    return best.select("topic", "rank", "word", F.round("weight", 4).alias("weight"))


def signature(words: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 5), " | "), F.lit("")), F.lit("unknown-topic"))


def label(words: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 3), " | "), F.lit("")), F.lit("Unknown Topic"))
