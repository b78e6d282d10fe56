"""Trend queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gleanery.functions import dates, urls
from gleanery.operators import store, trends
from gleanery.plans.registry import ARTICLES, MENTIONS, host_sql, query
from gleanery.sources import fixtures

START, END, SLICES = dt.date(2024, 1, 22), dt.date(2024, 1, 28), 3
LOW, HIGH, DAYS = dates.trend_window(START, END, END)
SLICED = MENTIONS + """, sliced AS (SELECT *, -CAST(floor(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-22') AS DOUBLE) / 604800000000) AS BIGINT) AS slice FROM mentions
  WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-29'),
counted AS (SELECT signature, CAST(count(*) FILTER (WHERE slice = 0) AS BIGINT) AS count_current, CAST(count(*) FILTER (WHERE slice > 0) AS BIGINT) AS history,
  CAST(count(DISTINCT CASE WHEN slice = 0 THEN nullif(trim(publication), '') END) AS BIGINT) AS publication_count, CAST(count(*) FILTER (WHERE slice > 0) AS DOUBLE) / 3 AS baseline FROM sliced GROUP BY signature),
measured AS (SELECT *, (count_current + 1) / (baseline + 1) AS lift, (count_current - baseline) / (baseline + 1) * 100 AS pct_change, (count_current + 1) / (baseline + 1) * ln(1 + count_current) AS score FROM counted),
gated AS (SELECT *, CASE WHEN count_current < 2 THEN 'mentions' WHEN publication_count < 1 THEN 'publications' WHEN lift < 1.2 THEN 'lift' ELSE 'pass' END AS reason FROM measured),
seen AS (SELECT signature, url, min(ord) AS ord FROM sliced WHERE slice = 0 GROUP BY signature, url),
first3 AS (SELECT signature, string_agg(url, ' | ' ORDER BY ord) AS supporting_urls FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY ord) AS n FROM seen) WHERE n <= 3 GROUP BY signature)"""
OUT = "SELECT g.signature, count_current, round(baseline, 3) AS baseline, round(pct_change, 2) AS pct_change, round(score, 4) AS trend_score, publication_count, coalesce(supporting_urls, '') AS supporting_urls FROM gated g LEFT JOIN first3 f ON g.signature = f.signature WHERE reason = 'pass'"


def inside(spark, sf):
    return trends.windowed(fixtures.mentions(spark, sf), LOW, DAYS, SLICES)


@query("r6_trend_signals", OUT, SLICED)
def trend_signals(spark, sf):
    return trends.trends(fixtures.mentions(spark, sf), LOW, DAYS, SLICES, top_n=None)


@query("o3_top_trends", OUT + " ORDER BY trend_score DESC, count_current DESC, g.signature LIMIT 25", SLICED)
def top_trends(spark, sf):
    return trends.trends(fixtures.mentions(spark, sf), LOW, DAYS, SLICES)


@query("a1_a3_a5_counts", "SELECT signature, count_current, history, publication_count, baseline FROM counted", SLICED)
def counts(spark, sf):
    return trends.counted(inside(spark, sf), SLICES)


@query("a2_history_by_slice", "SELECT signature, slice, CAST(count(*) AS BIGINT) AS n FROM sliced WHERE slice > 0 GROUP BY signature, slice", SLICED)
def history(spark, sf):
    return inside(spark, sf).where("slice > 0").groupBy("signature", "slice").agg(F.count("*").alias("n"))


@query("a4_supporting_urls", "SELECT * FROM first3", SLICED)
def first_urls(spark, sf):
    return trends.supporting_urls(inside(spark, sf))


@query("a20_gate_funnel", "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM gated GROUP BY reason", SLICED)
def funnel(spark, sf):
    return trends.gate(trends.measured(trends.counted(inside(spark, sf), SLICES))).groupBy("reason").agg(F.count("*").alias("n"))


@query("j8_slice_join", "SELECT slice, CAST(count(*) AS BIGINT) AS n, CAST(min(ord) AS BIGINT) AS first_ord FROM sliced GROUP BY slice", SLICED)
def slices(spark, sf):
    return inside(spark, sf).groupBy("slice").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query("w8_preceding_windows", "SELECT signature, slice, n, sum(n) OVER (PARTITION BY signature ORDER BY slice ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS before FROM (SELECT signature, slice, CAST(count(*) AS BIGINT) AS n FROM sliced GROUP BY signature, slice)".replace("sum(n) OVER", "CAST(sum(n) OVER").replace("3 FOLLOWING)", "3 FOLLOWING) AS BIGINT)"), SLICED)
def preceding(spark, sf):
    from pyspark.sql.window import Window

    per = inside(spark, sf).groupBy("signature", "slice").agg(F.count("*").alias("n"))
    return per.withColumn("before", F.sum("n").over(Window.partitionBy("signature").orderBy("slice").rowsBetween(1, 3)))


TOPICS = ARTICLES + """, topics AS (SELECT a.*, e.label AS topic FROM articles a JOIN embeddings e ON a.ord = e.vec_id)"""


def topic_articles(spark, sf):
    return fixtures.articles(spark, sf).join(fixtures.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("label").alias("topic")), "ord")


@query("j6_article_topics", "SELECT ord, topic, publication FROM topics", TOPICS)
def article_topics(spark, sf):
    return topic_articles(spark, sf).select("ord", "topic", "publication")


@query("m4_topic_trends", "SELECT CAST(topic AS VARCHAR) AS signature, CAST(count(*) FILTER (WHERE collected_at >= TIMESTAMP '2024-01-22') AS BIGINT) AS count_current, CAST(count(*) FILTER (WHERE collected_at < TIMESTAMP '2024-01-22') AS BIGINT) AS history FROM topics WHERE collected_at >= TIMESTAMP '2024-01-01' AND collected_at < TIMESTAMP '2024-01-29' GROUP BY topic", TOPICS)
def topic_trends(spark, sf):
    rows = topic_articles(spark, sf).select(F.col("topic").cast("string").alias("signature"), "publication", F.col("id").alias("url"), F.col("collected_at").alias("ts"), "ord")
    return trends.counted(trends.windowed(rows, LOW, DAYS, SLICES), SLICES).select("signature", "count_current", "history")


@query("a19_topic_sizes", "SELECT topic, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST((SELECT count(*) FROM topics) AS DOUBLE), 6) AS part FROM topics GROUP BY topic ORDER BY n DESC, topic LIMIT 10", TOPICS)
def topic_sizes(spark, sf):
    from pyspark.sql.window import Window

    sizes = topic_articles(spark, sf).groupBy("topic").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return sizes.withColumn("part", F.round(F.col("n") / whole, 6)).orderBy(F.desc("n"), "topic").limit(10)


WORDS = r"""tokens AS (SELECT ord, topic, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}_]+'), lambda x: len(x) > 1 AND x NOT IN ('the', 'of', 'and', 'to', 'in', 'a')) AS t FROM topics),
grams AS (SELECT ord, topic, unnest(t || [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) AS word FROM tokens),
per AS (SELECT topic, word, count(*) AS tf, count(DISTINCT ord) AS df FROM grams GROUP BY topic, word),
whole AS (SELECT word, sum(tf) AS f, sum(df) AS docs FROM per GROUP BY word),
mean AS (SELECT avg(n) AS average FROM (SELECT sum(tf) AS n FROM per GROUP BY topic)),
weighed AS (SELECT topic, word, tf * ln(1 + average / f) AS weight FROM per JOIN whole USING (word), mean WHERE docs >= 2)"""


@query("m5_topic_words", "SELECT topic, CAST(rank AS INTEGER) AS rank, word, round(weight, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 6) DESC, word) AS rank FROM weighed) WHERE rank <= 8", TOPICS, WORDS)
def topic_words(spark, sf):
    return trends.topic_words(topic_articles(spark, sf), "topic", "content")


@query("j7_first_label", "SELECT signature, arg_min(publication, ord) AS label FROM mentions GROUP BY signature", MENTIONS)
def first_label(spark, sf):
    return fixtures.mentions(spark, sf).groupBy("signature").agg(F.min_by("publication", "ord").alias("label"))


@query("f29_signature_label", "SELECT ord, coalesce(nullif(array_to_string(list_slice(w, 1, 5), ' | '), ''), 'unknown-topic') AS signature, coalesce(nullif(array_to_string(list_slice(w, 1, 3), ' | '), ''), 'Unknown Topic') AS label FROM (SELECT ord, list_filter(string_split(title, ' '), lambda x: x NOT IN ('the', 'of', '')) AS w FROM articles)", ARTICLES)
def labels(spark, sf):
    # stopwords are taken out of topic words by exact match
    words = F.filter(F.split("title", " "), lambda w: ~w.isin("the", "of", ""))
    return fixtures.articles(spark, sf).select("ord", trends.signature(words).alias("signature"), trends.label(words).alias("label"))


@query("u3_u4_stopwords", "SELECT ord, list_sort(list_distinct(list_filter(w, lambda x: NOT list_contains(['the', 'of', 'and', 'de', 'la'], x)))) AS words FROM (SELECT ord, string_split(lower(title), ' ') AS w FROM articles)", ARTICLES)
def without_stopwords(spark, sf):
    stop = F.array_union(F.array(F.lit("the"), F.lit("of"), F.lit("and")), F.array(F.lit("de"), F.lit("la"), F.lit("of")))
    return fixtures.articles(spark, sf).select("ord", F.array_sort(F.array_except(F.split(F.lower("title"), " "), stop)).alias("words"))


@query("a21_date_audit", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE k <> 0) AS BIGINT) AS ok, CAST(count(*) FILTER (WHERE k = 0) AS BIGINT) AS failed FROM (SELECT event_id % 5 AS k FROM events)")
def date_audit(spark, sf):
    e = fixtures.table(spark, sf, "events")
    day = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-M-d")
    shown = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("on "), day)).when(F.col("event_id") % 5 == 1, F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd"), F.lit("T10:00:00Z"))).when(F.col("event_id") % 5 == 2, F.concat(day, F.lit(" 10:00:00"))).otherwise(day)
    return e.agg(F.count("*").alias("total"), F.count_if(dates.parsed(shown).isNotNull()).alias("ok"), F.count_if(dates.parsed(shown).isNull()).alias("failed"))


@query("r5_trend_windows", "SELECT * FROM (VALUES (1, DATE '2024-01-22', DATE '2024-01-29', 7), (2, DATE '2024-01-22', DATE '2024-02-01', 10), (3, DATE '2024-01-01', DATE '2024-01-11', 10), (4, DATE '2024-12-01', DATE '2025-01-01', 31)) v(kind, low, high, days)")
def windows(spark, sf):
    bounds = [(START, END), (START, None), (None, dt.date(2024, 1, 10)), (None, None)]
    rows = [(i, *dates.trend_window(a, b, dt.date(2024, 12, 5))) for i, (a, b) in enumerate(bounds, start=1)]
    return spark.createDataFrame(rows, "kind int, low date, high date, days int")


SIZED = """sized AS (SELECT ord, topic, count(*) OVER (PARTITION BY topic) AS n FROM topics),
rare AS (SELECT count(*) FILTER (WHERE n < 40 OR topic = -1) / CAST(count(*) AS DOUBLE) > 0.75 AND count(*) >= 20 AS retry FROM sized)"""


@query("m4_sized_topics", "SELECT ord, CAST(CASE WHEN topic <> -1 AND n >= CASE WHEN (SELECT retry FROM rare) THEN 2 ELSE 40 END THEN topic ELSE -1 END AS INTEGER) AS topic FROM sized", TOPICS, SIZED)
def sized_topics(spark, sf):
    from gleanery.operators import models

    return models.sized_topics(topic_articles(spark, sf), "topic", 40).select("ord", "topic")


@query("m3_embeddings", "SELECT a.ord, e.embedding IS NOT NULL AS embedded FROM articles a LEFT JOIN embeddings e ON a.ord = e.vec_id", ARTICLES)
def embeddings(spark, sf):
    from gleanery.operators import models

    return models.embedded(fixtures.articles(spark, sf), fixtures.table(spark, sf, "embeddings"), "ord").select("ord", F.col("embedding").isNotNull().alias("embedded"))


# two thirds of the topics have words of their own, the others share them; one topic in ten is an outlier
ARTICLE_TRENDS = TOPICS + f""", rows_ AS (SELECT a.ord, a.publication, p.url, a.collected_at AS ts, CASE WHEN a.topic = 9 THEN -1 ELSE a.topic END AS topic FROM topics a JOIN pages p ON p.page_id = a.ord % (SELECT count(*) FROM pages)),
listed AS (SELECT * FROM rows_ WHERE {host_sql('url')} IN (SELECT {host_sql('url')} FROM pages WHERE page_id % 5 < 4)),
spans AS (SELECT *, -CAST(floor(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-22') AS DOUBLE) / 604800000000) AS BIGINT) AS slice, 'word' || CAST(topic % 4 AS VARCHAR) || ' | gold' AS signature FROM listed WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-29'),
bound AS (SELECT CASE WHEN count(*) FILTER (WHERE topic = -1) / CAST(count(*) AS DOUBLE) > 0.75 THEN 1 ELSE 2 END AS least FROM spans),
sums AS (SELECT signature, CAST(count(*) FILTER (WHERE slice = 0) AS BIGINT) AS c, CAST(count(*) FILTER (WHERE slice > 0) AS DOUBLE) / 3 AS b, CAST(count(DISTINCT CASE WHEN slice = 0 THEN nullif(trim(publication), '') END) AS BIGINT) AS pubs FROM spans WHERE topic <> -1 GROUP BY signature),
firsts AS (SELECT signature, string_agg(url, ' | ' ORDER BY ord) AS supporting FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY ord) AS n FROM (SELECT signature, url, min(ord) AS ord FROM spans WHERE slice = 0 AND topic <> -1 GROUP BY signature, url)) WHERE n <= 3 GROUP BY signature),
new_rows AS (SELECT s.signature AS keyword, c AS count_current, round(b, 3) AS baseline_4wk, round((c + 1) / (b + 1) * ln(1 + c), 4) AS trend_score, pubs AS publication_count, coalesce(supporting, '') AS supporting_urls, 'trending' AS status FROM sums s LEFT JOIN firsts f ON s.signature = f.signature, bound WHERE c > 0 AND c >= least AND pubs >= 1 AND (c + 1) / (b + 1) >= MINIMUM)"""


def run_trends(spark, sf, min_lift: float):
    p = fixtures.table(spark, sf, "pages").select("page_id", "url")
    pages = p.agg(F.count("*").alias("pages"))
    a = topic_articles(spark, sf).join(F.broadcast(pages), F.lit(True)).withColumn("page_id", F.col("ord") % F.col("pages")).join(p, "page_id")
    a = a.select("ord", "url", "publication", F.col("collected_at").alias("ts"), F.when(F.col("topic") == 9, -1).otherwise(F.col("topic")).alias("topic"))
    words = spark.range(10).select(F.col("id").cast("int").alias("topic"), F.array(F.concat(F.lit("word"), (F.col("id") % 4).cast("string")), F.lit("the"), F.lit("gold")).alias("words"))
    hosts = p.where("page_id % 5 < 4").select(urls.host(F.col("url")).alias("host"))
    return trends.article_trends(a, words, LOW, DAYS, SLICES, "run-2", "2024-W04", hosts, ("the", "of"), min_lift=min_lift)


@query("r6_article_trends", "SELECT * FROM new_rows", ARTICLE_TRENDS.replace("MINIMUM", "0.9"))
def article_trends(spark, sf):
    """List filter, topics merged by signature, gates and labels."""
    return run_trends(spark, sf, 0.9).select("keyword", "count_current", "baseline_4wk", "trend_score", "publication_count", "supporting_urls", "status")


@query("r6_no_trends", "SELECT '__NO_TRENDS__' AS keyword, CAST(0 AS BIGINT) AS count_current, CAST(0 AS DOUBLE) AS baseline_4wk, CAST(0 AS DOUBLE) AS trend_score, CAST(0 AS BIGINT) AS publication_count, '' AS supporting_urls, 'no_trends' AS status UNION ALL SELECT * FROM new_rows", ARTICLE_TRENDS.replace("MINIMUM", "1000"))
def no_trends(spark, sf):
    """Nothing passes: one row says so."""
    return run_trends(spark, sf, 1000.0).select("keyword", "count_current", "baseline_4wk", "trend_score", "publication_count", "supporting_urls", "status")


@query("r6_run_table", "SELECT 'run-1' AS trend_run_id, signature AS keyword, count_current FROM counted UNION ALL SELECT 'run-2', keyword, count_current FROM new_rows", SLICED, ARTICLE_TRENDS.replace("MINIMUM", "0.9"))
def run_table(spark, sf):
    """The new run's rows in place of its old ones; other runs stay."""
    new = run_trends(spark, sf, 0.9).select("trend_run_id", "keyword", "count_current")
    old = trends.counted(inside(spark, sf), SLICES).select(F.explode(F.array(F.lit("run-1"), F.lit("run-2"))).alias("trend_run_id"), F.col("signature").alias("keyword"), "count_current")
    return store.replace_run(old, new, "trend_run_id")


@query("r6_run_state", "SELECT key, CASE key WHEN 'click' THEN 'complete' ELSE value END AS value FROM (SELECT event_type AS key, arg_max(CAST(event_id AS VARCHAR), event_id) AS value FROM events GROUP BY event_type) UNION ALL SELECT 'latest_trend_rows_written', CAST(count(*) AS VARCHAR) FROM new_rows UNION ALL SELECT 'latest_trend_week_key', '2024-W04'", ARTICLE_TRENDS.replace("MINIMUM", "0.9"))
def run_state(spark, sf):
    """What the run leaves in the key-value table; click stands for its status."""
    rows = run_trends(spark, sf, 0.9).agg(F.count("*").cast("string").alias("value")).select(F.lit("latest_trend_rows_written").alias("key"), "value")
    fixed = spark.range(2).select(F.when(F.col("id") == 0, "click").otherwise("latest_trend_week_key").alias("key"), F.when(F.col("id") == 0, "complete").otherwise("2024-W04").alias("value"))
    return store.upsert(store.last_value(fixtures.metadata(spark, sf), "key", "value"), rows.unionByName(fixed), "key", "value")
