"""Table scans, maintenance and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import states, urls
from gleanery.functions.urls import BLOCKED_PATHS as BLOCKED
from gleanery.operators import scoring, store, validation
from gleanery.plans.registry import ARTICLES, CANDIDATES, METADATA, OUTCOMES, SOURCES, STARS, by_case, by_case_sql, host_sql, query
from gleanery.sources import catalog, fixtures, landed


@query("s1_full_scan", "SELECT r_regionkey, r_name FROM region")
def full_scan(spark, sf):
    return fixtures.table(spark, sf, "region").select("r_regionkey", "r_name")


@query("s2_aliased_scan", "SELECT ord, coalesce(nullif(CASE WHEN ord % 2 = 0 THEN '' ELSE title END, ''), id) AS title FROM articles", ARTICLES)
def aliased_scan(spark, sf):
    a = fixtures.articles(spark, sf).select("ord", F.when(F.col("ord") % 2 == 0, "").otherwise(F.col("title")).alias("TITLE_A"), F.col("id").alias("Title_B"))
    return a.select("ord", store.first_alias(a, "missing", "TITLE_A", "Title_B").alias("title"))


@query("s3_ragged_scan", "SELECT * FROM (SELECT coalesce(CASE WHEN page_id % 4 > 0 THEN CAST(page_id AS VARCHAR) END, '') AS id, coalesce(CASE page_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'x' END, '') AS x, coalesce(CASE WHEN page_id % 5 = 0 THEN url END, '') AS y FROM pages) WHERE trim(id) <> '' OR trim(x) <> '' OR trim(y) <> ''")
def ragged_scan(spark, sf):
    i = F.col("page_id")
    return store.ragged(fixtures.table(spark, sf, "pages").select(F.when(i % 4 > 0, i.cast("string")).alias("id"), F.when(i % 3 == 0, " ").when(i % 3 == 1, "x").alias("x"), F.when(i % 5 == 0, F.col("url")).alias("y")))


@query("s4_kv_scan", "SELECT key, arg_max(value, ord) AS value FROM metadata GROUP BY key", METADATA)
def kv_scan(spark, sf):
    return store.last_value(fixtures.metadata(spark, sf), "key", "value")


@query("s5_kv_lookup", "SELECT arg_max(value, ord) AS value FROM metadata WHERE key = 'click'", METADATA)
def kv_lookup(spark, sf):
    return store.last_value(fixtures.metadata(spark, sf).where("key = 'click'"), "key", "value").select("value")


@query("s6_last_n", "SELECT ord FROM articles ORDER BY ord DESC LIMIT 100", ARTICLES)
def last_n(spark, sf):
    return store.last_n(fixtures.articles(spark, sf), 100).select("ord")


@query("s19_s20_source_list", "SELECT publication, arg_max(base_url, ord) AS base_url, min(ord) AS first_ord FROM (SELECT ord, coalesce(nullif(trim(publication), ''), 'Unknown') AS publication, base_url FROM source_rows WHERE list_name = 'List 1' AND upper(coalesce(active, 'TRUE')) = 'TRUE') GROUP BY publication", SOURCES)
def source_list(spark, sf):
    s = fixtures.source_rows(spark, sf).where((F.col("list_name") == "List 1") & validation.is_active(F.col("active")))
    s = s.withColumn("publication", F.coalesce(F.nullif(F.trim("publication"), F.lit("")), F.lit("Unknown")))
    return s.groupBy("publication").agg(F.max_by("base_url", "ord").alias("base_url"), F.min("ord").alias("first_ord"))


@query("s19_catalog", "SELECT CASE WHEN page_id % 2 = 0 THEN 'finance' ELSE 'luxury' END AS topic, 'p' || CAST(page_id AS VARCHAR) AS publication, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || '/' AS base_url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'second' END AS sitemap_url, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS feeds FROM pages WHERE page_id % 7 > 0")
def source_catalog(spark, sf):
    """A catalog file in which names come twice, some without a name."""
    path = store.work_path(spark, "catalog")
    p, i = fixtures.table(spark, sf, "pages"), F.col("page_id")
    row = p.select(F.when(i % 2 == 0, "finance").otherwise("luxury").alias("topic"), F.when(i % 7 > 0, F.concat(F.lit("p"), i.cast("string"))).otherwise(" ").alias("publication"), F.regexp_extract("url", "^([^:/?#]+://[^/?#]*)", 1).alias("base_url"), F.when(i % 5 > 0, F.array("url")).alias("rss_feeds"))
    both = row.withColumn("sitemap_url", F.lit("first")).withColumn("ord", F.lit(0)).unionByName(row.withColumn("sitemap_url", F.when(F.regexp_extract("publication", r"(\d+)", 1).try_cast("int") % 3 > 0, "second")).withColumn("ord", F.lit(1)))
    store.write_json(both.coalesce(1).sortWithinPartitions("ord").drop("ord"), path)
    return catalog.sources(spark, path).select("topic", "publication", "base_url", "sitemap_url", F.size("rss_feeds").alias("feeds"))


@query("s21_first_kv", "SELECT key, arg_min(value, ord) AS value FROM metadata GROUP BY key", METADATA)
def first_kv(spark, sf):
    return fixtures.metadata(spark, sf).groupBy("key").agg(F.min_by("value", "ord").alias("value"))


@query("s22_csv_parameter", f"SELECT page_id, unnest(['gold', h] || CASE WHEN page_id % 2 = 0 THEN ['ruby'] ELSE [] END) AS keyword FROM (SELECT page_id, {host_sql('url')} AS h FROM pages)")
def csv_parameter(spark, sf):
    from gleanery.functions import text

    given = F.concat(F.lit("gold, "), urls.host(F.col("url")), F.when(F.col("page_id") % 2 == 0, ",,gold ,ruby").otherwise(", ,"))
    return fixtures.table(spark, sf, "pages").select("page_id", F.explode(text.split_list(given, ",")).alias("keyword"))


@query("k1_k2_append", "SELECT CAST(2 * count(*) AS BIGINT) AS n FROM articles", ARTICLES)
def append(spark, sf):
    path = store.work_path(spark, "append")
    rows = fixtures.articles(spark, sf).select("ord", "title", F.coalesce(F.lit(None).cast("string"), F.lit("Unknown")).alias("journalist"))
    store.append(rows, path)
    store.append(rows, path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


RUNS = "runs AS (SELECT CAST(user_id % 7 AS VARCHAR) AS run, event_id AS id FROM events)"


@query("k3_replace_run", "SELECT run, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM runs WHERE run <> '3' UNION ALL SELECT '3', id FROM runs WHERE id < 10) GROUP BY run", RUNS)
def replace_run(spark, sf):
    runs = fixtures.table(spark, sf, "events").select((F.col("user_id") % 7).cast("string").alias("run"), F.col("event_id").alias("id"))
    new = runs.where("id < 10").select(F.lit("3").alias("run"), "id")
    return store.replace_run(runs, new, "run").groupBy("run").agg(F.count("*").alias("n"))


@query("k4_kv_upsert", "SELECT key, CASE WHEN key = 'click' THEN 'new' ELSE value END AS value FROM (SELECT key, arg_max(value, ord) AS value FROM metadata GROUP BY key) UNION ALL SELECT 'added', '1'", METADATA)
def kv_upsert(spark, sf):
    new = spark.createDataFrame([("click", "new"), ("added", "1")], "key string, value string")
    return store.upsert(store.last_value(fixtures.metadata(spark, sf), "key", "value"), new, "key", "value")


@query("k5_row_update", "SELECT ord, CASE WHEN ord % 10 = 0 THEN 'FALSE' ELSE active END AS active FROM source_rows", SOURCES)
def row_update(spark, sf):
    s = fixtures.source_rows(spark, sf)
    new = s.where("ord % 10 = 0").select("ord", F.lit("FALSE").alias("new"))
    return s.join(new, "ord", "left").select("ord", F.coalesce("new", "active").alias("active"))


@query("k6_insert_absent", "SELECT week_key, CAST(count(*) AS BIGINT) AS n FROM (SELECT article_id, week_key FROM stars UNION ALL SELECT DISTINCT article_id, '2024-W01' FROM stars s WHERE NOT EXISTS (SELECT 1 FROM stars t WHERE t.article_id = s.article_id AND t.week_key = '2024-W01')) GROUP BY week_key", STARS)
def insert_absent(spark, sf):
    s = fixtures.stars(spark, sf).select("article_id", "week_key")
    new = s.select("article_id", F.lit("2024-W01").alias("week_key"))
    return store.insert_absent(s, new, ["article_id", "week_key"]).groupBy("week_key").agg(F.count("*").alias("n"))


@query("k7_delete_first", "SELECT ord FROM stars WHERE ord <> (SELECT min(ord) FROM stars WHERE week_key = '2024-W02')", STARS)
def delete_first(spark, sf):
    return store.delete_first(fixtures.stars(spark, sf), F.col("week_key") == "2024-W02").select("ord")


@query("k8_point_update", "SELECT ord, CASE WHEN ord = 8 THEN 'approved' ELSE 'pending' END AS status FROM stars", STARS)
def point_update(spark, sf):
    s = fixtures.stars(spark, sf).select("ord", F.lit("pending").alias("status"))
    return store.updated(s, F.col("ord") == 8, "status", F.lit("approved"))


@query("k9_source_append", "SELECT page_id, 'TRUE' AS active, '' AS sitemap_url FROM pages WHERE regexp_matches(url, '(?i)^https?://[^/?#]+')")
def source_append(spark, sf):
    return fixtures.table(spark, sf, "pages").where(urls.is_valid(F.col("url"))).select("page_id", F.lit("TRUE").alias("active"), F.lit("").alias("sitemap_url"))


@query("k10_k11_json_csv_sinks", "SELECT CAST(count(*) AS BIGINT) AS n FROM articles", ARTICLES)
def json_csv(spark, sf):
    path = store.work_path(spark, "sinks")
    rows = fixtures.articles(spark, sf).select("ord", "publication")
    store.write_json(rows, f"{path}/json")
    store.write_csv(rows, f"{path}/csv")
    back = spark.read.schema("ord bigint, publication string").json(f"{path}/json").join(spark.read.option("header", True).schema("ord bigint, publication string").csv(f"{path}/csv"), ["ord", "publication"])
    return back.agg(F.count("*").alias("n"))


@query("k12_report_lines", "SELECT ord, md5('* [' || title || '](' || id || ') by Unknown - ' || summary) AS h FROM articles", ARTICLES)
def report_lines(spark, sf):
    return fixtures.articles(spark, sf).select("ord", F.md5(store.report_line(F.col("title"), F.col("id"), F.lit(None), F.col("summary"))).alias("h"))


@query("k15_config_lines", """SELECT ord, '"' || publication || '": {base_url: "' || base_url || '", sitemap_url: "' || CASE WHEN ord % 3 = 0 THEN 'a\\"b' ELSE '' END || '"},' AS line FROM source_rows""".replace("\\\\", "\\"), SOURCES)
def config_lines(spark, sf):
    s = fixtures.source_rows(spark, sf)
    return s.select("ord", landed.config_entry(F.col("publication"), F.col("base_url"), F.when(F.col("ord") % 3 == 0, 'a"b')).alias("line"))


@query("a6_a16_publication_counts", "SELECT publication, CAST(count(*) AS BIGINT) AS n, min(ord) AS first_ord FROM articles GROUP BY publication", ARTICLES)
def publication_counts(spark, sf):
    return fixtures.articles(spark, sf).groupBy("publication").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query("a9_k13_grouped_report", "SELECT publication, row_number() OVER (ORDER BY n DESC, publication) AS by_size, row_number() OVER (ORDER BY publication) AS by_name FROM (SELECT publication, count(*) AS n FROM articles GROUP BY publication)", ARTICLES)
def grouped_report(spark, sf):
    g = fixtures.articles(spark, sf).groupBy("publication").agg(F.count("*").alias("n"))
    by_size = store.numbered(g, "by_size", F.desc("n"), F.col("publication"))
    return store.numbered(by_size, "by_name", F.col("publication")).select("publication", "by_size", "by_name")


@query("a10_o8_list_rollup", "SELECT list_name, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE upper(coalesce(active, 'TRUE')) = 'TRUE') AS BIGINT) AS active FROM source_rows WHERE trim(list_name) <> '' GROUP BY list_name ORDER BY lower(list_name)", SOURCES)
def list_rollup(spark, sf):
    s = fixtures.source_rows(spark, sf).where(F.trim("list_name") != "")
    return s.groupBy("list_name").agg(F.count("*").alias("n"), F.count_if(validation.is_active(F.col("active"))).alias("active")).orderBy(F.lower("list_name"))


CHECKS = "checks AS (SELECT event_id AS ord, user_id % 9 AS run_id, event_type <> 'error' AS sitemap_valid, value >= 10 AS rss_valid FROM events)"


def checks(spark, sf):
    e = fixtures.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("ord"), (F.col("user_id") % 9).alias("run_id"), (F.col("event_type") != "error").alias("sitemap_valid"), (F.col("value") >= 10).alias("rss_valid"))


TOTALS = "CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE sitemap_valid) AS BIGINT) AS sitemap_ok, CAST(count(*) FILTER (WHERE rss_valid) AS BIGINT) AS rss_ok, CAST(count(*) FILTER (WHERE sitemap_valid AND rss_valid) AS BIGINT) AS both, CAST(count(*) FILTER (WHERE NOT sitemap_valid AND NOT rss_valid) AS BIGINT) AS neither"


@query("a11_latest_validation", f"SELECT {TOTALS} FROM checks WHERE run_id = (SELECT arg_max(run_id, ord) FROM checks)".replace("AS both", 'AS "both"'), CHECKS)
def latest_validation(spark, sf):
    c = checks(spark, sf)
    last = c.agg(F.max_by("run_id", "ord").alias("run_id"))
    return validation.validation_totals(c.join(F.broadcast(last), "run_id"))


@query("a12_validation_totals", f"SELECT {TOTALS} FROM checks".replace("AS both", 'AS "both"'), CHECKS)
def totals(spark, sf):
    return validation.validation_totals(checks(spark, sf))


@query("a13_health_totals", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE outcome <> 'accepted') AS BIGINT) AS attention FROM outcomes", OUTCOMES)
def health_totals(spark, sf):
    return fixtures.outcomes(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") != "accepted").alias("attention"))


@query("o7_health_report", "SELECT publication, overall, found, row_number() OVER (ORDER BY CASE overall WHEN 'healthy' THEN 1 ELSE 0 END, found, publication) AS place FROM (SELECT publication, CASE WHEN count(*) FILTER (WHERE outcome = 'http_403') = 0 OR publication % 3 = 0 THEN 'healthy' ELSE 'needs_attention' END AS overall, CAST(count(*) FILTER (WHERE outcome = 'accepted') AS BIGINT) AS found FROM outcomes GROUP BY publication)", OUTCOMES)
def health_report(spark, sf):
    """Sources that need attention first, then those where least was found."""
    per = fixtures.outcomes(spark, sf).groupBy("publication").agg(F.count_if(F.col("outcome") == "http_403").alias("bad"), F.count_if(F.col("outcome") == "accepted").alias("found"))
    sitemap = F.when(F.col("bad") == 0, "ok").otherwise("blocked")
    rss = states.rss_state(F.when(F.col("publication") % 3 == 0, 0).otherwise(1), F.lit(0), F.lit(0))
    rows = per.select("publication", states.overall(sitemap, rss).alias("overall"), "found")
    return store.numbered(rows, "place", F.col("overall") == "healthy", F.col("found"), F.col("publication"))


@query("a14_feed_rollup", "SELECT publication, CAST(count(*) AS BIGINT) AS feeds, CAST(count(*) FILTER (WHERE outcome = 'accepted') AS BIGINT) AS feeds_ok, arg_max(outcome, ord) FILTER (WHERE outcome <> 'accepted') AS last_error FROM outcomes GROUP BY publication", OUTCOMES)
def feed_rollup(spark, sf):
    bad = F.when(F.col("outcome") != "accepted", F.col("ord"))
    return fixtures.outcomes(spark, sf).groupBy("publication").agg(F.count("*").alias("feeds"), F.count_if(F.col("outcome") == "accepted").alias("feeds_ok"), F.max_by("outcome", bad).alias("last_error"))


@query("a22_best_sitemap", "SELECT publication, ord FROM (SELECT *, row_number() OVER (PARTITION BY publication ORDER BY CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN ord % 3 = 0 THEN -score ELSE 0 END, ord) AS n FROM candidates) WHERE n = 1", CANDIDATES)
def best_sitemap(spark, sf):
    c = fixtures.candidates(spark, sf).withColumn("reason", F.when(F.col("ord") % 3 == 0, "ok").otherwise("http_404"))
    return validation.best_sitemap(c, "publication").select("publication", "ord")


def as_of():
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


@query("s7_s8_feed_entries", "SELECT publication, 'https://e.com/a' || CAST(page_id AS VARCHAR) AS url, TIMESTAMP '2024-01-19 01:00:00' AS published_date, CAST(CASE WHEN page_id % 2 = 0 THEN 6.35 ELSE 0.5 END AS DOUBLE) AS relevance_score, CASE WHEN page_id % 2 = 0 THEN 'queen,tion' ELSE 'ring' END AS keywords, 'rss' AS candidate_source FROM (SELECT ord AS page_id, publication FROM candidates)", CANDIDATES)
def feed_entries(spark, sf):
    """Of each feed one entry is relevant; others are old, without a title, below the gate, or beyond the cap."""
    i = F.col("page_id").cast("string")
    lexicon = scoring.Lexicon(["queen", "tion", "ring"], {"queen": 3.0, "tion": 2.0, "ring": 0.5}, [(("queen", "tion"), 1.0)])
    item = lambda title, path, day, summary: F.concat(*[x if hasattr(x, "_jc") else F.lit(x) for x in ("<item><title>", title, "</title><link>https://e.com/", path, f"</link><pubDate>Fri, {day} Jan 2024 01:00:00 GMT</pubDate><description>", summary, "</description></item>")])
    good = F.when(F.col("page_id") % 2 == 0, "The queen").otherwise("<![CDATA[a ring]]>")
    body = F.concat(F.lit("<rss><channel>"), item(good, F.concat(F.lit("a"), i), 19, F.when(F.col("page_id") % 2 == 0, "tion").otherwise("")), item("queen", "old", "02", "x"), item("", "none", 19, "queen"), item("nothing", "low", 19, "of note"), *[item("dull", f"b{n}", 19, "") for n in range(16)], item("queen", "late", 19, ""), F.lit("</channel></rss>"))
    feeds = fixtures.table(spark, sf, "pages").select(urls.host(F.col("url")).alias("publication"), F.concat(F.lit("https://e.com/feed"), i).alias("url"), body.alias("body"))
    out = landed.scored_entries(landed.feed_entries(feeds, as_of()), lexicon)
    return out.select("publication", "url", "published_date", F.round("relevance_score", 6).alias("relevance_score"), F.array_join("keywords_found", ",").alias("keywords"), "candidate_source")


@query("s9_s10_r2_sitemaps", "SELECT 'https://e.com/' || CAST(page_id AS VARCHAR) || x AS url, 'https://e.com/' || CAST(page_id AS VARCHAR) || '/2023-' || m || '.xml' AS sitemap FROM pages, (VALUES ('/new', '12'), ('/undated', '12'), ('/new', '11'), ('/undated', '11')) v(x, m) UNION ALL SELECT url, 'https://e.com/map' || CAST(page_id AS VARCHAR) || '.xml' FROM pages WHERE page_id % 10 = 0 AND length(url) > 0 AND NOT (" + " OR ".join(f"contains(lower(url), '{x}')" for x in BLOCKED) + ")")
def sitemaps(spark, sf):
    """Index files of three maps, of which the two latest are read, and url sets; old urls, those beyond the cap and those that are no articles go."""
    p = fixtures.table(spark, sf, "pages")
    i = F.col("page_id").cast("string")
    part = lambda *xs: F.concat(*[x if hasattr(x, "_jc") else F.lit(x) for x in xs])
    index = part("<sitemapindex>", *[x for m in ("3", "12", "11") for x in ("<sitemap><loc>https://e.com/", i, f"/2023-{m}.xml</loc></sitemap>")], "</sitemapindex>")
    entry = lambda path, day: ("<url><loc>/", i, f"{path}</loc>" + (f"<lastmod>{day}</lastmod>" if day else "") + "</url>")
    inner = part("junk <?xml version='1.0'?><urlset>", *entry("/new", "2024-01-18"), *entry("/old", "2024-01-02T10:00:00Z"), *entry("/undated", None), *entry("/tags/x", "2024-01-18"), *entry("/late", "2024-01-18"), "</urlset>")
    single = part("<urlset><url><loc>", F.col("url"), "</loc><lastmod>2024-01-18T10:00</lastmod></url></urlset>")
    roots = p.select(F.lit("P").alias("publication"), part("https://e.com/index", i, ".xml").alias("url"), index.alias("body"))
    roots = roots.unionByName(p.where("page_id % 10 = 0").select(F.lit("P").alias("publication"), part("https://e.com/map", i, ".xml").alias("url"), single.alias("body")))
    fetches = p.select(F.explode(F.array(*[F.struct(part("https://e.com/", i, f"/2023-{m}.xml").alias("url"), inner.alias("body")) for m in ("3", "12", "11")])).alias("f")).select("f.*")
    return landed.sitemap_candidates(roots, fetches, as_of(), children=2, most=3).select("url", "sitemap")


@query("s11_xml_cleanup", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<?xml?><a/>' WHEN 1 THEN '<urlset>' || url || '</urlset>' WHEN 2 THEN 'none' ELSE '<sitemapindex>é</sitemapindex>' END AS body FROM pages")
def xml_cleanup(spark, sf):
    raw = by_case(F.col("page_id") % 4, F.encode(F.lit("﻿junk <?xml?><a/>"), "UTF-8"), F.encode(F.concat(F.lit("  <urlset>"), "url", F.lit("</urlset>")), "UTF-8"), F.encode(F.lit("none"), "UTF-8"), F.encode(F.lit("x<sitemapindex>é</sitemapindex>"), "ISO-8859-1"))
    return fixtures.table(spark, sf, "pages").select("page_id", landed.xml_text(landed.decoded(raw)).alias("body"))


def page_text_sql(x: str) -> str:
    dropped = "(script|style|nav|header|footer|aside)"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<{dropped}\b[^>]*>.*?</{dropped}>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


HITS = ", ".join(page_text_sql(rf"regexp_extract(html, '(?is)<{t}\b[^>]*>(.*)</{t}>', 1)") + f" AS {t}_" for t in ("article", "main", "body"))


@query("s13_selected_article", rf"""SELECT page_id, title, CAST(len(c) AS INTEGER) AS n FROM (SELECT page_id, CASE WHEN len(h) > 5 THEN h ELSE t END AS title,
  coalesce(CASE WHEN len(article_) > 300 THEN article_ END, CASE WHEN len(main_) > 300 THEN main_ END, CASE WHEN len(body_) > 300 THEN body_ END, nullif(body_, ''), nullif(main_, ''), nullif(article_, '')) AS c
  FROM (SELECT page_id, {HITS}, trim(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS h, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)) AS t FROM pages)) WHERE len(c) >= 150""")
def selected(spark, sf):
    return landed.selected_article(fixtures.table(spark, sf, "pages")).select("page_id", "title", F.length("content").alias("n"))


ORIGIN = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"


@query("s15_s16_robots", f"SELECT page_id, {ORIGIN} || {by_case_sql('page_id % 4', '/a/news.xml', '/news-sitemap.xml', '/news-sitemap.xml', '/wp-news.xml')} AS sitemap, CAST({by_case_sql('page_id % 4', 6, 4, 5, 5)} AS BIGINT) AS candidates, CAST({by_case_sql('page_id % 4', 6, 4, 5, 5)} AS BIGINT) AS discovered FROM pages")
def robots(spark, sf):
    p = fixtures.table(spark, sf, "pages")
    o = F.regexp_extract("url", "^([^:/?#]+://[^/?#]*)", 1)
    body = by_case(F.col("page_id") % 4, F.concat(F.lit("User-agent: *\nSitemap: "), o, F.lit("/main.xml\n sitemap:"), o, F.lit("/a/news.xml\nSITEMAP:")), "", F.concat(F.lit("Sitemap: "), o, F.lit("/n")), F.concat(F.lit("sitemap: "), o, F.lit("/wp-news.xml\nsitemap: "), o, F.lit("/sitemap.xml")))
    files = p.select("page_id", o.alias("base_url"), body.alias("body"))
    found, more = (landed.robots_sitemaps(files, paths, key="page_id") for paths in (landed.SITEMAP_PATHS, landed.DISCOVERY_SITEMAP_PATHS))
    n = lambda d, name: d.groupBy("page_id").agg(F.count("*").alias(name))
    # the shortest of those with news in them, else the shortest
    best = landed.preferred_sitemap(found, "page_id").select("page_id", "sitemap")
    return best.join(n(found, "candidates"), "page_id").join(n(more, "discovered"), "page_id")


HREFS = """SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*href=["'']([^"''#]+)', 1))) AS h FROM pages"""
FOLDER = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1), ''), '/')"


@query("s17_s18_page_links", f"SELECT page, CAST(count(*) AS BIGINT) AS links FROM (SELECT page, u, row_number() OVER (PARTITION BY page ORDER BY u) AS n FROM (SELECT DISTINCT url AS page, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([^:]+:)', 1) || h WHEN starts_with(h, '/') THEN {ORIGIN} || h ELSE {FOLDER} || h END AS u FROM ({HREFS})) WHERE length(u) > 20) WHERE n <= 15 GROUP BY page")
def links(spark, sf):
    return landed.page_links(fixtures.table(spark, sf, "pages").select("url", "html")).groupBy("page").agg(F.count("*").alias("links"))


@query("s17_feed_links", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN f ELSE replace(f, '/declared.xml', '/rss') END AS feed FROM (SELECT page_id, o || unnest(['/feed', '/rss', '/rss.xml', '/atom.xml', '/feeds/posts/default', '/blog/feed', '/news/feed'] || CASE WHEN page_id % 2 = 0 THEN ['/declared.xml'] ELSE [] END) AS f FROM (SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS o FROM pages))")
def feeds(spark, sf):
    tag = F.when(F.col("page_id") % 2 == 0, '<link rel="alternate" type="application/rss+xml" href="/declared.xml">').otherwise('<a href="/rss">r</a>')
    p = fixtures.table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("#"), F.col("page_id").cast("string")).alias("url"), tag.alias("html"))
    return landed.feed_links(p).join(p.select("url", "page_id"), "url").select("page_id", "feed")


CHECKED = f"""listed AS (SELECT ord, list_name, publication, base_url, 'https://f.org/' || CAST(ord AS VARCHAR) AS rss_url, active FROM source_rows),
found AS (SELECT *, ord % 3 = 0 AS sitemap_valid, ord % 5 > 1 AS rss_valid FROM listed WHERE list_name = 'List 2' AND upper(coalesce(active, 'TRUE')) = 'TRUE')"""


def list_check(spark, sf):
    """Active rows of one list, and fetches in which some sitemaps and feeds are valid."""
    s = fixtures.source_rows(spark, sf).withColumns({"rss_url": F.concat(F.lit("https://f.org/"), F.col("ord").cast("string")), "sitemap_url": F.lit("old"), "base_url": F.concat(F.lit("https://s"), F.col("ord").cast("string"), F.lit(".org/"))})
    scope = s.where((F.trim("list_name") == "List 2") & validation.is_active(F.col("active")))
    i = F.col("ord").cast("string")
    part = lambda *xs: F.concat(*[x if hasattr(x, "_jc") else F.lit(x) for x in xs])
    row = lambda url, status, body, final=None: F.struct(url.alias("url"), F.lit(status).alias("status"), (url if final is None else final).alias("final_url"), body.alias("body"))
    site = part("https://s", i, ".org")
    robots = row(part(site, "/robots.txt"), 200, part("Sitemap: ", site, "/small.xml\nSitemap: ", site, "/bad.xml"))
    small = row(part(site, "/small.xml"), 200, F.when(F.col("ord") % 3 == 0, "<urlset><url><loc>a</loc></url></urlset>").otherwise("<urlset><url></urlset>"))
    bad = row(part(site, "/bad.xml"), 404, F.lit(""))
    large = row(part(site, "/wp-sitemap.xml"), 200, F.when(F.col("ord") % 6 == 0, "<sitemapindex><sitemap></sitemap><sitemap></sitemap></sitemapindex>").otherwise("<html>"), part(site, "/final.xml"))
    feed = row(F.col("rss_url"), 200, F.when(F.col("ord") % 5 > 1, "<rss><item></item></rss>").when(F.col("ord") % 5 == 1, "<rss></rss>").otherwise("<rss>"), part("https://f.org/final/", i))
    fetches = scope.select(F.explode(F.array(robots, small, bad, large, feed)).alias("f")).select("f.*")
    return s, validation.validated_sources(scope, fetches, "meta-1", as_of())


@query("r8_source_validation", """SELECT 'meta-1' AS run_id, ord, list_name, CASE WHEN ord % 6 = 0 THEN 'https://s' || CAST(ord AS VARCHAR) || '.org/final.xml' WHEN sitemap_valid THEN 'https://s' || CAST(ord AS VARCHAR) || '.org/small.xml' ELSE '' END AS sitemap_url, sitemap_valid, CASE WHEN sitemap_valid THEN 'ok' ELSE 'xml_parse_error' END AS sitemap_reason,
  CASE WHEN rss_valid THEN 'https://f.org/final/' || CAST(ord AS VARCHAR) ELSE rss_url END AS rss_url, rss_valid, CASE WHEN rss_valid THEN 'ok' WHEN ord % 5 = 1 THEN 'no_entries' ELSE 'feed_parse_error' END AS rss_reason, CASE WHEN sitemap_valid OR rss_valid THEN 'TRUE' ELSE 'FALSE' END AS active_after FROM found""", SOURCES, CHECKED)
def source_validation(spark, sf):
    return list_check(spark, sf)[1].drop("publication", "base_url", "created_at")


@query("r8_write_back", """SELECT l.ord, CASE WHEN f.ord IS NULL THEN 'old' WHEN f.ord % 6 = 0 THEN 'https://s' || CAST(f.ord AS VARCHAR) || '.org/final.xml' WHEN sitemap_valid THEN 'https://s' || CAST(f.ord AS VARCHAR) || '.org/small.xml' ELSE '' END AS sitemap_url,
  CASE WHEN f.ord IS NULL THEN l.active WHEN sitemap_valid OR rss_valid THEN 'TRUE' ELSE 'FALSE' END AS active FROM listed l LEFT JOIN found f ON l.ord = f.ord""", SOURCES, CHECKED)
def write_back(spark, sf):
    sources, details = list_check(spark, sf)
    return validation.written_back(sources, details).select("ord", "sitemap_url", "active")


@query("r8_totals", f"SELECT {TOTALS} FROM found".replace("AS both", 'AS "both"'), SOURCES, CHECKED)
def validation_totals(spark, sf):
    return validation.validation_totals(list_check(spark, sf)[1])
