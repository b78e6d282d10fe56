"""Feeds, sitemaps, robots files and pages that have been landed as rows (url, body)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import dates, text, urls
from gleanery.operators.scoring import Lexicon, relevance

#: Where sitemaps and feeds usually are.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml", "/news-sitemap.xml")
DISCOVERY_SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/news-sitemap.xml", "/sitemap_google_news.xml")
FEED_PATHS = ("/feed", "/rss", "/rss.xml", "/atom.xml", "/feeds/posts/default", "/blog/feed", "/news/feed")


def xml_text(body: Column) -> Column:
    """Without a byte order mark or what comes before the first XML marker."""
    clean = F.trim(F.regexp_replace(body, "^﻿", ""))
    at = [F.nullif(F.locate(m, clean), F.lit(0)) for m in ("<?xml", "<urlset", "<sitemapindex")]
    return F.substring(clean, F.coalesce(F.least(*at), F.lit(1)), F.length(clean))


def decoded(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1; a leading byte order mark goes."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "^﻿", "")


def _field(item: Column, tag: str) -> Column:
    raw = F.regexp_extract(item, rf"(?is)<{tag}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)
    return F.trim(raw)


def feed_entries(feeds: DataFrame, as_of: Column, most: int = 20, max_age_days: int = 7) -> DataFrame:
    """Entries of feeds (publication, url, body): the first `most` of each, recent, with title and link."""
    items = F.regexp_extract_all(F.col("body"), F.lit(r"(?is)<(item|entry)\b.*?</\1\s*>"), 0)
    each = feeds.select("publication", F.col("url").alias("feed"), F.posexplode(items).alias("ord", "item")).where(F.col("ord") < most)
    link = F.coalesce(F.nullif(_field(F.col("item"), "link"), F.lit("")), F.regexp_extract("item", r"(?is)<link[^>]*href=[\"']([^\"']+)", 1))
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace(_field(F.col("item"), "pubDate"), r"^\w+,\s*|\s+(?:GMT|UTC|[+-]\d{4})$", ""), F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz"), dates.parsed(_field(F.col("item"), "updated")), as_of)
    rows = each.select("publication", "feed", "ord", _field(F.col("item"), "title").alias("title"), link.alias("url"), when.alias("published_date"), F.coalesce(F.nullif(_field(F.col("item"), "description"), F.lit("")), _field(F.col("item"), "summary")).alias("summary"))
    return rows.where((F.col("title") != "") & (F.col("url") != "") & dates.is_recent(F.col("published_date"), as_of, max_age_days)).withColumn("candidate_source", F.lit("rss"))


def scored_entries(entries: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """Entries with relevance_score and keywords_found of title and summary; those below `least` go."""
    t = entries.withColumn("_t", text.normalized(F.concat_ws(" ", "title", "summary")))
    rows = t.withColumn("_r", relevance(F.col("_t"), lexicon)).withColumns({"relevance_score": F.col("_r.score"), "keywords_found": F.col("_r.found")}).drop("_t", "_r")
    return rows.where(F.col("relevance_score") >= least)


def sitemap_candidates(roots: DataFrame, fetches: DataFrame, as_of: Column, children: int = 17, most: int | None = 150, max_age_days: int | None = 7) -> DataFrame:
    """Candidates of landed sitemaps (publication, url, body): index files lead to the latest `children` maps, read from
    fetches (url, body); of each map the first `most` recent urls are taken, then those that are no articles go."""
    index = roots.where(F.contains(F.lower("body"), F.lit("<sitemapindex")))
    found = sitemap_children(index, children, "url").select("publication", F.col("child").alias("url")).join(fetches.select("url", "body"), "url")
    sets = roots.where(~F.contains(F.lower("body"), F.lit("<sitemapindex"))).select("publication", "url", "body").unionByName(found.select("publication", "url", "body"))
    return sitemap_urls(sets, as_of, max_age_days, most).where(urls.is_relevant(F.col("url")))


def sitemap_children(indexes: DataFrame, most: int = 17, group: str = "publication") -> DataFrame:
    """Child sitemaps of index files (publication, url, body): the latest `most` of each group, by lastmod or the month in their names."""
    parts = F.regexp_extract_all(xml_text(F.col("body")), F.lit(r"(?is)<sitemap>.*?</sitemap>"), 0)
    each = indexes.select("publication", "url", F.posexplode(parts).alias("ord", "part"))
    loc = urls.resolved(_field(F.col("part"), "loc"), F.col("url"))
    rows = each.select("publication", "url", "ord", loc.alias("child"), dates.iso(_field(F.col("part"), "lastmod")).alias("mod"))
    rows = rows.withColumn("lastmod", F.coalesce("mod", dates.sitemap_month(F.col("child")).cast("timestamp_ntz"))).drop("mod")
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("lastmod"), "ord")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def sitemap_urls(maps: DataFrame, as_of: Column, max_age_days: int | None = 7, most: int | None = None) -> DataFrame:
    """Urls of url sets (publication, url, body) with their dates, relative ones resolved; none is dropped by age where the limit is None."""
    parts = F.regexp_extract_all(xml_text(F.col("body")), F.lit(r"(?is)<url>.*?</url>"), 0)
    each = maps.select("publication", F.col("url").alias("sitemap"), F.posexplode(parts).alias("ord", "part"))
    rows = each.select("publication", "sitemap", "ord", urls.resolved(_field(F.col("part"), "loc"), F.col("sitemap")).alias("url"), F.coalesce(dates.lastmod(_field(F.col("part"), "lastmod")), as_of).alias("published_date"))
    rows = rows.where((F.col("url") != "") & dates.is_recent(F.col("published_date"), as_of, max_age_days))
    if most is not None:  # the cap comes before any later filter
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("sitemap").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")
    return rows.withColumns({"title": F.lit(""), "summary": F.lit(""), "relevance_score": F.lit(1.0), "candidate_source": F.lit("sitemap")})


def robots_sitemaps(robots: DataFrame, paths: Sequence[str] = SITEMAP_PATHS, key: str | None = None) -> DataFrame:
    """Sitemap candidates of robots files (base_url, body, and a key): listed ones, then usual paths, distinct in order."""
    listed = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(F.regexp_extract(x, r"(?i)^\s*sitemap:(.*)$", 1))), lambda x: x != "")
    usual = F.array(*[F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit(p)) for p in paths])
    return robots.select(*[key] * bool(key), "base_url", F.posexplode(F.array_distinct(F.concat(listed, usual))).alias("ord", "sitemap"))


def preferred_sitemap(candidates: DataFrame, key: str = "base_url") -> DataFrame:
    """One candidate for each base: urls with "news" first, then shorter ones."""
    w = Window.partitionBy(key).orderBy(F.when(F.contains(F.lower("sitemap"), F.lit("news")), 0).otherwise(1), F.length("sitemap"), "ord")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def feed_links(pages: DataFrame) -> DataFrame:
    """Feed candidates of pages (url, html): alternate links, feed-like links, usual paths; distinct."""
    declared = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<link\b(?=[^>]*(?:rss|atom)\+xml)[^>]*href=[\"']([^\"']+)"), 1)
    linked = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)href=[\"']([^\"']*(?:/feed|/rss|\.rss|atom\.xml)[^\"']*)[\"']"), 1)
    origin = F.regexp_replace(urls.base(F.col("url")), "/$", "")
    usual = F.array(*[F.concat(origin, F.lit(p)) for p in FEED_PATHS])
    found = F.transform(F.concat(declared, linked), lambda x: urls.resolved(x, F.col("url")))
    return pages.select("url", F.explode(F.array_sort(F.array_distinct(F.concat(found, usual)))).alias("feed")).distinct()


def page_links(pages: DataFrame, most: int = 15, longest: int = 20) -> DataFrame:
    """Links of pages (url, html), absolute and longer than `longest`, the first `most` by url."""
    hrefs = F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(r"(?i)<a\b[^>]*href=[\"']([^\"'#]+)"), 1))
    each = pages.select(F.col("url").alias("page"), F.explode(F.transform(hrefs, lambda x: urls.resolved(x, F.col("url")))).alias("url")).where(F.length("url") > longest).distinct()
    return each.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("url"))).where(F.col("n") <= most)


def page_rows(pages: DataFrame, least: int = 150) -> DataFrame:
    """Title and text of pages (page_id, url, html) with at least `least` characters of text."""
    out = pages.select("page_id", "url", text.page_title(F.col("html")).alias("title"), text.page_text(F.col("html")).alias("content"))
    return out.where(F.length("content") >= least)


def selected_article(pages: DataFrame) -> DataFrame:
    """Selector form: the first of article, main and body with over 300 characters of text, else the last that exists."""
    body = F.col("html")
    hits = [text.page_text(F.regexp_extract(body, rf"(?is)<{t}\b[^>]*>(.*)</{t}>", 1)) for t in ("article", "main", "body")]
    chosen = F.coalesce(*[F.when(F.length(h) > 300, h) for h in hits], *[F.nullif(h, F.lit("")) for h in reversed(hits)])
    heading = F.trim(F.regexp_replace(F.regexp_extract(body, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), r"<[^>]+>", ""))
    title = F.when(F.length(heading) > 5, heading).otherwise(text.page_title(body))
    return pages.select("page_id", "url", title.alias("title"), chosen.alias("content")).where(F.length("content") >= 150)


def config_entry(name: Column, base: Column, sitemap: Column) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(quoted(name), F.lit(": {base_url: "), quoted(base), F.lit(", sitemap_url: "), quoted(sitemap), F.lit("},"))
