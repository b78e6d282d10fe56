"""Checks of feeds, sitemaps and source lists on landed fetches (url, status, final_url, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import urls


def sitemap_reason(status: Column, body: Column) -> Column:
    """A fetch that failed counts as status 0; then markup that is no XML, XML that is not well formed, another root, ok."""
    code = F.coalesce(status, F.lit(0))
    head = F.lower(F.left(body, F.lit(1000)))
    root = F.lower(F.regexp_extract(xml_head(body), r"^<([^\s/>]+)", 1))
    known = F.contains(root, F.lit("urlset")) | F.contains(root, F.lit("sitemapindex"))
    return F.when(code != 200, F.concat(F.lit("http_"), code.cast("string"))).when(F.contains(head, F.lit("<html")), "html_not_xml").when(~well_formed(body), "xml_parse_error").when(~known, "not_sitemap_xml").otherwise("ok")


def xml_head(body: Column) -> Column:
    """From the root element on: without byte order mark, declaration, comments and document type."""
    return F.regexp_replace(F.coalesce(body, F.lit("")), r"(?s)^\ufeff?\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*", "")


def well_formed(body: Column) -> Column:
    """One root element whose tags are all closed in order, by the parser of Spark's XML source."""
    rest = xml_head(body)
    root = F.regexp_extract(rest, r"^<([^\s/>]+)", 1)
    bare = F.regexp_replace(rest, r"(?s)(?:\s|<!--.*?-->)*$", "")
    # one root: its closing tag is the last, and it is opened once
    tail = (F.endswith(bare, F.concat(F.lit("</"), root, F.lit(">"))) | bare.rlike(r"^<[^<>]*/>$")) & (F.size(F.split(bare, F.concat(F.lit("<"), root, F.lit(r"(?=[\s/>])")))) == 2)
    bad = F.from_xml(rest, F.lit("_bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"]
    return (root != "") & tail & bad.isNull()


def sitemap_score(status: Column, body: Column, url: Column, base: Column) -> Column:
    """Two for each entry, and 20 where the final url is the publication's own; nothing for what is not valid."""
    entries = F.regexp_count(F.lower(body), F.lit("<url>")) + F.regexp_count(F.lower(body), F.lit("<sitemap>"))
    return F.when(sitemap_reason(status, body) == "ok", 2 * entries + F.when(urls.host(url) == urls.host(base), 20).otherwise(0)).otherwise(0)


def feed_reason(url: Column, status: Column, body: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    entries = F.regexp_count(low, F.lit(r"<(item|entry)\b"))
    closed = low.rlike(r"</(rss|feed|rdf:rdf)\s*>")
    code = F.coalesce(status, F.lit(0))
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "missing").when(code != 200, F.concat(F.lit("http_"), code.cast("string"))).when(entries > 0, "ok").when(~closed, "feed_parse_error").otherwise("no_entries")


def best_sitemap(df: DataFrame, group: str) -> DataFrame:
    """The valid candidate of the highest score, the first of equals; the first candidate where none is valid."""
    valid = F.col("reason") == "ok"
    w = Window.partitionBy(group).orderBy(F.when(valid, 0).otherwise(1), F.when(valid, -F.col("score")).otherwise(0), "ord")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def is_active(c: Column, missing: str = "TRUE") -> Column:
    return F.upper(F.coalesce(c, F.lit(missing))) == "TRUE"


def validation_totals(df: DataFrame) -> DataFrame:
    s, r = F.col("sitemap_valid"), F.col("rss_valid")
    return df.agg(F.count("*").alias("total"), F.count_if(s).alias("sitemap_ok"), F.count_if(r).alias("rss_ok"), F.count_if(s & r).alias("both"), F.count_if(~s & ~r).alias("neither"))


def keyword_list(keywords: list[str], least: int = 5, most: int = 25, longest: int = 80) -> list[str]:
    """Trimmed, lower-cased, distinct in order; empty, or `least` to `most` of them."""
    out = list(dict.fromkeys(k.strip().lower() for k in keywords if k.strip()))
    if any(len(k) > longest for k in out) or (out and not least <= len(out) <= most):
        raise ValueError(f"{least} to {most} keywords of up to {longest} characters, or none")
    return out


def keywords_of(given: Column) -> Column:
    """Trimmed, lower-cased, distinct, non-blank keywords in order."""
    return F.array_distinct(F.filter(F.transform(given, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def keywords_fit(keywords: Column, least: int = 5, most: int = 25, longest: int = 80) -> Column:
    """Whether a list is empty, or has `least` to `most` keywords that are short enough."""
    return (F.size(keywords) == 0) | (F.size(keywords).between(least, most) & ~F.exists(keywords, lambda x: F.length(x) > longest))


def is_topic(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin("finance", "luxury"), F.lit(False))


def topic_of(name: Column, default: str = "finance") -> Column:
    return F.when(is_topic(name), F.lower(F.trim(name))).otherwise(default)


def topic(name: str | None, default: str = "finance", strict: bool = False) -> str:
    """A known topic; an unknown one is refused or becomes the default."""
    clean = (name or "").strip().lower()
    if clean in ("finance", "luxury"):
        return clean
    if strict:
        raise ValueError("topic must be finance or luxury")
    return default


def validated_sources(sources: DataFrame, fetches: DataFrame, run_id: str, created_at: Column) -> DataFrame:
    """The detail row of each active source (ord, list_name, publication, base_url, rss_url) on landed fetches (url, status, final_url, body).

    Sitemaps are those that the robots file names and the usual ones; the best valid one is kept, blank where none is."""
    from gleanery.sources import landed

    got = lambda key: fetches.select(F.col("url").alias(key), "status", "final_url", "body")
    origin = F.regexp_replace("base_url", "/+$", "")
    robots = sources.withColumn("_robots", F.concat(origin, F.lit("/robots.txt"))).join(got("_robots"), "_robots", "left")
    robots = robots.select("ord", "base_url", F.when(F.col("status") == 200, F.col("body")).otherwise("").alias("body"))
    tried = landed.robots_sitemaps(robots.withColumnRenamed("base_url", "_base").withColumnRenamed("ord", "_ord").select(F.col("_ord").alias("id"), F.col("_base").alias("base_url"), "body"), key="id").withColumnRenamed("ord", "place")
    tried = tried.join(got("sitemap"), "sitemap", "left")
    final = F.coalesce(F.nullif("final_url", F.lit("")), F.col("sitemap"))
    tried = tried.select(F.col("id").alias("ord"), "place", final.alias("sitemap_url"), sitemap_reason(F.col("status"), F.col("body")).alias("sitemap_reason"), sitemap_score(F.col("status"), F.col("body"), final, F.col("base_url")).alias("score"))
    best = best_sitemap(tried.withColumnsRenamed({"sitemap_reason": "reason", "ord": "id", "place": "ord"}), "id").select(F.col("id").alias("ord"), F.col("reason").alias("sitemap_reason"), F.when(F.col("reason") == "ok", F.col("sitemap_url")).otherwise("").alias("sitemap_url"))
    out = sources.drop("sitemap_url").join(best, "ord", "left").join(got("rss_url"), "rss_url", "left")
    out = out.withColumn("sitemap_reason", F.coalesce("sitemap_reason", F.lit("no_candidates"))).withColumn("rss_reason", feed_reason(F.col("rss_url"), F.col("status"), F.col("body")))
    ok = lambda c: F.col(c) == "ok"
    feed = F.when(ok("rss_reason"), F.coalesce(F.nullif("final_url", F.lit("")), F.col("rss_url"))).otherwise(F.coalesce("rss_url", F.lit("")))
    out = out.withColumns({"sitemap_valid": ok("sitemap_reason"), "rss_valid": ok("rss_reason"), "_feed": feed, "active_after": F.when(ok("sitemap_reason") | ok("rss_reason"), "TRUE").otherwise("FALSE")})
    return out.select(F.lit(run_id).alias("run_id"), "ord", "list_name", "publication", "base_url", F.coalesce("sitemap_url", F.lit("")).alias("sitemap_url"), "sitemap_valid", "sitemap_reason", F.col("_feed").alias("rss_url"), "rss_valid", "rss_reason", "active_after", created_at.alias("created_at"))


def written_back(sources: DataFrame, details: DataFrame) -> DataFrame:
    """The source rows with sitemap, feed and activity as the validation found them; rows outside its scope stay."""
    new = details.select("ord", F.col("sitemap_url").alias("_sitemap"), F.col("rss_url").alias("_rss"), F.col("active_after").alias("_active"))
    out = sources.join(new, "ord", "left")
    taken = F.col("_active").isNotNull()
    return out.withColumns({"sitemap_url": F.when(taken, F.col("_sitemap")).otherwise(F.col("sitemap_url")), "rss_url": F.when(taken, F.col("_rss")).otherwise(F.col("rss_url")), "active": F.when(taken, F.col("_active")).otherwise(F.col("active"))}).drop("_sitemap", "_rss", "_active")
