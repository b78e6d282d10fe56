"""Scalar functions and predicates (F10-F52, P1-P29) and url joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import dates, states, text, urls
from gleanery.operators import validation
from gleanery.plans.registry import ARTICLES, CANDIDATES, METADATA, SHAPED, SOURCES, STARS, by_case, by_case_sql, normalized_sql, query
from gleanery.plans.registry import host_sql as host_sql
from gleanery.sources import fixtures, landed

AS_OF = "2024-01-20 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def pages(spark, sf):
    return fixtures.table(spark, sf, "pages")


def shaped(spark, sf):
    """Pages under urls of several shapes."""
    u, i = F.col("url"), F.col("page_id") % 6
    odd = F.when(i == 0, u).when(i == 1, F.concat(F.lit("HTTPS://WWW."), urls.host(u), F.lit("/?utm_source=x&b=1&c="))).when(i == 2, F.concat(u, F.lit("?q=a%20b+c~*&GCLID=1")))
    return pages(spark, sf).select("page_id", odd.when(i == 3, F.regexp_replace(urls.base(u), "/$", "")).when(i == 4, F.concat(urls.host(u), F.lit("/a/"))).otherwise(F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit(";v=1"))).alias("url"))


@query("f10_sanitize_url", r"SELECT page_id, regexp_replace(regexp_replace(x, '[\x00-\x1f\x7f]', '', 'g'), '\s+', '', 'g') AS url FROM (SELECT page_id, ' ' || url || chr(9) || ' x' AS x FROM pages)")
def sanitize(spark, sf):
    return pages(spark, sf).select("page_id", urls.sanitized(F.concat(F.lit(" "), "url", F.lit("\t x"))).alias("url"))


@query("f11_normalize_url", f"SELECT page_id, {normalized_sql('url')} AS url FROM shaped", SHAPED)
def normalize_url(spark, sf):
    return shaped(spark, sf).select("page_id", urls.normalized(F.col("url")).alias("url"))


@query("f12_article_id", f"SELECT page_id, sha256({normalized_sql('url')}) AS article_id FROM shaped", SHAPED)
def article_id(spark, sf):
    return shaped(spark, sf).select("page_id", urls.article_id(F.col("url")).alias("article_id"))


@query("f13_host", f"SELECT page_id, {host_sql('url')} AS host FROM pages")
def host(spark, sf):
    return pages(spark, sf).select("page_id", urls.host(F.col("url")).alias("host"))


@query("f14_normalize_url_variant", f"SELECT page_id, {normalized_sql('url', True, True)} AS url FROM shaped", SHAPED)
def normalize_variant(spark, sf):
    return shaped(spark, sf).select("page_id", urls.normalized(F.col("url"), drop_port=True, keep_blank=True).alias("url"))


@query("f15_f16_publication_name", f"SELECT page_id, upper(substr(l, 1, 1)) || substr(l, 2) AS name FROM (SELECT page_id, split_part({host_sql('url')}, '.', 1) AS l FROM pages) WHERE NOT contains(l, '-') AND NOT contains(l, '_')")
def publication_name(spark, sf):
    label = F.substring_index(urls.host(F.col("url")), ".", 1)
    return pages(spark, sf).where(~label.rlike("[-_]")).select("page_id", urls.publication_name(F.col("url")).alias("name"))


@query("f17_base", "SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || '/' AS base FROM pages")
def base(spark, sf):
    return pages(spark, sf).select("page_id", urls.base(F.col("url")).alias("base"))


ORIGIN, PATH = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)", "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
FOLDER = f"coalesce(nullif(regexp_extract({PATH}, '^(.*/)', 1), ''), '/')"


@query("f18_urljoin", rf"SELECT page_id, CASE page_id % 7 WHEN 0 THEN {ORIGIN} || '/a' WHEN 1 THEN {ORIGIN} || {FOLDER} || 'b' WHEN 2 THEN regexp_extract(url, '^([^:]+:)', 1) || '//c.com/d' WHEN 3 THEN 'http://z.org' WHEN 4 THEN {ORIGIN} || {PATH} || '?q=1' WHEN 5 THEN {ORIGIN} || regexp_replace({FOLDER}, '[^/]+/$', '') || 'c' ELSE {ORIGIN} || {FOLDER} || 'd' END AS url FROM pages")
def urljoin(spark, sf):
    link = by_case(F.col("page_id") % 7, "/a", "b", "//c.com/d", "http://z.org", "?q=1", "../c", "./x/../d")
    return pages(spark, sf).select("page_id", urls.resolved(link, F.col("url")).alias("url"))


@query("f19_parse_date", "SELECT event_id, CASE event_id % 11 WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 9 THEN NULL WHEN 2 THEN date_trunc('day', ts) WHEN 7 THEN date_trunc('day', ts) WHEN 8 THEN date_trunc('day', ts) WHEN 6 THEN date_trunc('minute', ts) WHEN 10 THEN CAST(ts AS TIMESTAMP) ELSE date_trunc('second', ts) END AS parsed FROM events")
def parse_date(spark, sf):
    e = fixtures.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    show = lambda f: F.date_format("ts", f)
    whole = F.concat(show("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    week = F.concat(dates.iso_week(F.col("ts")), F.lit("-"), (F.weekday("ts") + 1).cast("string"))
    shapes = (show("yyyy-MM-dd HH:mm:ss"), whole, show("yyyy-MM-dd"), F.lit("soon"), show("M/d/yyyy HH:mm:ss"), show("d/M/yyyy"), show("yyyy-MM-dd'T'HH:mm"), show("yyyyMMdd"), week, F.concat(F.lit("on "), show("yyyy-MM-dd")), show("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return e.select("event_id", dates.parsed(by_case(F.col("event_id") % 11, *shapes)).alias("parsed"))


@query("f20_f21_sitemap_dates", "SELECT page_id, CASE WHEN page_id % 15 BETWEEN 1 AND 12 THEN make_date(2000 + page_id % 30, page_id % 15, 1) END AS month, CASE page_id % 5 WHEN 0 THEN TIMESTAMP '2024-01-05 10:30:00' WHEN 1 THEN TIMESTAMP '2024-01-05' WHEN 3 THEN TIMESTAMP '2024-01-05 10:00:00' END AS lastmod FROM pages")
def sitemap_dates(spark, sf):
    i = F.col("page_id")
    name = F.concat(F.lit("https://e.com/archive/"), (2000 + i % 30).cast("string"), F.lit("-"), (i % 15).cast("string"), F.when(i % 2 == 0, ".xml").otherwise(".xml.gz"))
    shown = by_case(i % 5, "2024-01-05T10:30:00Z", "2024-01-05 and more", "May 5", "2024-01-05T10:00", "20240105")
    return pages(spark, sf).select("page_id", dates.sitemap_month(name).alias("month"), dates.lastmod(shown).alias("lastmod"))


@query("f22_iso_week", "SELECT event_id, strftime(ts, '%G-W%V') AS week FROM events")
def iso_week(spark, sf):
    return fixtures.table(spark, sf, "events").select("event_id", dates.iso_week(F.col("ts").cast("timestamp_ntz")).alias("week"))


@query("f23_previous_weeks", "SELECT DISTINCT CAST(ts AS DATE) AS day, strftime(CAST(ts AS DATE) - 7, '%G-W%V') || ',' || strftime(CAST(ts AS DATE) - 14, '%G-W%V') AS weeks FROM events")
def previous_weeks(spark, sf):
    d = fixtures.table(spark, sf, "events").select(F.col("ts").cast("timestamp_ntz").cast("date").alias("day")).distinct()
    return d.select("day", F.array_join(dates.previous_weeks(F.col("day"), 2), ",").alias("weeks"))


@query("f24_week_start", "SELECT DISTINCT strftime(ts, '%G-W%V') AS week, CAST(date_trunc('week', ts) AS DATE) AS monday FROM events")
def week_start(spark, sf):
    w = fixtures.table(spark, sf, "events").select(dates.iso_week(F.col("ts").cast("timestamp_ntz")).alias("week")).distinct()
    return w.select("week", dates.week_start(F.col("week")).alias("monday"))


@query("f25_day_format", "SELECT event_id, strftime(ts, '%d/%m/%Y') AS day FROM events")
def day_format(spark, sf):
    return fixtures.table(spark, sf, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp_ntz"), "dd/MM/yyyy").alias("day"))


def half_up_sql(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits} + CAST(0.5 AS DOUBLE)) / CAST({10**digits} AS DOUBLE)"


def half_up(x, digits: int):
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


MEASURES = ("(value + 1) / (event_id % 7 + 1)", "(value - event_id % 7) / (event_id % 7 + 1) * 100", "(value + 1) / (event_id % 7 + 1) * ln(1 + value)")


# rounding is spelled out, as the engines' round() differ on ties of binary fractions
@query("f27_f28_measures", f"SELECT event_id, {half_up_sql(MEASURES[0], 3)} AS lift, {half_up_sql(MEASURES[1], 2)} AS pct, {half_up_sql(MEASURES[2], 4)} AS score FROM events WHERE value >= 0")
def measures(spark, sf):
    b = F.col("event_id") % 7
    e = fixtures.table(spark, sf, "events").where("value >= 0")
    lift = (F.col("value") + 1) / (b + 1)
    return e.select("event_id", half_up(lift, 3).alias("lift"), half_up((F.col("value") - b) / (b + 1) * 100, 2).alias("pct"), half_up(lift * F.log(1 + F.col("value")), 4).alias("score"))


@query("f30_f37_f49_document_text", "SELECT ord, md5(coalesce(nullif(title, ''), id) || '. ' || summary) AS doc, len(substr(content, 1, 4000)) AS cut FROM articles", ARTICLES)
def document_text(spark, sf):
    a = fixtures.articles(spark, sf)
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("id"))
    return a.select("ord", F.md5(F.concat(title, F.lit(". "), "summary")).alias("doc"), F.length(F.left("content", F.lit(4000))).cast("bigint").alias("cut"))


@query("f31_split_urls", "SELECT page_id, array_to_string(list_filter(list_transform(string_split(url || ' | ' || url || '|x', '|'), lambda x: trim(x)), lambda x, i: x <> '' AND i <> 2), ',') AS urls FROM pages")
def split_urls(spark, sf):
    return pages(spark, sf).select("page_id", F.array_join(text.split_list(F.concat("url", F.lit(" | "), "url", F.lit("|x"))), ",").alias("urls"))


NAMED = r"(?:\b[Bb]y\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"


@query("f32_byline", rf"SELECT ord, nullif(regexp_extract(CASE ord % 4 WHEN 0 THEN 'Report by Jane Doe today. ' WHEN 1 THEN 'by jane doe ' WHEN 2 THEN 'By Ann Lee Roe, ' ELSE '' END || summary, '{NAMED}', 1), '') AS author FROM articles", ARTICLES)
def byline(spark, sf):
    head = by_case(F.col("ord") % 4, "Report by Jane Doe today. ", "by jane doe ", "By Ann Lee Roe, ", "")
    return fixtures.articles(spark, sf).select("ord", text.byline(F.concat(head, "summary")).alias("author"))


@query("f33_byline_variants", rf"SELECT ord, coalesce(nullif(regexp_extract(t, '{NAMED}', 1), ''), nullif(regexp_extract(t, 'Author:\s*([A-Z][a-z]+)', 1), '')) AS author FROM (SELECT ord, substr(CASE ord % 3 WHEN 0 THEN 'Written by Jane Doe ' || content WHEN 1 THEN 'Author: Kim. ' || content ELSE content || ' by Late Name' END, 1, 500) AS t FROM articles)", ARTICLES)
def byline_variants(spark, sf):
    t = by_case(F.col("ord") % 3, F.concat(F.lit("Written by Jane Doe "), "content"), F.concat(F.lit("Author: Kim. "), "content"), F.concat("content", F.lit(" by Late Name")))
    return fixtures.articles(spark, sf).select("ord", text.byline_variants(t, [text.BYLINE, r"Author:\s*([A-Z][a-z]+)"], 500).alias("author"))


@query("f34_f35_author", f"SELECT page_id, {by_case_sql('page_id % 6', 'Jane', 'Kim', 'Unknown', 'Ann Roe', 'Unknown', 'From Tool')} AS author FROM pages")
def author(spark, sf):
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    i = F.col("page_id") % 6
    head = by_case(i, ld('{"author": {"name": "Jane"}}'), ld('[{"a": 1}, {"author": {"name": "Kim"}}]'), ld('{"author": {"name": " "}}'), "", ld("not json"), "")
    tool = F.when(i == 5, " From Tool ").otherwise("")
    return pages(spark, sf).select("page_id", text.resolved_author(text.json_ld_author(F.concat(head, "html")), tool, text.byline(F.when(i == 3, "by Ann Roe").otherwise(""))).alias("author"))


@query("f36_longer_description", "SELECT ord, md5(CASE WHEN len(title) > len(summary) THEN title ELSE summary END) AS h FROM articles", ARTICLES)
def longer(spark, sf):
    return fixtures.articles(spark, sf).select("ord", F.md5(text.longer(F.col("summary"), F.col("title"))).alias("h"))


STATES = [(200, False, 0, "empty_or_filtered"), (200, True, 0, "parse_error"), (200, False, 3, "ok"), (403, False, 0, "blocked"), (None, False, 0, "request_error"), (503, False, 0, "server_error"), (302, False, 0, "http_302"), (404, False, 0, "not_found"), (429, False, 0, "rate_limited")]


@query("f38_fetch_state", f"SELECT event_id, {by_case_sql('event_id % 9', *[x[3] for x in STATES])} AS state FROM events")
def fetch_state(spark, sf):
    code, bad, found = (by_case(F.col("event_id") % 9, *[x[i] for x in STATES]) for i in range(3))
    return fixtures.table(spark, sf, "events").select("event_id", states.fetch_state(code.cast("int"), bad, found).alias("state"))


@query("f39_r7_health", "SELECT page_id, rss, CASE WHEN site IN ('ok', 'not_configured') OR rss IN ('ok', 'not_configured') THEN 'healthy' ELSE 'needs_attention' END AS overall FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'blocked' WHEN 1 THEN 'ok' ELSE 'empty_or_filtered' END AS site, CASE WHEN page_id % 4 = 0 THEN 'not_configured' WHEN page_id % 4 > 1 AND page_id % 5 > 0 THEN 'ok' WHEN page_id % 4 > 1 THEN 'empty_or_filtered' ELSE 'blocked_or_unavailable' END AS rss FROM pages)")
def health(spark, sf):
    p = pages(spark, sf)
    site = F.when(F.col("page_id") % 3 == 0, "blocked").when(F.col("page_id") % 3 == 1, "ok").otherwise("empty_or_filtered")
    feeds, good = F.col("page_id") % 4, F.greatest(F.col("page_id") % 4 - 1, F.lit(0))
    rss = states.rss_state(feeds, good, F.col("page_id") % 5)
    return p.select("page_id", rss.alias("rss"), states.overall(site, rss).alias("overall"))


ERRORS = [("HTTP 403", "forbidden"), ("Forbidden here", "forbidden"), ("forbidden", "other"), ("Not Found", "not_found"), ("404", "not_found"), ("Too Many", "rate_limited"), ("429 slow", "rate_limited"), ("Read Timeout", "timeout"), ("SSL handshake", "ssl"), ("bad ssl", "ssl"), ("boom", "other"), ("SSL 404", "not_found")]


@query("f40_error_class", f"SELECT event_id, {by_case_sql('event_id % 12', *[x[1] for x in ERRORS])} AS kind FROM events")
def error_class(spark, sf):
    return fixtures.table(spark, sf, "events").select("event_id", states.error_class(by_case(F.col("event_id") % 12, *[x[0] for x in ERRORS])).alias("kind"))


RUN_STATES = [("waiting", None, "a", "odd", "queued", "running"), ("in_progress", None, "b", "complete", "running", "stale"), ("completed", "success", "a", "Complete ", "success", "complete"), ("completed", "failure", "a", "failed", "failed", "failed"), ("odd", None, "a", None, "idle", "running")]


@query("f41_f42_f43_run_states", f"SELECT event_id, {by_case_sql('event_id % 5', *[x[4] for x in RUN_STATES])} AS state, {by_case_sql('event_id % 5', *[x[5] for x in RUN_STATES])} AS trend FROM events")
def run_states(spark, sf):
    status, ended, run, trend = (by_case(F.col("event_id") % 5, *[x[i] for x in RUN_STATES]) for i in range(4))
    return fixtures.table(spark, sf, "events").select("event_id", states.run_state(status, ended.cast("string")).alias("state"), states.trend_run_state(run, F.lit("a"), trend).alias("trend"))


@query("f44_cooldown", "SELECT event_id, greatest(0, 1800 - event_id % 4000) AS retry_after, CAST(ceil(greatest(0, 1800 - event_id % 4000) / CAST(60 AS DOUBLE)) AS BIGINT) AS minutes FROM events")
def cooldown(spark, sf):
    wait = states.retry_after(F.col("event_id") % 4000)
    return fixtures.table(spark, sf, "events").select("event_id", wait.alias("retry_after"), F.ceil(wait / 60.0).alias("minutes"))


@query("f45_f46_list_rows", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'finance' ELSE 'luxury' END AS topic, 'n' AS name, url || ',x' AS rest FROM pages")
def list_rows(spark, sf):
    line = F.concat(F.lit("n,"), "url", F.lit(",x"))
    name = F.when(F.col("page_id") % 2 == 0, "UK Finance").otherwise("other")
    return pages(spark, sf).select("page_id", states.topic_of_list(name).alias("topic"), F.substring_index(line, ",", 1).alias("name"), F.substring(line, F.locate(",", line) + 1, F.length(line)).alias("rest"))


@query("f47_f50_f51_f52_progress", "SELECT event_id, CAST(CASE WHEN event_id % 9 = 0 THEN 0 ELSE least(100, round(event_id % 13 * 100.0 / (event_id % 9))) END AS INTEGER) AS percent, CASE WHEN event_id % 200 >= 60 THEN CAST(event_id % 200 // 60 AS VARCHAR) || 'm ' || CAST(event_id % 200 % 60 AS VARCHAR) || 's' ELSE CAST(event_id % 200 AS VARCHAR) || 's' END AS remaining, CASE WHEN event_id % 30 = 0 THEN 'default' WHEN event_id % 30 < 5 THEN 'too_few' WHEN event_id % 30 > 25 THEN 'too_many' WHEN event_id % 30 > 15 THEN 'broad' ELSE 'good' END AS band, CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 35 WHEN 'signup' THEN 60 ELSE 10 END AS phase FROM events")
def progress(spark, sf):
    i = F.col("event_id")
    return fixtures.table(spark, sf, "events").select("event_id", states.progress(i % 13, i % 9).alias("percent"), states.remaining(i % 200).alias("remaining"), states.keyword_band(i % 30).alias("band"), states.phase_progress(F.col("event_type"), ["view", "click", "signup"]).alias("phase"))


@query("f48_p29_article_rows", "SELECT ord, 'article-20240120-' || CAST(row_number() OVER (ORDER BY ord) AS VARCHAR) AS id, round(coalesce(score, 0), 2) AS score, 'Unknown' AS author, '' AS summary FROM candidates", CANDIDATES)
def article_rows(spark, sf):
    from gleanery.operators import store

    rows = store.numbered(fixtures.candidates(spark, sf).select("ord", "score"), "n", F.col("ord"))
    return rows.select("ord", store.numbered_ids(F.col("n"), "20240120").alias("id"), F.round(F.coalesce("score", F.lit(0.0)), 2).alias("score"), F.lit("Unknown").alias("author"), F.lit("").alias("summary"))


def age_sql(n: int) -> str:
    return f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', collected_at))) / 86400) <= {n}"


@query("p1_p2_recency", f"SELECT ord, {age_sql(7)} AS week, {age_sql(14)} AS fortnight, true AS ever FROM articles", ARTICLES)
def recency(spark, sf):
    d = F.col("collected_at")
    return fixtures.articles(spark, sf).select("ord", dates.is_recent(d, as_of(), 7).alias("week"), dates.is_recent(d, as_of(), 14).alias("fortnight"), dates.is_recent(d, as_of(), None).alias("ever"))


FRAGMENTS = ("/tags/", "/events/", "/live-blog/", "/roundtable", "/event-registration/x", "/story", "/news/topics/x", "/iplayer")
PUBLICATIONS = ("BBC", "The Telegraph", "Other")
BLOCKED_SQL = " OR ".join(f"contains(u, '{p}')" for p in urls.BLOCKED_PATHS)
OWN_SQL = " OR ".join(f"(p = '{name}' AND ({' OR '.join(f"contains(u, '{x}')" for x in paths)}))" for name, paths in urls.OWN_PATHS.items())
HOST_SQL = " OR ".join(f"contains(split_part(split_part(u, '://', 2), '/', 1), '{h}')" for h in urls.BLOCKED_HOSTS)


@query("p3_r3_url_relevance", f"SELECT page_id FROM (SELECT page_id, {by_case_sql('page_id % 3', *PUBLICATIONS)} AS p, regexp_replace(lower(CASE page_id % 11 WHEN 8 THEN '{urls.SECTION_PAGES[-1]}/' WHEN 9 THEN 'https://events.e.com/a' WHEN 10 THEN url ELSE regexp_replace(url, '[?#].*$', '') || {by_case_sql('page_id % 11', *FRAGMENTS)} END), '/+$', '') AS u FROM pages) WHERE NOT ({BLOCKED_SQL} OR {OWN_SQL} OR {HOST_SQL} OR u = '{urls.SECTION_PAGES[-1]}')")
def url_relevance(spark, sf):
    i, bare = F.col("page_id") % 11, F.regexp_replace("url", "[?#].*$", "")
    u = F.when(i == 8, urls.SECTION_PAGES[-1] + "/").when(i == 9, "https://events.e.com/a").when(i == 10, F.col("url")).otherwise(F.concat(bare, by_case(i, *FRAGMENTS)))
    publication = by_case(F.col("page_id") % 3, *PUBLICATIONS)
    return pages(spark, sf).where(urls.is_relevant(u, own_paths=urls.own_paths(publication))).select("page_id")


@query("p4_j14_url_relevance_variants", "SELECT page_id FROM (SELECT page_id, regexp_replace(lower(url), '/+$', '') AS u, split_part(split_part(url, '://', 2), '/', 1) AS h FROM pages) WHERE (contains(u, 'th') OR contains(u, 'spam')) AND NOT contains(u, '/de/') AND NOT (h = 'spam-farm.example.org' AND contains(u, '/en/7'))")
def url_variants(spark, sf):
    own = spark.createDataFrame([("spam-farm.example.org", ["/en/7"])], "h string, own array<string>")
    p = pages(spark, sf).withColumn("h", F.substring_index(F.substring_index("url", "://", -1), "/", 1)).join(F.broadcast(own), "h", "left")
    return p.where(urls.is_relevant(F.col("url"), (), (), ("/de/",), F.col("own"), ["th", "spam"])).select("page_id")


VALIDITY = [("http://a.com:0/", False, True), ("http://a.com:80/", True, True), ("ftp://a.com", False, False), ("http://a.com:x/", False, True), ("http://[::1]:x/", True, True), ("HTTP://a.com", True, True), (None, False, False)]


@query("p5_p7_url_validity", f"SELECT page_id, CASE WHEN page_id % 8 = 7 THEN true ELSE {by_case_sql('page_id % 8', *[x[1] for x in VALIDITY])} END AS fetchable, CASE WHEN page_id % 8 = 7 THEN true ELSE {by_case_sql('page_id % 8', *[x[2] for x in VALIDITY])} END AS valid FROM pages")
def validity(spark, sf):
    u = F.when(F.col("page_id") % 8 == 7, F.col("url")).otherwise(by_case(F.col("page_id") % 8, *[x[0] for x in VALIDITY]))
    return pages(spark, sf).select("page_id", urls.is_fetchable(u).alias("fetchable"), urls.is_valid(u).alias("valid"))


@query("p6_p11_presence", "SELECT ord FROM articles WHERE len(content) >= 150 AND trim(title) <> '' AND trim(id) <> ''", ARTICLES)
def presence(spark, sf):
    return fixtures.articles(spark, sf).where((F.length("content") >= 150) & (F.trim("title") != "") & (F.trim("id") != "")).select("ord")


@query("p9_p14_active", "SELECT ord, upper(coalesce(a, 'TRUE')) = 'TRUE' AS source, upper(coalesce(a, 'FALSE')) = 'TRUE' AS menu FROM (SELECT ord, CASE WHEN ord % 5 = 0 THEN ' true' ELSE active END AS a FROM source_rows)", SOURCES)
def active(spark, sf):
    a = F.when(F.col("ord") % 5 == 0, " true").otherwise(F.col("active"))
    return fixtures.source_rows(spark, sf).select("ord", validation.is_active(a).alias("source"), validation.is_active(a, "FALSE").alias("menu"))


@query("p12_blocked_fallback", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'title' ELSE 'url' END AS title FROM events WHERE event_type = 'error' AND value >= 10")
def blocked_fallback(spark, sf):
    e = fixtures.table(spark, sf, "events").withColumn("status", F.when(F.col("event_type") == "error", 403).otherwise(200))
    title = F.when(F.col("event_id") % 2 == 0, "title")
    return e.where(F.col("status").isin(401, 403, 429) & (F.col("value") >= 10)).select("event_id", F.coalesce(title, F.lit("url")).alias("title"))


@query("p15_p16_a17_latest_run", "SELECT ord, collected_at >= (SELECT max(collected_at) FROM articles) - INTERVAL 5 MINUTE AS latest, collected_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AS week FROM articles", ARTICLES)
def latest_run(spark, sf):
    a = fixtures.articles(spark, sf)
    last = a.agg(F.max("collected_at").alias("last")).withColumn("one", F.lit(1))
    # one row joined by a constant key: a scalar
    joined = a.withColumn("one", F.lit(1)).join(F.broadcast(last), "one")
    return joined.select("ord", (F.col("collected_at") >= F.col("last") - F.expr("INTERVAL 5 MINUTES")).alias("latest"), (F.col("collected_at") >= as_of() - F.expr("INTERVAL 7 DAYS")).alias("week"))


@query("p17_stars_by_week", "SELECT ord FROM stars WHERE trim(week_key) = '2024-W01' AND coalesce(trim(\"user\"), 'default') = 'default'", STARS)
def stars_by_week(spark, sf):
    return fixtures.stars(spark, sf).where((F.trim("week_key") == "2024-W01") & (F.coalesce(F.trim("user"), F.lit("default")) == "default")).select("ord")


@query("p18_p19_latest_trends", "SELECT o.event_id FROM events o JOIN (SELECT arg_max(value, ord) AS run FROM metadata WHERE key = 'click') m ON CAST(o.event_id AS VARCHAR) = m.run WHERE o.event_type <> '__NO_TRENDS__'", METADATA)
def latest_trends(spark, sf):
    run = fixtures.metadata(spark, sf).where("key = 'click'").agg(F.max_by("value", "ord").alias("run"))
    e = fixtures.table(spark, sf, "events").where("event_type <> '__NO_TRENDS__'")
    return e.join(F.broadcast(run), e["event_id"].cast("string") == F.col("run")).select("event_id")


@query("p20_keyword_list", "SELECT ord, array_to_string(k, '|') AS keywords, len(k) = 0 OR (len(k) BETWEEN 5 AND 25 AND len(list_filter(k, lambda x: len(x) > 12)) = 0) AS valid FROM (SELECT ord, CASE WHEN ord % 9 = 0 THEN [] ELSE list_filter(list_transform(string_split(title, ','), lambda x: lower(trim(x))), lambda x: x <> '') END AS l, [l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i] AS k FROM articles)", ARTICLES)
def keyword_list(spark, sf):
    given = F.when(F.col("ord") % 9 == 0, F.lit("")).otherwise(F.col("title"))
    k = validation.keywords_of(F.split(given, ","))
    return fixtures.articles(spark, sf).select("ord", F.array_join(k, "|").alias("keywords"), validation.keywords_fit(k, longest=12).alias("valid"))


@query("p21_topic", f"SELECT event_id, {by_case_sql('event_id % 4', 'luxury', 'finance', 'finance', 'finance')} AS topic, {by_case_sql('event_id % 4', True, True, False, False)} AS known FROM events")
def topic(spark, sf):
    given = by_case(F.col("event_id") % 4, " Luxury ", "FINANCE", "cars", None)
    return fixtures.table(spark, sf, "events").select("event_id", validation.topic_of(given).alias("topic"), validation.is_topic(given).alias("known"))


@query("p22_p24_feed_validity", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 4 = 0 THEN 'http_404' WHEN page_id % 3 <> 0 THEN 'ok' WHEN page_id % 5 = 0 THEN 'feed_parse_error' ELSE 'no_entries' END AS reason FROM pages")
def feed_validity(spark, sf):
    i = F.col("page_id")
    body = F.concat(F.lit("<feed>"), F.when(i % 3 == 0, "").otherwise("<entry>x</entry>"), F.when(i % 5 == 0, "").otherwise("</feed>"))
    return pages(spark, sf).select("page_id", validation.feed_reason(F.when(i % 7 != 0, F.col("url")), F.when(i % 4 == 0, 404).otherwise(200), body).alias("reason"))


MAPS = [(200, "<urlset><url></url><url></url></urlset>", "ok", 4), (200, "<!DOCTYPE html><html></html>", "html_not_xml", 0), (200, "<rss></rss>", "not_sitemap_xml", 0), (200, "<urlset><url>", "xml_parse_error", 0), (500, "", "http_500", 0), (200, "<urlset><url></urlset>", "xml_parse_error", 0), (None, None, "http_0", 0), (200, '<?xml version="1.0"?><!-- a --><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>x</loc></sitemap></sitemapindex>', "ok", 2), (200, "<urlset><url></urlset></url>", "xml_parse_error", 0), (200, "none", "xml_parse_error", 0)]


@query("p23_sitemap_validity", f"SELECT page_id, {by_case_sql('page_id % 10', *[x[2] for x in MAPS])} AS reason, {by_case_sql('page_id % 10', *[x[3] for x in MAPS])} + CASE WHEN page_id % 10 IN (0, 7) AND page_id % 4 < 3 THEN 20 ELSE 0 END AS score FROM pages")
def sitemap_validity(spark, sf):
    status, body = (by_case(F.col("page_id") % 10, *[x[i] for x in MAPS]) for i in range(2))
    final = F.when(F.col("page_id") % 4 < 3, F.concat(urls.base(F.col("url")), F.lit("s.xml"))).otherwise("https://elsewhere.org/s.xml")
    return pages(spark, sf).select("page_id", validation.sitemap_reason(status, body).alias("reason"), validation.sitemap_score(status, body, final, F.col("url")).alias("score"))


@query("p25_block_page", "SELECT page_id, " + " OR ".join(f"contains(h, '{w}')" for w in text.BLOCK_WORDS) + f" AS blocked FROM (SELECT page_id, lower(html || {by_case_sql('page_id % 8', 'Access Denied', 'CAPTCHA', 'denied', 'DataDome', 'Blocked', 'forbidden', '', 'ok')}) AS h FROM pages)")
def block_page(spark, sf):
    more = by_case(F.col("page_id") % 8, "Access Denied", "CAPTCHA", "denied", "DataDome", "Blocked", "forbidden", "", "ok")
    return pages(spark, sf).select("page_id", text.is_block_page(F.concat("html", more)).alias("blocked"))


@query("j1_host_semi_join", "SELECT ord FROM candidates WHERE publication IN (SELECT publication FROM candidates WHERE ord % 5 = 0)", CANDIDATES)
def host_semi_join(spark, sf):
    c = fixtures.candidates(spark, sf)
    return c.join(c.where("ord % 5 = 0").select("publication"), "publication", "left_semi").select("ord")


@query("j9_j10_catalog_subset", "SELECT publication, count(*) > 0 AS has_rows FROM candidates WHERE publication LIKE '%example.net' GROUP BY publication", CANDIDATES)
def catalog_subset(spark, sf):
    c = fixtures.candidates(spark, sf)
    wanted = c.where(F.col("publication").like("%example.net")).select("publication").distinct()
    return c.join(wanted, "publication", "left_semi").groupBy("publication").agg((F.count("*") > 0).alias("has_rows"))


@query("j11_j12_star_flags", f"SELECT ord, sha256({normalized_sql('url')}) IN (SELECT article_id FROM stars) AS starred FROM candidates", STARS)
def star_flags(spark, sf):
    marks = fixtures.stars(spark, sf).select("article_id").distinct().withColumn("mark", F.lit(True))
    c = fixtures.candidates(spark, sf).withColumn("article_id", urls.article_id(F.col("url")))
    return c.join(marks, "article_id", "left").select("ord", F.coalesce("mark", F.lit(False)).alias("starred"))


@query("j13_o12_url_lookup", "SELECT page_id FROM pages WHERE rtrim(url, '/') = 'https://m.ththth.example.net/en/25#top' OR contains(url, '/en/25') ORDER BY page_id LIMIT 5")
def url_lookup(spark, sf):
    wanted = "https://m.ththth.example.net/en/25#top"
    same = F.rtrim("url", F.lit("/")) == wanted
    return pages(spark, sf).where(same | F.contains("url", F.lit("/en/25"))).orderBy("page_id").limit(5).select("page_id")


@query("s12_m6_page_text", r"""SELECT page_id, md5(c) AS h FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|header|footer|aside)\b[^>]*>.*?</(script|style|nav|header|footer|aside)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM pages) WHERE len(c) >= 150""")
def page_text(spark, sf):
    return landed.page_rows(pages(spark, sf)).select("page_id", F.md5("content").alias("h"))


@query("s14_title", "SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)) AS title FROM pages")
def title(spark, sf):
    return pages(spark, sf).select("page_id", text.page_title(F.col("html")).alias("title"))


@query("m1_m2_lead_summary", "SELECT ord, md5(CASE WHEN s <> '' THEN s ELSE substr(content, 1, 300) END) AS h FROM (SELECT ord, content, regexp_extract(substr(content, 1, 300), '(?s)^(.*[.!?])', 1) AS s FROM articles)", ARTICLES)
def lead(spark, sf):
    return fixtures.articles(spark, sf).select("ord", F.md5(text.lead_summary(F.col("content"))).alias("h"))


@query("w7_ordered_distinct", "SELECT ord, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i], ' ') AS words FROM (SELECT ord, string_split(title, ' ') AS l FROM articles)", ARTICLES)
def ordered_distinct(spark, sf):
    return fixtures.articles(spark, sf).select("ord", F.array_join(F.array_distinct(F.split("title", " ")), " ").alias("words"))


@query("p13_pending", "SELECT event_id FROM events WHERE event_type = 'signup'")
def pending(spark, sf):
    status = F.when(F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 0, "Pending").otherwise("")).otherwise("sent")
    return fixtures.table(spark, sf, "events").where(F.lower(F.coalesce(F.nullif(status, F.lit("")), F.lit("pending"))) == "pending").select("event_id")


@query("o4_o9_article_order", "SELECT ord, CAST(row_number() OVER (PARTITION BY publication ORDER BY collected_at DESC NULLS LAST, ord) AS INTEGER) AS place FROM articles", ARTICLES)
def article_order(spark, sf):
    w = Window.partitionBy("publication").orderBy(F.desc_nulls_last("collected_at"), "ord")
    return fixtures.articles(spark, sf).select("ord", F.row_number().over(w).alias("place"))
