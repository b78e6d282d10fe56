"""Where queries and their SQL are kept; views used by the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

HOST = r"regexp_replace(lower(regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '')"


def host_sql(u: str) -> str:
    return HOST.replace("{u}", u)


def normalized_sql(u: str, drop_port: bool = False, keep_blank: bool = False) -> str:
    whole = f"regexp_replace(trim(coalesce({u}, '')), '#.*$', '')"
    rest = f"regexp_replace({whole}, '^[A-Za-z][A-Za-z0-9+.-]*:', '')"
    name = rf"regexp_replace(lower(regexp_extract({rest}, '^//([^/?]*)', 1)), '^www\.', '')"
    if drop_port:
        name = rf"regexp_replace({name}, ':\d+$', '')"
    blank = "true" if keep_blank else "regexp_matches(p, '=.')"
    key, value = "split_part(p, '=', 1)", "CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END"
    again = lambda x: f"replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"
    kept = rf"list_filter(string_split(regexp_extract({rest}, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower({key}), 'utm_') AND lower({key}) NOT IN ('gclid', 'fbclid', 'mc_cid', 'mc_eid') AND {blank})"
    params = f"array_to_string(list_transform({kept}, lambda p: {again(key)} || '=' || {again(value)}), '&')"
    scheme = f"coalesce(nullif(lower(regexp_extract({whole}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), ''), 'https')"
    path = f"'/' || ltrim(regexp_replace(regexp_replace(regexp_extract({rest}, '^(?://[^/?]*)?([^?]*)', 1), ';[^/]*$', ''), '/+$', ''), '/')"
    return f"CASE WHEN {whole} = '' THEN '' ELSE {scheme} || '://' || {name} || {path} || CASE WHEN {params} = '' THEN '' ELSE '?' || {params} END END"


#: Urls of pages in the shapes that identities must agree on.
SHAPED = rf"""shaped AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'HTTPS://WWW.' || {host_sql('url')} || '/?utm_source=x&b=1&c=' WHEN 2 THEN url || '?q=a%20b+c~*&GCLID=1'
  WHEN 3 THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) WHEN 4 THEN {host_sql('url')} || '/a/' ELSE regexp_replace(url, '[?#].*$', '') || ';v=1' END AS url FROM pages)"""


ARTICLES = """articles AS (SELECT doc_id AS ord, 'article-' || CAST(doc_id AS VARCHAR) AS id, trim(split_part(text, chr(10), 1)) AS title, substr(text, 1, 200) AS summary,
  source AS publication, text AS content, TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 7919) % 43200 AS BIGINT)) AS collected_at FROM documents)"""
MENTIONS = """mentions AS (SELECT CAST(user_id AS VARCHAR) AS signature, event_type AS publication, 'event://' || CAST(event_id AS VARCHAR) AS url, ts, event_id AS ord FROM events)"""
CANDIDATES = f"""candidates AS (SELECT page_id AS ord, url, {host_sql('url')} AS publication, CASE WHEN page_id % 3 <> 0 THEN 'sitemap' ELSE 'rss' END AS candidate_source,
  CAST((page_id * 37) % 101 AS DOUBLE) / 10 AS score, html FROM pages)"""
OUTCOMES = """outcomes AS (SELECT user_id AS publication, event_id AS ord, CASE event_type WHEN 'error' THEN 'http_403' WHEN 'signup' THEN 'low_score' ELSE 'accepted' END AS outcome, value AS score FROM events)"""
METADATA = "metadata AS (SELECT event_type AS key, CAST(event_id AS VARCHAR) AS value, event_id AS ord FROM events)"
STARS = f"""{CANDIDATES}, stars AS (SELECT ord, sha256({normalized_sql('url')}) AS article_id, '2024-W0' || CAST(ord % 3 + 1 AS VARCHAR) AS week_key,
  CASE WHEN ord % 5 = 0 THEN NULL ELSE ' u' || CAST(ord % 2 AS VARCHAR) END AS "user" FROM candidates WHERE ord % 4 = 0)"""
SOURCES = f"""{CANDIDATES}, source_rows AS (SELECT ord, CASE WHEN ord % 7 = 0 THEN '' ELSE 'List ' || CAST(ord % 5 AS VARCHAR) END AS list_name, publication,
  regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || '/' AS base_url, CASE ord % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'true' ELSE 'FALSE' END AS active FROM candidates)"""


def by_case(c, *values):
    """The value at the number that c holds; null for None."""
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(c == i, v if hasattr(v, "_jc") else F.lit(v)).otherwise(out)
    return out


def by_case_sql(c: str, *values) -> str:
    """The same for DuckDB; strings are quoted."""
    shown = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {c} " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + " END"


def query(name: str, sql: str | None = None, *views: str):
    """Register a function (spark, sf_dir) -> DataFrame; its SQL gets the views as common table expressions."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = ("WITH " + ", ".join(views) + " " if views else "") + sql
        return fn

    return add
