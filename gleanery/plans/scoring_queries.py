"""Scoring and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators import batch, ranking, scoring, store
from gleanery.plans.registry import ARTICLES, CANDIDATES, MENTIONS, OUTCOMES, by_case, query
from gleanery.sources import fixtures

LEX = fixtures.LEXICON
NORMAL = r"trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'))"
T = NORMAL.format("title || ' ' || content")
D = r"[^\p{L}\p{N}_]"


def occurrences_sql(k: str) -> str:
    doubled = k.replace(" ", "  ")
    return rf"len(regexp_extract_all('  ' || regexp_replace(t, '({D})', '\1\1', 'g') || '  ', '{D}{doubled}{D}'))"


def relevance_sql() -> tuple[str, str]:
    score, repeat, names = [], [], []
    for k in LEX.keywords:
        w = text.keyword_weight(k, LEX.weights)
        tokens = text.keyword_tokens(k)
        hit = f"contains(t, '{k}')"
        part = "(" + " + ".join(f"CASE WHEN contains(t, '{x}') THEN 1 ELSE 0 END" for x in tokens) + " >= 2)" if len(tokens) >= 3 else "false"
        score.append(f"CASE WHEN {hit} THEN {w} WHEN {part} THEN {0.5 * w} ELSE 0 END")
        repeat.append(f"CASE WHEN {hit} THEN greatest(0, least({occurrences_sql(k)}, 2) - 1) * {0.35 * w} ELSE 0 END")
        names.append(f"CASE WHEN {hit} OR {part} THEN '{k}' END")
    combos = " + ".join("CASE WHEN " + " AND ".join(f"contains(t, '{x}')" for x in terms) + f" THEN {b} ELSE 0 END" for terms, b in LEX.combos)
    found = f"list_sort(list_distinct(list_filter([{', '.join(names)}], lambda x: x IS NOT NULL)))"
    whole = f"CAST({' + '.join(score)} AS DOUBLE) + least({' + '.join(repeat)}, 3.0) + least(greatest(0, len({found}) - 1) * 0.35, 2.8) + {combos}"
    return whole, found


SCORE, FOUND = relevance_sql()
SCORED = ARTICLES + f", texts AS (SELECT ord, publication, {T} AS t FROM articles), scored AS (SELECT ord, publication, round({SCORE}, 6) AS score, array_to_string({FOUND}, ',') AS found FROM texts)"


def texts(spark, sf):
    """ord, publication and the normalised text t as a column of its own, so that it is worked out once for all that use it."""
    return fixtures.articles(spark, sf).select("ord", "publication", text.normalized(F.concat_ws(" ", "title", "content")).alias("t"))


def scored(spark, sf):
    a = texts(spark, sf).select("ord", "publication", scoring.relevance(F.col("t"), LEX).alias("r"))
    return a.select("ord", "publication", F.round("r.score", 6).alias("score"), F.array_join("r.found", ",").alias("found"))


@query("r1_relevance", "SELECT ord, score, found FROM scored", SCORED)
def relevance(spark, sf):
    return scored(spark, sf).select("ord", "score", "found")


@query("f1_normalize_text", f"SELECT ord, md5({NORMAL.format('content')}) AS h FROM articles", ARTICLES)
def normalize(spark, sf):
    return fixtures.articles(spark, sf).select("ord", F.md5(text.normalized(F.col("content"))).alias("h"))


@query("f2_keyword_tokens", "SELECT ord, array_to_string(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: len(x) > 2 AND x NOT IN ('the', 'and', 'for', 'with', 'from', 'into', 'of', 'to', 'in', 'on', 'a', 'an')), ',') AS tokens FROM (SELECT ord, title || ' this That are was on An into' AS t FROM articles)", ARTICLES)
def tokens(spark, sf):
    t = F.concat("title", F.lit(" this That are was on An into"))
    return fixtures.articles(spark, sf).select("ord", F.array_join(text.keyword_tokens_column(t), ",").alias("tokens"))


@query("f4_occurrences", f"SELECT ord, CAST({occurrences_sql('tion')} AS INTEGER) AS n FROM texts", SCORED)
def occurrences(spark, sf):
    return texts(spark, sf).select("ord", text.occurrences(F.col("t"), "tion").alias("n"))


@query("f5_combo_bonus", "SELECT ord, CAST(CASE WHEN contains(t, 'queen') AND contains(t, 'tion') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'étion') AND contains(t, 'mentoi') THEN 0.8 ELSE 0 END AS DOUBLE) AS bonus FROM texts", SCORED)
def combos(spark, sf):
    return texts(spark, sf).select("ord", text.combo_bonus(F.col("t"), LEX.combos).alias("bonus"))


TIER = "(" + " + ".join(f"CASE WHEN contains(t, '{k}') THEN {text.keyword_weight(k, LEX.weights)} ELSE 0 END" for k in LEX.keywords) + ")"
HITS = "(" + " + ".join(f"CASE WHEN contains(t, '{k}') THEN 1 ELSE 0 END" for k in LEX.keywords) + ")"


@query("f7_f8_tiered_score", f"SELECT ord, round(CAST({TIER} AS DOUBLE) * CASE WHEN {HITS} > 2 THEN 1.2 ELSE 1.0 END * CASE WHEN {HITS} > 4 THEN 1.4 ELSE 1.0 END, 6) AS score FROM texts", SCORED)
def tiered(spark, sf):
    return texts(spark, sf).select("ord", F.round(scoring.tiered(F.col("t"), LEX), 6).alias("score"))


@query("f9_title_hits", "SELECT ord, CAST((CASE WHEN contains(x, 'tion') THEN 1 ELSE 0 END) + (CASE WHEN contains(x, 'en') THEN 1 ELSE 0 END) AS INTEGER) AS n FROM (SELECT ord, lower(title || ' ' || id) AS x FROM articles)", ARTICLES)
def title_hits(spark, sf):
    return fixtures.articles(spark, sf).select("ord", scoring.title_hits(F.col("title"), F.col("id"), ["tion", "en"]).alias("n"))


@query("j3_text_keyword_join", " UNION ALL ".join(f"SELECT ord, '{k}' AS keyword FROM texts WHERE contains(t, '{k}')" for k in ("queen", "ring", "mentoi")), SCORED)
def text_keyword(spark, sf):
    # the lexicon is known to the driver, so no join is needed: matches are unrolled and exploded
    t = texts(spark, sf)
    found = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(k)), F.lit(k)) for k in ("queen", "ring", "mentoi")]))
    return t.select("ord", F.explode(found).alias("keyword"))


@query("j4_text_combo_join", "SELECT ord FROM texts WHERE contains(t, 'étion') AND contains(t, 'mentoi')", SCORED)
def text_combo(spark, sf):
    t = texts(spark, sf)
    return t.where(text.combo_bonus(F.col("t"), [(("étion", "mentoi"), 1.0)]) > 0).select("ord")


@query("j5_token_fallback", "SELECT ord FROM texts WHERE NOT contains(t, 'thorin thention ringer') AND (CASE WHEN contains(t, 'thorin') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'thention') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'ringer') THEN 1 ELSE 0 END) >= 2", SCORED)
def token_fallback(spark, sf):
    only = scoring.Lexicon(["thorin thention ringer"])
    t = texts(spark, sf)
    return t.where((scoring.relevance(F.col("t"), only)["score"] > 0) & ~F.contains("t", F.lit("thorin thention ringer"))).select("ord")


PLACED = "CASE ord % 5 WHEN 0 THEN ' Lorem ipsum dolor sit amet' WHEN 1 THEN ' Lorem ipsum dolor sit amet, consectetur adipiscing elit' WHEN 2 THEN ' donec neque eros in accumsan, ex a ultrices bibendum' WHEN 3 THEN ' sed do eiusmod lorem ipsum' ELSE '' END"


@query("p8_placeholder", f"SELECT ord FROM (SELECT ord, lower(content || {PLACED}) AS t FROM articles) WHERE NOT (" + " + ".join(f"CASE WHEN contains(t, '{m}') THEN 1 ELSE 0 END" for m in text.PLACEHOLDER_MARKERS) + " >= 2)", ARTICLES)
def placeholder(spark, sf):
    more = by_case(F.col("ord") % 5, " Lorem ipsum dolor sit amet", " Lorem ipsum dolor sit amet, consectetur adipiscing elit", " donec neque eros in accumsan, ex a ultrices bibendum", " sed do eiusmod lorem ipsum", "")
    return fixtures.articles(spark, sf).where(~text.is_placeholder(F.concat("content", more))).select("ord")


@query("p10_score_thresholds", "SELECT CAST(count(*) FILTER (WHERE score >= 0.5) AS BIGINT) AS rss, CAST(count(*) FILTER (WHERE score >= 1.0) AS BIGINT) AS whole, CAST(count(*) FILTER (WHERE score >= 3.0) AS BIGINT) AS strict FROM scored", SCORED)
def thresholds(spark, sf):
    return scored(spark, sf).agg(F.count_if(F.col("score") >= 0.5).alias("rss"), F.count_if(F.col("score") >= 1.0).alias("whole"), F.count_if(F.col("score") >= 3.0).alias("strict"))


CORE = "(contains(found, 'queen') OR contains(found, 'mentoi'))"


@query("p26_p27_verdict", f"SELECT ord, CASE WHEN score > 3 AND {CORE} THEN 'collected' WHEN score > 3 THEN 'no core term' WHEN {CORE} THEN 'low score' ELSE 'not relevant' END AS verdict FROM scored", SCORED)
def verdict(spark, sf):
    s = scored(spark, sf)
    return s.select("ord", scoring.verdict(F.col("score"), text.contains_any(F.col("found"), ["queen", "mentoi"])).alias("verdict"))


@query("a23_relevance_summary", "SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE score > 3) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE NOT score > 3) AS BIGINT) AS failed FROM scored", SCORED)
def summary(spark, sf):
    return scored(spark, sf).agg(F.count("*").alias("checked"), F.count_if(F.col("score") > 3).alias("passed"), F.count_if(~(F.col("score") > 3)).alias("failed"))


@query("a7_o11_top_keywords", "SELECT keyword, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(found, ',')) AS keyword FROM scored WHERE found <> '') GROUP BY keyword ORDER BY n DESC, keyword LIMIT 10", SCORED)
def top_keywords(spark, sf):
    # blank ones go after the split: a filter on the list would work it out twice
    k = scored(spark, sf).select(F.explode(F.split("found", ",")).alias("keyword")).where("keyword <> ''")
    return k.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(10)


@query("a8_average_score", "SELECT round(avg(score), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM scored", SCORED)
def average(spark, sf):
    return scored(spark, sf).agg(F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))


CAPS = """best AS (SELECT *, row_number() OVER (PARTITION BY publication ORDER BY score DESC, ord) AS rank FROM scored),
caps AS (SELECT publication, CAST(count(*) AS BIGINT) AS top, round(avg(score), 6) AS mean, CAST(count(*) FILTER (WHERE score >= 10) AS BIGINT) AS high, CAST(count(*) FILTER (WHERE score >= 7) AS BIGINT) AS good,
  CASE WHEN avg(score) > 10 AND count(*) FILTER (WHERE score >= 10) >= 5 THEN 10 WHEN avg(score) >= 7 AND count(*) FILTER (WHERE score >= 7) >= 3 THEN 8 ELSE 5 END AS cap FROM best WHERE rank <= 7 GROUP BY publication)"""


@query("w2_a18_dynamic_caps", "SELECT publication, top, mean, high, good, cap FROM caps", SCORED, CAPS)
def caps(spark, sf):
    return ranking.dynamic_caps(scored(spark, sf), "publication", "score", F.col("ord")).withColumn("mean", F.round("mean", 6))


@query("w1_top_by_dynamic_cap", "SELECT b.publication, b.ord, b.score, CAST(b.rank AS INTEGER) AS rank, c.cap FROM best b JOIN caps c ON b.publication = c.publication WHERE b.rank <= c.cap", SCORED, CAPS)
def dynamic_top(spark, sf):
    return ranking.top_by_dynamic_cap(scored(spark, sf), "publication", "score", F.col("ord")).select("publication", "ord", "score", "rank", "cap")


@query("w4_fixed_top", "SELECT publication, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY publication ORDER BY score DESC, ord) AS n FROM (SELECT *, row_number() OVER (PARTITION BY publication ORDER BY score DESC, ord) AS tries FROM scored) WHERE tries <= 9 AND score >= 1.0) WHERE n <= 3", SCORED)
def fixed_top(spark, sf):
    tried = ranking.top_n(scored(spark, sf), "publication", 9, F.desc("score"), F.col("ord")).where("score >= 1.0")
    return ranking.top_n(tried.drop("rank"), "publication", 3, F.desc("score"), F.col("ord")).select("publication", "ord", "score")


@query("w5_o2_top3", "SELECT publication, ord, score FROM best WHERE rank <= 3", SCORED, CAPS)
def top3(spark, sf):
    return ranking.top_n(scored(spark, sf), "publication", 3, F.desc("score"), F.col("ord")).select("publication", "ord", "score")


SEEN = """both_runs AS (SELECT ord, regexp_replace(url, '[?#].*$', '') AS url FROM candidates UNION ALL SELECT ord + 1000000, regexp_replace(url, '[?#].*$', '') FROM candidates WHERE ord % 2 = 0)"""


@query("w6_u2_first_by_url", "SELECT url, ord FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS n FROM both_runs) WHERE n = 1", CANDIDATES, SEEN)
def first_by_url(spark, sf):
    c = fixtures.candidates(spark, sf).select("ord", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return ranking.first_by(c.unionByName(c.where("ord % 2 = 0").withColumn("ord", F.col("ord") + 1000000)), "url").select("url", "ord")


@query("w9_early_stop", "SELECT publication, ord FROM (SELECT *, count(*) FILTER (WHERE outcome = 'http_403') OVER w AS bad, count(*) FILTER (WHERE outcome = 'accepted') OVER w AS good FROM outcomes WINDOW w AS (PARTITION BY publication ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE bad < 2 AND good < 8", OUTCOMES)
def early_stop(spark, sf):
    return ranking.before_stop(fixtures.outcomes(spark, sf), "publication", "ord", "outcome", {"http_403": 2, "accepted": 8}).select("publication", "ord")


R4 = """tried AS (SELECT *, row_number() OVER (PARTITION BY publication ORDER BY ord) AS n FROM outcomes),
t2 AS (SELECT *, outcome = 'accepted' AND score >= 1.0 AS ok FROM tried WHERE n <= 20),
pr AS (SELECT publication, score FROM (SELECT *, row_number() OVER (PARTITION BY publication ORDER BY score DESC, ord) AS k FROM t2 WHERE n <= 5 AND ok) WHERE k <= 7),
cp AS (SELECT publication, CASE WHEN avg(score) > 10 AND count(*) FILTER (WHERE score >= 10) >= 5 THEN 10 WHEN avg(score) >= 7 AND count(*) FILTER (WHERE score >= 7) >= 3 THEN 8 ELSE 5 END AS cap FROM pr GROUP BY publication),
t3 AS (SELECT t2.*, greatest(5, coalesce(cap, 5)) AS cap FROM t2 LEFT JOIN cp ON t2.publication = cp.publication),
t4 AS (SELECT *, count(*) FILTER (WHERE ok) OVER w AS good, count(*) FILTER (WHERE outcome = 'http_403') OVER w AS bad FROM t3 WINDOW w AS (PARTITION BY publication ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t5 AS (SELECT *, row_number() OVER (PARTITION BY publication ORDER BY score DESC, ord) AS rank FROM t4 WHERE ok AND (n <= 5 OR (good < cap + 3 AND bad < 8)))"""


@query("r4_collection", "SELECT publication, ord, score, CAST(rank AS INTEGER) AS rank, CAST(cap AS INTEGER) AS cap FROM t5 WHERE rank <= cap", OUTCOMES, R4)
def collection(spark, sf):
    return ranking.collected(fixtures.outcomes(spark, sf))


# candidates of a publication are its events; half of them are feed entries, of which some were candidates already
TRIED = """cands AS (SELECT publication, 'event://' || CAST(ord // 2 * 2 AS VARCHAR) AS url, ord, CASE WHEN ord % 3 = 0 THEN 'rss' ELSE 'sitemap' END AS candidate_source, CAST(ord % 11 AS DOUBLE) AS first_score,
  CASE WHEN publication % 4 = 0 AND ord % 5 > 0 THEN 'http_403' ELSE outcome END AS outcome, score FROM outcomes WHERE ord % 2 = 0),
feeds AS (SELECT publication, 'event://' || CAST(CASE WHEN ord % 3 = 0 THEN ord // 2 * 2 ELSE ord END AS VARCHAR) AS url, ord, CAST(ord % 7 AS DOUBLE) AS first_score, CASE WHEN ord % 4 = 0 THEN 'http_401' ELSE outcome END AS outcome, score FROM outcomes WHERE ord % 2 = 1 OR ord % 10 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY publication ORDER BY CASE candidate_source WHEN 'sitemap' THEN 0 ELSE 1 END, first_score DESC, ord) AS n FROM cands),
q2 AS (SELECT *, outcome = 'accepted' AND score >= 1.0 AS ok FROM placed WHERE n <= 20),
q3 AS (SELECT *, coalesce(CASE WHEN mean > 10 AND high >= 5 THEN 10 WHEN mean >= 7 AND good >= 3 THEN 8 ELSE 5 END, 5) AS cap FROM (SELECT *, avg(CASE WHEN n <= 5 AND ok THEN score END) OVER p AS mean, count(*) FILTER (WHERE n <= 5 AND ok AND score >= 10) OVER p AS high, count(*) FILTER (WHERE n <= 5 AND ok AND score >= 7) OVER p AS good FROM q2 WINDOW p AS (PARTITION BY publication))),
q4 AS (SELECT *, ok AND (n <= 5 OR (a < cap + 3 AND b < 8)) AS taken FROM (SELECT *, count(*) FILTER (WHERE ok) OVER w AS a, count(*) FILTER (WHERE outcome = 'http_403') OVER w AS b FROM q3 WINDOW w AS (PARTITION BY publication ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
had AS (SELECT publication, count(*) FILTER (WHERE taken) AS had, max(cap) AS cap FROM q4 GROUP BY publication),
e1 AS (SELECT f.*, row_number() OVER (PARTITION BY publication ORDER BY first_score DESC, ord) AS n FROM feeds f WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.publication = f.publication AND c.url = f.url)),
e2 AS (SELECT e1.*, h.had, h.cap, outcome = 'accepted' AND score >= 1.0 AS ok FROM e1 JOIN had h ON e1.publication = h.publication WHERE h.had < 3 AND n <= 30),
e3 AS (SELECT *, ok AND had + a < cap + 3 AND b < 5 AND d < 8 AS taken FROM (SELECT *, count(*) FILTER (WHERE ok) OVER w AS a, count(*) FILTER (WHERE outcome = 'http_401') OVER w AS b, count(*) FILTER (WHERE outcome = 'http_403') OVER w AS d FROM e2 WINDOW w AS (PARTITION BY publication ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
gathered AS (SELECT publication, url, ord, score, cap, n FROM q4 WHERE taken UNION ALL SELECT publication, url, ord, score, cap, n + 1000 FROM e3 WHERE taken),
final AS (SELECT *, row_number() OVER (PARTITION BY publication ORDER BY score DESC, n) AS rank FROM gathered)"""


def tried(spark, sf):
    """Candidates and feed entries of publications, as landed with their outcomes."""
    o = fixtures.outcomes(spark, sf)
    even = F.floor(F.col("ord") / 2) * 2
    url = lambda c: F.concat(F.lit("event://"), c.cast("string"))
    first = o.where("ord % 2 = 0").select("publication", url(even).alias("url"), "ord", F.when(F.col("ord") % 3 == 0, "rss").otherwise("sitemap").alias("candidate_source"), (F.col("ord") % 11).cast("double").alias("first_score"), F.when((F.col("publication") % 4 == 0) & (F.col("ord") % 5 > 0), "http_403").otherwise(F.col("outcome")).alias("outcome"), "score")
    feeds = o.where("ord % 2 = 1 or ord % 10 = 0").select("publication", url(F.when(F.col("ord") % 3 == 0, even).otherwise(F.col("ord"))).alias("url"), "ord", (F.col("ord") % 7).cast("double").alias("first_score"), F.when(F.col("ord") % 4 == 0, "http_401").otherwise(F.col("outcome")).alias("outcome"), "score")
    return first, feeds


@query("r4_collection_with_feeds", "SELECT publication, url, ord, score, CAST(rank AS INTEGER) AS rank, CAST(cap AS INTEGER) AS cap FROM final WHERE rank <= cap", OUTCOMES, TRIED)
def collection_with_feeds(spark, sf):
    return ranking.collected_with_feeds(*tried(spark, sf))


@query("r9_batch", "SELECT publication, url, round(score, 2) AS score, CAST(rank AS INTEGER) AS rank, md5('About event ' || url || '.') AS h, (SELECT count(*) FROM final WHERE rank <= cap AND ord % 9 <> 0) AS written, 'complete' AS status FROM final WHERE rank <= cap AND ord % 9 <> 0", OUTCOMES, TRIED)
def batch_run(spark, sf):
    """Collection, summaries, append and state, chained; texts of some candidates are empty, so that their rows are dropped."""
    first, feeds = tried(spark, sf)
    content = lambda d: d.select("publication", "url", "ord", F.when(F.col("ord") % 9 != 0, F.concat(F.lit("About event "), "url", F.lit(". And mo"))).otherwise("").alias("content"))
    landed_texts = content(first).unionByName(content(feeds)).distinct()
    out = batch.run(spark, first, feeds, landed_texts, store.work_path(spark, "articles"), store.work_path(spark, "state"))
    last = store.last_value(out.state, "key", "value").where("key = 'status'").select(F.col("value").alias("status"))
    written = store.last_value(out.state, "key", "value").where("key = 'rows_written'").select(F.col("value").cast("bigint").alias("written"))
    # two single rows joined to all: scalars
    return out.articles.select("publication", "url", "score", "rank", F.md5("summary").alias("h")).join(F.broadcast(last), F.lit(True)).join(F.broadcast(written), F.lit(True))


STREAKS = "runs AS (SELECT signature, publication, ord, sum(change) OVER (PARTITION BY signature ORDER BY ord) AS run FROM (SELECT *, CASE WHEN publication IS NOT DISTINCT FROM lag(publication) OVER (PARTITION BY signature ORDER BY ord) THEN 0 ELSE 1 END AS change FROM mentions))"


@query("w10_streaks", "SELECT signature, CAST(run AS BIGINT) AS run, min(publication) AS publication, min(ord) AS first, CAST(count(*) AS BIGINT) AS polls FROM runs GROUP BY signature, run HAVING count(*) >= 2", MENTIONS, STREAKS)
def state_streaks(spark, sf):
    return ranking.streaks(fixtures.mentions(spark, sf), "signature", "ord", "publication").where("polls >= 2")


@query("a15_fail_counts", "SELECT publication, CAST(count(*) FILTER (WHERE outcome = 'http_403') AS BIGINT) AS http_403, CAST(count(*) FILTER (WHERE outcome = 'low_score') AS BIGINT) AS low_score FROM outcomes GROUP BY publication", OUTCOMES)
def fail_counts(spark, sf):
    return fixtures.outcomes(spark, sf).groupBy("publication").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("http_403", "low_score")])


@query("u1_u6_conditional_union", "SELECT ord, publication, candidate_source FROM candidates c WHERE candidate_source = 'sitemap' OR (SELECT count(*) FROM candidates d WHERE d.publication = c.publication AND d.candidate_source = 'sitemap') < 3", CANDIDATES)
def conditional_union(spark, sf):
    c = fixtures.candidates(spark, sf).select("ord", "publication", "candidate_source")
    return ranking.with_fallback(c.where("candidate_source = 'sitemap'"), c.where("candidate_source = 'rss'"), "publication", 3).select("ord", "publication", "candidate_source")


@query("j2_u5_untried", "SELECT ord, url FROM candidates c WHERE ord % 2 = 0 AND NOT EXISTS (SELECT 1 FROM candidates t WHERE t.candidate_source = 'sitemap' AND t.publication = c.publication AND t.url = c.url)", CANDIDATES)
def untried(spark, sf):
    c = fixtures.candidates(spark, sf)
    return c.where("ord % 2 = 0").join(c.where("candidate_source = 'sitemap'").select("publication", "url"), ["publication", "url"], "left_anti").select("ord", "url")


@query("o1_candidate_order", "SELECT ord, CAST(row_number() OVER (PARTITION BY publication ORDER BY CASE candidate_source WHEN 'sitemap' THEN 0 WHEN 'rss' THEN 1 ELSE 99 END, score DESC, ord) AS INTEGER) AS place FROM candidates", CANDIDATES)
def candidate_order(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("publication").orderBy(ranking.source_priority(F.col("candidate_source")), F.desc("score"), "ord")
    return fixtures.candidates(spark, sf).select("ord", F.row_number().over(w).alias("place"))


@query("o5_o6_cap_before_filter", "SELECT ord FROM (SELECT ord, score, row_number() OVER (PARTITION BY publication ORDER BY ord) AS n FROM candidates) WHERE n <= 2 AND score >= 5", CANDIDATES)
def cap_then_filter(spark, sf):
    return ranking.top_n(fixtures.candidates(spark, sf), "publication", 2, F.col("ord")).where("score >= 5").select("ord")


@query("o10_global_top", "SELECT ord, score FROM (SELECT * FROM candidates ORDER BY score DESC, ord LIMIT 20) WHERE candidate_source = 'sitemap' ORDER BY score DESC, ord LIMIT 10", CANDIDATES)
def global_top(spark, sf):
    first = fixtures.candidates(spark, sf).orderBy(F.desc("score"), "ord").limit(20)
    return first.where("candidate_source = 'sitemap'").orderBy(F.desc("score"), "ord").limit(10).select("ord", "score")


@query("u7_fallback_chain", "SELECT ord, coalesce(CASE WHEN ord % 3 = 0 THEN NULL ELSE title END, CASE WHEN ord % 2 = 0 THEN NULL ELSE summary END, 'none') AS text FROM articles", ARTICLES)
def fallback_chain(spark, sf):
    return fixtures.articles(spark, sf).select("ord", F.coalesce(F.when(F.col("ord") % 3 != 0, F.col("title")), F.when(F.col("ord") % 2 != 0, F.col("summary")), F.lit("none")).alias("text"))
