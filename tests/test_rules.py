"""Rule vectors, plans and the incremental form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from gleanery.functions import dates, text, urls
from gleanery.operators import ranking, scoring, trends, validation
from gleanery.sources import fixtures


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("title", "content", "score", "found"), [("Gold", "gold ruby", 6.225, ["gold", "ruby"]), ("golden", "", 2.5, ["gold"]), ("", "", 0.0, []), ("gold gold gold", "", 3.375, ["gold"])])
def test_relevance_vectors(spark, title, content, score, found):
    lexicon = scoring.Lexicon(["gold", "ruby"], {"gold": 2.5, "ruby": 2.5})
    r = one(spark, scoring.relevance(text.normalized(F.lit(f"{title} {content}")), lexicon))
    assert (round(r["score"], 6), r["found"]) == (score, found)


@pytest.mark.parametrize(("day", "week"), [("2024-12-30", "2025-W01"), ("2021-01-03", "2020-W53"), ("2024-01-01", "2024-W01")])
def test_iso_weeks(spark, day, week):
    assert one(spark, dates.iso_week(F.lit(day).cast("date"))) == week


@pytest.mark.parametrize(("date", "keep"), [("2024-01-01 00:00:01", True), ("2024-01-01 00:00:00", False), ("2025-01-01 00:00:00", True)])
def test_recency_floors_days(spark, date, keep):
    assert one(spark, dates.is_recent(F.lit(date).cast("timestamp_ntz"), F.lit("2024-01-09 00:00:00").cast("timestamp_ntz"))) is keep


def test_windows():
    d = dt.date
    assert dates.trend_window(d(2024, 1, 22), d(2024, 1, 28), d(2024, 1, 1)) == (d(2024, 1, 22), d(2024, 1, 29), 7)
    assert dates.trend_window(None, None, d(2024, 12, 5)) == (d(2024, 12, 1), d(2025, 1, 1), 31)


def test_url_identity(spark):
    assert one(spark, urls.normalized(F.lit("https://WWW.Ex.com/a/?utm_source=x&b=1&c=#t"))) == "https://ex.com/a?b=1"
    assert one(spark, urls.normalized(F.lit(""))) == ""


@pytest.mark.parametrize(("scores", "cap"), [((11, 11, 11, 11, 11, 9, 9), 10), ((8, 7, 7, 7, 6), 8), ((9, 9, 1), 5)])
def test_dynamic_caps(spark, scores, cap):
    df = spark.createDataFrame([("p", float(s), i) for i, s in enumerate(scores)], "p string, score double, ord int")
    assert ranking.dynamic_caps(df, "p", "score", F.col("ord")).first()["cap"] == cap


def test_keyword_lists():
    assert validation.keyword_list([]) == []
    with pytest.raises(ValueError):
        validation.keyword_list(["a"])


def test_topn_limits_before_the_join(spark):
    df = fixtures.candidates(spark, SMALL)
    assert "WindowGroupLimit" in ranking.top_n(df, "publication", 3, F.desc("score"), F.col("ord"))._jdf.queryExecution().executedPlan().toString()


def test_trend_scan_is_pruned(spark):
    plan = trends.trends(fixtures.mentions(spark, SMALL), dt.date(2024, 1, 22), 7, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "props" not in plan


def test_order_of_input_does_not_matter(spark):
    m = fixtures.mentions(spark, SMALL)
    run = lambda d: sorted(map(tuple, trends.trends(d, dt.date(2024, 1, 22), 7, 3).collect()))
    assert run(m) == run(m.repartition(7, "url"))


def test_collection_against_plain_python(spark):
    rows = [tuple(r) for r in fixtures.outcomes(spark, SMALL).collect()]
    want = set()
    for p in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == p), key=lambda r: r[1])[:20]
        best = sorted((r[3] for r in mine[:5] if r[2] == "accepted" and r[3] >= 1), reverse=True)
        cap = 5
        if best:
            mean = sum(best) / len(best)
            cap = 10 if mean > 10 and sum(s >= 10 for s in best) >= 5 else 8 if mean >= 7 and sum(s >= 7 for s in best) >= 3 else 5
        accepted, bad = [], 0
        for n, r in enumerate(mine):
            if n >= 5 and (len(accepted) >= cap + 3 or bad >= 8):
                break
            if r[2] == "accepted" and r[3] >= 1:
                accepted.append(r)
            bad += r[2] == "http_403"
        want |= {(r[0], r[1]) for r in sorted(accepted, key=lambda r: (-r[3], r[1]))[:cap]}
    assert {(r["publication"], r["ord"]) for r in ranking.collected(fixtures.outcomes(spark, SMALL)).collect()} == want


def test_weekly_stream_equals_batch(spark, tmp_path):
    from gleanery.streaming import weekly

    rows = fixtures.articles(spark, SMALL).select("id", "publication", F.col("collected_at").cast("timestamp").alias("ts"))
    src = f"file://{tmp_path}/in"
    rows.repartition(3).write.parquet(src)
    out = weekly.run_once(spark, src, rows.schema, f"file://{tmp_path}/state")
    key = lambda d: sorted(map(tuple, d.select("week", "publication", "n").collect()))
    assert key(out) == key(weekly.counts(weekly.deduplicated(rows)))


def test_summary_seam_drops_failures(spark):
    from gleanery.operators import models

    df = spark.createDataFrame([(1, "One. Two."), (2, "bad"), (3, None)], "id int, content string")

    def factory():
        def model(t):
            if t == "bad":
                raise ValueError
            return t.upper()

        return model

    assert [tuple(r) for r in models.summarized(df, factory=factory).select("id", "summary").collect()] == [(1, "ONE. TWO.")]
    assert {r["id"]: r["summary"] for r in models.summarized(df).collect()} == {1: "One. Two.", 2: "bad"}


@pytest.mark.parametrize(
    ("shown", "want"),
    [
        ("01/20/2024 10:00:00", "2024-01-20 10:00:00"), ("13/2/2024", None), ("20/01/2024 10:00:00", None), ("2024-01-05T10:00", "2024-01-05 10:00:00"), ("20240105", "2024-01-05 00:00:00"),
        ("2024-1-5", "2024-01-05 00:00:00"), (" 2024-01-05 1:2:3 ", "2024-01-05 01:02:03"), ("2024-01-05T10:00:00.25+02:00", "2024-01-05 10:00:00.25"), ("2024-01-05T10:00:00Z", "2024-01-05 10:00:00"),
        ("2024-W01-5", "2024-01-05 00:00:00"), ("2024-W53-1", None), ("20240105T101112", "2024-01-05 10:11:12"), ("2024-02-30", None), ("2024-01-05T24:00:00", None), ("", None), ("soon", None), (None, None),
    ],
)
def test_dates(spark, shown, want):
    got = one(spark, dates.parsed(F.lit(shown).cast("string")).cast("string"))
    assert got == want


@pytest.mark.parametrize(("shown", "want"), [("2024-01-05T10:00:00+01:00", "2024-01-05 10:00:00"), ("2024-01-05 10:00", "2024-01-05 00:00:00"), ("5 May", None), ("20240105", None)])
def test_lastmod(spark, shown, want):
    assert one(spark, dates.lastmod(F.lit(shown)).cast("string")) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://www.a.com", "https://a.com/"), ("https://a.com/", "https://a.com/"), ("HTTP://A.com:80/x/?b=1&a=%20%2A~", "http://a.com:80/x?b=1&a=+%2A~"), ("a.com/x", "https:///a.com/x"), ("//a.com/x/;p=1?c=%zz", "https://a.com/x?c=%25zz"), ("https://a.com/?utm_source=x&GCLID=1&k", "https://a.com/")],
)
def test_url_identity_shapes(spark, url, want):
    assert one(spark, urls.normalized(F.lit(url))) == want


@pytest.mark.parametrize("link", ["/a", "b", "../c", "./d", "../../../e", "?q=1", "#f", "", "//c.com/d", "http://z.org/x", "x/../y", "..", "a/./b?c=../d"])
@pytest.mark.parametrize("page", ["https://e.com/x/y", "https://e.com", "https://e.com/x/", "https://e.com/x/y?q#f"])
def test_links_against_the_standard_library(spark, link, page):
    from urllib.parse import urljoin

    want = urljoin(page, link)
    assert one(spark, urls.resolved(F.lit(link), F.lit(page))).split("#f")[0] == want.split("#f")[0]


@pytest.mark.parametrize("path", ["/tags/a", "/events/x", "/live-blog/x", "/roundtable", "/conference", "/summit", "/registration", "/event-registration", "/galleries/x"])
def test_paths_that_are_no_articles(spark, path):
    assert one(spark, urls.is_relevant(F.lit("https://e.com" + path))) is False


def test_fragments_of_single_publications(spark):
    u = F.lit("https://www.bbc.com/worklife/x")
    assert one(spark, urls.is_relevant(u, own_paths=urls.own_paths(F.lit("BBC")))) is False
    assert one(spark, urls.is_relevant(u, own_paths=urls.own_paths(F.lit("Other")))) is True


def test_fixed_words(spark):
    assert text.keyword_tokens("This and that are on fire") == ["this", "that", "are", "fire"]
    assert one(spark, text.is_placeholder(F.lit("Lorem ipsum dolor sit amet"))) is False
    assert one(spark, text.is_block_page(F.lit("<p>Access Denied</p>"))) is True


@pytest.mark.parametrize(("body", "want"), [("<urlset><url></urlset>", "xml_parse_error"), ("<urlset><url/></urlset>", "ok"), ("<rss></rss>", "not_sitemap_xml"), ("<urlset></urlset><a/>", "xml_parse_error"), ("<?xml version='1.0'?>\n<sitemapindex a='1'/>", "ok")])
def test_sitemap_bodies(spark, body, want):
    assert one(spark, validation.sitemap_reason(F.lit(200), F.lit(body))) == want


def test_scoring_normalises_once(spark):
    from gleanery.plans import QUERIES

    for name in ("r1_relevance", "a7_o11_top_keywords", "w1_top_by_dynamic_cap"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 1 and final.count("regexp_replace") <= 2, name


def test_numbers_over_partitions(spark):
    from gleanery.operators import store

    rows = spark.range(1000).repartition(7).select((F.col("id") * 7 % 1000).alias("x"))
    assert all(r["n"] == r["x"] + 1 for r in store.numbered(rows, "n", F.col("x")).collect())
    assert store.numbered(rows.limit(0), "n", F.col("x")).count() == 0


def test_failed_run_leaves_its_state(spark):
    from gleanery.operators import batch, store

    paths = [store.work_path(spark, n) for n in ("a", "s")]
    candidates = spark.createDataFrame([], "publication string, url string, candidate_source string, first_score double, ord long, outcome string, score double")
    with pytest.raises(Exception, match="nowhere"):
        batch.run(spark, candidates, candidates.drop("candidate_source"), spark.createDataFrame([], "nowhere string"), *paths)
    state = {r["key"]: r["value"] for r in store.last_value(spark.read.parquet(paths[1]), "key", "value").collect()}
    assert state["status"] == "failed" and state["message"].startswith("Pipeline failed: ") and len(state["message"]) <= 217


def test_lexicon_from_a_file(spark, tmp_path):
    from gleanery.sources import catalog

    lines = ['{"topic": "t", "keyword": "Gold  Ring", "weight": 2.5}', '{"topic": "t", "keyword": "ruby"}', '{"topic": "u", "keyword": "x"}', '{"topic": "t", "terms": ["gold", "ruby"], "bonus": 0.8}']
    (tmp_path / "lexicon.json").write_text("\n".join(lines))
    lexicon = catalog.lexicon(spark, f"file://{tmp_path}/lexicon.json", "t")
    r = one(spark, scoring.relevance(text.normalized(F.lit("A gold ring and a ruby")), lexicon))
    assert round(r["score"], 6) == 2.5 + 1.0 + 0.35 + 0.8 and r["found"] == ["gold ring", "ruby"]
    with pytest.raises(ValueError):
        catalog.lexicon(spark, f"file://{tmp_path}/lexicon.json", "t", 1)
