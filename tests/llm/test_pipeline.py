"""The corpus pipeline: stages in order, planted cases, and queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from gleanery.llm.queries import ORACLE_SQL, QUERIES

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALL), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_planted_cases(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(3).collect()
    clean = " ".join(f"clean{i} house{i} river{i}" for i in range(60))
    near = clean.replace("river7 ", "stone7 ")
    rows = [(90_001, clean, "en", "p", 1), (90_002, clean, "en", "p", 1), (90_003, near, "en", "p", 1), (90_004, "quite other words here. " + items[0]["text"], "en", "p", 1), (90_005, "12 34 !!", "en", "p", 1)]
    current, seen = docs.unionByName(spark.createDataFrame(rows, docs.schema)), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, SMALL)
        assert out.columns == docs.columns
        current = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r["doc_id"] for r in current.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)
    assert 90_005 not in seen["language_id"] and 90_001 in seen["language_id"]
    assert {90_001, 90_002, 90_003} & seen["line_dedup"] == {90_001}
    assert 90_004 in seen["ngram_jaccard_join"] and 90_004 not in seen["benchmark_decontamination"]
    assert 90_001 in seen["benchmark_decontamination"]


def test_line_dedup_stage_keeps_own_lines(spark):
    """A document that is mostly lines of others keeps its own, and each line stays in one document."""
    line = lambda n: " ".join(f"w{n}x{i}" for i in range(10))
    lines = {1: range(8), 2: [*range(8), 20, 21], 3: [20, 21, 30], 4: range(8), 5: [0, 20, 30, *range(40, 41)]}
    rows = [(i, "\n".join(map(line, x)), "en", "a", 1) for i, x in lines.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r for r in corpus_pipeline.line_dedup_stage(spark, docs, SMALL).collect()}
    assert {i: r["text"].split("\n") for i, r in got.items()} == {i: [line(n) for n in x] for i, x in {1: range(8), 2: [20, 21], 3: [30], 5: [40]}.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_duplicate_stage_keeps_one(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text, "en", "a", 1), (2, text.replace("w50 ", "x "), "en", "a", 1), (3, " ".join(f"z{i}" for i in range(200)), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()) == [1, 3]


def test_odd_rows_through_all_stages(spark):
    """Nulls, empty texts, repeated rows and ids, and columns with names that stages use, in an empty table and a full one."""
    words = lambda n, k: " ".join(f"house{n} river{i} the" for i in range(k))
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, words(3, 40), "en", None, 1), (3, words(3, 40), "en", None, 1), (3, words(4, 40), "en", "a", 1), (None, words(5, 40), None, "a", 1), (7, words(7, 6000), "en", "a", 1), (8, "12 34", "en", "b", 1), (9, words(5, 40), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = ("doc", "line", "key", "id", "mix_by", "mix_size", "n_hit", "lang_pred", "slot", "row", "tell", "n_lines")
    current = docs.select("*", *[F.lit("mine").alias(c) for c in extra])
    nothing = current.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, current, SMALL), stage(spark, nothing, SMALL)
        assert out.columns == none.columns == current.columns and none.count() == 0
        current = spark.createDataFrame(out.collect(), out.schema)
        assert current.where(" or ".join(f"{c} <> 'mine'" for c in extra)).count() == 0, name
        seen = [r["doc_id"] for r in current.collect()]
        assert not {1, 2, 8} & set(seen)
        if name == "line_dedup":
            assert None in seen and 9 not in seen and 7 in seen
