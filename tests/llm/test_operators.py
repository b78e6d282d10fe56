"""Operators against brute force, exact round trips and held-out accuracy, and their defined cases."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from gleanery.llm import archives, common, decontamination, extraction, language, licenses, line_dedup, mixing, ngram_join, suffix_tree, winnowing
from gleanery.llm.common import components
from gleanery.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = {i: i + 32 for i in range(65, 91)}
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    line = " ".join(BASE)
    variant = " ".join([*BASE[:-1], "omega"])
    long = "\n".join(" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(300))
    texts = [None, "", "   \n\t", "one", line, line, variant, f"{line}\n{variant}\nshort line", line.upper(), long, long + " tail", "x" * 5000, "é ü 漢字 ñandú", "a b c", "a b c"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, line, "en", "s0", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# ---- line dedup

def test_line_dedup_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).limit(120).collect()]
    want = line_dedup.brute_force(rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_line_dedup_dense_group(spark):
    """Variants that are alike only in part: candidates beyond the best one decide."""
    rng = random.Random(2)
    rows = []
    for i in range(60):
        words = list(BASE)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == line_dedup.brute_force(rows)


def test_line_dedup_cases(spark, odd):
    out = line_dedup.deduplicated(odd.withColumn("n_removed", F.lit("mine")).withColumn("line", F.lit(1)))
    rows = {r["doc_id"]: r for r in out.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    assert out.count() == odd.count()
    assert rows[0]["text"] is None and rows[1]["text"] == ""
    assert rows[4]["text"] == "" and rows[7]["text"] == "short line" and rows[14]["text"] == ""  # the null id comes first
    assert line_dedup.deduplicated(odd.limit(0)).count() == 0


def test_line_dedup_short_lines(spark):
    """Lines under 5 words: equality, and 4 of 5 words."""
    rows = [(0, "a\nb c d e\nf g"), (1, "A\nb c d e x\nf h"), (2, "g f\nb c d\n\n a "), (3, "f h k")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == line_dedup.brute_force(rows) == {0: "a\nb c d e\nf g", 1: "f h", 2: "b c d\n", 3: "f h k"}


def test_line_dedup_rows_of_one_id(spark):
    """Two rows of one id whose lines of one number are near copies of different lines: both go, a third row stays."""
    one, two = BASE[:10], [w + "x" for w in BASE[:10]]
    rows = [(1, " ".join(one)), (2, " ".join(two)), (5, " ".join([*one, "n"])), (5, " ".join([*two, "n"])), (5, "something else of its own"), (5, None)]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(1, rows[0][1]), (2, rows[1][1]), (5, ""), (5, ""), (5, ""), (5, rows[4][1])]


def test_line_dedup_many_copies_and_partitions(spark):
    """Copies and near copies dealt over partitions, in no order; columns with names that the operator uses itself."""
    rng = random.Random(9)
    rows = [(i, f"{' '.join(BASE)}\nown{i} words{i}\n{' '.join([*BASE[: rng.randrange(14, 20)], f'v{i % 7}'])}") for i in range(150)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    frame = frame.select("*", *[F.lit(1).alias(c) for c in ("doc", "__removed", "__key", "__slot", "tell", "line", "n_lines")])
    out = line_dedup.deduplicated(frame)
    assert set(frame.columns) <= set(out.columns) and out.where("doc = 1 and __removed = 1 and line = 1").count() == 150
    assert {r["doc_id"]: r["text"] for r in out.collect()} == line_dedup.brute_force(rows)


# ---- n-gram join

@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_matches_brute_force(spark, k, percent):
    rng = random.Random(k)
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).limit(80).collect()]
    base = [f"b{i}" for i in range(120)]
    for i in range(60):  # a dense group of near copies and chains
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(1000)}"
        rows.append((1000 + i, " ".join(words)))
    want = ngram_join.brute_force(rows, k, percent)
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id bigint, text string"), k, percent).collect()}
    assert got == want


def test_ngram_join_wide_documents(spark):
    """Documents of frequent shingles only."""
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common[: 40 + i % 20])) for i in range(40)]
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == ngram_join.brute_force(rows)


@pytest.mark.parametrize("descending", [True, False])
def test_ngram_join_copies_in_any_order(spark, descending):
    """Copies that are met before the one with the smallest id keep the class's links to near copies."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words)) for i in (5, 7, 9)] + [(20, " ".join([*words[:-1], "other"])), (21, " ".join(f"v{i}" for i in range(60)))]
    docs = spark.createDataFrame(sorted(rows, reverse=descending), "doc_id bigint, text string").coalesce(1)
    assert {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_join.join_components(docs).collect()} == ngram_join.brute_force(rows)
    assert sorted(r["doc_id"] for r in ngram_join.deduplicated(docs).collect()) == [5, 21]


def test_ngram_join_cases(spark, odd):
    out = ngram_join.join_components(odd)
    rows = {r["id"]: r for r in out.collect()}
    assert out.count() == odd.count()
    assert rows[0]["n_shingles"] == rows[1]["n_shingles"] == rows[2]["n_shingles"] == 0 and rows[1]["component"] == 1
    assert rows[3]["n_shingles"] == 1 and rows[5]["component"] == rows[4]["component"] == rows[8]["component"] == ngram_join.NO_ID
    assert rows[14]["component"] == 13
    assert ngram_join.join_components(odd.limit(0)).count() == 0
    kept = ngram_join.deduplicated(odd.withColumn("key", F.lit(1)))
    assert kept.columns == [*odd.columns, "key"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (50, 7)]
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in [*range(21), 50]) and got[102] == got[101] == got[100] == 100


# ---- language

def test_language_held_out_accuracy(spark):
    q = QUERIES["op4_language"](spark, SMALL).join(documents(spark).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in q) / len(q) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in q)
    want = {r["doc_id"] for r in documents(spark).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert {r["doc_id"] for r in q} == want


def test_language_code_switching(spark):
    docs = documents(spark)
    model = language.fit(docs)
    pick = {r["lang"]: " ".join(r["text"].split()[:60]) for r in docs.where("n_chars > 800").collect()}
    text = f"{pick['en']} {pick['de']}"
    row = language.identify(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model, segments=True).first()
    runs = row["lang_segments"]
    words = {lang: sum(r["end"] - r["start"] for r in runs if r["lang"] == lang) for lang in ("en", "de")}
    assert words["en"] > 45 and words["de"] > 45 and runs[0]["start"] == 0 and runs[-1]["end"] == 120


def test_language_cases(spark, odd):
    model = language.fit(documents(spark))
    rows = {r["doc_id"]: r for r in language.identify(odd.withColumn("LANG_PRED", F.lit(1)), model).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == "und" and rows[0]["lang_score"] == 0
    assert rows[4]["lang_pred"] in model["labels"]
    assert language.identify(odd, None).where("lang_pred <> 'und'").count() == 0
    assert language.fit(odd.limit(0)) is None


def test_forward_backward_sums_over_paths():
    rng = np.random.default_rng(0)
    e, trans, init = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    gamma, edges, log_z = language.forward_backward(e, np.array([0, 3]), np.array([3, 2]), trans, init)
    import itertools

    total, want = 0.0, np.zeros((5, 3))
    for start, size in ((0, 3), (3, 2)):
        z, part = 0.0, np.zeros((size, 3))
        for path in itertools.product(range(3), repeat=size):
            s = init[path[0]] + sum(e[start + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False))
            z += math.exp(s)
            for i, y in enumerate(path):
                part[i, y] += math.exp(s)
        want[start : start + size] = part / z
        total += math.log(z)
    assert np.allclose(gamma, want) and math.isclose(log_z, total) and math.isclose(edges.sum(), 3)


# ---- fingerprints

@pytest.mark.parametrize(("k", "w"), [(25, 76), (3, 4), (16, 1), (1, 5)])
def test_winnowing_matches_brute_force(k, w):
    rng = random.Random(k)
    for n in (0, 1, 2, k - 1, k, k + 1, k + w - 1, k + w, 300):
        s = "".join(rng.choice("abé日") for _ in range(n))
        for block in (1 << 20, 37):
            h, p = winnowing.winnow(s, k, w, block)
            assert list(zip(h.tolist(), p.tolist(), strict=True)) == winnowing.winnow_brute_force(s, k, w)


def test_winnowing_guarantee():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(20):
        passage = word(winnowing.GUARANTEE)
        a, b = (winnowing.winnow(word(150) + passage + word(90))[0] for _ in range(2))
        assert len(np.intersect1d(a, b)) >= 1


def test_fingerprint_query_follows_ids(spark, odd):
    got = {r["doc_id"]: r for r in winnowing.compare_with_next(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    texts = dict(sorted({r[0]: r[1] or "" for r in odd_rows() if r[0] is not None}.items()))
    ids = list(texts)
    for i, doc_id in enumerate(ids):
        a, b = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[doc_id]["n_chars"] == len(a)
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] == 1.0
    assert winnowing.compare_with_next(odd.limit(0)).count() == 0
    assert winnowing.compare_with_next(odd).count() == odd.count()
    assert winnowing.fingerprints(odd).count() == odd.count()


# ---- language model

def test_suffix_tree_base_score_and_mass(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op6_suffix_tree"](spark, SMALL).collect()}
    docs = documents(spark).collect()
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    tokens = lambda s: [*re.findall(r"[^\x20\x09-\x0D]+", s.translate(LOWER)), "\n"]
    c = Counter(t for r in docs if not out(r["doc_id"]) for t in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    for r in docs:
        ts, got = tokens(r["text"]), rows[r["doc_id"]]
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["held_out"]) == (len(ts), sum(c[t] > 0 for t in ts), n, out(r["doc_id"]))
        assert math.isclose(got["base_score"], base, rel_tol=1e-9)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def suffix_tree_by_hand(texts, min_gain):
    """(P(word | context), words) of the tree grown by plain dictionaries."""
    tokens = [[*t.split(), "\n"] for t in texts]
    c = Counter(tuple(t[i : i + n]) for t in tokens for n in range(1, 5) for i in range(len(t) - n + 1))
    words = [g[0] for g in c if len(g) == 1]
    total = sum(c[w,] for w in words)
    root = lambda w: (c[w,] + 0.1) / (total + 0.1 * (len(words) + 1))
    follow = defaultdict(dict)
    for g, n in c.items():
        if len(g) > 1 and n > 1:
            follow[g[:-1]][g[-1]] = n
    kept, rest, opened = {}, {}, {()}

    def p(context, w):
        if not context:
            return root(w)
        if context not in kept:
            return p(context[1:], w)
        part = (kept[context][w] - 0.5) / c[context] if w in kept[context] else 0.0
        return part + rest[context] * p(context[1:], w)

    counted = {(w,) for w in words}
    for d in (1, 2, 3):
        candidates = [x for x in follow if len(x) == d and x in counted and x[1:] in opened]
        counted = {(*x, w) for x in candidates for w in follow[x]}
        for x in candidates:
            left = 1 - sum(n - 0.5 for n in follow[x].values()) / c[x]
            own = {w: (n - 0.5) / c[x] + left * p(x[1:], w) for w, n in follow[x].items()}
            if sum(-n * math.log(own[w]) for w, n in follow[x].items()) >= min_gain:
                opened.add(x)
            good = {w: n for w, n in follow[x].items() if n * math.log(own[w] / p(x[1:], w)) >= min_gain}
            if good:
                rest[x] = 1 - sum(n - 0.5 for n in good.values()) / c[x]
                kept[x] = good
    return p, words, kept, c


def suffix_tree_texts():
    rng = random.Random(3)
    return [" ".join(rng.choices(["a", "b", "c", "a b", "b c d", "b x c"], k=60) + [f"u{i % 12}", f"v{i % 12}", f"z{i}"]) for i in range(30)]


def test_driver_gets_small_tables_and_keeps_none(spark, monkeypatch):
    """Ranges of bits come compressed, and the n-gram join's broadcasts are gone from the driver when it returns."""
    sent, kept = [], []
    through = common.map_batches
    monkeypatch.setattr(common, "map_batches", lambda *a: sent.append(through(*a)) or sent[-1])
    bits = common.bitmap(spark.range(1000).select(F.col("id") * 1000), 24)
    assert np.flatnonzero(np.unpackbits(bits)).tolist() == list(range(0, 1_000_000, 1000))
    assert sent[0].agg(F.sum(F.length("bytes"))).first()[0] < len(bits) / 50
    share = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: kept.append(share(x)) or kept[-1])
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i // 2, i // 2 + 60))) for i in range(8)], "doc_id long, text string")
    assert ngram_join.join_components(docs).count() == 8
    assert len(kept) == 5 and not any(b._jbroadcast.isValid() for b in kept)


def test_suffix_tree_distributions_sum_to_one():
    """In every context the probabilities of all words and of the unknown one sum to one."""
    p, words, kept, _ = suffix_tree_by_hand(suffix_tree_texts(), 3.0)
    assert {len(x) for x in kept} == {1, 2, 3}
    for context in [(), ("a",), ("zz",), *kept]:
        assert math.isclose(sum(p(context, w) for w in [*words, "never seen"]), 1.0, rel_tol=1e-9), context


@pytest.mark.parametrize("share", [1e-9, 1e-2, 1.0])
@pytest.mark.parametrize("block", [100, 1_500_000])
def test_suffix_tree_matches_brute_force_at_any_share(spark, share, block):
    """Words and n-grams of two occurrences count, whatever part of the corpus they are: broadcast, in part or all looked up."""
    texts = suffix_tree_texts()
    p, _, kept, c = suffix_tree_by_hand(texts, 3.0)
    assert any(c[x] < 5 for x in kept) and any(len(x) == 3 for x in kept)
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("held_out", F.lit(False))
    other = [*texts, "a b zz u1 v1 never b x c", "", "u1 v1"]
    docs = spark.createDataFrame(list(enumerate(other)), "doc_id bigint, text string").withColumn("held_out", F.lit(True)).repartition(3)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, suffix_tree.fit(train, min_gain=3.0, min_share=share, word_share=share / 10, block=block), block=block).collect()}
    for i, t in enumerate([*t.split(), "\n"] for t in other):
        want = sum(math.log10(p(tuple(t[max(0, j - 3) : j]), w)) for j, w in enumerate(t))
        assert math.isclose(got[i], want, rel_tol=1e-9), (i, got[i], want)


def test_suffix_tree_filters_change_no_score(spark, monkeypatch):
    """Contexts that are not candidates get no values, even if every filter lets them through."""
    texts = [f"x q r w{i % 4} x q r w{i % 4} y{i}" for i in range(24)]
    p, _, kept, _ = suffix_tree_by_hand(texts, 3.0)
    assert ("r",) in kept and ("x", "q", "r") not in kept
    monkeypatch.setattr(suffix_tree, "filter_of", lambda *_: np.full(1 << suffix_tree.FILTER_BITS - 3, 255, np.uint8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("held_out", F.lit(False))
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, suffix_tree.fit(docs, min_gain=3.0)).collect()}
    for i, t in enumerate([*t.split(), "\n"] for t in texts):
        assert math.isclose(got[i], sum(math.log10(p(tuple(t[max(0, j - 3) : j]), w)) for j, w in enumerate(t)), rel_tol=1e-9)


def test_suffix_tree_leaves_little_on_disk(spark, monkeypatch):
    """Counting in rounds gives the same tree; shuffle files go with their query, staged tables with their level; lots don't grow with the square of the buckets."""
    docs = spark.createDataFrame(list(enumerate(suffix_tree_texts())), "doc_id bigint, text string").withColumn("held_out", F.lit(False))
    trees = [suffix_tree.fit(docs, min_gain=3.0, rounds=n) for n in ((1,), (2, 3, 4))]
    assert np.array_equal(trees[0].passes, trees[1].passes) and all(np.array_equal(a, b) for a, b in zip(trees[0].hot, trees[1].hot, strict=True))
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5000, np.uint64))
    lot = suffix_tree.lots([(k, suffix_tree.DEEP, 0, suffix_tree.pack(suffix_tree.planes(keys[k::50]), keys[k::50].astype(float))) for k in range(50)])
    dealt = suffix_tree.redealt(spark.createDataFrame(lot.to_pandas(), suffix_tree.LOT).coalesce(1), suffix_tree.DEEP, 50).collect()
    assert len(dealt) == 50 and sorted(r["bucket"] for r in dealt) == list(range(50))
    back = np.concatenate([suffix_tree.from_lot_keys(suffix_tree.unpack(bytes(r["blob"]))[0], 50, r["bucket"]) for r in dealt])
    assert np.array_equal(np.sort(back), keys)
    made = []
    through = common.staged
    monkeypatch.setattr(common, "staged", lambda *a: made.append(through(*a)) or made[-1])
    suffix_tree.fit(docs, min_gain=3.0)
    assert len(made) > 3 and not any(Path(f.removeprefix("file:")).exists() for t in made for f in t.inputFiles())
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with common.shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before


def test_suffix_tree_rounds_and_lookups(spark):
    """Rounds change no score; n-grams are looked up under contexts that may have a value alone."""
    docs = spark.createDataFrame([(i, f"a b c w{i % 5} a b d w{i % 3}", i % 4 == 0) for i in range(60)] + [(None, None, True), (None, "a b", True)], "doc_id long, text string, held_out boolean")
    tree = suffix_tree.fit(docs.where("not held_out"), min_gain=1.0, min_share=1.0, word_share=1.0)
    one, several = (sorted(map(tuple, suffix_tree.score(docs, tree, rounds=n).collect()), key=str) for n in (1, 3))
    assert one == several and len(one) == 62
    h, sizes = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([8])
    none = (np.empty(0, np.uint64), np.empty(0, np.float64))
    passes = np.full(1 << suffix_tree.FILTER_BITS - 3, 255, np.uint8)
    slots = suffix_tree.slot_of(h[:-1] ^ suffix_tree.CONTEXT)
    for s in slots[1:]:  # of contexts of a word, only the first may have a value
        passes[s >> 3] &= 255 ^ (128 >> (s & 7))
    found = [(at[cold], keys[cold]) for at, keys, _, cold in suffix_tree.lookups(h, sizes, none, suffix_tree.bits_of(none[0]), passes, 1)]
    assert [x[0].tolist() for x in found] == [[1], [1]]


def test_suffix_tree_cases(spark, odd):
    docs = odd.withColumn("held_out", F.lit(False))
    tree = suffix_tree.fit(docs)
    got = suffix_tree.score(docs, tree)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == odd.count() and rows[0]["n_tokens"] == rows[1]["n_tokens"] == 1
    assert rows[13]["score"] == rows[14]["score"] and None in rows
    assert suffix_tree.score(docs.limit(0), tree).count() == 0
    none = suffix_tree.fit(odd.limit(0))
    assert suffix_tree.score(docs, none).where("n_known > 0 or base_score <> 0").count() == 0


# ---- archives

def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "http://a", "x" * 200), (1, "http://b\r\nEvil: 1", "x" * 200), (2, None, None), (4, "u", "short"), (5, "u", "short"), (None, "n", "x" * 200), (6, "é", "é" * 60), (6, "é", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/warc"
    archives.write_archives(pages, path)
    got = archives.read_archives(spark, path).collect()
    assert len(got) == len(rows) and not any(r["error"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r)
    assert by[1][0]["record_type"] == "response" and bytes(by[1][0]["payload"]) == b"x" * 200
    assert by[3][0]["record_type"] == by[None][0]["record_type"] == "revisit" and by[3][0]["refers_to"] == by[None][0]["refers_to"] == 1
    assert by[4][0]["record_type"] == by[5][0]["record_type"] == "response" and by[2][0]["payload_bytes"] == 0
    assert by[1][0]["url"] == "http://b%0D%0AEvil:%201" and by[2][0]["url"] is None
    assert all(r["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest() for i, _, h in rows for r in by[i])


def test_archive_validation():
    import zstandard

    good = archives.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 3, None, False)
    assert archives.parsed(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"abc", b"abd"), good.replace(b"response\r\nWARC-R", b"other\r\nWARC-R")):
        with pytest.raises(ValueError):
            archives.parsed(bad)
    dictionary = archives.trained_dictionary([b"alpha beta gamma" * 9] * 3)
    frame = zstandard.ZstdCompressor(dict_data=archives.loaded(dictionary), write_checksum=True).compress(good)
    whole = archives.leading_frame(dictionary) + frame + archives.SEPARATOR.encode() + frame
    assert [r for r, _ in archives.frames(whole)] == [good, good]
    assert [e for _, e in archives.frames(whole[:-9])] == [None, "truncated frame"]
    broken = bytearray(whole)
    broken[len(archives.leading_frame(dictionary)) + len(frame) - 1] ^= 1
    assert [bool(e) for _, e in archives.frames(bytes(broken))] == [True, False]


# ---- extraction

def test_extraction_held_out_layouts():
    model = extraction.fit()
    right = wrong = 0
    for source in extraction.training_pages(80, seed=77):
        page = extraction.Page(source)
        truth = [t.startswith(extraction.MARK) for t in page.texts]
        page.texts = [t.replace(extraction.MARK, "") for t in page.texts]
        for k, g, t in zip(model.labels([page])[0], truth, page.texts, strict=True):
            if t:
                right += k == g
                wrong += k != g
    assert right / (right + wrong) > 0.97


def test_extraction_decoding_is_hierarchical():
    page = extraction.Page("<div><section><p>a</p><p>b</p></section></div><nav>c</nav>")
    rng = np.random.default_rng(3)
    for _ in range(50):
        odds = rng.normal(size=len(page.tags)) * 3
        kept = extraction.decoded(page, odds.tolist())
        assert all(kept[page.parents[i]] for i in range(1, len(kept)) if kept[i])


def test_extraction_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>Tom &amp; Jerry&nbsp;  ran<br>far<script>x</script><p>unclosed"), (4, "u", "no markup"), (5, "u", "<!-- open"), (6, "u", '<p a="unclosed'), (7, "u", "<div>" * 3000 + "deep")]
    out = {r["page_id"]: r for r in extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out[1]["text"] == out[2]["text"] == "" and out[5]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    page = extraction.Page(rows[2][2])
    assert [t for t in page.texts if t] == ["Tom & Jerry ran far", "unclosed"]


def test_extraction_keeps_articles_of_pages(spark):
    got = {r["page_id"]: r["text"] for r in QUERIES["op8_extraction"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        page = extraction.Page(r["html"])
        at = page.tags.index("article")
        assert got[r["page_id"]] == "\n".join(t for t in page.texts[at : page.ends[at]] if t)


# ---- decontamination

def test_decontamination_blocks_and_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()] + [(900, "two words"), (901, ""), (902, None)]
    docs += [(5000, "so Two, words! again two words"), (5001, None), (5002, "")]
    want = decontamination.brute_force(docs, items)
    for size in (32 << 20, 5000):
        out = decontamination.annotate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=size)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["hit_items"]), hashlib.sha256(",".join(sorted(map(str, r["hit_items"]))).encode()).hexdigest(), r["n_hit"] > 0) for r in out.collect()}
        assert got == want
    kept = decontamination.decontaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=5000)
    assert kept.columns == ["doc_id", "text"] and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    assert decontamination.annotate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).where("n_hit > 0").count() == 0


# ---- licenses

def test_license_templates_and_differences(spark):
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES:
        found = scanner.scan(f"Some words before.\nCopyright 2020 Jane Roe\n{text}\nSome words after.")
        assert [(f["license"], f["missing"], f["extra"]) for f in found] == [(name, 0, 0)]
    for name, text in licenses.NOTICES:
        assert name in {f["license"] for f in scanner.scan(f"x\n{text}.\ny")}, text
    changed = scanner.scan(licenses._MIT.replace("merge", "mix"))
    assert [(f["license"], f["missing"], f["extra"]) for f in changed] == [("MIT", 1, 1)]
    assert scanner.scan("Licensed under the Banana License, version 7") == [] and scanner.scan("plain text") == []
    both = scanner.scan("Released under the MIT License.\nLicensed under CC BY-NC 4.0.")
    assert {f["license"] for f in both} == {"MIT", "CC-BY-NC-4.0"}


def test_license_scan_matches_plain_search(spark):
    plain = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "All-Rights-Reserved"}
    got = {r["doc_id"]: r["licenses"] for r in QUERIES["op2_licenses"](spark, SMALL).collect()}
    for r in documents(spark).collect():
        assert got[r["doc_id"]] == ",".join(sorted({v for k, v in plain.items() if k in r["text"]}))


@pytest.mark.parametrize("around", [40, 200, 1000, 5000])
def test_license_inside_long_lines(around):
    """What surrounds a notice or a license text in its line does not hide it."""
    rng = random.Random(around)
    other = lambda: " ".join(rng.choice(BASE) + str(rng.randrange(500)) for _ in range(around))
    for name, text in [("MIT", "Licensed under the MIT License"), ("GPL-3.0", "Released under GPLv3"), ("CC-BY-4.0", "This work is licensed under CC BY 4.0"), *licenses.TEMPLATES]:
        found = licenses.Scanner().scan(f"{other()} {text.replace(chr(10), ' ')} {other()}")
        assert [(f["license"], f["missing"], f["extra"]) for f in found] == [(name, 0, 0)]


@pytest.mark.parametrize("sign", ["", " * ", "# "])
@pytest.mark.parametrize("width", [30, 78])
def test_license_wrapped_texts(width, sign):
    """License texts wrapped to lines, also as comments, are found on the lines they take up."""
    for name, text in [*licenses.TEMPLATES, ("All-Rights-Reserved", "Copyright 2020 Jane Q. Roe. All rights reserved"), ("MIT", "This library is distributed under the MIT License")]:
        lines = [f"{sign}{x}" for p in text.split("\n") for x in [*textwrap.wrap(p, width, break_long_words=False), ""]][:-1]
        found = licenses.Scanner().scan("\n".join(["x = 1", "y = 2", *lines, "z = 3"]))
        assert [(f["license"], f["missing"], f["extra"]) for f in found] == [(name, 0, 0)], name
        if name in dict(licenses.TEMPLATES) and len(lines) > 3:
            assert (found[0]["first_line"], found[0]["last_line"]) == (2, len(lines) + 1)


def test_license_beside_better_ranked_texts(monkeypatch):
    """A true license is confirmed although others have greater reductions and fail the wording test."""
    scanner = licenses.Scanner()
    true = next(n for n, t in enumerate(scanner.templates) if t[0] == "MPL-2.0")
    others = [n for n, t in enumerate(scanner.templates) if len(t[1]) >= licenses.SHORT and n != true]
    monkeypatch.setattr(scanner, "ranked", lambda words: [(0.5, n) for n in others] + [(0.1, true)])
    assert [f["license"] for f in scanner.scan(licenses._MPL)] == ["MPL-2.0"]


def test_license_cases(spark, odd):
    out = licenses.scan_licenses(odd.withColumn("license_matches", F.lit(1)))
    assert out.count() == odd.count() and out.where("size(license_matches) > 0").count() == 0
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


# ---- mixing

def filled(sizes, weights, share, most):
    """Targets by raising a common level until everything is shared out; sources in order."""
    open_, target, left = set(range(len(sizes))), [0.0] * len(sizes), share * sum(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * level >= most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = weights[i] * level
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def test_mixing_targets_and_draws(spark, odd):
    docs = documents(spark).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = mixing.plan_mix(docs.withColumn("mix_size", F.lit("clash"))).collect()
    sizes = Counter()
    for r in rows:
        assert r["mix_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["mix_size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(names))]
    want = dict(zip(names, filled([sizes[s] for s in names], weights, 1.5, 2.0), strict=True))
    for r in rows:
        assert math.isclose(r["mix_target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r["mix_copies"] <= 2
    again = {(r["doc_id"], r["mix_copies"]) for r in mixing.plan_mix(docs).collect()}
    assert again == {(r["doc_id"], r["mix_copies"]) for r in rows}
    taken = sum(r["mix_copies"] * r["mix_size"] for r in rows)
    assert abs(taken - 1.5 * sum(sizes.values())) < 0.15 * 1.5 * sum(sizes.values())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["mix_copies"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_salted_join(spark, monkeypatch):
    want = sorted((r["doc_id"], r["mix_copies"]) for r in mixing.plan_mix(documents(spark)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r["doc_id"], r["mix_copies"]) for r in mixing.plan_mix(documents(spark)).collect()) == want


def test_mixing_is_native(spark):
    plan = QUERIES["op10_mixing"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- cases of all operators

CLASHES = ("id", "key", "n", "doc", "line", "row", "slot", "block", "h", "w", "i", "t", "nx_key", "nx_to", "component", "__spare", "mix_by", "mix_salt", "words", "value")


@pytest.mark.parametrize(
    ("apply", "replaced"),
    [
        (lambda d: language.identify(d, language.fit(d), segments=True), ("lang_pred", "lang_score")),
        (lambda d: decontamination.annotate(d, d.select(F.col("doc_id").alias("item_id"), "text")), ("n_hit", "hit_items")),
        (winnowing.fingerprints, ("fp_hashes",)),
        (ngram_join.deduplicated, ()),
        (line_dedup.deduplicated, ("n_removed",)),
        (licenses.scan_licenses, ("license_matches",)),
        (mixing.plan_mix, ("mix_size", "mix_copies")),
        (mixing.mix, ()),
        (lambda d: extraction.extract(d.withColumnRenamed("text", "html")), ("text",)),
    ],
)
def test_clashing_columns_are_kept(spark, odd, apply, replaced):
    docs = odd.select("*", *[F.lit("mine").alias(c) for c in (*CLASHES, *[r for r in replaced if r not in odd.columns])])
    out = apply(docs)
    rows = out.collect()
    assert rows and all(r[c] == "mine" for r in rows for c in CLASHES)
    assert all(out.columns.count(c) == 1 for c in replaced) and all(r[c] != "mine" for r in rows for c in replaced)
    assert apply(docs.limit(0)).count() == 0


def test_rows_of_one_id_with_other_texts(spark):
    """They are one node to the n-gram join, follow each other for fingerprints, and stand alone elsewhere."""
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(9, a, "s"), (5, a, "s"), (5, b, "s"), (7, b, "s"), (None, "x y", "s"), (None, "z", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    joined = {(r["id"], r["component"]) for r in ngram_join.join_components(docs).where("id > 0").collect()}
    assert joined == {(9, 5), (5, 5), (7, 5)}
    near = winnowing.compare_with_next(docs).collect()
    assert Counter(r["doc_id"] for r in near) == Counter(r[0] for r in rows)
    items = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12)))], "item_id bigint, text string")
    hit = decontamination.annotate(docs, items).where("n_hit > 0").collect()
    assert sorted((r["doc_id"], r["text"] == b) for r in hit) == [(5, True), (7, True)]
    many = spark.createDataFrame([(1, f"{i} " * 3, "s") for i in range(400)] + [(2, "w " * 600, "t")], "doc_id bigint, text string, source string")
    assert len({r["mix_copies"] for r in mixing.plan_mix(many).where("doc_id = 1").collect()}) == 2


def test_fingerprints_follow_a_hot_id(spark):
    """An id with most of the rows is dealt over partitions, and every row still meets its successor."""
    rows = [(5, f"text {i} " + "q" * (i % 7)) for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, f"other {i}") for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    dealt = winnowing.with_next(docs, "doc_id", partitions=12)
    sizes = [r["count"] for r in dealt.groupBy("nx_part").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 120
    got = winnowing.compare_with_next(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    ordered = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h")).orderBy("k", "h", "text").collect()
    want = set()
    for x, y in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        half = len(x["text"]) // 2
        want.add((x["doc_id"], hashlib.sha256((x["text"][: len(x["text"]) - half] + y["text"][:half]).encode()).hexdigest()))
    assert {(r["doc_id"], r["edited_sha256"]) for r in got} == want


def test_fingerprint_likeness_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).limit(25).collect()]
    got = {r["doc_id"]: r for r in winnowing.compare_with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    rows.sort()
    kept = lambda t: {h for h, _ in winnowing.winnow_brute_force(t[:3000])}
    same = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, a), (_, b) in zip(rows, [*rows[1:], rows[0]], strict=True):
        if max(len(a), len(b)) < 3000:
            edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
            assert math.isclose(got[i]["near_edited"], same(kept(a), kept(edited))) and math.isclose(got[i]["near_next"], same(kept(a), kept(b)))
            assert [p for _, p in winnowing.winnow_brute_force(a)] == got[i]["positions"]


def test_long_lines_are_labelled_in_parts(monkeypatch):
    """A line that is run in overlapping parts gets the posteriors that it has as one sequence."""
    rows = [("en", "the house and the river " * 8), ("de", "das haus und der fluss " * 8)] * 3
    model = language.train(rows)
    text = " ".join((["the", "house", "fluss", "und"] * 7 + ["river", "das"] * 5)[i % 38] for i in range(900))
    whole = lambda n: (monkeypatch.setattr(language, "PIECE", n), language.Labeller(model).label([text, "the house\ndas haus", ""]))[1]
    one, parts = whole(10_000), whole(64)
    assert np.allclose(one[0], parts[0], atol=1e-6) and (one[2] == parts[2]).all() and len(one[0]) == 904


def test_large_benchmark_index_is_small():
    """The index takes a few bytes for each byte of text, whatever the words."""
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**7)) for _ in range(150_000)).encode()
    items = [(i, text[i * 1000 : (i + 1) * 1000]) for i in range(len(text) // 1000)]
    index = decontamination.WindowIndex(items, lambda words: np.ones(len(words), np.int64), 10)
    size = sum(x.nbytes for x in (index.key, index.place, index.size, index.hash, index.begin, index.end, index.items_at, index.owner)) + len(index.data)
    assert len(index.key) > 100_000 and size < 8 * len(text)
