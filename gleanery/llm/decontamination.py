"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item becomes windows of `window` consecutive words (an item with fewer
words is one window). A document contains a window only if it contains every word of
it, so with words ordered by rarity (occurrences in all documents) the necessary prefix
of a window is its rarest word. Documents look up that word; the position bound (the
window must lie inside the document), the length bound and the window's hash remove
candidates, and an exact comparison of the words confirms the rest.

The index is a set of sorted arrays, 36 bytes for each window beside the items' text (about 7
for each byte of text). It is
sent to the workers in blocks of items of at most `block_bytes` of text; one block is usual,
a larger benchmark makes more passes. Candidates are compared PAIRS at a time, so a frequent
word that many windows begin their search with needs time, not memory.

Defined cases: a null or empty document has no words and no hits; an item without
words is in no window; items of null id mark words but are not counted as items; windows that
several items hold count for each of them; of equally rare words the one of the smaller hash leads;
texts of any length are taken whole; repeated items count once per id, repeated documents
are judged each on its own; an empty table gives an empty result; other columns are kept,
but n_words, n_hit, hit_spans and hit_items are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import Words, chunks, extended, map_batches, mixed, powers, read, staged, with_columns

WINDOW, BLOCK_BYTES = 10, 32 << 20

#: Candidates compared at once.
PAIRS = 2_000_000
#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of code points above 0x7F, and blanks the rest.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
FOLD_VALUES = np.array([0 if FOLD[b] == 0x20 else FOLD[b] + 1 for b in range(256)], np.uint64)

ANNOTATIONS = [
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ("hit_items", T.ArrayType(T.LongType())),
]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


def occurrences(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> np.ndarray:
    """How often all documents use each of the given words (sorted hashes); a row per word and task is shuffled."""
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = wanted.value
        total = np.zeros(len(known), np.int64)
        for batch in chunks(batches, 0):
            at, found = places(known, Words(batch.column(0), FOLD_VALUES).h)
            total += np.bincount(at[found], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for r in map_batches(docs.select(F.col(f"`{text_col}`")), count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():  # the block's words at most
            out[r["at"]] = r["n"]
    return out


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted keys, found)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def span_hashes(h: np.ndarray):
    """A function (starts, sizes) -> hashes of runs of words, the same wherever the run stands."""
    up, down = powers(max(1, len(h)))
    with np.errstate(over="ignore"):
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))

    def of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((before[start + size] - before[start]) * down[start] + size.astype(np.uint64))

    return of


class WindowIndex:
    """Distinct windows by the hash of their rarest word: key (sorted), place of that word, size, hash, text, items."""

    def __init__(self, items: list[tuple[int | None, bytes]], frequency, window: int):
        items = items or [(None, b"")]
        words = Words(pa.array([t for _, t in items], pa.binary()), FOLD_VALUES)
        sizes = np.bincount(words.owner, minlength=len(items))
        first = np.cumsum(sizes) - sizes
        vocabulary, of = np.unique(words.h, return_inverse=True)
        times = frequency(vocabulary)
        order = np.lexsort((vocabulary, times))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rank = rank[of]
        counts = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        start = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        size = np.minimum(window, np.repeat(sizes, counts))
        best = np.full(len(start), np.iinfo(np.int64).max)
        for j in range(window):
            inside = np.flatnonzero(j < size)
            best[inside] = np.minimum(best[inside], (rank[start[inside] + j] << 16) | j)
        place = best & 0xFFFF
        key, hashes = words.h[start + place] if len(start) else words.h, span_hashes(words.h)(start, size)
        order = np.lexsort((hashes, size, place, key))
        key, place, size, hashes, start = (x[order] for x in (key, place, size, hashes, start))
        owner = np.repeat(np.arange(len(items)), counts)[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (size[1:] != size[:-1]) | (hashes[1:] != hashes[:-1])
        self.key, self.place, self.size, self.hash = key[new], place[new].astype(np.uint16), size[new].astype(np.uint16), hashes[new]
        ends = np.append(words.start[1:], len(words.data)) if len(words.start) else words.start
        self.begin, self.end = (x.astype(np.int32) for x in (words.start[start[new]], ends[start[new] + size[new] - 1] if len(start) else start))
        self.data = words.data.tobytes()
        # the items of each distinct window
        self.items_at, self.owner, self.ids = np.append(np.flatnonzero(new), len(key)).astype(np.int32), owner.astype(np.int32), [i for i, _ in items]

    def text(self, w: int) -> bytes:
        return b" ".join(words_of(self.data[self.begin[w] : self.end[w]]))

    def items(self, w: int) -> set:
        return {self.ids[i] for i in self.owner[self.items_at[w] : self.items_at[w + 1]].tolist()}

    def hits(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], set]]:
        """Of each text with hits, by its number: spans of words that a window covers (merged), and the items."""
        at, found = places(self.key, words.h)
        pos = np.flatnonzero(found)
        if not len(pos):
            return {}
        low = at[pos]
        many = np.searchsorted(self.key, words.h[pos], side="right") - low
        sizes = np.bincount(words.owner, minlength=len(words.bounds) - 1)
        first = np.cumsum(sizes) - sizes
        hashes = span_hashes(words.h)
        ends = np.append(words.start[1:], len(words.data)) if len(words.start) else words.start
        out: dict[int, tuple[list[tuple[int, int]], set]] = defaultdict(lambda: ([], set()))
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + PAIRS, PAIRS))
        for i, j in zip(cuts[:-1], [*cuts[1:-1], len(pos)], strict=True):
            n = many[i:j]
            window = np.repeat(low[i:j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(pos[i:j], n) - self.place[window]
            text = np.repeat(words.owner[pos[i:j]], n)
            size = self.size[window].astype(np.int64)
            ok = np.flatnonzero((start >= first[text]) & (start + size <= first[text] + sizes[text]))
            window, start, text, size = window[ok], start[ok], text[ok], size[ok]
            ok = np.flatnonzero(hashes(start, size) == self.hash[window])
            for w, s, t, k in zip(window[ok].tolist(), start[ok].tolist(), text[ok].tolist(), size[ok].tolist(), strict=True):
                if b" ".join(words_of(words.data[words.start[s] : ends[s + k - 1]].tobytes())) == self.text(w):
                    spans, items = out[t]
                    spans.append((s - int(first[t]), s - int(first[t]) + k))
                    items |= self.items(w)
        return {t: (merged(spans), items) for t, (spans, items) in out.items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, drop: bool = False) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (word positions, end exclusive) and hit_items (sorted ids).

    drop: leave out documents with hits instead (the columns of docs only)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t")).where("length(t) > 0")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    schema = extended(docs, ANNOTATIONS)
    current = docs
    for b in range(blocks):
        block = [(r["i"], bytes(r["t"])) for r in items.where(F.col("b") == b).toLocalIterator()]
        index = spark.sparkContext.broadcast(WindowIndex(block, lambda words: occurrences(docs, words, text_col), window))
        last = drop and b == blocks - 1
        current = map_batches(current, marker(index, text_col, b > 0, [n for n, _ in ANNOTATIONS], last), docs.schema if last else schema)
        if b < blocks - 1:
            current = staged(current, "decontamination")
    return current


def marker(index, text_col: str, more: bool, names: list[str], drop: bool):
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]

    def mark(batches):
        for batch in chunks(batches, text_col):
            words = Words(batch.column(text_col), FOLD_VALUES)
            n = batch.num_rows
            hits = index.value.hits(words)
            spans, items = [hits[i][0] if i in hits else [] for i in range(n)], [hits[i][1] - {None} if i in hits else set() for i in range(n)]
            if more:  # earlier blocks' hits
                before = batch.column("hit_spans").to_pylist()
                spans = [merged(a + [(x["start"], x["end"]) for x in b]) for a, b in zip(spans, before, strict=True)]
                items = [a | set(b) for a, b in zip(items, batch.column("hit_items").to_pylist(), strict=True)]
            if drop:
                kept = batch.filter(pa.array([not s for s in spans]))
                yield kept.select([n for n in kept.schema.names if not (more and n in names)])
                continue
            n_hit = [sum(e - s for s, e in x) for x in spans]
            rows = [[{"start": s, "end": e} for s, e in x] for x in spans]
            values = (np.bincount(words.owner, minlength=n), n_hit, rows, [sorted(x) for x in items])
            yield with_columns(batch, {n: pa.array(v, t) for n, v, t in zip(names, values, types, strict=True)})

    return mark


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with their columns as they were."""
    if not {c.lower() for c in docs.columns} & {n for n, _ in ANNOTATIONS}:
        return annotate(docs, benchmark, drop=True, **options)
    text = options.get("text_col", "text")
    rows = docs.select(F.col(f"`{text}`"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("kept"))
    out = annotate(rows, benchmark, drop=True, **options)
    return out.select(*[F.col(f"`{text}`") if c == text else F.col("kept").getField(c).alias(c) for c in docs.columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = annotate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """The contract's columns by comparing every window at every position; for tests."""
    out = {}
    for doc_id, text in docs:
        words = words_of(text and text.encode())
        hit, ids = set(), set()
        for item, t in items:
            for w in windows_of(words_of(t and t.encode()), window):
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        ids.add(item)
        out[doc_id] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))
    return out


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
