"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are lower-cased (A-Z) words and one end per text, as 64-bit hashes. The tree grows from
the root, which is the additively smoothed word distribution. A context is a candidate where it
is itself a repeated (`LEAST` = 2 occurrences) n-gram of a candidate or a word, and its suffix is
open: what follows the suffix costs at least MIN_GAIN nats there, so a longer context can gain as much.
Of a candidate's distribution, smoothed by absolute discounting towards its suffix's, a next
word is kept where its divergence test holds: count * ln(P(word|context) / P(word|suffix)) is
at least MIN_GAIN nats. Contexts with such words are retained states; words that are not kept
fall to the longest suffix that is retained. Thresholds are absolute, so the tree grows with the
corpus, and the tests alone prune. A token is scored in the state of its longest suffix.

N-grams are counted exactly over all training texts, level by level: blocks of tokens count
theirs, packed lots go to buckets by suffix (where the suffix's probability waits), and the
repeated ones to buckets by context (where its count waits, and the tests are made), in
`FIT_ROUNDS` rounds of contexts a level, so that the n-grams of one alone are on disk. A text's
score is the sum over its words' root terms, and over its n-grams' and contexts' logarithms;
those of n-grams of at least `MIN_SHARE` of the tokens, which would be hot keys, and counts of
words of `WORD_SHARE` are broadcast (1 / share at most), all others are looked up in buckets, in
`ROUNDS` rounds of texts whose shuffle files go before the next. An n-gram is looked up only
where its context may have a value, as contexts of n-grams with values are retained.
Filters of fixed size keep most n-grams without a value out of the shuffles, which changes the
cost only. A bucket holds its part of the table in memory: their number is that of the session's
shuffle partitions.

Defined cases: a null or empty text is one end token; texts of any length are taken whole;
without training texts N and V are 0 and every token has the root's probability 1; repeated rows
are scored each on its own; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import GOLDEN, RANGES, Scratch, Words, chunks, drop_staged, in_bitmap, map_batches, mixed, read, shuffles_dropped, staged, sweep
from gleanery.llm.language import held_out

DEPTH, LEAST, MIN_GAIN, DISCOUNT, PSEUDO = 3, 2, 10.0, 0.5, 0.1
MIN_SHARE, WORD_SHARE = 2e-6, 1e-6
#: Tokens of a block, counted before the shuffle as numpy arrays.
BLOCK_TOKENS, SCORED_TOKENS, TABLE_ROWS, TEXT_BYTES = 1_500_000, 500_000, 500_000, 1 << 20
#: Texts are scored in so many rounds, so that the queries of one alone are on disk.
ROUNDS = 5
#: N-grams of each level are counted in so many rounds of contexts, for the same reason; the second has most.
FIT_ROUNDS = (2, 5, 1)
#: Lots of a table that are taken together for the bits of a filter.
FILTER_LOTS = 500
#: A filter has 2 ** FILTER_BITS bits, whatever the number of n-grams.
FILTER_BITS = 27
#: The end of a text, and what tells a context's key from that of the same words as an n-gram.
END, CONTEXT = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)


# ---- tokens and n-grams

def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text after text, and the sizes of the texts."""
    words = Words(column)
    sizes = np.bincount(words.owner, minlength=len(column)) + 1
    h = np.full(len(words.h) + len(column), END)
    h[np.arange(len(words.h)) + words.owner] = words.h
    return h, sizes


def blocks(batches, size: int, *others: str) -> Iterator[tuple]:
    """(hashes, sizes, other columns as lists) of `size` tokens, one slice of texts at least."""
    held, n = [], 0
    for batch in chunks(batches, "text", TEXT_BYTES):
        h, sizes = tokens_of(batch.column("text"))
        held.append((h, sizes, *[batch.column(c).to_pylist() for c in others]))
        n += len(h)
        if n > size:
            yield joined(held)
            held, n = [], 0
    if held:
        yield joined(held)


def joined(held: list[tuple]) -> tuple:
    return tuple(np.concatenate(x) if isinstance(x[0], np.ndarray) else [v for part in x for v in part] for x in zip(*held, strict=True))


def longer(context: np.ndarray, suffix: np.ndarray, n: int) -> np.ndarray:
    """The hash of n-grams, from those of their first and of their last n - 1 words."""
    with np.errstate(over="ignore"):
        return mixed(context * GOLDEN + suffix + np.uint64(n))


def ngrams(h: np.ndarray, n: int) -> list[np.ndarray]:
    """For sizes 1 to n: the hash of the n-gram that ends at each token (of no use where it crosses texts)."""
    out = [h]
    for size in range(2, n + 1):
        before = np.concatenate((h[:1], out[-1][:-1]))
        out.append(longer(before, out[-1], size))
    return out


def offsets(sizes: np.ndarray) -> np.ndarray:
    """The place of each token in its text."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# ---- packed lots and sorted tables

def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def small(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def lot_keys(keys: np.ndarray, buckets: int) -> list:
    """The ascending keys of one bucket, of which the bucket says the rest."""
    return planes(keys // np.uint64(buckets))


def from_lot_keys(parts: list, buckets: int, bucket: int) -> np.ndarray:
    return from_planes(parts) * np.uint64(buckets) + np.uint64(bucket)


def planes(ascending: np.ndarray) -> list:
    """Ascending longs as differences, in planes of bytes, as the upper ones are mostly zero."""
    step = np.ascontiguousarray(np.diff(ascending, prepend=np.uint64(0)))
    parts = [np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, i]) for i in range(8)]
    return [x if x.any() else len(x) for x in parts]


def from_planes(parts: list) -> np.ndarray:
    n = next((x if isinstance(x, int) else len(x) for x in parts), 0)
    step = np.zeros((n, 8), np.uint8)
    for i, x in enumerate(parts):
        if not isinstance(x, int):
            step[:, i] = x
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)


def pack_runs(keys: np.ndarray, buckets: int) -> tuple[list, np.ndarray]:
    """Sorted keys of one bucket as distinct ones and their numbers."""
    new = heads(keys)
    return lot_keys(keys[new], buckets), small(np.diff(np.append(new, len(keys))))


def heads(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.empty(0, np.int64)


def dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, the indices of its keys in ascending order)."""
    order = np.argsort(keys)
    bucket = (keys[order] % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    again = np.argsort(bucket, kind="stable")
    order, bucket = order[again], bucket[again]
    cuts = np.append(heads(bucket), len(bucket))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), order[a:b]


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted keys, found)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


LOT = "bucket int, kind int, block bigint, blob binary"


def lots(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "block", "blob"])


def collected(batches, fn) -> Iterator[pa.RecordBatch]:
    """fn(rows) for TABLE_ROWS rows or more at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n > TABLE_ROWS:
            yield fn(pa.Table.from_batches(held))
            held, n = [], 0
    if held:
        yield fn(pa.Table.from_batches(held))


def table_lots(table: DataFrame, values: list[str], buckets: int, kind: int) -> DataFrame:
    """Rows (h, values) as lots of sorted arrays in the buckets of h."""

    def out(rows):
        h, *v = (np.asarray(rows.column(c)) for c in ("h", *values))
        h = h.view(np.uint64)
        return lots([(k, kind, 0, pack(lot_keys(h[at], buckets), *(x[at] for x in v))) for k, at in dealt(h, buckets)])

    return map_batches(table.select("h", *values), lambda batches: collected(batches, out), LOT)


def redealt(table: DataFrame, kind: int, buckets: int) -> DataFrame:
    """Lots that hold whole keys as lots in the buckets of the keys, TABLE_ROWS of them together, so that lots stay few."""

    def work(batches):
        held, n = [], 0

        def out():
            keys, *v = (np.concatenate(x) for x in zip(*held, strict=True))
            return lots([(k, kind, 0, pack(lot_keys(keys[at], buckets), *(small(x[at]) if x.dtype.kind == "u" else x[at] for x in v))) for k, at in dealt(keys, buckets)])

        for b in batches:
            for blob in b.column("blob").to_pylist():
                keys, *v = unpack(blob)
                held.append((from_planes(keys), *v))
                n += len(held[-1][0])
                if n > TABLE_ROWS:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return map_batches(table.where(F.col("kind") == kind).select("blob"), work, LOT)


def in_buckets(parts: DataFrame, buckets: int, fn, schema: str) -> DataFrame:
    """fn(bucket, list of (kind, block, blob)) -> batches, for the lots of each bucket."""

    def work(batches):
        held, at = [], None
        for b in batches:
            for bucket, kind, block, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "block", "blob")), strict=True):
                if bucket != at and held:
                    yield from fn(at, held)
                    held = []
                at = bucket
                held.append((kind, block, blob))
        if held:
            yield from fn(at, held)

    return map_batches(parts.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind"), work, schema)


def sorted_table(held: list, kind: int, buckets: int, bucket: int, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys and one of the columns of the lots of a kind."""
    parts = [unpack(blob) for k, _, blob in held if k == kind]
    h = np.concatenate([from_lot_keys(p[0], buckets, bucket) for p in parts]) if parts else np.empty(0, np.uint64)
    v = np.concatenate([p[column] for p in parts]) if parts else np.empty(0, np.float64)
    order = np.argsort(h)
    return h[order], v[order]


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def filter_of(table: DataFrame, kind: int, buckets: int) -> np.ndarray:
    """Bits of the keys of such lots. Slots travel sorted, their bits compressed: 2 ** (FILTER_BITS - 3) bytes at most, whatever the keys."""
    step = (1 << FILTER_BITS) // RANGES

    def out(rows):
        keys = [from_lot_keys(unpack(blob)[0], buckets, bucket) for bucket, blob in zip(rows["bucket"].to_pylist(), rows["blob"].to_pylist(), strict=True)]
        slots = np.unique(slot_of(np.concatenate(keys))).astype(np.uint64)
        cuts = np.searchsorted(slots, np.arange(RANGES + 1, dtype=np.uint64) * np.uint64(step))
        return lots([(r, 0, 0, pack(planes(slots[a:b] - np.uint64(r * step)))) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])

    def split(batches):
        for b in batches:
            for i in range(0, b.num_rows, FILTER_LOTS):
                yield out(pa.Table.from_batches([b.slice(i, FILTER_LOTS)]))

    def fill(part, held):
        bits = np.zeros(step, bool)
        for _, _, blob in held:
            bits[from_planes(unpack(blob)[0]).astype(np.int64)] = True
        yield lots([(part, 0, 0, zstandard.compress(np.packbits(bits), 1))])

    whole = np.zeros((1 << FILTER_BITS) >> 3, np.uint8)
    own = map_batches(table.where(F.col("kind") == kind).select("bucket", "blob"), split, LOT)
    for r in in_buckets(own, RANGES, fill, LOT).select("bucket", "blob").collect():  # RANGES rows
        whole[r["bucket"] * step >> 3 : (r["bucket"] + 1) * step >> 3] = np.frombuffer(zstandard.decompress(r["blob"]), np.uint8)
    return whole


# ---- the tree

def word_counts(texts: DataFrame, block: int, buckets: int) -> DataFrame:
    """(h, c) of all tokens of column text; blocks count theirs first."""

    def count(batches):
        for h, _ in blocks(batches, block):
            values, n = np.unique(h, return_counts=True)
            yield lots([(k, 0, 0, pack(lot_keys(values[i], buckets), small(n[i]))) for k, i in dealt(values, buckets)])

    def summed(bucket, held):
        h, n = sorted_table(held, 0, buckets, bucket)
        first = heads(h)
        yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.add.reduceat(n.astype(np.int64), first))], names=["h", "c"])

    return in_buckets(map_batches(texts, count, LOT), buckets, summed, "h bigint, c bigint")


#: Kinds of lots: tables of deep values and of words, queries of both, a block's texts, sums for a block.
DEEP, WORD, ASK_DEEP, ASK_WORD, TEXTS, SUMS = range(6)
#: Those of a level: n-grams with counts and probabilities, open contexts, n-grams of a block or of a bucket, frequent values.
LEVEL, OPEN, GRAMS, HOT = range(10, 14)


def block_counts(texts: DataFrame, n: int, passes, opened, buckets: int, block: int, rounds: int, r: int) -> DataFrame:
    """Lots of n-grams of repeated parts whose contexts' suffixes are open, counted by block, in buckets of their suffixes: those of contexts of round r."""

    def work(batches):
        for h, sizes in blocks(batches, block):
            grams = ngrams(h, n - 1)
            at = np.flatnonzero(offsets(sizes) >= n - 1)
            at = at[grams[-1][at - 1] % np.uint64(buckets) % np.uint64(rounds) == r]
            at = at[in_bitmap(passes.value, slot_of(grams[-1][at - 1]))]
            at = at[in_bitmap(passes.value, slot_of(grams[-1][at]))]
            if opened is not None:
                at = at[in_bitmap(opened.value, slot_of(grams[-2][at - 1]))]
            context, suffix = grams[-1][at - 1], grams[-1][at]
            gram = longer(context, suffix, n)
            order = np.argsort(gram)
            first = heads(gram[order])
            c, pick = np.diff(np.append(first, len(order))), order[first]
            context, suffix = context[pick], suffix[pick]
            rows = []
            for k, i in dealt(suffix, buckets):
                values, which = np.unique(context[i], return_inverse=True)
                rows.append((k, GRAMS, 0, pack(*pack_runs(suffix[i], buckets), planes(values), small(which), small(c[i]))))
            yield lots(rows)

    return map_batches(texts, work, LOT)


def repeated(bucket: int, held: list, n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """In a bucket of suffixes: n-grams of LEAST occurrences with their suffix's probability, as lots in buckets of their contexts."""
    known, lower = sorted_table(held, LEVEL, buckets, bucket, 2)
    parts = []
    for kind, _, blob in held:
        if kind == GRAMS:
            values, runs, contexts, which, c = unpack(blob)
            parts.append((np.repeat(from_lot_keys(values, buckets, bucket), runs), from_planes(contexts)[which], c.astype(np.int64)))
    if not parts:
        return
    suffix, context, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    gram = longer(context, suffix, n)
    order = np.argsort(gram)
    first = heads(gram[order])
    total, pick = np.add.reduceat(c[order], first), order[first]
    place, there = found_in(known, suffix[pick])
    p = lower[place] if len(known) else np.empty(len(place))
    keep = there & (total >= LEAST) & (p > 0)
    pick, total, p = pick[keep], total[keep], p[keep]
    context, gram = context[pick], gram[pick]
    yield lots([(k, GRAMS, 0, pack(*pack_runs(context[i], buckets), gram[i], small(total[i]), p[i])) for k, i in dealt(context, buckets)])


def tested(bucket: int, held: list, min_gain: float, hot: float, last: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """In a bucket of contexts: the divergence tests, for contexts that are candidates (filters let others through).

    Lots, not dealt yet, of the values, those of `hot` occurrences apart: of an n-gram that is kept the logarithm that
    it adds, of a context that is retained that of the mass left over. For a level that is not the last, also lots of
    n-grams' counts and their probabilities in the tree (0 where the context is not open), and the open contexts."""
    known, counts = sorted_table(held, LEVEL, buckets, bucket)
    parts = []
    for kind, _, blob in held:
        if kind == GRAMS:
            values, runs, gram, c, lower = unpack(blob)
            parts.append((np.repeat(from_lot_keys(values, buckets, bucket), runs), gram, c.astype(np.float64), lower))
    if not parts:
        return
    context, gram, c, lower = (np.concatenate(x) for x in zip(*parts, strict=True))
    place, there = found_in(known, context)
    whole = counts[place[there]].astype(np.float64) if len(known) else np.empty(0)
    context, gram, c, lower = context[there], gram[there], c[there], lower[there]
    if not len(context):
        return
    order = np.argsort(context)
    context, gram, c, lower, whole = context[order], gram[order], c[order], lower[order], whole[order]
    first = heads(context)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
    part = (c - DISCOUNT) / whole
    rest = 1 - np.add.reduceat(part, first)
    p = part + rest[of] * lower
    opened = np.add.reduceat(-c * np.log(p), first) >= min_gain
    kept = c * np.log(p / lower) >= min_gain
    retained = np.logical_or.reduceat(kept, first)
    rest = 1 - np.add.reduceat(np.where(kept, part, 0.0), first)
    below = np.where(retained, rest, 1.0)[of] * lower
    p = np.where(kept, part + below, below)
    keys = np.concatenate((gram[kept], context[first][retained] ^ CONTEXT))
    v = np.concatenate((np.log10(p[kept] / below[kept]), np.log10(rest[retained])))
    often = np.concatenate((c[kept], whole[first][retained])) >= hot
    rows = [(0, HOT, 0, pack(keys[often], v[often]))] if often.any() else []
    keys, v = keys[~often], v[~often]
    at = np.argsort(keys)
    rows.append((bucket, DEEP, 0, pack(planes(keys[at]), v[at])))
    if not last:
        p = np.where(opened[of], p, 0.0)
        at = np.argsort(gram)
        rows.append((bucket, LEVEL, 0, pack(planes(gram[at]), small(c[at].astype(np.int64)), p[at])))
        if opened.any():
            rows.append((bucket, OPEN, 0, pack(lot_keys(context[first][opened], buckets))))
    yield lots(rows)


class Tree:
    """What is frequent, as sorted arrays: words with counts, keys of n-grams and contexts with logarithms; the rest as tables.

    words (h, c) and cold (lots of values in so many buckets) are staged; passes has the bits of cold."""

    def __init__(self, total: int, distinct: int, buckets: int):
        self.total, self.distinct, self.buckets = total, distinct, buckets
        self.vocabulary = self.hot = (np.empty(0, np.uint64), np.empty(0, np.float64))
        self.passes: np.ndarray | None = None
        self.words: DataFrame | None = None
        self.cold: DataFrame | None = None

    @property
    def floor(self) -> float:
        return max(self.total + PSEUDO * (self.distinct + 1), PSEUDO)


def arrays(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows (h, value), of which there are 1 / share for each level at most, as sorted arrays."""
    frame = rows.select("h", value).toPandas()
    h = frame["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], frame[value].to_numpy(np.float64)[order]


def fit(train: DataFrame, text_col: str = "text", depth: int = DEPTH, min_gain: float = MIN_GAIN, min_share: float = MIN_SHARE, word_share: float = WORD_SHARE, block: int = BLOCK_TOKENS, rounds: tuple[int, ...] = FIT_ROUNDS) -> Tree:
    """Count, smooth, test the divergences level by level, and keep the values of what is retained."""
    spark = train.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = train.select(F.col(f"`{text_col}`").alias("text"))
    with shuffles_dropped(spark):
        words = staged(word_counts(texts, block, buckets), "pst-words")
        total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        tree = Tree(int(total), int(distinct), buckets)
        frequent = F.col("c") >= max(float(LEAST), word_share * total)
        tree.vocabulary, tree.words = arrays(words.where(frequent), "c"), words.where(~frequent)
        if not total or not depth:
            return tree
        often = words.where(F.col("c") >= LEAST).withColumn("p", (F.col("c") + PSEUDO) / F.lit(tree.floor))
        level, scratch = staged(table_lots(often, ["c", "p"], buckets, LEVEL), "pst-level"), Scratch(spark)
        opened, every, hot = None, None, max(LEAST, min_share * total)
        for d in range(1, depth + 1):
            passes, parts = spark.sparkContext.broadcast(filter_of(level, LEVEL, buckets)), None
            n = rounds[min(d, len(rounds)) - 1]
            for r in range(n):
                raw = block_counts(texts, d + 1, passes, opened, buckets, block, n, r).unionByName(level.where(F.col("kind") == LEVEL))
                by_context = in_buckets(raw, buckets, lambda b, held, size=d + 1: repeated(b, held, size, buckets), LOT)
                counts = level.where((F.col("kind") == LEVEL) & (F.col("bucket") % n == r))
                tests = in_buckets(by_context.unionByName(counts), buckets, lambda b, held, last=d == depth: tested(b, held, min_gain, hot, last, buckets), LOT)
                part = scratch.staged(tests.withColumn("value", F.col("kind").isin(DEEP, HOT)), "pst-level", by="value")
                parts = part if parts is None else parts.unionByName(part)
                del raw, by_context, counts, tests
                sweep(spark)
            passes.destroy()
            if opened is not None:
                opened.destroy()
            drop_staged(spark, level)
            found = parts.where("value").drop("value")
            every = found if every is None else every.unionByName(found)
            if d < depth:
                level = staged(redealt(parts.where("not value"), LEVEL, buckets), "pst-level")
                opened = spark.sparkContext.broadcast(filter_of(parts.where("not value"), OPEN, buckets))
                drop_staged(spark, parts, "value=false")
        frequents = [unpack(r["blob"]) for r in every.where(F.col("kind") == HOT).select("blob").collect()]
        if frequents:
            h, v = (np.concatenate(x) for x in zip(*frequents, strict=True))
            order = np.argsort(h)
            tree.hot = h[order], v[order]
        tree.cold = staged(redealt(every, DEEP, buckets), "pst-values")
        tree.passes = filter_of(tree.cold, DEEP, buckets)
        scratch.drop()
    return tree


# ---- scores

def logarithms(keys: np.ndarray, hot: tuple[np.ndarray, np.ndarray], coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, found) of keys among the frequent ones; coarse has bits that tell most others apart."""
    out, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.flatnonzero(in_bitmap(coarse, (keys >> np.uint64(64 - COARSE)).astype(np.int64)))
    place, there = found_in(hot[0], keys[at])
    out[at[there]], found[at[there]] = hot[1][place[there]], True
    return out, found


COARSE = 24


def bits_of(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << COARSE, bool)
    out[(keys >> np.uint64(64 - COARSE)).astype(np.int64)] = True
    return np.packbits(out)


def lookups(h: np.ndarray, sizes: np.ndarray, hot: tuple, hot_bits: np.ndarray, passes: np.ndarray, depth: int) -> Iterator[tuple]:
    """(tokens, keys, values that are broadcast, which keys to look up): for each depth of contexts, then of their n-grams."""
    place, grams = offsets(sizes), ngrams(h, depth + 1)
    for d in range(1, depth + 1):
        at = np.flatnonzero(place >= d)
        for context in (True, False):
            keys = grams[d - 1][at - 1] ^ CONTEXT if context else grams[d][at]
            v, found = logarithms(keys, hot, hot_bits)
            cold = ~found & in_bitmap(passes, slot_of(keys))
            yield at, keys, v, np.flatnonzero(cold)
            at = at[found | cold]  # without a retained context there is no value


def score(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out", depth: int = DEPTH, block: int = SCORED_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    buckets = tree.buckets
    shared = spark.sparkContext.broadcast((tree.vocabulary, tree.hot, tree.passes, tree.floor))
    total, floor = tree.total, tree.floor

    def ask(batches):
        vocabulary, hot, passes, floor = shared.value
        known_bits, hot_bits = bits_of(vocabulary[0]), bits_of(hot[0])
        for i, (h, sizes, ids, out) in enumerate(blocks(batches, block, "id", "out")):
            n, number = len(sizes), (TaskContext.get().partitionId() << 32) + i  # the same if the task runs again
            owner = np.repeat(np.arange(n), sizes)
            c, known = logarithms(h, vocabulary, known_bits)
            base = np.log10((c + PSEUDO) / floor)
            deep = base.copy()
            asked = []
            for at, keys, v, cold in lookups(h, sizes, hot, hot_bits, passes, depth) if passes is not None else ():
                deep[at] += v
                asked.append((keys[cold], owner[at[cold]]))
            sums = [np.bincount(owner, x, n) for x in (base, deep)]
            rows = [(number % buckets, TEXTS, number, pack(ids, out, sizes, np.bincount(owner, known, n).astype(np.int64), *sums))]
            queries = [(ASK_WORD, h[~known], owner[~known])] + [(ASK_DEEP, *(np.concatenate(x) for x in zip(*asked, strict=True)))] * bool(asked)
            for kind, keys, of in queries:
                rows += [(k, kind, number, pack(lot_keys(keys[j], buckets), small(of[j]))) for k, j in dealt(keys, buckets)]
            yield lots(rows)

    def answer(bucket, held):
        tables = {kind: sorted_table(held, kind, buckets, bucket) for kind in (DEEP, WORD)}
        rows = []
        for kind, block, blob in held:
            if kind in (ASK_DEEP, ASK_WORD):
                parts, owner = unpack(blob)
                keys, owner = from_lot_keys(parts, buckets, bucket), owner.astype(np.int64)
                h, v = tables[DEEP if kind == ASK_DEEP else WORD]
                place, found = found_in(h, keys)
                values = v[place[found]].astype(np.float64)
                if kind == ASK_WORD:
                    values = np.log10(values + PSEUDO) - np.log10(PSEUDO)
                texts, which = np.unique(owner[found], return_inverse=True)
                if len(texts):
                    rows.append((0, SUMS, block, pack(kind, small(texts), np.bincount(which, values), small(np.bincount(which)))))
            elif kind == TEXTS:
                rows.append((0, TEXTS, block, blob))
        yield lots(rows)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def gather(batches):
        def block_rows(held):
            texts = [unpack(blob) for kind, blob in held if kind == TEXTS]
            ids, out, sizes, known, base, deep = texts[0]
            for kind, blob in held:
                if kind == SUMS:
                    what, at, values, times = unpack(blob)
                    deep[at] += values
                    if what == ASK_WORD:
                        base[at] += values
                        known[at] += times.astype(np.int64)
            n = len(sizes)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(sizes), pa.array(known), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(deep)], names=names)

        held, at = [], None
        for b in batches:
            for kind, block, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "block", "blob")), strict=True):
                if block != at and held:
                    yield block_rows(held)
                    held = []
                at = block
                held.append((kind, blob))
        if held:
            yield block_rows(held)

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(held_col).alias("out"), F.col(f"`{text_col}`").alias("text"))
    scratch, scored, tables = Scratch(spark), None, tree.cold
    with shuffles_dropped(spark):
        if tree.words is not None:
            rare = scratch.staged(table_lots(tree.words, ["c"], buckets, WORD), "pst-rare")
            tables = rare if tables is None else tables.unionByName(rare)
        for r in range(rounds):
            parts = map_batches(texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == r), ask, LOT)
            every = in_buckets(parts if tables is None else parts.unionByName(tables), buckets, answer, LOT)
            part = staged(map_batches(every.repartition("block").sortWithinPartitions("block"), gather, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"), "pst-scores")
            scored = part if scored is None else scored.unionByName(part)
            del parts, every
            sweep(spark)
    scratch.drop()
    shared.destroy()
    return scored


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 10).alias("held_out"))
    return score(docs, fit(docs.where("not held_out")))
