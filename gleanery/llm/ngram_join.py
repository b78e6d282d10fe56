"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles (hashed to 64 bits). Shingles have one
global order: rare ones first, then the frequent class by frequency, then by hash. With n
shingles and threshold t, a linked pair shares at least two shingles among the first
n - ceil(t n) + 2 of each (the extended prefix), and one among the first n - ceil(t n) + 1.
So the index keys of a document are

* each rare shingle of the extended prefix, singly;
* each pair of frequent shingles of the extended prefix, up to `COMBINED` of them;
* where a document has more (it is then called wide), each frequent shingle of the plain
  prefix; all documents have those keys, but only pairs with a wide document count there.

Documents that share a key, pass the length and position bounds and are not known to be in
one component are verified on their whole texts. A key's group is never expanded into all its
pairs at once: first all members are paired with the group's most central document (the one
with the largest part of frequent shingles) and with the smallest id, the links found are
turned into components, and only pairs across components remain for the last round. There a
512-bit parity sketch of each set bounds the shingles that differ from below, which tells most pairs
of a dense group that are just not alike enough. Equal sets are one class from the start.

Rare shingles known to be in several documents (of a sample of twice each prefix) come after the
others. The frequent class comes from a table of fixed size (2 ** TABLE_BITS slots) filled with what
blocks of documents hold at least twice; keys that one document alone has are dropped with a
bit filter of fixed size. Both change the cost only, as any global order is valid.

Defined cases: texts that are null or without words have the empty set and link with nothing;
texts of fewer than k words are one shingle; texts of any length are taken whole; equal texts are
one component; null ids order first; rows that repeat an id are one node, whatever their texts, in
any order; an empty table gives an empty result; `deduplicated` keeps all columns, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import GOLDEN, MOST_ROWS, Scratch, Words, bitmap, byte_table, chunks, components, free_name, in_bitmap, map_batches, mixed, read, staged, sweep

#: Words of a shingle and percent of similarity: the contract's, and the default of stages.
K, PERCENT = 4, 85
STAGE_K, STAGE_PERCENT = 5, 80
TABLE_BITS, FILTER_BITS, COMMON_BITS, SAMPLED, BLOCK_SHINGLES, COMBINED = 24, 25, 27, 2, 2_000_000, 12
NO_ID = -(1 << 63)
#: Words of 64 bits of a set's parity sketch.
SKETCH = [f"s{i}" for i in range(8)]


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text of a column the sorted distinct hashes (52 bits, then 12 zeros) of its k-word shingles."""
    out = []
    for at in range(0, len(column), MOST_ROWS):
        part = column.slice(at, MOST_ROWS)
        words = Words(part)
        n = len(words.h)
        sizes = np.bincount(words.owner, minlength=len(part))
        gram, whole = np.zeros(max(0, n - k + 1), np.uint64), np.zeros(0, bool)
        with np.errstate(over="ignore"):
            for i in range(k if n >= k else 0):
                gram = gram * GOLDEN + words.h[i : n - k + 1 + i]
            owner = words.owner[: len(gram)]
            whole = owner == words.owner[k - 1 :] if len(gram) else whole
            grams, owners = [mixed(gram[whole] + np.uint64(k))], [owner[whole]]
            first = np.cumsum(sizes) - sizes
            for t in np.flatnonzero((sizes > 0) & (sizes < k)).tolist():  # the whole text is the shingle
                short = np.zeros(1, np.uint64)
                for h in words.h[first[t] : first[t] + sizes[t]]:
                    short = short * GOLDEN + h
                grams.append(mixed(short + np.uint64(sizes[t])))
                owners.append(np.array([t]))
        key = np.sort((np.concatenate(owners).astype(np.uint64) << np.uint64(52)) | (np.concatenate(grams) >> np.uint64(12)))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        out += np.split(key << np.uint64(12), np.searchsorted(key >> np.uint64(52), np.arange(1, len(part))))
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def needed(n: int, percent: int) -> int:
    """The overlap that a set of n needs with any linked set."""
    return -(-percent * n // 100)


def set_key(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        other = mixed(s * GOLDEN + np.uint64(len(s)))
        return int(s.sum(dtype=np.uint64).view(np.int64)), int(other.sum(dtype=np.uint64).view(np.int64))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of longs for each set: each shingle flips one bit, so bits that differ are never more than shingles that do."""
    bits = 64 * len(SKETCH)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (np.concatenate(sets) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64) if sets else np.empty(0, np.int64)
    odd = np.bincount(owner * bits + at, minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(bool).reshape(len(sets), bits), axis=1).view(np.int64)


def scan(docs: DataFrame, k: int) -> DataFrame:
    """A row per document (id, n, k1, k2: 128 bits that tell its set, SKETCH) and rows (slot, times) of locally repeated shingles."""

    names = ["id", "n", "k1", "k2", "slot", "times", *SKETCH]

    def work(batches):
        held, size = [], 0

        def repeated():
            values, count = np.unique(np.concatenate(held), return_counts=True)
            often = count > 1
            slots = (values[often] >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
            none = pa.nulls(len(slots), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(slots), pa.array(count[often]), *[none] * len(SKETCH)], names=names)

        for batch in chunks(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            keys = [set_key(s) for s in sets]
            rows = [batch.column("id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.int64()), *map(pa.array, np.ascontiguousarray(sketches(sets).T))], names=names)
            seen = {}
            held += [seen.setdefault(x, s) for x, s in zip(keys, sets, strict=True) if x not in seen]
            size = sum(map(len, held))
            if size > BLOCK_SHINGLES:
                yield repeated()
                held = []
        if held:
            yield repeated()

    return map_batches(docs, work, "id bigint, n bigint, k1 bigint, k2 bigint, slot int, times bigint, " + ", ".join(f"{c} bigint" for c in SKETCH))


def class_table(scanned: DataFrame) -> np.ndarray:
    """A byte per slot: 0 for rare shingles, else by the logarithm of their count."""
    counted = scanned.where("slot is not null").groupBy("slot").agg(F.sum("times").alias("times")).where("times >= 8")
    return byte_table(counted.select("slot", F.least(F.lit(255), F.floor(4 * F.log2("times"))).alias("value")), TABLE_BITS)


def place_of(classes, hashes) -> np.ndarray:
    """Where shingles stand in the global order, as comparable longs (hashes that fall together only loosen bounds)."""
    return ((classes.astype(np.uint64) << np.uint64(55)) | (hashes >> np.uint64(9))).view(np.int64)


def prefix(s: np.ndarray, table: np.ndarray, percent: int, common: np.ndarray | None = None, factor: int = 1) -> tuple[np.ndarray, np.ndarray, int, float]:
    """The extended prefix in global order, its classes, the plain prefix's length, and the set's part of frequent shingles.

    Classes: 0 rare, 1 rare but known to be in several documents (the bits in common), above 1 frequent."""
    classes = table[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.uint8)
    often = classes > 0
    classes = np.where(often, np.minimum(classes, 253) + np.uint8(2), in_bitmap(common, slot_of(s, COMMON_BITS)) if common is not None else 0).astype(np.uint8)
    plain = len(s) - needed(len(s), percent) + 1
    order = np.lexsort((s, classes))[: factor * (plain + 1)]
    return s[order], classes[order], plain, float(often.mean())


def slot_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def sampled(docs: DataFrame, table, k: int, percent: int) -> DataFrame:
    """(key): the first rare shingles of each document by hash, twice its extended prefix, to learn which are in several."""

    def work(batches):
        for batch in chunks(batches, "text"):
            seen, out = set(), []
            for s in shingle_sets(batch.column("text"), k):
                if len(s) < 2 or (x := set_key(s)) in seen:
                    continue
                seen.add(x)
                e, classes, _, _ = prefix(s, table.value, percent, factor=SAMPLED)
                out.append(e[classes == 0])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["key"])

    return map_batches(docs, work, "key bigint")


def keyed(docs: DataFrame, table, common, k: int, percent: int, alone=None) -> DataFrame:
    """Index rows (key, id, n, place, before, kind, wide, middle, most, last); without `alone`, only the keys, to find those of one document.

    before is how many of the prefix's shingles ahead of the key's may be in other prefixes;
    last is where the extended prefix ends in the global order. Its rare shingles that no other prefix has are not
    in any set whose prefix ends later, so such a set shares at most `most` shingles with this one."""

    def keys_of(s: np.ndarray):
        e, classes, plain, middle = prefix(s, table.value, percent, common.value)
        rare = classes < 2
        often = np.flatnonzero(~rare)
        wide = len(often) > COMBINED
        parts = [(e[rare], np.flatnonzero(rare), 0)]
        with np.errstate(over="ignore"):
            if not wide and len(often) > 1:
                a, b = np.array(list(combinations(often, 2))).T
                parts.append((mixed(e[a] * GOLDEN + e[b]), a, 1))
            single = often[often < plain]
            parts.append((mixed(e[single] + np.uint64(1)), single, 2))
        return len(e), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[0]), p[2], np.int8) for p in parts]), wide, middle, int(place_of(classes[-1:], e[-1:])[0])

    def work(batches):
        wanted = None if alone is None else alone.value
        for batch in chunks(batches, "text"):
            # equal sets are indexed under their smallest id, as the head of all equal sets may be any of them
            least, out = {}, []
            for doc_id, s in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text"), k), strict=True):
                if len(s) > 1 and ((x := set_key(s)) not in least or doc_id < least[x][0]):
                    least[x] = (doc_id, s)
            for doc_id, s in least.values():
                size, keys, place, kind, wide, middle, last = keys_of(s)
                most, before = len(s), place
                if wanted is not None:
                    keep = in_bitmap(wanted, slot_of(keys, FILTER_BITS))
                    own = np.zeros(size + 1, np.int64)  # places of shingles that no other prefix has
                    own[place[~keep & (kind == 0)] + 1] = 1
                    most -= int(own.sum())
                    before = (place - np.cumsum(own)[place])[keep]
                    keys, place, kind = keys[keep], place[keep], kind[keep]
                full = lambda x: np.full(len(keys), x)  # noqa: B023, E731
                out.append((keys, full(doc_id), full(len(s)), place, before, kind, full(wide), full(int(middle * 1e6)), full(most), full(last)))
            if not out:
                continue
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            if wanted is None:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64))], names=["key"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3].astype(np.int32)), pa.array(cols[4].astype(np.int32)), pa.array(cols[5]), pa.array(cols[6]), pa.array(cols[7].astype(np.int32)), pa.array(cols[8], pa.int64()), pa.array(cols[9], pa.int64())], names=["key", "id", "n", "place", "before", "kind", "wide", "middle", "most", "last"])

    return map_batches(docs, work, "key bigint" if alone is None else "key bigint, id bigint, n bigint, place int, before int, kind tinyint, wide boolean, middle int, most bigint, last bigint")


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole texts are linked, staged. Texts of documents that may be in a pair are shuffled, no others."""
    spark = docs.sparkSession
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_BITS).cast("int")
    passes = spark.sparkContext.broadcast(bitmap(pairs.select(slot("a").alias("s")).unionByName(pairs.select(slot("b").alias("s"))), FILTER_BITS))

    def some(batches):
        wanted = passes.value
        for batch in batches:
            at = np.asarray(batch.column("slot")).astype(np.int64)
            keep = in_bitmap(wanted, at)
            yield batch.select(["id", "text"]).filter(pa.array(keep))

    texts = map_batches(docs.select("id", F.col("text").cast("binary").alias("text"), slot("id").alias("slot")), some, "id bigint, text binary")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches):
        for batch in chunks(chunks(batches, "tb"), "ta"):
            both = zip(shingle_sets(batch.column("ta"), k), shingle_sets(batch.column("tb"), k), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([linked(x, y, percent) for x, y in both], pa.bool_()))

    links = scratch.staged(map_batches(both.select("a", "b", "ta", "tb"), check, "a bigint, b bigint"), "ngram-links")
    passes.destroy()
    return links


def join_components(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) for each row of docs; component is the smallest id that links reach."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    scanned = staged(scan(source, k), "ngram-scan")
    sets = scanned.where("slot is null").drop("slot", "times")
    table = spark.sparkContext.broadcast(class_table(scanned))
    heads = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("head"))
    same = sets.where("n > 0").join(heads, ["k1", "k2"]).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    several = sampled(source, table, k, percent).groupBy("key").count().where("count > 1")
    common = spark.sparkContext.broadcast(bitmap(several.select(F.shiftrightunsigned("key", 64 - COMMON_BITS)), COMMON_BITS))
    shared = keyed(source, table, common, k, percent).groupBy("key").count().where("count > 1")
    alone = spark.sparkContext.broadcast(bitmap(shared.select(F.shiftrightunsigned("key", 64 - FILTER_BITS)), FILTER_BITS))
    index = scratch.staged(keyed(source, table, common, k, percent, alone).join(heads.select(F.col("head").alias("id")).distinct(), "id", "left_semi"), "ngram-index")
    # the driver holds tables and what finished steps left behind only as long as they are of use
    for x in (table, common, alone):
        x.destroy()
    del several, shared
    sweep(spark)

    size = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    def may_link(n, most, last, wide, n2, most2, last2, wide2):
        """Length bound, the bound by shingles that only the earlier prefix has, and the rule for wide documents' keys."""
        shared = F.when(F.col(last) < F.col(last2), F.col(most)).when(F.col(last) > F.col(last2), F.col(most2)).otherwise(F.greatest(most, most2))
        return size(F.col(n), F.col(n2)) & ((100 + percent) * shared >= percent * (F.col(n) + F.col(n2))) & ((F.col("kind") < 2) | F.col(wide) | F.col(wide2))

    member = F.struct("middle", "id", "n", "most", "last", "wide")
    leaders = index.groupBy("key").agg(F.count("*").alias("members"), F.max(member).alias("c"), F.min(F.struct("id", "n", "most", "last", "wide")).alias("l")).where("members > 1")
    met = index.join(leaders, "key")
    kept = lambda s: met.where((F.col("id") != F.col(f"{s}.id")) & may_link("n", "most", "last", "wide", f"{s}.n", f"{s}.most", f"{s}.last", f"{s}.wide")).select(F.greatest("id", f"{s}.id").alias("a"), F.least("id", f"{s}.id").alias("b"))
    stars = scratch.staged(kept("c").unionByName(kept("l")).distinct(), "ngram-pairs")
    links = verified(source, stars, k, percent, scratch)
    sweep(spark)

    found = scratch.staged(components(spark, links), "ngram-components")
    sweep(spark)
    grouped = index.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = grouped.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    # the sketch of an id with one row; rows that repeat an id do without
    known = sets.groupBy("id").agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in SKETCH]).where("rows = 1").drop("rows")
    rest = scratch.staged(grouped.join(open_keys, "key", "left_semi").join(known, "id", "left"), "ngram-rest")
    cols = ("key", "id", "n", "place", "before", "kind", "wide", "most", "last", "component", *SKETCH)
    x, y = rest.select(*cols), rest.select("key", *[F.col(c).alias(f"{c}_y") for c in cols[1:]])
    # what stands ahead of the key in both, the key, and what follows it
    bound = F.least("before", "before_y") + 1 + F.least(F.col("n") - F.col("place") - 1, F.col("n_y") - F.col("place_y") - 1)
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_y"))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0]).bitwiseXOR(F.col(f"{SKETCH[0]}_y"))))
    close = F.coalesce((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n_y")), F.lit(True))
    across = x.join(y, "key").where((F.col("id") > F.col("id_y")) & (F.col("component") != F.col("component_y")) & may_link("n", "most", "last", "wide", "n_y", "most_y", "last_y", "wide_y") & ((100 + percent) * bound >= percent * (F.col("n") + F.col("n_y"))) & close)
    across = scratch.staged(across.select(F.col("id").alias("a"), F.col("id_y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "ngram-pairs")
    more = verified(source, across, k, percent, scratch)
    sweep(spark)

    final = components(spark, links.unionByName(more).unionByName(same))
    scratch.drop()
    return sets.join(final.withColumnRenamed("node", "id"), "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def deduplicated(docs: DataFrame, k: int = STAGE_K, percent: int = STAGE_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id. Unlinked documents stay."""
    name = free_name(docs, "__spare")
    spare = join_components(docs, k, percent, id_col, text_col).where("component <> id").select(F.col("id").alias(name)).distinct()
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    return docs.join(spare, key == F.col(name), "left_anti")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join_components(read(spark, sf_dir, "documents"))
    whole = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(whole("id").alias("doc_id"), "n_shingles", whole("component").alias("component_id"))


def brute_force(rows: list[tuple[int, str | None]], k: int = K, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """id -> (n_shingles, component) by comparing all pairs of word tuples; for tests."""
    import re

    def grams(text):
        lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}
