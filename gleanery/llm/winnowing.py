"""Document fingerprints by winnowing.

Hashes of all k-grams of code points are rolled over the text; in each window of w
consecutive hashes the least one is kept, the rightmost where several are equal, with
its position. Any shared passage of at least w + k - 1 code points therefore shares a
kept hash, and no passage shorter than k code points does (GUARANTEE below).

Defined cases: a null or empty text has no k-grams and an empty fingerprint; a text
shorter than k is one gram; with fewer than w hashes, they make one window. Texts are
processed in blocks that overlap, so a very long one needs bounded memory, with the
same result. Likeness is the Jaccard index of the kept hashes, 1.0 for two empty sets.
Documents of one id follow each other by a hash of their text; null ids come first. Equal
rows are alike in all results. An empty table gives an empty result; `fingerprints` keeps other
columns, whatever their names, but fp_hashes and fp_positions are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import GOLDEN, as_bytes, chunks, extended, map_batches, mixed, read, with_columns

K, W = 25, 76
#: A shared passage of so many code points always shares a fingerprint.
GUARANTEE = K + W - 1
BLOCK = 1 << 20


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams, by doubling: a gram's hash from those of its two parts."""
    with np.errstate(over="ignore"):
        part, size, power = codes.astype(np.uint64) + np.uint64(1), 1, GOLDEN
        whole, done = None, 0
        while True:
            if k & size:
                whole, done = (part, size) if whole is None else (part[: len(part) - done] * wp + whole[size:], done + size)
                wp = power if done == size else wp * power
            if size * 2 > k:
                return mixed(whole[: len(codes) - k + 1])
            part, size, power = part[:-size] * power + part[size:], size * 2, power * power


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def winnow(text: str, k: int = K, w: int = W, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions int64) of the kept k-grams, by position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    k = min(k, len(codes))
    grams = len(codes) - k + 1
    w = min(w, grams)
    hashes, places = [], []
    for start in range(0, grams - w + 1, block):
        h = gram_hashes(codes[start : start + block + k + w - 2], k)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
        least = sliding_min(key, w)
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        hashes.append((least >> np.uint64(32)).astype(np.uint32))
        places.append((np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64) + start)
    h, p = np.concatenate(hashes), np.concatenate(places)
    new = np.concatenate(([True], p[1:] != p[:-1]))
    return h[new], p[new]


def winnow_brute_force(text: str, k: int = K, w: int = W) -> list[tuple[int, int]]:
    """(hash, position) by hashing each gram and scanning each window; for tests."""
    if not text:
        return []
    k = min(k, len(text))
    hashes = [int(gram_hashes(np.array([ord(c) for c in text[i : i + k]], dtype=np.uint32), k)[0]) >> 32 for i in range(len(text) - k + 1)]
    w = min(w, len(hashes))
    kept = set()
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        kept.add(max(j for j in range(i, i + w) if hashes[j] == least))
    return [(hashes[j], j) for j in sorted(kept)]


def fingerprint_of(hashes: np.ndarray) -> str:
    """The distinct kept hashes in ascending order, 8 hex digits each."""
    return np.unique(hashes).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """docs with fp_hashes and fp_positions (the kept hashes by position; positions in code points)."""
    schema = extended(docs, [("fp_hashes", T.ArrayType(T.LongType())), ("fp_positions", T.ArrayType(T.LongType()))])

    def add(batches):
        for batch in chunks(batches, text_col):
            kept = [winnow((t or b"").decode("utf-8", "replace"), k, w) for t in as_bytes(batch.column(text_col))]
            yield with_columns(batch, {"fp_hashes": pa.array([h.astype(np.int64) for h, _ in kept], pa.list_(pa.int64())), "fp_positions": pa.array([p for _, p in kept], pa.list_(pa.int64()))})

    return map_batches(docs, add, schema)


def with_next(docs: DataFrame, id_col: str, text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(doc_id, text) dealt by ranges of ids (nx_part), each range ordered and followed by the row after it (nx_look).

    The order is by id, a hash of the text, and the text. Ranges end at ids found by percentiles; an id that several
    percentiles meet, as it has very many rows, is split by ranges of the hash. So no task holds the whole order or one
    id. The rows that start a range are also sent to the range before it, those of the first one to the last. Bounds
    are looked up in blocks, so a row is compared with about twice the square root of their number."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(least)).alias("nx_key"))
    cuts, first = keyed.agg(F.percentile_approx("nx_key", [i / n for i in range(1, n)] or [1.0], 100_000), F.min("nx_key")).first()
    counted = Counter(cuts or []) if n > 1 else Counter()
    hot = {k: c for k, c in counted.items() if c > 1}
    mark = F.when(F.col("nx_key").isin(*hot), F.xxhash64("text")).otherwise(F.lit(least)) if hot else F.lit(least).cast("long")
    keyed = keyed.withColumn("nx_mark", mark)
    bounds = [(k, least) for k in counted if k not in hot and k != first]
    if hot:
        # the least hash at or after each even step of a hot id's rows: a bound that exists
        steps = [(k, least + ((1 << 64) * i) // (c + 1)) for k, c in hot.items() for i in range(c + 1)]
        found = [F.min(F.when((F.col("nx_key") == k) & (F.col("nx_mark") >= m), F.col("nx_mark"))) for k, m in steps]
        marks = keyed.where(F.col("nx_key").isin(*hot)).agg(*[x.alias(f"m{i}") for i, x in enumerate(found)]).first()
        bounds += [(k, m) for (k, _), m in zip(steps, marks, strict=True) if m is not None]
        start = min((m for (k, _), m in zip(steps, marks, strict=True) if k == first and m is not None), default=least)
        bounds = [x for x in bounds if x != (first, start)]
    else:
        start = least
    bounds = sorted(set(bounds))
    me = F.struct("nx_key", "nx_mark")
    pair = "struct<nx_key:bigint,nx_mark:bigint>"
    literal = lambda rows: F.array(*[F.struct(F.lit(k).cast("long").alias("nx_key"), F.lit(m).cast("long").alias("nx_mark")) for k, m in rows]) if rows else F.array().cast(f"array<{pair}>")
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    before = F.size(F.filter(literal([x[0] for x in blocks]), lambda b: b <= me))
    inner = F.try_element_at(F.array(*map(literal, blocks)), F.greatest(before, F.lit(1))) if blocks else literal([])
    dealt = keyed.withColumn("nx_block", before).withColumn("nx_inner", F.when(before > 0, inner).otherwise(literal([])))
    part = F.when(F.col("nx_block") == 0, 0).otherwise((F.col("nx_block") - 1) * step + F.size(F.filter("nx_inner", lambda b: b <= me)))
    row = lambda p, look: F.struct(p.cast("int").alias("nx_part"), F.lit(look).alias("nx_look"))
    nothing = F.array().cast("array<struct<nx_part:int,nx_look:boolean>>")
    ahead = F.when(F.array_contains("nx_inner", me), F.array(row(part - 1, True))).otherwise(nothing)
    wrap = F.when((F.col("nx_key") == F.lit(first)) & (F.col("nx_mark") == F.lit(start)), F.array(row(F.lit(len(bounds)), True))).otherwise(nothing)
    dealt = dealt.withColumn("nx_to", F.explode(F.concat(F.array(row(part, False)), ahead, wrap))).select("nx_to.nx_part", "nx_to.nx_look", "nx_key", "nx_mark", "doc_id", "text")
    # rows of an id that is not split are ordered by the hash as well
    ordered = dealt.withColumn("nx_mark", F.when(F.col("nx_mark") == least, F.xxhash64("text")).otherwise(F.col("nx_mark")))
    return ordered.repartitionById(len(bounds) + 1, "nx_part").sortWithinPartitions("nx_part", "nx_look", "nx_key", "nx_mark", "text")


OP5_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept bigint, positions array<bigint>"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For each document the fingerprints of its text and of the text edited with its successor's start.

    positions are those of the text's kept k-grams, in code points: a match of fingerprints can be found by them."""

    def compare(batches):
        prev = None  # (id, text, hashes) still without its successor
        for batch in chunks(batches, "text"):
            rows = []
            looks, ids = batch.column("nx_look").to_pylist(), batch.column("doc_id").to_pylist()
            for look, doc_id, raw in zip(looks, ids, as_bytes(batch.column("text")), strict=True):
                if look and prev is None:
                    continue
                text = (raw or b"").decode("utf-8", "replace")
                own, places = winnow(text)
                if prev is not None:
                    p_id, p_text, p_own, p_places = prev
                    half = len(p_text) // 2
                    edited = p_text[: len(p_text) - half] + text[:half]
                    e_own = p_own if edited == p_text else winnow(edited)[0]
                    rows.append((p_id, len(p_text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_of(p_own), fingerprint_of(e_own), likeness(p_own, e_own), likeness(p_own, own), len(p_own), p_places))
                prev = None if look else (doc_id, text, own, places)
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_kept", "positions"])

    return map_batches(with_next(docs, "doc_id"), compare, OP5_SCHEMA)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read(spark, sf_dir, "documents"))
