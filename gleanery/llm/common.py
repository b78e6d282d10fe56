"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once inside a Python worker.
CHUNK_BYTES = 1 << 20
#: Rows handled at once at most.
MOST_ROWS = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only where the session has none (tests, local mode)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = "file:///tmp/checkpoints/gleanery"
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors. by: a folder for each value of that column."""
    path = shared_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop_staged(spark: SparkSession, df: DataFrame, part: str = "") -> None:
    """Delete the files of a staged table that no later step reads, or those in folders of the name part."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.endswith(part):
            continue
        if folder.startswith(shared_dir(spark)) or shared_dir(spark).removeprefix("file://") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Staged tables of one computation, deleted together once its result is staged itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def staged(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        self.tables.append(staged(df, name, by))
        return self.tables[-1]

    def drop(self) -> None:
        for table in self.tables:
            drop_staged(self.spark, table)
        self.tables = []


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(df: DataFrame, extra: Iterable[tuple[str, T.DataType]]) -> T.StructType:
    """The schema of df with new columns; a column of the same name is replaced."""
    extra = list(extra)
    names = {n.lower() for n, _ in extra}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + [T.StructField(n, t) for n, t in extra])


def chunks(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about limit bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = min(start + MOST_ROWS, max(start + 1, int(np.searchsorted(sizes, base + limit, side="right"))))
            yield batch.slice(start, end - start)
            start = end


def lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def with_columns(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    names = {n.lower() for n in extra}
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.lower() not in names]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(extra.values()), names=[n for n, _ in kept] + list(extra))


#: Rows of an Arrow batch, where the session keeps Spark's default of 10,000: rows hold whole texts here.
BATCH_ROWS = 1_000


def sweep(spark: SparkSession) -> None:
    """Shuffle files of finished steps stay until the driver collects its garbage: let it do so now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends; else the driver's references to the last one keep them until another has run."""
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with small batches; a worker gives its memory back after each task, as idle workers stay alive."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library cannot trim
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


#: Fixed odd multiplier of the rolling hashes (64-bit golden ratio).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (shift, multiply, shift)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fraction_of(*parts) -> F.Column:
    """A number in [0, 1) from the md5 of the parts, the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over (a, b) edges of longs, for nodes that have edges.

    Alternating large-star and small-star steps, staged in the shared folder after
    each round; the number of rounds is logarithmic in the length of chains. The
    smallest neighbour is pre-aggregated; a hub's edges meet it in a join that adaptive
    execution splits where they are many (spark.sql.adaptive.skewJoin).
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
            return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(low, "a")
        return linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))

    current = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while True:
        step = staged(star(star(current, True), False).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        fingerprint = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        done = fingerprint(step) == fingerprint(current)
        drop_staged(spark, current)
        current = step
        if done:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )


#: Slots of a table are dealt in so many ranges, each filled by one task.
RANGES = 16


def bitmap(slots: DataFrame, bits: int, distinct: bool = True) -> np.ndarray:
    """Packed bits of the slot numbers in column 0 (below 2 ** bits). Executors fill ranges of it; the driver gets 2 ** (bits - 3) bytes at most, whatever the rows.

    distinct: take equal slots together first, as one may be very frequent."""
    rows = slots.select(F.col(slots.columns[0]).cast("long").alias("slot"), F.lit(1).alias("value"))
    return filled(rows.distinct() if distinct else rows, bits, True)


def byte_table(rows: DataFrame, bits: int) -> np.ndarray:
    """A byte for each of 2 ** bits slots, from rows (slot, value) with each slot once; 0 elsewhere."""
    return filled(rows.select(F.col("slot").cast("long").alias("slot"), F.col("value").cast("int").alias("value")), bits, False)


def filled(rows: DataFrame, bits: int, pack: bool) -> np.ndarray:
    """Ranges travel compressed: the driver's JVM holds each several times over until it collects its garbage."""
    size = (1 << bits) // RANGES

    def fill(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            slot, value = np.asarray(b.column("slot")), np.asarray(b.column("value"))
            for r in np.unique(slot // size).tolist():
                own = slot // size == r
                part = parts.setdefault(r, np.zeros(size, bool if pack else np.uint8))
                part[slot[own] - r * size] = value[own]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([zstandard.compress(np.packbits(p) if pack else p, 1) for p in parts.values()], pa.binary())], names=["range", "bytes"])

    whole = np.zeros((1 << bits) >> (3 if pack else 0), np.uint8)
    step = len(whole) // RANGES
    for r in map_batches(rows.repartition(RANGES, F.floor(F.col("slot") / size)), fill, "range bigint, bytes binary").collect():  # RANGES rows
        whole[r["range"] * step : (r["range"] + 1) * step] = np.frombuffer(zstandard.decompress(r["bytes"]), np.uint8)
    return whole


def in_bitmap(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


#: What a byte adds to a word's hash: 0 for white space, which ends words; A-Z count as a-z.
BYTE_VALUES = np.array([0 if b == 0x20 or 0x09 <= b <= 0x0D else (b + 32 if 0x41 <= b <= 0x5A else b) + 1 for b in range(256)], np.uint64)
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of GOLDEN and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((int(GOLDEN), pow(int(GOLDEN), -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _POWERS[i] = np.cumprod(x)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """The white-space-separated words of a column of texts as arrays, without an object per word.

    h: 64-bit hashes of the lower-cased (A-Z) words; owner: the text of each word; start: its first byte in data;
    bounds: where each text starts, and where the last ends. values: what each byte adds to its word, 0 between words."""

    def __init__(self, column: pa.Array, values: np.ndarray = BYTE_VALUES):
        import pyarrow.compute as pc

        if column.null_count:
            column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        _, offsets, data = column.buffers()
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        self.data, self.bounds = whole[bounds[0] : bounds[-1]], bounds - bounds[0]
        n = len(self.data)
        self.h, self.start = np.empty(0, np.uint64), np.empty(0, np.int64)
        if n:
            value = values[self.data]
            inside = value != 0
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            edges = self.bounds[:-1][self.bounds[:-1] < n]
            begins[edges] = inside[edges]
            self.start = np.flatnonzero(begins)
            up, down = powers(n)
            with np.errstate(over="ignore"):
                total = np.cumsum(value * up)
                # a word's sum ends where the next word starts, as white space adds nothing
                before = np.where(self.start > 0, total[self.start - 1], np.uint64(0))
                self.h = mixed((np.append(before[1:], total[-1]) - before) * down[self.start]) if len(self.start) else self.h
        self.owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(np.searchsorted(self.start, self.bounds)))

    def lines(self) -> np.ndarray:
        """The line (from 0) of its text that each word is in."""
        breaks = np.flatnonzero(self.data == 10)
        after = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(self.start, breaks), prepend=0, append=len(self.start)))
        return after - np.searchsorted(breaks, self.bounds[:-1])[self.owner]
