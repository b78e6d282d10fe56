"""Mixing sources to target weights [native]: built-in DataFrame functions only.

Tokens are summed per source, each source's repetition rate is its target over its
size, and a document is emitted floor(rate) times plus one hash-seeded Bernoulli
copy with probability equal to the fraction of the rate.

Defined cases: a null or empty text has size 0 and draws like any other document;
a null source is a source of its own, last in order; repeated rows are documents of
their own (rows equal in id and text share one draw); ties of cap and weight go by the order of sources;
texts of any length are counted whole; an empty table gives an empty result;
input columns are kept, whatever their names: `mix` returns them as they are, `plan_mix` replaces those
named like its own (mix_size, mix_source_size, mix_target, mix_copies).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.common import fraction_of, free_name, read, staged

#: Weights by the rank of a source, repeating; the mix's size and a source's most, in units of the sizes.
WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
#: The per-source table is broadcast up to so many sources; beyond it, the join is salted.
BROADCAST_SOURCES, SALTS = 10_000, 32
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per source: mix_source, mix_source_size, mix_target.

    Water-filling in closed form: sources by ascending cap / weight; a source stops at its
    cap when the level that the rest would share reaches it, which holds for a prefix.
    The windows run over one row per source, never over documents: a task holds a few numbers for each
    source, so millions of sources fit.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(source_col).cast("string").alias("mix_source"), size.alias("s")).groupBy("mix_source").agg(F.sum("s").alias("mix_source_size"))
    ranked = sizes.withColumn("r", F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("r") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("mix_source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "r")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    ranked = ranked.withColumn("budget", F.lit(float(share)) * F.sum("mix_source_size").over(everything))
    ranked = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    ranked = ranked.withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    left = F.min(F.when(~F.col("full"), F.struct("cw", "r", "level"))).over(everything)["level"]
    ranked = ranked.withColumn("cw", F.col("cap") / F.col("w")).withColumn("final", left)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("final"))
    return ranked.select("mix_source", "mix_source_size", target.alias("mix_target"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target (of its source) and mix_copies (how often to emit it)."""
    targets = staged(source_targets(docs, weights, share, most, source_col, text_col), "mix-sources")
    kept = docs.drop("mix_source_size", "mix_target", "mix_size", "mix_copies")
    source, by, salt, part = (free_name(docs, n) for n in ("mix_source", "mix_by", "mix_salt", "mix_part"))
    targets = targets.withColumnRenamed("mix_source", source)
    sized = kept.withColumn("mix_size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")).withColumn(by, F.col(source_col).cast("string"))
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), F.col(by).eqNullSafe(F.col(source)))
    else:
        salted = targets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn(part, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        joined = sized.join(salted, F.col(by).eqNullSafe(F.col(source)) & (F.col(part) == F.col(salt))).drop(salt, part)
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    draw = fraction_of(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text_col)), F.lit("null")))
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("mix_copies", copies.cast("long")).drop(source, by)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus: the columns of docs as they are, each row as often as the plan says."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    planned = plan_mix(rows, id_col="id", source_col="source", text_col="text", **options)
    each = planned.where("mix_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return each.select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(md5(text), 'null') AS h, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w, CAST(2 AS DOUBLE) * source_size AS cap FROM r),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
        - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, cap <= w * level AS is_full FROM l),
o AS (SELECT level AS final FROM f WHERE NOT is_full ORDER BY cap / w, r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * (SELECT final FROM o) END AS target FROM f),
j AS (SELECT d.doc_id, d.size, d.h, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE CAST(0 AS DOUBLE) END AS rate,
        CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || h), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken
FROM j
"""
