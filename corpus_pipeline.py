"""A training corpus from the table documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents; the last one may repeat rows.

Defined cases: documents whose text is null, empty or without letters go with the language
stage; texts of any length are taken whole; of equal texts the one with the smallest id stays
(null ids are the smallest); rows of one id are one document to line dedup and the n-gram join,
whose texts stay or go together there, and documents of their own elsewhere; null sources are a
source; other columns, whatever their names, are kept by all stages, and n_chars follows the
text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import decontamination, language, line_dedup, mixing, ngram_join
from gleanery.llm.common import read, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted field places in a language; those without letters or of unclear language go."""
    return language.identify(docs, language.fit(docs), keep_score=language.KEEP_SCORE)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents of which no word is left then; copies are the next stage's."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("kept"))
    out = line_dedup.deduplicated(rows).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \x09-\x0D]"))
    columns = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[columns.get(c, F.col("kept").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest id."""
    return ngram_join.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target weight asks."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express the fitted language model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
