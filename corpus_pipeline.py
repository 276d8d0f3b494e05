"""The corpus pipeline: documents to a weighted training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

Null and repeated rows: a null or letterless text is rejected by the first stage. Rows with a null doc_id
belong to no group of near duplicates and stay. Of rows that share a doc_id the smallest (by the columns in
their order) stays after the second stage.
Empty tables give empty results; columns besides those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.chunk_dedup import dedup_chunks
from plumbline.llm.common import attach, read_table, written
from plumbline.llm.decontam import find_leaks
from plumbline.llm.langid import UNDETERMINED, fit_language, predict_language
from plumbline.llm.mixing import mix
from plumbline.llm.ngram_join import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language is less likely than this are rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; undetermined and doubtful ones go."""
    docs = docs.select(*COLUMNS)
    model = fit_language(docs)
    known = predict_language(docs, model, keep=COLUMNS).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return known.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    groups = near_duplicates(docs)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*COLUMNS)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    least = F.min(F.struct(*COLUMNS)).alias("row")  # the same one each time
    twice = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionAll(twice)


def cut_repeated_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in an earlier document; texts of nothing else go."""
    blank = F.col("text").isNull().alias("__null")
    found = dedup_chunks(docs.select(*COLUMNS, blank), carry=["lang", "source", "n_chars", "__null"])
    kept = found.where((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    text = F.when(~F.col("__null"), F.col("kept"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", n_chars.cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = find_leaks(docs, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leak_id")), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's manifest: doc_id, source, size, source_size, target and the words taken, where any are."""
    return mix(docs).where("taken > 0")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_chunks),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near duplicates, chunking and the cube method aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
