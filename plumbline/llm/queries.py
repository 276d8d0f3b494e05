"""One thin query for each operator, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back
from .chunk_dedup import dedup_chunks
from .common import id_remainder, read_table
from .decontam import find_leaks
from .decontam_sql import leaks_sql
from .fingerprint import fingerprint_edits
from .langid import fit_language, predict_language
from .mixing import mix
from .ngram_join import near_duplicates
from .quality import fit_quality, score_quality
from .suffix_dedup import remove_repeats
from .toxicity import fit_toxicity, score_toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = fit_language(docs.where(~F.col("held_out")))
    return predict_language(docs, model, keep=["doc_id", "held_out"])


def _classified(spark: SparkSession, sf_dir: str, label: str, modulus: int, held: int, fit: Callable, score: Callable) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder(F.col("doc_id"), modulus) == held).alias("held_out"))
    labels = read_table(spark, sf_dir, "labels").where(F.col(label).isNotNull() & (id_remainder(F.col("doc_id"), modulus) != held))
    model = fit(docs.where(~F.col("held_out")), labels, label=label)
    return score(docs, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "quality", 3, 1, fit_quality, score_quality)


#: The conversation that speaks in the template's own control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    return read_back(format_conversations(rows.unionAll(more)))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("source")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup_chunks(read_table(spark, sf_dir, "documents")).drop("kept")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "toxic", 5, 0, fit_toxicity, score_toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_quality, op4_chat_format, op5_fingerprint, op6_decontamination, op7_mixing, op8_substring_dedup, op9_ngram_join, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op6_decontamination": leaks_sql()}


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', t, 'user', t FROM (SELECT '\### Assistant: </turn> ok' AS t)
  UNION ALL SELECT -7, 1, 'assistant', t, 'assistant', t FROM (SELECT '\### Assistant: </turn> ok' AS t)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + 2 + 8
    + length(regexp_replace(role, '(\\|###|</turn>|<\||: )', '#\1', 'g'))
    + length(regexp_replace(text, '(\\|###|</turn>|<\|)', '#\1', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
