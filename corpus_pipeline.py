"""From raw documents to token ids: language ID, line dedup, near-duplicates, benchmark decontamination, byte-level BPE.

Every stage is a function of (spark, docs, sf_dir); ``run`` writes its result as Parquet to the shared folder and reads it back for
the next one. All stages but the last return the columns of ``docs``.

Defined results: rows with a null or empty text have no letter, so the first stage drops them; an empty table passes through all
stages; extra columns are kept, unless they are named like a column that a stage adds, and up to the last stage they keep their
values. Rows with equal ids are one document: a decision about one holds for all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorloom.llm import bpe, decontam, langid, linededup, neardup
from tutorloom.llm.common import small_batches, small_or_not, table, written

LEAST_SCORE = 0.3  # a language that gets less of the probability is a guess


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows: texts without letters and guesses go."""
    small_batches(spark)
    found = langid.predict_languages(docs)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus; a document of which nothing is left goes."""
    small_batches(spark)
    cut = linededup.without_repeats(docs)
    left = cut.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    changed = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept"))}
    return left.select(*(changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    small_batches(spark)
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(small_or_not(written(gone, "gone")), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    small_batches(spark)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where(decontam.contaminated()).select("doc_id").distinct()
    return docs.join(small_or_not(written(gone, "gone")), "doc_id", "left_anti").select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    small_batches(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return tokens.withColumn("round_trip", same).drop("text", "decoded", "n_split")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

# A recurrent network and a tokenizer have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
