"""Document preparation: cleaning, quality, language, duplicates, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorloom.functions import text as T
from tutorloom.functions.text import CleaningConfig
from tutorloom.operators.dedup import near_duplicates
from tutorloom.session import spread, write_step
from tutorloom.sources import corpus


def clean(docs: DataFrame, cfg: CleaningConfig = CleaningConfig(), text: str = "text") -> DataFrame:
    return docs.withColumn(text, T.clean_text(F.col(text), cfg))


def judge_quality(docs: DataFrame, cfg: CleaningConfig = CleaningConfig(), text: str = "text") -> DataFrame:
    """Adds ``reason``: the first failing rule, or ``quality``."""
    return docs.withColumn("reason", T.quality_reason(F.col(text), cfg))


def quality_counts(docs: DataFrame, cfg: CleaningConfig = CleaningConfig(), text: str = "text") -> DataFrame:
    return judge_quality(docs, cfg, text).groupBy("reason").agg(F.count("*").alias("documents"))


def detect_languages(docs: DataFrame, text: str = "text", given: str | None = None) -> DataFrame:
    """Adds ``detected_lang``; a given language column wins where it is filled."""
    found = T.detect_language(F.col(text))
    return docs.withColumn("detected_lang", F.coalesce(F.col(given), found) if given else found)


def language_counts(docs: DataFrame, cfg: CleaningConfig = CleaningConfig(), text: str = "text", given: str | None = None) -> DataFrame:
    judged = detect_languages(docs, text, given)
    return judged.groupBy("detected_lang").agg(
        F.count("*").alias("documents"), F.count_if(T.language_allowed(F.col("detected_lang"), cfg)).alias("kept")
    )


def staged(docs: DataFrame, cfg: CleaningConfig = CleaningConfig(), text: str = "text", lang: str | None = None) -> DataFrame:
    """Cleaned documents with the stage that rejects them in ``stage`` (null while they are kept)."""
    out = judge_quality(clean(docs, cfg, text), cfg, text)
    out = detect_languages(out, text, lang)
    stage = F.when(F.col("reason") != "quality", "quality").when(~T.language_allowed(F.col("detected_lang"), cfg), "language")
    return out.withColumn("stage", stage)


def prepare(docs: DataFrame, cfg: CleaningConfig = CleaningConfig(), key: str = "doc_id", text: str = "text", lang: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean, judge, and drop near-duplicates. Returns the kept documents and one row of statistics.

    The text is cleaned and judged once; the result is written so that neither the duplicate search
    nor the statistics reads the raw text again. Every input column travels along, so a document
    keeps its own file however many of its neighbours are rejected.
    """
    judged = write_step(staged(docs, cfg, text, lang), "judged")
    passed = judged.filter(F.col("stage").isNull())
    if cfg.remove_duplicates:
        duplicates = near_duplicates(passed.select(key, text), key, text, cfg.duplicate_threshold)
        kept = passed.join(duplicates, key, "left_anti")
    else:
        duplicates = passed.select(key).limit(0)
        kept = passed
    fates = judged.select("stage", F.lit(1).alias("read")).unionByName(duplicates.select(F.lit("duplicate").alias("stage"), F.lit(0).alias("read")))
    stats = fates.agg(
        F.coalesce(F.sum("read"), F.lit(0)).alias("input_documents"),
        F.count_if(F.col("stage") == "quality").alias("removed_by_quality"),
        F.count_if(F.col("stage") == "language").alias("removed_by_language"),
        F.count_if(F.col("stage") == "duplicate").alias("removed_as_duplicates"),
    )
    removed = F.col("removed_by_quality") + F.col("removed_by_language") + F.col("removed_as_duplicates")
    stats = stats.withColumn("final_documents", F.col("input_documents") - removed)
    return kept.drop("stage", "reason"), stats


def config_row(docs: DataFrame, cfg: CleaningConfig) -> DataFrame:
    """Snapshot of the configuration as a one-row table next to the statistics."""
    spark = docs.sparkSession
    values = {k: ",".join(v) if isinstance(v, tuple) else v for k, v in vars(cfg).items()}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def minimum_words(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    return docs.filter(T.word_count(F.col(text)) >= words)


def topic_inputs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents fit for topic discovery, whitespace collapsed."""
    return docs.withColumn(text, T.topic_input(F.col(text))).filter(F.col(text).isNotNull())


def extension_report(files: DataFrame, binary_extensions: list[str], path: str = "path") -> DataFrame:
    """Files per extension and whether the extension counts as text.

    Names are returned as rows by :func:`names_by_extension`: one extension may hold most files.
    """
    ext = T.extension(F.col(path))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("files")).withColumn(
        "is_text", ~F.col("extension").isin(*binary_extensions)
    )


def names_by_extension(files: DataFrame, path: str = "path") -> DataFrame:
    return files.select(T.extension(F.col(path)).alias("extension"), T.base_name(F.col(path)).alias("name")).orderBy("extension", "name")


def prepare_folder(spark: SparkSession, folder: str, cfg: CleaningConfig = CleaningConfig(), max_files: int | None = None) -> dict[str, DataFrame]:
    """Scan, load and prepare a folder: kept documents with their file, statistics, configuration, files by extension."""
    files = corpus.scan_folder(spark, folder, max_files)
    loaded = spread(corpus.load_documents(files))
    # of near-duplicates the first by path and part stays
    placed = loaded.withColumn("place", F.concat_ws("\u0000", "file_path", F.lpad(F.col("part").cast("string"), 10, "0")))
    kept, stats = prepare(placed, cfg, key="place")
    kept = kept.drop("place")
    return {
        "documents": kept,
        "stats": stats,
        "config": config_row(stats, cfg),
        "extensions": extension_report(files, corpus.BINARY_EXTENSIONS, "relative_path"),
    }
