"""Structured Streaming forms of the study operators.

Each takes a streaming DataFrame and stays lazy; ``run_to_end`` drains what is available and reads
the result back. A replayed micro-batch overwrites its own folder, so results are exactly-once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tutorloom.functions import text as T
from tutorloom.functions.text import CleaningConfig
from tutorloom.operators.spaced import NEW, fold_rating
from tutorloom.session import shared_folder


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table (``<folder>/<name>.parquet``, one file or a folder of them) as a stream, schema taken from the table itself.

    The path is given as a pattern: a stream takes a plain path for a folder, a pattern for whatever it finds.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}[.]parquet")


def run_to_end(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process everything available; returns the written rows with the micro-batch in ``epoch``."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/tutorloom/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")


def activity_windows(progress: DataFrame, delay: str = "2 hours", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and mean value per workspace, action and time window; rows later than ``delay`` are dropped."""
    w = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    return (
        progress.withWatermark("timestamp", delay)
        .groupBy(w.alias("w"), "workspace_id", "action_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "workspace_id", "action_type", "events", "value")
    )


def study_sessions(progress: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions of a user, closed by ``gap`` without activity."""
    return (
        progress.withWatermark("timestamp", delay)
        .groupBy(F.session_window("timestamp", gap).alias("s"), "user_id")
        .agg(F.count("*").alias("events"), F.count_if(F.col("action_type") == "question_answered").alias("answered"))
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events", "answered")
    )


SCHEDULE = "question_id long, ease_tenths long, interval_days long, review_count long, days long, first_at timestamp"
BUCKETS = 1024  # of questions; each is one entry of the state


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Updates of the questions of one bucket; its state is one array for each number. The questions without an id are one in a bucket of their own."""
    known = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
    rows = pd.concat(list(batches))
    rows = rows.iloc[np.lexsort((rows["id"].to_numpy(), rows["created_at"].to_numpy(), rows["question_id"].to_numpy()))]
    at = rows["created_at"].to_numpy().astype("datetime64[us]").astype(np.int64)
    updates, question = {}, None
    for q, quality, time in zip(rows["question_id"].tolist(), rows["quality"].tolist(), at.tolist()):
        if q != question:
            question, (*current, first) = q, known.get(q, (*NEW, time))
        current = fold_rating(current, int(quality))
        updates[q] = (*current, first)
    known |= updates
    state.update((list(known), *[list(x) for x in zip(*known.values())]))
    ids = pd.Series([q if key[0] >= 0 else None for q in updates], dtype="Int64")
    ease, interval, reviews, days, first = zip(*updates.values())
    yield pd.DataFrame({"question_id": ids, "ease_tenths": ease, "interval_days": interval, "review_count": reviews, "days": days, "first_at": pd.to_datetime(np.array(first), unit="us")})


def live_schedules(ratings: DataFrame) -> DataFrame:
    """Spaced-repetition state per question, updated by every micro-batch of ratings.

    The state of a question is five numbers; a micro-batch holds its new ratings only. Questions are dealt to buckets, and a bucket is folded in one call:
    most questions have few ratings, for which a call and a state entry each would cost far more than the fold.
    """
    question = F.col("question_id").cast("long")
    bucket = F.when(question.isNull(), -1).otherwise(F.pmod(F.xxhash64(question), F.lit(BUCKETS)))
    rows = ratings.select(
        bucket.alias("bucket"), F.coalesce(question, F.lit(0)).alias("question_id"), F.col("quality").cast("int").alias("quality"),
        F.col("created_at").cast("timestamp").alias("created_at"), "id",
    )
    kept = "ids array<long>, ease array<long>, interval array<long>, reviews array<long>, days array<long>, first array<long>"
    return rows.groupBy("bucket").applyInPandasWithState(_fold, SCHEDULE, kept, "update", GroupStateTimeout.NoTimeout)


def latest_schedules(updates: DataFrame) -> DataFrame:
    """Current schedule of every question from the updates of all micro-batches."""
    last = updates.groupBy("question_id").agg(F.max_by(F.struct("ease_tenths", "interval_days", "review_count", "days", "first_at"), "epoch").alias("s"))
    return last.select(
        "question_id", (F.col("s.ease_tenths") / 10.0).alias("ease_factor"), F.col("s.interval_days").cast("int").alias("interval_days"),
        F.col("s.review_count").cast("int").alias("review_count"), (F.col("s.first_at") + F.make_dt_interval(F.col("s.days").cast("int"))).alias("next_review"),
    )


def counter_increments(batch: DataFrame) -> DataFrame:
    """Counters of one micro-batch, to be added up by ``total_counters``."""
    return batch.groupBy("question_id").agg(
        F.count("*").alias("times_asked"), F.count_if("is_correct").alias("times_correct"), F.max("created_at").alias("last_asked")
    )


def total_counters(increments: DataFrame) -> DataFrame:
    return increments.groupBy("question_id").agg(
        F.sum("times_asked").alias("times_asked"), F.sum("times_correct").alias("times_correct"), F.max("last_asked").alias("last_asked")
    )


def ingest_documents(docs: DataFrame, cfg: CleaningConfig = CleaningConfig(), time: str = "ingested_at", delay: str = "1 day", text: str = "text") -> DataFrame:
    """New documents cleaned, quality-checked, and each distinct text passed on once within ``delay``."""
    cleaned = docs.withColumn(text, T.clean_text(F.col(text), cfg))
    good = cleaned.filter(T.quality_reason(F.col(text), cfg) == "quality").withColumn("hash", F.md5(text))
    return good.withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def enriched_progress(progress: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Stream-static join: events with the attributes of their workspace."""
    w = workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"))
    return progress.join(w, "workspace_id", "left")
