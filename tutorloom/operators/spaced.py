"""Spaced repetition: one step, a batch update, and the replay of whole histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorloom.functions import study as S

MAX_INTERVAL = S.MAX_INTERVAL


def step(df: DataFrame, ease="ease_factor", interval="interval_days", reviews="review_count", quality="quality") -> DataFrame:
    """Adds new_ease, new_interval and new_reviews for one rating per row."""
    e, i, c, q = (F.col(x) for x in (ease, interval, reviews, quality))
    return df.select(
        "*",
        F.round(S.next_ease(e, q), 6).alias("new_ease"),
        S.next_interval(e, i, c, q).alias("new_interval"),
        S.next_reviews(c, q).alias("new_reviews"),
    )


def apply_ratings(state: DataFrame, ratings: DataFrame, as_of: Column) -> DataFrame:
    """Stored schedules after at most one rating per question; unrated schedules stay as they are.

    The next review counts from the previous next review, or from ``as_of`` for a new question.
    """
    joined = state.join(ratings.select("question_id", "quality"), "question_id", "full_outer")
    stepped = step(
        joined.withColumns(
            {
                "ease_factor": F.coalesce("ease_factor", F.lit(S.DEFAULT_EASE)),
                "interval_days": F.coalesce("interval_days", F.lit(1)),
                "review_count": F.coalesce("review_count", F.lit(0)),
                "next_review": F.coalesce("next_review", as_of),
            }
        )
    )
    rated = F.col("quality").isNotNull()
    return stepped.select(
        "question_id",
        F.when(rated, F.col("new_ease")).otherwise(F.col("ease_factor")).alias("ease_factor"),
        F.when(rated, F.col("new_interval")).otherwise(F.col("interval_days")).alias("interval_days"),
        F.when(rated, F.col("new_reviews")).otherwise(F.col("review_count")).alias("review_count"),
        F.when(rated, S.add_days(F.col("next_review"), F.col("new_interval"))).otherwise(F.col("next_review")).alias("next_review"),
    )


# --- replay of whole histories -------------------------------------------------------------------
#
# Ratings are range-partitioned on (question, time, id): a question with very many ratings spans
# several tasks, each of which streams its slice in order and holds one running state. Only the
# first question of a slice can have begun in an earlier one. For it the task does not know the
# starting state, so it follows all of them at once: ease moves in tenths from 1.3 to 3.0 (18
# values) and the review count matters only as 0, 1 or more. The interval is settled by the first
# failure; the passes before it are kept as they are and replayed when the slices are joined.

START_EASES = range(13, 31)
NEW = (25, 1, 0, 0)  # ease in tenths, interval, reviews, days scheduled so far


def fold_rating(state: tuple[int, int, int, int], quality: int) -> tuple[int, int, int, int]:
    ease, interval, reviews, days = state
    if quality < 3:
        return max(13, ease - 2), 1, reviews, min(days + 1, MAX_INTERVAL)
    if reviews < 2:
        grown = 1 if reviews == 0 else 6
    else:
        whole, tenth = divmod(interval * ease, 10)
        grown = min(whole + (tenth > 5 or (tenth == 5 and whole % 2 == 1)), MAX_INTERVAL)
    return max(13, min(30, ease + quality - 4)), grown, reviews + 1, min(days + grown, MAX_INTERVAL)


FRAGMENT = (
    "question_id long, slice int, first_at timestamp, state array<long>, head array<int>, "
    "starts array<array<long>>"
)


def _fold_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per question of a sorted slice: its end state, or a table of end states."""
    question = first_at = state = table = slice_no = None
    head: list[int] = []
    opening = True  # the slice's first question may continue from an earlier slice

    def row():
        return (question, slice_no, first_at, list(state), head, [] if table is None else [[*k, *v] for k, v in table.items()])

    columns = ["question_id", "slice", "first_at", "state", "head", "starts"]
    for pdf in batches:
        done = []
        for q, quality, at, s in zip(pdf["question_id"], pdf["quality"], pdf["created_at"], pdf["slice"]):
            if q != question:
                if question is not None:
                    done.append(row())
                    opening = False
                question, first_at, state, head, table, slice_no = q, at, NEW, [], None, s
            state = fold_rating(state, quality)
            if not opening:
                continue
            if table is not None:
                table = {k: fold_rating(v, quality) for k, v in table.items()}
            elif quality < 3:
                table = {(e, c): fold_rating((e, 1, c, 0), quality) for e in START_EASES for c in (0, 1, 2)}
            else:
                head.append(int(quality))
        if done:
            yield pd.DataFrame(done, columns=columns)
    if question is not None:
        yield pd.DataFrame([row()], columns=columns)


def _join_slices(fragments: pd.DataFrame) -> pd.DataFrame:
    """End state of one question from the fragments of its slices (at most one per task)."""
    fragments = fragments.sort_values("slice")
    state = tuple(int(x) for x in fragments["state"].iloc[0])
    for head, starts in zip(fragments["head"].iloc[1:], fragments["starts"].iloc[1:]):
        for quality in head:
            state = fold_rating(state, quality)
        if len(starts):
            ends = {(int(r[0]), int(r[1])): tuple(int(x) for x in r[2:]) for r in starts}
            seen = min(state[2], 2)
            ease, interval, reviews, days = ends[(state[0], seen)]
            state = (ease, interval, state[2] + reviews - seen, min(state[3] + days, MAX_INTERVAL))
    return pd.DataFrame(
        [(fragments["question_id"].iloc[0], fragments["first_at"].min(), list(state))], columns=["question_id", "first_at", "state"]
    )


def replay(ratings: DataFrame, slices: int | None = None) -> DataFrame:
    """Final schedule per question after folding all of its ratings in time order.

    ``ratings`` holds question_id, quality, created_at and an ``id`` deciding between equal times.
    """
    keys = ["question_id", "created_at", "id"]
    r = ratings.select("question_id", F.col("quality").cast("int").alias("quality"), F.col("created_at").cast("timestamp").alias("created_at"), "id")
    ranged = r.repartitionByRange(slices, *keys) if slices else r.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys).withColumn("slice", F.spark_partition_id())
    fragments = ordered.select("question_id", "quality", "created_at", "slice").mapInPandas(_fold_slices, FRAGMENT)
    # A question inside one slice is already finished. Those crossing a border, at most two per
    # slice, have several fragments and are joined; the count below is a map-side combined sum.
    merged = fragments.groupBy("question_id").agg(
        F.count("*").alias("n"),
        F.min("first_at").alias("first_at"),
        F.first("state").alias("state"),
        F.array_sort(F.collect_list(F.struct("slice", "state", "head", "starts", "first_at"))).alias("parts"),
    )
    whole = merged.filter("n = 1").select("question_id", "first_at", "state")
    split = merged.filter("n > 1").select("question_id", F.explode("parts").alias("p")).select("question_id", "p.*")
    joined = split.groupBy("question_id").applyInPandas(_join_slices, "question_id long, first_at timestamp, state array<long>")
    s = F.col("state")
    return whole.unionByName(joined).select(
        "question_id",
        (s[0] / 10.0).alias("ease_factor"),
        s[1].cast("int").alias("interval_days"),
        s[2].cast("int").alias("review_count"),
        (F.col("first_at") + F.make_dt_interval(s[3].cast("int"))).alias("next_review"),
    )
