"""Scoring rules of study analytics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tutorloom.functions.vectors import clamp

# --- fixed values -----------------------------------------------------------------------------
DEFAULT_EASE, MIN_EASE, MAX_EASE = 2.5, 1.3, 3.0
ADAPTIVE_WEIGHT = {"easy": 0.5, "medium": 1.0, "hard": 1.5}
WEAKNESS_WEIGHT = {"easy": 0.8, "medium": 1.0, "hard": 1.3}
ADVICE = {
    "fundamentals": "Focus on fundamental concepts - consider reviewing basic materials",
    "similar": "Practice similar questions to build confidence",
    "consistency": "Work on consistency - review mistakes and understand why they occurred",
    "slower": "Take more time to understand concepts before answering",
    "faster": "Great progress! Continue practicing at this pace",
    "hard": "Break down complex topics into smaller, manageable parts",
    "easy": "Review basic concepts that may have been misunderstood",
    "default": "Continue practicing to maintain performance",
}
# -----------------------------------------------------------------------------------------------

DAY_MICROS = 86_400_000_000
MAX_INTERVAL = 2_900_000  # days; later reviews would pass the year 9999, where the calendar types end
CALENDAR_END = "9999-12-31 23:59:59"


def days_between(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods between two timestamps, rounded down."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / DAY_MICROS)


def add_days(ts: Column, days: Column) -> Column:
    """``ts`` some days later; past the calendar's end its last second."""
    return F.least(ts + F.make_dt_interval(days), F.lit(CALENDAR_END).cast("timestamp_ntz"))


def age_bucket(ts: Column, as_of: Column) -> Column:
    """Today / Yesterday / n days / weeks / months ago, by started 24-hour periods."""
    micros = F.abs(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")))
    days = F.ceil(micros / DAY_MICROS)
    return (
        F.when(ts.isNull(), "Never")
        .when(days == 1, "Today")
        .when(days == 2, "Yesterday")
        .when(days <= 7, F.concat(days - 1, F.lit(" days ago")))
        .when(days <= 30, F.concat(F.ceil(days / 7), F.lit(" weeks ago")))
        .otherwise(F.concat(F.ceil(days / 30), F.lit(" months ago")))
    )


def by_difficulty(difficulty: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(difficulty == name, weight).otherwise(out)
    return out


def accuracy(correct: Column, asked: Column) -> Column:
    """Share correct, 0 for a question never asked."""
    return F.coalesce(F.try_divide(correct, asked), F.lit(0.0))


def adaptive_score(asked: Column, correct: Column, difficulty: Column, last_asked: Column, as_of: Column) -> Column:
    """How much a question deserves to be asked next: low accuracy, hard, long not asked."""
    need = F.when(asked > 0, (1 - accuracy(correct, asked)) * 2).otherwise(1.0)
    boost = F.when(last_asked.isNotNull(), 1 + F.least(days_between(as_of, last_asked) / 7, F.lit(2.0))).otherwise(1.5)
    return need * by_difficulty(difficulty, ADAPTIVE_WEIGHT) * boost


def weakness_score(error_rate: Column, consistency: Column, recency: Column, difficulty: Column) -> Column:
    return error_rate * 0.4 + (1 - consistency) * 0.3 + recency * 0.2 + by_difficulty(difficulty, WEAKNESS_WEIGHT) * 0.1


def advice(acc: Column, consistency: Column, trend: Column, difficulty: Column) -> Column:
    """All advice whose condition holds, in fixed order; one default when none does."""
    chosen = F.array(
        F.when(acc < 0.5, ADVICE["fundamentals"]).when(acc < 0.7, ADVICE["similar"]),
        F.when(consistency < 0.6, ADVICE["consistency"]),
        F.when(trend == "struggling", ADVICE["slower"]).when(trend == "improving", ADVICE["faster"]),
        F.when((difficulty == "hard") & (acc < 0.6), ADVICE["hard"]).when((difficulty == "easy") & (acc < 0.8), ADVICE["easy"]),
    )
    said = F.filter(chosen, lambda x: x.isNotNull())
    return F.when(F.size(said) == 0, F.array(F.lit(ADVICE["default"]))).otherwise(said)


def next_ease(ease: Column, quality: Column) -> Column:
    passed = clamp(ease + (0.1 - (5 - quality) * 0.1), MIN_EASE, MAX_EASE)
    return F.when(quality < 3, F.greatest(F.lit(MIN_EASE), ease - 0.2)).otherwise(passed)


def next_interval(ease: Column, interval: Column, reviews: Column, quality: Column) -> Column:
    """Days to the next review; grows with the ease held *before* this answer."""
    return (
        F.when(quality < 3, 1)
        .when(reviews == 0, 1)
        .when(reviews == 1, 6)
        .otherwise(F.least(F.bround(interval * ease), F.lit(float(MAX_INTERVAL))).cast("int"))
    )


def next_reviews(reviews: Column, quality: Column) -> Column:
    """A failure keeps the count; a pass adds one."""
    return reviews + F.when(quality >= 3, 1).otherwise(0)


def progress_percent(files_done: Column, quizzes_done: Column, total_files: Column) -> Column:
    return F.least(100.0 * (files_done + quizzes_done) / F.greatest(2 * total_files, F.lit(10)), F.lit(100.0))
