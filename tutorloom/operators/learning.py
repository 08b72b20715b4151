"""Learning analytics over workspaces, files, questions, answers, sessions and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorloom.functions import study as S
from tutorloom.operators.lookups import top_n

# --- joins ---------------------------------------------------------------------------------------


def workspace_questions(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Questions with the workspace of their file."""
    f = files.select(F.col("id").alias("file_id"), "workspace_id")
    return questions.join(f, "file_id")


def session_answers(answers: DataFrame, session_questions: DataFrame) -> DataFrame:
    """Answers to the questions of each session; an answer appears once per session holding its question."""
    return answers.join(session_questions.select("session_id", "question_id"), "question_id")


def session_results(session_questions: DataFrame, questions: DataFrame) -> DataFrame:
    q = questions.select(F.col("id").alias("question_id"), "question_text", "question_type", "difficulty")
    return session_questions.join(q, "question_id")


def due_questions(questions: DataFrame, schedules: DataFrame, as_of: Column, concepts: list[str] | None = None) -> DataFrame:
    """Questions due for review with their schedule."""
    s = schedules.filter(F.col("next_review") <= as_of)
    if concepts:
        s = s.filter(F.col("kg_concept_id").isin(*concepts))
    return questions.join(s, questions["id"] == s["question_id"]).drop("question_id")


def question_performance(questions: DataFrame, files: DataFrame, answers: DataFrame) -> DataFrame:
    """Stored counters and mean answer time per question; questions never answered stay, without a time.

    Answers are aggregated before the join, so a question with very many answers crosses the
    network as one partial row per task.
    """
    times = answers.groupBy("question_id").agg(F.avg("time_taken").alias("avg_time"))
    return (
        workspace_questions(questions, files)
        .join(times, F.col("id") == times["question_id"], "left")
        .select("workspace_id", "id", "difficulty", "times_asked", "times_correct", "avg_time")
    )


def in_workspaces(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Questions whose file belongs to one of the given files."""
    return questions.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


# --- aggregations -------------------------------------------------------------------------------


def answer_statistics(questions: DataFrame, answers: DataFrame) -> DataFrame:
    a = answers.groupBy("question_id").agg(
        F.count("*").alias("total_answers"),
        F.avg("time_taken").alias("avg_time"),
        F.count_if("is_correct").alias("correct_answers"),
    )
    return questions.select(F.col("id").alias("question_id")).join(a, "question_id", "left").select(
        "question_id",
        F.coalesce("total_answers", F.lit(0)).alias("total_answers"),
        F.coalesce("avg_time", F.lit(0.0)).alias("avg_time"),
        F.coalesce("correct_answers", F.lit(0)).alias("correct_answers"),
    )


def file_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("workspace_id").agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def question_stats(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Per workspace: questions, completed ones, mean accuracy over all questions and attempts."""
    return (
        workspace_questions(questions, files)
        .groupBy("workspace_id")
        .agg(
            F.count("*").alias("total_questions"),
            F.count_if(F.col("times_correct") > 0).alias("completed_questions"),
            F.avg(S.accuracy(F.col("times_correct"), F.col("times_asked"))).alias("avg_accuracy"),
            F.sum("times_asked").alias("total_attempts"),
        )
    )


def session_stats(sessions: DataFrame) -> DataFrame:
    """Completed sessions per workspace; a session without questions does not enter the mean score."""
    return (
        sessions.filter(F.col("status") == "completed")
        .groupBy("workspace_id")
        .agg(
            F.count("*").alias("total_sessions"),
            F.coalesce(F.avg(F.try_divide("correct_answers", "total_questions")), F.lit(0.0)).alias("avg_score"),
            F.coalesce(F.sum("total_time"), F.lit(0)).alias("total_time"),
        )
    )


def progress_stats(progress: DataFrame) -> DataFrame:
    """Starts, last start, last completion and last study date per workspace, in one pass."""
    action, ts = F.col("action_type"), F.col("timestamp")
    return (
        progress.filter(action.isin("quiz_started", "quiz_completed"))
        .groupBy("workspace_id")
        .agg(
            F.count_if(action == "quiz_started").alias("study_sessions"),
            F.max(F.when(action == "quiz_started", ts)).alias("last_study"),
            F.max(F.when(action == "quiz_completed", ts)).alias("last_studied"),
            F.max(ts).alias("last_activity"),
        )
    )


def workspace_overview(workspaces: DataFrame, files: DataFrame, questions: DataFrame, progress: DataFrame) -> DataFrame:
    """File count, question totals and last completion for every workspace in one plan."""
    ws = workspaces.withColumnRenamed("id", "workspace_id")
    return (
        ws.join(file_stats(files), "workspace_id", "left")
        .join(question_stats(questions, files), "workspace_id", "left")
        .join(progress_stats(progress), "workspace_id", "left")
        .select(
            "workspace_id",
            "name",
            F.coalesce("total_files", F.lit(0)).alias("file_count"),
            F.coalesce("total_questions", F.lit(0)).alias("total_questions"),
            F.coalesce("completed_questions", F.lit(0)).alias("completed_questions"),
            "last_studied",
        )
    )


def study_days(progress: DataFrame, key: str = "workspace_id", action: str = "quiz_completed") -> DataFrame:
    """Distinct days with a completed quiz."""
    return progress.filter(F.col("action_type") == action).select(key, F.to_date("timestamp").alias("day")).distinct()


def current_streak(days: DataFrame, as_of_day: Column, key: str = "workspace_id", max_gap_days: int = 2, last_days: int = 30) -> DataFrame:
    """Length of the run of study days that reaches today or yesterday.

    ``days`` holds one row per key and day, so a window over a key is bounded by the calendar, not
    by the size of the log. Neighbouring days may lie up to ``max_gap_days`` apart.
    """
    w = Window.partitionBy(key).orderBy(F.col("day").desc())
    gap = F.when(F.row_number().over(w) == 1, F.date_diff(as_of_day, "day") > 1).otherwise(
        F.date_diff(F.lag("day").over(w), "day") > max_gap_days
    )
    recent = top_n(days.filter(F.col("day") <= as_of_day), last_days, [F.col("day").desc()], [key])
    marked = recent.withColumn("broken", gap.cast("int"))
    run = marked.withColumn("breaks", F.sum("broken").over(w))
    return run.groupBy(key).agg(F.count_if(F.col("breaks") == 0).alias("study_streak"))


def longest_streak(days: DataFrame, key: str = "workspace_id", max_gap_days: int = 1) -> DataFrame:
    w = Window.partitionBy(key).orderBy("day")
    gap = F.coalesce(F.date_diff("day", F.lag("day").over(w)) > max_gap_days, F.lit(True)).cast("int")
    islands = days.withColumn("starts", gap).withColumn("island", F.sum("starts").over(w))
    return (
        islands.groupBy(key, "island")
        .agg(F.count("*").alias("length"))
        .groupBy(key)
        .agg(F.max("length").alias("longest_streak"))
    )


def workspace_stats(
    workspaces: DataFrame, files: DataFrame, questions: DataFrame, sessions: DataFrame, progress: DataFrame, as_of_day: Column, max_gap_days: int = 2
) -> DataFrame:
    """Detailed statistics of every workspace."""
    streak = current_streak(study_days(progress), as_of_day, max_gap_days=max_gap_days)
    correct = (F.coalesce("avg_accuracy", F.lit(0.0)) * F.coalesce("total_attempts", F.lit(0))).cast("long")
    return (
        workspaces.select(F.col("id").alias("workspace_id"))
        .join(file_stats(files), "workspace_id", "left")
        .join(question_stats(questions, files), "workspace_id", "left")
        .join(session_stats(sessions), "workspace_id", "left")
        .join(progress_stats(progress), "workspace_id", "left")
        .join(streak, "workspace_id", "left")
        .select(
            "workspace_id",
            F.coalesce("total_files", F.lit(0)).alias("total_files"),
            F.coalesce("total_questions", F.lit(0)).alias("total_questions"),
            correct.alias("correct_answers"),
            (F.coalesce("total_attempts", F.lit(0)) - correct).alias("incorrect_answers"),
            F.coalesce("study_streak", F.lit(0)).alias("study_streak"),
            F.coalesce("avg_score", F.lit(0.0)).alias("average_score"),
            F.col("last_study").alias("last_study_date"),
        )
    )


def performance_analysis(questions: DataFrame, files: DataFrame, answers: DataFrame, concepts: DataFrame) -> DataFrame:
    """Mean question accuracy per workspace by difficulty, by concept and overall, in one result.

    ``concepts`` is the exploded (question_id, concept_id) list. Overall accuracy weighs answers,
    the other two weigh questions, as each question carries one accuracy.
    """
    per_question = (
        answers.groupBy("question_id")
        .agg(F.count("*").alias("asked"), F.count_if("is_correct").alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("asked"))
    )
    q = (
        workspace_questions(questions, files)
        .select("workspace_id", F.col("id").alias("question_id"), "difficulty")
        .join(per_question, "question_id")
    )
    linked = q.join(concepts, "question_id")
    by_level = (
        q.groupingSets([["workspace_id", "difficulty"], ["workspace_id"]], "workspace_id", "difficulty")
        .agg(
            F.grouping("difficulty").alias("is_total"),
            F.count("*").alias("questions"),
            F.avg("accuracy").alias("mean"),
            (F.sum("correct") / F.sum("asked")).alias("pooled"),
        )
        .select(
            "workspace_id",
            F.when(F.col("is_total") == 1, "overall").otherwise("difficulty").alias("kind"),
            F.coalesce("difficulty", F.lit("all")).alias("name"),
            "questions",
            F.when(F.col("is_total") == 1, F.col("pooled")).otherwise(F.col("mean")).alias("accuracy"),
        )
    )
    by_concept = (
        linked.groupBy("workspace_id", "concept_id")
        .agg(F.count("*").alias("questions"), F.avg("accuracy").alias("accuracy"))
        .select("workspace_id", F.lit("concept").alias("kind"), F.col("concept_id").alias("name"), "questions", "accuracy")
    )
    return by_level.unionByName(by_concept)


def optimal_difficulty(analysis: DataFrame, target: float = 0.75) -> DataFrame:
    """Difficulty whose mean accuracy is nearest to ``target`` (0.5 assumed without data)."""
    rank = F.create_map(F.lit("medium"), F.lit(0), F.lit("easy"), F.lit(1), F.lit("hard"), F.lit(2))
    seen = analysis.filter(F.col("kind") == "difficulty").select("workspace_id", F.col("name").alias("difficulty"), "accuracy")
    all_levels = (
        analysis.select("workspace_id").distinct().select("workspace_id", F.explode(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard"))).alias("difficulty"))
    )
    scored = all_levels.join(seen, ["workspace_id", "difficulty"], "left").withColumn(
        "distance", F.abs(F.coalesce("accuracy", F.lit(0.5)) - target)
    )
    return scored.groupBy("workspace_id").agg(F.min_by("difficulty", F.struct("distance", rank[F.col("difficulty")])).alias("optimal_difficulty"))


# --- weak areas ---------------------------------------------------------------------------------


def latest_answers(answers: DataFrame, n: int = 5) -> DataFrame:
    return top_n(answers, n, [F.col("created_at").desc(), F.col("id").desc()], ["question_id"])


def time_trends(answers: DataFrame) -> DataFrame:
    """``struggling`` / ``improving`` / ``stable`` from the newest five answer times of a question."""
    overall = answers.groupBy("question_id").agg(F.count("*").alias("n"), F.avg("time_taken").alias("avg_time"))
    recent = latest_answers(answers).groupBy("question_id").agg(F.count("*").alias("recent_n"), F.avg("time_taken").alias("recent_time"))
    enough = (F.col("n") > 5) & (F.col("avg_time") != 0) & (F.col("recent_n") >= 3)
    trend = (
        F.when(enough & (F.col("recent_time") > F.col("avg_time") * 1.2), "struggling")
        .when(enough & (F.col("recent_time") < F.col("avg_time") * 0.8), "improving")
        .otherwise("stable")
    )
    return overall.join(recent, "question_id").select("question_id", trend.alias("time_trend"))


def weak_areas(questions: DataFrame, answers: DataFrame, as_of: Column, min_answers: int = 3) -> DataFrame:
    """Every sufficiently answered question with its weakness score, trend and advice.

    Counters and the newest five answers come from two passes over ``answers`` on the same key; the
    second pass keeps five rows per question before it shuffles.
    """
    stats = (
        answers.groupBy("question_id")
        .agg(
            F.count("*").alias("n_asked"),
            F.count_if("is_correct").alias("n_correct"),
            F.avg("time_taken").alias("avg_time"),
            F.min("created_at").alias("first_at"),
            F.max("created_at").alias("last_at"),
        )
        .filter(F.col("n_asked") >= min_answers)
    )
    recent = latest_answers(answers.select("question_id", "id", "created_at", "time_taken")).groupBy("question_id").agg(
        F.count("*").alias("recent_n"), F.avg("time_taken").alias("recent_time")
    )
    q = questions.filter(F.col("times_asked") > 0).select(
        F.col("id").alias("question_id"), "file_id", "question_text", "question_type", "difficulty"
    )
    acc = F.col("accuracy")
    recency = F.least(F.col("last_asked_days") / 7, F.lit(2.0))
    trend = (
        F.when((F.col("n_asked") <= 5) | (F.col("avg_time") == 0) | (F.col("recent_n") < 3), "stable")
        .when(F.col("recent_time") > F.col("avg_time") * 1.2, "struggling")
        .when(F.col("recent_time") < F.col("avg_time") * 0.8, "improving")
        .otherwise("stable")
    )
    velocity = F.when(
        S.days_between(F.col("last_at"), F.col("first_at")) > 7, F.when(acc > 0.5, acc - 0.5).otherwise(acc - 0.7)
    ).otherwise(0.0)
    return (
        q.join(stats, "question_id")
        .join(recent, "question_id")
        .withColumn("accuracy", F.col("n_correct") / F.col("n_asked"))
        .withColumn("error_rate", 1 - acc)
        .withColumn("consistency", 1 - (F.col("n_asked") - F.col("n_correct")) / F.col("n_asked"))
        .withColumn("last_asked_days", F.coalesce(S.days_between(as_of, F.col("last_at")), F.lit(30)))
        .withColumn("time_trend", trend)
        .select(
            "question_id",
            "file_id",
            "question_text",
            "question_type",
            "difficulty",
            F.col("n_asked").alias("times_asked"),
            F.col("n_correct").alias("times_correct"),
            "accuracy",
            "error_rate",
            "avg_time",
            "consistency",
            velocity.alias("learning_velocity"),
            "time_trend",
            "last_asked_days",
            S.weakness_score(F.col("error_rate"), F.col("consistency"), recency, F.col("difficulty")).alias("weakness"),
            S.advice(acc, F.col("consistency"), F.col("time_trend"), F.col("difficulty")).alias("advice"),
        )
    )


def top_weak_areas(areas: DataFrame, limit: int = 10) -> DataFrame:
    # rounding lets the id, not the last bits of a sum, decide between equal scores
    return top_n(areas, limit, [F.round("weakness", 9).desc(), F.col("question_id")])


def weak_concepts(areas: DataFrame, concepts: DataFrame, limit: int = 10, top: int = 5) -> DataFrame:
    """Mean weakness per concept over the ``2 * limit`` weakest questions."""
    worst = top_weak_areas(areas, 2 * limit).select("question_id", "weakness")
    grouped = worst.join(concepts, "question_id").groupBy("concept_id").agg(
        F.count("*").alias("question_count"), F.avg("weakness").alias("avg_weakness")
    )
    return top_n(grouped, top, [F.round("avg_weakness", 9).desc(), F.col("concept_id")])


def weak_area_summary(areas: DataFrame) -> DataFrame:
    return areas.agg(
        F.count("*").alias("total_questions_analyzed"),
        F.count_if(F.col("weakness") > 0.5).alias("weak_questions_found"),
        F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("average_accuracy"),
    )


def repetition_stats(schedules: DataFrame, questions: DataFrame, as_of: Column) -> DataFrame:
    """Tracked, due, mean ease and interval, reviews; questions may be restricted by ``in_workspaces``."""
    tracked = schedules.join(questions.select(F.col("id").alias("question_id")), "question_id", "left_semi")
    return tracked.agg(
        F.count("*").alias("tracked"),
        F.count_if(F.col("next_review") <= as_of).alias("due"),
        F.coalesce(F.avg("ease_factor"), F.lit(2.5)).alias("avg_ease"),
        F.coalesce(F.avg("interval_days"), F.lit(1.0)).alias("avg_interval"),
        F.coalesce(F.sum("review_count"), F.lit(0)).alias("total_reviews"),
    )


# --- selection ------------------------------------------------------------------------------------


def adaptive_questions(questions: DataFrame, files: DataFrame, as_of: Column, count: int = 10) -> DataFrame:
    """The ``count`` questions of each workspace that most deserve practice."""
    scored = workspace_questions(questions, files).withColumn(
        "score", S.adaptive_score(F.col("times_asked"), F.col("times_correct"), F.col("difficulty"), F.col("last_asked"), as_of)
    )
    return top_n(scored, count, [F.col("score").desc(), F.col("id")], ["workspace_id"])


def topped_up(existing: DataFrame, generated: DataFrame, count: int, by: list[str], order: list[Column]) -> DataFrame:
    """Existing rows first, then generated ones, up to ``count`` per group."""
    both = existing.withColumn("source", F.lit(0)).unionByName(generated.withColumn("source", F.lit(1)))
    return top_n(both, count, [F.col("source"), *order], by)


def quota_selection(questions: DataFrame, quotas: dict[str, int], column: str, order: list[Column], by: list[str], total: int) -> DataFrame:
    """Per group fill each stratum's quota first, then the remaining places in order."""
    share = F.lit(0)
    for value, quota in quotas.items():
        share = F.when(F.col(column) == value, quota).otherwise(share)
    # no stratum can contribute more than ``total`` rows, so everything below that rank is settled
    ranked = top_n(questions, total, order, [*by, column]).withColumn("spare", (F.col("position") > share).cast("int")).drop("position")
    return top_n(ranked, total, [F.col("spare"), *order], by)


def targeted_review(questions: DataFrame, files: DataFrame, total: int = 10, weak_share: float = 0.7, weak_below: float = 0.6) -> DataFrame:
    """A review of each workspace: ``weak_share`` of the places for questions answered badly so far, the rest for others, free places filled in order.

    A question is weak if it was asked and less than ``weak_below`` of its answers were right; the worst come first, never asked ones last.
    """
    accuracy = F.try_divide(F.col("times_correct"), F.col("times_asked"))
    rated = workspace_questions(questions, files).withColumn("accuracy", accuracy).withColumn("area", F.when(accuracy < weak_below, "weak").otherwise("strong"))
    weak = round(total * weak_share)
    return quota_selection(rated, {"weak": weak, "strong": total - weak}, "area", [F.col("accuracy").asc_nulls_last(), F.col("id")], ["workspace_id"], total)


def flashcard_order(cards: DataFrame, deck: str, topic: str, score: str, key: str, size: int) -> DataFrame:
    """Round-robin over topics, hardest first within each: the first ``size`` cards of every deck."""
    inner = top_n(cards, size, [F.col(score).desc(), F.col(key)], [deck, topic]).withColumnRenamed("position", "turn")
    return top_n(inner, size, [F.col("turn"), F.col(score).desc(), F.col(key)], [deck])
