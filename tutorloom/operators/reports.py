"""Declared reports: quiz results, file, user and period statistics, achievements, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorloom.functions import study as S
from tutorloom.operators import learning as L
from tutorloom.operators.lookups import top_n

DIFFICULTY_LEVEL = {"easy": 0.0, "medium": 0.5, "hard": 1.0}


def difficulty_level(difficulty: Column) -> Column:
    out = F.lit(0.5)
    for name, level in DIFFICULTY_LEVEL.items():
        out = F.when(difficulty == name, level).otherwise(out)
    return out


def topic_rollup(areas: DataFrame, as_of: Column) -> DataFrame:
    """Per workspace: totals, coverage by topic (as a map) and the suggested next analysis."""
    entry = F.struct("topic_area_id", "coverage_score")
    return areas.groupBy("workspace_id").agg(
        F.count("*").alias("total_topics"),
        F.sum("concept_count").alias("total_concepts"),
        F.sum("file_count").alias("total_files"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("coverage_distribution"),
    ).withColumn("next_analysis", as_of + F.expr("INTERVAL '7' DAY"))


def workspace_progress(workspaces: DataFrame, files: DataFrame, sessions: DataFrame) -> DataFrame:
    quizzes = sessions.groupBy("workspace_id").agg(F.count_if(F.col("status") == "completed").alias("taken"), F.count("*").alias("total"))
    return (
        workspaces.select(F.col("id").alias("workspace_id"))
        .join(L.file_stats(files), "workspace_id", "left")
        .join(quizzes, "workspace_id", "left")
        .na.fill(0)
        .select("workspace_id", S.progress_percent(F.col("total_files"), F.col("taken"), F.col("total")).alias("percent"))
    )


def quiz_results(session_questions: DataFrame, questions: DataFrame) -> DataFrame:
    level = F.col("difficulty")
    return L.session_results(session_questions, questions).groupBy("session_id").agg(
        F.count("*").alias("total_questions"),
        F.count_if("is_correct").alias("correct_answers"),
        F.count_if(~F.col("is_correct")).alias("incorrect_answers"),
        (100.0 * F.count_if("is_correct") / F.count("*")).alias("score_percentage"),
        F.sum("time_taken").alias("total_time"),
        F.avg("time_taken").alias("average_time"),
        *[F.count_if(level == n).alias(n) for n in DIFFICULTY_LEVEL],
    )


def quiz_stats(sessions: DataFrame, questions: DataFrame, files: DataFrame, answers: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per workspace: totals, favourite difficulty, hardest concept and the trend of session scores."""
    score = F.try_divide("correct_answers", "total_questions")
    day = F.unix_micros(F.col("created_at").cast("timestamp")) / S.DAY_MICROS
    totals = sessions.groupBy("workspace_id").agg(
        F.count("*").alias("total_sessions"),
        F.sum("total_questions").alias("answered"),
        F.sum("correct_answers").alias("correct"),
        F.avg(score).alias("average_score"),
        F.regr_slope(score, day).alias("slope"),
    )
    q = L.workspace_questions(questions, files).select("workspace_id", F.col("id").alias("question_id"), "difficulty")
    levels = q.groupBy("workspace_id", "difficulty").agg(F.count("*").alias("n"))
    favourite = levels.groupBy("workspace_id").agg(F.min_by("difficulty", F.struct(-F.col("n"), "difficulty")).alias("favorite_difficulty"))
    per_q = answers.groupBy("question_id").agg(F.count("*").alias("asked"), F.count_if("is_correct").alias("right"))
    topics = q.join(per_q, "question_id").join(concepts, "question_id").groupBy("workspace_id", "concept_id").agg(
        (F.sum("right") / F.sum("asked")).alias("acc")
    )
    hardest = topics.groupBy("workspace_id").agg(F.min_by("concept_id", F.struct(F.round("acc", 9), "concept_id")).alias("most_difficult_topic"))
    trend = F.when(F.col("slope") > 1e-5, "improving").when(F.col("slope") < -1e-5, "declining").otherwise("stable")
    return (
        totals.join(favourite, "workspace_id", "left")
        .join(hardest, "workspace_id", "left")
        .select("workspace_id", "total_sessions", "answered", "correct", "average_score", "favorite_difficulty", "most_difficult_topic", trend.alias("trend"))
    )


def file_report(questions: DataFrame) -> DataFrame:
    """``questions`` with counters; one row per file."""
    return questions.groupBy("file_id").agg(
        F.count("*").alias("total_questions"),
        F.sum("times_correct").alias("correct_answers"),
        F.sum(F.col("times_asked") - F.col("times_correct")).alias("incorrect_answers"),
        F.avg(difficulty_level(F.col("difficulty"))).alias("difficulty_score"),
        F.max("last_asked").alias("last_studied"),
    )


def daily_sessions(answers: DataFrame, questions: DataFrame, files: DataFrame) -> DataFrame:
    """Study per calendar day. Answers are reduced to (question, day) before the join."""
    daily = answers.groupBy("question_id", F.to_date("created_at").alias("day")).agg(
        F.sum("time_taken").alias("seconds"), F.count("*").alias("n"), F.count_if("is_correct").alias("right")
    )
    q = L.workspace_questions(questions, files).select("workspace_id", F.col("id").alias("question_id"), "difficulty")
    return (
        daily.join(q, "question_id")
        .groupBy("day")
        .agg(
            (F.sum("seconds") / 60.0).alias("duration_minutes"),
            F.sum("n").alias("questions_answered"),
            F.sum("right").alias("correct_answers"),
            F.sort_array(F.collect_set("workspace_id")).alias("workspaces_studied"),
            (F.sum(difficulty_level(F.col("difficulty")) * F.col("n")) / F.sum("n")).alias("average_difficulty"),
        )
    )


def user_stats(progress: DataFrame, as_of: Column) -> DataFrame:
    """Per user: activity, score, streaks, sessions of the last week and month, change, extremes."""
    ts, action, value = F.col("timestamp"), F.col("action_type"), F.col("value")
    week, fortnight, month = (as_of - F.expr(f"INTERVAL '{d}' DAY") for d in (7, 14, 30))
    this_week = F.avg(F.when(ts >= week, value))
    last_week = F.avg(F.when((ts >= fortnight) & (ts < week), value))
    base = progress.groupBy("user_id").agg(
        F.sum(value).alias("total_value"),
        F.avg(value).alias("average_score"),
        F.count_if(action == "question_answered").alias("questions_answered"),
        F.count_if((action == "quiz_started") & (ts >= week)).alias("sessions_this_week"),
        F.count_if((action == "quiz_started") & (ts >= month)).alias("sessions_this_month"),
        (this_week - last_week).alias("improvement_rate"),
    )
    places = progress.groupBy("user_id", "workspace_id").agg(F.avg(value).alias("score"), F.count("*").alias("n"))
    score = F.round("score", 9)
    extremes = places.groupBy("user_id").agg(
        F.min_by("workspace_id", F.struct(-F.col("n"), F.col("workspace_id"))).alias("favorite_workspace"),
        F.min_by("workspace_id", F.struct(score, F.col("workspace_id"))).alias("weakest_workspace"),
        F.min_by("workspace_id", F.struct(-score, F.col("workspace_id"))).alias("strongest_workspace"),
    )
    days = L.study_days(progress, "user_id")
    return (
        base.join(extremes, "user_id")
        .join(L.current_streak(days, F.to_date(as_of), "user_id", max_gap_days=1), "user_id", "left")
        .join(L.longest_streak(days, "user_id"), "user_id", "left")
        .withColumns({"study_streak": F.coalesce("study_streak", F.lit(0)), "longest_streak": F.coalesce("longest_streak", F.lit(0))})
    )


def period_report(progress: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    """Totals, per-day and per-workspace rows of one period in a single aggregation."""
    p = progress if days is None else progress.filter(F.col("timestamp") >= as_of - F.expr(f"INTERVAL '{days}' DAY"))
    p = p.withColumn("day", F.to_date("timestamp"))
    return p.groupingSets([["day"], ["workspace_id"], []], "day", "workspace_id").agg(
        F.when(F.grouping("day") == 0, "day").when(F.grouping("workspace_id") == 0, "workspace").otherwise("total").alias("level"),
        F.count_if(F.col("action_type") == "quiz_started").alias("sessions"),
        F.count_if(F.col("action_type") == "question_answered").alias("questions"),
        F.avg("value").alias("average_score"),
    )


def achievement_progress(progress: DataFrame, catalog: dict[str, tuple[str, int]]) -> DataFrame:
    """Progress of every active user on every achievement: {id: (action, target)}.

    The unlocking event is the target-th one; ranks above the largest target are never needed.
    """
    goals = F.array(*[F.struct(F.lit(k).alias("achievement_id"), F.lit(a).alias("action_type"), F.lit(t).alias("target")) for k, (a, t) in catalog.items()])
    users = progress.select("user_id").distinct().select("user_id", F.inline(goals))
    actions = progress.filter(F.col("action_type").isin(*{a for a, _ in catalog.values()}))
    done = actions.groupBy("user_id", "action_type").agg(F.count("*").alias("current_value"))
    ranked = top_n(actions, max(t for _, t in catalog.values()), [F.col("timestamp"), F.col("id")], ["user_id", "action_type"]).select(
        "user_id", "action_type", F.col("position").alias("target"), F.col("timestamp").alias("unlocked_at")
    )
    return (
        users.join(done, ["user_id", "action_type"], "left")
        .join(ranked, ["user_id", "action_type", "target"], "left")
        .withColumn("current_value", F.coalesce("current_value", F.lit(0)))
        .withColumn("progress", F.least(F.lit(1.0), F.col("current_value") / F.col("target")))
    )


def gamification(achievements: DataFrame, points_per_unlock: int = 100) -> DataFrame:
    unlocked = F.count_if(F.col("progress") >= 1)
    return achievements.groupBy("user_id").agg(
        unlocked.alias("unlocked"), (unlocked * points_per_unlock).alias("experience_points"), F.avg("progress").alias("mean_progress")
    )


def pool_diversity(questions: DataFrame, files: DataFrame, concepts: DataFrame) -> DataFrame:
    """Topic entropy, variance of type counts, difficulty spread and spread in time per workspace."""
    q = L.workspace_questions(questions, files).select("workspace_id", F.col("id").alias("question_id"), "difficulty", "question_type", "created_at")
    topics = q.join(concepts, "question_id").groupBy("workspace_id", "concept_id").agg(F.count("*").alias("n"))
    # -sum(p ln p) with p = n / N equals ln N - sum(n ln n) / N
    entropy = topics.groupBy("workspace_id").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("topic_entropy"))
    types = q.groupBy("workspace_id", "question_type").agg(F.count("*").alias("n")).groupBy("workspace_id").agg(F.var_pop("n").alias("type_variance"))
    levels = q.groupBy("workspace_id", "difficulty").agg(F.count("*").alias("n")).groupBy("workspace_id").agg(
        (1 - F.max("n") / F.sum("n")).alias("difficulty_spread")
    )
    times = q.groupBy("workspace_id").agg((F.stddev_pop(F.unix_micros(F.col("created_at").cast("timestamp")) / S.DAY_MICROS)).alias("temporal_spread_days"))
    return entropy.join(types, "workspace_id").join(levels, "workspace_id").join(times, "workspace_id")
