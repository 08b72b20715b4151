"""Queries for reports and spaced repetition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorloom.operators import reports as R
from tutorloom.operators import spaced as SP
from tutorloom.operators import learning as L
from tutorloom.plans import mapping as M
from tutorloom.plans.mapping import AS_OF_ANSWERS, AS_OF_EVENTS, ntz, sql_with
from tutorloom.plans.q_study import rounded, sql_rounded, sql_stamp, stamp
from tutorloom.plans.registry import query

LEVEL_SQL = "CASE difficulty WHEN 'easy' THEN 0.0 WHEN 'hard' THEN 1.0 ELSE 0.5 END"


@query("agg28_topic_rollup", sql_with("topic_areas", f"""SELECT workspace_id, count(*) AS total_topics, CAST(sum(concept_count) AS BIGINT) AS total_concepts,
    CAST(sum(file_count) AS BIGINT) AS total_files, string_agg(topic_area_id || '=' || printf('%.4f', coverage_score), ',' ORDER BY topic_area_id) AS coverage,
    strftime(TIMESTAMP '{AS_OF_EVENTS}' + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS next_analysis FROM topic_areas GROUP BY 1"""))
def _(spark, d):
    df = R.topic_rollup(M.topic_areas(spark, d), ntz(AS_OF_EVENTS))
    shown = F.transform(F.map_entries("coverage_distribution"), lambda e: F.format_string("%s=%.4f", e["key"], e["value"]))
    return df.select("workspace_id", "total_topics", "total_concepts", "total_files", F.array_join(shown, ",").alias("coverage"), stamp("next_analysis"))


@query("agg30_progress_percent", sql_with("workspaces files quiz_sessions", """SELECT w.id AS workspace_id,
    round(least(100.0 * (coalesce(f.n, 0) + coalesce(s.taken, 0)) / greatest(2 * coalesce(s.total, 0), 10), 100.0), 6) AS percent
    FROM workspaces w LEFT JOIN (SELECT workspace_id, count(*) n FROM files GROUP BY 1) f ON f.workspace_id = w.id
    LEFT JOIN (SELECT workspace_id, count(*) FILTER (status = 'completed') taken, count(*) total FROM quiz_sessions GROUP BY 1) s ON s.workspace_id = w.id"""))
def _(spark, d):
    return R.workspace_progress(M.workspaces(spark, d), M.files(spark, d), M.quiz_sessions(spark, d)).select("workspace_id", *rounded("percent"))


@query("agg31_quiz_results", sql_with("session_questions questions0", """SELECT session_id, count(*) AS total_questions, count(*) FILTER (is_correct) AS correct_answers,
    count(*) FILTER (NOT is_correct) AS incorrect_answers, round(100.0 * count(*) FILTER (is_correct) / count(*), 6) AS score_percentage,
    CAST(sum(time_taken) AS BIGINT) AS total_time, round(avg(time_taken), 6) AS average_time, count(*) FILTER (difficulty = 'easy') AS easy,
    count(*) FILTER (difficulty = 'medium') AS medium, count(*) FILTER (difficulty = 'hard') AS hard
    FROM session_questions s JOIN questions0 q ON s.question_id = q.id GROUP BY 1"""))
def _(spark, d):
    df = R.quiz_results(M.session_questions(spark, d), M.questions(spark, d))
    return df.withColumns({c: F.round(c, 6) for c in ("score_percentage", "average_time")})


@query("agg32_quiz_stats", sql_with("quiz_sessions questions0 question_concepts", """WITH t AS (SELECT workspace_id, count(*) AS total_sessions,
        CAST(sum(total_questions) AS BIGINT) AS answered, CAST(sum(correct_answers) AS BIGINT) AS correct,
        avg(correct_answers / nullif(total_questions, 0)) AS average_score,
        regr_slope(correct_answers / nullif(total_questions, 0), epoch_us(created_at) / 86400000000.0) AS slope FROM quiz_sessions GROUP BY 1),
    q AS (SELECT f.workspace_id, q.id AS question_id, q.difficulty FROM questions0 q JOIN files f ON q.file_id = f.id),
    fav AS (SELECT workspace_id, difficulty FROM (SELECT workspace_id, difficulty, count(*) n FROM q GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY n DESC, difficulty) = 1),
    pq AS (SELECT question_id, count(*) asked, count(*) FILTER (is_correct) AS ok FROM answers GROUP BY 1),
    hard AS (SELECT workspace_id, concept_id FROM (SELECT workspace_id, concept_id, sum(ok) / sum(asked) acc FROM q JOIN pq USING (question_id)
        JOIN question_concepts USING (question_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY round(acc, 9), concept_id) = 1)
    SELECT t.workspace_id, total_sessions, answered, correct, round(average_score, 6) AS average_score, fav.difficulty AS favorite_difficulty,
        hard.concept_id AS most_difficult_topic, CASE WHEN slope > 1e-5 THEN 'improving' WHEN slope < -1e-5 THEN 'declining' ELSE 'stable' END AS trend
    FROM t LEFT JOIN fav USING (workspace_id) LEFT JOIN hard USING (workspace_id)"""))
def _(spark, d):
    df = R.quiz_stats(M.quiz_sessions(spark, d), M.questions(spark, d), M.files(spark, d), M.answers(spark, d), M.question_concepts(spark, d))
    return df.withColumn("average_score", F.round("average_score", 6))


@query("agg33_file_report", sql_with("questions", f"""SELECT file_id, count(*) AS total_questions, CAST(sum(times_correct) AS BIGINT) AS correct_answers,
    CAST(sum(times_asked - times_correct) AS BIGINT) AS incorrect_answers, round(avg({LEVEL_SQL}), 6) AS difficulty_score,
    {sql_stamp('max(last_asked)', 'last_studied')} FROM questions GROUP BY 1"""))
def _(spark, d):
    df = R.file_report(M.questions_with_counters(spark, d))
    return df.withColumn("difficulty_score", F.round("difficulty_score", 6)).withColumn("last_studied", stamp("last_studied"))


@query("agg34_daily_sessions", sql_with("answers questions0 files", f"""SELECT strftime(a.created_at, '%Y-%m-%d') AS day, round(sum(time_taken) / 60.0, 6) AS duration_minutes,
    count(*) AS questions_answered, count(*) FILTER (is_correct) AS correct_answers,
    array_to_string(list_sort(list_distinct(list(f.workspace_id))), ',') AS workspaces_studied, round(avg({LEVEL_SQL}), 6) AS average_difficulty
    FROM answers a JOIN questions0 q ON a.question_id = q.id JOIN files f ON q.file_id = f.id GROUP BY 1"""))
def _(spark, d):
    df = R.daily_sessions(M.answers(spark, d), M.questions(spark, d), M.files(spark, d))
    return df.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), *rounded("duration_minutes", "average_difficulty"), "questions_answered", "correct_answers",
        F.array_join(F.col("workspaces_studied").cast("array<string>"), ",").alias("workspaces_studied"),
    )


@query("agg35_user_stats", sql_with("progress", f"""WITH b AS (SELECT user_id, sum(value) AS total_value, avg(value) AS average_score,
        count(*) FILTER (action_type = 'question_answered') AS questions_answered,
        count(*) FILTER (action_type = 'quiz_started' AND timestamp >= t - INTERVAL 7 DAY) AS sessions_this_week,
        count(*) FILTER (action_type = 'quiz_started' AND timestamp >= t - INTERVAL 30 DAY) AS sessions_this_month,
        avg(value) FILTER (timestamp >= t - INTERVAL 7 DAY) - avg(value) FILTER (timestamp >= t - INTERVAL 14 DAY AND timestamp < t - INTERVAL 7 DAY) AS improvement_rate
        FROM progress, (SELECT TIMESTAMP '{AS_OF_EVENTS}' AS t) GROUP BY 1),
    pl AS (SELECT user_id, workspace_id, avg(value) AS score, count(*) AS n FROM progress GROUP BY 1, 2),
    days AS (SELECT DISTINCT user_id, CAST(timestamp AS DATE) AS day FROM progress WHERE action_type = 'quiz_completed'),
    isl AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM days),
    il AS (SELECT user_id, island, count(*) AS n, max(day) AS last_day FROM isl GROUP BY 1, 2),
    st AS (SELECT user_id, max(n) AS longest_streak, max(CASE WHEN last_day >= DATE '{AS_OF_EVENTS[:10]}' - 1 THEN n ELSE 0 END) AS study_streak FROM il GROUP BY 1),
    fav AS (SELECT user_id, workspace_id AS favorite_workspace FROM pl QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, workspace_id) = 1),
    we AS (SELECT user_id, workspace_id AS weakest_workspace FROM pl QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9), workspace_id) = 1),
    sg AS (SELECT user_id, workspace_id AS strongest_workspace FROM pl QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, workspace_id) = 1)
    SELECT user_id, round(total_value, 9) AS total_value, round(average_score, 9) AS average_score, questions_answered, sessions_this_week, sessions_this_month,
        round(coalesce(improvement_rate, 0), 9) AS improvement_rate, favorite_workspace, weakest_workspace, strongest_workspace,
        coalesce(study_streak, 0) AS study_streak, coalesce(longest_streak, 0) AS longest_streak
    FROM b JOIN fav USING (user_id) JOIN we USING (user_id) JOIN sg USING (user_id) LEFT JOIN st USING (user_id)"""))
def _(spark, d):
    df = R.user_stats(M.progress(spark, d), ntz(AS_OF_EVENTS)).withColumn("improvement_rate", F.coalesce("improvement_rate", F.lit(0.0)))
    return df.withColumns({c: F.round(c, 9) for c in ("total_value", "average_score", "improvement_rate")})


@query("agg36_period_report", sql_with("progress", f"""SELECT coalesce(strftime(day, '%Y-%m-%d'), '-') AS day, coalesce(workspace_id, -1) AS workspace_id,
    CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(workspace_id) = 0 THEN 'workspace' ELSE 'total' END AS level,
    count(*) FILTER (action_type = 'quiz_started') AS sessions, count(*) FILTER (action_type = 'question_answered') AS questions, round(avg(value), 9) AS average_score
    FROM (SELECT *, CAST(timestamp AS DATE) AS day FROM progress) GROUP BY GROUPING SETS ((day), (workspace_id), ())"""))
def _(spark, d):
    df = R.period_report(M.progress(spark, d), ntz(AS_OF_EVENTS))
    return df.select(
        F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("-")).alias("day"), F.coalesce("workspace_id", F.lit(-1)).alias("workspace_id"),
        "level", "sessions", "questions", F.round("average_score", 9).alias("average_score"),
    )


GOALS = {"first_quiz": ("quiz_completed", 1), "ten_quizzes": ("quiz_completed", 10), "reader": ("file_viewed", 15), "scholar": ("question_answered", 20)}
GOALS_SQL = ", ".join(f"('{k}', '{a}', {t})" for k, (a, t) in GOALS.items())


@query("agg37_achievements", sql_with("progress", f"""WITH g(achievement_id, action_type, target) AS (VALUES {GOALS_SQL}),
    u AS (SELECT DISTINCT user_id FROM progress),
    n AS (SELECT user_id, action_type, count(*) AS n FROM progress GROUP BY 1, 2),
    r AS (SELECT user_id, action_type, timestamp, row_number() OVER (PARTITION BY user_id, action_type ORDER BY timestamp, id) AS rn FROM progress)
    SELECT u.user_id, g.achievement_id, g.target, coalesce(n.n, 0) AS current_value, round(least(1.0, coalesce(n.n, 0) / g.target), 6) AS progress,
        coalesce(strftime(r.timestamp, '%Y-%m-%d %H:%M:%S'), 'locked') AS unlocked_at
    FROM u, g LEFT JOIN n ON n.user_id = u.user_id AND n.action_type = g.action_type
    LEFT JOIN r ON r.user_id = u.user_id AND r.action_type = g.action_type AND r.rn = g.target"""))
def _(spark, d):
    df = R.achievement_progress(M.progress(spark, d), GOALS)
    return df.select("user_id", "achievement_id", "target", "current_value", *rounded("progress"), F.coalesce(stamp("unlocked_at"), F.lit("locked")).alias("unlocked_at"))


@query("agg37_gamification", sql_with("progress", f"""WITH g(achievement_id, action_type, target) AS (VALUES {GOALS_SQL}),
    u AS (SELECT DISTINCT user_id FROM progress), n AS (SELECT user_id, action_type, count(*) AS n FROM progress GROUP BY 1, 2),
    a AS (SELECT u.user_id, least(1.0, coalesce(n.n, 0) / g.target) AS progress FROM u, g LEFT JOIN n ON n.user_id = u.user_id AND n.action_type = g.action_type)
    SELECT user_id, count(*) FILTER (progress >= 1) AS unlocked, count(*) FILTER (progress >= 1) * 100 AS experience_points, round(avg(progress), 6) AS mean_progress FROM a GROUP BY 1"""))
def _(spark, d):
    return R.gamification(R.achievement_progress(M.progress(spark, d), GOALS)).withColumn("mean_progress", F.round("mean_progress", 6))


@query("agg38_pool_diversity", sql_with("questions0 files question_concepts", """WITH q AS (SELECT f.workspace_id, q.* FROM questions0 q JOIN files f ON q.file_id = f.id),
    t AS (SELECT workspace_id, concept_id, count(*) AS n FROM q JOIN question_concepts c ON c.question_id = q.id GROUP BY 1, 2),
    e AS (SELECT workspace_id, -sum(p * ln(p)) AS topic_entropy FROM (SELECT workspace_id, n / sum(n) OVER (PARTITION BY workspace_id) AS p FROM t) GROUP BY 1),
    y AS (SELECT workspace_id, var_pop(n) AS type_variance FROM (SELECT workspace_id, question_type, count(*) n FROM q GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT workspace_id, 1 - max(n) / sum(n) AS difficulty_spread FROM (SELECT workspace_id, difficulty, count(*) n FROM q GROUP BY 1, 2) GROUP BY 1),
    m AS (SELECT workspace_id, stddev_pop(epoch_us(created_at) / 86400000000.0) AS temporal_spread_days FROM q GROUP BY 1)
    SELECT workspace_id, round(topic_entropy, 6) AS topic_entropy, round(type_variance, 6) AS type_variance, round(difficulty_spread, 6) AS difficulty_spread,
        round(temporal_spread_days, 4) AS temporal_spread_days FROM e JOIN y USING (workspace_id) JOIN l USING (workspace_id) JOIN m USING (workspace_id)"""))
def _(spark, d):
    df = R.pool_diversity(M.questions(spark, d), M.files(spark, d), M.question_concepts(spark, d))
    return df.select("workspace_id", *rounded("topic_entropy", "type_variance", "difficulty_spread"), F.round("temporal_spread_days", 4).alias("temporal_spread_days"))


# --- spaced repetition ------------------------------------------------------------------------------

STEP_SQL = """CASE WHEN quality < 3 THEN greatest(1.3, ease_factor - 0.2) ELSE greatest(1.3, least(3.0, ease_factor + (0.1 - (5 - quality) * 0.1))) END"""
INTERVAL_SQL = """CASE WHEN quality < 3 OR review_count = 0 THEN 1 WHEN review_count = 1 THEN 6 ELSE CAST(round_even(interval_days * ease_factor, 0) AS INT) END"""


@query("sm2_1_step", sql_with("schedules", f"""WITH s AS (SELECT s.*, CAST(ease_factor AS DOUBLE) AS ease_factor, CAST(floor(o_totalprice) AS BIGINT) % 6 AS quality
        FROM (SELECT * EXCLUDE (ease_factor), CAST(ease_factor AS DOUBLE) AS ease_factor FROM schedules) s JOIN orders ON o_orderkey = question_id)
    SELECT question_id, quality, round({STEP_SQL}, 6) AS new_ease, {INTERVAL_SQL} AS new_interval,
    review_count + CAST(quality >= 3 AS INT) AS new_reviews FROM s""".replace("s.*, CAST(ease_factor AS DOUBLE) AS ease_factor, CAST(floor", "s.*, CAST(floor")))
def _(spark, d):
    rating = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), (F.floor("o_totalprice") % 6).alias("quality"))
    return SP.step(M.schedules(spark, d).join(rating, "question_id")).select("question_id", "quality", "new_ease", "new_interval", "new_reviews")


@query("sm2_2_apply_ratings", sql_with("schedules answers questions0", f"""WITH st AS (SELECT s.* EXCLUDE (ease_factor), CAST(s.ease_factor AS DOUBLE) AS ease_factor FROM schedules s JOIN questions0 q ON q.id = s.question_id
        WHERE q.difficulty <> 'hard'),
    r AS (SELECT question_id, quality FROM answers QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, id DESC) = 1),
    j AS (SELECT coalesce(st.question_id, r.question_id) AS question_id, quality, coalesce(ease_factor, 2.5) AS ease_factor, coalesce(interval_days, 1) AS interval_days,
        coalesce(review_count, 0) AS review_count, coalesce(next_review, TIMESTAMP '{AS_OF_ANSWERS}') AS next_review FROM st FULL JOIN r ON r.question_id = st.question_id)
    SELECT question_id, round(CASE WHEN quality IS NULL THEN ease_factor ELSE {STEP_SQL} END, 6) AS ease_factor,
        CASE WHEN quality IS NULL THEN interval_days ELSE {INTERVAL_SQL} END AS interval_days,
        review_count + CASE WHEN quality >= 3 THEN 1 ELSE 0 END AS review_count,
        strftime(CASE WHEN quality IS NULL THEN next_review ELSE next_review + to_days({INTERVAL_SQL}) END, '%Y-%m-%d %H:%M:%S') AS next_review FROM j"""))
def _(spark, d):
    easy = M.questions(spark, d).filter("difficulty <> 'hard'").select(F.col("id").alias("question_id"))
    state = M.schedules(spark, d).join(easy, "question_id", "left_semi")
    ratings = L.latest_answers(M.answers(spark, d), 1)
    df = SP.apply_ratings(state, ratings, ntz(AS_OF_ANSWERS))
    return df.select("question_id", *rounded("ease_factor"), "interval_days", "review_count", stamp("next_review"))


@query("sm2_3_replay", sql_with("answers", """WITH RECURSIVE rated AS (SELECT question_id, quality, created_at, row_number() OVER (PARTITION BY question_id ORDER BY created_at, id) AS rn FROM answers),
    f(question_id, rn, e, i, c, t) AS (SELECT question_id, CAST(0 AS BIGINT), CAST(25 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), created_at FROM rated WHERE rn = 1
        UNION ALL SELECT f.question_id, f.rn + 1, CASE WHEN quality < 3 THEN greatest(13, e - 2) ELSE greatest(13, least(30, e + quality - 4)) END,
            CASE WHEN quality < 3 OR c = 0 THEN 1 WHEN c = 1 THEN 6 ELSE CAST(round_even(i * e / 10.0, 0) AS BIGINT) END,
            c + CAST(quality >= 3 AS BIGINT),
            t + to_days(CAST(CASE WHEN quality < 3 OR c = 0 THEN 1 WHEN c = 1 THEN 6 ELSE round_even(i * e / 10.0, 0) END AS INT))
        FROM f JOIN rated r ON r.question_id = f.question_id AND r.rn = f.rn + 1)
    SELECT question_id, e / 10.0 AS ease_factor, i AS interval_days, c AS review_count, strftime(t, '%Y-%m-%d %H:%M:%S') AS next_review FROM f
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rn DESC) = 1"""))
def _(spark, d):
    return SP.replay(M.answers(spark, d)).withColumn("next_review", stamp("next_review"))
