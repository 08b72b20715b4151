"""Queries on the relational study tables: lookups, joins, aggregations, windows, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorloom.functions import study as S
from tutorloom.operators import learning as L
from tutorloom.operators import lookups as K
from tutorloom.plans import mapping as M
from tutorloom.plans.mapping import AS_OF_ANSWERS, AS_OF_EVENTS, AS_OF_REVIEWS, ntz, sql_with
from tutorloom.plans.registry import query


def stamp(column: str, alias: str | None = None):
    """Timestamps leave a query as text, so that both engines print them alike."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(alias or column)


def sql_stamp(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {alias or column.split('.')[-1]}"


def rounded(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def sql_rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# --- lookups --------------------------------------------------------------------------------------


@query("src11_table_read", sql_with("files", "SELECT id, workspace_id, name, size, file_type FROM files"))
def _(spark, d):
    return M.files(spark, d).select("id", "workspace_id", "name", "size", "file_type")


@query("flt1_lookup_by_key", sql_with("questions0 schedules", """SELECT q.id, q.file_id, q.difficulty FROM questions0 q
    WHERE q.id IN (SELECT question_id FROM schedules WHERE review_count = 0)"""))
def _(spark, d):
    wanted = K.by_key(M.schedules(spark, d), review_count=0).select(F.col("question_id").alias("id"))
    return K.by_keys(M.questions(spark, d), wanted, ["id"]).select("id", "file_id", "difficulty")


@query("flt2_workspace_files", sql_with("files", "SELECT workspace_id, path, id FROM files"))
def _(spark, d):
    return M.files(spark, d).select("workspace_id", "path", "id").orderBy("workspace_id", "path")


@query("flt3_path_taken", sql_with("files", """, p AS (SELECT id + 1 AS id, workspace_id, path FROM files)
    SELECT p.id, p.workspace_id, p.path, EXISTS (SELECT 1 FROM files f WHERE f.workspace_id = p.workspace_id AND f.path = p.path
    AND f.id <> p.id) AS taken FROM p""".lstrip(", ").replace("p AS", "WITH p AS", 1)))
def _(spark, d):
    files = M.files(spark, d)
    return K.path_taken(files, files.select((F.col("id") + 1).alias("id"), "workspace_id", "path"))


@query("flt4_answers_newest_first", sql_with("answers", f"SELECT question_id, id, is_correct, {sql_stamp('created_at')} FROM answers"))
def _(spark, d):
    return (
        M.answers(spark, d).orderBy("question_id", F.col("created_at").desc(), F.col("id").desc())
        .select("question_id", "id", "is_correct", stamp("created_at"))
    )


@query("flt5_file_questions", sql_with("questions0", f"SELECT file_id, id, difficulty, {sql_stamp('created_at')} FROM questions0"))
def _(spark, d):
    return M.questions(spark, d).orderBy("file_id", "created_at", "id").select("file_id", "id", "difficulty", stamp("created_at"))


@query("flt6_newest_progress", sql_with("progress", """SELECT workspace_id, id, action_type FROM progress
    QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY timestamp DESC, id DESC) <= 20"""))
def _(spark, d):
    return K.newest(M.progress(spark, d), 20, "timestamp", "id", ["workspace_id"]).select("workspace_id", "id", "action_type")


@query("flt6_newest_progress_of_user", sql_with("progress", """SELECT user_id, id, action_type FROM progress
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) <= 20"""))
def _(spark, d):
    return K.newest(M.progress(spark, d), 20, "timestamp", "id", ["user_id"]).select("user_id", "id", "action_type")


@query("flt7_recent_progress", sql_with("progress", f"""SELECT id, workspace_id, action_type, value FROM progress
    WHERE timestamp >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY"""))
def _(spark, d):
    return K.within_days(M.progress(spark, d), "timestamp", ntz(AS_OF_EVENTS), 7).select("id", "workspace_id", "action_type", "value")


@query("flt8_recent_sessions", sql_with("quiz_sessions", """SELECT workspace_id, id, status, total_questions FROM quiz_sessions
    QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY id DESC) <= 10"""))
def _(spark, d):
    return K.top_n(M.quiz_sessions(spark, d), 10, [F.col("id").desc()], ["workspace_id"]).select("workspace_id", "id", "status", "total_questions")


@query("flt9_session_questions", sql_with("session_questions", "SELECT session_id, question_order, question_id, is_correct FROM session_questions"))
def _(spark, d):
    return M.session_questions(spark, d).orderBy("session_id", "question_order").select("session_id", "question_order", "question_id", "is_correct")


@query("flt10_overdue_reviews", sql_with("schedules", f"""SELECT question_id, interval_days, {sql_stamp('next_review')} FROM schedules
    WHERE next_review < TIMESTAMP '{AS_OF_REVIEWS}'"""))
def _(spark, d):
    return K.due(M.schedules(spark, d), ntz(AS_OF_REVIEWS), strictly=True).select("question_id", "interval_days", stamp("next_review"))


@query("flt11_due_reviews", sql_with("schedules", f"""SELECT question_id, {sql_stamp('next_review')} FROM schedules
    WHERE next_review <= TIMESTAMP '{AS_OF_REVIEWS}' ORDER BY schedules.next_review, question_id LIMIT 50"""))
def _(spark, d):
    due = K.due(M.schedules(spark, d), ntz(AS_OF_REVIEWS))
    return K.top_n(due, 50, [F.col("next_review"), F.col("question_id")]).select("question_id", stamp("next_review"))


@query("flt12_topic_areas_ranked", sql_with("topic_areas", """SELECT workspace_id, topic_area_id, coverage_score, explored_percentage,
    row_number() OVER (PARTITION BY workspace_id ORDER BY coverage_score DESC, explored_percentage DESC, topic_area_id) AS position
    FROM topic_areas QUALIFY position <= 20"""))
def _(spark, d):
    order = [F.col("coverage_score").desc(), F.col("explored_percentage").desc(), F.col("topic_area_id")]
    return K.top_n(M.topic_areas(spark, d), 20, order, ["workspace_id"]).select(
        "workspace_id", "topic_area_id", "coverage_score", "explored_percentage", "position"
    )


@query("flt13_achievement_unlocked", sql_with("progress", """SELECT u.user_id, coalesce(x.found, FALSE) AS found
    FROM (SELECT DISTINCT user_id FROM progress) u LEFT JOIN (SELECT user_id, TRUE AS found FROM progress
    WHERE action_type = 'quiz_completed' GROUP BY user_id HAVING count(*) >= 15) x USING (user_id)"""))
def _(spark, d):
    p = M.progress(spark, d)
    unlocked = p.filter(F.col("action_type") == "quiz_completed").groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= 15)
    return K.exists_by(unlocked, p.select("user_id").distinct(), ["user_id"])


# --- joins ----------------------------------------------------------------------------------------


@query("join1_workspace_questions", sql_with("questions0 files", f"""SELECT f.workspace_id, q.id, q.difficulty, {sql_stamp('q.created_at')}
    FROM questions0 q JOIN files f ON q.file_id = f.id"""))
def _(spark, d):
    return L.workspace_questions(M.questions(spark, d), M.files(spark, d)).select("workspace_id", "id", "difficulty", stamp("created_at"))


@query("join2_session_answers", sql_with("answers session_questions", """SELECT s.session_id, a.question_id, a.id, a.is_correct
    FROM answers a JOIN session_questions s ON a.question_id = s.question_id"""))
def _(spark, d):
    return L.session_answers(M.answers(spark, d), M.session_questions(spark, d)).select("session_id", "question_id", "id", "is_correct")


@query("join3_session_results", sql_with("questions0 session_questions", """SELECT s.session_id, s.question_order, s.question_id, s.user_answer,
    s.is_correct, s.time_taken, q.question_text, q.question_type, q.difficulty FROM session_questions s JOIN questions0 q ON s.question_id = q.id"""))
def _(spark, d):
    return L.session_results(M.session_questions(spark, d), M.questions(spark, d)).drop("answered_at").orderBy("session_id", "question_order")


@query("join4_due_questions", sql_with("questions0 schedules", f"""SELECT q.id, q.file_id, q.difficulty, round(s.ease_factor, 6) AS ease_factor, s.interval_days,
    s.review_count, s.kg_concept_id, {sql_stamp('s.next_review')} FROM questions0 q JOIN schedules s ON q.id = s.question_id
    WHERE s.next_review <= TIMESTAMP '{AS_OF_REVIEWS}' AND s.kg_concept_id IN ('c1', 'c2', 'c3', 'c4', 'c5')"""))
def _(spark, d):
    df = L.due_questions(M.questions(spark, d), M.schedules(spark, d), ntz(AS_OF_REVIEWS), ["c1", "c2", "c3", "c4", "c5"])
    return df.select("id", "file_id", "difficulty", *rounded("ease_factor"), "interval_days", "review_count", "kg_concept_id", stamp("next_review"))


@query("join5_question_performance", sql_with("questions files", """SELECT f.workspace_id, q.id, q.difficulty, q.times_asked, q.times_correct,
    coalesce(round(t.avg_time, 6), -1) AS avg_time FROM questions q JOIN files f ON q.file_id = f.id
    LEFT JOIN (SELECT question_id, avg(time_taken) AS avg_time FROM answers GROUP BY 1) t ON t.question_id = q.id"""))
def _(spark, d):
    df = L.question_performance(M.questions_with_counters(spark, d), M.files(spark, d), M.answers(spark, d))
    return df.withColumn("avg_time", F.coalesce(F.round("avg_time", 6), F.lit(-1.0)))


@query("join6_questions_of_large_workspaces", sql_with("questions0 files", """SELECT id, file_id, difficulty FROM questions0
    WHERE file_id IN (SELECT id FROM files WHERE size >= 5000)"""))
def _(spark, d):
    return L.in_workspaces(M.questions(spark, d), M.files(spark, d).filter("size >= 5000")).select("id", "file_id", "difficulty")


# --- aggregations ----------------------------------------------------------------------------------


@query("agg1_answer_statistics", sql_with("questions0 answers", """SELECT q.id AS question_id, count(a.id) AS total_answers,
    round(coalesce(avg(a.time_taken), 0), 6) AS avg_time, count(*) FILTER (a.is_correct) AS correct_answers
    FROM questions0 q LEFT JOIN answers a ON a.question_id = q.id GROUP BY q.id"""))
def _(spark, d):
    df = L.answer_statistics(M.questions(spark, d), M.answers(spark, d))
    return df.select("question_id", "total_answers", *rounded("avg_time"), "correct_answers")


@query("agg2_question_stats", sql_with("questions files", """SELECT f.workspace_id, count(*) AS total_questions,
    count(*) FILTER (q.times_correct > 0) AS completed_questions FROM questions q JOIN files f ON q.file_id = f.id GROUP BY 1"""))
def _(spark, d):
    return L.question_stats(M.questions_with_counters(spark, d), M.files(spark, d)).select("workspace_id", "total_questions", "completed_questions")


@query("agg3_file_stats", sql_with("files", "SELECT workspace_id, count(*) AS total_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM files GROUP BY 1"))
def _(spark, d):
    return L.file_stats(M.files(spark, d))


@query("agg4_question_accuracy", sql_with("questions files", """SELECT f.workspace_id, count(*) AS total_questions,
    round(avg(CASE WHEN times_asked > 0 THEN times_correct * 1.0 / times_asked ELSE 0 END), 6) AS avg_accuracy,
    CAST(sum(times_asked) AS BIGINT) AS total_attempts FROM questions q JOIN files f ON q.file_id = f.id GROUP BY 1"""))
def _(spark, d):
    df = L.question_stats(M.questions_with_counters(spark, d), M.files(spark, d))
    return df.select("workspace_id", "total_questions", *rounded("avg_accuracy"), "total_attempts")


@query("agg5_session_stats", sql_with("quiz_sessions", """SELECT workspace_id, count(*) AS total_sessions,
    round(coalesce(avg(correct_answers * 1.0 / nullif(total_questions, 0)), 0), 6) AS avg_score,
    CAST(coalesce(sum(total_time), 0) AS BIGINT) AS total_time FROM quiz_sessions WHERE status = 'completed' GROUP BY 1"""))
def _(spark, d):
    return L.session_stats(M.quiz_sessions(spark, d)).select("workspace_id", "total_sessions", *rounded("avg_score"), "total_time")


@query("agg6_progress_stats", sql_with("progress", f"""SELECT workspace_id, count(*) AS study_sessions, {sql_stamp('max(timestamp)', 'last_study')}
    FROM progress WHERE action_type = 'quiz_started' GROUP BY 1"""))
def _(spark, d):
    df = L.progress_stats(M.progress(spark, d)).filter("study_sessions > 0")
    return df.select("workspace_id", "study_sessions", stamp("last_study"))


@query("agg7_last_studied", sql_with("progress", f"""SELECT workspace_id,
    {sql_stamp("max(timestamp) FILTER (action_type = 'quiz_completed')", 'last_studied')}, {sql_stamp('max(timestamp)', 'last_activity')}
    FROM progress WHERE action_type IN ('quiz_started', 'quiz_completed') GROUP BY 1"""))
def _(spark, d):
    return L.progress_stats(M.progress(spark, d)).select("workspace_id", stamp("last_studied"), stamp("last_activity"))


@query("agg8_session_correct", sql_with("session_questions", "SELECT session_id, count(*) FILTER (is_correct) AS correct FROM session_questions GROUP BY 1"))
def _(spark, d):
    return M.session_questions(spark, d).groupBy("session_id").agg(F.count_if("is_correct").alias("correct"))


@query("agg9_questions_per_workspace", sql_with("questions0 files", "SELECT workspace_id, count(*) AS questions FROM questions0 q JOIN files f ON q.file_id = f.id GROUP BY 1"))
def _(spark, d):
    return L.workspace_questions(M.questions(spark, d), M.files(spark, d)).groupBy("workspace_id").agg(F.count("*").alias("questions"))


@query("agg10_workspace_overview", sql_with("workspaces files questions progress", f"""SELECT w.id AS workspace_id, w.name,
    coalesce(f.n, 0) AS file_count, coalesce(q.n, 0) AS total_questions, coalesce(q.done, 0) AS completed_questions, {sql_stamp('p.last_studied')}
    FROM workspaces w LEFT JOIN (SELECT workspace_id, count(*) n FROM files GROUP BY 1) f ON f.workspace_id = w.id
    LEFT JOIN (SELECT workspace_id, count(*) n, count(*) FILTER (times_correct > 0) done FROM questions JOIN files ON file_id = files.id GROUP BY 1) q ON q.workspace_id = w.id
    LEFT JOIN (SELECT workspace_id, max(timestamp) AS last_studied FROM progress WHERE action_type = 'quiz_completed' GROUP BY 1) p ON p.workspace_id = w.id"""))
def _(spark, d):
    df = L.workspace_overview(M.workspaces(spark, d), M.files(spark, d), M.questions_with_counters(spark, d), M.progress(spark, d))
    return df.select("workspace_id", "name", "file_count", "total_questions", "completed_questions", stamp("last_studied"))


STREAK_SQL = f"""days AS (SELECT DISTINCT workspace_id, CAST(timestamp AS DATE) AS day FROM progress
        WHERE action_type = 'quiz_completed' AND CAST(timestamp AS DATE) <= DATE '{AS_OF_EVENTS[:10]}'),
    recent AS (SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY day DESC) <= 30),
    gaps AS (SELECT workspace_id, day, CASE WHEN lag(day) OVER w IS NULL THEN date_diff('day', day, DATE '{AS_OF_EVENTS[:10]}') > 1
        ELSE date_diff('day', day, lag(day) OVER w) > 2 END AS broken FROM recent WINDOW w AS (PARTITION BY workspace_id ORDER BY day DESC)),
    runs AS (SELECT workspace_id, sum(CAST(broken AS INT)) OVER (PARTITION BY workspace_id ORDER BY day DESC) AS breaks FROM gaps),
    streaks AS (SELECT workspace_id, count(*) FILTER (breaks = 0) AS study_streak FROM runs GROUP BY 1)"""


@query("agg11_workspace_stats", sql_with("workspaces files questions quiz_sessions progress", f"""WITH {STREAK_SQL},
    q AS (SELECT workspace_id, count(*) n, avg(CASE WHEN times_asked > 0 THEN times_correct * 1.0 / times_asked ELSE 0 END) acc, CAST(sum(times_asked) AS BIGINT) att
        FROM questions JOIN files ON file_id = files.id GROUP BY 1),
    f AS (SELECT workspace_id, count(*) n FROM files GROUP BY 1),
    s AS (SELECT workspace_id, avg(correct_answers * 1.0 / nullif(total_questions, 0)) score FROM quiz_sessions WHERE status = 'completed' GROUP BY 1),
    p AS (SELECT workspace_id, max(timestamp) last_study FROM progress WHERE action_type = 'quiz_started' GROUP BY 1)
    SELECT w.id AS workspace_id, coalesce(f.n, 0) AS total_files, coalesce(q.n, 0) AS total_questions,
        CAST(trunc(coalesce(acc * att, 0)) AS BIGINT) AS correct_answers, coalesce(att, 0) - CAST(trunc(coalesce(acc * att, 0)) AS BIGINT) AS incorrect_answers,
        coalesce(study_streak, 0) AS study_streak, round(coalesce(score, 0), 6) AS average_score, {sql_stamp('last_study', 'last_study_date')}
    FROM workspaces w LEFT JOIN f ON f.workspace_id = w.id LEFT JOIN q ON q.workspace_id = w.id LEFT JOIN s ON s.workspace_id = w.id
    LEFT JOIN p ON p.workspace_id = w.id LEFT JOIN streaks ON streaks.workspace_id = w.id"""))
def _(spark, d):
    df = L.workspace_stats(
        M.workspaces(spark, d), M.files(spark, d), M.questions_with_counters(spark, d), M.quiz_sessions(spark, d), M.progress(spark, d),
        F.to_date(F.lit(AS_OF_EVENTS[:10])),
    )
    return df.select(
        "workspace_id", "total_files", "total_questions", "correct_answers", "incorrect_answers", "study_streak",
        *rounded("average_score"), stamp("last_study_date"),
    )


ANALYSIS_SQL = """per_q AS (SELECT question_id, count(*) AS asked, count(*) FILTER (is_correct) AS correct, count(*) FILTER (is_correct) / count(*) AS accuracy
        FROM answers GROUP BY 1),
    qa AS (SELECT f.workspace_id, q.id AS question_id, q.difficulty, p.asked, p.correct, p.accuracy
        FROM questions0 q JOIN files f ON q.file_id = f.id JOIN per_q p ON p.question_id = q.id),
    analysis AS (SELECT workspace_id, 'overall' AS kind, 'all' AS name, count(*) AS questions, sum(correct) / sum(asked) AS accuracy FROM qa GROUP BY 1
        UNION ALL SELECT workspace_id, 'difficulty', difficulty, count(*), avg(accuracy) FROM qa GROUP BY 1, 3
        UNION ALL SELECT workspace_id, 'concept', concept_id, count(*), avg(accuracy) FROM qa JOIN question_concepts USING (question_id) GROUP BY 1, 3)"""


@query("agg12_performance_analysis", sql_with("questions0 files answers question_concepts",
    f"WITH {ANALYSIS_SQL} SELECT workspace_id, kind, name, questions, round(accuracy, 6) AS accuracy FROM analysis"))
def _(spark, d):
    df = L.performance_analysis(M.questions(spark, d), M.files(spark, d), M.answers(spark, d), M.question_concepts(spark, d))
    return df.withColumn("accuracy", F.round("accuracy", 6))


@query("agg13_optimal_difficulty", sql_with("questions0 files answers question_concepts", f"""WITH {ANALYSIS_SQL},
    lv AS (SELECT DISTINCT workspace_id, l.difficulty, l.rank FROM analysis, (VALUES ('medium', 0), ('easy', 1), ('hard', 2)) l(difficulty, rank)),
    sc AS (SELECT lv.*, abs(coalesce(a.accuracy, 0.5) - 0.75) AS distance FROM lv LEFT JOIN analysis a
        ON a.workspace_id = lv.workspace_id AND a.kind = 'difficulty' AND a.name = lv.difficulty)
    SELECT workspace_id, difficulty AS optimal_difficulty FROM sc
    QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY distance, rank) = 1"""))
def _(spark, d):
    return L.optimal_difficulty(L.performance_analysis(M.questions(spark, d), M.files(spark, d), M.answers(spark, d), M.question_concepts(spark, d)))


WEAK_SQL = f"""latest AS (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, id DESC) <= 5),
    recent AS (SELECT question_id, count(*) AS recent_n, avg(time_taken) AS recent_time FROM latest GROUP BY 1),
    stats AS (SELECT question_id, count(*) AS n, count(*) FILTER (is_correct) AS c, avg(time_taken) AS avg_time, min(created_at) AS f, max(created_at) AS l
        FROM answers GROUP BY 1 HAVING count(*) >= 3),
    base AS (SELECT q.id AS question_id, q.file_id, q.question_text, q.question_type, q.difficulty, n AS times_asked, c AS times_correct, c / n AS accuracy,
        1 - c / n AS error_rate, avg_time, 1 - (n - c) / n AS consistency, f, l, recent_n, recent_time,
        CAST(floor(date_diff('microsecond', l, TIMESTAMP '{AS_OF_ANSWERS}') / 86400000000.0) AS BIGINT) AS last_asked_days,
        CASE WHEN n <= 5 OR avg_time = 0 OR recent_n < 3 THEN 'stable' WHEN recent_time > avg_time * 1.2 THEN 'struggling'
            WHEN recent_time < avg_time * 0.8 THEN 'improving' ELSE 'stable' END AS time_trend
        FROM questions q JOIN stats s ON q.id = s.question_id JOIN recent r ON r.question_id = q.id WHERE q.times_asked > 0),
    weak AS (SELECT *, CASE WHEN floor(date_diff('microsecond', f, l) / 86400000000.0) > 7 THEN CASE WHEN accuracy > 0.5 THEN accuracy - 0.5 ELSE accuracy - 0.7 END
            ELSE 0 END AS learning_velocity,
        error_rate * 0.4 + (1 - consistency) * 0.3 + least(last_asked_days / 7.0, 2) * 0.2
            + (CASE difficulty WHEN 'easy' THEN 0.8 WHEN 'hard' THEN 1.3 ELSE 1.0 END) * 0.1 AS weakness FROM base)"""
ADVICE_SQL = f"""array_to_string(CASE WHEN len(list_filter(a, lambda x: x IS NOT NULL)) = 0 THEN ['{S.ADVICE["default"]}'] ELSE list_filter(a, lambda x: x IS NOT NULL) END, ' | ')"""


@query("agg14_weak_areas", sql_with("questions", f"""WITH {WEAK_SQL},
    adv AS (SELECT *, [CASE WHEN accuracy < 0.5 THEN '{S.ADVICE["fundamentals"]}' WHEN accuracy < 0.7 THEN '{S.ADVICE["similar"]}' END,
        CASE WHEN consistency < 0.6 THEN '{S.ADVICE["consistency"]}' END,
        CASE time_trend WHEN 'struggling' THEN '{S.ADVICE["slower"]}' WHEN 'improving' THEN '{S.ADVICE["faster"]}' END,
        CASE WHEN difficulty = 'hard' AND accuracy < 0.6 THEN '{S.ADVICE["hard"]}' WHEN difficulty = 'easy' AND accuracy < 0.8 THEN '{S.ADVICE["easy"]}' END] AS a
        FROM weak)
    SELECT question_id, question_text, question_type, difficulty, times_asked, times_correct,
        {sql_rounded('accuracy', 'error_rate', 'avg_time', 'consistency', 'learning_velocity', 'weakness')},
        time_trend, last_asked_days, {ADVICE_SQL} AS advice FROM adv"""))
def _(spark, d):
    df = L.weak_areas(M.questions_with_counters(spark, d), M.answers(spark, d), ntz(AS_OF_ANSWERS))
    return df.select(
        "question_id", "question_text", "question_type", "difficulty", "times_asked", "times_correct",
        *rounded("accuracy", "error_rate", "avg_time", "consistency", "learning_velocity", "weakness"),
        "time_trend", "last_asked_days", F.array_join("advice", " | ").alias("advice"),
    )


@query("agg14_top_weak_areas", sql_with("questions", f"""WITH {WEAK_SQL} SELECT question_id, round(weakness, 6) AS weakness FROM weak
    ORDER BY round(weak.weakness, 9) DESC, question_id LIMIT 10"""))
def _(spark, d):
    df = L.weak_areas(M.questions_with_counters(spark, d), M.answers(spark, d), ntz(AS_OF_ANSWERS))
    return L.top_weak_areas(df).select("question_id", *rounded("weakness"))


@query("agg15_weak_concepts", sql_with("questions question_concepts", f"""WITH {WEAK_SQL},
    worst AS (SELECT question_id, weakness FROM weak ORDER BY round(weak.weakness, 9) DESC, question_id LIMIT 20)
    SELECT concept_id, count(*) AS question_count, round(avg(weakness), 6) AS avg_weakness FROM worst JOIN question_concepts USING (question_id)
    GROUP BY 1 ORDER BY round(avg(worst.weakness), 9) DESC, concept_id LIMIT 5"""))
def _(spark, d):
    df = L.weak_areas(M.questions_with_counters(spark, d), M.answers(spark, d), ntz(AS_OF_ANSWERS))
    return L.weak_concepts(df, M.question_concepts(spark, d)).select(
        "concept_id", "question_count", *rounded("avg_weakness")
    )


@query("agg16_weak_area_summary", sql_with("questions", f"""WITH {WEAK_SQL} SELECT count(*) AS total_questions_analyzed,
    count(*) FILTER (weakness > 0.5) AS weak_questions_found, round(coalesce(avg(accuracy), 0), 6) AS average_accuracy FROM weak"""))
def _(spark, d):
    df = L.weak_area_summary(L.weak_areas(M.questions_with_counters(spark, d), M.answers(spark, d), ntz(AS_OF_ANSWERS)))
    return df.select("total_questions_analyzed", "weak_questions_found", *rounded("average_accuracy"))


@query("agg17_repetition_stats", sql_with("schedules questions0 files", f"""SELECT count(*) AS tracked, count(*) FILTER (next_review <= TIMESTAMP '{AS_OF_REVIEWS}') AS due,
    round(coalesce(avg(ease_factor), 2.5), 6) AS avg_ease, round(coalesce(avg(interval_days), 1), 6) AS avg_interval,
    CAST(coalesce(sum(review_count), 0) AS BIGINT) AS total_reviews FROM schedules
    WHERE question_id IN (SELECT q.id FROM questions0 q WHERE q.file_id IN (SELECT id FROM files WHERE workspace_id < 10))"""))
def _(spark, d):
    q = L.in_workspaces(M.questions(spark, d), M.files(spark, d).filter("workspace_id < 10"))
    return L.repetition_stats(M.schedules(spark, d), q, ntz(AS_OF_REVIEWS)).select(
        "tracked", "due", *rounded("avg_ease", "avg_interval"), "total_reviews"
    )


# --- windows ---------------------------------------------------------------------------------------


@query("win1_latest_answers", sql_with("answers", """SELECT question_id, id, time_taken, row_number() OVER w AS position FROM answers
    WINDOW w AS (PARTITION BY question_id ORDER BY created_at DESC, id DESC) QUALIFY position <= 5"""))
def _(spark, d):
    return L.latest_answers(M.answers(spark, d)).select("question_id", "id", "time_taken", "position")


@query("win2_time_trend", sql_with("questions", f"""WITH {WEAK_SQL} SELECT s.question_id, CASE WHEN s.n > 5 AND s.avg_time <> 0 AND r.recent_n >= 3 THEN
    CASE WHEN recent_time > avg_time * 1.2 THEN 'struggling' WHEN recent_time < avg_time * 0.8 THEN 'improving' ELSE 'stable' END ELSE 'stable' END AS time_trend
    FROM (SELECT question_id, count(*) n, avg(time_taken) avg_time FROM answers GROUP BY 1) s JOIN recent r USING (question_id)"""))
def _(spark, d):
    return L.time_trends(M.answers(spark, d))


@query("win3_study_streak", sql_with("progress", f"WITH {STREAK_SQL} SELECT workspace_id, study_streak FROM streaks"))
def _(spark, d):
    return L.current_streak(L.study_days(M.progress(spark, d)), F.to_date(F.lit(AS_OF_EVENTS[:10])))


@query("win6_longest_streak", sql_with("progress", """WITH days AS (SELECT DISTINCT user_id, CAST(timestamp AS DATE) AS day FROM progress WHERE action_type = 'quiz_completed'),
    isl AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM days)
    SELECT user_id, max(n) AS longest_streak FROM (SELECT user_id, island, count(*) AS n FROM isl GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, d):
    return L.longest_streak(L.study_days(M.progress(spark, d), "user_id"), "user_id")


@query("set5_study_days", sql_with("progress", """SELECT DISTINCT workspace_id, strftime(timestamp, '%Y-%m-%d') AS day FROM progress WHERE action_type = 'quiz_completed'"""))
def _(spark, d):
    return L.study_days(M.progress(spark, d)).select("workspace_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


# --- selection -------------------------------------------------------------------------------------


@query("top1_recent_answers", sql_with("answers", """SELECT id, question_id, is_correct FROM answers ORDER BY created_at DESC, id DESC, question_id LIMIT 50"""))
def _(spark, d):
    return K.top_n(M.answers(spark, d), 50, [F.col("created_at").desc(), F.col("id").desc(), F.col("question_id")]).select("id", "question_id", "is_correct")


ADAPTIVE_SQL = f"""scored AS (SELECT f.workspace_id, q.id, q.difficulty, q.times_asked,
        CASE WHEN q.times_asked > 0 THEN (1 - q.times_correct / q.times_asked) * 2 ELSE 1 END
        * CASE q.difficulty WHEN 'easy' THEN 0.5 WHEN 'hard' THEN 1.5 ELSE 1.0 END
        * CASE WHEN q.last_asked IS NULL THEN 1.5 ELSE 1 + least(floor(date_diff('microsecond', q.last_asked, TIMESTAMP '{AS_OF_ANSWERS}') / 86400000000.0) / 7.0, 2) END AS score
        FROM questions q JOIN files f ON q.file_id = f.id)"""


@query("top4_adaptive_questions", sql_with("questions files", f"""WITH {ADAPTIVE_SQL} SELECT workspace_id, id, difficulty, times_asked, round(score, 6) AS score,
    row_number() OVER (PARTITION BY workspace_id ORDER BY score DESC, id) AS position FROM scored QUALIFY position <= 10"""))
def _(spark, d):
    df = L.adaptive_questions(M.questions_with_counters(spark, d), M.files(spark, d), ntz(AS_OF_ANSWERS))
    return df.select("workspace_id", "id", "difficulty", "times_asked", *rounded("score"), "position")


@query("top8_quota_selection", sql_with("questions0 files", """, r AS (SELECT f.workspace_id, q.id, q.difficulty,
        row_number() OVER (PARTITION BY f.workspace_id, q.difficulty ORDER BY q.created_at DESC, q.id) AS rn, q.created_at
        FROM questions0 q JOIN files f ON q.file_id = f.id),
    s AS (SELECT *, rn > CASE difficulty WHEN 'easy' THEN 6 WHEN 'medium' THEN 10 ELSE 4 END AS spare FROM r)
    SELECT workspace_id, id, difficulty, spare FROM s
    QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY spare, created_at DESC, id) <= 20""".lstrip(", ").replace("r AS", "WITH r AS", 1)))
def _(spark, d):
    q = L.workspace_questions(M.questions(spark, d), M.files(spark, d))
    df = L.quota_selection(q, {"easy": 6, "medium": 10, "hard": 4}, "difficulty", [F.col("created_at").desc(), F.col("id")], ["workspace_id"], 20)
    return df.select("workspace_id", "id", "difficulty", (F.col("spare") == 1).alias("spare"))


@query("top8_type_mix", sql_with("questions0 files", """, r AS (SELECT f.workspace_id, q.id, q.question_type, q.created_at,
        row_number() OVER (PARTITION BY f.workspace_id, q.question_type ORDER BY q.created_at DESC, q.id) AS rn FROM questions0 q JOIN files f ON q.file_id = f.id),
    s AS (SELECT *, rn > CASE question_type WHEN 'multiple_choice' THEN 8 WHEN 'true_false' THEN 6 WHEN 'short_answer' THEN 4 ELSE 2 END AS spare FROM r)
    SELECT workspace_id, id, question_type, spare FROM s
    QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY spare, created_at DESC, id) <= 20""".lstrip(", ").replace("r AS", "WITH r AS", 1)))
def _(spark, d):
    q = L.workspace_questions(M.questions(spark, d), M.files(spark, d))
    mix = {"multiple_choice": 8, "true_false": 6, "short_answer": 4, "fill_in_blank": 2}
    df = L.quota_selection(q, mix, "question_type", [F.col("created_at").desc(), F.col("id")], ["workspace_id"], 20)
    return df.select("workspace_id", "id", "question_type", (F.col("spare") == 1).alias("spare"))


@query("top8_targeted_review", sql_with("questions files", """, r AS (SELECT f.workspace_id, q.id, times_correct / nullif(times_asked, 0) AS accuracy, coalesce(times_correct / nullif(times_asked, 0) < 0.6, FALSE) AS weak
        FROM questions q JOIN files f ON q.file_id = f.id),
    s AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, weak ORDER BY accuracy NULLS LAST, id) > CASE WHEN weak THEN 7 ELSE 3 END AS spare FROM r)
    SELECT workspace_id, id, CASE WHEN weak THEN 'weak' ELSE 'strong' END AS area, round(accuracy, 6) AS accuracy, spare FROM s
    QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY spare, accuracy NULLS LAST, id) <= 10""".lstrip(", ").replace("r AS", "WITH r AS", 1)))
def _(spark, d):
    df = L.targeted_review(M.questions_with_counters(spark, d), M.files(spark, d))
    return df.select("workspace_id", "id", "area", F.round("accuracy", 6).alias("accuracy"), (F.col("spare") == 1).alias("spare"))


@query("top9_flashcard_order", sql_with("questions files", f"""WITH {ADAPTIVE_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, difficulty ORDER BY round(score, 9) DESC, id) AS turn FROM scored)
    SELECT workspace_id, id, difficulty, turn, row_number() OVER (PARTITION BY workspace_id ORDER BY turn, round(score, 9) DESC, id) AS position FROM r
    QUALIFY position <= 30"""))
def _(spark, d):
    q = L.workspace_questions(M.questions_with_counters(spark, d), M.files(spark, d))
    score = S.adaptive_score(F.col("times_asked"), F.col("times_correct"), F.col("difficulty"), F.col("last_asked"), ntz(AS_OF_ANSWERS))
    df = L.flashcard_order(q.withColumn("score", F.round(score, 9)), "workspace_id", "difficulty", "score", "id", 30)
    return df.select("workspace_id", "id", "difficulty", "turn", "position")


@query("set4_topped_up_questions", sql_with("questions0 files", """WITH u AS (SELECT workspace_id, q.id, 0 AS source FROM questions0 q JOIN files f ON q.file_id = f.id WHERE difficulty = 'hard'
        UNION ALL SELECT workspace_id, q.id, 1 FROM questions0 q JOIN files f ON q.file_id = f.id WHERE difficulty = 'easy')
    SELECT workspace_id, id, source FROM u QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY source, id) <= 300"""))
def _(spark, d):
    q = L.workspace_questions(M.questions(spark, d), M.files(spark, d)).select("workspace_id", "id", "difficulty")
    df = L.topped_up(q.filter("difficulty = 'hard'"), q.filter("difficulty = 'easy'"), 300, ["workspace_id"], [F.col("id")])
    return df.select("workspace_id", "id", "source")
