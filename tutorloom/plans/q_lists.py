"""Ordered lists, pages of tables, and the totals that accompany other reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorloom.operators import documents as D
from tutorloom.operators import graph as G
from tutorloom.operators import learning as L
from tutorloom.operators import lookups as K
from tutorloom.operators import maintain as MT
from tutorloom.operators import reports as R
from tutorloom.plans import mapping as M
from tutorloom.plans.mapping import AS_OF_EVENTS, AS_OF_REVIEWS, ntz, sql_with
from tutorloom.plans.q_documents import URL_PATH_SQL, _page_paths
from tutorloom.plans.q_study import sql_stamp, stamp
from tutorloom.plans.q_topics import graph, graph_sql
from tutorloom.plans.registry import query


@query("src11_table_page", sql_with("files", "SELECT id, workspace_id, name FROM files ORDER BY workspace_id, id LIMIT 100 OFFSET 50"))
def _(spark, d):
    return M.files(spark, d).select("id", "workspace_id", "name").orderBy("workspace_id", "id").offset(50).limit(100)


@query("flt12_paths_by_hours", sql_with("topic_areas", """SELECT workspace_id, topic_area_id, concept_count * 3 AS estimated_hours,
    row_number() OVER (PARTITION BY workspace_id ORDER BY concept_count * 3, topic_area_id) AS position FROM topic_areas WHERE coverage_score > 0.5 QUALIFY position <= 10"""))
def _(spark, d):
    paths = M.topic_areas(spark, d).filter("coverage_score > 0.5").select("workspace_id", "topic_area_id", (F.col("concept_count") * 3).alias("estimated_hours"))
    return K.top_n(paths, 10, [F.col("estimated_hours"), F.col("topic_area_id")], ["workspace_id"])


@query("flt13_newest_of_user", sql_with("progress", f"""SELECT user_id, id, {sql_stamp('timestamp')}, row_number() OVER (PARTITION BY user_id ORDER BY progress.timestamp DESC, id DESC) AS position
    FROM progress WHERE action_type = 'quiz_completed' QUALIFY position <= 5"""))
def _(spark, d):
    done = M.progress(spark, d).filter(F.col("action_type") == "quiz_completed")
    return K.newest(done, 5, "timestamp", "id", ["user_id"]).select("user_id", "id", stamp("timestamp"), "position")


@query("join4_due_list", sql_with("questions0 schedules", f"""SELECT q.id, q.difficulty, s.kg_concept_id, {sql_stamp('s.next_review')} FROM questions0 q JOIN schedules s ON q.id = s.question_id
    WHERE s.next_review <= TIMESTAMP '{AS_OF_REVIEWS}' ORDER BY s.next_review, q.id LIMIT 50"""))
def _(spark, d):
    due = L.due_questions(M.questions(spark, d), M.schedules(spark, d), ntz(AS_OF_REVIEWS))
    return K.top_n(due, 50, [F.col("next_review"), F.col("id")]).select("id", "difficulty", "kg_concept_id", stamp("next_review"))


@query("top6_top_file_types", sql_with("files", "SELECT file_type, count(*) AS files FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"))
def _(spark, d):
    return K.top_n(M.files(spark, d).groupBy("file_type").agg(F.count("*").alias("files")), 3, [F.desc("files"), F.col("file_type")])


@query("top6_top_topics", sql_with("topic_areas", "SELECT topic_area_id, coverage_score FROM topic_areas ORDER BY coverage_score DESC, topic_area_id LIMIT 10"))
def _(spark, d):
    return K.top_n(M.topic_areas(spark, d).select("topic_area_id", "coverage_score"), 10, [F.desc("coverage_score"), F.col("topic_area_id")])


def _period(name: str, days: int) -> None:
    sql = f"""SELECT coalesce(strftime(day, '%Y-%m-%d'), '-') AS day, coalesce(workspace_id, -1) AS workspace_id,
        count(*) FILTER (action_type = 'quiz_started') AS sessions, count(*) FILTER (action_type = 'question_answered') AS questions, round(avg(value), 6) AS average_score
        FROM (SELECT *, CAST(timestamp AS DATE) AS day FROM progress WHERE timestamp >= TIMESTAMP '{AS_OF_EVENTS}' - to_days({days})) GROUP BY GROUPING SETS ((day), (workspace_id), ())"""

    @query(name, sql_with("progress", sql))
    def _(spark, d):
        report = R.period_report(M.progress(spark, d), ntz(AS_OF_EVENTS), days)
        day, workspace = F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("-")), F.coalesce("workspace_id", F.lit(-1))
        return report.select(day.alias("day"), workspace.alias("workspace_id"), "sessions", "questions", F.round("average_score", 6).alias("average_score"))


_period("agg36_week_report", 7)
_period("agg36_month_report", 30)


@query("agg19_text_totals", f"""SELECT extension NOT IN ('.com', '.org') AS is_text, count(*) AS files, count(DISTINCT extension) AS extensions
    FROM (SELECT lower(regexp_extract({URL_PATH_SQL}, '[^/.][^/]*?(\\.[^./]+)$', 1)) AS extension FROM pages) GROUP BY 1""")
def _(spark, d):
    report = D.extension_report(_page_paths(spark, d), [".com", ".org"])
    return report.groupBy("is_text").agg(F.sum("files").alias("files"), F.count("*").alias("extensions"))


@query("agg19_names_by_extension", f"""SELECT lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]+)$', 1)) AS extension, string_split(path, '/')[-1] AS name
    FROM (SELECT {URL_PATH_SQL} AS path FROM pages)""")
def _(spark, d):
    return D.names_by_extension(_page_paths(spark, d))


@query("ups7_session_totals", sql_with("answers", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN coalesce(t.n, 0) ELSE 0 END AS total_questions,
    CASE WHEN o_orderstatus = 'F' THEN coalesce(t.c, 0) ELSE 0 END AS correct_answers, CASE WHEN o_orderstatus = 'F' THEN coalesce(t.s, 0) ELSE 0 END AS total_time
    FROM orders LEFT JOIN (SELECT question_id, count(*) AS n, count(*) FILTER (is_correct) AS c, CAST(sum(time_taken) AS BIGINT) AS s FROM answers GROUP BY 1) t ON o_orderkey = t.question_id"""))
def _(spark, d):
    sessions = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"))
    return MT.completed_totals(sessions, M.answers(spark, d).withColumnRenamed("question_id", "session_id")).drop("status")


@query("ups9_patch_topics", sql_with("topic_areas", """SELECT topic_area_id, CASE WHEN explored_percentage > 0.6 THEN 1.0 ELSE coverage_score END AS coverage_score,
    CASE WHEN explored_percentage > 0.6 THEN upper(name) ELSE name END AS name FROM topic_areas"""))
def _(spark, d):
    areas = M.topic_areas(spark, d)
    changes = areas.filter("explored_percentage > 0.6").select("topic_area_id", F.lit(1.0).alias("coverage_score"), F.upper("name").alias("name"))
    return MT.patch(areas.select("topic_area_id", "coverage_score", "name"), changes, ["topic_area_id"])


@query("snk3_graph_nodes", graph_sql("SELECT id, type, name FROM nodes"))
def _(spark, d):
    return graph(spark, d)[3].select("id", "type", "name")


@query("join14_breadcrumb", graph_sql("SELECT id, name, type FROM nodes WHERE type = 'topic'"))
def _(spark, d):
    return G.breadcrumb(graph(spark, d)[3])
