"""The logical study tables, read from the star-schema test tables.

Each function returns a lazy DataFrame; ``CTES`` states the same mapping in SQL so a query and its
oracle start from one definition. Timestamps stay zone-less as stored, so filters on them reach
the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorloom.session import spread

AS_OF_ANSWERS = "2001-12-01 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"
AS_OF_REVIEWS = "1998-06-01 00:00:00"


def ntz(text: str):
    """A zone-less timestamp constant."""
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def workspaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description"),
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").cast("long").alias("workspace_id"),
        F.col("c_name").alias("name"),
        F.col("c_name").alias("path"),
        F.floor(F.abs("c_acctbal")).alias("size"),
        F.lower("c_mktsegment").alias("file_type"),
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        (
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
        ).alias("id"),
        F.col("l_orderkey").alias("question_id"),
        (F.col("l_returnflag") != "R").alias("is_correct"),
        F.col("l_quantity").cast("int").alias("time_taken"),
        (1 + F.col("l_linenumber") % 5).alias("confidence_level"),
        (F.round(F.col("l_discount") * 100).cast("int") % 6).alias("quality"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_partkey").alias("part_id"),
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions without the answer counters (see ``questions_with_counters``)."""
    priority = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("file_id"),
        F.when(F.col("o_orderstatus") == "F", "multiple_choice")
        .when(F.col("o_orderstatus") == "O", "true_false")
        .otherwise("short_answer")
        .alias("question_type"),
        F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("question_text"),
        F.when(priority == "5-LOW", "easy")
        .when(priority.isin("1-URGENT", "2-HIGH"), "hard")
        .otherwise("medium")
        .alias("difficulty"),
        F.col("o_orderdate").alias("created_at"),
    )


def question_counters(spark: SparkSession, d: str) -> DataFrame:
    return (
        answers(spark, d)
        .groupBy("question_id")
        .agg(
            F.count("*").alias("times_asked"),
            F.count_if("is_correct").alias("times_correct"),
            F.max("created_at").alias("last_asked"),
        )
    )


def questions_with_counters(spark: SparkSession, d: str) -> DataFrame:
    c = question_counters(spark, d)
    q = questions(spark, d)
    return q.join(c, q["id"] == c["question_id"], "left").select(
        *q.columns,
        F.coalesce("times_asked", F.lit(0)).alias("times_asked"),
        F.coalesce("times_correct", F.lit(0)).alias("times_correct"),
        "last_asked",
    )


def question_concepts(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, concept_id): a question is linked to the concepts its answers touched."""
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("concept_id")
    )
    return (
        answers(spark, d)
        .select("question_id", "part_id")
        .distinct()
        .join(part, "part_id")
        .select("question_id", "concept_id")
        .distinct()
    )


def quiz_sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    f = files(spark, d).select(F.col("id").alias("file_id"), "workspace_id")
    totals = (
        answers(spark, d)
        .groupBy("question_id")
        .agg(
            F.count("*").alias("total_questions"),
            F.count_if("is_correct").alias("correct_answers"),
            F.sum("time_taken").alias("total_time"),
        )
    )
    return (
        o.join(f, o["o_custkey"] == f["file_id"])
        .join(totals, o["o_orderkey"] == totals["question_id"], "left")
        .select(
            F.col("o_orderkey").alias("id"),
            "workspace_id",
            "file_id",
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "in_progress")
            .otherwise("paused")
            .alias("status"),
            F.col("o_orderdate").alias("created_at"),
            F.coalesce("total_questions", F.lit(0)).alias("total_questions"),
            F.coalesce("correct_answers", F.lit(0)).alias("correct_answers"),
            F.coalesce("total_time", F.lit(0)).alias("total_time"),
        )
    )


def session_questions(spark: SparkSession, d: str) -> DataFrame:
    """One session per file holding that file's questions."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("session_id"),
        F.col("o_orderkey").alias("question_id"),
        F.col("o_orderkey").alias("question_order"),
        F.col("o_orderpriority").alias("user_answer"),
        (F.col("o_orderstatus") == "F").alias("is_correct"),
        (F.floor("o_totalprice") % 120).alias("time_taken"),
        F.col("o_orderdate").alias("answered_at"),
    )


def schedules(spark: SparkSession, d: str) -> DataFrame:
    """Stored spaced-repetition state, one row per question."""
    k = F.col("o_orderkey")
    interval = (1 + k % 30).cast("int")
    return table(spark, d, "orders").select(
        k.alias("question_id"),
        ((13 + k % 18) / F.lit(10.0)).alias("ease_factor"),
        interval.alias("interval_days"),
        (k % 5).cast("int").alias("review_count"),
        (F.col("o_orderdate") + F.make_dt_interval(interval)).alias("next_review"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")).alias("kg_concept_id"),
    )


def progress(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 25).alias("workspace_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(kind == "signup", "quiz_started")
        .when(kind == "purchase", "quiz_completed")
        .when(kind == "view", "file_viewed")
        .when(kind == "click", "question_answered")
        .otherwise("quiz_failed")
        .alias("action_type"),
        F.col("ts").alias("timestamp"),
        "value",
        F.col("props").alias("metadata"),
    )


def topic_areas(spark: SparkSession, d: str) -> DataFrame:
    """Topic areas per workspace: file type x question priority, scored from the questions."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    f = files(spark, d).select(F.col("id").alias("o_custkey"), "workspace_id", "file_type")
    return (
        o.join(f, "o_custkey")
        .groupBy("workspace_id", "file_type", "o_orderpriority")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("o_orderstatus") == "F").alias("done"),
            F.countDistinct("o_custkey").alias("file_count"),
        )
        .select(
            F.concat_ws("_", F.lit("topic"), "workspace_id", "file_type", F.substring("o_orderpriority", 1, 1)).alias("topic_area_id"),
            "workspace_id",
            F.concat_ws(" ", "file_type", "o_orderpriority").alias("name"),
            F.concat(F.lit("Questions on "), F.col("file_type"), F.lit(" files")).alias("description"),
            F.least(F.lit(1.0), F.round(F.col("n") / 30.0, 4)).alias("coverage_score"),
            F.round(F.col("done") / F.col("n"), 4).alias("explored_percentage"),
            F.col("n").alias("concept_count"),
            "file_count",
            "file_type",
            F.substring("o_orderpriority", 1, 1).cast("int").alias("rank_no"),
        )
    )


def topic_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Each topic area is linked to the next priority of the same file type."""
    a = topic_areas(spark, d).select(
        "workspace_id", "file_type", "rank_no", F.col("topic_area_id").alias("source_topic_id"), F.col("explored_percentage").alias("e1")
    )
    b = topic_areas(spark, d).select(
        "workspace_id", "file_type", (F.col("rank_no") - 1).alias("rank_no"), F.col("topic_area_id").alias("target_topic_id"), F.col("explored_percentage").alias("e2")
    )
    return a.join(b, ["workspace_id", "file_type", "rank_no"]).select(
        F.concat_ws("->", "source_topic_id", "target_topic_id").alias("relationship_id"),
        "source_topic_id",
        "target_topic_id",
        F.when(F.col("e1") > F.col("e2"), "builds_on").otherwise("relates_to").alias("relationship_type"),
        F.round((F.col("e1") + F.col("e2")) / 2, 6).alias("strength"),
        F.lit("adjacent priority").alias("reasoning"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages"))


def document_topics(spark: SparkSession, d: str) -> DataFrame:
    """Given document -> topic assignments: the number in ``source``; short texts are outliers (-1)."""
    return documents(spark, d).select(
        "doc_id",
        F.when(F.col("n_chars") < 100, F.lit(-1))
        .otherwise(F.regexp_extract("source", r"(\d+)", 1).cast("int"))
        .alias("topic_id"),
        "text",
        "source",
    )


CTES: dict[str, str] = {
    "workspaces": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'region ' || n_regionkey AS description FROM nation",
    "files": """SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS workspace_id, c_name AS name, c_name AS path,
        CAST(floor(abs(c_acctbal)) AS BIGINT) AS size, lower(c_mktsegment) AS file_type FROM customer""",
    "answers": """SELECT (l_partkey*100000+l_suppkey)*10+l_linenumber AS id, l_orderkey AS question_id,
        l_returnflag <> 'R' AS is_correct, CAST(l_quantity AS INT) AS time_taken, 1 + l_linenumber % 5 AS confidence_level,
        CAST(round(l_discount*100) AS INT) % 6 AS quality, l_shipdate AS created_at, l_partkey AS part_id FROM lineitem""",
    "questions0": """SELECT o_orderkey AS id, o_custkey AS file_id,
        CASE o_orderstatus WHEN 'F' THEN 'multiple_choice' WHEN 'O' THEN 'true_false' ELSE 'short_answer' END AS question_type,
        'Q' || o_orderkey AS question_text,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'easy' WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'hard' ELSE 'medium' END AS difficulty,
        o_orderdate AS created_at FROM orders""",
    "counters": """SELECT question_id, count(*) AS times_asked, count(*) FILTER (is_correct) AS times_correct,
        max(created_at) AS last_asked FROM answers GROUP BY question_id""",
    "questions": """SELECT q.*, coalesce(c.times_asked, 0) AS times_asked, coalesce(c.times_correct, 0) AS times_correct, c.last_asked
        FROM questions0 q LEFT JOIN counters c ON q.id = c.question_id""",
    "question_concepts": """SELECT DISTINCT a.question_id, p.p_brand AS concept_id FROM answers a JOIN part p ON a.part_id = p.p_partkey""",
    "quiz_sessions": """SELECT o.o_orderkey AS id, f.workspace_id, f.id AS file_id,
        CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'paused' END AS status,
        o.o_orderdate AS created_at, coalesce(t.n, 0) AS total_questions, coalesce(t.c, 0) AS correct_answers,
        coalesce(t.s, 0) AS total_time
        FROM orders o JOIN files f ON o.o_custkey = f.id LEFT JOIN
        (SELECT question_id, count(*) n, count(*) FILTER (is_correct) c, CAST(sum(time_taken) AS BIGINT) s FROM answers GROUP BY 1) t
        ON o.o_orderkey = t.question_id""",
    "session_questions": """SELECT o_custkey AS session_id, o_orderkey AS question_id, o_orderkey AS question_order,
        o_orderpriority AS user_answer, o_orderstatus = 'F' AS is_correct,
        CAST(floor(o_totalprice) AS BIGINT) % 120 AS time_taken, o_orderdate AS answered_at FROM orders""",
    "schedules": """SELECT o_orderkey AS question_id, (13 + o_orderkey % 18) / 10.0 AS ease_factor,
        CAST(1 + o_orderkey % 30 AS INT) AS interval_days, CAST(o_orderkey % 5 AS INT) AS review_count,
        o_orderdate + to_days(CAST(1 + o_orderkey % 30 AS INT)) AS next_review, 'c' || (o_custkey % 25) AS kg_concept_id FROM orders""",
    "progress": """SELECT event_id AS id, user_id % 25 AS workspace_id, CAST(user_id AS VARCHAR) AS user_id,
        CASE event_type WHEN 'signup' THEN 'quiz_started' WHEN 'purchase' THEN 'quiz_completed' WHEN 'view' THEN 'file_viewed'
        WHEN 'click' THEN 'question_answered' ELSE 'quiz_failed' END AS action_type, ts AS timestamp, value, props AS metadata FROM events""",
    "topic_areas": """SELECT 'topic_' || workspace_id || '_' || file_type || '_' || substr(o_orderpriority, 1, 1) AS topic_area_id,
        workspace_id, file_type || ' ' || o_orderpriority AS name, 'Questions on ' || file_type || ' files' AS description,
        least(1.0, round(count(*) / 30.0, 4)) AS coverage_score,
        round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS explored_percentage, count(*) AS concept_count,
        count(DISTINCT o_custkey) AS file_count, file_type, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank_no
        FROM orders JOIN files ON o_custkey = files.id GROUP BY workspace_id, file_type, o_orderpriority""",
    "topic_relationships": """SELECT a.topic_area_id || '->' || b.topic_area_id AS relationship_id, a.topic_area_id AS source_topic_id,
        b.topic_area_id AS target_topic_id,
        CASE WHEN a.explored_percentage > b.explored_percentage THEN 'builds_on' ELSE 'relates_to' END AS relationship_type,
        round((a.explored_percentage + b.explored_percentage) / 2, 6) AS strength, 'adjacent priority' AS reasoning
        FROM topic_areas a JOIN topic_areas b USING (workspace_id, file_type) WHERE a.rank_no + 1 = b.rank_no""",
    "document_topics": r"""SELECT doc_id, CASE WHEN n_chars < 100 THEN -1 ELSE CAST(regexp_extract(source, '(\d+)', 1) AS INT) END AS topic_id,
        text, source FROM documents""",
}

_NEEDS = {
    "counters": ["answers"],
    "questions": ["questions0", "counters"],
    "question_concepts": ["answers"],
    "quiz_sessions": ["files", "answers"],
    "topic_areas": ["files"],
    "topic_relationships": ["topic_areas"],
}


def sql_with(tables: str, body: str) -> str:
    """``body`` preceded by the CTEs of the named tables (space separated) and what they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in tables.split():
        visit(name)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
