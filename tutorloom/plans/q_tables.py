"""Queries on table maintenance, change detection, sources, sinks and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tutorloom.functions import text as T
from tutorloom.operators import documents as D
from tutorloom.operators import generation as GEN
from tutorloom.operators import topics as TP
from tutorloom.operators import vectors as V
from tutorloom.operators import maintain as MT
from tutorloom.plans import mapping as M
from tutorloom.plans.mapping import ntz, sql_with
from tutorloom.plans.q_documents import PREPARED_SQL, SP, sql_clean, sql_reason, sql_words
from tutorloom.plans.q_study import sql_stamp, stamp
from tutorloom.plans.q_topics import TABLE_SQL, topic_docs
from tutorloom.plans.registry import ORACLES, query
from tutorloom.session import shared_folder
from tutorloom.sources import corpus as C
from tutorloom.sources import sinks as SK
from tutorloom.streaming import activity as A

# --- keyed maintenance ------------------------------------------------------------------------------


@query("ups1_append", sql_with("files", "SELECT id, workspace_id, size FROM files UNION ALL SELECT id + 1000000, workspace_id, size FROM files"))
def _(spark, d):
    f = M.files(spark, d).select("id", "workspace_id", "size")
    return MT.append(f, f.withColumn("id", F.col("id") + 1000000))


@query("ups2_upsert", sql_with("topic_areas", """WITH n AS (SELECT topic_area_id, workspace_id, 1.0 AS coverage_score FROM topic_areas WHERE coverage_score > 0.8
        UNION ALL SELECT topic_area_id || '_new', workspace_id, 0.1 FROM topic_areas WHERE coverage_score < 0.5)
    SELECT topic_area_id, workspace_id, coverage_score FROM topic_areas WHERE topic_area_id NOT IN (SELECT topic_area_id FROM n) UNION ALL SELECT * FROM n"""))
def _(spark, d):
    t = M.topic_areas(spark, d).select("topic_area_id", "workspace_id", "coverage_score")
    new = t.filter("coverage_score > 0.8").withColumn("coverage_score", F.lit(1.0)).unionByName(
        t.filter("coverage_score < 0.5").withColumn("topic_area_id", F.concat("topic_area_id", F.lit("_new"))).withColumn("coverage_score", F.lit(0.1))
    )
    return MT.upsert(t, new, ["topic_area_id"])


@query("win7_latest_per_key", sql_with("progress", """SELECT user_id, action_type, id FROM progress QUALIFY row_number() OVER (PARTITION BY user_id, action_type ORDER BY timestamp DESC, id DESC) = 1"""))
def _(spark, d):
    return MT.latest_per_key(M.progress(spark, d), ["user_id", "action_type"], [F.desc("timestamp"), F.desc("id")]).select("user_id", "action_type", "id")


@query("set1_union_later_wins", sql_with("files questions0", """WITH u AS (SELECT id, 'file' AS kind, 0 AS rank FROM files UNION ALL SELECT id, 'question', 1 FROM questions0)
    SELECT id, kind FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank DESC) = 1"""))
def _(spark, d):
    f = M.files(spark, d).select("id", F.lit("file").alias("kind"), F.lit(0).alias("rank"))
    q = M.questions(spark, d).select("id", F.lit("question").alias("kind"), F.lit(1).alias("rank"))
    return MT.latest_per_key(MT.append(f, q), ["id"], [F.desc("rank")]).select("id", "kind")


@query("set2_jaccard", sql_with("question_concepts questions0", """WITH s AS (SELECT difficulty, question_type, list(DISTINCT concept_id) AS c FROM question_concepts JOIN questions0 ON id = question_id GROUP BY 1, 2)
    SELECT a.difficulty, a.question_type, b.question_type AS other_type, round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 6) AS jaccard FROM s a JOIN s b ON a.difficulty = b.difficulty AND a.question_type < b.question_type"""))
def _(spark, d):
    from tutorloom.functions.vectors import jaccard

    q = M.questions(spark, d).select(F.col("id").alias("question_id"), "difficulty", "question_type")
    s = M.question_concepts(spark, d).join(q, "question_id").groupBy("difficulty", "question_type").agg(F.collect_set("concept_id").alias("c"))
    b = s.select("difficulty", F.col("question_type").alias("other_type"), F.col("c").alias("other"))
    return s.join(b, "difficulty").filter("question_type < other_type").select("difficulty", "question_type", "other_type", F.round(jaccard(F.col("c"), F.col("other")), 6).alias("jaccard"))


@query("ups3_upsert_relationships", sql_with("topic_relationships", """WITH n AS (SELECT relationship_id || '_x' AS relationship_id, target_topic_id AS s, source_topic_id AS t, 'contains' AS k, 0.9 AS w, 'new' AS r FROM topic_relationships WHERE relationship_type = 'builds_on')
    SELECT o.relationship_id, o.source_topic_id, o.target_topic_id, coalesce(n.k, o.relationship_type) AS relationship_type, coalesce(n.w, o.strength) AS strength, coalesce(n.r, o.reasoning) AS reasoning
    FROM topic_relationships o LEFT JOIN n ON least(n.s, n.t) = least(o.source_topic_id, o.target_topic_id) AND greatest(n.s, n.t) = greatest(o.source_topic_id, o.target_topic_id)"""))
def _(spark, d):
    old = M.topic_relationships(spark, d)
    new = old.filter("relationship_type = 'builds_on'").select(
        F.concat("relationship_id", F.lit("_x")).alias("relationship_id"), F.col("target_topic_id").alias("source_topic_id"), F.col("source_topic_id").alias("target_topic_id"),
        F.lit("contains").alias("relationship_type"), F.lit(0.9).alias("strength"), F.lit("new").alias("reasoning"),
    )
    return MT.upsert_relationships(old, new)


@query("ups4_ups8_patch", sql_with("files", """SELECT f.id, f.workspace_id, coalesce(p.size, f.size) AS size, f.name, CASE WHEN p.id IS NULL THEN 'old' ELSE '2024-01-31' END AS updated
    FROM files f LEFT JOIN (SELECT id, CASE WHEN size % 2 = 0 THEN NULL ELSE size * 2 END AS size FROM files WHERE file_type = 'machinery') p USING (id)"""))
def _(spark, d):
    f = M.files(spark, d).select("id", "workspace_id", "size", "name", "file_type")
    change = f.filter("file_type = 'machinery'").select("id", F.when(F.col("size") % 2 != 0, F.col("size") * 2).alias("size"))
    out = MT.patch(f.drop("file_type"), change, ["id"], ntz("2024-01-31 00:00:00"))
    return out.select("id", "workspace_id", "size", "name", F.coalesce(F.date_format("updated_at", "yyyy-MM-dd"), F.lit("old")).alias("updated"))


@query("ups5_delete", sql_with("questions0", "SELECT id, difficulty FROM questions0 WHERE file_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"))
def _(spark, d):
    gone = M.table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("file_id"))
    return MT.delete(M.questions(spark, d), gone, ["file_id"]).select("id", "difficulty")


@query("join19_cascade_delete", sql_with("files questions0 answers", """WITH q AS (SELECT id FROM questions0 WHERE file_id IN (SELECT id FROM files WHERE workspace_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)))
    SELECT 'files' AS name, count(*) AS rows_left FROM files WHERE workspace_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0) UNION ALL SELECT 'questions', count(*) FROM q UNION ALL
    SELECT 'answers', count(*) FROM answers WHERE question_id IN (SELECT id FROM q)"""))
def _(spark, d):
    root = M.table(spark, d, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("id"))
    tables = {"files": M.files(spark, d), "questions": M.questions(spark, d), "answers": M.answers(spark, d)}
    left = MT.cascade_delete(tables, root, [("files", "workspace_id", "root", "id"), ("questions", "file_id", "files", "id"), ("answers", "question_id", "questions", "id")])
    parts = [df.agg(F.count("*").alias("rows_left")).select(F.lit(n).alias("name"), "rows_left") for n, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("join19_set_null", sql_with("topic_relationships topic_areas", """SELECT relationship_id, coalesce(CASE WHEN target_topic_id IN (SELECT topic_area_id FROM topic_areas WHERE coverage_score > 0.8) THEN NULL ELSE target_topic_id END, 'none') AS target_topic_id FROM topic_relationships"""))
def _(spark, d):
    gone = M.topic_areas(spark, d).filter("coverage_score > 0.8")
    out = MT.set_null_on_delete(M.topic_relationships(spark, d), "target_topic_id", gone, "topic_area_id")
    return out.select("relationship_id", F.coalesce("target_topic_id", F.lit("none")).alias("target_topic_id"))


@query("ups6_add_counters", sql_with("questions0 answers", f"""WITH o AS (SELECT question_id, count(*) a, count(*) FILTER (is_correct) c, max(created_at) l FROM answers GROUP BY 1)
    SELECT q.id, coalesce(a, 0) AS times_asked, coalesce(c, 0) AS times_correct, coalesce(strftime(l, '%Y-%m-%d %H:%M:%S'), '-') AS last_asked FROM questions0 q LEFT JOIN o ON o.question_id = q.id"""))
def _(spark, d):
    a, cut = M.answers(spark, d), ntz("1997-01-01 00:00:00")
    zero = M.questions(spark, d).select("id", F.lit(0).cast("long").alias("times_asked"), F.lit(0).cast("long").alias("times_correct"), F.lit(None).cast("timestamp_ntz").alias("last_asked"))
    out = MT.add_counters(MT.add_counters(zero, a.filter(F.col("created_at") < cut)), a.filter(F.col("created_at") >= cut))
    return out.select("id", "times_asked", "times_correct", F.coalesce(stamp("last_asked"), F.lit("-")).alias("last_asked"))


@query("ups7_session_lifecycle", sql_with("progress workspaces", """WITH e AS (SELECT CAST(user_id AS BIGINT) AS id, min(timestamp) FILTER (action_type = 'quiz_started') AS s, max(timestamp) FILTER (action_type = 'quiz_completed') AS c FROM progress GROUP BY 1)
    SELECT c_custkey AS id, CASE WHEN c IS NOT NULL THEN 'completed' WHEN s IS NOT NULL THEN 'in_progress' ELSE 'pending' END AS status FROM customer LEFT JOIN e ON e.id = c_custkey"""))
def _(spark, d):
    events = M.progress(spark, d).select(F.col("user_id").cast("long").alias("session_id"), "action_type", "timestamp")
    return MT.session_lifecycle(M.files(spark, d).select("id"), events).select("id", "status")


# --- change detection -------------------------------------------------------------------------------------

INDEX_SQL = """prev AS (SELECT source || '/' || doc_id AS path, md5(CASE WHEN lang = 'fr' THEN text || 'x' ELSE text END) AS hash FROM documents WHERE lang <> 'de'),
    cur AS (SELECT source || '/' || doc_id AS path, md5(text) AS hash FROM documents WHERE lang <> 'es'),
    changes AS (SELECT path, CASE WHEN p.hash IS NULL THEN 'new' WHEN c.hash IS NULL THEN 'deleted' WHEN p.hash <> c.hash THEN 'modified' ELSE 'unchanged' END AS change FROM cur c FULL JOIN prev p USING (path))"""


def _indexes(spark, d):
    docs = M.documents(spark, d).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text", "lang")
    old = docs.filter("lang <> 'de'").withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return MT.file_index(docs.filter("lang <> 'es'"), content="text"), MT.file_index(old, content="text"), docs


@query("join18_inc1_changes", f"WITH {INDEX_SQL} SELECT path, change FROM changes")
def _(spark, d):
    cur, prev, _ = _indexes(spark, d)
    return MT.changes(cur, prev)


@query("inc1_change_counts", f"""WITH {INDEX_SQL} SELECT count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted,
    count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change IN ('new', 'modified')) AS total_new_modified FROM changes""")
def _(spark, d):
    cur, prev, _ = _indexes(spark, d)
    return MT.change_counts(MT.changes(cur, prev))


@query("inc2_needs_reindex", f"WITH {INDEX_SQL} SELECT count(*) FILTER (change IN ('new', 'modified')) > 0 AS reindex FROM changes")
def _(spark, d):
    cur, prev, _ = _indexes(spark, d)
    return MT.needs_reindex(MT.changes(cur, prev))


@query("inc3_changed_documents", f"""WITH {INDEX_SQL}, c AS (SELECT source || '/' || doc_id AS path, {sql_clean()} AS text FROM documents)
    SELECT path, text FROM c WHERE path IN (SELECT path FROM changes WHERE change IN ('new', 'modified'))""")
def _(spark, d):
    cur, prev, docs = _indexes(spark, d)
    return MT.changed_rows(docs, MT.changes(cur, prev)).select("path", T.clean_text(F.col("text")).alias("text"))


@query("set3_new_paths", f"WITH {INDEX_SQL} SELECT path FROM cur EXCEPT SELECT path FROM prev")
def _(spark, d):
    cur, prev, _ = _indexes(spark, d)
    return cur.select("path").exceptAll(prev.select("path"))


@query("q7_violations", sql_with("answers questions0 files", """SELECT 'confidence' AS "constraint", count(*) FILTER (confidence_level NOT BETWEEN 1 AND 4) AS violations FROM answers UNION ALL
    SELECT 'time_taken', count(*) FILTER (time_taken < 0) FROM answers UNION ALL SELECT 'quality', count(*) FILTER (quality NOT BETWEEN 0 AND 4) FROM answers UNION ALL
    SELECT 'unique(question_id,created_at)', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) - 1 AS n FROM answers GROUP BY question_id, created_at) UNION ALL
    SELECT 'reference(question_id)', count(*) FROM answers WHERE question_id NOT IN (SELECT id FROM questions0 WHERE difficulty <> 'easy')"""))
def _(spark, d):
    return MT.violations(
        M.answers(spark, d),
        {"confidence": F.col("confidence_level").between(1, 4), "time_taken": F.col("time_taken") >= 0, "quality": F.col("quality").between(0, 4)},
        [["question_id", "created_at"]],
        {"question_id": (M.questions(spark, d).filter("difficulty <> 'easy'"), "id")},
    )


# --- sources and sinks --------------------------------------------------------------------------------------


def _written(spark, d, kind: str) -> str:
    """The documents written out by Spark as a folder tree, one subfolder per source."""
    base = f"{shared_folder(spark)}/tutorloom/{kind}-{uuid.uuid4().hex}"
    docs = M.documents(spark, d)
    rows = {
        "text": docs.select("source", "text"),
        "json": docs.select("source", F.col("doc_id").alias("n"), F.col("text").alias("content"), "lang"),
        "csv": docs.select("source", "doc_id", F.col("text").alias("body")),
    }[kind]
    writer = rows.repartition("source").write.partitionBy("source")
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(kind).save(base)
    return base


@query("src1_src2_corpus_scan", "SELECT 'source=' || source AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def _(spark, d):
    files = C.scan_folder(spark, _written(spark, d, "text"))
    return files.groupBy(T.directory(F.col("relative_path")).alias("folder")).agg(F.sum("length").alias("bytes"))


@query("src3_src4_text_tests", "SELECT doc_id, regexp_full_match(text, '[^\\x00-\\x06\\x0B\\x0E-\\x1A\\x1C-\\x1F\\x7F]*') AS plain, NOT contains(text, chr(0)) AS utf8 FROM documents")
def _(spark, d):
    content = F.col("text").cast("binary")
    return M.documents(spark, d).select("doc_id", C.is_plain_bytes(content).alias("plain"), C.is_utf8(content).alias("utf8"))


TRIM = f"regexp_replace(x, '^{SP}+|{SP}+$', '', 'g')"


def sql_pieces(separator: str) -> str:
    return f"list_filter(list_transform(string_split(text, {separator}), lambda x: {TRIM}), lambda x: x <> '')"


@query("src5_split_text", f"""WITH s AS (SELECT doc_id, {sql_pieces("chr(10) || chr(10)")} AS p, {sql_pieces("chr(10)")} AS l, regexp_replace(text, '^{SP}+|{SP}+$', '', 'g') AS w FROM documents),
    c AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN p WHEN len(l) > 1 THEN l WHEN w <> '' THEN [w] ELSE [] END AS ps FROM s)
    SELECT doc_id, unnest(range(0, len(ps))) AS part, unnest(ps) AS text FROM c""")
def _(spark, d):
    return M.documents(spark, d).select("doc_id", F.posexplode(C.split_text(F.col("text"))).alias("part", "text"))


@query("src6_csv_documents", "SELECT text FROM documents WHERE text <> ''")
def _(spark, d):
    return C.read_csv_documents(spark, _written(spark, d, "csv"))


@query("src7_first_fields", f"""SELECT doc_id, coalesce(nullif(regexp_replace(CASE WHEN lang = 'en' THEN ' ' ELSE lang END, '^{SP}+|{SP}+$', '', 'g'), ''), regexp_replace(source, '^{SP}+|{SP}+$', '', 'g')) AS text FROM documents""")
def _(spark, d):
    blank = F.when(F.col("lang") == "en", " ").otherwise(F.col("lang"))
    return M.documents(spark, d).select("doc_id", C.first_field([blank, F.col("source"), F.col("text")]).alias("text"))


@query("src8_json_documents", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS documents, text FROM documents")
def _(spark, d):
    lang = F.col("lang")
    one = F.to_json(F.struct(F.col("doc_id").alias("content"), F.col("text").alias("body")))
    content = (
        F.when(lang == "en", F.to_json(F.struct(F.array("text").alias("documents"))))
        .when(lang == "fr", F.concat(F.lit("["), one, F.lit(', "plain"]')))
        .otherwise(one)
    )
    docs = M.documents(spark, d).select("doc_id", C.json_documents(content).alias("found"))
    return docs.select("doc_id", F.size("found").alias("documents"), F.element_at("found", 1).alias("text"))


@query("src9_src10_loaded_documents", f"""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents), t AS (SELECT source, {TRIM} AS t FROM l)
    SELECT 'source=' || source AS folder, CAST(sum(length(t)) AS BIGINT) AS characters, CAST(sum(len({sql_words('t')})) AS BIGINT) AS words FROM t WHERE t <> '' GROUP BY 1""")
def _(spark, d):
    docs = C.load_documents(C.scan_folder(spark, _written(spark, d, "text")))
    # paragraphs keep their inner line breaks, so lines are compared after splitting them again
    lines = docs.select(T.directory(F.col("relative_path")).alias("folder"), F.explode(F.split("text", "\n")).alias("t")).withColumn("t", T.trim_space(F.col("t")))
    return lines.filter("t <> ''").groupBy("folder").agg(F.sum(F.length("t")).alias("characters"), F.sum(T.word_count(F.col("t"))).alias("words"))


@query("top6_largest_files", "SELECT source || '/' || doc_id AS relative_path, strlen(text) AS length FROM documents ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    files = M.documents(spark, d).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relative_path"), F.octet_length("text").alias("length"))
    return C.largest_files(files)


@query("snk4_flattened", """SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, repeat('=', 80) || chr(10) || 'FILE: ' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || chr(10) || repeat('=', 80) || chr(10) || chr(10) || text || chr(10) AS value FROM documents""")
def _(spark, d):
    files = M.documents(spark, d).select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("text").alias("content"))
    return SK.flattened(files)


@query("snk1_topic_output", sql_with("document_topics", f"WITH {TABLE_SQL} SELECT topic_id, name, count FROM named"))
def _(spark, d):
    docs = topic_docs(spark, d)
    folder = f"{shared_folder(spark)}/tutorloom/topics-{uuid.uuid4().hex}"
    SK.write_topics(TP.topic_table(docs, TP.topic_words(docs)), docs.select("doc_id", "topic_id"), folder)
    return spark.read.schema("topic_id int, name string, count long").json(f"{folder}/topics")


@query("snk2_prepared_corpus", f"WITH RECURSIVE {PREPARED_SQL} SELECT doc_id, source, cleaned AS text FROM passed ANTI JOIN removed USING (doc_id)")
def _(spark, d):
    folder = f"{shared_folder(spark)}/tutorloom/prepared-{uuid.uuid4().hex}"
    kept, stats = D.prepare(M.documents(spark, d))
    SK.write_corpus(kept, stats, T.CleaningConfig(), folder)
    return spark.read.parquet(f"{folder}/documents").select("doc_id", "source", "text")


@query("udf2_generated_questions", """SELECT doc_id, 1 AS position, 'About ' || length(text) || ' characters?' AS question, 'multiple_choice' AS type, 0.8 AS confidence FROM documents""")
def _(spark, d):
    empty = len("Write 5 varied quiz questions about the content below.\nAllowed question types: multiple choice, true/false, short answer\nContent:\n")
    tail = len('\nAnswer with a JSON array of objects with the keys "question", "type", "answer", "options", "explanation", "confidence".')

    @F.pandas_udf("string")
    def stub(prompt: pd.Series) -> pd.Series:
        return prompt.map(lambda p: f'[{{"question": "About {len(p) - empty - tail} characters?", "answer": "yes"}}]')

    return GEN.generate_questions(M.documents(spark, d), stub).select("doc_id", "position", "question", "type", "confidence")


@query("sea2_semantic_search", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS qe FROM v ORDER BY id LIMIT 1)
    SELECT id, round(list_cosine_similarity(e, qe), 6) AS similarity FROM v, q WHERE list_cosine_similarity(e, qe) >= 0.0 ORDER BY list_cosine_similarity(e, qe) DESC, id LIMIT 10""")
def _(spark, d):
    v = M.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    probe = list(v.orderBy("id").first()["embedding"])
    return V.search(v, probe, 10).select("id", F.round("similarity", 6).alias("similarity"))


# --- streams --------------------------------------------------------------------------------------------------


def _progress_stream(spark, d):
    events = A.stream_table(spark, d, "events")
    kind = F.col("event_type")
    action = F.when(kind == "click", "question_answered").when(kind == "purchase", "quiz_completed").otherwise(kind)
    return events.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("workspace_id"), F.col("user_id").cast("string").alias("user_id"),
        action.alias("action_type"), F.col("ts").cast("timestamp").alias("timestamp"), "value",
    )


EVENTS_SQL = """e AS (SELECT event_id AS id, user_id % 25 AS workspace_id, CAST(user_id AS VARCHAR) AS user_id,
    CASE event_type WHEN 'click' THEN 'question_answered' WHEN 'purchase' THEN 'quiz_completed' ELSE event_type END AS action_type, ts, value FROM events)"""


@query("str1_activity_windows", f"""WITH {EVENTS_SQL}, w AS (SELECT date_trunc('day', ts) AS s, * FROM e)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, workspace_id, action_type, count(*) AS events, round(sum(value), 6) AS value FROM w
    WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM e) GROUP BY 1, 2, 3""")
def _(spark, d):
    out = A.run_to_end(A.activity_windows(_progress_stream(spark, d)))
    return out.select(stamp("window_start"), "workspace_id", "action_type", "events", F.round("value", 6).alias("value"))


@query("str1_sliding_windows", f"""WITH {EVENTS_SQL}, w AS (SELECT date_trunc('day', ts) + to_hours(12 * CAST(k AS INT)) AS s, e.* FROM e, range(-1, 2) t(k)
        WHERE ts >= date_trunc('day', ts) + to_hours(12 * CAST(k AS INT)) AND ts < date_trunc('day', ts) + to_hours(12 * CAST(k AS INT) + 24))
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, workspace_id, action_type, count(*) AS events FROM w
    WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM e) GROUP BY 1, 2, 3""")
def _(spark, d):
    out = A.run_to_end(A.activity_windows(_progress_stream(spark, d), slide="12 hours"))
    return out.select(stamp("window_start"), "workspace_id", "action_type", "events")


@query("str2_study_sessions", f"""WITH {EVENTS_SQL}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events, count(*) FILTER (action_type = 'question_answered') AS answered FROM s GROUP BY user_id, n
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 2 HOUR FROM e)""")
def _(spark, d):
    out = A.run_to_end(A.study_sessions(_progress_stream(spark, d)))
    return out.select("user_id", stamp("session_start"), "events", "answered")


def _answer_stream(spark, d):
    li = A.stream_table(spark, d, "lineitem")
    return li.select(
        ((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("question_id"),
        (F.col("l_returnflag") != "R").alias("is_correct"), (F.round(F.col("l_discount") * 100).cast("int") % 6).alias("quality"), F.col("l_shipdate").alias("created_at"),
    )


@query("str3_live_schedules", ORACLES["sm2_3_replay"])
def _(spark, d):
    out = A.latest_schedules(A.run_to_end(A.live_schedules(_answer_stream(spark, d)), "update"))
    return out.withColumn("next_review", stamp("next_review"))


@query("str4_live_counters", sql_with("answers", f"SELECT question_id, count(*) AS times_asked, count(*) FILTER (is_correct) AS times_correct, {sql_stamp('max(created_at)', 'last_asked')} FROM answers GROUP BY 1"))
def _(spark, d):
    out = A.total_counters(A.run_to_end(_answer_stream(spark, d), each=A.counter_increments))
    return out.select("question_id", "times_asked", "times_correct", stamp("last_asked"))


@query("str5_ingested_documents", f"""WITH c AS (SELECT {sql_clean()} AS text FROM documents), w AS (SELECT text, {sql_words('text')} AS ws FROM c)
    SELECT DISTINCT md5(text) AS hash, text FROM w WHERE {sql_reason()} = 'quality'""")
def _(spark, d):
    docs = A.stream_table(spark, d, "documents").withColumn("ingested_at", F.col("_metadata.file_modification_time"))
    return A.run_to_end(A.ingest_documents(docs)).select("hash", "text")


@query("str6_enriched_progress", f"WITH {EVENTS_SQL} SELECT id, workspace_id, action_type, n_name AS workspace_name FROM e LEFT JOIN nation ON n_nationkey = workspace_id")
def _(spark, d):
    return A.run_to_end(A.enriched_progress(_progress_stream(spark, d), M.workspaces(spark, d))).select("id", "workspace_id", "action_type", "workspace_name")
