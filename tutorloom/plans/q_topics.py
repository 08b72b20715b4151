"""Queries on topics, vectors and the knowledge graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tutorloom.functions import text as T
from tutorloom.functions import vectors as VF
from tutorloom.operators import graph as G
from tutorloom.operators import topics as TP
from tutorloom.operators import vectors as V
from tutorloom.plans import mapping as M
from tutorloom.plans.mapping import AS_OF_EVENTS, ntz, sql_with
from tutorloom.plans.q_documents import SP, sql_terms, sql_words
from tutorloom.plans.q_study import rounded
from tutorloom.plans.registry import query
from tutorloom.session import shared_folder, write_step

# --- vectors --------------------------------------------------------------------------------------


def vectors(spark, d):
    return M.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("topic_id"))


VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT arg_min(id, id) AS query_id, arg_min(e, id) AS qe FROM v GROUP BY label)"


@query("join8_vector_top_k", f"""WITH {VEC} SELECT query_id, id, round(list_cosine_similarity(e, qe), 6) AS similarity FROM v, q
    WHERE list_cosine_similarity(e, qe) >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e, qe), 9) DESC, id) <= 5""")
def _(spark, d):
    v = vectors(spark, d)
    queries = v.groupBy("topic_id").agg(F.min("id").alias("id")).join(v.drop("topic_id"), "id")
    return V.top_k(v, queries, 5, 0.05).select("query_id", "id", *rounded("similarity"))


@query("join9_cosine", f"""WITH {VEC} SELECT id, round(list_cosine_similarity(e, qe), 6) AS similarity FROM v JOIN (SELECT label, arg_min(e, id) AS qe FROM v GROUP BY 1) USING (label)""")
def _(spark, d):
    v = vectors(spark, d)
    first = v.groupBy("topic_id").agg(F.min_by("embedding", "id").alias("first"))
    return v.join(first, "topic_id").select("id", F.round(VF.cosine(F.col("embedding"), F.col("first")), 6).alias("similarity"))


LEAD_T = 0.3
LEADERS_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    nb AS (SELECT b.id, list(a.id) FILTER (list_cosine_similarity(a.e, b.e) > {LEAD_T}) AS earlier FROM v b LEFT JOIN v a ON a.id < b.id GROUP BY 1),
    r AS (SELECT id, coalesce(earlier, []) AS earlier, row_number() OVER (ORDER BY id) AS rn FROM nb),
    walk(rn, leaders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
        SELECT r.rn, CASE WHEN list_has_any(r.earlier, leaders) THEN leaders ELSE list_append(leaders, r.id) END FROM walk JOIN r ON r.rn = walk.rn + 1),
    lead AS (SELECT unnest(leaders) AS id FROM walk WHERE rn = (SELECT max(rn) FROM walk)),
    best AS (SELECT v.id, l.id AS cluster FROM v JOIN v l ON l.id IN (SELECT id FROM lead) WHERE list_cosine_similarity(v.e, l.e) > {LEAD_T}
        QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY round(list_cosine_similarity(v.e, l.e), 12) DESC, l.id) = 1)"""


@query("topic2_leaders", f"{LEADERS_SQL} SELECT id FROM lead")
def _(spark, d):
    return V.leaders(vectors(spark, d), LEAD_T, [F.col("id")])


@query("topic2_threshold_clusters", f"""{LEADERS_SQL} SELECT id, cluster FROM best WHERE cluster IN (SELECT cluster FROM best GROUP BY 1 HAVING count(*) >= 3)""")
def _(spark, d):
    return TP.threshold_clusters(vectors(spark, d), LEAD_T, 3, [F.col("id")]).select("id", "cluster")


@query("topic3_merge_clusters")
def _(spark, d):
    v = write_step(vectors(spark, d), "vectors")
    return TP.merge_clusters(v, write_step(TP.threshold_clusters(v, LEAD_T, 3, [F.col("id")]), "clusters"), 8)


DENSITY_SQL = """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 12) AS s FROM v a JOIN v b ON list_cosine_similarity(a.e, b.e) >= 0.25),
    core AS MATERIALIZED (SELECT a AS id FROM p WHERE s >= 0.3 GROUP BY 1 HAVING count(*) >= 5),
    link AS MATERIALIZED (SELECT a, b FROM p WHERE s >= 0.3 AND a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach(id, other) AS (SELECT id, id FROM core UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other),
    grp AS (SELECT id, min(other) AS component FROM reach GROUP BY 1),
    border AS (SELECT a AS id, b AS core FROM p WHERE a NOT IN (SELECT id FROM core) AND b IN (SELECT id FROM core) QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) = 1),
    member AS (SELECT id, component FROM grp UNION ALL SELECT border.id, component FROM border JOIN grp ON grp.id = border.core),
    kept AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS topic_id FROM member GROUP BY 1 HAVING count(*) >= 5)
    SELECT v.id, CAST(coalesce(topic_id, -1) AS INT) AS topic_id FROM v LEFT JOIN member USING (id) LEFT JOIN kept USING (component)"""


@query("topic4_density_clusters", DENSITY_SQL)
def _(spark, d):
    return TP.density_clusters(vectors(spark, d), 0.3, 0.25, 5)


@query("sea2_text_search")
def _(spark, d):
    """The opening words of every 50th document as queries by text; the model is fitted once, stored, and loaded for both sides."""
    docs = M.documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    path = f"{shared_folder(spark)}/tutorloom/model-{uuid.uuid4().hex}"
    TP.fit_embedding(docs, path, dims=16, features=256)
    embedder = TP.load_embedding(path)
    corpus = write_step(embedder(docs).select("id", "embedding"), "corpus")
    queries = docs.filter(F.col("id") % 50 == 0).select("id", T.array_join_words(F.col("text"), 12).alias("text"))
    return TP.search_texts(queries, corpus, embedder, 5).withColumn("similarity", F.round("similarity", 6))


@query("topic1_text_embedding")
def _(spark, d):
    return TP.tfidf_embedding(M.documents(spark, d).select("doc_id", "text"), dims=16, features=256).select("doc_id", F.size("embedding").alias("dimensions"))


CENTROID_SQL = """u AS (SELECT vec_id AS id, label AS topic_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM embeddings),
    parts AS (SELECT topic_id, i, avg(e[i]) AS x FROM (SELECT topic_id, e, unnest(range(1, len(e) + 1)) AS i FROM u) GROUP BY 1, 2),
    centers AS (SELECT topic_id, list(x ORDER BY i) AS c FROM parts GROUP BY 1)"""


@query("topic7_assignments", f"""WITH {CENTROID_SQL}, s AS (SELECT u.id, u.topic_id, centers.topic_id AS t, greatest(0, list_cosine_similarity(e, c)) AS sim FROM u, centers)
    SELECT id, topic_id, round(coalesce(sum(sim) FILTER (t = topic_id) / nullif(sum(sim), 0), 0.5), 6) AS probability FROM s GROUP BY 1, 2""")
def _(spark, d):
    v = vectors(spark, d)
    return TP.assignments(v, TP.centroids(v)).withColumn("probability", F.round("probability", 6))


@query("topic13_topic_key", "SELECT doc_id, substr(sha256(source || ':' || lower(trim(text))), 1, 32) AS topic_key FROM documents")
def _(spark, d):
    return M.documents(spark, d).select("doc_id", TP.topic_key(F.col("source"), F.col("text")).alias("topic_key"))


@query("topic14_vector_collection", """WITH n AS (SELECT vec_id + 250 AS vec_id, label FROM embeddings),
    c AS (SELECT vec_id, 'base' AS model, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT vec_id, 'base', label FROM n)
    SELECT model, count(*) AS vectors, 64 AS dimensions FROM c GROUP BY 1""")
def _(spark, d):
    base = M.table(spark, d, "embeddings").select("vec_id", F.lit("base").alias("model"), "embedding")
    return TP.collection_stats(TP.upsert_vectors(base, base.withColumn("vec_id", F.col("vec_id") + 250), "vec_id"))


# --- topic words and tables -------------------------------------------------------------------------


def topic_docs(spark, d):
    return M.spread(M.document_topics(spark, d))


WORDS_SQL = f"""kept AS (SELECT topic_id, doc_id, text FROM document_topics WHERE topic_id >= 0), {sql_terms('kept', 'topic_id', 'text')},
    tf AS (SELECT topic_id, term, count(*) AS tf FROM terms GROUP BY 1, 2), nt AS (SELECT count(DISTINCT topic_id) AS n FROM kept),
    tm AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1 HAVING count(*) <= 0.95 * (SELECT n FROM nt)),
    used AS (SELECT * FROM tf JOIN tm USING (term)), per AS (SELECT topic_id, sum(tf) AS total FROM used GROUP BY 1),
    av AS (SELECT sum(tf) // (SELECT n FROM nt) AS a FROM used),
    words AS (SELECT topic_id, term, round(tf / total * ln(1 + (SELECT a FROM av) / f), 9) AS score,
        row_number() OVER (PARTITION BY topic_id ORDER BY round(tf / total * ln(1 + (SELECT a FROM av) / f), 9) DESC, term) AS position
        FROM used JOIN per USING (topic_id) QUALIFY position <= 10)"""
TABLE_SQL = f"""{WORDS_SQL},
    reps AS (SELECT topic_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview,
        row_number() OVER (PARTITION BY topic_id ORDER BY doc_id) AS position, doc_id FROM kept QUALIFY position <= 3),
    topics AS (SELECT topic_id, count(*) AS count, (SELECT list(term ORDER BY position) FROM words w WHERE w.topic_id = k.topic_id) AS ws,
        (SELECT list(preview ORDER BY position) FROM reps r WHERE r.topic_id = k.topic_id) AS rs FROM kept k GROUP BY 1),
    named AS (SELECT *, topic_id || '_' || array_to_string(ws[1:4], '_') AS name FROM topics)"""


@query("topic6_topic_words", sql_with("document_topics", f"WITH {WORDS_SQL} SELECT topic_id, term, score, position FROM words"))
def _(spark, d):
    return TP.topic_words(topic_docs(spark, d))


@query("topic8_topic_table", sql_with("document_topics", f"WITH {TABLE_SQL} SELECT topic_id, name, count, array_to_string(ws, ',') AS words, array_to_string(rs, '|') AS docs FROM named"))
def _(spark, d):
    docs = topic_docs(spark, d)
    t = TP.topic_table(docs, TP.topic_words(docs))
    return t.select("topic_id", "name", "count", F.array_join(F.transform("words", lambda x: x["term"]), ",").alias("words"), F.array_join("representative_docs", "|").alias("docs"))


@query("win5_representative_docs", sql_with("document_topics", f"WITH {TABLE_SQL} SELECT topic_id, doc_id, position, preview FROM reps"))
def _(spark, d):
    return TP.representatives(topic_docs(spark, d).filter("topic_id >= 0"))


@query("agg18_topic_statistics", sql_with("document_topics", """WITH s AS (SELECT topic_id, count(*) AS n FROM document_topics GROUP BY 1)
    SELECT count(*) FILTER (topic_id >= 0) AS total_topics, CAST(sum(n) AS BIGINT) AS total_documents, CAST(coalesce(sum(n) FILTER (topic_id = -1), 0) AS BIGINT) AS outlier_documents,
    string_agg(topic_id || '=' || n, ',' ORDER BY topic_id) AS documents_per_topic, round(sum(n) / greatest(count(*) FILTER (topic_id >= 0), 1), 6) AS average_docs_per_topic FROM s"""))
def _(spark, d):
    s = TP.topic_statistics(M.document_topics(spark, d))
    shown = F.transform(F.map_entries("documents_per_topic"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return s.withColumn("documents_per_topic", F.array_join(shown, ",")).withColumn("average_docs_per_topic", F.round("average_docs_per_topic", 6))


@query("snk5_summary_report", sql_with("document_topics", f"WITH {TABLE_SQL} SELECT topic_id, name, count, array_to_string(ws[1:5], ', ') AS top_words, substr(rs[1], 1, 80) AS sample FROM named"))
def _(spark, d):
    docs = topic_docs(spark, d)
    return TP.summary_report(TP.topic_table(docs, TP.topic_words(docs)))


@query("agg20_sample_names", """WITH w AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)'), lambda w: regexp_full_match(w, '[a-z]{3,}'))) AS word FROM documents),
    c AS (SELECT source, word, count(*) AS n FROM w GROUP BY 1, 2),
    ten AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, word) <= 10),
    two AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS p FROM ten WHERE word NOT IN ('the','and','or','but','in','on','at','to','for','of','with','by','an','a') QUALIFY p <= 2),
    nm AS (SELECT source, string_agg(upper(word[1]) || lower(word[2:]), ' ' ORDER BY p) AS name FROM two GROUP BY 1)
    SELECT s.source, coalesce(nm.name, 'General Topic') AS name FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN nm USING (source)""")
def _(spark, d):
    return TP.sample_names(M.documents(spark, d).select("source", "text"), "source")


SNIP = f"regexp_replace(substr(text, 1, 100), '^{SP}+|{SP}+$', '', 'g')"


@query("agg21_sample_descriptions", f"""WITH f AS (SELECT source, doc_id, {SNIP} AS s FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 2),
    q AS (SELECT source, string_agg('"' || CASE WHEN length(s) > 50 THEN substr(s, 1, 47) || '...' ELSE s END || '"', ', ' ORDER BY doc_id) AS q FROM f GROUP BY 1)
    SELECT source, 'Topic covering content like ' || q || ' across ' || n || ' files' AS description FROM q JOIN (SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY 1) USING (source)""")
def _(spark, d):
    return TP.sample_descriptions(M.documents(spark, d), "source", "doc_id", files="lang")


TITLE_LEAD = f"""array_to_string(list_transform(regexp_extract_all(array_to_string({sql_words('text')}[1:4], ' '), '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda p: CASE WHEN substr(p, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substr(p, 1, 1)) END || lower(substr(p, 2))), '')"""


@query("agg22_cluster_labels", f"""WITH g AS (SELECT source, count(*) AS n, arg_min({TITLE_LEAD}, doc_id) AS lead, avg(len({sql_words('text')})) AS mean_words,
        list(lang ORDER BY doc_id) AS langs FROM documents GROUP BY 1),
    m AS (SELECT *, CASE WHEN n > 1 THEN lead || ' and Related' ELSE lead END AS nm FROM g)
    SELECT source, CASE WHEN length(nm) > 50 THEN substr(nm, 1, 47) || '...' ELSE nm END AS name, 'Heuristic topic containing ' || n || CASE WHEN n = 1 THEN ' document' ELSE ' documents' END
    || ' with average ' || printf('%.0f', round_even(mean_words, 0)) || ' words per document.' || CASE WHEN n <= 3 THEN ' Files: ' || array_to_string(langs, ', ') ELSE '' END AS description FROM m""")
def _(spark, d):
    return TP.cluster_labels(M.documents(spark, d), "source", "doc_id", path="lang")


@query("agg24_coherence", sql_with("document_topics", f"""WITH {WORDS_SQL} SELECT topic_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE least(1.0, 1 / (1 + var_pop(score) FILTER (position <= 5))) END, 9) AS coherence FROM words GROUP BY 1"""))
def _(spark, d):
    return G.coherence(TP.topic_words(topic_docs(spark, d))).withColumn("coherence", F.round("coherence", 9))


@query("agg25_topic_overview", sql_with("document_topics", f"WITH {TABLE_SQL} SELECT 'topic_' || topic_id AS id, name, count, array_to_string(ws[1:3], ',') AS top_words, array_to_string(rs[1:2], '|') AS samples FROM named ORDER BY count DESC, topic_id LIMIT 10"))
def _(spark, d):
    docs = topic_docs(spark, d)
    o = G.topic_overview(TP.topic_table(docs, TP.topic_words(docs)))
    return o.withColumn("top_words", F.array_join("top_words", ",")).withColumn("samples", F.array_join("samples", "|"))


@query("topic9_density_topic_areas", sql_with("document_topics", f"""WITH {TABLE_SQL} SELECT 'topic_1_' || topic_id AS topic_area_id, name, 'Topic discovered in ' || count || ' documents. Key themes include: ' || array_to_string(ws[1:5], ', ') AS description,
    least(1.0, (len(ws) + count) / 20.0) AS coverage_score, count AS concept_count FROM named WHERE count >= 3"""))
def _(spark, d):
    docs = topic_docs(spark, d)
    return TP.density_topic_areas(TP.topic_table(docs, TP.topic_words(docs)), F.lit(1)).select("topic_area_id", "name", "description", "coverage_score", "concept_count")


@query("topic10_cluster_topic_areas", sql_with("document_topics", """WITH dx AS (SELECT doc_id, topic_id % 5 AS workspace_id, topic_id, source, 1.0 / (1 + doc_id % 4) AS relevance FROM document_topics WHERE topic_id >= 0),
    m AS (SELECT * FROM dx),
    a AS (SELECT 'cluster_' || workspace_id || '_' || topic_id AS topic_area_id, workspace_id, least(1.0, avg(relevance)) AS coverage_score, count(*) AS concept_count, count(DISTINCT source) AS file_count FROM m GROUP BY workspace_id, topic_id HAVING count(*) >= 3),
    ws AS (SELECT n_nationkey AS workspace_id FROM nation),
    t AS (SELECT workspace_id, count(*) AS n, avg(relevance) AS r, count(DISTINCT source) AS file_count FROM dx GROUP BY 1)
    SELECT topic_area_id, workspace_id, round(coverage_score, 6) AS coverage_score, concept_count, file_count FROM a UNION ALL
    SELECT 'cluster_' || ws.workspace_id || CASE WHEN n IS NULL THEN '_fallback' ELSE '_general' END, ws.workspace_id, round(CASE WHEN n IS NULL THEN 0.5 ELSE least(1.0, r) END, 6), coalesce(n, 0), coalesce(file_count, 0)
    FROM ws LEFT JOIN t USING (workspace_id) WHERE ws.workspace_id NOT IN (SELECT workspace_id FROM a)"""))
def _(spark, d):
    docs = topic_docs(spark, d).filter("topic_id >= 0").select(
        "doc_id", (F.col("topic_id") % 5).cast("long").alias("workspace_id"), "topic_id", F.col("source").alias("file_path"), "text", (1.0 / (1 + F.col("doc_id") % 4)).alias("relevance")
    )
    member = docs.select("workspace_id", F.col("topic_id").alias("cluster"), "doc_id")
    ws = M.workspaces(spark, d).select(F.col("id").alias("workspace_id"))
    areas = TP.cluster_topic_areas(member, docs.drop("topic_id"), ws)
    return areas.select("topic_area_id", "workspace_id", *rounded("coverage_score"), "concept_count", "file_count")


@query("topic12_analyse_corpus")
def _(spark, d):
    docs = TP.tfidf_embedding(M.documents(spark, d).select("doc_id", "text"), dims=16, features=256)
    found = TP.extract_topics(docs, "density", min_size=5)
    return TP.topic_statistics(found).select("total_topics", "total_documents", "outlier_documents")


# --- ranking and recommendations -----------------------------------------------------------------------


@query("top2_topic_ranking", sql_with("topic_areas", """SELECT workspace_id, topic_area_id, round(coverage_score * 0.6 + explored_percentage * 0.4, 6) AS score,
    row_number() OVER (PARTITION BY workspace_id ORDER BY round(coverage_score * 0.6 + explored_percentage * 0.4, 9) DESC, topic_area_id) AS position FROM topic_areas QUALIFY position <= 20"""))
def _(spark, d):
    return TP.rank_by_score(M.topic_areas(spark, d)).select("workspace_id", "topic_area_id", *rounded("score"), "position")


@query("top3_topic_quality", sql_with("topic_areas", """SELECT workspace_id, topic_area_id, round(coverage_score * 0.7 + least(1.0, concept_count / 15.0) * 0.3, 6) AS quality,
    row_number() OVER (PARTITION BY workspace_id ORDER BY round(coverage_score * 0.7 + least(1.0, concept_count / 15.0) * 0.3, 9) DESC, topic_area_id) AS position FROM topic_areas QUALIFY position <= 20"""))
def _(spark, d):
    return TP.rank_by_quality(M.topic_areas(spark, d)).select("workspace_id", "topic_area_id", *rounded("quality"), "position")


@query("kg3_learning_paths", sql_with("topic_areas", """WITH c AS (SELECT workspace_id, count(*) AS topics, CAST(sum(concept_count * 2) AS BIGINT) AS estimated_hours, avg(coverage_score) AS c FROM topic_areas GROUP BY 1 HAVING count(*) >= 3),
    f AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY round(coverage_score + explored_percentage, 9) DESC, topic_area_id) AS p FROM topic_areas WHERE coverage_score > 0.7 QUALIFY p <= 5)
    SELECT 'path_' || workspace_id || '_comprehensive' AS learning_path_id, workspace_id, 'Comprehensive Workspace Mastery' AS name,
    'Complete learning path covering all major topics in your workspace' AS description, topics, estimated_hours,
    CASE WHEN c < 0.4 THEN 'beginner' WHEN c < 0.7 THEN 'intermediate' ELSE 'advanced' END AS difficulty_level, '' AS prerequisites FROM c UNION ALL
    SELECT 'path_' || workspace_id || '_focused_' || (p - 1), workspace_id, 'Deep Dive: ' || name, 'Focused learning path for mastering ' || name, 1, concept_count * 3, 'intermediate', '' FROM f"""))
def _(spark, d):
    return G.learning_paths(M.topic_areas(spark, d)).withColumn("prerequisites", F.array_join("prerequisites", ","))


@query("kg3_path_members", sql_with("topic_areas", """WITH o AS (SELECT *, count(*) OVER (PARTITION BY workspace_id) AS n, row_number() OVER (PARTITION BY workspace_id ORDER BY round(coverage_score + explored_percentage, 9) DESC, topic_area_id) AS p FROM topic_areas),
    f AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY p) AS q FROM o WHERE coverage_score > 0.7 QUALIFY q <= 5)
    SELECT 'path_' || workspace_id || '_comprehensive' AS learning_path_id, p AS position, topic_area_id FROM o WHERE n >= 3 UNION ALL
    SELECT 'path_' || workspace_id || '_focused_' || (q - 1), 1, topic_area_id FROM f"""))
def _(spark, d):
    return G.path_members(M.topic_areas(spark, d))


@query("kg3_path_topics", sql_with("topic_areas", """SELECT workspace_id, topic_area_id, row_number() OVER (PARTITION BY workspace_id ORDER BY round(coverage_score + explored_percentage, 9) DESC, topic_area_id) AS position FROM topic_areas"""))
def _(spark, d):
    return G.path_topics(M.topic_areas(spark, d))


@query("kg4_recommendations", sql_with("topic_areas", """WITH r AS (SELECT *, explored_percentage < 0.3 AS gap FROM topic_areas WHERE explored_percentage < 0.3 OR (coverage_score > 0.8 AND explored_percentage < 0.5)),
    s AS (SELECT *, round(CASE WHEN gap THEN least(1.0, (1 - explored_percentage) * 0.8) ELSE 0.7 END, 9) AS p FROM r)
    SELECT workspace_id, topic_area_id, CASE WHEN gap THEN 'concept_gap' ELSE 'quiz_performance' END AS recommendation_type, round(p, 6) AS priority_score,
    CASE WHEN gap THEN 'You''ve only explored ' || printf('%.1f', round_even(explored_percentage * 100, 1)) || '% of ' || name ELSE 'You have good coverage of ' || name || ' but need more practice' END AS reason,
    CASE WHEN gap THEN 'Take a quiz on ' || name || ' to improve your understanding' ELSE 'Practice quizzes on ' || name || ' concepts' END AS suggested_action
    FROM s QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY p DESC, topic_area_id) <= 10"""))
def _(spark, d):
    return G.recommendations(M.topic_areas(spark, d)).drop("position").withColumn("priority_score", F.round("priority_score", 6))


@query("top7_topic_suggestions", sql_with("progress", f"""WITH c AS (SELECT CAST(user_id AS BIGINT) AS id, count(*) AS frequency, max(timestamp) AS last_accessed FROM progress GROUP BY 1),
    v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
    s AS (SELECT v.id, max(list_cosine_similarity(v.e, f.e)) AS s FROM v, (SELECT arg_min(e, id) AS e FROM v GROUP BY label) f GROUP BY 1 HAVING max(list_cosine_similarity(v.e, f.e)) >= 0),
    p AS (SELECT c.id, frequency / (SELECT max(frequency) FROM c) AS frequency_score, exp(-floor(date_diff('microsecond', last_accessed, TIMESTAMP '{AS_OF_EVENTS}') / 86400000000.0) / 7.0) AS recency_score, coalesce(s.s, 0) AS semantic_score FROM c LEFT JOIN s USING (id))
    SELECT id, round(frequency_score, 6) AS frequency_score, round(recency_score, 6) AS recency_score, round(semantic_score, 6) AS semantic_score,
    round(frequency_score * 0.4 + recency_score * 0.3 + semantic_score * 0.3, 6) AS score FROM p ORDER BY round(p.frequency_score * 0.4 + p.recency_score * 0.3 + p.semantic_score * 0.3, 9) DESC, id LIMIT 10"""))
def _(spark, d):
    c = M.progress(spark, d).groupBy(F.col("user_id").cast("long").alias("id")).agg(F.count("*").alias("frequency"), F.max("timestamp").alias("last_accessed"))
    v = vectors(spark, d)
    focus = v.groupBy("topic_id").agg(F.min("id").alias("id")).join(v.drop("topic_id"), "id")
    near = V.above(v, focus, 0.0).groupBy("id").agg(F.max("similarity").alias("similarity"))
    s = G.topic_suggestions(c, near, ntz(AS_OF_EVENTS))
    return s.select("id", *rounded("frequency_score", "recency_score", "semantic_score", "score"))


@query("join10_relationship_candidates", sql_with("topic_areas", """WITH k AS (SELECT workspace_id, topic_area_id, list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS words,
        coalesce(lead(topic_area_id) OVER w, lag(topic_area_id) OVER w) AS other FROM topic_areas WINDOW w AS (PARTITION BY workspace_id ORDER BY topic_area_id)),
    p AS (SELECT a.workspace_id, a.topic_area_id AS source_topic_id, b.topic_area_id AS target_topic_id FROM k a JOIN k b ON a.workspace_id = b.workspace_id AND a.topic_area_id < b.topic_area_id AND list_has_any(a.words, b.words))
    SELECT * FROM p UNION SELECT workspace_id, least(topic_area_id, other), greatest(topic_area_id, other) FROM k
    WHERE other IS NOT NULL AND topic_area_id NOT IN (SELECT source_topic_id FROM p UNION SELECT target_topic_id FROM p)"""))
def _(spark, d):
    return G.relationship_candidates(M.topic_areas(spark, d))


@query("join11_workspace_relationships", sql_with("topic_areas topic_relationships", """WITH t AS (SELECT topic_area_id FROM topic_areas WHERE coverage_score > 0.8)
    SELECT relationship_id, source_topic_id, target_topic_id, relationship_type, strength FROM topic_relationships
    WHERE source_topic_id IN (SELECT topic_area_id FROM t) OR target_topic_id IN (SELECT topic_area_id FROM t)"""))
def _(spark, d):
    areas = M.topic_areas(spark, d).filter("coverage_score > 0.8")
    return G.workspace_relationships(M.topic_relationships(spark, d), areas).select("relationship_id", "source_topic_id", "target_topic_id", "relationship_type", "strength")


@query("kg2_relationships_from_verdicts", sql_with("topic_relationships", """WITH r AS (SELECT *, row_number() OVER (ORDER BY relationship_id) AS rn, length(relationship_id) % 4 AS k FROM topic_relationships)
    SELECT CASE WHEN k = 1 THEN target_topic_id ELSE source_topic_id END AS source_topic_id, CASE WHEN k = 1 THEN source_topic_id ELSE target_topic_id END AS target_topic_id,
    relationship_type, CASE WHEN k = 2 THEN 0.5 ELSE 0.8 END AS strength, CASE WHEN k = 2 THEN '' ELSE 'close' END AS reasoning FROM r WHERE k <> 0"""))
def _(spark, d):
    r = M.topic_relationships(spark, d)
    k = F.length("relationship_id") % 4
    kind = F.col("relationship_type")
    verdict = (
        F.when(k == 0, 'Sorry. {"relationship_type": "no_relationship"}')
        .when(k == 1, F.concat(F.lit('Sure: {"relationship_type": "'), kind, F.lit('", "strength": 0.8, "reasoning": "close", "direction": "topic2_to_topic1"} ok')))
        .when(k == 2, F.concat(F.lit('{"relationship_type": "'), kind, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"relationship_type": "'), kind, F.lit('", "strength": 0.8, "reasoning": "close", "direction": "bidirectional"}')))
    )
    return G.relationships_from_verdicts(r.select("source_topic_id", "target_topic_id", "relationship_id", F.col("relationship_type")), verdict)


# --- knowledge graph -------------------------------------------------------------------------------------

WINDOWS_SQL = f"""{TABLE_SQL}, kw AS (SELECT topic_id, term AS keyword FROM words WHERE position <= 5),
    sn AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda s: regexp_replace(s, '^{SP}+|{SP}+$', '', 'g')), lambda s: s <> '') AS ss FROM document_topics),
    se AS (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM sn),
    hits AS (SELECT kw.topic_id, doc_id, i, list(keyword ORDER BY keyword) AS keywords, any_value(array_to_string(ss[greatest(1, i - 3) : least(len(ss), i + 3)], '. ')) AS c
        FROM se JOIN kw ON contains(lower(ss[i]), lower(keyword)) GROUP BY 1, 2, 3),
    windows AS (SELECT topic_id, doc_id, CAST(i - 1 AS INT) AS sentence_index, keywords, CASE WHEN length(c) > 200 THEN substr(c, 1, 200) || '...' ELSE c END AS context FROM hits),
    cw AS (SELECT topic_id, doc_id, sentence_index, context, unnest(keywords) AS keyword, len(keywords) AS m FROM windows),
    concepts AS (SELECT topic_id, keyword, count(*) AS window_count, CAST(sum(m) AS BIGINT) AS total_mentions FROM cw GROUP BY 1, 2)"""
GRAPH_SQL = f"""{WINDOWS_SQL},
    ov AS (SELECT a.topic_id AS s, b.topic_id AS t, count(*) AS shared FROM words a JOIN words b ON a.term = b.term AND a.topic_id <> b.topic_id GROUP BY 1, 2),
    hier AS (SELECT 'hierarchy_' || s || '_' || t AS id, 'topic_' || s AS source_id, 'topic_' || t AS target_id, CASE WHEN x.count > y.count THEN 'subtopic_of' ELSE 'relates_to' END AS type,
        shared / (len(x.ws) + len(y.ws) - shared) AS weight FROM ov JOIN named x ON x.topic_id = s JOIN named y ON y.topic_id = t WHERE shared / (len(x.ws) + len(y.ws) - shared) > 0.05),
    du AS (SELECT d.doc_id, d.topic_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e
        FROM kept d JOIN embeddings ON vec_id = doc_id),
    dc AS (SELECT topic_id, list(x ORDER BY i) AS c FROM (SELECT topic_id, i, avg(e[i]) AS x FROM (SELECT topic_id, e, unnest(range(1, len(e) + 1)) AS i FROM du) GROUP BY 1, 2) GROUP BY 1),
    dp AS (SELECT doc_id, coalesce(sum(s) FILTER (own) / nullif(sum(s), 0), 0.5) AS probability
        FROM (SELECT doc_id, du.topic_id = dc.topic_id AS own, greatest(0, list_cosine_similarity(e, c)) AS s FROM du, dc) GROUP BY 1),
    edges AS (SELECT * FROM hier UNION ALL
        SELECT 'concept_topic_concept_' || topic_id || '_' || keyword || '_topic_' || topic_id, 'concept_' || topic_id || '_' || keyword, 'topic_' || topic_id, 'belongs_to_topic', window_count / 10.0 FROM concepts UNION ALL
        SELECT 'doc_topic_doc_' || doc_id || '_topic_' || topic_id, 'doc_' || doc_id, 'topic_' || topic_id, 'belongs_to_topic', coalesce(probability, 0.5) FROM kept LEFT JOIN dp USING (doc_id)),
    nodes AS (SELECT 'topic_' || topic_id AS id, 'topic' AS type, name, 'Topic covering ' || count || ' documents. Key themes: ' || array_to_string(ws[1:5], ', ') || ' Example: ' || substr(rs[1], 1, 100) || '...' AS description FROM named UNION ALL
        SELECT 'concept_' || c.topic_id || '_' || keyword, 'concept', keyword, 'Concept extracted from ' || window_count || ' context windows in topic ''' || n.name || '''' FROM concepts c JOIN named n USING (topic_id) UNION ALL
        SELECT 'doc_' || doc_id, 'document', 'Document ' || (doc_id + 1), CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END FROM document_topics)"""


def graph(spark, d):
    """(docs, words, topics, nodes, edges, windows) of the given assignments, weighted by the vectors of the documents; overlap above 0.05 links topics."""
    docs = topic_docs(spark, d)
    words = write_step(TP.topic_words(docs), "words")
    topics = write_step(TP.topic_table(docs, words), "topics")
    vectors = M.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    held = docs.select("doc_id", "topic_id").join(vectors, "doc_id", "left")
    assigned = TP.assignments(held, TP.centroids(held.filter("topic_id >= 0 AND embedding IS NOT NULL")), key="doc_id")
    nodes, edges, windows = G.build_graph(docs, topics, words, assigned, overlap=0.05)
    return docs, words, topics, nodes, edges, windows


def windows_of(spark, d):
    """The windows of the graph alone: they need the topics' words, but no nodes and edges."""
    docs = topic_docs(spark, d)
    words = write_step(TP.topic_words(docs), "words")
    return write_step(G.context_windows(docs, words.filter("position <= 5").select("topic_id", F.col("term").alias("keyword"))), "windows")


def graph_sql(body: str) -> str:
    return sql_with("document_topics", f"WITH {GRAPH_SQL} {body}")


@query("win4_context_windows", graph_sql("SELECT topic_id, doc_id, sentence_index, array_to_string(keywords, ',') AS keywords, context FROM windows"))
def _(spark, d):
    w = windows_of(spark, d)
    return w.withColumn("keywords", F.array_join(F.array_sort("keywords"), ","))


@query("agg23_concepts", graph_sql("SELECT * FROM concepts"))
def _(spark, d):
    return G.concepts(windows_of(spark, d))


@query("agg23_concept_samples", graph_sql("SELECT topic_id, keyword, doc_id, substr(context, 1, 100) AS sample, row_number() OVER (PARTITION BY topic_id, keyword ORDER BY doc_id, sentence_index) AS position FROM cw QUALIFY position <= 3"))
def _(spark, d):
    return G.concept_samples(windows_of(spark, d)).drop("sentence_index")


@query("agg23_related_words", graph_sql(f"SELECT DISTINCT topic_id, keyword, unnest(list_filter({sql_words('context')}, lambda w: length(w) > 4 AND regexp_full_match(w, '\\p{{L}}+'))[1:3]) AS word FROM cw"))
def _(spark, d):
    return G.related_words(windows_of(spark, d))


@query("join12_word_overlap_edges", graph_sql("SELECT id, source_id, target_id, type, round(weight, 6) AS weight FROM hier"))
def _(spark, d):
    docs = topic_docs(spark, d)
    words = write_step(TP.topic_words(docs), "words")
    sizes = docs.filter("topic_id >= 0").groupBy("topic_id").agg(F.count("*").alias("count"))
    return G.word_overlap_edges(words, sizes, 0.05).withColumn("weight", F.round("weight", 6))


@query("join12_frequent_word_overlap", sql_with("document_topics", f"""WITH {WORDS_SQL}, ten AS (SELECT topic_id, term FROM tf QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY tf DESC, term) <= 10),
    z AS (SELECT topic_id, count(*) AS count FROM kept GROUP BY 1), o AS (SELECT a.topic_id AS s, b.topic_id AS t, count(*) AS shared FROM ten a JOIN ten b ON a.term = b.term AND a.topic_id <> b.topic_id GROUP BY 1, 2)
    SELECT 'hierarchy_' || s || '_' || t AS id, 'topic_' || s AS source_id, 'topic_' || t AS target_id, CASE WHEN x.count > y.count THEN 'subtopic_of' ELSE 'relates_to' END AS type,
        round(shared / ((SELECT count(*) FROM ten WHERE topic_id = s) + (SELECT count(*) FROM ten WHERE topic_id = t) - shared), 6) AS weight
    FROM o JOIN z x ON x.topic_id = s JOIN z y ON y.topic_id = t WHERE shared / ((SELECT count(*) FROM ten WHERE topic_id = s) + (SELECT count(*) FROM ten WHERE topic_id = t) - shared) > 0.3"""))
def _(spark, d):
    docs = topic_docs(spark, d).filter("topic_id >= 0")
    edges = G.word_overlap_edges(TP.frequent_terms(docs), docs.groupBy("topic_id").agg(F.count("*").alias("count")))
    return edges.withColumn("weight", F.round("weight", 6))


@query("kg1_graph_nodes", graph_sql("SELECT id, type, name, description FROM nodes"))
def _(spark, d):
    return graph(spark, d)[3]


@query("join13_graph_edges", graph_sql("SELECT id, source_id, target_id, type, round(weight, 6) AS weight FROM edges"))
def _(spark, d):
    return graph(spark, d)[4].withColumn("weight", F.round("weight", 6))


@query("agg26_graph_counts", graph_sql("SELECT type, count(*) AS nodes FROM nodes GROUP BY 1"))
def _(spark, d):
    return G.graph_counts(graph(spark, d)[3])


@query("agg27_node_sizes", graph_sql("""SELECT n.id, coalesce(g.d, 0) AS degree, least(greatest(8 + 2 * coalesce(g.d, 0), 8), 20) AS size FROM nodes n
    LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1) g USING (id)"""))
def _(spark, d):
    _, _, _, nodes, edges, _ = graph(spark, d)
    return G.node_sizes(nodes, edges)


@query("snk3_graph_export", graph_sql("SELECT id, source_id AS source, target_id AS target, type, round(weight, 6) AS weight FROM edges"))
def _(spark, d):
    return G.export_edges(graph(spark, d)[4]).withColumn("weight", F.round("weight", 6))


@query("join14_explore_topics", graph_sql("""SELECT e.target_id AS topic, CASE n.type WHEN 'topic' THEN 'related' ELSE n.type END AS relation, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.type = 'belongs_to_topic'
    UNION ALL SELECT e.source_id, CASE n.type WHEN 'topic' THEN 'related' ELSE n.type END, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.type IN ('subtopic_of', 'relates_to')"""))
def _(spark, d):
    _, _, _, nodes, edges, _ = graph(spark, d)
    return G.explore(nodes, edges)


@query("join15_similar_topics", graph_sql("""SELECT source_id, target_id, n.name, round(weight, 6) AS weight, e.type AS relation FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.type IN ('subtopic_of', 'relates_to')
    QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY round(weight, 9) DESC, target_id) <= 5"""))
def _(spark, d):
    _, _, _, nodes, edges, _ = graph(spark, d)
    return G.similar_topics(nodes, edges).withColumn("weight", F.round("weight", 6))


@query("join16_neighbourhood", graph_sql("""SELECT id, min(hops) AS hops FROM (SELECT 'topic_3' AS id, 0 AS hops UNION ALL
    SELECT unnest([source_id, target_id]), 1 FROM edges WHERE source_id = 'topic_3' OR target_id = 'topic_3' UNION ALL
    SELECT unnest([f.source_id, f.target_id]), 2 FROM edges e JOIN edges f ON f.source_id IN (e.source_id, e.target_id) OR f.target_id IN (e.source_id, e.target_id)
    WHERE e.source_id = 'topic_3' OR e.target_id = 'topic_3') GROUP BY 1"""))
def _(spark, d):
    _, _, _, nodes, edges, _ = graph(spark, d)
    return G.neighbourhood(edges, nodes.filter("id = 'topic_3'"), 2)


@query("join17_concept_files", graph_sql("""SELECT topic_id, keyword, source, count(*) AS mentions, round(count(*) / sum(count(*)) OVER (PARTITION BY topic_id, keyword), 6) AS relevance
    FROM cw JOIN documents USING (doc_id) GROUP BY topic_id, keyword, source"""))
def _(spark, d):
    return G.concept_files(windows_of(spark, d), topic_docs(spark, d)).withColumn("relevance", F.round("relevance", 6)).withColumn("mentions", F.col("mentions").cast("long"))


@query("join20_merge_by_name", graph_sql("SELECT lower(trim(name)) AS key, min(id) AS id, count(*) AS members FROM nodes GROUP BY 1"))
def _(spark, d):
    _, _, _, nodes, edges, _ = graph(spark, d)
    return G.merge_by_name(nodes, edges)[0]


@query("join20_merged_edges", graph_sql("""SELECT s.into_id AS source, t.into_id AS target, count(*) AS links, round(max(weight), 6) AS weight FROM edges e
    JOIN (SELECT id, min(id) OVER (PARTITION BY lower(trim(name))) AS into_id FROM nodes) s ON s.id = e.source_id
    JOIN (SELECT id, min(id) OVER (PARTITION BY lower(trim(name))) AS into_id FROM nodes) t ON t.id = e.target_id WHERE s.into_id <> t.into_id GROUP BY 1, 2"""))
def _(spark, d):
    _, _, _, nodes, edges, _ = graph(spark, d)
    return G.merge_by_name(nodes, edges)[1].withColumn("weight", F.round("weight", 6))


@query("top5_graph_search", graph_sql("""SELECT id, type, CASE WHEN contains(lower(name), 'tion') THEN 1.0 ELSE 0.5 END AS relevance, CASE WHEN contains(lower(name), 'tion') THEN 'name' ELSE 'description' END AS match_type
    FROM nodes WHERE contains(lower(name), 'tion') OR contains(lower(description), 'tion') ORDER BY 3 DESC, id LIMIT 25"""))
def _(spark, d):
    return G.search_nodes(graph(spark, d)[3], "tion", 25).select("id", "type", "relevance", "match_type")
