"""Queries on text: cleaning, quality, language, search, duplicates, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorloom.functions import study as S
from tutorloom.functions import text as T
from tutorloom.functions.text import CleaningConfig
from tutorloom.operators import dedup
from tutorloom.operators import documents as D
from tutorloom.operators import lookups as K
from tutorloom.operators import search as SE
from tutorloom.plans import mapping as M
from tutorloom.plans.mapping import AS_OF_ANSWERS, ntz, sql_with
from tutorloom.plans.q_study import rounded
from tutorloom.plans.registry import query

SP = T.SPACE_CLASS


def sql_clean(text: str = "text") -> str:
    out = text
    for pattern, to in ((T.URL_PATTERN, ""), (T.EMAIL_PATTERN, ""), (T.TAG_PATTERN, ""), (T.UNIFIED_SPACE_PATTERN, " ")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace(lower({out}), '{SP}+', ' ', 'g'))"


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SP}+'), lambda w: w <> '')"


def sql_reason(words: str = "ws", low: int = 10, high: int = 50_000) -> str:
    return f"""CASE WHEN len({words}) < {low} THEN 'too_short' WHEN len({words}) > {high} THEN 'too_long'
        WHEN len(list_filter({words}, lambda w: length(w) > 50)) > 0 THEN 'long_words'
        WHEN len(list_filter({words}, lambda w: regexp_full_match(w, '\\p{{Nd}}+'))) / len({words}) > 0.5 THEN 'too_many_numbers' ELSE 'quality' END"""


def sql_lang(text: str) -> str:
    hits = {lang: f"len(list_filter(toks, lambda t: t IN ({', '.join(repr(w) for w in ws)})))" for lang, ws in T.LANGUAGE_WORDS.items()}
    cols = ", ".join(f"{h} AS h_{lang}" for lang, h in hits.items())
    pick = " ".join(f"WHEN h_{lang} = greatest(h_en, h_fr, h_de, h_es) THEN '{lang}'" for lang in hits)
    return cols, f"CASE WHEN greatest(h_en, h_fr, h_de, h_es) = 0 THEN 'unknown' {pick} END"


LANG_COLS, LANG_PICK = sql_lang("cleaned")
JUDGED = f"""cleaned AS (SELECT doc_id, lang, source, {sql_clean()} AS cleaned FROM documents),
    split AS (SELECT *, {sql_words('cleaned')} AS ws, regexp_extract_all(cleaned, '(\\p{{L}}+)') AS toks FROM cleaned),
    scored AS (SELECT *, {LANG_COLS} FROM split),
    judged AS (SELECT doc_id, lang, source, cleaned, ws, {sql_reason()} AS reason, {LANG_PICK} AS detected_lang FROM scored)"""


@query("doc1_clean_text", f"WITH {JUDGED} SELECT doc_id, cleaned AS text FROM judged")
def _(spark, d):
    return D.clean(M.documents(spark, d)).select("doc_id", "text")


@query("doc1_clean_pages", f"SELECT page_id, {sql_clean('html')} AS html FROM pages")
def _(spark, d):
    return D.clean(M.pages(spark, d), text="html").select("page_id", "html")


@query("doc2_quality_verdict", f"""WITH {JUDGED} SELECT doc_id, reason, CASE reason WHEN 'too_short' THEN 'too_short_' || len(ws) || '_words'
    WHEN 'too_long' THEN 'too_long_' || len(ws) || '_words' WHEN 'long_words' THEN 'long_words_found' WHEN 'too_many_numbers'
    THEN 'too_many_numbers_' || printf('%.2f', round_even(len(list_filter(ws, lambda w: regexp_full_match(w, '\\p{{Nd}}+'))) / len(ws), 2)) ELSE 'quality' END AS label FROM judged""")
def _(spark, d):
    docs = D.judge_quality(D.clean(M.documents(spark, d)))
    return docs.select("doc_id", "reason", T.quality_label(F.col("text")).alias("label"))


@query("doc3_quality_counts", f"WITH {JUDGED} SELECT reason, count(*) AS documents FROM judged GROUP BY 1")
def _(spark, d):
    return D.quality_counts(D.clean(M.documents(spark, d)))


@query("doc3_quality_against_labels", f"""WITH {JUDGED} SELECT quality, toxic, reason, count(*) AS documents FROM judged JOIN labels USING (doc_id) GROUP BY 1, 2, 3""")
def _(spark, d):
    judged = D.judge_quality(D.clean(M.documents(spark, d))).select("doc_id", "reason")
    return judged.join(M.table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic", "reason").agg(F.count("*").alias("documents"))


@query("doc4_language_counts", f"WITH {JUDGED} SELECT detected_lang, count(*) AS documents, count(*) FILTER (detected_lang = 'en') AS kept FROM judged GROUP BY 1")
def _(spark, d):
    return D.language_counts(D.clean(M.documents(spark, d)))


@query("doc4_language_agreement", f"WITH {JUDGED} SELECT lang, detected_lang, count(*) AS documents FROM judged GROUP BY 1, 2")
def _(spark, d):
    docs = D.detect_languages(D.clean(M.documents(spark, d)))
    return docs.groupBy("lang", "detected_lang").agg(F.count("*").alias("documents"))


@query("doc7_single_document", f"WITH {JUDGED} SELECT doc_id, CASE WHEN reason = 'quality' AND detected_lang = 'en' THEN cleaned ELSE '-' END AS prepared FROM judged")
def _(spark, d):
    return M.documents(spark, d).select("doc_id", F.coalesce(T.prepared_document(F.col("text")), F.lit("-")).alias("prepared"))


@query("doc9_text_selection", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END AS content, text FROM documents)
    SELECT doc_id, coalesce(nullif(regexp_replace(content, '^{SP}+|{SP}+$', '', 'g'), ''), regexp_replace(text, '^{SP}+|{SP}+$', '', 'g')) AS chosen,
    coalesce(CASE WHEN len({sql_words('text')}) >= 3 THEN regexp_replace(text, '^{SP}+|{SP}+$', '', 'g') END, '-') AS chosen3 FROM t""")
def _(spark, d):
    content = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source"))
    return M.documents(spark, d).select(
        "doc_id", T.first_filled(content, F.col("text")).alias("chosen"),
        F.coalesce(T.first_filled(content, F.col("text"), min_words=3), F.lit("-")).alias("chosen3"),
    )


TOPIC_INPUT_SQL = f"""SELECT doc_id, trim(regexp_replace(text, '{SP}+', ' ', 'g')) AS text FROM documents
    WHERE len({sql_words('text')}) >= 3 AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s.,!?;:]', '', 'g')) / length(text) >= 0.7"""


@query("doc10_topic_input", TOPIC_INPUT_SQL)
def _(spark, d):
    return D.topic_inputs(M.documents(spark, d)).select("doc_id", "text")


@query("doc11_minimum_words", f"SELECT doc_id, n_chars FROM documents WHERE len({sql_words('text')}) >= 50")
def _(spark, d):
    return D.minimum_words(M.documents(spark, d), 50).select("doc_id", "n_chars")


# --- near duplicates ----------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in T.ENGLISH_STOP_WORDS)


def sql_terms(source: str, key: str, text: str) -> str:
    """CTEs toks and terms(key, term): 1-2-grams without stop words."""
    return f"""toks AS (SELECT {key}, list_filter(regexp_extract_all(lower({text}), '([\\p{{L}}\\p{{N}}_]{{2,}})'), lambda t: t NOT IN ({STOP})) AS t FROM {source}),
    grams AS (SELECT {key}, list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END) AS g FROM toks),
    terms AS (SELECT {key}, unnest(g) AS term FROM grams)"""


def sql_dedup(source: str, text: str) -> str:
    """CTEs ending in removed(doc_id)."""
    return f"""{sql_terms(source, 'doc_id', text)},
    n AS (SELECT count(*) AS n FROM {source}),
    vocab AS (SELECT term FROM terms GROUP BY term ORDER BY count(*) DESC, term LIMIT least(1000, (SELECT n // 2 FROM n))),
    tf AS (SELECT doc_id, term, count(*) AS c FROM terms SEMI JOIN vocab USING (term) GROUP BY 1, 2),
    idf AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
    raw AS (SELECT doc_id, term, c * idf AS w FROM tf JOIN idf USING (term)),
    vec AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw),
    edges AS (SELECT a.doc_id AS a, b.doc_id AS b FROM vec a JOIN vec b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) > 0.95),
    nb AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS rn FROM edges GROUP BY b),
    walk(rn, removed) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
        SELECT nb.rn, CASE WHEN len(list_filter(nb.earlier, lambda x: NOT list_contains(walk.removed, x))) > 0 THEN list_append(walk.removed, nb.b) ELSE walk.removed END
        FROM walk JOIN nb ON nb.rn = walk.rn + 1),
    removed AS (SELECT unnest(removed) AS doc_id FROM walk WHERE rn = (SELECT max(rn) FROM walk))"""


@query("join7_near_duplicates", f"WITH RECURSIVE {sql_dedup('documents', 'text')} SELECT doc_id FROM removed")
def _(spark, d):
    return dedup.near_duplicates(M.documents(spark, d).select("doc_id", "text"), "doc_id", "text")


PREPARED_SQL = f"""{JUDGED}, passed AS (SELECT * FROM judged WHERE reason = 'quality' AND detected_lang = 'en'), {sql_dedup('passed', 'cleaned')}"""


@query("doc5_duplicates_removed", f"WITH RECURSIVE {PREPARED_SQL} SELECT doc_id, source, cleaned AS text FROM passed ANTI JOIN removed USING (doc_id)")
def _(spark, d):
    kept, _ = D.prepare(M.documents(spark, d))
    return kept.select("doc_id", "source", "text")


@query("doc6_preparation_stats", f"""WITH RECURSIVE {PREPARED_SQL} SELECT count(*) AS input_documents, count(*) FILTER (reason <> 'quality') AS removed_by_quality,
    count(*) FILTER (reason = 'quality' AND detected_lang <> 'en') AS removed_by_language, (SELECT count(*) FROM removed) AS removed_as_duplicates,
    count(*) FILTER (reason = 'quality' AND detected_lang = 'en') - (SELECT count(*) FROM removed) AS final_documents FROM judged""")
def _(spark, d):
    return D.prepare(M.documents(spark, d))[1]


# --- search ---------------------------------------------------------------------------------------------

NEEDLE = "tion"
SEARCH_SQL = f"""lines AS (SELECT source || '/' || doc_id || '.txt' AS path, unnest(ls) AS body, generate_subscripts(ls, 1) AS line
        FROM (SELECT *, regexp_split_to_array(text, '\\r\\n?|\\n') AS ls FROM documents)),
    hits AS (SELECT *, strpos(lower(body), '{NEEDLE}') - 1 AS pos FROM lines WHERE contains(lower(body), '{NEEDLE}')),
    ctx AS (SELECT path, line, greatest(0, pos - 50) AS s, least(length(body), pos + {len(NEEDLE)} + 50) AS e, body FROM hits),
    found AS (SELECT path, CAST(line AS BIGINT) AS line, CASE WHEN s > 0 THEN '...' ELSE '' END || regexp_replace(substr(body, s + 1, e - s), '^{SP}+|{SP}+$', '', 'g')
        || CASE WHEN e < length(body) THEN '...' ELSE '' END AS match FROM ctx)"""


def _files(spark, d):
    return M.documents(spark, d).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


@query("sea1_content_search", f"WITH {SEARCH_SQL} SELECT path, line, match FROM found")
def _(spark, d):
    return SE.search_lines(_files(spark, d), NEEDLE)


@query("sea1_matches_per_file", f"WITH {SEARCH_SQL} SELECT path, count(*) AS matches FROM found GROUP BY 1")
def _(spark, d):
    return SE.matches_per_file(SE.search_lines(_files(spark, d), NEEDLE))


@query("agg29_results_by_directory", f"""WITH {SEARCH_SQL} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, path, line, match FROM found
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 3""")
def _(spark, d):
    return SE.grouped_by_directory(SE.search_lines(_files(spark, d), NEEDLE)).select("directory", "path", "line", "match")


# --- folder trees over page addresses ------------------------------------------------------------------

URL_PATH_SQL = "regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+$', '')"


def _page_paths(spark, d):
    return M.pages(spark, d).select(F.regexp_replace(F.regexp_extract("url", "^https?://([^?#]*)", 1), "/+$", "").alias("path"))


TREE_SQL = f"""p AS (SELECT DISTINCT string_split({URL_PATH_SQL}, '/') AS parts FROM pages),
    nodes AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS path, array_to_string(parts[1:k-1], '/') AS parent, parts[k] AS name, k = len(parts) AS is_file
        FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM p))"""


@query("flt15_folder_tree", f"WITH {TREE_SQL} SELECT path, parent, name, is_file FROM nodes")
def _(spark, d):
    return K.folder_tree(_page_paths(spark, d))


@query("flt14_filter_tree", f"""WITH {TREE_SQL}, hit AS (SELECT path FROM nodes WHERE contains(lower(name), 'en'))
    SELECT path, parent, name, is_file FROM nodes n WHERE EXISTS (SELECT 1 FROM hit h WHERE h.path = n.path OR starts_with(h.path, n.path || '/'))""")
def _(spark, d):
    return K.filter_tree(K.path_nodes(_page_paths(spark, d)), "en")


@query("flt16_workspace_files", f"""SELECT source || '/' || doc_id || '.txt' AS path FROM documents WHERE source NOT IN ('src1', 'src2') AND len({sql_words('text')}) >= 6""")
def _(spark, d):
    return K.workspace_files(_files(spark, d), ("src1", "src2"), (".png", ".jpg")).select("path")


@query("agg19_extension_report", f"""WITH f AS (SELECT lower(regexp_extract({URL_PATH_SQL}, '[^/.][^/]*?(\\.[^./]+)$', 1)) AS extension FROM pages)
    SELECT extension, count(*) AS files, extension NOT IN ('.com', '.org') AS is_text FROM f GROUP BY 1""")
def _(spark, d):
    return D.extension_report(_page_paths(spark, d), [".com", ".org"])


# --- scalar functions ---------------------------------------------------------------------------------


@query("fn1_fn2_word_counts", f"SELECT doc_id, len({sql_words('text')}) AS words FROM documents")
def _(spark, d):
    return M.documents(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("fn3_fn4_titles", """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview,
    array_to_string(list_transform(regexp_extract_all(text, '(\\p{L}+|[^\\p{L}]+)'), lambda p: CASE WHEN substr(p, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substr(p, 1, 1)) END || lower(substr(p, 2))), '') AS title FROM documents""")
def _(spark, d):
    return M.documents(spark, d).select("doc_id", T.preview(F.col("text")).alias("preview"), T.title_case(F.col("text")).alias("title"))


@query("fn5_path_parts", f"""WITH p AS (SELECT page_id, {URL_PATH_SQL} AS path FROM pages)
    SELECT page_id, lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]+)$', 1)) AS extension, string_split(path, '/')[-1] AS name,
    regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM p""")
def _(spark, d):
    p = M.pages(spark, d).select("page_id", F.regexp_replace(F.regexp_extract("url", "^https?://([^?#]*)", 1), "/+$", "").alias("path"))
    c = F.col("path")
    return p.select("page_id", T.extension(c).alias("extension"), T.base_name(c).alias("name"), T.directory(c).alias("directory"))


KINDS = ["py", "TS", "md", "markdown", "txt", "pdf", "JPG", "gif", "json", "zip"]  # endings that the documents get in turn


@query("fn5_file_kind", f"""SELECT doc_id, CASE WHEN e IN ('py', 'js', 'ts', 'html', 'css', 'json', 'xml') THEN 'code' WHEN e IN ('md', 'markdown') THEN 'markdown'
    WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('jpg', 'jpeg', 'png', 'gif') THEN 'image' ELSE 'text' END AS kind
    FROM (SELECT doc_id, lower({KINDS}[doc_id % {len(KINDS)} + 1]) AS e FROM documents)""")
def _(spark, d):
    ending = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    return M.documents(spark, d).select("doc_id", T.file_kind(F.concat_ws(".", F.concat_ws("/", "source", F.col("doc_id").cast("string")), ending)).alias("kind"))


@query("fn6_human_size", """WITH s AS (SELECT doc_id, n_chars * n_chars AS size FROM documents),
    u AS (SELECT *, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 ELSE 3 END AS k FROM s)
    SELECT doc_id, CASE WHEN size = 0 THEN '0 Bytes' ELSE regexp_replace(regexp_replace(printf('%.2f', size / pow(1024.0, k)), '0+$', ''), '\\.$', '')
    || ' ' || ['Bytes', 'KB', 'MB', 'GB'][k + 1] END AS size FROM u""")
def _(spark, d):
    return M.documents(spark, d).select("doc_id", T.human_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("fn9_generation_prompt", """SELECT doc_id, 'Write 5 varied quiz questions at ' || CASE WHEN n_chars > 1000 THEN 'hard' ELSE 'easy' END
    || ' difficulty level about the content below.' || chr(10) || 'Allowed question types: true_false' || chr(10) || 'Content:' || chr(10) || text
    || chr(10) || 'Answer with a JSON array of objects with the keys "question", "type", "answer", "options", "explanation", "confidence".' AS prompt FROM documents""")
def _(spark, d):
    level = F.when(F.col("n_chars") > 1000, "hard").otherwise("easy")
    return M.documents(spark, d).select("doc_id", T.generation_prompt(F.col("text"), 5, ["true_false"], level).alias("prompt"))


@query("fn10_fn12_ages", f"""WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, date_diff('microsecond', l_shipdate, TIMESTAMP '{AS_OF_ANSWERS}') / 86400000000.0 AS days FROM lineitem),
    c AS (SELECT *, CAST(ceil(abs(days)) AS BIGINT) AS k FROM a)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(days) AS BIGINT) AS days, CASE WHEN k = 1 THEN 'Today' WHEN k = 2 THEN 'Yesterday' WHEN k <= 7 THEN (k - 1) || ' days ago'
    WHEN k <= 30 THEN CAST(ceil(k / 7) AS BIGINT) || ' weeks ago' ELSE CAST(ceil(k / 30) AS BIGINT) || ' months ago' END AS age FROM c""")
def _(spark, d):
    at, now = F.col("l_shipdate"), ntz(AS_OF_ANSWERS)
    return M.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.days_between(now, at).alias("days"), S.age_bucket(at, now).alias("age")
    )


@query("fn16_json_metadata", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return M.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


RESPONSE = """'Here you go: [{"question": "What is ' || {id} || '?", "answer": "{a}"}, {"question": "Second?", "answer": "b", "type": "true_false", "confidence": 0.9}, {"type": "x"}] done'"""


@query("fn17_parse_questions", """WITH q AS (SELECT o_orderkey, unnest([1, 2]) AS position FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT o_orderkey AS question_id, position, CASE position WHEN 1 THEN 'What is ' || o_orderkey || '?' ELSE 'Second?' END AS question,
    CASE position WHEN 1 THEN 'multiple_choice' ELSE 'true_false' END AS type, CASE position WHEN 1 THEN 0.8 ELSE 0.9 END AS confidence FROM q""")
def _(spark, d):
    k = F.col("o_orderkey")
    good = F.format_string(
        'Here you go: [{"question": "What is %d?", "answer": "a"}, {"question": "Second?", "answer": "b", "type": "true_false", "confidence": 0.9}, {"type": "x"}] done', k
    )
    response = F.when(k % 5 == 0, '{"invalid": json}').otherwise(good)
    parsed = M.table(spark, d, "orders").select(k.alias("question_id"), F.posexplode(T.parse_questions(response)).alias("i", "q"))
    return parsed.select("question_id", (F.col("i") + 1).alias("position"), "q.question", "q.type", "q.confidence")


@query("fn18_hashes", "SELECT doc_id, md5(text) AS md5, substr(sha256(source || ':' || lower(trim(text))), 1, 32) AS sha FROM documents")
def _(spark, d):
    return M.documents(spark, d).select("doc_id", F.md5("text").alias("md5"), F.substring(F.sha2(F.concat("source", F.lit(":"), F.lower(F.trim("text"))), 256), 1, 32).alias("sha"))


@query("fn20_quality_range", sql_with("answers", "SELECT quality, quality BETWEEN 0 AND 5 AS valid, count(*) AS answers FROM answers GROUP BY 1, 2"))
def _(spark, d):
    return M.answers(spark, d).groupBy("quality", F.col("quality").between(0, 5).alias("valid")).agg(F.count("*").alias("answers"))


@query("fn21_stop_words", f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]{{2,}})'), lambda t: t NOT IN ({STOP})), ' ') AS content_words FROM documents""")
def _(spark, d):
    toks = F.filter(T.word_tokens(F.col("text")), lambda t: ~t.isin(T.ENGLISH_STOP_WORDS))
    return M.documents(spark, d).select("doc_id", F.array_join(toks, " ").alias("content_words"))
