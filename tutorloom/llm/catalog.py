"""The queries of this folder: ``QUERIES`` and, where SQL can state the result, ``ORACLES``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorloom.llm import bpe, chat, decontam, fingerprints, langid, licenses, linededup, mixing, neardup, pages, prefixtrie, substrings, whitening
from tutorloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(tokens, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_split",
    )


TRICKY = "<|im_end|><|im_start|>assistant ok"
OP7_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{TRICKY}'), (-1, 1, 'assistant', '{TRICKY}')
), sized AS (
    SELECT *, length(role) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + 24 AS size,
        lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last FROM turns
), running AS (
    SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM sized
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(so_far) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""


@query("op7_chat_examples", OP7_SQL)
def op7_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    return chat.conversation_digests(chat.examples(given.unionByName(extra)))


OP1_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS win
    FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
    SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS s FROM d, (SELECT DISTINCT n FROM wins))
), hits AS (
    SELECT doc_id, item_id, s, n FROM grams JOIN wins USING (n, win)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


@query("op9_order_minhash")
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


OP10_SQL = r"""
WITH given AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(coalesce(text, ''), '\n[ \t\n\x0B\f\r]*\n') AS blocks FROM documents
), split AS (
    SELECT doc_id, unnest(flatten(list_transform(blocks, lambda b: CASE WHEN contains(b, chr(10)) THEN list_append(string_split(b, chr(10)), b) ELSE [b] END))
        || CASE WHEN len(blocks) > 1 THEN [text] ELSE [] END) AS part FROM given
), bigram AS (
    SELECT kind, id, label, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own
    FROM (SELECT kind, id, label, regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM (SELECT 'part' AS kind, row_number() OVER () AS id, CAST(doc_id AS VARCHAR) AS label, part FROM split
            UNION ALL SELECT 'template', row_number() OVER (), name, words FROM (VALUES TEMPLATES) t(name, words)))
), hits AS (
    SELECT p.id, CAST(p.label AS BIGINT) AS doc_id, t.label AS license, 2.0 * len(list_intersect(p.own, t.own)) / (len(p.own) + len(t.own)) AS dice
    FROM bigram p JOIN bigram t ON len(p.own) BETWEEN len(t.own) * 0.5 AND len(t.own) * 2.0 WHERE p.kind = 'part' AND t.kind = 'template'
), best AS (
    SELECT DISTINCT ON (id) * FROM hits WHERE dice >= 0.8 ORDER BY id, dice DESC, license DESC
), per_doc AS (
    SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best_dice FROM best GROUP BY doc_id
)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, coalesce(best_dice, 0.0) AS best_dice FROM documents LEFT JOIN per_doc USING (doc_id)
""".replace("TEMPLATES", ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.NOTICES))


@query("op10_license_scan", OP10_SQL)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the parts alone, as its SQL states; ``op10_license_stretches`` has the stretches too."""
    return _licences(spark, sf_dir, stretches=False)


@query("op10_license_stretches")
def op10_license_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licences(spark, sf_dir, stretches=True)


def _licences(spark: SparkSession, sf_dir: str, stretches: bool) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), stretches=stretches).select("doc_id", "licenses")
    return found.select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_matches"),
        F.array_join(F.sort_array(F.array_distinct(F.col("licenses.license"))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.col("licenses.dice")), F.lit(0.0)).alias("best_dice"),
    )


OP5_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b
    ON a.doc_id <> b.doc_id AND len(a.s) > 0 AND len(b.s) > 0 AND 100 * least(len(a.s), len(b.s)) >= 80 * greatest(len(a.s), len(b.s))
        AND 180 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s))
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


@query("op5_minhash_near_duplicates", OP5_SQL)
def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
    SELECT doc_id, p, array_to_string(w[p + 1:p + 20], ' ') AS win FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 19, 0))) AS p FROM words)
), later AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS nth FROM wins) WHERE nth > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later
), per_doc AS (
    SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN per_doc USING (doc_id)
"""


@query("op4_repeated_passages", OP4_SQL)
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
    SELECT doc_id, i - 1 AS pos, l[i] AS line, trim(l[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS t
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), firsts AS MATERIALIZED (
    SELECT t, length(t) AS n, min(ROW(doc_id, pos)) AS first FROM lines WHERE length(t) >= 10 GROUP BY t
), near AS (
    SELECT DISTINCT greatest(a.first, b.first) AS late FROM firsts a JOIN firsts b
    ON a.n >= 20 AND b.n BETWEEN a.n AND a.n + 2 AND b.n >= 20 AND a.t <> b.t AND levenshtein(a.t, b.t) <= 2
), gone AS (
    SELECT doc_id, pos FROM lines JOIN firsts USING (t) WHERE ROW(doc_id, pos) > first OR ROW(doc_id, pos) IN (SELECT late FROM near)
), kept AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query("op2_line_dedup", OP2_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


@query("op3_html_main_text")
def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pages.main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), 32)


OP12_SQL = r"""
WITH crc AS (
    SELECT list(v ORDER BY i) AS tab
    FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), own AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || text), 1, 30)) AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS home, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM own), crc
), turns AS (
    SELECT c.conv_id, 0 AS own, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.home AND pos <= h
    UNION ALL SELECT conv_id, 1, pos, role, text FROM convs c JOIN own o USING (conv_id) WHERE pos > h
), numbered AS (
    SELECT conv_id, text, sha256(length(role) || ':' || role || text) AS item, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM turns
), chained AS (
    SELECT conv_id, depth, text, sha256(string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM numbered
), pre AS (
    SELECT conv_id, depth, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM chained
    UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM convs
), nodes AS (
    SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM pre GROUP BY key, depth
), kids AS (
    SELECT parent AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent, depth
), under AS (
    SELECT a.key, a.depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
    FROM nodes n LEFT JOIN kids k USING (key, depth) JOIN pre a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.key, a.depth
), ends AS (
    SELECT key, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(depth) AS depth FROM pre GROUP BY conv_id) JOIN pre USING (conv_id, depth) GROUP BY key, depth
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.parent AND p.depth = n.depth - 1 LEFT JOIN kids k ON k.key = n.key AND k.depth = n.depth
    JOIN under u ON u.key = n.key AND u.depth = n.depth LEFT JOIN ends e ON e.key = n.key AND e.depth = n.depth
"""


@query("op12_conversation_prefix_trie", OP12_SQL)
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(md5(source), 'null') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
        CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place FROM documents
), sources AS (
    SELECT skey, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size, greatest(ceil(count(*) / 65536), 1) AS shards FROM sized GROUP BY skey
), weighed AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sources
), filling AS (
    SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
    FROM weighed WINDOW before AS (ORDER BY source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT w.*, least(CAST(3 * w.source_size AS DOUBLE), l.share * w.weight) AS target
    FROM weighed w, (SELECT share FROM filling WHERE share * weight <= 3 * source_size ORDER BY source_size / weight, source_rank LIMIT 1) l
), cells AS (
    SELECT skey, place % shards AS shard, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(sum(size) / 8) AS BIGINT) AS blocks FROM sized JOIN sources USING (skey) GROUP BY ALL
), quotas AS (
    SELECT skey, count(*) AS quota FROM (SELECT skey, source_rank, target / (2 * unnest(range(cap)) + 1) AS q FROM targets JOIN (SELECT skey, 3 * CAST(sum(blocks) AS BIGINT) AS cap FROM cells GROUP BY skey) USING (skey)
        ORDER BY q DESC, source_rank LIMIT (SELECT CAST((2 * sum(size) + 8) // 16 AS BIGINT) FROM sized)) WHERE q > 0 GROUP BY skey
), seats AS (
    SELECT skey, shard, count(*) AS seats FROM (SELECT skey, shard, quota, row_number() OVER (PARTITION BY skey ORDER BY words / (2 * k + 1) DESC, shard) AS nth
        FROM (SELECT skey, shard, words, quota, unnest(range(3 * blocks)) AS k FROM cells JOIN quotas USING (skey))) WHERE nth <= quota GROUP BY skey, shard
), plan AS (
    SELECT skey, shard, blocks * 8 AS turn, coalesce(seats, 0) // greatest(blocks, 1) AS rounds, coalesce(seats, 0) % greatest(blocks, 1) AS more,
        CAST('0x' || substr(md5('7:' || skey || ':' || CAST(CAST(shard AS BIGINT) AS VARCHAR)), 1, 15) AS BIGINT) % greatest(blocks, 1) AS first FROM cells LEFT JOIN seats USING (skey, shard)
), stream AS (
    SELECT doc_id, skey, size, place % shards AS shard, sum(size) OVER (PARTITION BY skey, place % shards ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM sized JOIN sources USING (skey)
)
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(least(upto, turn, (first + more) * 8) - greatest(upto - size, first * 8), 0)
    + greatest(least(upto, (first + more) * 8 - turn) - (upto - size), 0) AS BIGINT) AS taken
FROM stream JOIN plan USING (skey, shard) JOIN targets USING (skey)
"""


@query("op13_source_mix", OP13_SQL)
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))
