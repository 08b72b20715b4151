"""Hand-checked small cases of every rule."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tutorloom.functions import study as S
from tutorloom.functions import text as T
from tutorloom.functions import vectors as VF
from tutorloom.operators import dedup, documents, generation, graph, learning, maintain, search, spaced, topics
from tutorloom.operators import lookups as K
from tutorloom.operators import vectors as V
from tutorloom.sources import corpus


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def ts(text):
    return dt.datetime.fromisoformat(text)


# --- text ---------------------------------------------------------------------------------------------


def test_clean(spark):
    assert one(spark, T.clean_text(F.col("t")), t="See <b>HTTP</b> https://x.y/z  a@b.co Now") == "see http now"
    assert one(spark, T.clean_text(F.col("t")), t="A B C　D") == "a b c d"


@pytest.mark.parametrize(
    "text, reason",
    [
        (" ".join(["w"] * 9), "too_short"),
        (" ".join(["w"] * 10), "quality"),
        (" ".join(["w"] * 9 + ["x" * 51]), "long_words"),
        (" ".join(["w"] * 4 + ["1"] * 6), "too_many_numbers"),
    ],
)
def test_quality(spark, text, reason):
    assert one(spark, T.quality_reason(F.col("t")), t=text) == reason


def test_quality_label(spark):
    assert one(spark, T.quality_label(F.col("t")), t="one two three") == "too_short_3_words"


def test_language(spark):
    assert one(spark, T.detect_language(F.col("t")), t="Der Hund und die Katze sind nicht hier") == "de"
    assert one(spark, T.detect_language(F.col("t")), t="zzz qqq") == "unknown"


def test_title_and_sizes(spark):
    assert one(spark, T.title_case(F.col("t")), t="don't stop-me now") == "Don'T Stop-Me Now"
    assert one(spark, T.human_size(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, T.human_size(F.col("n")), n=0) == "0 Bytes"
    assert one(spark, T.percent_text(F.col("n"), 1), n=0.1) == "10.0%"
    assert one(spark, T.file_kind(F.col("p")), p="a/b.PY") == "code"


def test_generator_response(spark):
    good = 'Sure [{"question": "q", "answer": "a", "confidence": 0.9}] bye'
    got = one(spark, T.parse_questions(F.col("t")), t=good)
    assert len(got) == 1 and got[0]["confidence"] == 0.9 and got[0]["type"] == "multiple_choice"
    for bad in ("no list in here", '[{"question": "unfinished'):
        assert one(spark, T.parse_questions(F.col("t")), t=bad) == []


def test_topic_input(spark):
    assert one(spark, T.topic_input(F.col("t")), t="one  two three.") == "one two three."
    assert one(spark, T.topic_input(F.col("t")), t="two words") is None
    assert one(spark, T.topic_input(F.col("t")), t="### ### ### a b") is None


# --- study rules -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "ease, interval, count, quality, new_ease, new_interval",
    [(2.5, 1, 0, 5, 2.6, 1), (2.6, 1, 1, 4, 2.6, 6), (2.68, 6, 2, 3, 2.58, 16), (2.5, 10, 3, 2, 2.3, 1), (1.4, 1, 0, 2, 1.3, 1), (2.9, 1, 0, 5, 3.0, 1)],
)
def test_repetition_step(spark, ease, interval, count, quality, new_ease, new_interval):
    df = spark.createDataFrame([(ease, interval, count, quality)], "ease_factor double, interval_days int, review_count int, quality int")
    row = spaced.step(df).first()
    assert row["new_ease"] == pytest.approx(new_ease) and row["new_interval"] == new_interval


def test_weakness_and_adaptive(spark):
    q = spark.createDataFrame([(1, 1, "Q", "mc", "medium", 4)], "id long, file_id long, question_text string, question_type string, difficulty string, times_asked int")
    a = spark.createDataFrame([(i, 1, i == 0, 10, ts("2024-01-01")) for i in range(4)], "id long, question_id long, is_correct boolean, time_taken int, created_at timestamp")
    got = learning.weak_areas(q, a, F.lit("2024-01-15").cast("timestamp")).first()
    assert got["weakness"] == pytest.approx(1.025)
    score = S.adaptive_score(F.lit(4), F.lit(1), F.lit("hard"), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-08").cast("timestamp"))
    assert one(spark, score) == pytest.approx(4.5)


def test_question_accuracy(spark):
    f = spark.createDataFrame([(1, 7)], "id long, workspace_id long")
    q = spark.createDataFrame([(1, 1, 5, 3), (2, 1, 0, 0), (3, 1, 10, 8)], "id long, file_id long, times_asked long, times_correct long")
    got = learning.question_stats(q, f).first()
    assert (got["total_questions"], got["total_attempts"]) == (3, 15) and got["avg_accuracy"] == pytest.approx(0.4666666667)


def test_progress_and_streaks(spark):
    days = ["2023-01-01", "2023-01-02", "2023-01-02", "2023-01-03", "2023-01-05"]
    p = spark.createDataFrame([(1, "quiz_completed", ts(d + "T10:00")) for d in days] + [(1, "quiz_started", ts("2023-01-02T11:00"))], "workspace_id long, action_type string, timestamp timestamp")
    d = learning.study_days(p)
    today = F.to_date(F.lit("2023-01-05"))
    assert d.count() == 4
    assert learning.current_streak(d, today).first()["study_streak"] == 4
    assert learning.current_streak(d, today, max_gap_days=1).first()["study_streak"] == 1
    assert learning.longest_streak(d).first()["longest_streak"] == 3
    assert learning.progress_stats(p).first()["study_sessions"] == 1


def test_replay_matches_sequential_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for q in range(30):
        n = 4000 if q == 11 else rng.randint(1, 40)  # one question holds most of the ratings
        state, start = spaced.NEW, ts("2020-01-01")
        for i in range(n):
            quality = rng.choice([2, 3, 3, 4, 5, 5]) if q % 2 else rng.choice([3, 4])
            rows.append((q, quality, start + dt.timedelta(hours=i), i))
            state = spaced.fold_rating(state, quality)
        want[q] = (state[0] / 10, state[1], state[2])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "question_id long, quality int, created_at timestamp, id long").repartition(5)
    for slices in (1, 7):
        got = {r["question_id"]: (r["ease_factor"], r["interval_days"], r["review_count"]) for r in spaced.replay(df, slices).collect()}
        assert got == want
    three = spark.createDataFrame([(1, q, ts("2020-01-01") + dt.timedelta(days=i), i) for i, q in enumerate((5, 4, 3))], "question_id long, quality int, created_at timestamp, id long")
    r = spaced.replay(three).first()
    assert (r["ease_factor"], r["interval_days"], r["review_count"]) == (2.5, 16, 3)


def test_recommendations_and_paths(spark):
    areas = spark.createDataFrame([(1, "a", "A", 0.5, 0.1, 2), (1, "b", "B", 0.9, 0.4, 3), (1, "c", "C", 0.9, 0.9, 4)], "workspace_id long, topic_area_id string, name string, coverage_score double, explored_percentage double, concept_count long")
    got = {r["topic_area_id"]: (r["recommendation_type"], r["priority_score"]) for r in graph.recommendations(areas).collect()}
    assert got == {"a": ("concept_gap", 0.72), "b": ("quiz_performance", 0.7)}
    paths = {r["learning_path_id"]: (r["estimated_hours"], r["difficulty_level"]) for r in graph.learning_paths(areas).collect()}
    assert paths["path_1_comprehensive"] == (18, "advanced") and paths["path_1_focused_0"] == (12, "intermediate")


# --- search, folders, sources --------------------------------------------------------------------------------


def test_search(spark):
    files = spark.createDataFrame([("a.txt", "Plums are blue.\r\nBLUE plums, too.\nPears are green."), ("node_modules/b.txt", "blue")], "path string, content string")
    got = search.search_lines(files, "blue").collect()
    assert [(r["path"], r["line"]) for r in got] == [("a.txt", 1), ("a.txt", 2)]
    with pytest.raises(ValueError):
        search.search_lines(files, "  ")


def test_tree_filter(spark):
    files = spark.createDataFrame([("src/app/main.py",), ("src/lib/x.js",), ("docs/readme.md",), (".git/config",)], "path string")
    nodes = K.path_nodes(files)
    assert {r["path"] for r in K.filter_tree(nodes, "MAIN").collect()} == {"src", "src/app", "src/app/main.py"}
    listing = [(r["parent"], r["name"]) for r in K.folder_tree(files).collect()]
    assert listing[0] == ("", "docs") and (".git", "config") not in listing


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.txt").write_text("First part.\n\nSecond part.")
    (tmp_path / "sub" / "b.md").write_text("line one\nline two")
    (tmp_path / "c.json").write_text('[{"content": "from json"}, "plain", {"other": 1}]')
    (tmp_path / "d.csv").write_text('id,body\n1,"hello, csv"\n2,again\n')
    (tmp_path / "e.bin").write_bytes(b"\x00\x01")
    (tmp_path / "f.dat2").write_bytes(b"abc\x00def")
    (tmp_path / "node_modules" / "g.txt").write_text("vendor")
    (tmp_path / ".hidden.txt").write_text("hidden")
    docs = corpus.load_documents(corpus.scan_folder(spark, str(tmp_path)))
    got = sorted((r["file_name"], r["text"]) for r in docs.collect())
    assert got == [
        ("a.txt", "First part."), ("a.txt", "Second part."), ("b.md", "line one"), ("b.md", "line two"),
        ("c.json", "from json"), ("c.json", "plain"), ("c.json", '{"other":1}'), ("d.csv", "again"), ("d.csv", "hello, csv"),
    ]
    assert corpus.load_file(spark, str(tmp_path / "c.json")).count() == 3
    assert corpus.read_csv_documents(spark, str(tmp_path / "d.csv")).count() == 2
    nested = spark.createDataFrame([('{"documents": ["a", "b"]}',), ('{"title": 1, "text": "t"}',), ("not json",)], "c string")
    assert [r["x"] for r in nested.select(corpus.json_documents(F.col("c")).alias("x")).collect()] == [["a", "b"], ["t"], []]


# --- change detection -------------------------------------------------------------------------------------------


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    changed = maintain.changes(now, old)
    assert {r["path"]: r["change"] for r in changed.collect()} == {"a": "unchanged", "b": "modified", "d": "new", "c": "deleted"}
    assert maintain.change_counts(changed).first()["total_new_modified"] == 2
    assert maintain.needs_reindex(changed).first()["reindex"] is True


# --- near duplicates against the quadratic rule ------------------------------------------------------------------------


def brute_force(texts, threshold=0.95, max_terms=1000):
    import re

    grams = []
    for t in texts:
        toks = [w for w in re.findall(r"\w{2,}", t.lower()) if w not in T.ENGLISH_STOP_WORDS]
        grams.append(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])])
    counts: dict[str, int] = {}
    for w in itertools.chain.from_iterable(grams):
        counts[w] = counts.get(w, 0) + 1
    vocab = sorted(counts, key=lambda w: (-counts[w], w))[: min(max_terms, len(texts) // 2)]
    at = {w: i for i, w in enumerate(vocab)}
    m = np.zeros((len(texts), len(vocab)))
    for i, g in enumerate(grams):
        for w in g:
            if w in at:
                m[i, at[w]] += 1
    m *= np.log((1 + len(texts)) / (1 + (m > 0).sum(0))) + 1
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    sim, removed = m @ m.T, set()
    for i in range(len(texts)):
        if any(j not in removed and sim[i, j] > threshold for j in range(i)):
            removed.add(i)
    return removed


def corpus_with_copies(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(n)]
    hot = base[0] + " " + base[1] + " " + base[2]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:  # a third of the corpus are near copies of one text
            ws = hot.split()
            for _ in range(rng.randint(0, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(words)
            out.append(" ".join(ws))
        elif kind < 0.45:
            out.append(rng.choice(base))
        else:
            out.append(base[i])
    return out + ["", "the and of"]


@pytest.mark.parametrize("seed, budget", [(1, 500), (2, 0), (3, 0)])
def test_near_duplicates(spark, seed, budget, monkeypatch):
    monkeypatch.setattr(dedup, "PAIR_BUDGET", budget or 1e-9)
    monkeypatch.setattr(dedup, "BLOCK", 16 if budget == 0 else 32_768)
    texts = corpus_with_copies(150, seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in dedup.near_duplicates(df, "doc_id", "text").collect()}
    assert got == brute_force(texts)


def test_prepare_keeps_lineage(spark):
    long = "the cat and the dog were with the children in the big house for a day"
    rows = [(1, "x.txt", long), (2, "y.txt", long.upper()), (3, "z.txt", "short"), (4, "w.txt", "der hund und die katze sind nicht in dem haus mit den kindern auf der strasse")]
    kept, stats = documents.prepare(spark.createDataFrame(rows, "doc_id long, file string, text string"))
    assert [(r["doc_id"], r["file"]) for r in kept.collect()] == [(1, "x.txt")]
    s = stats.first()
    assert (s["input_documents"], s["removed_by_quality"], s["removed_by_language"], s["removed_as_duplicates"], s["final_documents"]) == (4, 1, 1, 1, 1)


# --- vectors and clusters -------------------------------------------------------------------------------------------------


def blobs(seed=0, groups=6, per=20, dims=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims))
    rows = []
    for i in range(groups * per):
        rows.append((i, 1.0, [float(x) for x in centers[i % groups] + 0.15 * rng.normal(size=dims)]))
    return rows


def test_vector_search_and_cosine(spark):
    rows = blobs()
    df = spark.createDataFrame(rows, "id long, relevance double, embedding array<float>")
    m = V.unit_rows([r[2] for r in rows])
    got = [(r["query_id"], r["id"]) for r in V.top_k(df, df.filter("id < 3"), 4).orderBy("query_id", "position").collect()]
    want = [(q, int(i)) for q in range(3) for i in np.argsort(-(m @ m[q]), kind="stable")[:4]]
    assert got == want
    assert [r["id"] for r in V.search(df, list(rows[0][2]), 4).collect()] == [i for _, i in want[:4]]
    assert one(spark, VF.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0


def test_leaders_follow_the_sequential_rule(spark):
    rows = blobs(1)
    m = V.unit_rows([r[2] for r in rows])
    want: list[int] = []
    for i in range(len(rows)):
        if not want or (m[want] @ m[i]).max() <= 0.9:
            want.append(i)
    df = spark.createDataFrame(rows, "id long, relevance double, embedding array<float>").repartition(4)
    for batch in (3, 512):
        assert sorted(r["id"] for r in V.leaders(df, 0.9, [F.col("id")], batch=batch).collect()) == want


def test_clusters_recover_groups(spark):
    df = spark.createDataFrame(blobs(2), "id long, relevance double, embedding array<float>")
    member = topics.threshold_clusters(df, 0.6, 3)
    groups = member.groupBy("cluster").agg(F.collect_set(F.col("id") % 6).alias("g"), F.count("*").alias("n")).collect()
    assert len(groups) == 6 and all(len(r["g"]) == 1 and r["n"] == 20 for r in groups)
    assert topics.merge_clusters(df, member, 4).select("cluster").distinct().count() == 4
    dense = topics.density_clusters(df, 0.8, 0.7, 5)
    assert dense.count() == 120 and dense.filter("topic_id >= 0").select("topic_id").distinct().count() == 6
    for method in ("embedding", "density", "hybrid"):
        docs = df.withColumnRenamed("id", "doc_id")
        assert topics.extract_topics(docs, method).count() == 120


def test_merge_folds_the_smallest_into_the_nearest(spark, monkeypatch):
    vec = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    rows, member, k = [], [], 0
    for c, (v, n) in enumerate(zip(vec, (5, 3, 4))):
        for _ in range(n):
            rows.append((k, v))
            member.append((k, c))
            k += 1
    df, mem = spark.createDataFrame(rows, "id long, embedding array<float>"), spark.createDataFrame(member, "id long, cluster long")
    for limit in (2000, 2):  # in one go, and one merge per job
        monkeypatch.setattr(topics, "MAX_DRIVER_CLUSTERS", limit)
        got = {r["cluster"]: r["count"] for r in topics.merge_clusters(df, mem, 2).groupBy("cluster").count().collect()}
        assert got == {0: 8, 2: 4}


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(9, 10)], "a long, b long")
    got = {r["id"]: r["component"] for r in V.components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(8)}, 8: 8, 9: 9, 10: 9, 11: 11}


def test_topic_overlap_labels(spark):
    words = spark.createDataFrame([(0, w, 1.0, i + 1) for i, w in enumerate("abcd")] + [(1, w, 1.0, i + 1) for i, w in enumerate("bcde")], "topic_id int, term string, score double, position int")
    sizes = spark.createDataFrame([(0, 9), (1, 5)], "topic_id int, count long")
    got = {(r["source_id"], r["target_id"]): (r["type"], r["weight"]) for r in graph.word_overlap_edges(words, sizes).collect()}
    assert got == {("topic_0", "topic_1"): ("subtopic_of", pytest.approx(0.6)), ("topic_1", "topic_0"): ("relates_to", pytest.approx(0.6))}


def test_adapted_parameters():
    assert topics.adapted_parameters(40)["min_size"] == 4
    assert topics.adapted_parameters(5)["min_size"] == 2
    assert topics.adapted_parameters(5000)["min_df"] == 5


def test_prepare_folder(spark, tmp_path):
    text = "the cat and the dog were with the children in the big house for a day"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.md").write_text(text + "\n\nshort")
    got = documents.prepare_folder(spark, str(tmp_path))
    assert [r["file_name"] for r in got["documents"].collect()] == ["a.txt"]  # the first by path
    s = got["stats"].first()
    assert (s["input_documents"], s["removed_by_quality"], s["removed_as_duplicates"]) == (3, 1, 1)
    assert got["config"].first()["min_words"] == 10
    assert {r["extension"]: r["files"] for r in got["extensions"].collect()} == {".txt": 1, ".md": 1}


def test_generation_hooks(spark):
    areas = spark.createDataFrame([(1, "a", "A", "x"), (1, "b", "B", "y"), (1, "c", "C", "z")], "workspace_id long, topic_area_id string, name string, description string")
    reply = lambda ask: F.when(ask.contains("Topic 1: A") & ask.contains("Topic 2: B"), '{"relationship_type": "contains", "direction": "topic2_to_topic1"}').otherwise("no idea")
    got = generation.judge_relationships(areas, reply).collect()
    assert [(r["source_topic_id"], r["target_topic_id"], r["strength"]) for r in got] == [("b", "a", 0.5)]


def test_collection_and_reembedding(spark):
    base = spark.createDataFrame([("t1", "m", [1.0]), ("t2", "m", [2.0])], "topic_id string, model string, embedding array<float>")
    new = spark.createDataFrame([("t2", "m", [3.0]), ("t3", "m", [4.0])], base.schema)
    out = {r["topic_id"]: r["embedding"][0] for r in topics.upsert_vectors(base, new).collect()}
    assert out == {"t1": 1.0, "t2": 3.0, "t3": 4.0}
    again = topics.reembed(base.withColumn("text", F.col("topic_id")), lambda d: d.withColumn("embedding", F.array(F.length("text").cast("float"))), "n")
    assert {r["model"] for r in again.collect()} == {"n"}


# --- cases where rows used to be lost ------------------------------------------------------------------------


def test_relationship_candidates_lose_no_topic(spark):
    topics_of = [(1, f"t{k:02d}", f"Topic {'even' if k % 2 == 0 else 'odd'}" if k < 48 else f"single{k}") for k in range(50)]
    areas = spark.createDataFrame(topics_of + [(2, "x", "Topic")], "workspace_id long, topic_area_id string, name string")
    got = {(r["source_topic_id"], r["target_topic_id"]) for r in graph.relationship_candidates(areas).collect()}
    assert len([p for p in got if p[0] < "t48" and p[1] < "t48"]) == 48 * 47 // 2  # all share the word "topic"
    assert ("t48", "t49") in got and not any("x" in p for p in got)
    evidence = spark.createDataFrame([("t00", "f"), ("t45", "f"), ("t46", "g")], "topic_area_id string, evidence string")
    some = {(r["source_topic_id"], r["target_topic_id"]) for r in graph.relationship_candidates(areas, evidence).collect()}
    assert ("t00", "t45") in some and {t for p in some for t in p} == {f"t{k:02d}" for k in range(50)}


def test_pair_upsert_of_both_directions(spark):
    fields = "relationship_id string, source_topic_id string, target_topic_id string, relationship_type string, strength double, reasoning string"
    stored = spark.createDataFrame([("r1", "a", "b", "old", 0.1, "")], fields)
    new = spark.createDataFrame([("r2", "a", "b", "first", 0.2, ""), ("r3", "b", "a", "second", 0.3, ""), ("r4", "d", "c", "x", 0.4, ""), ("r5", "c", "d", "y", 0.5, "")], fields)
    got = sorted((r["relationship_id"], r["source_topic_id"], r["relationship_type"]) for r in maintain.upsert_relationships(stored, new).collect())
    assert got == [("r1", "a", "second"), ("r5", "c", "y")]


def test_folder_keeps_cut_characters_large_files_and_long_fields(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 1023 + "é" + "y" * 50)
    (tmp_path / "b.csv").write_text('text\n"' + "long " * 40_000 + '"\n')
    (tmp_path / "c.txt").write_bytes(b"x" * 100 + b"\xff" * 3)
    files = corpus.scan_folder(spark, str(tmp_path), test="utf8")
    assert {r["name"] for r in files.select("name").collect()} == {"a.txt", "b.csv"}
    assert max(r["document_length"] for r in corpus.load_documents(files).collect()) == 40_000 * 5 - 1
    assert {r["name"] for r in corpus.scan_folder(spark, str(tmp_path), max_bytes=10_000).select("name").collect()} == {"a.txt", "c.txt"}
    assert [r["relative_path"] for r in corpus.oversized_files(spark, str(tmp_path), 10_000).collect()] == ["b.csv"]


def test_long_intervals_stay_in_the_calendar(spark):
    state = spark.createDataFrame([(1, 3.0, 2_500_000, 9, dt.datetime(2024, 1, 1))], "question_id long, ease_factor double, interval_days int, review_count int, next_review timestamp_ntz")
    ratings = spark.createDataFrame([(1, 5)], "question_id long, quality int")
    row = spaced.apply_ratings(state, ratings, F.lit("2024-01-01").cast("timestamp_ntz")).first()
    assert row["interval_days"] == spaced.MAX_INTERVAL
    again = spaced.apply_ratings(spaced.apply_ratings(state, ratings, F.lit("2024-01-01").cast("timestamp_ntz")), ratings, F.lit("2024-01-01").cast("timestamp_ntz")).first()
    assert again["next_review"] == dt.datetime(9999, 12, 31, 23, 59, 59)
