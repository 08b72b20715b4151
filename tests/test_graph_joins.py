"""Keyword windows and overlap edges against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tutorloom.operators import graph


def plain_windows(docs, keywords, window=3, limit=200):
    out = {}
    for doc, text in docs:
        ss = [s for s in (p.strip() for p in text.split(".")) if s]
        for i, s in enumerate(ss):
            for topic, word in keywords:
                if word.lower() in s.lower():
                    context = ". ".join(ss[max(0, i - window) : i + window + 1])
                    out.setdefault((topic, doc, i), [set(), context if len(context) <= limit else context[:limit] + "..."])[0].add(word)
    return {k: (sorted(v[0]), v[1]) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_plain_search(spark, seed):
    r = random.Random(seed)
    syllables = ["ar", "ta", "Kle", "éç", "n", "to", "x9", "ri"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    docs = [(i, "".join(word() + r.choice([" ", " ", " ", "  ", "\n", ". ", "."]) for _ in range(r.randint(0, 60)))) for i in range(60)]
    docs.append((60, "start " + "Ar ta" * 5000))  # one long sentence
    keywords = {(0, "ar"), (0, "n"), (1, "é"), (1, "ta kle"), (2, "TA"), (2, "to ri ar"), (3, "r t"), (3, "nowhere"), (4, "ar  ta")} | {(r.randint(0, 4), word() + r.choice(["", " " + word()])) for _ in range(30)}
    got = graph.context_windows(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(sorted(keywords), "topic_id int, keyword string")
    ).collect()
    assert {(x["topic_id"], x["doc_id"], x["sentence_index"]): (x["keywords"], x["context"]) for x in got} == plain_windows(docs, sorted(keywords))
    assert len(got) > 100


def test_windows_without_keywords(spark):
    docs = spark.createDataFrame([(1, "a b. c"), (2, None), (3, "")], "doc_id long, text string")
    empty = spark.createDataFrame([], "topic_id int, keyword string")
    assert graph.context_windows(docs, empty).count() == 0
    assert graph.context_windows(docs, spark.createDataFrame([(0, "")], "topic_id int, keyword string")).count() == 0


@pytest.mark.parametrize("minimum", [0.05, 0.3, 0.5, 0.9])
def test_overlap_edges_equal_all_pairs(spark, minimum):
    r = random.Random(7)
    lists = {t: ["everywhere", *r.sample([f"w{i}" for i in range(18 if t % 3 else 200)], r.randint(0, 9))] for t in range(40)}
    lists[40], lists[41] = list(lists[0]), list(lists[0])
    for ws in lists.values():
        r.shuffle(ws)
    words = spark.createDataFrame([(t, w, 1.0, i + 1) for t, ws in lists.items() for i, w in enumerate(ws)], "topic_id int, term string, score double, position int")
    count = {t: r.randint(1, 5) for t in lists}
    got = {(x["source_id"], x["target_id"]): (x["type"], round(x["weight"], 9)) for x in graph.word_overlap_edges(words, spark.createDataFrame(list(count.items()), "topic_id int, count long"), minimum).collect()}
    want = {}
    for a in lists:
        for b in lists:
            share = len(set(lists[a]) & set(lists[b])) / len(set(lists[a]) | set(lists[b]))
            if a != b and share > minimum:
                want[f"topic_{a}", f"topic_{b}"] = ("subtopic_of" if count[a] > count[b] else "relates_to", round(share, 9))
    assert got == want


def test_a_word_of_all_topics_makes_no_pairs(spark):
    rows = [(t, w, 1.0, i + 1) for t in range(300) for i, w in enumerate(["topic", *(f"own{t}_{k}" for k in range(9))])]
    words = spark.createDataFrame(rows, "topic_id int, term string, score double, position int")
    edges = graph.word_overlap_edges(words, words.selectExpr("topic_id", "1L AS count").distinct())
    assert edges.count() == 0


def test_search_writes_only_documents_that_hold_a_gram(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "write_step", lambda df, name, write=graph.write_step: (written.append(made := write(df, name)), made)[1])
    docs = [(i, ". ".join(f"seagreen{i} reenact{i} greenish{k}" for k in range(20))) for i in range(300)] + [(300, "The greensea. It is green")]
    keywords = spark.createDataFrame([(0, "greensea"), (0, "Nowhere at all")], "topic_id int, keyword string")
    got = graph.context_windows(spark.createDataFrame(docs, "doc_id long, text string"), keywords).collect()
    assert [(r["doc_id"], r["sentence_index"], r["keywords"]) for r in got] == [(300, 0, ["greensea"])]
    assert sum(made.count() for made in written) <= 3  # two keywords and one document, no table of tokens


@pytest.mark.parametrize("size", [3, 50, 1 << 20])
def test_scan_finds_every_gram(monkeypatch, size):
    monkeypatch.setattr(graph, "SCAN_BYTES", size)
    r = random.Random(size)
    texts = ["".join(r.choices(["a", "b", "é", " ", "."], k=r.randint(0, 40))) for _ in range(60)]
    grams = {t.encode()[i : i + n] for t in texts[:20] for n in (1, 3, 8) for i in (0, 5) if len(t.encode()[i : i + n]) == n and r.random() < 0.3}
    bits = np.zeros(1 << 20, np.uint8)
    for g in grams:
        for factor in graph.FILTER_HASHES:
            bits[graph._slot(np.frombuffer(g.ljust(8, b"\0"), "<u8"), len(g), len(bits), factor)] = 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(62)), pa.array(["", *texts, ""]).cast(pa.string())], ["id", "low"]).slice(1)
    scan = graph._scan(np.packbits(bits, bitorder="little").tobytes(), [1, 3, 8], ["id", "hits"])
    got = {(row["id"], h["i"], h["n"], h["gram"].to_bytes(8, "little", signed=True)[: h["n"]]) for part in scan(iter([batch])) for row in part.to_pylist() for h in row["hits"]}
    want = {(k, t.encode()[:at].count(b"."), len(g), g) for k, t in enumerate(texts, 1) for g in grams for at in range(len(t.encode())) if t.encode()[at : at + len(g)] == g}
    assert got == want and len(want) > 20
