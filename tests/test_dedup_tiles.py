"""Vocabulary and tiles of the near-duplicate step."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from tutorloom.functions import text as T
from tutorloom.operators import dedup


def test_vocabulary_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(2, 30))) for _ in range(60)] + ["w1 w2 w3 w4"] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counts = collections.Counter()
    for t in texts:
        ws = t.split()
        counts.update(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])
    tokens = docs.select("id", T.content_words(F.col("text")).alias("tokens"))
    for size in (10, 40, 60, 500):
        assert dedup.vocabulary(tokens, size) == sorted(counts, key=lambda t: (-counts[t], t))[:size]

    vocab = dedup.vocabulary(tokens, 60)
    rows = dedup.term_counts(tokens, "id", vocab)
    idf = dedup.inverse_frequencies(rows, len(vocab), len(texts))
    at = dedup.Rows(rows.select("id", "idx", "n").toArrow(), idf)
    m = {int(i): v for i, v in zip(at.ids, at.part(0, len(at.ids)).astype(float))}
    for threshold in (0.6, 0.95):
        filed = dedup.filed(rows, idf, threshold)
        want = {(a, b) for a in m for b in m if a > b and m[a] @ m[b] > threshold}
        assert {(r["a"], r["b"]) for r in dedup.tiled(filed, None, idf, threshold).collect()} == want
        left, right = filed.filter("id >= 90"), filed.filter("id < 90")
        got = [r["a"] for r in dedup.tiled(left, right, idf, threshold).collect()]  # 30 copies against 30: ids, no pairs
        assert sorted(got) == sorted({a for a in m if a >= 90 and any(m[a] @ v > threshold for b, v in m.items() if b < 90)})
    assert np.isclose(np.linalg.norm(at.part(0, 1)), 1)


def test_tiles_multiply_norms_first(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(rng.choices(words, k=rng.randint(8, 30))) for _ in range(120)]
    texts += [t + " " + rng.choice(words) for t in texts[:40] for _ in range(2)]  # some of them near
    tokens = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", T.content_words(F.col("text")).alias("tokens"))
    rows = dedup.term_counts(tokens, "id", dedup.vocabulary(tokens, 150))
    idf = dedup.inverse_frequencies(rows, 150, len(texts))
    at = dedup.Rows(rows.select("id", "idx", "n").toArrow(), idf)
    m = at.part(0, len(at.ids)).astype(float)
    norms = at.norms(dedup.term_groups(idf)).astype(float)
    assert norms.shape[1] == dedup.GROUPS < len(idf)
    assert (norms @ norms.T > m @ m.T - 1e-6).all()
    assert (np.triu(norms @ norms.T > 0.9, 1)).sum() < 1.2 * (np.triu(m @ m.T > 0.9, 1)).sum() < 200  # of 19900 pairs
    want = {(int(max(at.ids[i], at.ids[j])), int(min(at.ids[i], at.ids[j]))) for i, j in zip(*np.nonzero(np.triu(m @ m.T > 0.9, 1)))}
    monkeypatch.setattr(dedup, "PART", 8)
    monkeypatch.setattr(dedup, "BLOCK", 32)
    filed = dedup.filed(rows, idf, 0.9)
    for share in (0.0, 1.0):  # whole vectors, or term by term
        monkeypatch.setattr(dedup, "DENSE", share)
        assert {(r["a"], r["b"]) for r in dedup.tiled(filed, None, idf, 0.9).collect()} == want
        got = [r["a"] for r in dedup.tiled(filed.filter("id >= 120"), filed.filter("id < 120"), idf, 0.9).collect()]
        assert sorted(got) == sorted({a for a, b in want if a >= 120 > b})
