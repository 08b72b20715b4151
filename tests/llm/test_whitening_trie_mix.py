"""Whitening, the prefix trie and the source mix against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tutorloom.llm import mixing, prefixtrie, whitening

# --- whitening -----------------------------------------------------------------------------------------------


def plain_whitening(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    return n, s, cov, [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x], np.array([[(n * r[i] - s[i]) / n for i in range(d)] for r in x])


def test_whitening_equals_plain_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 96)  # several blocks, the last one short
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 6)) @ np.diag([9, 5, 3, 2, 1, 0.5]) + rng.normal(size=6) * 100
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = whitening.whitened_components(df, 4).toPandas().sort_values(["vec_id", "component"])
    n, s, cov, deviation, centred = plain_whitening(v.tolist())
    e, u = np.linalg.eigh(cov)
    want = (centred @ u[:, ::-1][:, :4]) / np.sqrt(e[::-1][:4])
    values = got["whitened"].to_numpy().reshape(-1, 4)
    assert np.allclose(np.abs(values), np.abs(want), atol=1e-9)
    assert set(got["n"]) == {n} and got["deviation"].tolist() == np.repeat(deviation, 4).tolist()
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 4), e[::-1][:4] / e.sum())
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert np.allclose(np.cov(values.T, bias=True), np.eye(4), atol=1e-9)


def test_bit_slices_give_products_of_any_width():
    rng = np.random.default_rng(4)
    y = np.stack([rng.integers(0, 2**40, 150), rng.integers(0, 2, 150), np.zeros(150, np.int64), rng.integers(0, 2**61, 150)], axis=1)
    bits = [int(c.max()).bit_length() for c in y.T]
    total = np.zeros((4, 4), dtype=object)
    for limb, part in whitening.weighted(whitening.both_set(whitening.bit_slices(y, bits)), bits):
        total = total + part.astype(object) * 2 ** (32 * limb)
    assert (total == y.astype(object).T @ y.astype(object)).all()


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, "a"), (2, [1.0, None], "a"), (3, [nan, 1.0], "a"), (4, [inf, 1.0], "a"), (5, [], "b"), (6, [1.0], "b"), (7, [0.5, 4.0], "c"), (7, [0.5, 4.0], "c"), (None, [2.5, 4.0], "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    got = whitening.whitened_components(df).toPandas()
    assert len(got) == 6 and set(got["n"]) == {3}  # three rows, of ids 7, 7 and null
    flat = got[got["component"] == 2]
    assert flat["whitened"].isna().all() and got["identity_error"].iloc[0] < 1e-12
    model = whitening.fit(df)
    assert whitening.transform(df, model, 2).columns == ["vec_id", "embedding", "whitened", "deviation"]
    assert whitening.whitened_components(df.where("vec_id < 6")).count() == 0
    assert whitening.whitened_components(df.where("vec_id = 6")).toPandas()[["whitened", "explained", "identity_error"]].isna().all(axis=None)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened_components(huge, 1).toPandas()["deviation"].isna().all()
    assert {r["deviation"] for r in whitening.transform(huge, whitening.fit(huge), 1).collect()} == {2**124 + 64**2}


# --- prefix trie ---------------------------------------------------------------------------------------------


def plain_trie(rows):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]
            given[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in given.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(int)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += node not in kids
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations():
    r = random.Random(5)
    rows = [(None, 0, "user", "lost")]
    for conv in range(-30, 200):
        if r.random() < 0.1:
            continue
        for i in range(400 if conv == 60 else r.choice([1, 2, 3, 5, 9])):
            rows.append((conv, r.choice([i, i, i, None, 1]), r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", r.choice(["a b", "c", None]) if i < 3 else f"w{i % 3} x"))
    return rows + [(500 + i, 0, "user", "the same words") for i in range(300)]  # a hot group of copies


@pytest.mark.parametrize("limit", [1_000_000, 100])
def test_trie_equals_plain_python(spark, limit):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "2 AS part", "'k' AS d1").repartition(5)
    got = sorted([tuple(r) for r in prefixtrie.prefix_trie(df, limit).collect()], key=str)
    assert got == plain_trie(rows)


def test_trie_starts_over_on_a_collision(spark, monkeypatch):
    """With base 1 the digest forgets the order of turns, so both orders meet in one group."""
    honest, tried = prefixtrie.bases, []
    monkeypatch.setattr(prefixtrie, "bases", lambda attempt: (tried.append(attempt), (1, 1) if attempt == 0 else honest(attempt))[1])
    rows = [(c, t, "user", x) for c, words in ((1000, "abcdef"), (1020, "fedcba"), (1040, "abcfed")) for t, x in enumerate(words)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted([tuple(r) for r in prefixtrie.prefix_trie(df).collect()], key=str) == plain_trie(rows)
    assert tried == [0, 1]


def test_trie_of_a_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    for rows in ([(41, None, None, None)], [(7, 0, "user", "x " * 200_000)], [(3, 0, "a", "b"), (3, 0, "a", "b"), (3, 0, "a", "b"), (3, 0, "a", "b")]):
        got = sorted([tuple(r) for r in prefixtrie.prefix_trie(spark.createDataFrame(rows, schema)).collect()], key=str)
        assert got == plain_trie(rows)


def test_perfect_hash_is_minimal():
    keys = [np.arange(5000, dtype=np.int64) // 7, np.arange(5000, dtype=np.int64) % 7]
    table = prefixtrie.PerfectHash.of(keys)
    assert sorted(table.slots(keys)) == list(range(5000))


# --- mix -------------------------------------------------------------------------------------------------------


def plain_seats(parties, seats):
    """Sainte-Laguë one seat at a time: parties (votes, number, cap)."""
    held = [0] * len(parties)
    for _ in range(seats):
        able = [i for i, (v, _, cap) in enumerate(parties) if v > 0 and held[i] < cap]
        best = max(able, key=lambda i: (parties[i][0] / (2 * held[i] + 1), -parties[i][1]))
        held[best] += 1
    return held


@pytest.mark.parametrize("seed", range(4))
def test_apportion_equals_seat_by_seat(spark, seed):
    r = random.Random(seed)
    groups = {g: [(r.choice([0, 1, 7, 7, 50, 1000]), i, 0) for i in range(r.randint(1, 9))] for g in range(5)}
    groups = {g: [(v, i, 3 * -(-v // 8)) for v, i, _ in p] for g, p in groups.items()}
    wanted = {g: min(sum(c for *_, c in p), round(sum(v for v, *_ in p) / 8 * r.choice([0.3, 1, 2, 2.9, 3]))) for g, p in groups.items()}
    df = spark.createDataFrame([(g, i, float(v), c, wanted[g]) for g, p in groups.items() for v, i, c in p], "g int, party int, votes double, cap long, seats_in_all long")
    got = {(x["g"], x["party"]): x["seats"] for x in mixing.apportion(df, "test", "g").collect()}
    assert got == {(g, i): s for g, p in groups.items() for (_, i, _), s in zip(p, plain_seats(p, wanted[g]), strict=True)}
    one = mixing.apportion(df.where("g = 0"), "test").collect()
    assert {x["party"]: x["seats"] for x in one} == {i: s for (_, i, _), s in zip(groups[0], plain_seats(groups[0], wanted[0]), strict=True)}


def mixed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "9 AS size", "'x' AS shard", "0 AS taken", "1 AS rank").repartition(3)
    return [r.asDict() for r in mixing.mix(df, **options).collect()]


def test_mix_meets_targets_with_shards_and_caps(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["b", "b", "b", "b", "a", None]), "w " * r.choice([0, 1, 3, 40, 200])) for i in range(600)] + [(1000, "tiny", "one two three"), (1001, "none", None), (1002, "é", "x " * 50_000)]
    got = mixed(spark, rows, shard_docs=40, block=4)
    source = {i: s for i, s, _ in rows}
    sums = defaultdict(lambda: [0, 0, 0.0, 0])
    for x in got:
        t = sums[source[x["doc_id"]]]
        t[0], t[1], t[2], t[3] = t[0] + x["size"], x["source_size"], x["target"], t[3] + x["taken"]
        assert 0 <= x["taken"] <= 3 * x["size"]
    assert len(got) == len(rows) and all(t[0] == t[1] for t in sums.values())
    total = sum(t[0] for t in sums.values())
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    free, fixed = set(order), {}
    while True:
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        above = {s for s in free if share * weight[s] > 3 * sums[s][0]}
        if not above:
            break
        fixed |= {s: 3 * sums[s][0] for s in above}
        free -= above
    assert fixed  # the small sources are taken three times
    for s, t in sums.items():
        assert math.isclose(t[2], fixed.get(s, share * weight[s] if s in free else 0), rel_tol=1e-12)
        assert abs(t[3] - t[2]) <= 4 * (len(rows) // 40 + 2)
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows[::-1], shard_docs=40, block=4)))
    other = {x["doc_id"]: x["taken"] for x in mixed(spark, rows, shard_docs=40, block=4, seed=8)}
    assert any(other[x["doc_id"]] != x["taken"] for x in got)


def test_mix_of_odd_tables(spark):
    assert mixed(spark, []) == []
    assert [(x["size"], x["target"], x["taken"]) for x in mixed(spark, [(1, "a", None), (2, None, " \t")])] == [(0, 0.0, 0), (0, 0.0, 0)]
    same = mixed(spark, [(5, "a", "x y z")] * 4 + [(None, "a", "x")])
    assert sum(x["taken"] for x in same) in range(8, 17) and len(same) == 5
