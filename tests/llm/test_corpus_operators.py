"""Near-duplicates, line dedup, language ID and the pipeline against brute force and held-out labels."""

import random
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tutorloom.llm import components, langid, linededup, neardup

SF_DIR = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def changed(rng, text, n, alphabet="abcdé "):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice(alphabet))
        elif out:
            at = min(at, len(out) - 1)
            out[at : at + 1] = [] if kind == 1 else [rng.choice(alphabet)]
    return "".join(out)


def shingles(text):
    words = (text or "").encode().lower().split()
    return set(zip(words, words[1:])) if len(words) > 1 else set(words)


def brute_components(docs):
    """Smallest id reachable over links, by (id, text)."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(documents):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (200, 120, 60, 30, 12, 6, 5, 3)]
    docs = []
    for k in range(240):  # a third of them around one text
        own = list(bases[0] if k % 3 == 0 else rng.choice(bases))
        for _ in range(rng.randrange(0, max(2, len(own) // 9))):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((k * 3 - 9, " ".join(own)))
    docs += [(9001, docs[5][1].upper() + " "), (9002, ""), (9003, None), (9004, " \n"), (9005, "Solo"), (9006, "solo"), (9007, "a b"), (9008, "b a")]
    want = brute_components(docs)
    got = {r.doc_id: r for r in neardup.near_duplicates(documents([*docs, (None, docs[0][1])])).collect()}
    assert {i: r.component_id for i, r in got.items() if i is not None} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items() if i is not None)
    assert (got[None].component_id, got[None].kept) == (None, True)
    assert {i: r.n_shingles for i, r in got.items() if i is not None} == {i: len(shingles(t)) for i, t in docs}
    assert len(set(want.values())) < 150
    assert neardup.near_duplicates(documents([])).collect() == []
    assert {r.kept for r in neardup.near_duplicates(documents([(1, "x y"), (1, "x y"), (2, None)])).collect()} == {True}


def test_near_duplicates_grow_with_groups_and_not_with_chance(documents, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for k in range(90):  # around one text, about half of them linked with the first
        own = list(base)
        for _ in range(rng.randrange(3, 20)):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((k, " ".join(own)))
    docs += [(k, " ".join(rng.choices(words, k=rng.randrange(60, 120)))) for k in range(90, 390)]  # unrelated, but each pair of words stands in many
    tables, written = {}, neardup.written

    def remembered(df, name):
        tables.setdefault(name, out := written(df, name))
        return out

    monkeypatch.setattr(neardup, "TILE_VALUES", 1500, raising=False)  # so the group is cut into blocks
    monkeypatch.setattr(neardup, "written", remembered)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(docs)).collect()}
    assert got == brute_components(docs)
    assert tables["star"].where("rid >= 90 OR hub >= 90").count() < 100  # the unrelated ones meet hardly anybody
    assert tables["groups"].agg({"rights": "max"}).first()[0] > 1


def test_near_duplicates_of_repeated_rows(documents):
    words = [f"w{k}" for k in range(40)]
    near = " ".join([*words[:-1], "other"])  # 38 of 40 pairs of words are common
    rows = [(3, " ".join(words)), (3, " ".join(words)), (5, near), (5, near), (7, " ".join([*words[1:], "more"])), (9, "w1 w2 w3")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(documents(rows)).collect())
    assert got == [(3, 3, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True)]


def test_components_of_a_chain(spark):
    rng = random.Random(1)
    order = rng.sample(range(500), 500)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(0, 499) if i != 250], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {n: min(part) for part in (order[:251], order[251:]) for n in part}
    assert components.components(edges.limit(0)).collect() == []


def test_edit_distance_and_filters_lose_nothing():
    rng = random.Random(3)
    for _ in range(1500):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(40)))
        b = changed(rng, a, rng.randrange(6))
        assert all(linededup.within(a, b, m) == (edits(a, b) <= m) for m in range(4))
    for _ in range(400):
        a = "".join(rng.choice("abcdefghé ") for _ in range(rng.randrange(22, 70)))
        b = changed(rng, a, rng.randrange(3))
        filed = [{(n, i, x[s:e]) for n, i, s, e, own in linededup._probes(len(x)) if own or not index} for x in (a, b) for index in (True, False)]
        assert filed[0] & filed[3] or filed[2] & filed[1]
        one, two = linededup._signatures([a, b]).tolist()
        assert bin((one ^ two) & (1 << 64) - 1).count("1") <= 4 * linededup.THRESHOLD


def test_line_dedup_equals_brute_force(documents):
    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdefgé ") for _ in range(rng.choice([5, 12, 19, 20, 25, 60]))) for _ in range(25)]
    docs = [(k, "\n".join(changed(rng, rng.choice(lines), rng.choice([0, 0, 1, 2, 4])) for _ in range(rng.randrange(1, 7)))) for k in range(40)]
    docs += [(50, docs[0][1]), (51, ""), (52, None), (53, "\n\n"), (None, docs[0][1])]
    placed = [(i, at, line, line.strip(linededup.BLANK)) for i, t in docs if i is not None and t is not None for at, line in enumerate(t.split("\n"))]
    want = {}
    for i, text in docs:
        kept, gone = [], 0
        for at, line in enumerate(text.split("\n") if text is not None else []):
            own = line.strip(linededup.BLANK)
            earlier = [o for j, a, _, o in placed if i is not None and (j, a) < (i, at)]
            near = len(own) >= 20 and any(len(o) >= 20 and abs(len(o) - len(own)) < 3 and edits(o, own) <= 2 for o in earlier)
            if len(own) >= 10 and (own in earlier or near):
                gone += 1
            else:
                kept.append(line)
        want[i] = (gone, "\n".join(kept) if text is not None else None)
    got = {r.doc_id: (r.n_removed, r.kept) for r in linededup.without_repeats(documents(docs)).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 30
    assert linededup.without_repeats(documents([])).collect() == []
    assert len(linededup.without_repeats(documents([(1, "the same long line"), (1, "the same long line")])).collect()) == 2


def test_language_network_on_held_out_documents(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    given = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = entry.queries()["op8_language_id"](spark, sf_dir).collect()
    assert len(got) == len(given)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    tested = [r.lang_pred == given[r.doc_id].lang for r in got if r.held_out]
    assert sum(tested) / len(tested) > 0.97


def test_language_odd_texts(spark, documents):
    known = next(i for i in range(5, 50) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = documents([(1, None), (2, ""), (3, "123 !?"), (4, "é" * 300), (4, "é" * 300), (known, "le chat et la souris")]).withColumn("lang", F.when(F.col("doc_id") == known, "fr"))
    got = sorted((r.doc_id, r.lang_pred, r.position) for r in langid.predict_languages(docs.withColumn("score", F.lit("x"))).collect())
    assert got == [(1, "und", "a"), (2, "und", "a"), (3, "und", "a"), (4, "fr", "a"), (4, "fr", "a"), (known, "fr", "a")]
    assert {r.lang_pred for r in langid.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict_languages(docs.limit(0)).collect() == []
    sample = langid.training_sample(docs, "doc_id", "text", "lang")
    assert all(lang == "fr" for _, lang in sample)


def test_network_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    net = langid._start(["a", "b"], rng)
    codes = rng.integers(0, 256, (5, 3))
    above = rng.standard_normal((5, 3, langid.HIDDEN))
    inputs, carried = net.inputs[0].astype(float), net.carried[0].astype(float)
    d_inputs, d_carried = langid._learn_from(inputs, carried, codes, langid._read(inputs, carried, codes), above)
    for array, grad, at in ((inputs, d_inputs, (int(codes[2, 1]), 3)), (inputs, d_inputs, (int(codes[0, 0]), 2 * langid.HIDDEN + 1)), (carried, d_carried, (2, 5)), (carried, d_carried, (1, 2 * langid.HIDDEN + 4))):
        step, was = 1e-2, array[at]
        value = []
        for sign in (1, -1):
            array[at] = was + sign * step
            value.append(float((langid._read(inputs, carried, codes) * above).sum()))
        array[at] = was
        assert abs((value[0] - value[1]) / (2 * step) - grad[at]) < 0.02 * max(1, abs(grad[at]))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("*", "'x' AS position")
    benchmark = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    odd = [(90001, None), (90002, "123"), (90003, max(benchmark, key=len))]
    extra = spark.createDataFrame(odd, "doc_id bigint, text string").selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "'s' AS source", "CAST(0 AS bigint) AS n_chars", "'y' AS position")
    current = docs.unionByName(extra)
    from tutorloom.llm.common import written

    seen = {"": {r.doc_id: r.text for r in current.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, current, SF_DIR), f"test-{name}")
        if name != "byte_bpe":
            assert result.columns == current.columns and [f.dataType for f in result.schema] == [f.dataType for f in current.schema]
            seen[name] = {r.doc_id: r.text for r in result.collect()}
            current = result
    assert not {90001, 90002} & set(seen["language_id"])
    lines = linededup.without_repeats(spark.createDataFrame(list(seen["language_id"].items()), "doc_id bigint, text string")).collect()
    assert seen["line_dedup"] == {r.doc_id: r.kept for r in lines if r.kept.strip() or not r.n_removed}
    groups = brute_components(list(seen["line_dedup"].items()))
    assert set(seen["near_duplicates"]) == {i for i, c in groups.items() if i == c}
    assert 90003 not in seen["decontamination"] and set(seen["decontamination"]) <= set(seen["near_duplicates"])
    rows = result.collect()
    assert all(r.round_trip for r in rows) and {r.doc_id for r in rows} == set(seen["decontamination"])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, name):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF_DIR).collect() == []
