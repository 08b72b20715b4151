"""Order MinHash fingerprints against the same rules in plain Python."""

import hashlib
import re
import struct

import xxhash

from tutorloom.llm import fingerprints as fp


def h64(*values):
    """Spark's xxhash64: each value's hash is the seed for the next."""
    seed = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, int) and not isinstance(v, Short) else struct.pack("<i", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Short(int):
    pass


def plain(text):
    tokens = [h64(t) for t in re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)]
    n = max(len(tokens) - fp.K + 1, min(len(tokens), 1))
    kmers = [h64(*tokens[i : i + fp.K]) for i in range(n)]
    seen, bins = {}, {}
    order = sorted(range(n), key=lambda i: ((kmers[i] & 0xFFFFFFFF) - (1 << 32 if kmers[i] & 0x80000000 else 0), i))
    for i in order:
        low = kmers[i] & 0xFFFFFFFF
        nth = seen.get(low, 0)
        seen[low] = nth + 1
        mixed = (h64(low, Short(nth)) & 0xFFFFFFFFFFFFFFFF) >> 32
        bins.setdefault(mixed >> 26, []).append((mixed, i))
    out = []
    for b in range(fp.BINS):
        first = sorted(bins.get(b, []))[: fp.KEPT]
        out.append(f"{h64(*(kmers[i] for i in sorted(i for _, i in first))) & 0xFFFF:04x}" if first else fp.EMPTY)
    return "".join(out)


def alike(a, b):
    if a == b:
        return 1.0
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    filled = [p for p in pairs if p != (fp.EMPTY, fp.EMPTY)]
    return sum(x == y for x, y in filled) / len(filled)


def test_equals_plain_python(spark):
    texts = {3: "one two three one two three one two three " * 5, 70: "", 71: None, 1000: "x" * 100, 5_000_000_000: "é漢🙂 a b c d e f g h", -4: "the end of the text " * 40, 12: "one", 13: " \n\t"}
    rows = [*texts.items(), (None, "no id here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("text", "text").selectExpr("*", "'x' AS bucket", "1 AS fingerprint")
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    assert len(got) == len(rows)
    ids = sorted(texts)
    for k, i in enumerate(ids):
        own, nxt = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        q = len(own) // 4
        edited = own[: len(own) - q] + nxt[:q]
        r = got[i]
        assert (r.n_chars, r.edited) == (len(own), edited)
        assert r.fingerprint == plain(own) and r.edited_fingerprint == plain(edited)
        assert abs(r.near_edited - alike(plain(own), plain(edited))) < 1e-12
        assert abs(r.near_next - alike(plain(own), plain(nxt))) < 1e-12
    assert (got[None].edited, got[None].near_edited, got[None].near_next) == ("no id here", 1.0, 1.0)


def test_order_matters_and_empty_table(spark):
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[200:] + words[:200])), (3, " ".join(words))], "doc_id int, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(df).collect()}
    assert got[1] == got[3] and 0.2 < alike(got[1], got[2]) < 0.8  # nearly the same set, another order
    assert fp.fingerprints(df.limit(0)).collect() == []


def test_query_edits_with_the_next_document(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in entry.queries()["op9_order_minhash"](spark, sf_dir).collect()}
    for k, (i, own) in enumerate(docs):
        q = len(own) // 4
        edited = own[: len(own) - q] + docs[(k + 1) % len(docs)][1][:q]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert sum(r.near_edited for r in got.values()) / len(got) > 5 * sum(r.near_next for r in got.values()) / len(got)
