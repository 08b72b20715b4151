"""Benchmark decontamination as a prefix-filtered set join.

Words are runs of digits, letters a-z (A-Z in lower case) and all characters beyond ASCII. An item gives a window for every
``window`` consecutive words, or one window of all its words if it has fewer. A window is a set of shingles of ``SHINGLE``
words (of all its words, if fewer), and a document holds the window only if it holds all of them, so the necessary prefix in
an order by rarity is the rarest shingle alone: windows meet documents on that shingle. Where it stands in the window gives
the position in the document, which must leave room for the window on both sides (positional and length bound); then the
words themselves are compared.

The documents are read once. A task keeps only the stretches of words around shingles whose bit is set in a bitmap of
``FILTER_BITS`` bits, the only thing that is sent to all tasks; false positives fall out in the joins, nothing is lost.

Defined results: a null, empty or wordless text has no words, no hits and is not contaminated; items without words have no
windows; repeated item rows count once by id, different items with equal texts each; repeated document rows give a row each;
null item ids are ignored; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorloom.llm import wordhash
from tutorloom.llm.common import slices, written

SHINGLE = 5
FILTER_BITS = 1 << 22
SLICE_CHARS = 4_000_000

find_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def split_words(text: bytes) -> list[bytes]:
    return find_words(text.lower())  # bytes.lower() changes A-Z alone


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FILTER_BITS)).astype(np.int64)


def item_windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item_id, words, bits): every window of every item, and the filter bits of its shingles."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_CHARS // 32):
            ids, spelled, bits = [], [], []
            words = wordhash.hashed(part.column("text").to_pylist(), split_words)
            for i, (key, own) in enumerate(zip(part.column("item_id").to_pylist(), words.lists, strict=True)):
                size = min(window, len(own))
                for at in range(len(own) - size + 1 if size else 0):
                    hashes = words.hashes[words.bounds[i] + at : words.bounds[i] + at + size]
                    ids.append(key)
                    spelled.append([w.decode() for w in own[at : at + size]])
                    bits.append(_bit(wordhash.runs(hashes, min(SHINGLE, size))).tolist())
            columns = [pa.array(ids, part.schema.field("item_id").type), pa.array(spelled, pa.list_(pa.string())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "bits"])

    given = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id IS NOT NULL")
    return given.mapInArrow(run, f"item_id {kind}, words array<string>, bits array<bigint>")


def stretches(docs: DataFrame, filter_bits: bytes, lengths: list[int], window: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_words, stretches): of each document its words near shingles that pass the filter, with their positions."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(filter_bits, np.uint8)).astype(bool)
        for part in slices(batches, "text", SLICE_CHARS):
            words = wordhash.hashed(part.column("text").to_pylist(), split_words)
            found: list[list[dict]] = [[] for _ in words.lists]
            lows, highs = [], []
            for n in lengths:
                starts = wordhash.run_starts(words.bounds, n)
                starts = starts[known[_bit(wordhash.runs(words.hashes, n)[starts])]]
                lows.append(starts - window + 1)
                highs.append(starts + n + window - 1)
            low, high = np.concatenate(lows), np.concatenate(highs)
            order = np.argsort(low, kind="stable")
            low, high = low[order], high[order]
            of = wordhash.text_of(words.bounds, low + window - 1)
            low, high = np.maximum(low, words.bounds[of]), np.minimum(high, words.bounds[of + 1])
            if len(low):
                reach = np.maximum.accumulate(high)
                first = np.concatenate([[True], (low[1:] > reach[:-1]) | (of[1:] != of[:-1])])
                at = np.flatnonzero(first)
                for i, a, b in zip(of[at].tolist(), low[at].tolist(), np.maximum.reduceat(high, at).tolist(), strict=True):
                    base = int(words.bounds[i])
                    found[i].append({"start": a - base, "words": b" ".join(words.lists[i][a - base : b - base]).decode()})
            stretch = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.string())]))
            columns = [part.column("doc_id"), pa.array(np.diff(words.bounds)), pa.array(found, stretch)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "stretches"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, n_words bigint, stretches array<struct<start: int, words: string>>")


def matches(near: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, start, size, window): each occurrence of a window in a document; ``windows`` (window, words) are distinct."""
    shingle = F.array_join(F.slice("words", F.col("at") + 1, F.least(F.size("words"), F.lit(SHINGLE))), " ")
    parts = windows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.least(F.size("words"), F.lit(SHINGLE)))))
    parts = parts.select("window", F.size("words").alias("size"), F.col("at").alias("offset"), shingle.alias("shingle"))

    spots = near.select("row", F.explode("stretches").alias("s")).select("row", "s.start", F.split("s.words", " ").alias("words"))
    spots = spots.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where(F.size("words") >= F.col("n"))
    spots = spots.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))))
    spots = spots.select("row", F.col("start").alias("stretch"), (F.col("start") + F.col("at")).alias("position"), F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("shingle"))
    spots = written(spots.join(parts.select("shingle").distinct(), "shingle", "left_semi"), "spots")

    rarity = spots.groupBy("shingle").agg(F.count("*").alias("seen"))
    common = parts.groupBy("shingle").agg(F.count("*").alias("listed"))
    ranked = parts.join(rarity, "shingle", "left").join(common, "shingle")
    rarest = ranked.groupBy("window", "size").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "listed", "offset", "shingle")).alias("prefix"))
    prefixes = rarest.where("prefix.seen > 0").select("window", "size", "prefix.offset", "prefix.shingle")

    placed = spots.join(prefixes, "shingle").select("row", "stretch", "window", "size", (F.col("position") - F.col("offset")).alias("start"))
    texts = near.select("row", F.explode("stretches").alias("s")).select("row", F.col("s.start").alias("stretch"), F.split("s.words", " ").alias("words"))
    fits = (F.col("start") >= F.col("stretch")) & (F.col("start") + F.col("size") <= F.col("stretch") + F.size("words"))
    same = F.array_join(F.slice("words", F.col("start") - F.col("stretch") + 1, F.col("size")), " ") == F.col("window")
    return placed.where(F.col("start") >= 0).join(texts, ["row", "stretch"]).where(fits & same).select("row", "start", "size", "window")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans) of every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``item_ids`` are the sorted ids, as strings, of the items
    whose windows occur, ``spans`` the covered stretches as (start, end) in words.
    """
    spark = docs.sparkSession
    listed = written(item_windows(items, window, item_id, item_text), "windows")
    bits = np.zeros(FILTER_BITS, np.uint8)
    set_bits = listed.select(F.explode("bits").alias("bit")).distinct()  # at most FILTER_BITS rows
    bits[[r.bit for r in set_bits.toLocalIterator()]] = 1
    lengths = sorted(r.n for r in listed.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect())  # at most SHINGLE rows
    near = stretches(docs, np.packbits(bits).tobytes(), lengths or [SHINGLE], window, doc_id, text)
    near = written(near.withColumn("row", F.monotonically_increasing_id()), "stretches")

    windows = listed.select(F.array_join("words", " ").alias("window"), "words").distinct()
    found = written(matches(near, windows, lengths or [SHINGLE]), "matches")
    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    reached = found.select("row", "start", "size").distinct().withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
    fresh = reached.select("row", F.greatest("start", "reached").alias("start"), end.alias("end")).where("end > start")
    spans = fresh.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    owners = listed.select(F.array_join("words", " ").alias("window"), "item_id").distinct()
    of_items = found.select("row", "window").distinct().join(owners, "window").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    of_items = of_items.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    return (
        near.select("row", F.col("doc_id").alias(doc_id), "n_words")
        .join(spans, "row", "left")
        .join(of_items, "row", "left")
        .select(
            doc_id,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
        )
    )


def contaminated():
    """The rule on the result: some words are hit, and they are a twentieth of all words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
