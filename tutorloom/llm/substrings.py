"""Removal of repeated passages: windows of words that also start earlier, found by level-wise doubling.

A window of ``window`` words can only be repeated if its halves are, so the first level looks at runs of half that length.
Among the runs in a window the one with the smallest hash stands for it; equal windows choose equal runs at equal places, so
runs that no window chooses needn't be counted, and a window is extended to twice the length only where its chosen run is
repeated. On the second level, the asked length, windows are told apart by 96 bits of hash. Longer repeats need no level of
their own: they are covered by the windows inside them.

Texts with the same words are one text to begin with; all but the first are copies, whose windows all start earlier.

Defined results: words are what stands between ASCII white space; null, empty and short texts (fewer than ``window`` words) lose
nothing; kept words are joined by single spaces; rows without an id lose nothing and make nothing else be removed; ids are taken
as unique (rows with one id count as one document); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorloom.llm import wordhash
from tutorloom.llm.common import slices, small_or_not, written

SLICE_CHARS = 4_000_000
MOST_HEAVY = 100_000  # keys that are met by broadcast because each holds at least that share of all rows


def _keys(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, words_key): the number of words of each text and a hash of their sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_CHARS):
            counts, keys = [], []
            for text in part.column("text").to_pylist():
                own = text.encode().split()
                counts.append(len(own))
                keys.append(xxhash.xxh3_128_digest(b" ".join(own)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_words", "words_key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, words_key binary")


def _met(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with the keys ``counted`` (on, n, ...), both written tables; ``n`` is the number of rows of a key.

    Fewer than ``MOST_HEAVY`` keys can hold more than that share of the rows. They are broadcast, so their rows stay where they are;
    what is left to shuffle has no heavy key.
    """
    share = rows.count() // MOST_HEAVY + 1000
    heavy = F.broadcast(counted.where(F.col("n") > share).drop("n"))
    light = counted.where(F.col("n") <= share).drop("n")
    rest = rows.join(heavy.select(*on), on, "left_anti")
    return rows.join(heavy, on).unionByName(rest.join(light, on))


def _choices(words: wordhash.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the start of the run each chooses, and the hashes of all runs of half a window."""
    half = window // 2
    halves = wordhash.runs(words.hashes, half)
    starts = wordhash.run_starts(words.bounds, window)
    if not len(starts):
        return starts, starts, halves
    lowest = np.lib.stride_tricks.sliding_window_view(halves, window - half + 1).argmin(axis=1)
    return starts, starts + lowest[starts], halves


def _chosen_runs(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, position, run): the runs that stand for at least one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_CHARS):
            words = wordhash.hashed(part.column("text").to_pylist(), bytes.split)
            _, chosen, halves = _choices(words, window)
            chosen = np.unique(chosen)
            of = wordhash.text_of(words.bounds, chosen)
            place = (chosen - words.bounds[of]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), pa.array(place), pa.array(halves[chosen].view(np.int64))], names=["doc_id", "position", "run"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, position int, run bigint")


def _extended(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, position, again, key, more): the windows of ``docs`` (doc_id, text, positions) whose chosen run is at a given position.

    ``again`` is true where the same document has the same window earlier; of the others there is one for each key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_CHARS):
            words = wordhash.hashed(part.column("text").to_pylist(), bytes.split)
            starts, chosen, _ = _choices(words, window)
            marked = np.zeros(len(words.hashes) + 1, bool)
            lists = part.column("positions")
            held = np.diff(lists.offsets.to_numpy())
            spots = lists.flatten().to_numpy() + np.repeat(words.bounds[:-1], held)
            marked[spots[spots < np.repeat(words.bounds[1:], held)]] = True  # a place beyond the text comes from a repeated id
            starts = starts[marked[chosen]]
            key = wordhash.runs(words.hashes, window)[starts] if len(starts) else np.array([], np.uint64)
            more = wordhash.runs(wordhash.scramble(words.hashes), window)[starts].astype(np.uint32) if len(starts) else np.array([], np.uint32)
            of = wordhash.text_of(words.bounds, starts)
            order = np.lexsort((starts, more, key, of))
            same = np.zeros(len(starts), bool)
            a, b = order[1:], order[:-1]
            same[a] = (of[a] == of[b]) & (key[a] == key[b]) & (more[a] == more[b])
            place = (starts - words.bounds[of]).astype(np.int32)
            columns = [part.column("doc_id").take(pa.array(of)), pa.array(place), pa.array(same), pa.array(key.view(np.int64)), pa.array(more.view(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "position", "again", "key", "more"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "positions").mapInArrow(run, f"doc_id {kind}, position int, again boolean, key bigint, more int")


def _without(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of ``docs`` (doc_id, text, positions) without the words of the windows at ``positions`` (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_CHARS):
            counts, removed, kept = [], [], []
            for text, places in zip(part.column("text").to_pylist(), part.column("positions"), strict=True):
                own = text.encode().split()
                if places.values is None:
                    counts.append(len(own))
                    removed.append(0)
                    kept.append(b" ".join(own).decode())
                    continue
                edges = np.zeros(len(own) + 1, np.int64)
                at = places.values.to_numpy()
                at = at[at + window <= len(own)]
                np.add.at(edges, at, 1)
                np.add.at(edges, at + window, -1)
                stay = np.cumsum(edges[:-1]) == 0
                counts.append(len(own))
                removed.append(len(own) - int(stay.sum()))
                kept.append(b" ".join([w for w, s in zip(own, stay.tolist(), strict=True) if s]).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "positions").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def _repeated(firsts: DataFrame, window: int) -> DataFrame:
    """(doc_id, position) of every window of ``firsts`` (doc_id, text), no two with the same words, that also starts earlier."""
    runs = written(_chosen_runs(firsts, window), "runs")
    often = written(runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1"), "often")
    spots = written(_met(runs, often, ["run"]).groupBy("doc_id").agg(F.collect_list("position").alias("positions")), "spots")
    near = firsts.join(small_or_not(written(spots.select("doc_id"), "ids")), "doc_id", "left_semi").join(spots, "doc_id")
    windows = written(_extended(near, window), "windows")
    earliest = windows.groupBy("key", "more").agg(F.min("doc_id").alias("earliest"), F.count_if(~F.col("again")).alias("docs"), F.count("*").alias("n"))
    earliest = earliest.where("docs > 1").drop("docs")
    # all occurrences in a later document go, those with an earlier one in their own document anyway
    later = _met(windows, written(earliest, "earliest"), ["key", "more"]).where("doc_id > earliest").select("doc_id", "position")
    return later.union(windows.where("again").select("doc_id", "position"))


def without_repeats(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs``."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = written(_keys(given.where("doc_id IS NOT NULL")).where(F.col("n_words") >= window), "keys")
    groups = keyed.groupBy("words_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = _met(keyed, written(groups, "groups"), ["words_key"]).where("doc_id > first").select("doc_id").distinct()
    lost = small_or_not(written(copies, "copies"))
    firsts = given.where("doc_id IS NOT NULL").join(lost, "doc_id", "left_anti")
    gone = written(_repeated(firsts, window).groupBy("doc_id").agg(F.collect_set("position").alias("positions")), "gone")
    touched = small_or_not(written(gone.select("doc_id"), "touched"))

    kept = given.join(lost, "doc_id", "left_anti")
    whole = kept.join(touched, "doc_id", "left_anti").withColumn("positions", F.lit(None).cast("array<int>"))
    cut = kept.join(touched, "doc_id", "left_semi").join(gone, "doc_id")
    empty = _keys(given.join(lost, "doc_id", "left_semi")).select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    return empty.unionByName(_without(whole, window)).unionByName(_without(cut, window)).withColumnRenamed("doc_id", doc_id)
