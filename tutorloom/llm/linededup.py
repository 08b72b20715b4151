"""Line dedup as a segment-partition edit join.

Lines are compared without white space at their ends. A line goes if an equal line, or one within ``THRESHOLD`` edits
(insertions, deletions, substitutions of code points), stands earlier: in a document with a smaller id, or higher up in the
same one. Lines are judged on the input, not on what is left. Lines of fewer than ``MIN_CHARS`` characters always stay, lines of
fewer than ``NEAR_CHARS`` only go for equal lines.

Equal lines are grouped by 128 bits of hash. For near lines each distinct line is split into ``THRESHOLD`` + 1 segments; a line
within the threshold has one of them unchanged, moved by at most as many places as edits stand before it. So a line is
indexed under (its length, segment number, segment) and looks up those substrings of its own that can be such a segment of a line of
equal or up to ``THRESHOLD`` smaller length. Both sides carry the parities of their character bigrams in 64 buckets: an edit
changes four of them at most, so pairs that differ in more are not let out of the joins. What is left is verified by a banded
bit-parallel computation on the whole lines.

A list of lines under one key is not expanded into pairs: first all of it meets its earliest indexed line. A line that is near an
earlier one is decided by that; only pairs whose later line is undecided are looked at after that.

Defined results: null and empty texts have no lines to remove and stay as they are; rows without an id neither lose lines nor
make others lose them; rows with equal ids count as one document and all lose the lines at the same places; other columns are
kept, but those named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorloom.llm.common import BROADCAST_ROWS, slices, small_or_not, written
from tutorloom.llm.wordhash import scramble

THRESHOLD = 2
MIN_CHARS, NEAR_CHARS = 10, 20
BLANK = " \t\r\x0b\x0c"
SLICE_CHARS = 4_000_000
CHUNK_CHARS = 250_000  # characters of lines whose keys are computed at once
BASE = 0x9E3779B97F4A7C15


def within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits turn ``a`` into ``b``.

    Bit i of ``states[e]`` says that the first i characters of ``a`` can be turned into the part of ``b`` read so far with at
    most e edits. Only bits within ``most`` of the diagonal are kept. Equal ends are cut off before.
    """
    if abs(len(a) - len(b)) > most:
        return False
    start = 0
    shortest = min(len(a), len(b))
    while start < shortest and a[start] == b[start]:
        start += 1
    end = 0
    while end < shortest - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if max(len(a), len(b)) <= most:
        return True
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 2 << i
    states = [(2 << e) - 1 for e in range(most + 1)]
    full = (2 << len(a)) - 1
    for j, c in enumerate(b, 1):
        band = ((1 << 2 * most + 1) - 1 << j) >> most & full
        same = where.get(c, 0)
        before, now, left = 0, 0, []
        for e in range(most + 1):
            state = states[e] << 1 & same  # the characters match
            if e:
                state |= before | before << 1 | now << 1  # insertion; substitution; deletion
            state &= band
            before, now = states[e], state
            left.append(state)
        states = left
        if not states[most]:
            return False
    return bool(states[most] >> len(a) & 1)


def _segments(length: int) -> list[tuple[int, int]]:
    """Start and end of each segment; the longer ones come last."""
    n = THRESHOLD + 1
    short, longer = length // n, length % n
    bounds = [0]
    for i in range(n):
        bounds.append(bounds[-1] + short + (i >= n - longer))
    return list(zip(bounds, bounds[1:], strict=False))


def _probes(length: int) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment, start, end, is the index entry) of each substring that a line of ``length`` is filed under or looks up."""
    out = []
    for shorter in range(THRESHOLD + 1):
        for i, (low, high) in enumerate(_segments(length - shorter)):
            first = max(low - i, low + shorter - (THRESHOLD - i), 0)
            last = min(low + i, low + shorter + (THRESHOLD - i), length - (high - low))
            out += [(length - shorter, i, at, at + high - low, not shorter and at == low) for at in range(first, last + 1)]
    return out


def _signatures(lines: list[str]) -> np.ndarray:
    """Parities of the character bigrams of each line, in 64 buckets."""
    codes = np.frombuffer("\n".join(["", *lines, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(x) + 1 for x in lines])
    pair = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    bits = np.uint64(1) << (pair >> np.uint64(58))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return np.bitwise_xor.reduceat(bits[: ends[-1]], starts).view(np.int64) if len(lines) else np.array([], np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _keyed(lines: list[str], docs: list[int], probes: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Columns key, is_index, line, signature and doc_id of ``_filed``.

    Substrings are hashed as differences of running polynomial sums, shifted to the same power; unequal ones that share a hash would only be verified in vain.
    """
    lengths = np.array([len(x) for x in lines], np.int64)
    for n in np.unique(lengths).tolist():
        if n not in probes:
            probes[n] = np.array([(a, b, length * (THRESHOLD + 1) + i, own) for length, i, a, b, own in _probes(n) if length >= NEAR_CHARS], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble(codes + np.uint64(1)) * _powers(BASE, len(codes)), dtype=np.uint64)])
    back = _powers(pow(BASE, -1, 1 << 64), len(codes))
    own = [probes[n] for n in lengths.tolist()]
    counts = [len(x) for x in own]
    low, high, number, index = np.concatenate(own).T
    at = np.repeat(starts, counts)
    low, high = low + at, high + at
    key = scramble(scramble((sums[high] - sums[low]) * back[low]) + number.astype(np.uint64) * np.uint64(BASE))
    names = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in lines], np.uint64)
    return [key.view(np.int64), index.astype(bool), np.repeat(names.view(np.int64), counts), np.repeat(_signatures(lines), counts), np.repeat(np.array(docs, np.int64), counts)]


def _filed(docs: DataFrame) -> DataFrame:
    """(key, is_index, line, signature, doc_id): what each line is filed under and looks up; equal lines of a slice once, with their smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes: dict[int, np.ndarray] = {}
        for part in slices(batches, "text", SLICE_CHARS):
            first: dict[str, int] = {}
            for i, text in sorted(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True), key=lambda row: row[0]):
                for x in text.split("\n") if text else ():
                    if len(line := x.strip(BLANK)) >= NEAR_CHARS:
                        first.setdefault(line, i)
            lines, ids = list(first), list(first.values())
            chunk = np.cumsum([len(x) for x in lines]) // CHUNK_CHARS
            for low, high in pairwise([0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(lines)] if lines else []):
                columns = _keyed(lines[low:high], ids[low:high], probes)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "is_index", "line", "signature", "doc_id"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, "key bigint, is_index boolean, line bigint, signature bigint, doc_id bigint")


def _verified(pairs: DataFrame) -> DataFrame:
    """(first_a, first_b) of the ``pairs`` (with text_a, text_b) whose texts are within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within(a, b, THRESHOLD) for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
            yield batch.select(["first_a", "first_b"]).filter(pa.array(near, pa.bool_()))

    kept = pairs.select("first_a", "first_b", "text_a", "text_b")
    return kept.mapInArrow(run, T.StructType(kept.schema.fields[:2]))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, at, line, more, text) of every line of ``docs`` (doc_id, text) that is long enough to go; ``line`` and ``more`` hash its text."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    rows = rows.select("doc_id", "at", F.btrim("text", F.lit(BLANK)).alias("text")).where(F.char_length("text") >= MIN_CHARS)
    return rows.select("doc_id", "at", F.xxhash64("text").alias("line"), F.xxhash64("text", F.lit(1)).alias("more"), "text")


def _lists(docs: DataFrame) -> DataFrame:
    """(key, is_index, line, signature, doc_id) of the keys under which different lines stand, one of them indexed; ``doc_id`` is the line's first."""
    filed = _filed(docs).repartition("key").groupBy("key", "line", "signature").agg(F.max("is_index").alias("is_index"), F.min("doc_id").alias("doc_id"))
    of_key = Window.partitionBy("key")
    counted = filed.withColumns({"n": F.count("*").over(of_key), "indexed": F.max("is_index").over(of_key)})
    return counted.where("n > 1 AND indexed").drop("n", "indexed")


def _side(lists: DataFrame, name: str, *more: str) -> DataFrame:
    return lists.select("key", *(F.col(c).alias(f"{c}_{name}") for c in ("line", "signature", "doc_id", *more)))


def _close() -> Column:
    return (F.col("line_a") != F.col("line_b")) & (F.bit_count(F.col("signature_a").bitwiseXOR(F.col("signature_b"))) <= 4 * THRESHOLD)


def _unordered(pairs: DataFrame) -> DataFrame:
    """A pair once, whichever side was indexed."""
    return pairs.select(F.least("line_a", "line_b").alias("line_a"), F.greatest("line_a", "line_b").alias("line_b")).distinct()


def _late(pairs: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """(line, doc_id, at): the later line of each of ``pairs`` (line_a, line_b) within the threshold, and where it stands first."""
    ends = pairs.select("line_a").union(pairs.select("line_b")).distinct().withColumnRenamed("line_a", "line")
    spots = written(firsts.join(small_or_not(written(ends, "ends")), "line", "left_semi").select("line", "first.doc_id", "first.at"), "spots")
    wanted = small_or_not(written(spots.select("doc_id").distinct(), "wanted"))
    spelled = occurrences(docs.join(wanted, "doc_id", "left_semi")).select("doc_id", "at", "text").join(spots, ["doc_id", "at"])
    spelled = written(spelled.select("line", F.struct("doc_id", "at", "line").alias("first"), "text"), "spelled")

    def end(name: str) -> DataFrame:
        return spelled.select(*(F.col(c).alias(f"{c}_{name}") for c in ("line", "first", "text")))

    near = _verified(pairs.join(end("a"), "line_a").join(end("b"), "line_b"))
    return near.select(F.greatest("first_a", "first_b").alias("late")).select("late.line", "late.doc_id", "late.at").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, at): the lines of ``docs`` (doc_id, text) that go, each once."""
    given = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    lines = written(occurrences(given).select("doc_id", "at", "line", "more"), "lines")
    firsts = written(lines.groupBy("line", "more").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")), "firsts")

    lists = written(_lists(given), "lists")
    hubs = lists.where("is_index").groupBy("key").agg(F.min(F.struct("doc_id", "line", "signature")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.line").alias("line_a"), F.col("hub.signature").alias("signature_a"))
    star = written(_unordered(hubs.join(_side(lists, "b"), "key").where(_close())), "star")
    late = written(_late(star, firsts, given), "late")

    decided = late.select("line").distinct().withColumn("decided", F.lit(True))
    open_lists = lists.join(decided, "line", "left").withColumn("open", F.col("decided").isNull()).drop("decided")
    # the later line of a pair must be undecided; which of two lines of one document is later isn't known here
    useful = (F.col("open_b") & (F.col("doc_id_a") <= F.col("doc_id_b"))) | (F.col("open_a") & (F.col("doc_id_b") <= F.col("doc_id_a")))
    rest = _side(open_lists.where("is_index"), "a", "open").join(_side(open_lists, "b", "open"), "key").where(_close() & useful)
    rest = written(_unordered(rest).join(star, ["line_a", "line_b"], "left_anti"), "rest")
    late = late.union(_late(rest, firsts, given)).select("doc_id", "at")
    repeats = lines.join(firsts.where("n > 1").select("line", "more", "first"), ["line", "more"]).where(F.struct("doc_id", "at") > F.col("first")).select("doc_id", "at")
    return late.union(repeats).distinct()


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the text without removed lines), ``n_lines`` and ``n_removed``."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    places = written(removed_lines(given), "gone")
    gone = places.groupBy(F.col("doc_id").alias(doc_id)).agg(F.sort_array(F.collect_list("at")).alias("__gone"))
    # few enough numbers go to the texts; beyond the bound both sides are shuffled
    gone = F.broadcast(gone) if places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone
    joined = docs.join(gone, doc_id, "left")
    lines = F.split(F.col(text), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        *(c for c in docs.columns if c not in ("kept", "n_lines", "n_removed")),
        F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept).alias("kept"),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
