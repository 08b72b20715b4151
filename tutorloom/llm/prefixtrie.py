"""The trie of conversation prefixes, with counts over subtrees.

1. Turns become narrow rows: a 128-bit digest of role and text, and a word count. They are sorted by ranges of (conversation, turn), so a huge
   conversation spans tasks. A prefix of d turns has the digest sum(x_i * B^i, i = 1..d) modulo 2^61 - 1, on two lanes; sums of slices are
   joined by adding, and taking turns out of the middle or putting others before them is a product with a power of B.
2. Grouping by (digest, depth) enumerates the distinct prefixes. All members of a group must agree on the digest of the last turn and on the
   prefix before it; by induction from the empty prefix the groups then are equal sequences. A collision starts over with other bases.
3. Nodes with more than ``LIMIT`` prefix rows below them are heavy: on each level there are at most rows / LIMIT. The subtrees that hang from heavy
   nodes are light; they are packed into shards, one task each. A shard numbers its digests by a minimal perfect hash, checks the stored digest of
   every slot it looks up, scatters the counts into flat arrays by slot, and adds them up through the array of parent slots, deepest level first.
4. Heavy nodes follow in slabs of levels, from the deepest to the root, by the same shard function. A slab holds at most ``LIMIT`` nodes or one level; the
   nodes of one level don't depend on each other and are dealt over as many shards as needed.

Defined results: null role and text are empty; turns of one conversation with equal numbers follow the digest of their role and text, and repeated
rows are turns of their own; null turns come first; rows without conv_id belong to no conversation and are left out. An empty table has no
conversation and gives no rows. A conversation of which nothing is left is a member of the root alone. Texts may have any length, for only
their digest moves. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorloom.llm.common import small_or_not, written

WORD = r"[^\x20\x09-\x0D]+"
SHARED, FAMILY = 4, 20  # fewer than SHARED turns come from the first conversation of the FAMILY
LIMIT = 250_000  # nodes of a shard: some 25 MB
LEVELS = 1024  # of a slab to begin with
NODE = ["d1", "d2", "depth"]

# --- prefix digests ---------------------------------------------------------------------------------------------

PRIME = (1 << 61) - 1
_P, _31, _30 = np.uint64(PRIME), np.uint64(31), np.uint64(30)
_LOW31, _LOW30, _61, _1 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(61), np.uint64(1)


def fold(x: np.ndarray) -> np.ndarray:
    """``x`` below 2^64, modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of numbers below the prime, from halves of 31 bits."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = al * bh + ah * bl
    return fold(ah * bh * np.uint64(2) + (mid >> _30) + ((mid & _LOW30) << _31) + al * bl)


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each of the exponents; negative ones mean the inverse."""
    if len(exponents) and exponents.min() < 0:
        return np.where(exponents < 0, power(pow(base, PRIME - 2, PRIME), np.maximum(-exponents, 0)), power(base, np.maximum(exponents, 0)))
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    while len(left) and left.any():
        out = np.where(left & _1, times(out, np.full(len(out), square)), out)
        square, left = times(np.array([square]), np.array([square]))[0], left >> _1
    return out


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return fold(a + b)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return fold(a + (_P - b))


def running(x: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime (fewer than 2^31 numbers)."""
    high, low = np.cumsum(x >> _31), np.cumsum(x & _LOW31)
    return plus(times(fold(high), np.full(len(x), np.uint64(1) << _31)), fold(low))


def bases(attempt: int) -> tuple[int, int]:
    return tuple(int(hashlib.sha256(f"prefix {lane} {attempt}".encode()).hexdigest()[:15], 16) for lane in (1, 2))


def longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _local_prefixes(base: tuple[int, int]):
    """Number of each turn in its part of a conversation, and the digest up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, sums = None, 0, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, h1, h2 = longs(batch, "conv_id", "h1", "h2")
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
            at = np.where(starts < 0, count + 1, 1) + np.arange(len(conv)) - np.maximum(starts, 0)
            digests = []
            for lane, h in enumerate((h1, h2)):
                upto = running(times(fold(h.astype(np.uint64)), power(base[lane], at)))
                before = np.concatenate([[np.uint64(0)], upto])[np.maximum(starts, 0)]
                digests.append(plus(minus(upto, before), np.where(starts < 0, sums[lane], np.uint64(0))))
            last, count, sums = conv[-1], int(at[-1]), [d[-1] for d in digests]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("part"), pa.array(at), batch.column("h1"), batch.column("h2"), batch.column("words"), *[pa.array(d.astype(np.int64)) for d in digests]],
                ["conv_id", "part", "at", "h1", "h2", "words", "s1", "s2"],
            )

    return run


def _shifts(base: tuple[int, int]):
    """What stands before each part of a conversation that several tasks hold."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        out, n, sums = [], 0, [np.zeros(1, np.uint64), np.zeros(1, np.uint64)]
        for r in parts.sort_values("part").itertuples():
            out.append((r.conv_id, r.part, n, int(sums[0][0]), int(sums[1][0])))
            for lane, s in enumerate((r.s1, r.s2)):
                sums[lane] = plus(sums[lane], times(np.array([s], np.uint64), power(base[lane], np.array([n]))))
            n += r.n
        return pd.DataFrame(out, columns=["conv_id", "part", "n_before", "o1", "o2"])

    return run


def _shifted(base: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, before, s1, s2, o1, o2 = longs(batch, "at", "n_before", "s1", "s2", "o1", "o2")
            sums = [plus(o.astype(np.uint64), times(s.astype(np.uint64), power(base[lane], before))) for lane, (s, o) in enumerate(((s1, o1), (s2, o2)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(at + before), batch.column("h1"), batch.column("h2"), batch.column("words"), *[pa.array(s.astype(np.int64)) for s in sums]],
                ["conv_id", "at", "h1", "h2", "words", "s1", "s2"],
            )

    return run


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(SHARED)).cast("int")


def own_turns(conversations: DataFrame, base: tuple[int, int]) -> DataFrame:
    """(conv_id, at, h1, h2, words, s1, s2): turns in order with their own prefix digests."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    part_of = lambda i: F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", part_of(0).alias("h1"), part_of(1).alias("h2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    local = written(dealt.drop("turn").mapInArrow(_local_prefixes(base), "conv_id long, part int, at long, h1 long, h2 long, words long, s1 long, s2 long"), "turns")
    # conversations that go on in another partition: two for each partition at most
    ends = local.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    cut = ends.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv_id")).groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    parts = local.join(F.broadcast(cut), "conv_id", "left_semi").groupBy("conv_id", "part").agg(
        F.max("at").alias("n"), F.max_by("s1", "at").alias("s1"), F.max_by("s2", "at").alias("s2")
    )
    shifts = written(parts.groupBy("conv_id").applyInPandas(_shifts(base), "conv_id long, part int, n_before long, o1 long, o2 long"), "shifts")
    return local.join(F.broadcast(shifts), ["conv_id", "part"], "left").mapInArrow(_shifted(base), "conv_id long, at long, h1 long, h2 long, words long, s1 long, s2 long")


def _rebuilt(base: tuple[int, int]):
    """Digests of own turns after the shared ones have been put in place of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, drop, kept, h1, h2 = longs(batch, "at", "h", "k", "h1", "h2")
            depth = at - drop + kept
            digests, parents = [], []
            for lane, h in enumerate((h1, h2)):
                own, cut, new = (x.astype(np.uint64) for x in longs(batch, f"s{lane + 1}", f"cut{lane + 1}", f"new{lane + 1}"))
                digest = plus(new, times(minus(own, cut), power(base[lane], kept - drop)))
                digests.append(digest)
                parents.append(minus(digest, times(fold(h.astype(np.uint64)), power(base[lane], depth))))
            columns = [pa.array(d.astype(np.int64)) for d in (*digests, *parents)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(depth), *columns, batch.column("h1"), batch.column("h2"), batch.column("words"), batch.column("length")],
                ["conv_id", "depth", "d1", "d2", "p1", "p2", "h1", "h2", "words", "length"],
            )

    return run


def prefixes(conversations: DataFrame, base: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """All prefixes but the empty one of the rebuilt conversations, and (conv_id, length) of every conversation."""
    turns = own_turns(conversations, base)
    opening = F.collect_list(F.when(F.col("at") < SHARED, F.struct("at", "s1", "s2", "h1", "h2", "words")))  # at most three
    heads = written(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(opening).alias("head")), "heads")
    home = heads.select(F.col("conv_id").alias("home"), F.col("head").alias("first"))
    shared = heads.withColumn("h", shared_turns(F.col("conv_id"))).withColumn("home", F.col("conv_id") - F.col("conv_id") % FAMILY)
    shared = shared.join(home, "home", "left").withColumn("k", F.least("h", F.coalesce(F.size("first"), F.lit(0))))
    upto = lambda head, i, lane: F.when(i > 0, F.get(F.col(head), i - 1)[f"s{lane}"]).otherwise(0)
    cut = F.least("h", F.size("head"))
    plan = written(
        shared.select(
            "conv_id", "h", "k", F.slice("first", 1, F.col("k")).alias("first"), (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
            *[upto("head", cut, lane).alias(f"cut{lane}") for lane in (1, 2)], *[upto("first", F.col("k"), lane).alias(f"new{lane}") for lane in (1, 2)],
        ),
        "plan",
    )
    own = turns.where(F.col("at") > shared_turns(F.col("conv_id"))).join(plan.drop("first"), "conv_id")
    schema = "conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, h1 long, h2 long, words long, length long"
    later = own.mapInArrow(_rebuilt(base), schema)
    taken = plan.where("k > 0").select("conv_id", "length", "first", F.posexplode("first").alias("i", "t"))
    before = lambda lane: F.when(F.col("i") > 0, F.get("first", F.col("i") - 1)[f"s{lane}"]).otherwise(0)
    early = taken.select(
        "conv_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("t.s1").alias("d1"), F.col("t.s2").alias("d2"), before(1).alias("p1"), before(2).alias("p2"),
        F.col("t.h1").alias("h1"), F.col("t.h2").alias("h2"), F.col("t.words").alias("words"), "length",
    )
    return written(early.unionByName(later), "prefixes"), plan.select("conv_id", "length")


# --- nodes ------------------------------------------------------------------------------------------------------


def distinct_prefixes(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(d1, d2, depth, p1, p2, conv_id, n_convs, words, below) of every node but the root, and whether all groups hold equal prefixes."""
    same = [F.min(c) == F.max(c) for c in ("h1", "h2", "p1", "p2")]
    nodes = written(
        rows.groupBy(*NODE).agg(
            F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("below"), (same[0] & same[1] & same[2] & same[3]).alias("sound"),
        ),
        "nodes",
    )
    return nodes.drop("sound"), nodes.where("NOT sound").isEmpty()


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct keys: on each level the keys that are alone at their place stay there, the rest go on to the next."""

    levels: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def place(keys: list[np.ndarray], level: int, size: int) -> np.ndarray:
        x = np.full(len(keys[0]), np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
        for k in keys:
            x = (x ^ k.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> _31
        return (x % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: list[np.ndarray]) -> PerfectHash:
        out, left, placed = cls(), np.arange(len(keys[0])), 0
        while len(left):
            size = 2 * len(left) + 1
            at = cls.place([k[left] for k in keys], len(out.levels), size)
            taken = np.bincount(at, minlength=size) == 1
            out.levels.append((size, taken, placed + np.cumsum(taken) - 1))
            placed += int(taken.sum())
            left = left[~taken[at]]
            if len(out.levels) > 200:
                raise ValueError("keys are not distinct")
        return out

    def slots(self, keys: list[np.ndarray]) -> np.ndarray:
        """Slot of each key; a key that isn't one of them gets any slot or -1."""
        out, left = np.full(len(keys[0]), -1), np.arange(len(keys[0]))
        for level, (size, taken, rank) in enumerate(self.levels):
            at = self.place([k[left] for k in keys], level, size)
            out[left[taken[at]]] = rank[at[taken[at]]]
            left = left[~taken[at]]
        return out


SHARD = "d1 long, d2 long, depth long, p1 long, p2 long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, hangs boolean"


def shard_counts(table: pa.Table) -> pa.Table:
    """Sums over the subtrees of a shard's nodes; ``hangs`` marks nodes whose parent isn't in the shard."""
    column = {n: table.column(n).to_numpy().astype(np.int64) for n in table.column_names}
    key = [column[n] for n in NODE]
    table_of = PerfectHash.of(key)
    slot = table_of.slots(key)
    flat = {n: np.empty(len(slot), np.int64) for n in column}
    for n, values in flat.items():
        values[slot] = column[n]
    up = [flat["p1"], flat["p2"], flat["depth"] - 1]
    parent = table_of.slots(up)
    there = parent >= 0
    for stored, wanted in zip((flat[n] for n in NODE), up, strict=True):
        there &= stored[np.maximum(parent, 0)] == wanted
    inside = np.flatnonzero(there)
    children = flat["children"] + np.bincount(parent[inside], minlength=len(slot))
    leaves = flat["leaves"] + (children == 0)
    saved = flat["saved"] + (flat["n_convs"] - 1) * flat["words"]
    order = inside[np.argsort(-flat["depth"][inside], kind="stable")]
    bounds = np.flatnonzero(np.diff(flat["depth"][order], prepend=-1)) if len(order) else np.array([], int)
    for begin, end in pairwise([*bounds, len(order)]):  # one level at a time, deepest first
        level = order[begin:end]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = pa.array(np.where(there, flat["conv_id"][np.maximum(parent, 0)], 0), mask=~there)
    kept = [flat[n] for n in ("d1", "d2", "depth", "p1", "p2", "conv_id", "n_convs")]
    return pa.table([*map(pa.array, kept), above, *map(pa.array, (children, leaves, saved, ~there))], names=[f.split()[0] for f in SHARD.split(", ")])


def folded(nodes: DataFrame, shard: Column, name: str) -> DataFrame:
    """``nodes`` (with children, leaves and saved tokens from outside the shard) after the sums of each shard."""
    rows = nodes.select(*NODE, "p1", "p2", "conv_id", "n_convs", "words", "children", "leaves", "saved", shard.alias("shard"))
    return written(rows.groupBy("shard").applyInArrow(lambda t: shard_counts(t.drop(["shard"])), SHARD), name)


def handed_up(done: DataFrame) -> DataFrame:
    """What the nodes that hang from another shard hand to their parents."""
    return done.where("hangs AND depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )


def subtree_counts(nodes: DataFrame, rows: DataFrame, root: DataFrame, limit: int) -> DataFrame:
    none = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    columns = [*NODE, "p1", "p2", "conv_id", "n_convs", "words"]
    heavy = written(nodes.where(F.col("below") > limit).select(*columns).unionByName(root.select(*columns)), "heavy")
    marks = small_or_not(heavy.select(*NODE))
    parents = small_or_not(heavy.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), (F.col("depth") + 1).alias("depth")))
    # each conversation enters the light part of the trie at one node: the top of the shard of all further nodes on its way
    tops = rows.join(parents, ["p1", "p2", "depth"], "left_semi").join(marks, NODE, "left_anti")
    tops = tops.select("conv_id", F.xxhash64(*NODE).alias("top"))
    light = nodes.where(F.col("below") <= limit).select(*columns, *none)
    shards = max(1, -(-light.count() // limit))
    done = folded(light.join(tops, "conv_id"), F.pmod("top", F.lit(shards)), "light")
    results, pending = [done], handed_up(done)

    def climb(low: int, high: int) -> None:
        """Levels from ``low`` to ``high`` - 1 of heavy nodes, deepest first."""
        nonlocal pending
        here = heavy.where(F.col("depth").between(low, high - 1))
        n = here.count()
        if not n:
            return
        if n > limit and high - low > 1:
            middle = (low + high) // 2
            climb(middle, high)
            climb(low, middle)
            return
        given = pending.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
        met = here.join(given, NODE, "left").fillna(0, ["children", "leaves", "saved"])
        step = folded(met, F.pmod(F.xxhash64(*NODE), F.lit(max(1, -(-n // limit)))), "heavy-counts")
        results.append(step)
        pending = pending.unionByName(handed_up(step))

    slabs = heavy.select(F.floor(F.col("depth") / LEVELS).alias("slab")).distinct().orderBy(F.desc("slab")).collect()
    for r in slabs:
        climb(r["slab"] * LEVELS, (r["slab"] + 1) * LEVELS)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    above = small_or_not(heavy.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above")))
    inside = found.where("NOT hangs OR depth = 0")
    hanging = found.where("hangs AND depth > 0").join(above, ["p1", "p2", "depth"]).withColumn("parent_conv_id", F.col("above")).drop("above")
    return inside.unionByName(hanging)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each run of rows with one node; only the state of one digest is held."""
    node, state = None, None
    for batch in batches:
        out = []
        d1, d2, depth, conv = longs(batch, *NODE, "conv_id")
        starts = np.flatnonzero(np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]) | (depth[1:] != depth[:-1])])) if len(conv) else []
        for a, b in pairwise([*starts, len(conv)]):
            text = ",".join(map(str, conv[a:b].tolist())).encode()
            if (here := (int(d1[a]), int(d2[a]), int(depth[a]))) == node:
                state.update(b"," + text)
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = here, hashlib.sha256(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], [*NODE, "ends_sha256"])


def end_digests(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(d1, d2, depth, ends_sha256) of the nodes at which conversations end."""
    zero = F.lit(0).cast("long")
    ends = rows.where("depth = length").select(*NODE, "conv_id").unionByName(lengths.where("length = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    return ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_end_digests, "d1 long, d2 long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    attempt, sound = 0, False
    while not sound:
        rows, lengths = prefixes(conversations, bases(attempt))
        nodes, sound = distinct_prefixes(rows)
        attempt += 1
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select("conv_id", "n_convs", *[zero.alias(c) for c in (*NODE, "words")], *[F.lit(-1).cast("long").alias(c) for c in ("p1", "p2")])
    found = subtree_counts(nodes, rows, root, limit).join(end_digests(rows, lengths), NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
