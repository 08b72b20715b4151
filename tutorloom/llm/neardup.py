"""Near-duplicates by runs of neighbouring hashes of one hash function.

A text's set is its distinct runs of ``SHINGLE`` words (A-Z in lower case), or all its words if it has fewer. Texts with equal
sets are one class.

Inverted lists. The hashes of a set are sorted, and a class is filed under runs of ``RUN`` neighbouring ones, the ``FILED`` smallest
by a hash of the run. Two sets that share s of u shingles share every run of their union that no other shingle interrupts. If all runs are
filed (up to ``FILED``), linked sets share one for certain: u >= 16 shingles with at most u / 5 interruptions leave four neighbours
somewhere; smaller unions leave three, or two (u = 5), and have runs of that length filed as well. Of larger sets a linked pair is missed only if none of
its shared runs, 0.4 of u at a similarity of 0.8, is among the smallest: with a probability below 1e-8. A run of four that two unrelated texts of
similarity 0.01 share has a chance of 1e-8, so the lists grow with the groups of near copies and not with the square of the corpus.

No list is expanded into pairs. Its hub, the member with the most shared runs, meets every member (star), in whole sets. Members that
the hub is linked with are connected already. A member around the hub (similarity ``AROUND`` or more) without a link to it, a stray, only needs
one link to a connected one or to another stray. Members far from the hub meet the others of their list that aren't near it. By the triangle inequality
of the Jaccard distance a link between a near and a far member would need a larger difference than ``AROUND`` to ``NEAR`` leaves room for.
These groups are compared in tiles: two blocks of whole sets of a group, cut by their number of shingles, meet in one task, and what leaves a tile are the
edges of a forest, not its pairs.

Defined results: null, empty and wordless texts have an empty set, are linked with nothing and kept; rows without an id are
linked with nothing and kept, with a null component; rows with the same id are one document; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorloom.llm import wordhash
from tutorloom.llm.common import discard, slices, small_or_not, written
from tutorloom.llm.components import components

SHINGLE = 2
RUN, FILED = 4, 96
FILED_RUNS = ((2, 4, 5), (3, 5, 15), (RUN, 13, None))  # length of the runs, sizes of the sets that file them
PERCENT = 80  # least similarity of a link
AROUND, NEAR = 0.3, 0.75  # similarity to a hub
SLICE_CHARS = 4_000_000
TILE_VALUES = 4_000_000  # shingles of one side of a tile


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    words = wordhash.hashed(texts, lambda t: t.lower().split())  # of bytes: both know ASCII alone
    pairs = wordhash.runs(words.hashes, SHINGLE).view(np.int64)
    for low, high in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if high - low >= SHINGLE:
            yield np.unique(pairs[low : high - SHINGLE + 1])
        else:
            yield wordhash.scramble(words.hashes[low:high]).view(np.int64)  # one word or none


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts) if parts else np.array([], np.int64)))


def _runs(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Of each set (sorted distinct hashes) the hashes of the runs under which it is filed."""
    flat = np.concatenate(sets).view(np.uint64) if sets else np.zeros(0, np.uint64)
    hashes = {length: wordhash.runs(flat, length).view(np.int64) for length, _, _ in FILED_RUNS}
    end = 0
    for own in sets:
        start, end = end, end + len(own)
        found = [hashes[length][start : end - length + 1] for length, least, most in FILED_RUNS if least <= len(own) and (most is None or len(own) <= most)]
        runs = found[0] if len(found) == 1 else np.concatenate([flat[:0].view(np.int64), *found])
        yield np.partition(runs, FILED)[:FILED] if len(runs) > FILED else runs


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, runs) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_CHARS):
            sets = list(_sets(part.column("text").to_pylist()))
            sizes = pa.array([len(own) for own in sets], pa.int64())
            keys = pa.array([xxhash.xxh3_128_digest(own.tobytes()) for own in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, keys, _list_array(list(_runs(sets)))], names=["doc_id", "n_shingles", "set_key", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_key binary, runs array<bigint>")


def whole_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _list_array(list(_sets(part.column("text").to_pylist())))], names=["doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shingles array<bigint>")


def _one_a_document(sets: DataFrame, repeated: DataFrame) -> DataFrame:
    """``sets`` with one row for each of the ``repeated`` ids; the others, which are nearly all, aren't moved for that."""
    repeated = small_or_not(written(repeated, "repeated"))
    return sets.join(repeated, "rid", "left_anti").union(sets.join(repeated, "rid", "left_semi").dropDuplicates(["rid"]))


def lists_of(reps: DataFrame) -> DataFrame:
    """(value, hub, rid) of the inverted lists of classes ``reps`` (rid, runs)."""
    rows = reps.select("rid", F.explode("runs").alias("value"))
    common = rows.groupBy("value").agg(F.count("*").alias("size")).where("size > 1").select("value")
    lists = written(rows.join(common, "value").select("rid", "value"), "lists")
    shared = lists.select("rid", "value", F.count("*").over(Window.partitionBy("rid")).alias("shared"))
    shared = written(shared, "shared")
    hubs = shared.groupBy("value").agg(F.min(F.struct((-F.col("shared")).alias("order"), "rid")).alias("hub"))
    return written(shared.join(hubs, "value").select("value", F.col("hub.rid").alias("hub"), "rid"), "placed")


def _common(left: list[np.ndarray], right: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """How many numbers below ``width`` each set in ``left`` has in common with each in ``right``, whose sets begin at ``starts`` (none is empty)."""
    bits = 16 if max(map(len, left)) < 1 << 16 else 32
    out = np.empty((len(left), len(starts)), np.int64)
    for i in range(0, len(left), 64 // bits):  # several counters share a number
        some = left[i : i + 64 // bits]
        marks = np.zeros(width, np.uint64)
        for k, own in enumerate(some):
            marks[own] += np.uint64(1 << k * bits)
        sums = np.add.reduceat(marks[right], starts)
        for k in range(len(some)):
            out[i + k] = (sums >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    return out


def _forest(sets: list[np.ndarray], stray: np.ndarray, left: np.ndarray, right: np.ndarray, tied: np.ndarray) -> list[tuple[int, int]]:
    """Edges between sets of one group that connect what links between a stray of the block ``left`` and a set of the block ``right`` connect; the tied are connected."""
    label = np.where(tied, -1, np.arange(len(sets)))
    rows, others = np.flatnonzero(stray & left), np.flatnonzero(right)
    lengths = np.array([len(x) for x in sets])
    values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    numbers = numbers.astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    edges = []
    for i in range(0, len(rows), 16):
        some = rows[i : i + 16]
        low, high = lengths[some].min() * PERCENT, lengths[some].max() * 100
        open_ = others[(label[others][:, None] != label[some][None, :]).any(axis=1) & (100 * lengths[others] >= low) & (PERCENT * lengths[others] <= high)]
        if not len(open_):
            continue
        starts = np.concatenate([[0], np.cumsum(lengths[open_])])[:-1]
        at = np.arange(lengths[open_].sum()) + np.repeat(begin[open_] - starts, lengths[open_])
        common = _common([numbers[begin[r] : begin[r + 1]] for r in some], numbers[at], starts, len(values))
        linked = 100 * common >= PERCENT * (lengths[some][:, None] + lengths[open_][None, :] - common)
        for r, row in zip(some, linked, strict=True):
            partners = open_[row & (label[open_] != label[r])]
            for other in partners[np.unique(label[partners], return_index=True)[1]]:
                edges.append((r, other))
                label[label == label[other]] = label[r]
    return edges


def forests(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): edges that connect what links connect in each group of ``members`` (key, rid, n, stray, tied).

    Every stray meets all members of its group; ``tied`` ones are known to be connected. ``sets`` is (rid, shingles).
    """
    spark = members.sparkSession
    size = members.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stray"), F.col("n"))).alias("strays")).where("strays > 0")
    cut = size.select("key", F.monotonically_increasing_id().alias("group"), "n", *(F.ceil(F.col(c) / TILE_VALUES).alias(name) for c, name in (("strays", "lefts"), ("n", "rights"))))
    cut = written(cut, "groups")
    total = cut.agg(F.sum("n")).first()[0] or 0
    # groups of one tile share tasks
    shares = max(4 * spark.sparkContext.defaultParallelism, total // TILE_VALUES + 1)
    blocks = members.join(cut.drop("n"), "key")
    spot = F.xxhash64("rid")
    blocks = blocks.select("group", "rid", "stray", "tied", "lefts", "rights", F.when(F.col("stray"), F.pmod(spot, "lefts")).alias("i"), F.pmod(spot, "rights").alias("j"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1))
    as_left = blocks.where("stray").select("*", every.alias("right_block")).select("group", "rid", "stray", "tied", "rights", F.col("i").alias("left_block"), "right_block", F.lit(True).alias("left"), (F.col("j") == F.col("right_block")).alias("right"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1))
    as_right = blocks.select("*", every.alias("left_block")).where("NOT stray OR i <> left_block").select("group", "rid", "stray", "tied", "rights", "left_block", F.col("j").alias("right_block"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    dealt = as_left.union(as_right)
    tile = F.when(F.col("rights") == 1, F.pmod(F.xxhash64("group"), F.lit(shares))).otherwise(-1 - F.pmod(F.xxhash64("group", "left_block", "right_block"), F.lit(1 << 62)))
    dealt = dealt.select("group", "rid", "stray", "tied", "left", "right", tile.alias("tile")).join(sets, "rid")
    kind = members.schema["rid"].dataType.simpleString()

    def compare(part: pa.Table) -> pa.Table:
        part = part.sort_by("group").combine_chunks()
        flat = part.column("shingles").combine_chunks() if isinstance(part.column("shingles"), pa.ChunkedArray) else part.column("shingles")
        bounds = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))])
        values = flat.flatten().to_numpy(zero_copy_only=False)
        flags = {c: part.column(c).to_numpy() for c in ("stray", "left", "right", "tied")}
        group = part.column("group").to_numpy()
        a, b = [], []
        ends = [*np.flatnonzero(np.diff(group)) + 1, len(group)]
        for low, high in zip([0, *ends], ends):
            found = _forest([values[bounds[r] : bounds[r + 1]] for r in range(low, high)], **{c: x[low:high] for c, x in flags.items()})
            a += [low + x for x, _ in found]
            b += [low + y for _, y in found]
        ids = part.column("rid")
        return pa.table([ids.take(pa.array(x, pa.int64())) for x in (a, b)], names=["a", "b"])

    return written(dealt.repartition(shares, "tile").groupBy("tile").applyInArrow(compare, f"a {kind}, b {kind}"), "forest")


def links(docs: DataFrame, placed: DataFrame, repeated: DataFrame) -> DataFrame:
    """(a, b): pairs of classes that connect what links connect, and nothing else. ``placed`` comes from ``lists_of``; ``repeated`` (rid) names the ids of several rows."""
    ends = small_or_not(written(placed.select("rid").distinct(), "ends"))  # the hubs are members too
    sets = whole_sets(docs.join(ends.withColumnRenamed("rid", "doc_id"), "doc_id", "left_semi"))
    sets = _one_a_document(written(sets.select(F.col("doc_id").alias("rid"), "shingles"), "sets"), repeated)

    def of(name: str) -> DataFrame:
        return sets.select(F.col("rid").alias(name), F.col("shingles").alias(f"{name}_set"))

    star = placed.where("rid <> hub").select("hub", "rid").distinct()
    star = star.join(of("rid"), "rid").join(of("hub"), "hub")
    common, n = F.size(F.array_intersect("rid_set", "hub_set")), F.size("rid_set")
    star = star.select("hub", "rid", n.alias("n"), common.alias("common"), (n + F.size("hub_set") - common).alias("union"))
    star = written(star.select("hub", "rid", "n", (F.col("common") / F.col("union")).alias("share"), (100 * F.col("common") >= PERCENT * F.col("union")).alias("linked")), "star")

    around = star.where(F.col("share") >= AROUND).select(F.col("hub").alias("key"), "rid", "n", (~F.col("linked")).alias("stray"), F.col("linked").alias("tied"))
    outer = placed.where("rid <> hub").join(star.where(F.col("share") < NEAR), ["hub", "rid"])
    outer = outer.select(F.col("value").alias("key"), "rid", "n", (F.col("share") < AROUND).alias("stray"), F.lit(False).alias("tied"))
    return star.where("linked").select(F.col("hub").alias("a"), F.col("rid").alias("b")).union(forests(around, sets)).union(forests(outer, sets))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketched = written(sketches(given).withColumn("row", F.monotonically_increasing_id()), "sketches")
    marked = written(sketched.select("doc_id", "n_shingles", "set_key"), "marked")
    filled = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("set_key").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = written(classes.select("set_key", F.col("first.doc_id").alias("rid"), "first.row"), "classes")
    reps = filled.join(small_or_not(classes.select("row")), "row", "left_semi")
    placed = lists_of(reps.select(F.col("doc_id").alias("rid"), "runs"))
    discard(sketched)
    repeated = marked.groupBy(F.col("doc_id").alias("rid")).agg(F.count("*").alias("rows")).where("rows > 1").select("rid")
    groups = components(links(given, placed, repeated))
    classes = classes.join(groups, F.col("rid") == F.col("node"), "left").select("set_key", F.coalesce("component", "rid").alias("component"))
    key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key"))
    joined = marked.select("doc_id", "n_shingles", key.alias("set_key")).join(classes, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(F.col("doc_id").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
