"""Near-duplicate removal by TF-IDF cosine similarity with an order-defined winner.

A document is removed when its similarity to an *earlier kept* document exceeds the threshold, i.e.
the kept documents are the first maximal independent set, in id order, of the similarity graph. The
graph is never built whole:

1. Only the vocabulary (at most ``max_terms`` terms) matters, so a document becomes a short list of
   term numbers and counts. Documents with the same counts are folded onto their first member by one
   aggregation, however many there are.
2. Unit vectors whose dot product exceeds the threshold are close in every orthogonal projection. A
   vector is filed in a cell of a grid over a few axes, as wide as that distance, and meets the
   vectors of its own and the adjacent cells only. The axes come from a bounded sample; they decide
   what is skipped, never a result.
3. Cells are cut into blocks, a block is packed into one row, and two blocks are one task's tile. Counts
   travel, weights are computed inside the task, so a copy of a vector costs a few bytes a term. A tile multiplies
   the norms that the vectors have on ``GROUPS`` groups of terms: no dot product is larger than that of the
   norms. The pairs that this leaves, a few in a thousand, are multiplied term by term; nothing but what is
   surely similar leaves a tile.
4. Documents are settled in steps that follow the ids, each several times as long as all before. What an
   earlier kept document covers goes first and leaves a tile as an id, not as pairs: groups of near
   copies collapse there. The pairs within the rest of a step decide the others round by round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tutorloom.functions import text as T
from tutorloom.session import MAX_LOOKUP_ROWS, bounded_rows, ranked, write_step

AXES = 4  # of the grid
BLOCK = 65_536  # most vectors of a tile's side
BLOCK_TERMS = 4_000_000  # and about the most terms of all its vectors
GROUPS = 64  # of terms
DENSE = 0.02  # share of the pairs from which whole vectors are multiplied
PART = 2_048  # vectors of one matrix product
MIN_BLOCK = 1_024
PAIR_BUDGET = 1_000  # pairs per document up to which the first step compares directly: it takes twice as many documents
GROWTH = 8  # times the documents before, for every further step
SAMPLE = 4_000  # vectors that the axes are taken from


def vocabulary(tokens: DataFrame, size: int) -> list[str]:
    """The ``size`` most frequent 1-2-gram terms of the ``tokens``; ties by term.

    A pair is no more frequent than either of its words, so only the pairs of words that are themselves frequent enough are counted.
    """
    words = write_step(tokens.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "words")
    top = words.orderBy(F.desc("n"), "term").limit(size).agg(F.count("*").alias("words"), F.min("n").alias("n")).first()
    frequent = words.filter(F.col("n") >= (top["n"] if top["words"] == size else 0)).select("term")
    n = F.greatest(F.size("tokens") - 1, F.lit(0))
    neighbours = F.arrays_zip(F.slice("tokens", 1, n).alias("a"), F.slice("tokens", 2, n).alias("b"))
    pairs = tokens.filter(F.size("tokens") > 1).select(F.explode(neighbours).alias("p")).select("p.a", "p.b")
    if frequent.count() <= MAX_LOOKUP_ROWS:  # with a great many words of the least count all pairs are counted
        for side in ("a", "b"):
            pairs = pairs.join(F.broadcast(frequent.withColumnRenamed("term", side)), side)
    counts = words.unionByName(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).select(F.concat_ws(" ", "a", "b").alias("term"), "n"))
    return [r["term"] for r in bounded_rows(counts.orderBy(F.desc("n"), "term").limit(size).select("term"))]


def term_counts(tokens: DataFrame, key: str, vocab: list[str]) -> DataFrame:
    """(key, idx, n): vocabulary terms of each document, ascending, and how often they stand there.

    Counting happens inside each batch, without a shuffle; words are looked up once and pairs are
    pairs of their numbers. Documents without any vocabulary term have no direction and are left out.
    """
    terms = [t.split(" ") for t in vocab]
    words = sorted({w for t in terms for w in t})
    number = {w: i for i, w in enumerate(words)}
    single = np.full(len(words), -1)
    for i, t in enumerate(terms):
        if len(t) == 1:
            single[number[t[0]]] = i
    codes = sorted((number[t[0]] * len(words) + number[t[1]], i) for i, t in enumerate(terms) if len(t) == 2)
    pairs, of_pair = (np.array(x, np.int64) for x in (zip(*codes) if codes else ([], [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for batch in batches:
            lists = batch.column("tokens")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            idx = single[at]
            alone = (at >= 0) & (idx >= 0)
            found = [row[alone] * len(vocab) + idx[alone]]
            if len(pairs):
                both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:]))
                code = at[both] * len(words) + at[both + 1]
                place = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
                hit = pairs[place] == code
                found.append(row[both[hit]] * len(vocab) + of_pair[place[hit]])
            cells, n = np.unique(np.concatenate(found), return_counts=True)
            held = np.bincount(cells // len(vocab), minlength=len(sizes))
            bounds = pa.array(np.concatenate([[0], np.cumsum(held[held > 0])]), pa.int32())
            arrays = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (cells % len(vocab), n)]
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(pa.array(held > 0)), *arrays], [key, "idx", "n"])

    kind = tokens.schema[key].dataType.simpleString()
    return write_step(tokens.select(key, "tokens").mapInArrow(run, f"`{key}` {kind}, idx array<int>, n array<int>"), "counts")


def inverse_frequencies(counts: DataFrame, size: int, n_docs: int) -> np.ndarray:
    """Weight of one occurrence of each of the ``size`` terms."""
    df = {r["t"]: r["df"] for r in bounded_rows(counts.select(F.explode("idx").alias("t")).groupBy("t").agg(F.count("*").alias("df")))}
    return np.array([math.log((1.0 + n_docs) / (1.0 + df.get(t, 0))) + 1.0 for t in range(size)])


PACKED = ("ids", "sizes", "idx", "n")


class Rows:
    """Vectors of an Arrow table with idx and n, as flat arrays."""

    def __init__(self, table: pa.Table | pa.RecordBatch, idf: np.ndarray):
        def flat(c: str) -> np.ndarray:
            column = table.column(c)
            return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)

        sizes = table.column("idx").combine_chunks().value_lengths() if isinstance(table, pa.Table) else table.column("idx").value_lengths()
        self._fill(table.column("id").to_numpy(), sizes.to_numpy(zero_copy_only=False), flat("idx"), flat("n"), idf)

    @classmethod
    def unpacked(cls, block: pa.Table, idf: np.ndarray) -> Rows:
        """Of one row of ``packed``."""
        self = cls.__new__(cls)
        ids, sizes, idx, n = (block.column(c)[0].as_buffer() for c in PACKED)
        ids = np.frombuffer(ids, np.int64)
        sizes = np.frombuffer(sizes, f"u{sizes.size // len(ids)}")
        idx, n = (np.frombuffer(x, f"u{x.size // int(sizes.sum())}") for x in (idx, n))
        self._fill(ids, sizes, idx, n, idf)
        return self

    def _fill(self, ids: np.ndarray, sizes: np.ndarray, idx: np.ndarray, n: np.ndarray, idf: np.ndarray) -> None:
        self.ids, self.idx, self.w = ids, idx.astype(np.int32), n * idf[idx]
        self.starts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        self.w /= np.sqrt(np.bincount(self._row(0, len(ids)), weights=self.w * self.w, minlength=len(ids)))[self._row(0, len(ids))]
        self.width = len(idf)

    def _row(self, start: int, stop: int) -> np.ndarray:
        return np.repeat(np.arange(stop - start), np.diff(self.starts[start : stop + 1]))

    def part(self, start: int, stop: int) -> np.ndarray:
        """Dense float32 vectors of some rows."""
        a, b = self.starts[start], self.starts[stop]
        out = np.zeros((stop - start, self.width), np.float32)
        out[self._row(start, stop), self.idx[a:b]] = self.w[a:b]
        return out

    def norms(self, group: np.ndarray) -> np.ndarray:
        """Length of each vector on each of the groups of terms, float32."""
        width = int(group.max()) + 1
        out = np.empty((len(self.ids), width), np.float32)
        for s in range(0, len(out), PART):
            e = min(s + PART, len(out))
            a, b = self.starts[s], self.starts[e]
            squares = np.bincount(self._row(s, e) * width + group[self.idx[a:b]], weights=self.w[a:b] ** 2, minlength=(e - s) * width)
            out[s:e] = np.sqrt(squares).reshape(e - s, width)
        return out

    def products(self, i: np.ndarray, dense: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the vectors ``i`` with rows ``j`` of ``dense``, pair by pair."""
        sizes = self.starts[i + 1] - self.starts[i]
        begin = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.starts[i] - begin, sizes)
        return np.add.reduceat(dense.reshape(-1)[np.repeat(j * self.width, sizes) + self.idx[at]] * self.w[at], begin)

    def dot(self, i: int, other: Rows, j: int) -> float:
        """In double precision."""
        left, right = slice(self.starts[i], self.starts[i + 1]), slice(other.starts[j], other.starts[j + 1])
        _, x, y = np.intersect1d(self.idx[left], other.idx[right], assume_unique=True, return_indices=True)
        return float(self.w[left][x] @ other.w[right][y])


def axes_of(nodes: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Orthonormal axes along which a bounded sample of the vectors lies widest."""
    picked = nodes.sample(fraction=min(1.0, 1.0 * SAMPLE / max(nodes.count(), 1)), seed=1).limit(2 * SAMPLE)
    rows = Rows(picked.select("id", "idx", "n").toArrow(), idf)
    m = rows.part(0, len(rows.ids)).astype(np.float64)
    return np.linalg.eigh(m.T @ m)[1][:, ::-1][:, :AXES]


def filed(nodes: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(id, idx, n, cell): the cell is an interval on every axis, no narrower than two similar vectors lie apart."""
    axes = axes_of(nodes, idf)
    width = max(math.sqrt(max(2.0 - 2.0 * threshold, 0.0)), 0.1) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Rows(batch, idf)
            at = np.concatenate([rows.part(s, min(s + PART, batch.num_rows)) @ axes for s in range(0, batch.num_rows, PART)])
            cell = np.floor(at / width + 0.5).astype(np.int32)
            cells = pa.FixedSizeListArray.from_arrays(pa.array(cell.reshape(-1)), cell.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "idx", "n")], cells], ["id", "idx", "n", "cell"])

    shorts = nodes.select(F.col("id").cast("long").alias("id"), F.col("idx").cast("array<int>"), F.col("n").cast("array<int>"))
    return write_step(shorts.mapInArrow(run, "id long, idx array<int>, n array<int>, cell array<int>"), "filed")


def adjacent(a: Column, b: Column) -> Column:
    return F.forall(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.abs(p["x"] - p["y"]) <= 1)


def term_groups(idf: np.ndarray) -> np.ndarray:
    """Number of the group of each term: groups weigh about the same, by what the terms' frequency lets expect. They decide what is skipped, never a result."""
    weight = idf**2 * np.exp(-idf)
    held, group = np.zeros(min(GROUPS, len(idf))), np.zeros(len(idf), np.int64)
    for term in np.argsort(-weight, kind="stable"):
        group[term] = held.argmin()
        held[group[term]] += weight[term]
    return group


def packed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, block, ids, sizes, idx, n): the vectors of a block in one row, short ones first, numbers in as few bytes as they need. ``cells`` is (cell, blocks)."""
    own = rows.join(F.broadcast(cells), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(block: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(block.column("idx"))
        block = block.take(np.argsort(sizes.to_numpy(), kind="stable")).combine_chunks()
        columns = [block.column("id"), pc.list_value_length(block.column("idx")), pc.list_flatten(block.column("idx")), pc.list_flatten(block.column("n"))]
        ids, *small = (c.to_numpy() for c in columns)
        blobs = [pa.array([c.tobytes()], pa.binary()) for c in (ids, *(c.astype(np.min_scalar_type(c.max())) for c in small))]
        return pa.table([block.column("cell").slice(0, 1), block.column("block").slice(0, 1), *blobs], names=["cell", "block", *PACKED])

    own = own.select("cell", "block", "id", "idx", "n")
    return write_step(own.groupBy("cell", "block").applyInArrow(pack, "cell array<int>, block int, " + ", ".join(f"{c} binary" for c in PACKED)), "blocks")


def tiled(left: DataFrame, right: DataFrame | None, idf: np.ndarray, threshold: float) -> DataFrame:
    """Similar pairs (a > b) within ``left``; or, with ``right``, ids (a) of the vectors of ``left`` similar to one of those."""
    spark = left.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    within = right is None

    def sizes(rows: DataFrame, side: str) -> DataFrame:
        counted = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("idx")).alias("terms"))
        return write_step(counted.select(F.col("cell").alias(f"{side}_cell"), "n", "terms"), "cells")

    def blocks(cells: DataFrame, side: str) -> DataFrame:
        """A side of a tile holds its share of all rows, so that there are tiles for all tasks, and ``BLOCK`` rows at most."""
        n = cells.agg(F.sum("n")).first()[0] or 0
        most = int(min(BLOCK, max(MIN_BLOCK, n / math.sqrt(2 * tasks))))
        return cells.select(f"{side}_cell", F.ceil(F.greatest(F.col("n") / most, F.col("terms") / BLOCK_TERMS)).cast("int").alias(f"{side}_blocks"))

    l_blocks = blocks(sizes(left, "l"), "l")
    r_blocks = l_blocks.toDF("r_cell", "r_blocks") if within else blocks(sizes(right, "r"), "r")

    def each(cells: DataFrame, side: str) -> DataFrame:
        return cells.withColumn(f"{side}_block", F.explode(F.sequence(F.lit(0), F.col(f"{side}_blocks") - 1))).drop(f"{side}_blocks")

    met = each(l_blocks, "l").crossJoin(each(r_blocks, "r")).filter(adjacent(F.col("l_cell"), F.col("r_cell")))  # a row a block: few
    if within:
        met = met.filter(F.struct("l_cell", "l_block") <= F.struct("r_cell", "r_block"))
    met = write_step(met.withColumn("tile", F.monotonically_increasing_id()), "tiles")

    l_packed = packed(left, l_blocks.toDF("cell", "blocks"))
    r_packed = l_packed if within else packed(right, r_blocks.toDF("cell", "blocks"))

    def dealt(blocks: DataFrame, tiles: DataFrame, side: str) -> DataFrame:
        tiles = tiles.select(F.col(f"{side}_cell").alias("cell"), F.col(f"{side}_block").alias("block"), "tile")
        return blocks.join(F.broadcast(tiles), ["cell", "block"]).select("tile", F.lit(side == "r").alias("right"), *PACKED)

    others = met.filter((F.col("l_cell") != F.col("r_cell")) | (F.col("l_block") != F.col("r_block"))) if within else met
    rows = dealt(l_packed, met, "l").unionByName(dealt(r_packed, others, "r"))
    group = term_groups(idf)

    def compare(tile: pa.Table) -> pa.Table:
        flags = tile.column("right").to_numpy()
        if flags.all() or not (within or flags.any()):  # a block that got no row
            return pa.table([pa.array([], pa.int64())] * (2 if within else 1), names=["a", "b"] if within else ["a"])
        x = Rows.unpacked(tile.filter(pa.array(~flags)), idf)
        alone = not flags.any()
        y = x if alone else Rows.unpacked(tile.filter(pa.array(flags)), idf)
        x_norms = x.norms(group)
        y_norms = x_norms if alone else y.norms(group)
        found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        open_ = np.ones(len(x.ids), bool)
        for t in range(0, len(y.ids), PART):
            j = np.arange(t, min(t + PART, len(y.ids)))
            dense = None
            for s in range(0, t + 1 if within and alone else len(x.ids), PART):
                i = s + np.flatnonzero(open_[s : s + PART])
                near = x_norms[i] @ y_norms[t : t + PART].T > threshold - 1e-4
                if within and alone and s == t:
                    near = np.triu(near, 1)
                flat = np.flatnonzero(near)
                if not len(flat):
                    continue
                row, col = flat // near.shape[1], flat % near.shape[1]
                dense = y.part(t, j[-1] + 1) if dense is None else dense
                if len(row) > DENSE * near.size:
                    products = (x.part(s, min(s + PART, len(x.ids)))[i - s] @ dense.T)[row, col]
                else:
                    products = x.products(i[row], dense, col)
                good = products > threshold + 1e-5
                unsure = np.flatnonzero(~good & (products > threshold - 1e-5))
                if not within:  # whoever is surely covered needs no closer look
                    unsure = unsure[~np.isin(row[unsure], row[good])]
                for k in unsure:
                    good[k] = x.dot(i[row[k]], y, j[col[k]]) > threshold
                row, col = row[good], col[good]
                if within:
                    found.append(np.stack([x.ids[i[row]], y.ids[j[col]]], axis=1))
                else:
                    open_[i[row]] = False
        if within:
            pairs = np.concatenate(found)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.table([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["a", "b"])
        return pa.table([pa.array(np.sort(x.ids[~open_]))], names=["a"])

    out = rows.repartition(tasks, "tile").groupBy("tile").applyInArrow(compare, "a long, b long" if within else "a long")
    return out if within else out.distinct()


def removed_along(edges: DataFrame) -> DataFrame:
    """Ids removed when every edge (a < b) lets a kept ``a`` remove ``b``.

    Each round settles the documents without an undecided earlier neighbour; the number of rounds
    is the longest chain of such dependencies.
    """
    removed = []
    edges = write_step(edges, "edges")
    while not edges.isEmpty():
        kept = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select("a").distinct()
        gone = write_step(edges.join(kept, "a", "left_semi").select("b").distinct(), "removed")
        removed.append(gone)
        edges = write_step(
            edges.join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti"), "edges"
        )
    out = edges.select("b")
    for part in removed:
        out = out.unionByName(part)
    return out.withColumnRenamed("b", "id")


def first_independent_set(nodes: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Ids of the documents removed because an earlier kept one is more similar than the threshold."""
    vectors = filed(nodes, idf, threshold)
    total = vectors.count()
    removed = vectors.select("id").limit(0)
    share = max(16, int(2 * PAIR_BUDGET))
    shares = []
    while share < total:
        shares.append(share / total)
        share *= GROWTH
    # where the steps end decides nothing but their length
    ends = [int(x) for x in vectors.approxQuantile("id", shares, 0.1 * shares[0])] if shares else []
    before = None
    for end in [*ends, None]:
        step = vectors if before is None else vectors.filter(F.col("id") > before)
        if end is not None:
            step = step.filter(F.col("id") <= end)
        if before is not None:
            kept = vectors.filter(F.col("id") <= before).join(removed, "id", "left_anti")
            covered = write_step(tiled(step, kept, idf, threshold).select(F.col("a").alias("id")), "removed")
            removed = removed.unionByName(covered)
            step = step.join(covered, "id", "left_anti")
        pairs = tiled(step, None, idf, threshold).select(F.col("b").alias("a"), F.col("a").alias("b"))
        removed = write_step(removed.unionByName(removed_along(pairs)), "removed")
        before = before if end is None else end
    return removed


def near_duplicates(docs: DataFrame, key: str, text: str, threshold: float = 0.95, max_terms: int = 1000) -> DataFrame:
    """Keys of the documents to remove."""
    n = docs.count()
    none = docs.select(key).limit(0)
    if n <= 1:
        return none
    tokens = write_step(docs.select(key, T.content_words(F.col(text)).alias("tokens")), "tokens")
    vocab = vocabulary(tokens, min(max_terms, n // 2))
    if not vocab:
        return none
    vectors = term_counts(tokens, key, vocab)
    idf = inverse_frequencies(vectors, len(vocab), n)
    shapes = write_step(vectors.select(key, F.sha2(F.to_json(F.struct("idx", "n")), 256).alias("shape")), "shapes")
    first = shapes.groupBy("shape").agg(F.min(key).alias("first"))
    copies = write_step(shapes.join(first, "shape").filter(F.col(key) != F.col("first")).select(key), "copies")
    nodes = vectors.join(copies, key, "left_anti").withColumnRenamed(key, "id")
    if isinstance(nodes.schema["id"].dataType, IntegralType):
        near = first_independent_set(nodes, idf, threshold).select(F.col("id").alias(key))
    else:  # keys of other types take part under their number in key order
        numbered = write_step(ranked(nodes, [F.col("id")], "numbered"), "numbered")
        found = first_independent_set(numbered.select(F.col("rank").alias("id"), "idx", "n"), idf, threshold).select(F.col("id").alias("rank"))
        near = numbered.join(found, "rank", "left_semi").select(F.col("id").alias(key))
    return copies.unionByName(near)
