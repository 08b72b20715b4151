"""Exact similarity work on dense vectors: top-k search, best matches, ordered leader covers, components.

Both sides are packed into blocks of unit vectors, one row a block, and the blocks meet in an equi-join on (group, salt): a cell of the grid is one matrix
product, and what leaves it is already reduced (the best k, the best match, a sum). The plan is the same for any number of vectors, and no vector
passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorloom.functions import vectors as V
from tutorloom.operators.lookups import top_n
from tutorloom.session import ranked, write_step

BLOCK_ROWS = 2048
BLOCK_BYTES = 2 << 20  # a block is full at either bound
BROADCAST_BYTES = 64 << 20  # blocks of one side, as counted, that may go to every executor

BLOCK = "ids array<long>, tags array<double>, m binary"
Block = tuple[np.ndarray, np.ndarray, np.ndarray]
Cell = Callable[[Block, Block], dict[str, np.ndarray]]


def unit_rows(values) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in values])
    if m.size == 0:
        return m.reshape(0, 0)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def packed(table: DataFrame, key: str, vector: str, tag: Column | None = None, groups: list[Column] | None = None) -> DataFrame:
    """Blocks of ``table`` in the order of its rows: ids, a number for each row, unit vectors as bytes, and the ``groups``, which are constant in a block."""
    groups = groups or []
    rows = table.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.lit(0.0) if tag is None else tag).cast("double").alias("tag"),
        *[g.cast("long").alias(f"g{i}") for i, g in enumerate(groups)],
    ).filter(F.col("v").isNotNull())
    names = [f"g{i}" for i in range(len(groups))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def block(at: tuple) -> pa.RecordBatch:
            ids, tags, m = (np.concatenate(x) for x in zip(*held.pop(at), strict=True))
            arrays = [pa.array([ids]), pa.array([tags]), pa.array([unit_rows(m).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array([x], pa.int64()) for x in at]], ["ids", "tags", "m", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in names], axis=1) if names else np.zeros((batch.num_rows, 0), np.int64)
            m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            full = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(8 * m.shape[1], 1)))
            for at in sorted(set(map(tuple, keys.tolist()))):
                mine = np.flatnonzero((keys == at).all(axis=1))
                while len(mine):
                    room = full - sum(len(x[0]) for x in held.get(at, []))
                    held.setdefault(at, []).append((ids[mine[:room]], tags[mine[:room]], m[mine[:room]]))
                    if len(mine) >= room:
                        yield block(at)
                    mine = mine[room:]
        for at in list(held):
            yield block(at)

    return rows.mapInArrow(run, ", ".join([BLOCK, *[f"{n} long" for n in names]]))


def opened(batch: pa.RecordBatch, side: str, row: int) -> Block:
    ids = batch.column(f"{side}_ids")[row].values.to_numpy()
    m = np.frombuffer(batch.column(f"{side}_m")[row].as_py()).reshape(len(ids), -1)
    return ids, batch.column(f"{side}_tags")[row].values.to_numpy(), m


def products(cells: DataFrame, cell: Cell, schema: str) -> DataFrame:
    """``cell`` of every row that holds two blocks (l_ids, l_tags, l_m, r_ids, r_tags, r_m)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out = cell(opened(batch, "l", row), opened(batch, "r", row))
                yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names)

    return cells.mapInArrow(run, schema)


def sided(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("ids", "tags", "m")], *[c for c in blocks.columns if c not in ("ids", "tags", "m")])


def light(blocks: DataFrame) -> DataFrame:
    """Written blocks, marked for broadcast if their counted bytes allow it."""
    size = blocks.agg(F.sum(F.length("m"))).first()[0] or 0
    return F.broadcast(blocks) if size <= BROADCAST_BYTES else blocks


def grid(left: DataFrame, right: DataFrame, n_right: int) -> DataFrame:
    """All pairs of a block of ``left`` (packed) and one of ``right`` (packed by ``group_of(n_right)``).

    Each left block meets every group of right blocks; with few groups the left blocks are salted, so the cells of a shuffled join still spread.
    """
    groups = max(1, -(-n_right // BLOCK_ROWS))
    salts = max(1, 2 * left.sparkSession.sparkContext.defaultParallelism // groups)
    met = left.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).withColumn("g0", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    there = light(right).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    return sided(met, "l").join(sided(there, "r"), ["g0", "salt"])


def group_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // BLOCK_ROWS))))


def compared(left: DataFrame, right: DataFrame, cell: Cell, schema: str, key: str = "id", vector: str = "embedding", left_tag: Column | None = None, right_tag: Column | None = None) -> DataFrame:
    """The rows that ``cell`` gives for all pairs of blocks of two tables of vectors."""
    n = right.count()
    dealt = right.withColumn("__g", group_of(key, n)).repartition("__g")
    blocks = write_step(packed(dealt, key, vector, right_tag, [F.col("__g")]), "blocks")
    return products(grid(packed(left, key, vector, left_tag), blocks, n), cell, schema)


def above(corpus: DataFrame, queries: DataFrame, threshold: float, k: int | None = None, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, similarity) for every pair reaching the threshold.

    With ``k`` each cell keeps its own best k per query, so at most k rows per query leave a cell.
    """

    def cell(left: Block, right: Block) -> dict[str, np.ndarray]:
        sims = left[2] @ right[2].T
        hit = sims >= threshold
        if k is not None and len(sims) > k:
            hit &= sims >= -np.partition(-sims, k - 1, axis=0)[k - 1]
        row, col = np.nonzero(hit)
        return {"query_id": right[0][col], "id": left[0][row], "similarity": sims[row, col]}

    return compared(corpus, queries, cell, "query_id long, id long, similarity double", key, vector)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k most similar corpus vectors of every query vector; ties by id."""
    found = above(corpus, queries, threshold, k, key, vector).withColumn("similarity", F.round("similarity", 9))
    return top_n(found, k, [F.col("similarity").desc(), F.col("id")], ["query_id"])


def search(corpus: DataFrame, query_vector: Column | list[float], k: int, threshold: float = 0.0, vector: str = "embedding", key: str = "id") -> DataFrame:
    """Top-k for one vector, entirely as expressions."""
    q = F.array(*[F.lit(float(x)) for x in query_vector]) if isinstance(query_vector, list) else query_vector
    scored = corpus.withColumn("similarity", V.cosine(F.col(vector), q)).filter(F.col("similarity") >= threshold)
    return top_n(scored, k, [F.col("similarity").desc(), F.col(key)])


def assign(table: DataFrame, centers: DataFrame, threshold: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, center, similarity): every vector with the most similar center above the threshold; of equal ones the smallest."""

    def cell(left: Block, right: Block) -> dict[str, np.ndarray]:
        order = np.argsort(right[0], kind="stable")
        sims = left[2] @ right[2][order].T
        at = sims.argmax(axis=1)
        best = sims[np.arange(len(at)), at]
        good = best > threshold
        return {"id": left[0][good], "center": right[0][order][at[good]], "similarity": best[good]}

    best = compared(table, centers, cell, "id long, center long, similarity double", key, vector)
    picked = F.max(F.struct("similarity", (-F.col("center")).alias("c")))
    return best.groupBy("id").agg(picked.alias("b")).select("id", (-F.col("b.c")).alias("center"), F.col("b.similarity").alias("similarity"))


def leaders(table: DataFrame, threshold: float, order: list[Column], key: str = "id", vector: str = "embedding", batch: int = BLOCK_ROWS) -> DataFrame:
    """Ids of the vectors not within ``threshold`` of an earlier leader, taken in ``order``.

    Exactly the sequential rule, in rounds over written tables. A round looks at the undecided vectors up to some rank, four times as far every time nothing
    is left there. Its blocks follow the order: a block settles each vector as soon as all earlier ones similar to it are settled, by itself for those of the block
    and by a flag for those of earlier blocks. Then everything that the new leaders cover goes. Rounds are bounded by the longest chain of such
    dependencies over blocks, plus the logarithm of the table's size.
    """
    placed = ranked(table.filter(F.col(vector).isNotNull()), [*order, F.col(key)], "order")
    undecided = write_step(placed.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), "rank"), "undecided")
    total = undecided.count()
    found = undecided.select("id").limit(0)
    reach = batch
    while True:
        head = undecided.filter(F.col("rank") <= reach)
        n = head.count()
        if not n:
            if reach >= total:
                return write_step(found.withColumnRenamed("id", key), "leaders")
            reach *= 4
            continue
        new = write_step(_settled(head, n, threshold, batch), "new_leaders")
        found = found.unionByName(new)
        covered = compared(undecided, undecided.join(new, "id", "left_semi"), _covers(threshold), "id long", "id", "v").distinct()
        undecided = write_step(undecided.join(new.unionByName(covered).distinct(), "id", "left_anti"), "undecided")


def _covers(threshold: float) -> Cell:
    def cell(left: Block, right: Block) -> dict[str, np.ndarray]:
        return {"id": left[0][((left[2] @ right[2].T) > threshold).any(axis=1)]}

    return cell


def _settled(head: DataFrame, n: int, threshold: float, batch: int) -> DataFrame:
    """(id): the vectors of ``head`` that are certain to be leaders."""
    block_of = F.floor((F.col("rank") - 1) / batch) if n > batch else F.lit(0).cast("long")  # few vectors are one block, however far apart their ranks
    ahead = head.select("id", "v", "rank", block_of.alias("b"))
    if n > batch:  # several blocks: who has a similar vector in an earlier one?
        dealt = ahead.repartition("b")
        right = write_step(packed(dealt, "id", "v", F.col("rank"), [group_of("b", n), F.col("b")]), "earlier")
        left = packed(dealt, "id", "v", F.col("rank"), [F.col("b")]).withColumnRenamed("g0", "lb")
        cells = grid(left, right.withColumnRenamed("g1", "rb"), n).filter("rb < lb")
        waiting = products(cells, _covers(threshold), "id long").distinct().withColumn("waits", F.lit(1.0))
        ahead = ahead.join(waiting, "id", "left").fillna(0.0, ["waits"])
    else:
        ahead = ahead.withColumn("waits", F.lit(0.0))

    def settle(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("rank").to_numpy(), kind="stable")
        ids, waits = rows.column("id").to_numpy()[order], rows.column("waits").to_numpy()[order] > 0
        m = unit_rows(rows.column("v").to_pylist())[order]
        near = (m @ m.T) > threshold
        leads, open_ = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        for i in range(len(ids)):
            earlier = near[i, :i]
            if (earlier & leads[:i]).any():
                continue
            open_[i] = waits[i] or (earlier & open_[:i]).any()
            leads[i] = not open_[i]
        return pa.table([pa.array(ids[leads])], names=["id"])

    return ahead.groupBy("b").applyInArrow(settle, "id long")  # a block holds ``batch`` ranks


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over undirected edges (a, b).

    Min-label propagation with shortcutting; labels are pre-combined by one aggregation per round. Rounds go on until no label changes.
    """
    both = write_step(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_step(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        offers = both.join(labels.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.min("component").alias("offer"))
        hop = labels.join(offers, labels["id"] == offers["b"], "left").select(
            "id", F.least("component", F.coalesce("offer", "component")).alias("component"), F.col("component").alias("old")
        )
        # shortcut: adopt the label of the label
        via = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = write_step(hop.join(via, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"), "old"), "labels")
        changed = not new.filter(F.col("component") != F.col("old")).isEmpty()
        labels = new.select("id", "component")
        if not changed:
            return labels
