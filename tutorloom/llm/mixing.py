"""A mix of sources by target weights: Sainte-Laguë quotas of equal blocks for sources and shards, then seeded blocks.

1. Every source gets a target: its weight's share of all words, at most ``MOST`` times its own; what a source can't hold is shared again
   by weight. All that a round needs is the common level (words per unit of weight), so a round is one aggregate over the sources.
2. Words are handed out in blocks of ``block`` words. Seats (blocks) go to the highest quotients target / (2 k + 1), k being the seats a
   source has. Only quotients near the last seat are compared: the first seats of a source are settled by a bound, so some six rows
   a source are ranked, by a range exchange and not in one task. In the same way the seats of a source go to its shards by their words.
3. A shard is the documents of a source with the same residue of a seeded hash, ``SHARD_DOCS`` on average. In order of that hash its texts form a
   stream cut into blocks. Its seats take all blocks as often as they go round, and the rest as a run of blocks from a seeded place.

A hot source is many shards. No step depends on the order of rows, so a second run gives the same mix.

Defined results: a null or empty text has size 0 and takes 0; null sources are one source, the last; ids may repeat or be null, every row is a
document of its own, and rows of one id in one source stand next to each other in the stream by size. An empty table gives no rows; if
all sizes are 0, all targets are. A text may have any length. Other columns don't matter. Equal quotients go to the source first in order, and to
the shard with the smaller number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorloom.llm.common import small_or_not, written
from tutorloom.session import ranked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3  # times that a source, and a document, may be taken
BLOCK = 8  # words
SHARD_DOCS = 65_536
SLACK = 4  # seats beyond the upper bound that are compared, for blocks that are cut short at the end of a stream


def seeded(seed: int, *parts: Column) -> Column:
    """A number below 2^60 from the seed and the text of ``parts``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, seed: int, key: str, source: str, text: str) -> DataFrame:
    """(id, source, source_key, size, place): a document without its text. The key of a source has a fixed width."""
    return docs.select(
        F.col(key).alias("id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.md5(F.col(source).cast("string").cast("binary")), F.lit("null")).alias("source_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        seeded(seed, F.col(key)).alias("place"),
    )


def level(sources: DataFrame) -> float:
    """Words for a unit of weight once no target is above ``MOST`` times its source."""
    at = None
    while True:
        full = F.lit(False) if at is None else F.lit(at) * F.col("weight") > MOST * F.col("source_size")
        r = sources.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(full, MOST * F.col("source_size"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        new = ((r["total"] or 0) - (r["held"] or 0)) / r["weight"] if r["weight"] else at or 0.0
        if new == at:
            return at
        at = new


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source_key, source_rank, docs, source_size, weight, target) of every source, in order of code points, null last."""
    sums = sized.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = ranked(sums, [F.col("source").asc_nulls_last()], "llm-sources").withColumnRenamed("rank", "source_rank")
    turn = F.pmod(F.col("source_rank") - 1, F.lit(len(weights))).cast("int")
    sources = written(order.drop("source").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)), "weights")
    share = F.lit(level(sources)) * F.col("weight")
    return sources.withColumn("target", F.when(share > MOST * F.col("source_size"), (MOST * F.col("source_size")).cast("double")).otherwise(share))


def apportion(parties: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """``parties`` (party, votes, cap, and for each ``group`` the same seats_in_all) with ``seats`` by Sainte-Laguë, at most ``cap`` each.

    With n parties, N seats and V votes, votes * (N - n/2) / V, rounded down less one, is below what the party gets, and
    votes * (N + n/2) / V rounded up is above it, but for caps: the quotients between the two are ranked.
    """
    keys = [group] if group else []
    able = parties.where((F.col("votes") > 0) & (F.col("cap") > 0))
    whole = Window.partitionBy(*keys) if keys else None
    if keys:
        bounded = able.withColumn("all_votes", F.sum("votes").over(whole)).withColumn("n", F.count("*").over(whole))
    else:
        r = able.agg(F.sum("votes").cast("double").alias("v"), F.count("*").alias("n")).first()
        bounded = able.withColumn("all_votes", F.lit(r["v"] or 1.0)).withColumn("n", F.lit(r["n"]).cast("long"))
    exact = lambda sign: F.col("votes") * F.greatest(F.col("seats_in_all") + sign * F.col("n") / 2, F.lit(0.0)) / F.col("all_votes")
    bounded = written(
        bounded.withColumn("sure", F.least(F.col("cap"), F.greatest(F.floor(exact(-1) + 0.5) - 1, F.lit(0)))).withColumn(
            "most", F.least(F.col("cap"), F.floor(exact(1) + 0.5) + SLACK)
        ),
        f"{name}-bounds",
    )
    wanted = bounded.where("most > sure").withColumn("k", F.explode(F.sequence(F.col("sure"), F.col("most") - 1)))
    wanted = wanted.select(*keys, "party", (F.col("votes") / (2 * F.col("k") + 1)).alias("quotient"))
    order = [F.col("quotient").desc(), F.col("party")]
    if keys:
        left = bounded.groupBy(group).agg((F.first("seats_in_all") - F.sum("sure")).alias("left"))
        placed = wanted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).join(left, group).where("rank <= left")
    else:
        r = bounded.agg((F.first("seats_in_all") - F.sum("sure")).alias("left")).first()
        placed = ranked(wanted, order, f"llm-{name}").where(F.col("rank") <= (r["left"] or 0))
    more = placed.groupBy(*keys, "party").agg(F.count("*").alias("more"))
    seats = bounded.select(*keys, "party", "sure").join(more, [*keys, "party"], "left").select(*keys, "party", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("seats"))
    return parties.join(seats, [*keys, "party"], "left").withColumn("seats", F.coalesce("seats", F.lit(0)).cast("long"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 7,
    block: int = BLOCK,
    shard_docs: int = SHARD_DOCS,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row a document: key, size, source_size, target (its source's), taken (words, repeats counted)."""
    sized = written(sizes(docs, seed, key, source, text), "sizes")
    sources = written(targets(sized, weights).withColumn("shards", F.greatest(F.ceil(F.col("docs") / shard_docs), F.lit(1))), "targets")
    known = small_or_not(sources.select("source_key", "shards"))
    dealt = sized.join(known, "source_key").withColumn("shard", F.pmod("place", F.col("shards")))
    cells = written(
        dealt.groupBy("source_key", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block)).withColumn("cap", MOST * F.col("blocks")), "cells"
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    caps = cells.groupBy("source_key").agg(F.sum("cap").alias("cap"))
    parties = sources.join(caps, "source_key").select("source_key", F.col("source_rank").alias("party"), F.col("target").alias("votes"), "cap")
    quotas = apportion(parties.withColumn("seats_in_all", F.lit((2 * total + block) // (2 * block)).cast("long")), "source-seats")
    shards = cells.join(quotas.select("source_key", F.col("seats").alias("seats_in_all")), "source_key")
    shards = apportion(shards.select("source_key", F.col("shard").alias("party"), F.col("words").alias("votes"), "cap", "blocks", "seats_in_all"), "shard-seats", "source_key")
    rounds = F.floor(F.col("seats") / F.greatest("blocks", F.lit(1)))
    first = F.pmod(seeded(seed, F.col("source_key"), F.col("party")), F.greatest("blocks", F.lit(1)))
    plan = shards.select(
        "source_key", F.col("party").alias("shard"), F.col("votes").alias("words"), rounds.alias("rounds"), (first * block).alias("begin"),
        ((first + F.col("seats") - rounds * F.col("blocks")) * block).alias("end"), (F.col("blocks") * block).alias("turn"),
    )
    plan = plan.join(sources.select("source_key", "source_size", "target"), "source_key")
    return taken(dealt.drop("shards"), small_or_not(written(plan, "plan"))).select(F.col("id").alias(key), "size", "source_size", "target", "taken")


def taken(dealt: DataFrame, plan: DataFrame) -> DataFrame:
    """``dealt`` with the words that the plan of its shard takes of each document.

    The run of blocks goes from word ``begin`` to word ``end``; past the last block (``turn``) it goes on at the first.
    """
    stream = Window.partitionBy("source_key", "shard").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = dealt.withColumn("upto", F.sum("size").over(stream)).join(plan, ["source_key", "shard"])
    start = F.col("upto") - F.col("size")

    def within(begin: Column, end: Column) -> Column:
        return F.greatest(F.least("upto", end) - F.greatest(start, begin), F.lit(0))

    run = within(F.col("begin"), F.least("end", "turn")) + within(F.lit(0), F.col("end") - F.col("turn"))
    return lined.withColumn("taken", (F.col("rounds") * F.col("size") + run).cast("long"))
