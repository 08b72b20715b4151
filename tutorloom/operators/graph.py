"""Knowledge graph: context windows, concepts, nodes and edges, search, neighbours, learning paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorloom.functions import text as T
from tutorloom.operators.lookups import top_n
from tutorloom.session import write_step

# --- fixed values -------------------------------------------------------------------------------------
TOPIC_TEXT = "Topic covering {} documents. Key themes: {}{}"
TOPIC_EXAMPLE = " Example: {}..."
CONCEPT_TEXT = "Concept extracted from {} context windows in topic '{}'"
DOCUMENT_NAME = "Document {}"
WHOLE_PATH = "Comprehensive Workspace Mastery"
FOCUSED_PATH = "Deep Dive: {}"
WHOLE_PATH_TEXT = "Complete learning path covering all major topics in your workspace"
FOCUSED_PATH_TEXT = "Focused learning path for mastering {}"
GAP_REASON = "You've only explored {} of {}"
GAP_ACTION = "Take a quiz on {} to improve your understanding"
PRACTICE_REASON = "You have good coverage of {} but need more practice"
PRACTICE_ACTION = "Practice quizzes on {} concepts"
# ------------------------------------------------------------------------------------------------------


def said(sentence: str, *values: Column) -> Column:
    """``sentence`` with its braces filled in order; null if a value is."""
    first, *others = sentence.split("{}")
    return F.concat(F.lit(first), *(part for value, text in zip(values, others, strict=True) for part in (value, F.lit(text))))


# --- context windows and concepts ---------------------------------------------------------------------


GRAM = 8  # bytes of a keyword that texts are searched for; a shorter keyword is searched whole
SCAN_BYTES = 1 << 20  # of text that are scanned at once
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26  # of the filter; 32 to 64 for each keyword between
FILTER_HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _slot(grams: np.ndarray, n: int, bits: int, factor: int) -> np.ndarray:
    """Filter bit of grams of ``n`` bytes, read as little-endian numbers."""
    return ((grams ^ np.uint64(n)) * np.uint64(factor) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def filed_keywords(keywords: DataFrame) -> DataFrame:
    """(low, n, gram): every lower-cased keyword that isn't blank, filed under the one of its stretches of ``GRAM`` bytes that the fewest keywords hold."""
    low = keywords.select(F.lower("keyword").alias("low")).distinct().filter(F.replace("low", F.lit(" "), F.lit("")) != "")
    at = F.sequence(F.lit(1), F.greatest(F.octet_length("low") - (GRAM - 1), F.lit(1)))
    own = low.select("low", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("low").cast("binary"), i, F.lit(GRAM))))).alias("gram"))
    shared = own.groupBy("gram").agg(F.count("*").alias("keywords"))
    filed = own.join(shared, "gram").groupBy("low").agg(F.min(F.struct("keywords", "gram")).alias("filed")).select("low", "filed.gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            numbers = np.frombuffer(b"".join(g.ljust(8, b"\0") for g in grams), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column("low"), pa.array([len(g) for g in grams], pa.int32()), pa.array(numbers)], ["low", "n", "gram"])

    return write_step(filed.mapInArrow(run, "low string, n int, gram long"), "filed_keywords")


def keyword_filter(filed: DataFrame) -> tuple[bytes, list[int]]:
    """A bitmap of the keywords' grams, the only thing of them that is sent to all tasks, and the lengths of the grams."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * filed.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gram = batch.column("n").to_numpy(), batch.column("gram").to_numpy().view(np.uint64)
            for length in np.unique(n).tolist():
                for factor in FILTER_HASHES:
                    yield pa.RecordBatch.from_arrays([pa.array(_slot(gram[n == length], length, bits, factor))], ["slot"])

    slots = filed.select("n", "gram").mapInArrow(run, "slot long")
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    table = np.zeros(bits // 64, np.int64)
    for word in words.toLocalIterator():  # at most one for 64 bits
        table[word["word"]] = word["bits"]
    return table.tobytes(), sorted(r["n"] for r in filed.select("n").distinct().collect())


def _scan(filter_bits: bytes, lengths: list[int], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows whose last column, the lower-cased sentences joined by full stops, holds a gram that passes the filter; in its place the hits (sentence i, n, gram)."""

    def hits(part: pa.RecordBatch, known: np.ndarray) -> pa.RecordBatch:
        texts = part.column(part.num_columns - 1).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.zeros(ends[-1] - ends[0] + GRAM, np.uint8)
        data[:-GRAM] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        stops = np.flatnonzero(data == ord("."))
        before = np.searchsorted(stops, ends)
        found = []
        for start in range(0, len(data) - GRAM, SCAN_BYTES):
            eight = np.ndarray(min(SCAN_BYTES, len(data) - GRAM - start), "<u8", data, start, (1,)).copy()
            for n in lengths:
                grams = eight & np.uint64((1 << 8 * n) - 1)
                at = np.flatnonzero(known[_slot(grams, n, len(known), FILTER_HASHES[0])])
                at = at[known[_slot(grams[at], n, len(known), FILTER_HASHES[1])]]
                gram, at = grams[at], at + start
                row = np.searchsorted(ends, at, "right") - 1
                inside = at + n <= ends[row + 1]
                row, at, gram = row[inside], at[inside], gram[inside]
                i = np.searchsorted(stops, at) - before[row]
                order = np.lexsort((gram, i, row))
                row, i, gram = row[order], i[order], gram[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (i[1:] != i[:-1]) | (gram[1:] != gram[:-1])] if len(row) else np.zeros(0, bool)
                found.append((row[new], i[new], np.full(new.sum(), n), gram[new]))
        row, i, n, gram = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        rows, counts = np.unique(row, return_counts=True)
        each = pa.StructArray.from_arrays([pa.array(i[order].astype(np.int32)), pa.array(n[order].astype(np.int32)), pa.array(gram[order].view(np.int64))], ["i", "n", "gram"])
        listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), each)
        return pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in range(part.num_columns - 1)), listed], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(filter_bits, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            whole = np.r_[0, np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))]
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(whole, whole[start] + SCAN_BYTES, "right")) - 1)
                if whole[stop] > whole[start] and lengths:
                    found = hits(batch.slice(start, stop - start), known)
                    if found.num_rows:
                        yield found
                start = stop

    return run


def context_windows(docs: DataFrame, keywords: DataFrame, window: int = 3, max_chars: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(topic_id, doc, sentence_index, keywords, context) for every sentence naming a topic keyword.

    One scan over the texts keeps the documents in which a sentence holds a gram that a keyword is filed under; these meet the keywords in an equi-join on
    the gram, the keyword is verified in the whole sentence and the context is cut. ``key`` is unique. Blank keywords name nothing.
    """
    known = keywords.select("topic_id", "keyword").distinct()
    filed = filed_keywords(known)
    low = F.coalesce(F.array_join(F.transform(T.sentences(F.col(text)), F.lower), "."), F.lit(""))  # sentence i lies behind i full stops
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, text)]
    scan = _scan(*keyword_filter(filed), [key, text, "hits"])
    held = write_step(docs.select(key, text, low.alias("low")).mapInArrow(scan, f"{', '.join(kinds)}, hits array<struct<i: int, n: int, gram: bigint>>"), "keyword_grams")
    named = known.withColumn("low", F.lower("keyword")).join(filed, "low").select("n", "gram", "topic_id", "keyword")
    met = held.select(key, F.inline("hits")).join(named, ["n", "gram"])
    hits = met.groupBy(key).agg(F.collect_set(F.struct("i", "topic_id", "keyword")).alias("hits"))  # at most one for each sentence and keyword

    def windows(ss: Column) -> Column:
        def at(h: Column) -> Column:
            start = F.greatest(F.lit(0), h["i"] - window)
            around = F.array_join(F.slice(ss, start + 1, F.least(F.size(ss), h["i"] + window + 1) - start), ". ")
            there = F.contains(F.lower(F.get(ss, h["i"])), F.lower(h["keyword"]))
            return F.struct(h["topic_id"].alias("topic_id"), h["i"].alias("sentence_index"), h["keyword"].alias("keyword"), F.when(there, T.truncate(around, max_chars)).alias("context"))

        return F.filter(F.transform("hits", at), lambda x: x["context"].isNotNull())

    found = held.select(key, text).join(hits, key).select(key, F.inline(T.let(T.sentences(F.col(text)), windows)))
    grouped = found.groupBy(key, "topic_id", "sentence_index").agg(F.collect_list("keyword").alias("keywords"), F.first("context").alias("context"))
    return grouped.select("topic_id", key, "sentence_index", F.array_sort("keywords").alias("keywords"), "context")


def concepts(windows: DataFrame) -> DataFrame:
    """(topic_id, keyword, window_count, total_mentions): one concept per matched keyword of a topic."""
    return (
        windows.select("topic_id", F.explode("keywords").alias("keyword"), F.size("keywords").alias("m"))
        .groupBy("topic_id", "keyword")
        .agg(F.count("*").alias("window_count"), F.sum("m").alias("total_mentions"))
    )


def concept_samples(windows: DataFrame, n: int = 3, key: str = "doc_id") -> DataFrame:
    """First ``n`` contexts of every concept, cut at 100 characters."""
    rows = windows.select("topic_id", F.explode("keywords").alias("keyword"), key, "sentence_index", F.substring("context", 1, 100).alias("sample"))
    return top_n(rows, n, [F.col(key), F.col("sentence_index")], ["topic_id", "keyword"])


def related_words(windows: DataFrame) -> DataFrame:
    """(topic_id, keyword, word): alphabetic words over four letters, the first three of each window."""
    good = F.slice(F.filter(T.words(F.col("context")), lambda w: (F.length(w) > 4) & w.rlike(r"^\p{L}+$")), 1, 3)
    return (
        windows.select("topic_id", "keywords", good.alias("ws"))
        .select("topic_id", F.explode("keywords").alias("keyword"), "ws")
        .select("topic_id", "keyword", F.explode("ws").alias("word"))
        .distinct()
    )


def coherence(words: DataFrame) -> DataFrame:
    """1 / (1 + variance of the five best scores); 0 with fewer than two words."""
    scored = words.groupBy("topic_id").agg(F.count("*").alias("n"), F.var_pop(F.when(F.col("position") <= 5, F.col("score"))).alias("v"))
    return scored.select("topic_id", F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.lit(1.0), 1 / (1 + F.col("v")))).alias("coherence"))


# --- edges -----------------------------------------------------------------------------------------------


def word_overlap_edges(words: DataFrame, sizes: DataFrame, minimum: float = 0.3, top: int = 10) -> DataFrame:
    """Directed edges between topics whose top words have a Jaccard overlap above ``minimum``.

    Words are ordered from rare to common over the topics. Two topics above the threshold share more than ``minimum`` times the words of either, so they share one
    of the rarest n - floor(minimum * n) words of both: only those are joined, a word that all topics hold pairs none. A pair needs sizes and rests of both lists
    that still allow the overlap, and the whole word sets decide.
    """
    w = words.filter(F.col("position") <= top).select("topic_id", "term")
    rarity = w.groupBy("term").agg(F.count("*").alias("df"))
    ordered = w.join(rarity, "term").groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("terms"))  # at most ``top``
    listed = write_step(ordered.join(sizes, "topic_id").select("topic_id", "terms", F.size("terms").alias("n"), "count"), "topic_terms")
    prefix = F.slice("terms", 1, F.col("n") - F.greatest(F.floor(F.col("n") * minimum - 1e-9), F.lit(0)).cast("int"))
    entries = listed.select("topic_id", "n", F.posexplode(prefix).alias("at", "term"))
    a, b = entries.alias("a"), entries.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    needed = (n + m) * (minimum / (1 + minimum)) - 1e-9
    hopeful = (F.least(n, m) > needed) & (1 + F.least(n - F.col("a.at") - 1, m - F.col("b.at") - 1) > needed)
    pairs = a.join(b, (F.col("a.term") == F.col("b.term")) & (F.col("a.topic_id") < F.col("b.topic_id")) & hopeful)
    pairs = pairs.select(F.col("a.topic_id").alias("x"), F.col("b.topic_id").alias("y")).distinct()
    left = listed.select(F.col("topic_id").alias("x"), F.col("terms").alias("x_terms"), F.col("count").alias("x_count"))
    right = listed.select(F.col("topic_id").alias("y"), F.col("terms").alias("y_terms"), F.col("count").alias("y_count"))
    shared = F.size(F.array_intersect("x_terms", "y_terms"))
    met = pairs.join(left, "x").join(right, "y").withColumn("weight", shared / (F.size("x_terms") + F.size("y_terms") - shared)).filter(F.col("weight") > minimum)
    both = F.explode(F.array(F.struct(F.col("x").alias("s"), F.col("y").alias("t"), F.col("x_count").alias("sc"), F.col("y_count").alias("tc")), F.struct(F.col("y").alias("s"), F.col("x").alias("t"), F.col("y_count").alias("sc"), F.col("x_count").alias("tc"))))
    return met.select(both.alias("e"), "weight").select(
        F.concat_ws("_", F.lit("hierarchy"), "e.s", "e.t").alias("id"),
        F.concat(F.lit("topic_"), "e.s").alias("source_id"),
        F.concat(F.lit("topic_"), "e.t").alias("target_id"),
        F.when(F.col("e.sc") > F.col("e.tc"), "subtopic_of").otherwise("relates_to").alias("type"),
        "weight",
    )


def concept_edges(concept_rows: DataFrame) -> DataFrame:
    source = F.concat_ws("_", F.lit("concept"), F.col("topic_id").cast("string"), "keyword")
    target = F.concat(F.lit("topic_"), "topic_id")
    return concept_rows.select(
        F.concat_ws("_", F.lit("concept_topic"), source, target).alias("id"), source.alias("source_id"), target.alias("target_id"),
        F.lit("belongs_to_topic").alias("type"), (F.col("window_count") / 10.0).alias("weight"),
    )


def document_edges(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    source, target = F.concat(F.lit("doc_"), key), F.concat(F.lit("topic_"), "topic_id")
    return assigned.filter("topic_id >= 0").select(
        F.concat_ws("_", F.lit("doc_topic"), source, target).alias("id"), source.alias("source_id"), target.alias("target_id"),
        F.lit("belongs_to_topic").alias("type"), F.col("probability").alias("weight"),
    )


# --- nodes ------------------------------------------------------------------------------------------------


def topic_nodes(topics: DataFrame) -> DataFrame:
    five = F.array_join(F.transform(F.slice("words", 1, 5), lambda x: x["term"]), ", ")
    sample = F.substring(F.element_at("representative_docs", 1), 1, 100)
    return topics.select(
        F.concat(F.lit("topic_"), "topic_id").alias("id"), F.lit("topic").alias("type"), "name",
        said(TOPIC_TEXT, F.col("count"), five, F.coalesce(said(TOPIC_EXAMPLE, sample), F.lit(""))).alias("description"),
    )


def concept_nodes(concept_rows: DataFrame, topics: DataFrame) -> DataFrame:
    named = concept_rows.join(topics.select("topic_id", F.col("name").alias("topic_name")), "topic_id")
    return named.select(
        F.concat_ws("_", F.lit("concept"), F.col("topic_id").cast("string"), "keyword").alias("id"), F.lit("concept").alias("type"), F.col("keyword").alias("name"),
        said(CONCEPT_TEXT, F.col("window_count"), F.col("topic_name")).alias("description"),
    )


def document_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(
        F.concat(F.lit("doc_"), key).alias("id"), F.lit("document").alias("type"), said(DOCUMENT_NAME, F.col(key) + 1).alias("name"),
        T.truncate(F.col(text), 150).alias("description"),
    )


def build_graph(docs: DataFrame, topics: DataFrame, words: DataFrame, assigned: DataFrame, min_weight: float = 0.0, key: str = "doc_id", overlap: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, windows). ``topics`` as from ``topic_table``; ``assigned`` (doc, topic_id, probability)."""
    top5 = words.filter("position <= 5").select("topic_id", F.col("term").alias("keyword"))
    windows = write_step(context_windows(docs, top5, key=key), "windows")
    found = concepts(windows)
    nodes = topic_nodes(topics).unionByName(concept_nodes(found, topics)).unionByName(document_nodes(docs, key))
    edges = (
        word_overlap_edges(words, topics.select("topic_id", "count"), overlap)
        .unionByName(concept_edges(found))
        .unionByName(document_edges(assigned, key))
        .filter(F.col("weight") >= min_weight)
    )
    return nodes, edges, windows


def graph_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("nodes"))


def node_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Display size from the degree, between 8 and 20."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    degree = F.coalesce("degree", F.lit(0))
    return nodes.select("id").join(ends, "id", "left").select("id", degree.alias("degree"), F.least(F.greatest(8 + 2 * degree, F.lit(8)), F.lit(20)).alias("size"))


def export_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.col("name").alias("label"), "type", F.to_json(F.struct("description")).alias("metadata"))


def export_edges(edges: DataFrame) -> DataFrame:
    return edges.select("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", "weight")


# --- navigation ---------------------------------------------------------------------------------------------


def topic_overview(topics: DataFrame, limit: int = 10) -> DataFrame:
    """Largest topics with three words and up to two sample documents."""
    first = top_n(topics, limit, [F.desc("count"), F.col("topic_id")])
    return first.select(
        F.concat(F.lit("topic_"), "topic_id").alias("id"), "name", "count",
        F.transform(F.slice("words", 1, 3), lambda x: x["term"]).alias("top_words"), F.slice("representative_docs", 1, 2).alias("samples"),
    )


def explore(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic, relation, id, name): concepts and documents of every topic, and its related topics."""
    inward = edges.filter("type = 'belongs_to_topic'").select(F.col("target_id").alias("topic"), F.col("source_id").alias("id"))
    outward = edges.filter(F.col("type").isin("subtopic_of", "relates_to")).select(F.col("source_id").alias("topic"), F.col("target_id").alias("id"))
    relation = F.when(F.col("type") == "topic", "related").otherwise(F.col("type"))
    return inward.unionByName(outward).join(nodes.select("id", "name", "type"), "id").select("topic", relation.alias("relation"), "id", "name")


def breadcrumb(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'topic'").select("id", "name", "type")


def search_nodes(nodes: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """Nodes naming (1.0) or describing (0.5) the text, by relevance."""
    low = needle.lower()
    in_name, in_text = F.lower("name").contains(low), F.lower("description").contains(low)
    hits = nodes.filter(in_name | in_text).select(
        "id", "type", F.when(in_name, 1.0).otherwise(0.5).alias("relevance"), F.when(in_name, "name").otherwise("description").alias("match_type")
    )
    return top_n(hits, limit, [F.desc("relevance"), F.col("id")])


def similar_topics(nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    e = edges.filter(F.col("type").isin("relates_to", "subtopic_of")).join(nodes.select(F.col("id").alias("target_id"), "name"), "target_id")
    return top_n(e, limit, [F.round("weight", 9).desc(), F.col("target_id")], ["source_id"]).select("source_id", "target_id", "name", "weight", F.col("type").alias("relation"))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hops): nodes within ``depth`` undirected steps of the start nodes."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("next")).unionByName(
        edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("next"))
    )
    seen = write_step(start.select("id").distinct().withColumn("hops", F.lit(0)), "seen")
    frontier = seen
    for hop in range(1, depth + 1):
        step = both.join(frontier.select("id"), "id", "left_semi").select(F.col("next").alias("id")).distinct()
        frontier = write_step(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def concept_files(windows: DataFrame, docs: DataFrame, key: str = "doc_id", path: str = "source") -> DataFrame:
    """(topic_id, keyword, path, mentions, relevance): files naming a concept, by share of its windows."""
    rows = windows.select("topic_id", F.explode("keywords").alias("keyword"), key).groupBy("topic_id", "keyword", key).agg(F.count("*").alias("n"))
    per_file = rows.join(docs.select(key, path), key).groupBy("topic_id", "keyword", path).agg(F.sum("n").alias("mentions"))
    total = per_file.groupBy("topic_id", "keyword").agg(F.sum("mentions").alias("total"))
    return per_file.join(total, ["topic_id", "keyword"]).select("topic_id", "keyword", path, "mentions", (F.col("mentions") / F.col("total")).alias("relevance"))


# --- topic relationships --------------------------------------------------------------------------------------


def relationship_candidates(areas: DataFrame, evidence: DataFrame | None = None, blocks: int = 8) -> DataFrame:
    """Unordered topic pairs of each workspace to be judged: topics that share a piece of evidence.

    ``evidence`` (topic_area_id, evidence) lists common files, concepts or words; by default the words of the
    topics' names. The pairs come from an equi-join on the evidence, a frequent piece being met in ``blocks`` parts. A topic
    that shares nothing is paired with its neighbour by id, so every topic of a workspace with two or more is judged.
    """
    if evidence is None:
        words = F.filter(F.array_distinct(F.split(F.lower("name"), r"[^\p{L}\p{N}]+")), lambda w: w != "")
        evidence = areas.select("topic_area_id", F.explode(words).alias("evidence"))
    ids = areas.select("workspace_id", "topic_area_id")
    held = ids.join(evidence.select("topic_area_id", "evidence").distinct(), "topic_area_id")
    left = held.select("workspace_id", "evidence", F.col("topic_area_id").alias("source_topic_id"), F.pmod(F.xxhash64("topic_area_id"), F.lit(blocks)).alias("block"))
    right = held.select("workspace_id", "evidence", F.col("topic_area_id").alias("target_topic_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    shared = left.join(right, ["workspace_id", "evidence", "block"]).filter("source_topic_id < target_topic_id").select("workspace_id", "source_topic_id", "target_topic_id").distinct()
    paired = shared.select(F.col("source_topic_id").alias("topic_area_id")).unionByName(shared.select(F.col("target_topic_id").alias("topic_area_id")))
    order = Window.partitionBy("workspace_id").orderBy("topic_area_id")
    near = ids.withColumn("other", F.coalesce(F.lead("topic_area_id").over(order), F.lag("topic_area_id").over(order)))
    alone = near.filter("other IS NOT NULL").join(paired.distinct(), "topic_area_id", "left_anti")
    alone = alone.select("workspace_id", F.least("topic_area_id", "other").alias("source_topic_id"), F.greatest("topic_area_id", "other").alias("target_topic_id"))
    return shared.unionByName(alone).distinct()


def relationships_from_verdicts(pairs: DataFrame, verdict: Column) -> DataFrame:
    """Relationship rows from the free-text verdict on each candidate pair."""
    v = pairs.withColumn("v", T.parse_verdict(verdict)).filter(F.col("v.relationship_type").isNotNull() & (F.col("v.relationship_type") != "no_relationship"))
    flip = F.coalesce(F.col("v.direction"), F.lit("bidirectional")) == "topic2_to_topic1"
    return v.select(
        F.when(flip, F.col("target_topic_id")).otherwise(F.col("source_topic_id")).alias("source_topic_id"),
        F.when(flip, F.col("source_topic_id")).otherwise(F.col("target_topic_id")).alias("target_topic_id"),
        F.col("v.relationship_type").alias("relationship_type"),
        F.coalesce(F.col("v.strength"), F.lit(0.5)).alias("strength"),
        F.coalesce(F.col("v.reasoning"), F.lit("")).alias("reasoning"),
    )


def workspace_relationships(relationships: DataFrame, areas: DataFrame) -> DataFrame:
    """Relationships with either end among the given topic areas: two semi joins, no disjunctive join."""
    ids = areas.select("topic_area_id")
    source = relationships.join(ids.withColumnRenamed("topic_area_id", "source_topic_id"), "source_topic_id", "left_semi")
    target = relationships.join(ids.withColumnRenamed("topic_area_id", "target_topic_id"), "target_topic_id", "left_semi")
    return source.unionByName(target).dropDuplicates(["relationship_id"])


def merge_by_name(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One global graph: nodes of equal (case-insensitive) name become one, edges follow and add up."""
    named = nodes.withColumn("key", F.lower(F.trim("name")))
    merged = named.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("members"))
    to = named.select("id", "key").join(merged.select("key", F.col("id").alias("into")), "key").select("id", "into")
    e = (
        edges.join(to.select(F.col("id").alias("source_id"), F.col("into").alias("source")), "source_id")
        .join(to.select(F.col("id").alias("target_id"), F.col("into").alias("target")), "target_id")
        .filter("source <> target")
        .groupBy("source", "target")
        .agg(F.count("*").alias("links"), F.max("weight").alias("weight"))
    )
    return merged, e


# --- paths, recommendations, suggestions --------------------------------------------------------------------------


def learning_paths(areas: DataFrame, focused: int = 5) -> DataFrame:
    """A comprehensive path for workspaces of three or more topics, and focused ones for covered topics.

    Paths have no prerequisites; their topic areas in order are the rows of ``path_members``, so that no workspace is collected into a list.
    """
    no_paths = F.array().cast("array<string>")
    score = F.round(F.col("coverage_score") + F.col("explored_percentage"), 9)
    whole = areas.groupBy("workspace_id").agg(
        F.count("*").alias("topics"), F.sum(F.col("concept_count") * 2).alias("estimated_hours"), F.avg("coverage_score").alias("c")
    ).filter("topics >= 3")
    comprehensive = whole.select(
        F.concat_ws("_", F.lit("path"), "workspace_id", F.lit("comprehensive")).alias("learning_path_id"), "workspace_id",
        F.lit(WHOLE_PATH).alias("name"), F.lit(WHOLE_PATH_TEXT).alias("description"), "topics", "estimated_hours",
        F.when(F.col("c") < 0.4, "beginner").when(F.col("c") < 0.7, "intermediate").otherwise("advanced").alias("difficulty_level"), no_paths.alias("prerequisites"),
    )
    best = top_n(areas.filter("coverage_score > 0.7"), focused, [score.desc(), F.col("topic_area_id")], ["workspace_id"])
    deep = best.select(
        F.concat_ws("_", F.lit("path"), "workspace_id", F.lit("focused"), (F.col("position") - 1).cast("string")).alias("learning_path_id"), "workspace_id",
        said(FOCUSED_PATH, F.col("name")).alias("name"), said(FOCUSED_PATH_TEXT, F.col("name")).alias("description"), F.lit(1).cast("long").alias("topics"),
        (F.col("concept_count") * 3).alias("estimated_hours"), F.lit("intermediate").alias("difficulty_level"), no_paths.alias("prerequisites"),
    )
    return comprehensive.unionByName(deep)


def path_members(areas: DataFrame, focused: int = 5) -> DataFrame:
    """(learning_path_id, position, topic_area_id): the topic areas of every learning path in order."""
    score = F.round(F.col("coverage_score") + F.col("explored_percentage"), 9)
    large = areas.groupBy("workspace_id").agg(F.count("*").alias("n")).filter("n >= 3").select("workspace_id")
    whole = path_topics(areas.join(large, "workspace_id", "left_semi")).select(
        F.concat_ws("_", F.lit("path"), "workspace_id", F.lit("comprehensive")).alias("learning_path_id"), "position", "topic_area_id"
    )
    deep = top_n(areas.filter("coverage_score > 0.7"), focused, [score.desc(), F.col("topic_area_id")], ["workspace_id"])
    return whole.unionByName(
        deep.select(F.concat_ws("_", F.lit("path"), "workspace_id", F.lit("focused"), (F.col("position") - 1).cast("string")).alias("learning_path_id"), F.lit(1).alias("position"), "topic_area_id")
    )


def path_topics(areas: DataFrame) -> DataFrame:
    """Order of the topics within each comprehensive path."""
    w = Window.partitionBy("workspace_id").orderBy(F.round(F.col("coverage_score") + F.col("explored_percentage"), 9).desc(), "topic_area_id")
    return areas.select("workspace_id", "topic_area_id", F.row_number().over(w).alias("position"))


def recommendations(areas: DataFrame, limit: int = 10) -> DataFrame:
    explored, covered, name = F.col("explored_percentage"), F.col("coverage_score"), F.col("name")
    gap, practice = explored < 0.3, (covered > 0.8) & (explored < 0.5)
    rec = areas.filter(gap | practice).select(
        "workspace_id", "topic_area_id",
        F.when(gap, "concept_gap").otherwise("quiz_performance").alias("recommendation_type"),
        F.round(F.when(gap, F.least(F.lit(1.0), (1 - explored) * 0.8)).otherwise(0.7), 9).alias("priority_score"),
        F.when(gap, said(GAP_REASON, T.percent_text(explored, 1), name)).otherwise(said(PRACTICE_REASON, name)).alias("reason"),
        F.when(gap, said(GAP_ACTION, name)).otherwise(said(PRACTICE_ACTION, name)).alias("suggested_action"),
    )
    return top_n(rec, limit, [F.desc("priority_score"), F.col("topic_area_id")], ["workspace_id"])


def topic_suggestions(candidates: DataFrame, similarity: DataFrame, as_of: Column, limit: int = 10, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), decay_days: float = 7.0) -> DataFrame:
    """Candidates (id, frequency, last_accessed) scored by frequency, recency and closeness to the focus set.

    ``similarity`` (id, similarity) holds each candidate's best cosine to the focus set.
    """
    top = candidates.agg(F.max("frequency")).first()[0] or 1
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_accessed").cast("timestamp"))) / 86_400_000_000
    scored = candidates.join(similarity, "id", "left").select(
        "id", (F.col("frequency") / F.lit(top)).alias("frequency_score"), F.exp(-F.floor(days) / F.lit(decay_days)).alias("recency_score"),
        F.coalesce("similarity", F.lit(0.0)).alias("semantic_score"),
    )
    f, r, s = weights
    total = F.round(F.col("frequency_score") * f + F.col("recency_score") * r + F.col("semantic_score") * s, 9)
    return top_n(scored.withColumn("score", total), limit, [F.desc("score"), F.col("id")])
