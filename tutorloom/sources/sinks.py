"""Outputs: topic results, prepared corpus, graph, flattened workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorloom.functions.text import CleaningConfig
from tutorloom.operators import graph as G
from tutorloom.operators.documents import config_row

RULE = "=" * 80


def write_topics(topics: DataFrame, assigned: DataFrame, folder: str) -> None:
    """Topic table and assignments as JSON, topic info as CSV."""
    topics.write.mode("overwrite").json(f"{folder}/topics")
    assigned.write.mode("overwrite").json(f"{folder}/document_topics")
    flat = topics.select("topic_id", "name", "count", F.array_join(F.transform("words", lambda x: x["term"]), ", ").alias("words"))
    flat.write.mode("overwrite").csv(f"{folder}/topic_info", header=True)


def write_corpus(kept: DataFrame, stats: DataFrame, cfg: CleaningConfig, folder: str) -> None:
    """Prepared documents with their file columns, statistics and the configuration they came from."""
    kept.write.mode("overwrite").parquet(f"{folder}/documents")
    stats.write.mode("overwrite").json(f"{folder}/stats")
    config_row(kept, cfg).write.mode("overwrite").json(f"{folder}/config")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    G.export_nodes(nodes).write.mode("overwrite").json(f"{folder}/nodes")
    G.export_edges(edges).write.mode("overwrite").json(f"{folder}/edges")


def flattened(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One block of text per file, under a header line, in path order."""
    header = F.concat(F.lit(f"{RULE}\nFILE: "), F.col(path), F.lit(f"\n{RULE}\n\n"))
    return files.select(F.col(path).alias("path"), F.concat(header, F.col(content), F.lit("\n")).alias("value")).orderBy("path")


def write_flattened(files: DataFrame, folder: str, single_file: bool = False) -> None:
    """Text parts whose order is the path order; one file only on request."""
    blocks = flattened(files).select("value")
    (blocks.coalesce(1) if single_file else blocks).write.mode("overwrite").text(folder)
