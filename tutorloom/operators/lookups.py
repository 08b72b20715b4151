"""Filters, set lookups and newest-N selections shared by all study tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorloom.functions import text as T


def by_key(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values; reaches the Parquet scan as a pushed filter."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def by_keys(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Set form of a key lookup: rows whose key occurs in ``wanted``."""
    return df.join(wanted.select(*on), on, "left_semi")


def exists_by(df: DataFrame, probe: DataFrame, on: list[str]) -> DataFrame:
    """Each probe row with a flag telling whether ``df`` holds its key."""
    keys = df.select(*on).distinct().withColumn("found", F.lit(True))
    return probe.join(keys, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def path_taken(files: DataFrame, probe: DataFrame) -> DataFrame:
    """Whether another file of the workspace holds the probed path (its own id excluded)."""
    owners = files.groupBy("workspace_id", "path").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return (
        probe.join(owners, ["workspace_id", "path"], "left")
        .withColumn("taken", F.coalesce((F.col("n") > 1) | (F.col("first_id") != F.col("id")), F.lit(False)))
        .drop("n", "first_id")
    )


def top_n(df: DataFrame, n: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in ``order``, globally or for each group.

    The rank filter is pushed below the shuffle (window group limit), so a hot group sends at most
    ``n`` rows per map task.
    """
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def newest(df: DataFrame, n: int, ts: str = "created_at", key: str = "id", by: list[str] | None = None) -> DataFrame:
    return top_n(df, n, [F.col(ts).desc(), F.col(key).desc()], by)


def within_days(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL '{days}' DAY"))


def due(schedules: DataFrame, as_of: Column, strictly: bool = False) -> DataFrame:
    """Schedules whose review time has come (``strictly``: has passed)."""
    when = F.col("next_review")
    return schedules.filter(when < as_of if strictly else when <= as_of)


def path_nodes(files: DataFrame, path: str = "path") -> DataFrame:
    """Every directory and file on the given paths: path, parent, name, is_file."""
    parts = F.split(path, "/")
    steps = files.select(path).select(F.posexplode(F.sequence(F.lit(1), F.size(parts))).alias("i", "depth"), parts.alias("parts"))
    nodes = steps.select(
        F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"),
        F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/").alias("parent"),
        F.element_at("parts", F.col("depth")).alias("name"),
        (F.col("depth") == F.size("parts")).alias("is_file"),
    )
    return nodes.distinct()


def folder_tree(files: DataFrame, ignored: tuple[str, ...] = ("node_modules", "__pycache__", ".git")) -> DataFrame:
    """Tree listing without hidden and vendor folders: directories first, then by name."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*ignored))
    return path_nodes(files.filter(~hidden)).orderBy("parent", "is_file", "name")


def filter_tree(nodes: DataFrame, needle: str) -> DataFrame:
    """Nodes whose name contains ``needle`` and all directories above them."""
    if not needle.strip():
        return nodes
    hit = nodes.filter(F.lower("name").contains(needle.lower()))
    parts = F.split("path", "/")
    kept = hit.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path")
    ).distinct()
    return nodes.join(kept, "path", "left_semi")


def workspace_files(files: DataFrame, excluded_names: tuple[str, ...], excluded_extensions: tuple[str, ...], min_words: int = 6) -> DataFrame:
    """Files worth analysing: no excluded folder, hidden name or extension, and enough words."""
    parts = F.split("path", "/")
    name = T.base_name(F.col("path"))
    skip = F.exists(parts, lambda p: p.isin(*excluded_names)) | name.startswith(".")
    return files.filter(
        ~skip & ~T.extension(F.col("path")).isin(*excluded_extensions) & (T.word_count(F.col("content")) >= min_words)
    )
