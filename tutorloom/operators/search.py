"""Content search over lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorloom.functions import text as T
from tutorloom.operators.lookups import top_n

# Path parts never searched.
SKIPPED_PARTS = ["node_modules", ".git", "__pycache__", ".next", "dist", "build"]


def search_lines(files: DataFrame, needle: str, path: str = "path", content: str = "content") -> DataFrame:
    """Lines holding ``needle`` in any case: path, 1-based line number and the text around the hit.

    Files without a hit are dropped before their text is split into lines.
    """
    needle = needle.strip()
    if not needle:
        raise ValueError("search query cannot be empty")
    skipped = F.lit(False)
    for part in SKIPPED_PARTS:
        skipped = skipped | F.col(path).contains(part)
    lowered = needle.lower()
    hits = files.filter(~skipped & F.lower(content).contains(lowered))
    lines = hits.select(path, F.posexplode(F.split(content, r"\r\n?|\n")).alias("i", "body"))
    return lines.filter(F.lower("body").contains(lowered)).select(
        path, (F.col("i") + 1).alias("line"), T.match_context(F.col("body"), needle).alias("match")
    )


def matches_per_file(lines: DataFrame, path: str = "path") -> DataFrame:
    return lines.groupBy(path).agg(F.count("*").alias("matches"))


def grouped_by_directory(lines: DataFrame, per_file: int = 3, path: str = "path") -> DataFrame:
    """The first matches of every file with the directory they are listed under."""
    first = top_n(lines, per_file, [F.col("line")], [path])
    folder = T.directory(F.col(path))
    return first.withColumn("directory", F.when(folder == "", "/").otherwise(folder)).drop("position")
