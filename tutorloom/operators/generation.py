"""Text generation as a caller-supplied column function between a prompt table and a parse table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorloom.functions import text as T
from tutorloom.operators import graph as G

Generate = Callable[[Column], Column]


def generate_questions(
    docs: DataFrame, generate: Generate, key: str = "doc_id", count: int = 5, question_types: list[str] | None = None, difficulty: Column | None = None, text: str = "text"
) -> DataFrame:
    """(key, position, question, type, answer, options, explanation, confidence) for each document.

    Equal prompts are sent once: the generator runs over the distinct prompt table.
    """
    prompts = docs.select(key, T.generation_prompt(F.col(text), count, question_types, difficulty).alias("prompt"))
    answered = prompts.select("prompt").distinct().withColumn("response", generate(F.col("prompt")))
    parsed = answered.select("prompt", F.posexplode(F.slice(T.parse_questions(F.col("response")), 1, count)).alias("i", "q"))
    return prompts.join(parsed, "prompt").select(key, (F.col("i") + 1).alias("position"), "q.*")


def judge_relationships(areas: DataFrame, generate: Generate, evidence: DataFrame | None = None) -> DataFrame:
    """Topic relationships of every workspace from a generator's verdict on each candidate pair."""
    pairs = G.relationship_candidates(areas, evidence)
    for side in ("source", "target"):
        about = areas.select(F.col("topic_area_id").alias(f"{side}_topic_id"), F.concat_ws(": ", "name", "description").alias(f"{side}_text"))
        pairs = pairs.join(about, f"{side}_topic_id")
    ask = F.concat(
        F.lit("How are these topics related? Topic 1: "), "source_text", F.lit(" Topic 2: "), "target_text",
        F.lit(' Answer with one JSON object holding "relationship_type", "strength", "reasoning" and "direction".'),
    )
    judged = pairs.select("source_topic_id", "target_topic_id", generate(ask).alias("verdict"))
    return G.relationships_from_verdicts(judged, F.col("verdict"))
