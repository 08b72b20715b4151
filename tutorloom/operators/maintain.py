"""Keyed table maintenance, change detection and constraint checks, DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorloom.operators.lookups import top_n


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def latest_per_key(rows: DataFrame, key: list[str], newest_first: list[Column]) -> DataFrame:
    return top_n(rows, 1, newest_first, key).drop("position")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Insert-or-replace by key; ``rows`` holds each key at most once (see ``latest_per_key``)."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def patch(table: DataFrame, changes: DataFrame, key: list[str], touched: Column | None = None) -> DataFrame:
    """Columns of ``changes`` override where not null; ``touched`` stamps ``updated_at`` of changed rows."""
    fields = [c for c in changes.columns if c not in key]
    renamed = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = table.join(renamed, key, "left")
    out = [F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns if c != "updated_at" or touched is None]
    if touched is not None:
        old = F.col("updated_at") if "updated_at" in table.columns else F.lit(None).cast("timestamp_ntz")
        out.append(F.when(F.col("_hit"), touched).otherwise(old).alias("updated_at"))
    return joined.select(*out)


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on), on, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], parent_keys: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Remove dependants level by level.

    ``links`` lists (child table, child column, parent table, parent column) from the top down; the
    first parent is named ``root`` and holds the deleted keys.
    """
    gone = {"root": parent_keys}
    out = dict(tables)
    for child, column, parent, parent_column in links:
        doomed = gone[parent].select(F.col(parent_column).alias(column)).distinct()
        gone[child] = tables[child].join(doomed, column, "left_semi")
        out[child] = tables[child].join(doomed, column, "left_anti")
    return out


def set_null_on_delete(table: DataFrame, column: str, deleted: DataFrame, deleted_column: str) -> DataFrame:
    marks = deleted.select(F.col(deleted_column).alias(column)).distinct().withColumn("_gone", F.lit(True))
    joined = table.join(marks, column, "left")
    return joined.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in table.columns])


def upsert_relationships(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Undirected pairs: (A, B) and (B, A) are one relationship that keeps its stored id and ends."""

    def keyed(df: DataFrame) -> DataFrame:
        s, t = F.col("source_topic_id"), F.col("target_topic_id")
        return df.withColumn("_low", F.least(s, t)).withColumn("_high", F.greatest(s, t))

    values = ["relationship_type", "strength", "reasoning"]
    # a batch may hold a pair in both directions: its last relationship by id counts
    fresh = latest_per_key(keyed(new), ["_low", "_high"], [F.desc("relationship_id"), F.desc("source_topic_id")]).select("_low", "_high", *[F.col(c).alias(f"_new_{c}") for c in ["relationship_id", "source_topic_id", "target_topic_id", *values]])
    joined = keyed(stored).join(fresh, ["_low", "_high"], "full_outer")
    old_first = [F.coalesce(c, f"_new_{c}").alias(c) for c in ("relationship_id", "source_topic_id", "target_topic_id")]
    return joined.select(*old_first, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])


def add_counters(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Question counters after a batch of answers, which is aggregated before it meets the table."""
    new = answers.groupBy(F.col("question_id").alias("id")).agg(
        F.count("*").alias("_asked"), F.count_if("is_correct").alias("_correct"), F.max("created_at").alias("_last")
    )
    out = questions.join(new, "id", "left")
    return out.withColumns(
        {
            "times_asked": F.col("times_asked") + F.coalesce("_asked", F.lit(0)),
            "times_correct": F.col("times_correct") + F.coalesce("_correct", F.lit(0)),
            "last_asked": F.greatest("last_asked", "_last"),
        }
    ).drop("_asked", "_correct", "_last")


def session_lifecycle(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Start and completion times and status of sessions from their events (session_id, action_type, timestamp)."""
    when = F.col("timestamp")
    seen = events.groupBy(F.col("session_id").alias("id")).agg(
        F.min(F.when(F.col("action_type") == "quiz_started", when)).alias("started_at"),
        F.max(F.when(F.col("action_type") == "quiz_completed", when)).alias("completed_at"),
    )
    status = F.when(F.col("completed_at").isNotNull(), "completed").when(F.col("started_at").isNotNull(), "in_progress").otherwise("pending")
    return sessions.join(seen, "id", "left").withColumn("status", status)


def completed_totals(sessions: DataFrame, answers: DataFrame) -> DataFrame:
    """Completed sessions (id, status) with the totals of their answers (session_id, is_correct, time_taken); open ones have zeros."""
    sums = answers.groupBy(F.col("session_id").alias("id")).agg(
        F.count("*").alias("total_questions"), F.count_if("is_correct").alias("correct_answers"), F.sum(F.col("time_taken").cast("bigint")).alias("total_time")
    )
    done = F.col("status") == "completed"
    totals = {c: F.when(done, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint") for c in ("total_questions", "correct_answers", "total_time")}
    return sessions.join(sums, "id", "left").withColumns(totals)


# --- change detection ------------------------------------------------------------------------------------


def file_index(files: DataFrame, path: str = "path", content: str = "content", version: str = "1.0", as_of: Column | None = None) -> DataFrame:
    stamp = as_of if as_of is not None else F.current_timestamp()
    return files.select(F.col(path).alias("path"), F.md5(content).alias("hash"), F.lit(version).alias("version"), stamp.alias("last_updated"))


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, change) comparing the current (path, hash) index with the previous one."""
    now, old = current.select("path", F.col("hash").alias("now")), previous.select("path", F.col("hash").alias("old"))
    kind = (
        F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("old") != F.col("now"), "modified").otherwise("unchanged")
    )
    return now.join(old, "path", "full_outer").select("path", kind.alias("change"))


def change_counts(changed: DataFrame) -> DataFrame:
    names = ("new", "modified", "deleted", "unchanged")
    return changed.agg(
        *[F.count_if(F.col("change") == n).alias(n) for n in names], F.count_if(F.col("change").isin("new", "modified")).alias("total_new_modified")
    )


def needs_reindex(changed: DataFrame, force: bool = False) -> DataFrame:
    return changed.agg((F.lit(force) | (F.count_if(F.col("change").isin("new", "modified")) > 0)).alias("reindex"))


def changed_rows(files: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """Only the files to analyse again."""
    wanted = changed.filter(F.col("change").isin("new", "modified")).select(F.col("path").alias(path))
    return files.join(wanted, path, "left_semi")


# --- constraints ----------------------------------------------------------------------------------------------


def violations(
    table: DataFrame, checks: dict[str, Column] | None = None, unique: list[list[str]] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None
) -> DataFrame:
    """(constraint, violations): rows failing each predicate, surplus rows of each key, orphans of each reference."""
    checks = checks or {}
    spark = table.sparkSession
    out = spark.createDataFrame([], "constraint string, violations long")
    if checks:
        sums = table.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
        out = out.unionByName(sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(n).alias("violations")) for n in checks])).alias("x")).select("x.*"))
    for key in unique or []:
        extra = table.groupBy(*key).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
        out = out.unionByName(extra.select(F.lit(f"unique({','.join(key)})").alias("constraint"), "violations"))
    for column, (parent, parent_key) in (foreign or {}).items():
        ids = parent.select(F.col(parent_key).alias(column)).distinct()
        orphan = table.filter(F.col(column).isNotNull()).join(ids, column, "left_anti").agg(F.count("*").alias("violations"))
        out = out.unionByName(orphan.select(F.lit(f"reference({column})").alias("constraint"), "violations"))
    return out
