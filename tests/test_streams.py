"""Streams over tables that are folders of files."""

import random

import pandas as pd

from tutorloom.operators import spaced
from tutorloom.streaming import activity


def test_stream_of_a_folder_table(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(10, 13).coalesce(1).write.parquet(f"{tmp_path}/other.parquet")
    got = activity.run_to_end(activity.stream_table(spark, str(tmp_path), "t"))
    assert sorted(r["id"] for r in got.collect()) == list(range(10))


def test_schedules_fold_a_bucket_of_questions_in_one_call(spark, tmp_path, monkeypatch):
    class Kept:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rng, state, want = random.Random(3), Kept(), {}
    for day in range(3):  # three micro-batches
        rows = [(rng.randrange(6 + day), rng.randrange(6), pd.Timestamp("2024-01-01") + pd.Timedelta(days=day, minutes=rng.randrange(20)), i) for i in range(40)]
        for q, quality, at, _ in sorted(rows, key=lambda r: (r[2], r[3])):
            *current, first = want.get(q, (*spaced.NEW, at))
            want[q] = (*spaced.fold_rating(tuple(current), quality), first)
        frame = pd.DataFrame(rows, columns=["question_id", "quality", "created_at", "id"])
        (out,) = activity._fold((5,), iter([frame[:25], frame[25:]]), state)
        assert {r[0]: tuple(r[1:]) for r in out.itertuples(index=False)} == {q: want[q] for q in {r[0] for r in rows}}
    assert sorted(state.get[0]) == sorted(want)


def test_live_schedules_over_micro_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(30) or None, rng.randrange(6), pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), i) for i in range(300)]
    want = {}
    for q, quality, at, _ in rows:
        *current, first = want.get(q, (*spaced.NEW, at))
        want[q] = (*spaced.fold_rating(tuple(current), quality), first)
    for part in range(3):
        df = spark.createDataFrame([(q, n, at.to_pydatetime(), i) for q, n, at, i in rows[part * 100 : part * 100 + 100]], "question_id long, quality int, created_at timestamp, id long")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "ratings.parquet"))
    stream = activity.stream_table(spark, str(tmp_path), "ratings", files_per_batch=1)
    out = activity.latest_schedules(activity.run_to_end(activity.live_schedules(stream), "update")).collect()
    got = {r["question_id"]: (round(r["ease_factor"] * 10), r["interval_days"], r["review_count"], r["next_review"]) for r in out}
    assert got == {q: (e, i, n, (first + pd.Timedelta(days=days)).to_pydatetime()) for q, (e, i, n, days, first) in want.items()}
