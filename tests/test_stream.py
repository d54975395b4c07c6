"""Questions of a stream that are delivered again are answered once, across micro-batches and restarts."""

import pytest
from pyspark.sql import functions as F

from tarnwick.streaming.questions import answer_stream, asked_once, read_questions

SCHEMA = "session long, turn long, text string, at timestamp"


def deliver(spark, folder, rows):
    made = spark.createDataFrame(rows, "session long, turn long, text string, second long").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("second")))
    made.drop("second").coalesce(1).write.mode("append").parquet(f"file://{folder}/in")


def run(spark, folder, seen, files=1):
    questions = asked_once(read_questions(spark, f"file://{folder}/in", SCHEMA, files), ["session", "turn"], "at", "10 minutes")

    def answer(batch):
        seen.append(batch.count())  # read more than once
        return batch.select("session", "turn", F.upper("text").alias("answer"))

    answer_stream(questions, answer, f"file://{folder}/out", f"file://{folder}/checkpoint", with_state=True).awaitTermination()


def answers(spark, folder):
    return sorted(map(tuple, spark.read.schema("session long, turn long, answer string").parquet(f"file://{folder}/out").drop("batch").collect()))


@pytest.mark.parametrize("files", [1, None])
def test_each_question_once(spark, tmp_path, files):
    first = [(1, 0, "a", 0), (1, 1, "b", 5), (2, 0, "c", 6), (1, 0, "a", 0)]
    deliver(spark, tmp_path, first)
    seen = []
    run(spark, tmp_path, seen, files)
    want = [(1, 0, "A"), (1, 1, "B"), (2, 0, "C")]
    assert answers(spark, tmp_path) == want
    # Delivered again, with something new, after a restart.
    deliver(spark, tmp_path, [*first, (1, 2, "d", 30)])
    deliver(spark, tmp_path, first[::-1])
    run(spark, tmp_path, seen, files)
    assert answers(spark, tmp_path) == sorted([*want, (1, 2, "D")])
    run(spark, tmp_path, seen, files)
    assert answers(spark, tmp_path) == sorted([*want, (1, 2, "D")])


def test_a_session_with_most_questions(spark, tmp_path):
    rows = [(1 if i % 3 else i, i, f"q{i}", i % 100) for i in range(1500)]
    deliver(spark, tmp_path, rows)
    deliver(spark, tmp_path, rows[::2])
    run(spark, tmp_path, [])
    assert answers(spark, tmp_path) == sorted((s, t, q.upper()) for s, t, q, _ in rows)


def test_state_expires(spark, tmp_path):
    """Far later questions move the watermark; what it has passed is late and dropped, and its keys are forgotten."""
    deliver(spark, tmp_path, [(1, 0, "a", 0)])
    run(spark, tmp_path, [])
    deliver(spark, tmp_path, [(9, 9, "z", 7200)])
    run(spark, tmp_path, [])
    deliver(spark, tmp_path, [(1, 0, "a", 0), (3, 0, "late", 1), (4, 0, "new", 7300)])
    run(spark, tmp_path, [])
    assert answers(spark, tmp_path) == [(1, 0, "A"), (4, 0, "NEW"), (9, 9, "Z")]
