"""A stream of questions, each micro-batch answered by the batch plan, and each question once.

Sources deliver a question again after a failure, or twice. ``asked_once`` keeps the keys of
questions as state of the stream, partitioned by key, until the watermark of their time has passed
``expiry``: a question that comes again within that time is dropped, in whatever
micro-batch and after whatever restart, and one that is later than the watermark is too.
State is by question, not by session, so a session that holds a third of all questions is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwick.session import stored


def read_questions(spark: SparkSession, folder: str, schema: str = "query_id long, text string", files_per_batch: int | None = None) -> DataFrame:
    source = spark.readStream.schema(schema)
    return (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).parquet(folder)


def asked_once(questions: DataFrame, keys: list[str], time: str, expiry: str = "1 hour") -> DataFrame:
    """The first delivery of each question; its keys are remembered for ``expiry`` of event time."""
    return questions.withWatermark(time, expiry).dropDuplicatesWithinWatermark(keys)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True, with_state: bool = False):
    """Start answering; every micro-batch replaces its own folder, so a repeated one changes nothing.

    A micro-batch of a stream with state is written before it is answered: the plan that
    answers may read its questions several times, the state may be advanced once.
    """

    def run(batch: DataFrame, number: int) -> None:
        answer(stored(batch, "micro-batch") if with_state else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
