"""Prompts and answers: a deterministic stub, or a service behind an adapter."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.text import REFUSAL, passage_block, prompt, py_strip
from tarnwick.schemas import Config
from tarnwick.session import drop_stored, stored

#: Prompts that a task has under way at a time, prompts after which answers are kept, and answers that a task gives out at a time.
IN_FLIGHT, SLICE, _RESULT_ROWS = 8, 10_000, 256
_ANSWERS = "key string, answer string, error string"


def contexts(retrieved: DataFrame) -> DataFrame:
    """query_id and context: the passages' blocks in rank order, a blank line between."""
    block = passage_block(F.col("rank"), F.col("title"), F.col("text"))
    blocks = F.sort_array(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return retrieved.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id, question, prompt of every question; one without passages has an empty context."""
    return questions.join(contexts(retrieved), "query_id", "left").select(
        "query_id", F.col("text").alias("question"), prompt(F.coalesce("context", F.lit("")), F.col("text")).alias("prompt")
    )


def stub_answers(questions: DataFrame, retrieved: DataFrame, threshold: float = 0.4) -> DataFrame:
    """query_id and answer: the best passage's title, or the refusal where none reaches the threshold."""
    top = retrieved.filter("rank = 1").select("query_id", "title", "score")
    said = F.when(F.col("score") >= threshold, F.col("title")).otherwise(F.lit(REFUSAL))
    return questions.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce(said, F.lit(REFUSAL)).alias("answer"))


def service_answers(prompted: DataFrame, connect: Callable[[], Callable[[str], str]], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """query_id and answer from a service: one client per partition, each prompt asked once.

    ``connect`` returns a function of one user message. The answers are written to the
    shared folder, so that nothing asks again when they are read a second time.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = None
        for pdf in parts:
            ask = ask or connect()
            yield pd.DataFrame({"query_id": pdf["query_id"], "answer": [_asked(ask, p, tries, wait) for p in pdf["prompt"]]})

    answers = prompted.select("query_id", "prompt").mapInPandas(run, "query_id long, answer string")
    return stored(answers.withColumn("answer", py_strip(F.col("answer"))), "answers")


def kept_answers(
    prompted: DataFrame, connect: Callable[[], Callable[[str], str]], folder: str, in_flight: int = IN_FLIGHT, tries: int = 3, wait: float = 1.0, slice_rows: int = SLICE
) -> DataFrame:
    """query_id, answer, error from a service, each different prompt asked once however often this runs.

    ``folder`` is a Parquet table of prompts by their hash, with their answers or what went
    wrong. Prompts that it has an answer to are not asked. The others are asked in slices of
    about ``slice_rows``, each added to the table when it is done: a job that ends early
    has kept the slices before, and its next run asks for the rest. A task asks
    ``in_flight`` prompts at a time, over one client. A prompt whose ``tries`` all
    failed is a row with an error and no answer, and fails nothing else; the next run
    asks it again. Only a task that is lost and run again repeats what it had asked.

    Null prompts are not asked: their answer and error are null.
    """
    spark = prompted.sparkSession
    keyed = prompted.select("query_id", "prompt", F.sha2("prompt", 256).alias("key"))
    new = keyed.filter("prompt is not null").groupBy("key").agg(F.first("prompt").alias("prompt"))  # equal keys have equal prompts
    done = _answered(spark, folder)
    if done is not None:
        new = new.join(done.filter("answer is not null").select("key"), "key", "left_anti")
    new = stored(new, "prompts")
    slices = max(1, -(-new.count() // slice_rows))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = None
        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in parts:
                ask = ask or connect()
                for lo in range(0, len(pdf), _RESULT_ROWS):
                    part = pdf.iloc[lo : lo + _RESULT_ROWS]
                    said = list(pool.map(lambda p, ask=ask: _tried(ask, p, tries, wait), part["prompt"]))
                    yield pd.DataFrame({"key": part["key"], "answer": [a for a, _ in said], "error": [e for _, e in said]})

    for i in range(slices):
        own = new.filter(F.pmod(F.xxhash64("key"), F.lit(slices)) == i)
        own.mapInPandas(run, "key string, answer string, error string").withColumn("answer", py_strip(F.col("answer"))).write.mode("append").parquet(folder)
    drop_stored(new)
    said = _answered(spark, folder)
    if said is None:
        said = spark.createDataFrame([], _ANSWERS)
    # A prompt has one answer at most; of errors one is shown.
    said = said.groupBy("key").agg(F.max("answer").alias("answer"), F.max("error").alias("error"))
    said = said.withColumn("error", F.when(F.col("answer").isNull(), F.col("error")))
    return keyed.select("query_id", "key").join(said, "key", "left").select("query_id", "answer", "error")


def _answered(spark, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(_ANSWERS).parquet(folder)
    except AnalysisException as e:  # nothing has been asked yet
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _tried(ask: Callable[[str], str], text: str, tries: int, wait: float) -> tuple[str | None, str | None]:
    try:
        return _asked(ask, text, tries, wait), None
    except Exception as e:  # noqa: BLE001  (whatever it is, it is this prompt's row)
        return None, f"{type(e).__name__}: {e}"


def _asked(ask: Callable[[str], str], text: str, tries: int, wait: float) -> str:
    for left in range(tries - 1, -1, -1):
        try:
            return ask(text)
        except (OSError, TimeoutError):
            if not left:
                raise
            time.sleep(wait)
    raise AssertionError


def connect_of(config: Config):
    """How a configuration's generator is reached; None for the stub."""
    return None if config.generator == "stub" else chat_service(config.service, config.generator)


def chat_service(url: str, model: str, timeout: float = 120.0) -> Callable[[], Callable[[str], str]]:
    """A client of a local chat service: one user message in, ``message.content`` out."""

    def connect():
        import json
        import urllib.request

        def ask(text: str) -> str:
            body = json.dumps({"model": model, "stream": False, "messages": [{"role": "user", "content": text}]}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)["message"]["content"]

        return ask

    return connect
