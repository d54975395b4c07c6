"""The typed session: a question a line, ``eval`` to evaluate, ``quit`` to end."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tarnwick.operators.evaluate import report_lines, summary
from tarnwick.plans import rag
from tarnwick.schemas import Config

#: Samples of an evaluation that is started from the console.
CONSOLE_SAMPLES = 50


def commands(lines: Iterable[str]) -> Iterable[tuple[str, str]]:
    """(command, question) of each line until ``quit``; blank lines say nothing."""
    for line in lines:
        said = line.strip()
        if said.lower() == "quit":
            return
        if said.lower() == "eval":
            yield "eval", ""
        elif said:
            yield "ask", said


def session(
    spark: SparkSession, lines: Iterable[str], index: DataFrame, embedder, examples: DataFrame | None = None,
    config: Config = Config(), show: Callable[[str], None] = print, connect=None,
) -> None:
    """Answer the questions of ``lines`` and show each report; runs on the driver, one line at a time."""
    for number, (command, question) in enumerate(commands(lines)):
        if command == "ask":
            asked = spark.createDataFrame([(number, question)], "query_id long, text string")
            for row in rag.shown(rag.ask(asked, index, embedder, config, connect=connect)).collect():
                show(row["report"])
        elif examples is not None:
            few = Config(**{**config.__dict__, "num_samples": CONSOLE_SAMPLES})
            rows = rag.evaluate_questions(examples, index, embedder, few, connect=connect).cache()
            if summary(rows).head()["n"]:
                show(report_lines(rows).head()["line"])
            rows.unpersist()
