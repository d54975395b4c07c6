"""Build or load an index and answer the questions of standard input, a line each."""

from __future__ import annotations

import argparse
import sys

from tarnwick.operators.embed import embedder_of
from tarnwick.operators.generate import connect_of
from tarnwick.plans import console
from tarnwick.schemas import Config
from tarnwick.session import local_session
from tarnwick.sources import index, tables


def main(arguments: list[str] | None = None, lines=sys.stdin, show=print) -> None:
    ask = argparse.ArgumentParser(prog="tarnwick", description=__doc__)
    ask.add_argument("examples", help="folder of nested examples, one folder per split")
    ask.add_argument("index", help="folder of the index, built if it is not there")
    ask.add_argument("--evaluate-on", default="validation", help="split that the line 'eval' evaluates")
    ask.add_argument("--check-source", action="store_true", help="build anew if the examples have changed")
    for name, kind in (("embedder", str), ("dimensions", int), ("generator", str), ("service", str), ("top_k", int), ("max_passages", int), ("threshold", float)):
        ask.add_argument("--" + name.replace("_", "-"), type=kind, default=getattr(Config, name))
    given = vars(ask.parse_args(arguments))
    examples, path, split = given.pop("examples"), given.pop("index"), given.pop("evaluate_on")
    check = given.pop("check_source")
    config, spark = Config(**given), local_session()
    spark.sparkContext.setLogLevel("ERROR")
    embedder = embedder_of(config)
    found, built = index.from_examples(spark, path, tables.read_examples(spark, examples, "train"), embedder, config, check)
    show(f"{'Built' if built else 'Loaded'} an index of {index.size(found)} passages.")
    asked = tables.read_examples(spark, examples, split).withColumnRenamed("example_ord", "query_id").select("query_id", "question", "answer")
    console.session(spark, lines, found, embedder, asked, config, show, connect_of(config))


if __name__ == "__main__":
    main()
