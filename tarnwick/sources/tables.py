"""Scans: nested question-answering examples, and substitutes from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.functions.text import blank, py_strip
from tarnwick.schemas import EXAMPLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_examples(spark: SparkSession, path: str, split: str | None = None, file_format: str = "parquet") -> DataFrame:
    """Examples with the declared schema; ``example_ord`` gives their order.

    A split is a folder ``split=<name>`` below ``path``: only its files are read.
    """
    return spark.read.schema(EXAMPLES).format(file_format).load(f"{path}/split={split}" if split else path)


def write_examples(examples: DataFrame, path: str, split: str) -> None:
    """Write examples as the split of that name; missing columns are null."""
    have = set(examples.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in EXAMPLES]
    examples.select(*cols).write.mode("overwrite").parquet(f"{path}/split={split}")


def examples_from_documents(docs: DataFrame, per_example: int = 10) -> DataFrame:
    """Ten documents in a row are the context of one example; a document's first line is its title."""
    lines = F.split("text", "\n")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("pos"), F.col("title"), F.col("sentences"))))
    return (
        docs.select(
            F.expr(f"doc_id div {per_example}").alias("example_ord"), (F.col("doc_id") % per_example).alias("pos"),
            lines[0].alias("title"), lines.alias("sentences"),
        )
        .groupBy("example_ord").agg(ordered.alias("c"))
        .select("example_ord", F.struct(F.col("c.title").alias("title"), F.col("c.sentences").alias("sentences")).alias("context"))
    )


def questions_from_lines(spark: SparkSession, path: str) -> DataFrame:
    """Typed questions, one a line: stripped, blank ones ignored. ``query_id`` is the line's number, files by their path.

    A file of typed questions is read whole, so a line's number does not depend on splits.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    files = files.withColumn("base", F.coalesce(F.sum(F.size("lines")).over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per file
    lines = files.select("base", F.posexplode("lines").alias("pos", "value"))
    lines = lines.select((F.col("base") + F.col("pos")).cast("long").alias("query_id"), py_strip(F.col("value")).alias("text"))
    return lines.filter(~blank(F.col("text")))


def question_answer_pairs(conversations: DataFrame) -> DataFrame:
    """A user's turn and the assistant's that follows: conv_id, turn, question, answer."""
    order = W.partitionBy("conv_id").orderBy("turn")
    after = lambda c: F.lead(c).over(order)
    return (
        conversations.select("conv_id", "turn", "role", "text", after("role").alias("next_role"), after("text").alias("answer"))
        .filter("role = 'user' and next_role = 'assistant'")
        .select("conv_id", "turn", F.col("text").alias("question"), "answer")
    )
