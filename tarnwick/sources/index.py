"""The passage index: versions of a Parquet table, and manifests that say which one counts.

A build writes its vectors to a folder of their own and then a manifest, one line of
JSON in a new numbered folder, which Spark shows to readers only when it is whole. The
manifest with the highest number counts, so a build that ends early leaves the version
before it as it was, and what it wrote is never read. The version before the latest is
kept as well, for readers that have opened it.

A manifest has the configuration and, if asked for, a fingerprint of the passages: their
number and the sums of two hashes of their rows. It changes with any row, and not with
their order. Taking it reads the passages once; without it the source is not looked at.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.embed import embed
from tarnwick.operators.passages import capped, flatten
from tarnwick.schemas import INDEX, Config
from tarnwick.session import delete_folder, small_batches


def fingerprint(passages: DataFrame) -> dict:
    """An order-free hash of a multiset of rows: equal for the same rows, however dealt; repeated rows count."""
    row = [F.struct(F.lit(seed), F.col("passage_id"), F.col("title"), F.col("text")) for seed in (1, 2)]
    total = [F.coalesce(F.sum(F.xxhash64(r, F.to_json(r)).cast("decimal(20,0)")), F.lit(0)).cast("string") for r in row]
    n, first, second = passages.agg(F.count(F.lit(1)), *total).head()
    return {"rows": n, "sums": [first, second]}


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """All complete manifests, the latest first."""
    try:
        rows = spark.read.schema("value string, number long").text(f"{path}/manifests").collect()  # one line a build
    except AnalysisException as e:  # a missing folder is the one error that means "build"
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return [json.loads(r["value"]) for r in sorted(rows, key=lambda r: -r["number"])]


def write_index(passages: DataFrame, path: str, embedder, config: dict, source: dict | None = None) -> None:
    """Embed and write passages as a new version, then its manifest; older versions than the one before go."""
    spark, there = passages.sparkSession, manifests(passages.sparkSession, path)
    version = f"vectors-{uuid.uuid4().hex}"
    vectors = embed(passages, embedder, keep=("passage_id", "title", "text"))
    with small_batches(spark):
        vectors.write.parquet(f"{path}/{version}")
    number = 1 + max((m["number"] for m in there), default=0)
    line = json.dumps({"number": number, "version": version, "config": config, "source": source}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifests/number={number}")
    for old in there[1:]:
        delete_folder(spark, f"{path}/manifests/number={old['number']}")
        delete_folder(spark, f"{path}/{old['version']}")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """passage_id, title, text, embedding of the latest version."""
    there = manifests(spark, path)
    if not there:
        raise ValueError(f"there is no index in {path}")
    return spark.read.schema(INDEX).parquet(f"{path}/{there[0]['version']}")


def build_or_load(spark: SparkSession, path: str, make_passages, embedder, config: dict, check_source: bool = False) -> tuple[DataFrame, bool]:
    """The index and whether it was built now: it is reused only if made with the same configuration.

    With ``check_source`` it is also rebuilt when the passages are no longer those that it
    was made of, or when that is not known.
    """
    latest = next(iter(manifests(spark, path)), None)
    source = fingerprint(make_passages()) if check_source else None
    built = latest is None or latest["config"] != config or (check_source and latest["source"] != source)
    if built:
        write_index(make_passages(), path, embedder, config, source)
    return load_index(spark, path), built


def from_examples(spark: SparkSession, path: str, examples: DataFrame, embedder, config: Config, check_source: bool = False) -> tuple[DataFrame, bool]:
    """The index of nested examples: flattened, first-seen by title, capped by whole examples, embedded and written."""
    make = lambda: capped(flatten(examples), config.max_passages).select("passage_id", "title", "text")
    return build_or_load(spark, path, make, embedder, config.index_fields(), check_source)


def size(index: DataFrame) -> int:
    return index.agg(F.count("embedding")).head()[0]
