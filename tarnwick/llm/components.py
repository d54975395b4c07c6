"""Connected components of a table of links, and a join that survives hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.session import drop_stored, stored


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join where ``left`` may hold a third of its rows under one key and ``right`` is unique by key.

    The hash as one more key makes both sides shuffle for this join alone, so that
    adaptive execution can split a large partition of ``left``; an aggregate below
    ``right`` would else share its partitioning with the join, which rules that out.
    """
    h = F.xxhash64(*keys)
    return left.withColumn("_h", h).join(right.withColumn("_h", h), ["_h", *keys], how).drop("_h")


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link, to a smaller node that has none: then all is done."""
    ends = links.selectExpr("a as node", "1L as out", "0L as in").unionByName(links.selectExpr("b as node", "0L as out", "1L as in"))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and in = 1)").isEmpty()


def components(links: DataFrame, nodes: int | None = None, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) of every node of ``links`` (columns a, b).

    Alternates large-star and small-star steps, each a minimum per node and a join
    back, until all links are stars around the smallest nodes. Every round's links are a table in the shared
    folder, so a lost executor costs no earlier round; ``nodes``, if known, is the most
    nodes there are, and sizes its files.

    Defined results: links to itself and repeated links add nothing; a link with a null
    end is left out; without links the result is empty. Rounds are as many as the
    logarithm of the longest path squared at worst; beyond ``most_rounds``, which
    that allows for paths of some 100 doublings, it raises an error.
    """
    links = links.filter("a is not null and b is not null")
    links = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    given = links = stored(links, "links", rows=nodes if nodes is None else 4 * nodes)
    for _ in range(most_rounds):
        if _stars(links):
            break
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = spread_join(both, low, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, low, ["a"])
        links = (
            small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        before, links = given, stored(links, "links", rows=nodes if nodes is None else 4 * nodes)
        drop_stored(before)
        given = links
    else:
        raise RuntimeError("components did not settle")
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
