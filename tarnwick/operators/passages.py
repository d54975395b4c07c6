"""Passages of nested examples: flatten, first-seen dedupe, cap by whole examples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.session import stored

#: Examples per range of the running total; each range is one task's work.
RANGE = 100_000
#: Examples of the first range of an early cap, and how much longer each further range is.
FIRST_RANGE, GROWTH = 10_000, 4
#: An example holds fewer passages than this.
PLACES = 1 << 20


def flatten(examples: DataFrame) -> DataFrame:
    """example_ord, pos, title, text: titles paired with sentences up to the shorter list; sentences joined by a space."""
    title, sentences = F.col("context.title"), F.col("context.sentences")
    n = F.least(F.size(title), F.size(sentences))
    cut = lambda x: F.slice(x, 1, F.greatest(n, F.lit(0)))
    pairs = F.arrays_zip(cut(title).alias("title"), cut(sentences).alias("sentences"))
    return examples.select("example_ord", F.posexplode(pairs).alias("pos", "p")).select(
        "example_ord", F.col("pos").cast("long").alias("pos"), F.col("p.title").alias("title"), F.concat_ws(" ", "p.sentences").alias("text")
    )


def first_seen(flat: DataFrame) -> DataFrame:
    """Per title the passage of the earliest example and place; ``passage_id`` keeps that order."""
    first = F.min_by(F.struct("example_ord", "pos", "text"), F.struct("example_ord", "pos"))
    place = F.when(F.col("f.pos") < PLACES, F.col("f.pos")).otherwise(F.raise_error(F.lit(f"an example holds more than {PLACES} passages")).cast("long"))
    return flat.groupBy("title").agg(first.alias("f")).select(
        (F.col("f.example_ord") * PLACES + place).alias("passage_id"), "title", "f.text", "f.example_ord", "f.pos"
    )


def running_total(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows of smaller ``by``, in two phases: by range, then within ranges."""
    ranged = rows.withColumn("_range", F.floor(F.col(by) / RANGE))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_n"))
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = W.partitionBy("_range").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, "_range")
    return out.withColumn(name, F.col("_base") + F.col("_in")).drop("_range", "_in", "_base")


def capped_by(flat: DataFrame, caps: Iterable[int]) -> DataFrame:
    """For each cap, as column ``cap``, the first-seen passages of the examples read before it was reached.

    The cap is looked at after each whole example, so a result may exceed it, and the
    first example is always in. The examples are read once, whatever the number of caps.
    """
    passages = first_seen(flat)
    # Examples without a new passage add nothing; the first of the others has none before it.
    counted = running_total(passages.groupBy("example_ord").agg(F.count(F.lit(1)).alias("n")), "example_ord", "n", "before")
    each = F.explode(F.array(*[F.lit(c).cast("long") for c in caps])).alias("cap")
    kept = counted.select("example_ord", "before", each).filter("before = 0 or before < cap").select("example_ord", "cap")
    return passages.join(kept, "example_ord")


def capped(flat: DataFrame, cap: int) -> DataFrame:
    """``capped_by`` for one cap."""
    return capped_by(flat, [cap]).drop("cap")


def capped_early(examples: DataFrame, cap: int, first: int = FIRST_RANGE, growth: int = GROWTH) -> tuple[DataFrame, int]:
    """The passages of ``capped``, and the number of examples that were read for them.

    Examples are read in ranges of ``example_ord``, each ``growth`` times as long as the one
    before, until the cap holds; nothing beyond is read. The bounds of a range reach the
    scan, so where files are sorted by ``example_ord`` only those of the range are opened. A
    range's passages are those whose titles no earlier range has had. At most ``growth`` times
    the examples that the cap needs are read, and ``first`` at least.
    """
    ends = examples.agg(F.min("example_ord"), F.max("example_ord")).head()  # from the files' statistics, where they have them
    out, total, read, low = None, 0, 0, ends[0]
    while low is not None and low <= ends[1] and (total == 0 or total < cap):
        high = low + first
        own = examples.filter((F.col("example_ord") >= low) & (F.col("example_ord") < high))
        new = first_seen(flatten(own))
        if out is not None:
            new = new.join(out.select(F.col("title").alias("_title")), F.col("title").eqNullSafe(F.col("_title")), "left_anti")
        new = stored(new, "capped-range")
        counted = running_total(new.groupBy("example_ord").agg(F.count(F.lit(1)).alias("n")), "example_ord", "n", "before")
        counted = counted.withColumn("before", F.col("before") + total)
        # As in ``capped``: the very first example with passages is in, whatever the cap.
        kept = new.join(counted.filter((F.col("before") == 0) | (F.col("before") < cap)).select("example_ord"), "example_ord", "left_semi")
        total, read = total + new.count(), read + own.count()
        out = kept if out is None else out.unionByName(kept)
        low, first = high, first * growth
    if out is None:
        out = first_seen(flatten(examples))
    return out, read


def unique(flat: DataFrame) -> DataFrame:
    """One row: the number of different passages."""
    return flat.agg(F.count_distinct(F.coalesce("title", F.lit("")), F.col("title").isNull()).alias("n"))
