"""Classification metrics over columns ``label`` and ``predicted``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """Unweighted mean of the F1 of each class that is a label or a prediction.

    Counts of pairs come first, so the rest works on as many rows as classes squared.
    """
    pairs = confusion(rows)
    one = lambda c, n: F.struct(F.col(c).alias("class"), n.alias("hit"), F.lit(1).alias("x"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    # 2 TP / (2 TP + FP + FN): every pair counts once for its label and once for its prediction.
    sides = pairs.select("n", F.explode(F.array(one("label", hit), one("predicted", F.lit(0).cast("long")))).alias("s"))
    f1 = sides.groupBy("s.class").agg((2.0 * F.sum("s.hit") / F.sum("n")).alias("f1"))
    return f1.agg(F.avg("f1").alias("macro_f1"))
