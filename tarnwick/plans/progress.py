"""Row counts of a running plan, observed as it runs and without a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation whose ``get`` has their number once an action has run."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen
