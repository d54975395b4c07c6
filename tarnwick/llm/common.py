"""Small helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of one batch of rows that goes to Python, where the session has Spark's own larger bound.
BATCH_BYTES = 4 << 20
_BATCH, _USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", "67108864", "67108864b")


def text_batches(rows: DataFrame) -> DataFrame:
    """The same rows, after telling the session to send texts to Python in small batches: a worker holds a batch and what is made of it."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH, _USUAL[0]) in _USUAL:
        conf.set(_BATCH, str(BATCH_BYTES))
    return rows


def trimmed(run):
    """``run`` over batches, after which the idle worker gives unused memory back to the system."""

    def whole(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, in one pass: each word, with the white space after it, becomes one mark.

    Where no word starts the pattern fails at once, so white space of any length takes linear time.
    """
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.length(F.ltrim(marks, F.lit(" \t\n\x0b\f\r"))).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string: five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def bounded_sample(rows: DataFrame, by: str, keys: list[str], per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each value of ``by``: those with the smallest hashes of ``keys``.

    The classes are counted first; rows whose hash is beyond what should hold twice as
    many are left behind where they are, so a few times ``per_class`` rows of a class
    move, however large it is. Only classes of more than that are broadcast with their
    bound, so there may be any number of classes. A null class gives no rows, a table
    without classes none; rows of equal keys are taken in any order, as they are alike;
    columns added on the way take names that the table does not use.
    """
    enough, columns, bound = 2.0 * per_class + 50, rows.columns, free(rows, "_bound")
    rows = rows.filter(F.col(by).isNotNull())
    large = rows.groupBy(by).agg((F.lit(enough) / F.count(F.lit(1))).alias(bound)).filter(F.col(bound) < 1)
    u = unit_hash(*[F.col(k) for k in keys])
    name = free(rows, "_nth")
    near = rows.join(F.broadcast(large), by, "left").filter(u <= F.coalesce(F.col(bound), F.lit(1.0))).select(*columns)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(u, *keys))
    return near.withColumn(name, nth).filter(F.col(name) <= per_class).drop(name)
