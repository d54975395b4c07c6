"""Session builder and the shared folder for intermediate tables."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of one file of a table whose size is known, the number of files from which on they are left as they are, and the least.
FILE_ROWS, MOST_FILES, LEAST_FILES = 10_000, 100, 6
#: Bytes of one batch of texts that goes to Python, where the session has Spark's own larger bound.
BATCH_BYTES = 4 << 20
_BATCH, _USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", "67108864", "67108864b")


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    n = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tarnwick")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@functools.lru_cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tarnwick-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests, benchmarks) is a temporary folder
    made; on a cluster no executor would see it, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_tables(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application, when no result that reads them is needed."""
    delete_folder(spark, _tables(spark))


def drop_stored(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = df.__dict__.pop("_stored_at", None)
        if path:
            delete_folder(df.sparkSession, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """What is run meanwhile sends rows to Python in small batches: a worker holds one, and what is made of it. The setting is restored."""
    before = spark.conf.get(_BATCH, _USUAL[0])
    if before not in _USUAL:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor. Where the caller knows that
    there are ``rows`` rows at most, a small table is dealt over few files once it is made: one per
    ``FILE_ROWS`` rows, however many tasks made it.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    schema = df.schema
    if rows is not None and rows < FILE_ROWS * MOST_FILES:
        df = df.repartition(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out
