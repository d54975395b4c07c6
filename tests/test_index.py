"""Versions and manifests of the index: what counts after a change, and after a build that ended early."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.operators.embed import HashingEmbedder
from tarnwick.sources import index

ROWS = [(1, "a", "alpha"), (2, "b", "beta"), (3, None, None), (2, "b", "beta")]
E = HashingEmbedder(8)


def passages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "passage_id long, title string, text string")


def ids(found):
    return sorted(r.passage_id for r in found.collect())


def test_fingerprint_knows_rows_and_not_their_order(spark):
    base = index.fingerprint(passages(spark))
    assert base["rows"] == 4 and base == index.fingerprint(passages(spark, ROWS[::-1]).repartition(3))
    for other in (ROWS[:3], [*ROWS, ROWS[0]], [(1, "a", "alphA"), *ROWS[1:]], [(1, "alpha", "a"), *ROWS[1:]], [(1, "a", "alpha"), (2, "b", "beta"), (3, "", None), (2, "b", "beta")], [(9, "a", "alpha"), *ROWS[1:]], []):
        assert index.fingerprint(passages(spark, other)) != base


def build(spark, path, rows=ROWS, config=None, check=True, make=None):
    return index.build_or_load(spark, path, make or (lambda: passages(spark, rows)), E, config or {"d": 8}, check_source=check)


def test_built_anew_only_when_something_changed(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert build(spark, path)[1] and not build(spark, path)[1] and not build(spark, path, ROWS[::-1])[1]
    found, built = build(spark, path, ROWS[:2])
    assert built and ids(found) == [1, 2]
    assert build(spark, path, ROWS[:2], {"d": 9})[1]
    # Without a look at the source a change goes unseen; that it was not looked at is known later.
    assert not build(spark, path, ROWS, {"d": 9}, check=False)[1]
    assert build(spark, path, ROWS, {"d": 10}, check=False)[1] and build(spark, path, ROWS, {"d": 10})[1]
    # The latest version and the one before are kept.
    assert len(glob.glob(f"{tmp_path}/index/vectors-*")) == len(glob.glob(f"{tmp_path}/index/manifests/number=*")) == 2


def test_a_build_that_ends_early_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    build(spark, path)
    before = ids(index.load_index(spark, path))

    def broken():
        return passages(spark, ROWS[:1]).selectExpr("passage_id", "title", "if(text = 'alpha', raise_error('stop'), text) as text")

    with pytest.raises(Exception, match="stop"):
        build(spark, path, check=False, config={"d": 9}, make=broken)
    assert ids(index.load_index(spark, path)) == before

    # As if it had ended between the vectors and the manifest.
    calls = []
    monkeypatch.setattr(index.json, "dumps", lambda *a, **k: calls.append(1) or (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        build(spark, path, ROWS[:1], check=False, config={"d": 9})
    monkeypatch.undo()
    assert calls and ids(index.load_index(spark, path)) == before and not build(spark, path)[1]
    # A manifest that is not whole does not count either.
    os.makedirs(tmp_path / "index/manifests/number=7/_temporary/0")
    assert ids(index.load_index(spark, path)) == before
    assert build(spark, path, ROWS[:1])[1] and ids(index.load_index(spark, path)) == [1]


def test_no_index(spark, tmp_path):
    with pytest.raises(ValueError, match="no index"):
        index.load_index(spark, f"file://{tmp_path}/none")


def test_a_build_sends_texts_to_python_in_small_batches_and_restores_the_setting(spark, tmp_path):
    class Counting:
        def encode(self, texts):
            return np.array([[len(texts), 1.0]] * len(texts))

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 100, 1, 1).select(F.col("id").alias("passage_id"), F.lit("t").alias("title"), F.repeat(F.lit("word "), 20_000).alias("text"))
    before = spark.conf.get(setting)
    try:
        for given, least, most in (("64MB", 1, 60), ("1MB", 1, 20)):  # of 100 texts of 100 KB
            spark.conf.set(setting, given)
            path = f"file://{tmp_path}/index-{given}"
            index.write_index(rows, path, Counting(), {"d": 2})
            seen = [round(float(r.embedding[0] / r.embedding[1])) for r in index.load_index(spark, path).collect()]
            assert len(seen) == 100 and least <= max(seen) <= most and spark.conf.get(setting) == given
    finally:
        spark.conf.set(setting, before)
