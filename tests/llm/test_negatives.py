"""Hard negatives against plain loops, with every edge case that the module names."""

import math
import random

import pytest

from pyspark.sql import functions as F

from tarnwick.llm import negatives
from tarnwick.llm.negatives import hard_negatives


def brute(rows, asks, k=5):
    ok = [(i, [math.floor(256 * float(x)) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: max(-(2**63), min(sum(x * y for x, y in zip(a, b)), 2**63 - 1))
    out = []
    for i, v, c in ok:
        if not asks(i):
            continue
        others = sorted(((dot(v, w), j, d) for j, w, d in ok if j != i and len(w) == len(v)), key=lambda t: (-t[0], t[1]))
        for p, j, _ in [t for t in others if t[2] == c][:k]:
            window = [t for t in others if t[2] != c and 80 * p <= 100 * t[0] <= 100 * p][:k]
            out += [(i, j, r, t[1], p, t[0]) for r, t in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, asks, parts=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0)).repartition(parts)
    return sorted(tuple(r) for r in hard_negatives(df, asks).collect())


def vectors(n, d, seed, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.3, spread) for _ in range(d)], rng.randint(0, 3)) for i in range(n)]
    rows += [(n + i, rows[5][1], i % 3) for i in range(40)]  # a group of copies over all labels
    rows += [rows[0], rows[3], (None, rows[1][1], 1), (900, None, 1), (901, [1.0, None] + [0.0] * (d - 2), 1), (902, [float("nan")] * d, 2), (903, [float("inf")] * d, 2), (904, rows[2][1], None)]
    rows += [(905, [], 0), (906, [0.5] * (d + 1), 0), (907, [0.4] * (d + 1), 1), (910, [0.5] * (d + 1), 0), (920, [0.0] * d, 0), (-10, [-0.5] * d, 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,d,spread", [(1, 6, 1.0), (2, 3, 0.05), (3, 16, 30.0)])
def test_equal_to_plain_loops(spark, seed, d, spread, monkeypatch):
    monkeypatch.setattr(negatives, "PART", 7)
    rows = vectors(150, d, seed, spread)
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)


def test_many_blocks_and_plans(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "PART", 3)
    monkeypatch.setattr(negatives, "PLAN_BLOCKS", 2)
    rows = vectors(80, 4, 4)
    assert mined(spark, rows, F.col("vec_id") % 2 == 0) == brute(rows, lambda i: i % 2 == 0)


@pytest.mark.parametrize("size", [1e9, 1e16])
def test_scores_beyond_doubles_stay_exact(spark, size):
    rng = random.Random(6)
    rows = [(i, [rng.random() * size for _ in range(4)], i % 2) for i in range(40)]
    rows += [(40 + i, rows[i][1], 1) for i in range(6)]
    assert mined(spark, rows, F.col("vec_id") % 4 == 0) == brute(rows, lambda i: i % 4 == 0)


def test_a_third_of_the_rows_equal(spark):
    rng = random.Random(5)
    same = [0.1, 0.9, 0.2]
    rows = [(i, same if i % 3 == 0 else [rng.random() for _ in range(3)], i % 2) for i in range(3000)]
    assert mined(spark, rows, F.col("vec_id") % 300 == 0) == brute(rows, lambda i: i % 300 == 0)


def test_equal_anchors_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 10)
    sizes = []
    one = negatives._one_block
    monkeypatch.setattr(negatives, "_one_block", lambda spark, rows, table, *a: sizes.append(table.num_rows) or one(spark, rows, table, *a))
    rows = [(0, [0.5, 0.25], 1)] * 60 + [(i, [0.01 * i, 0.5], i % 3) for i in range(1, 12)]
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)
    assert sum(sizes) == 61 and max(sizes) < 30


def test_nothing(spark):
    assert mined(spark, [], F.col("vec_id") % 10 == 0) == []
    assert mined(spark, [(1, [1.0], 1)], F.col("vec_id") % 10 == 0) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)], F.col("vec_id") % 10 == 0) == []
