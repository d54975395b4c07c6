"""The search with bounds gives the rows of the plain search, and skips where it can."""

import numpy as np
import pytest

from tarnwick.operators import bounded, retrieve


def _frame(spark, ids, v, name):
    return spark.createDataFrame([(int(i), [float(x) for x in np.float32(row)]) for i, row in zip(ids, v)], f"{name} long, embedding array<float>").repartition(4)


def _both(spark, q, v, k, skip_same=False, counts=None):
    questions, rows = _frame(spark, range(len(q)), q, "query_id"), _frame(spark, range(len(v)), v, "passage_id")
    plain = sorted(map(tuple, retrieve.top_k(questions, rows, k, skip_same).collect()))
    return plain, sorted(map(tuple, bounded.top_k(questions, rows, k, skip_same, counts=counts).collect()))


@pytest.mark.parametrize("skip_same", [False, True])
@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "tiny", "large", "zero"])
def test_same_rows_as_the_plain_search(spark, monkeypatch, kind, skip_same):
    monkeypatch.setattr(bounded, "ROWS", 200)
    monkeypatch.setattr(bounded, "GROUP", 16)
    monkeypatch.setattr(bounded, "PART", 9)
    rng = np.random.default_rng(len(kind))
    v = rng.normal(size=(900, 12))
    if kind == "clustered":
        v = rng.normal(size=(6, 12))[rng.integers(0, 6, 900)] * 5 + 0.01 * v
    if kind == "equal":
        v[rng.random(900) < 0.4] = v[3]
        v[rng.random(900) < 0.1] = v[5]
    if kind in ("tiny", "large"):
        v *= {"tiny": 1e-6, "large": 1e4}[kind]
    if kind == "zero":
        v[::2] = 0
    plain, found = _both(spark, v[:40].copy(), v, 7, skip_same)
    if kind == "large":  # double precision itself rounds at this size
        assert [r[:3] for r in plain] == [r[:3] for r in found] and np.allclose([r[3] for r in plain], [r[3] for r in found], rtol=1e-12)
    else:
        assert plain == found


def test_more_wanted_than_there_is(spark):
    v = np.eye(4)
    plain, found = _both(spark, v[:2], v, 10)
    assert plain == found and len(found) == 8
    empty = _frame(spark, [], [], "passage_id")
    assert bounded.top_k(_frame(spark, [0], v[:1], "query_id"), empty, 3).count() == 0
    assert bounded.top_k(_frame(spark, [], [], "query_id"), _frame(spark, [0], v[:1], "passage_id"), 3).count() == 0


def test_blocks_and_plans(spark, monkeypatch):
    monkeypatch.setattr(bounded, "QUERY_BLOCK", 5)
    monkeypatch.setattr(bounded, "PLAN_BLOCKS", 2)
    v = np.random.default_rng(1).normal(size=(60, 5))
    plain, found = _both(spark, v[:31], v, 3)
    assert plain == found


def test_clusters_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(bounded, "PART", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = centres[rng.integers(0, 20, 6000)] + 0.002 * rng.normal(size=(6000, 32))
    counts = [spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)]
    questions, rows = _frame(spark, range(40), v[:40], "query_id"), _frame(spark, range(6000), v, "passage_id").coalesce(1)
    plain = sorted(map(tuple, retrieve.top_k(questions, rows, 5).collect()))
    assert plain == sorted(map(tuple, bounded.top_k(questions, rows, 5, counts=counts).collect()))
    pairs, scored = (c.value for c in counts)
    assert pairs == 40 * 6000 and scored < 0.2 * pairs


@pytest.mark.parametrize("always", [[], [250]])
def test_few_of_equal_rows(always):
    v = np.float32(np.vstack([np.tile([1.0, 2.0], (300, 1)), np.random.default_rng(3).normal(size=(50, 2))]))
    ids = np.arange(350)[::-1].copy()
    kept = bounded.few_of_equal(ids, v, 4, np.array(always, dtype=np.int64))
    assert sorted(ids[kept].tolist()) == [*range(50), *range(50, 54), *always]
