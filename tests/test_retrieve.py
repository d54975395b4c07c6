import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import retrieve
from tarnwick.operators.vectors import dimension, l2_normalize

VECTORS = "passage_id long, embedding array<float>"


def _vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def _made(spark, n=60, d=5):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, size=(n, d)).astype(float)
    return x, _vectors(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)])


@pytest.mark.parametrize("k", [1, 7, 100])
@pytest.mark.parametrize("block,blocks", [(3, 2), (3, 16), (4096, 16)])
def test_both_forms_are_brute_force(spark, monkeypatch, k, block, blocks):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieve, "PLAN_BLOCKS", blocks)
    monkeypatch.setattr(retrieve, "ROW_BLOCK", 11)
    x, v = _made(spark)
    q = v.filter("passage_id % 9 = 0").select(F.col("passage_id").alias("query_id"), "embedding")
    want = sorted(
        (i, r + 1, j, float(x[i] @ x[j])) for i in range(0, 60, 9) for r, j in enumerate(sorted(range(60), key=lambda j: (-(x[i] @ x[j]), j))[:k])
    )
    for form in (retrieve.top_k, retrieve.top_k_sql):
        assert sorted(tuple(r) for r in form(q, v.repartition(3), k).collect()) == want


def test_more_questions_than_a_block_in_expressions(spark):
    n = retrieve.QUERY_BLOCK + 1
    q = spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    v = _vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    got = retrieve.top_k_sql(q, v, 1)
    assert got.count() == n and got.select("rank", "passage_id", "score").distinct().collect() == [(1, 1, 1.0)]


def test_skips_itself_and_ranks_few(spark):
    v = _vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    assert sorted(tuple(r) for r in retrieve.top_k(q, v, 5, skip_same=True).collect()) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]


def test_empty_sides(spark):
    v = _vectors(spark, [(1, [1.0, 0.0]), (2, None)])
    none = _vectors(spark, [])
    q = lambda x: x.select(F.col("passage_id").alias("query_id"), "embedding")
    assert retrieve.top_k(q(none), v, 3).collect() == []
    assert retrieve.top_k(q(v), none, 3).collect() == []


def test_plan_limits_before_the_shuffle_and_never_broadcasts_the_corpus(spark):
    _, v = _made(spark)
    q = v.limit(3).select(F.col("passage_id").alias("query_id"), "embedding")
    plan = retrieve.top_k(q, v, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("most", [1, 1_000_000])
def test_passages_stay_where_they_are(spark, monkeypatch, most):
    """A checked number of retrieved rows is broadcast; more meet the passages in a shuffle. Both give the same."""
    monkeypatch.setattr(retrieve, "BROADCAST_ROWS", most)
    p = spark.range(50).selectExpr("id as passage_id", "concat('t', id) as title", "concat('x', id) as text")
    f = spark.createDataFrame([(1, 1, 7, 0.5), (1, 2, 60, 0.4), (2, 1, 7, 0.3)], "query_id long, rank int, passage_id long, score double")
    out = retrieve.with_passages(f, p)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 7, "t7", "x7", 0.5), (2, 1, 7, "t7", "x7", 0.3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert most == 1 or ("BroadcastHashJoin" in plan and "hashpartitioning" not in plan)


def test_normalize_keeps_zero_vectors(spark):
    v = _vectors(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0])])
    got = {r.passage_id: r.n for r in v.select("passage_id", l2_normalize(F.col("embedding")).alias("n")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_dimension(spark):
    assert dimension(_vectors(spark, [(1, [1.0, 2.0])])) == 2
    assert dimension(_vectors(spark, [])) is None
    with pytest.raises(ValueError):
        dimension(_vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_expressions_compile_their_products_and_sort_only_what_a_bound_leaves(spark):
    rng = np.random.default_rng(4)
    v = _vectors(spark, [(i, [float(x) for x in rng.normal(size=4)]) for i in range(900)] + [(900, [1.0]), (901, [None, 1.0, 1.0, 1.0]), (902, None)])
    q = v.filter("passage_id in (3, 5)").select(F.col("passage_id").alias("query_id"), "embedding")
    out = retrieve.top_k_sql(q, v, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "_low" in plan
    full = v.filter("passage_id < 900")
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in retrieve.top_k(q, full, 3).collect())
    # Fewer rows than asked for: a vector with a missing component has no score, and comes last.
    got = [(r.rank, r.passage_id, r.score is None) for r in retrieve.top_k_sql(q.limit(1), v.filter("passage_id in (3, 900)"), 5).orderBy("rank").collect()]
    assert got == [(1, 3, False), (2, 900, True)]


def _batches(ids, x, rows):
    kind = pa.float32() if x.dtype == np.float32 else pa.float64()
    for at in range(0, len(ids), rows):
        part = x[at : at + rows]
        v = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1], pa.array(part.ravel(), kind))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + rows]), v], names=["passage_id", "embedding"])


def _best(q_ids, q, ids, x, k, skip_same):
    rows = []
    for i, a in zip(q_ids, q.astype(np.float64)):
        s = [(round(float(a @ b), 9) + 0.0, int(j)) for j, b in zip(ids, x.astype(np.float64)) if not (skip_same and i == j)]
        rows += [(int(i), j, t) for t, j in sorted(s, key=lambda r: (-r[0], r[1]))[:k]]
    return sorted(rows)


@pytest.mark.parametrize("skip_same", [False, True])
@pytest.mark.parametrize("kind,scale", [(np.float32, 1.0), (np.float64, 1.0), (np.float32, 1e18)])
def test_scan_is_brute_force_on_ties_zeros_and_copies(monkeypatch, kind, scale, skip_same):
    monkeypatch.setattr(retrieve, "ROW_BLOCK", 37)
    monkeypatch.setattr(retrieve, "PART", 4)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, size=(400, 6)).astype(kind) * kind(scale)
    x[50:150] = x[50]
    x[200:210] = 0
    ids = rng.permutation(400).astype(np.int64)
    some = [0, 50, 60, 149, 200, 205, 300, 399, 17]
    got = list(retrieve._scan(ids[some], x[some], 5, skip_same, 9)(_batches(ids, x, 90)))
    rows = sorted((q, p, s + 0.0) for b in got for q, p, s in zip(*[c.to_pylist() for c in b.columns]))
    want = _best(ids[some], x[some], ids, x, 5, skip_same)
    assert [r[:2] for r in rows] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in rows], [r[2] for r in want])


def test_scan_selects_by_what_it_holds(monkeypatch):
    """Only the first rows are partitioned; later ones are compared with the k-th score so far."""
    calls, part = [], np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **b: calls.append(1) or part(*a, **b))
    x = np.random.default_rng(6).normal(size=(2000, 8)).astype(np.float32)
    ids = np.arange(2000)
    list(retrieve._scan(ids[:40], x[:40], 5, False, 9)(_batches(ids, x, 100)))
    assert len(calls) == 1


def test_texts_are_embedded_in_slices(spark):
    from tarnwick.operators.embed import SLICE, HashingEmbedder, embed

    class Few(HashingEmbedder):
        def encode(self, texts):
            assert len(texts) <= 512
            return super().encode(texts)

    n = 2 * SLICE + 7
    rows = spark.range(0, n, 1, 1).selectExpr("id as passage_id", "if(id % 5 = 0, null, concat('word', id % 3)) as text")
    out = embed(rows, Few(16), keep=("passage_id", "text")).collect()
    alone = {t: [float(y) for y in HashingEmbedder(16).encode([t])[0]] for t in (None, "word0", "word1", "word2")}
    assert len(out) == n and all(list(r.embedding) == alone[r.text] for r in out)


def test_evaluation_does_not_read_texts_that_it_does_not_show(spark, tmp_path):
    from tarnwick.operators.embed import HashingEmbedder, embed
    from tarnwick.plans import rag

    p = spark.createDataFrame([(1, "red", "red apple"), (2, "blue", "blue sky sea")], "passage_id long, title string, text string")
    e, path = HashingEmbedder(32), f"file://{tmp_path}/index"
    embed(p, e, keep=("passage_id", "title", "text")).write.parquet(path)
    ex = spark.createDataFrame([(1, "red apple", "Red")], "query_id long, question string, answer string")
    out = rag.evaluate_questions(ex, spark.read.parquet(path), e)
    assert [(r.predicted, r.exact_match, r.retrieved_titles) for r in out.collect()] == [("red", 1, ["red", "blue"])]
    reads = [x for x in out._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ") if x.startswith("struct<passage_id:bigint,title")]
    assert reads and not any("text" in x.split(">")[0] for x in reads)


def test_places_that_reach_a_bound():
    rng = np.random.default_rng(7)
    for shape in ((1, 1), (3, 8), (5, 13), (40, 100)):
        s, low = rng.normal(size=shape).astype(np.float32), rng.normal(size=shape[0]).astype(np.float32)
        got, want = retrieve._at_least(s, low), np.nonzero(s >= low[:, None])
        assert [a.tolist() for a in got] == [a.tolist() for a in want]


def test_held_rows_are_the_best_whatever_the_order():
    rng = np.random.default_rng(8)
    q, p, s = rng.integers(0, 6, 300), rng.permutation(300), rng.integers(-4, 5, 300).astype(float)
    q[q == 2] = 3  # nothing is held for question 2
    h = retrieve.Held(6, 4)
    for at in range(0, 300, 17):
        h.add(q[at : at + 17], p[at : at + 17], s[at : at + 17])
    best = lambda i: sorted((-float(x), int(j)) for a, j, x in zip(q, p, s) if a == i)[:4]
    assert sorted((int(i), -float(x), int(j)) for i, j, x in zip(*h.rows())) == sorted((i, *r) for i in range(6) for r in best(i))
    assert np.isneginf(h.kth[2])


def test_a_vector_that_is_no_number_hides_no_other():
    x = np.random.default_rng(9).normal(size=(30, 4)).astype(np.float32)
    x[7, 2] = np.nan
    ids = np.arange(30)
    got = list(retrieve._scan(ids[:3], x[:3], 4, False, 9)(_batches(ids, x, 30)))
    rows = sorted((q, p, s) for b in got for q, p, s in zip(*[c.to_pylist() for c in b.columns]))
    there = np.delete(ids, 7)
    assert [r[:2] for r in rows] == [r[:2] for r in _best(ids[:3], x[:3], there, x[there], 4, False)]


def _counted(n, words, seed, width=32):
    """Rows of length one that were counts of hashed words, some of zeros."""
    rng = np.random.default_rng(seed)
    c = np.stack([np.bincount(rng.zipf(1.5, m) % width, minlength=width) for m in rng.integers(0, words, n)]).astype(np.float64)
    return (c / np.maximum(np.sqrt((c**2).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)


@pytest.mark.parametrize("skip_same", [False, True])
def test_two_rows_share_a_product_and_none_is_lost(monkeypatch, skip_same):
    monkeypatch.setattr(retrieve, "PART", 16)
    monkeypatch.setattr(retrieve, "ROW_BLOCK", 301)
    calls, hits = [], retrieve._hits
    monkeypatch.setattr(retrieve, "_hits", lambda *a: calls.append(out := hits(*a)) or out)
    q, x = _counted(90, 40, 1), _counted(4000, 300, 2)
    q[7] *= np.float32(np.pi)  # no length of one
    q[8] = np.random.default_rng(3).random(q.shape[1], dtype=np.float32)  # no counts
    q[9] = 0
    q[10] = np.eye(q.shape[1], dtype=np.float32)[31] * 2 / 3
    x[100:140] = x[100]
    x[500], x[501] = q[20], q[21]
    ids = np.random.default_rng(4).permutation(len(x))
    q_ids = ids[: len(q)] if skip_same else np.arange(len(q))
    got = list(retrieve._scan(q_ids, q, 6, skip_same, 9)(_batches(ids, x, 700)))
    rows = sorted((a, p, s + 0.0) for b in got for a, p, s in zip(*[c.to_pylist() for c in b.columns]))
    want = _best(q_ids, q, ids, x, 6, skip_same)
    assert [r[:2] for r in rows] == [r[:2] for r in want] and np.allclose([r[2] for r in rows], [r[2] for r in want], atol=2e-9)
    assert sum(c is not None for c in calls) > 20


def test_questions_that_are_counts():
    q = np.array([[0, 1, 2, 0], [2, 3, 0, 4], [0.3, 0.4, 0.123, 0], [0, 0, 0, 0], [-1, 1, 0, 0], [np.nan, 1, 0, 0], [0, 0, 0, 5]], dtype=np.float32)
    c = retrieve.Counts(q / np.float32(7))
    assert (c.level >= 0).tolist() == [True, True, False, False, False, False, True]
    assert c.whole[[0, 1, 6]].tolist() == [[0, 1, 2, 0], [2, 3, 0, 4], [0, 0, 0, 1]] and (c.off < 1e-6).all(where=c.level >= 0)
    assert retrieve.Counts(q.astype(np.float64)).level.tolist() == [-1] * 7


@pytest.mark.parametrize("most", [1, 1_000_000])
def test_equal_vectors_are_scored_once(spark, monkeypatch, most):
    monkeypatch.setattr(retrieve, "MANY", 1, raising=False)
    monkeypatch.setattr(retrieve, "BROADCAST_ROWS", most)
    scan, pairs = retrieve._scan, spark.sparkContext.accumulator(0)

    def counted(ids, questions, *rest):
        def run(batches):
            def seen():
                for b in batches:
                    pairs.add(len(ids) * b.num_rows)
                    yield b

            yield from scan(ids, questions, *rest)(seen())

        return run

    monkeypatch.setattr(retrieve, "_scan", counted)
    base = np.array([[3, 0, 1], [0, 2, 2], [1, 1, 1], [0, 0, 0], [2, 0, 0.0], [0, 3, 0]])
    rows = [(i, [float(y) for y in base[i % 6]]) for i in range(60)] + [(60, None), (61, [9.0, 9.0, 9.0])]
    v = _vectors(spark, rows).repartition(3)
    q = _vectors(spark, [(100 + i, rows[i % 4][1]) for i in range(12)]).withColumnRenamed("passage_id", "query_id")
    got = sorted(tuple(r) for r in retrieve.top_k(q, v, 13).collect())
    there = [(j, x) for j, x in rows if x]
    want = []
    for i in range(12):
        s = sorted((-sum(a * b for a, b in zip(rows[i % 4][1], x)), j) for j, x in there)[:13]
        want += [(100 + i, r + 1, j, -t + 0.0) for r, (t, j) in enumerate(s)]
    assert got == sorted(want)
    some = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 61)], "p long").filter(F.pmod(F.xxhash64("p"), F.lit(32)) == 0).count()
    assert pairs.value == 4 * (7 + some)  # of 12 questions and 61 vectors


@pytest.mark.parametrize("skip_same", [False, True])
def test_rows_that_are_searched_first_bound_the_others(spark, monkeypatch, skip_same):
    scan, lows = retrieve._scan, spark.sparkContext.accumulator(0)

    def seen(ids, questions, k, skip_same, places, low=None):
        lows.add(0 if low is None else int(np.isfinite(low).sum()))
        return scan(ids, questions, k, skip_same, places, low)

    monkeypatch.setattr(retrieve, "_scan", seen)
    x = _counted(500, 60, 5)
    v = _vectors(spark, [(i, [float(y) for y in r]) for i, r in enumerate(x)]).repartition(3)
    q = v.filter("passage_id < 40").select(F.col("passage_id").alias("query_id"), "embedding")
    plain = sorted(tuple(r) for r in retrieve.top_k(q, v, 7, skip_same).collect())
    assert not lows.value
    monkeypatch.setattr(retrieve, "MANY", 40)
    monkeypatch.setattr(retrieve, "FIRST", 4)
    assert sorted(tuple(r) for r in retrieve.top_k(q, v, 7, skip_same).collect()) == plain
    assert lows.value and [r[:3] for r in plain] == sorted((a, 1 + n, p) for a, n, p in _ranks(_best(np.arange(40), x[:40], np.arange(500), x, 7, skip_same)))


def _ranks(rows):
    """Question, place from 0 and row of what ``_best`` gives."""
    for a in sorted({r[0] for r in rows}):
        for n, r in enumerate(sorted((r for r in rows if r[0] == a), key=lambda r: (-r[2], r[1]))):
            yield a, n, r[1]
