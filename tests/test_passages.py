import random

import pytest

from tarnwick.operators import passages
from tarnwick.schemas import EXAMPLES


def _examples(spark, contexts):
    rows = [(i, {"title": t, "sentences": s}, "q", "a") for i, (t, s) in enumerate(contexts)]
    return spark.createDataFrame(rows, EXAMPLES)


def _loop(contexts, cap):
    seen, out = set(), []
    for i, (titles, sentences) in enumerate(contexts):
        for pos, (t, s) in enumerate(zip(titles, sentences)):
            if t not in seen:
                seen.add(t)
                out.append((i, pos, t, " ".join(x for x in s if x is not None)))
        if len(out) >= cap:
            break
    return sorted(out)


def test_flatten_truncates_and_joins(spark):
    df = passages.flatten(_examples(spark, [(["a", "b"], [["x ", " y"]]), ([], []), (["c"], [["p", None, "q"], ["r"]])]))
    assert sorted(map(tuple, df.collect())) == [(0, 0, "a", "x   y"), (2, 0, "c", "p q")]


def test_first_seen_takes_the_earliest(spark):
    df = passages.first_seen(passages.flatten(_examples(spark, [(["a", "a", "A"], [["1"], ["2"], ["3"]]), (["a"], [["4"]])])))
    assert sorted((r.title, r.text) for r in df.collect()) == [("A", "3"), ("a", "1")]


@pytest.mark.parametrize("cap", [-1, 0, 1, 4, 5, 17, 10_000])
def test_cap_by_whole_examples(spark, cap):
    rng = random.Random(cap)
    contexts = [([f"t{rng.randint(0, 60)}" for _ in range(rng.randint(0, 5))], [[f"s{i}{j}"] for j in range(5)]) for i in range(40)]
    contexts[0] = (["t0"], [["s"]])
    got = passages.capped(passages.flatten(_examples(spark, contexts)), cap)
    assert sorted((r.example_ord, r.pos, r.title, r.text) for r in got.collect()) == _loop(contexts, cap)


def test_running_total_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(passages, "RANGE", 7)
    df = spark.range(50).selectExpr("id as o", "id % 3 as n")
    got = {r.o: r.b for r in passages.running_total(df, "o", "n", "b").collect()}
    assert got == {i: sum(j % 3 for j in range(i)) for i in range(50)}


@pytest.mark.parametrize("cap", [-1, 0, 1, 3, 7, 20, 1000])
@pytest.mark.parametrize("first", [1, 3, 100])
def test_early_cap_is_the_cap(spark, cap, first):
    rows = [(i * 2 + 5, {"title": [f"t{(i * 7 + j * 3) % 40}" if i % 5 else None for j in range(i % 4)], "sentences": [[f"s{i}", str(j)] for j in range(i % 4)]}) for i in range(60)]
    examples = spark.createDataFrame(rows, "example_ord long, context struct<title:array<string>,sentences:array<array<string>>>").repartition(4)
    want = sorted(map(str, passages.capped(passages.flatten(examples), cap).select("example_ord", "pos", "title", "text", "passage_id").collect()))
    found, read = passages.capped_early(examples, cap, first)
    assert sorted(map(str, found.select("example_ord", "pos", "title", "text", "passage_id").collect())) == want
    assert read <= 60 and (cap > 7 or first == 100 or read < 60)


def test_early_cap_of_nothing_and_its_bounds_in_the_scan(spark, tmp_path):
    examples = spark.createDataFrame([], "example_ord long, context struct<title:array<string>,sentences:array<array<string>>>")
    found, read = passages.capped_early(examples, 5)
    assert found.count() == 0 and read == 0
    rows = [(i, {"title": [f"t{i}"], "sentences": [["x"]]}) for i in range(1000)]
    spark.createDataFrame(rows, examples.schema).repartitionByRange(10, "example_ord").sortWithinPartitions("example_ord").write.parquet(f"file://{tmp_path}/e")
    examples = spark.read.parquet(f"file://{tmp_path}/e")
    found, read = passages.capped_early(examples, 12, first=10)
    assert found.count() == 12 and read == 50
    plan = examples.filter("example_ord >= 3 and example_ord < 9")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(example_ord), GreaterThanOrEqual(example_ord,3), LessThan(example_ord,9)]" in plan
