import os
import shutil
import subprocess
import sys
import warnings
from pathlib import Path

import pytest

import __spark_entry__ as entry
from jobs.queries import QUERIES as JOBS
from tarnwick.plans.registered import ORACLE_SQL, QUERIES
from tests.helpers import saved
from tests.oracle import FOLDER, compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def without_optional(tmp_path_factory):
    """A copy without the optional folders and the pipeline."""
    root, copy = Path(entry.__file__).parent, tmp_path_factory.mktemp("copy")
    for name in ("tarnwick", "jobs", "tests"):
        shutil.copytree(root / name, copy / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", copy)
    return lambda *a: subprocess.run([sys.executable, *a], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_nothing_else_needs_the_optional_subpackage(without_optional):
    """The copy still imports and lists the other queries."""
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = without_optional("-c", code)
    assert done.returncode == 0 and int(done.stdout) == len(QUERIES) + len(JOBS), done.stderr


def test_what_else_is_missing_is_told(monkeypatch):
    """A missing library takes the optional queries away with a word, the missing subpackage without one."""
    def fail(missing):
        def importing(name):
            raise ModuleNotFoundError(f"No module named '{missing}'", name=missing)

        return importing

    monkeypatch.setattr(entry.importlib, "import_module", fail("xxhash"))
    with pytest.warns(UserWarning, match="xxhash"):
        assert set(entry.queries()) == set(QUERIES) | set(JOBS)
    monkeypatch.setattr(entry.importlib, "import_module", fail("tarnwick.llm"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert set(entry.queries()) == set(QUERIES) | set(JOBS)


def test_no_other_test_needs_the_optional_tests(without_optional):
    """All tests of the copy are found without an error."""
    done = without_optional("-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout


def _long_conversations(spark, tmp_path, more=()):
    """Turn 1000 of conversation 0 beside turn 0 of conversation 1; every question's best document has its answer as title."""
    texts = {"red": "red\napple", "blue": "blue\nsky", "green": "green\ngrass"}
    saved(spark, [(i, t, *[None] * 10) for i, t in enumerate(texts.values())], tmp_path)
    asked = [(0, 0, "green"), (0, 1000, "red"), (1, 0, "blue"), *more]
    rows = [x for c, t, a in asked for x in ((c, t, "user", texts[a].replace("\n", " ")), (c, t + 1, "assistant", a))]
    return saved(spark, rows, tmp_path, "conversations", "conv_id long, turn long, role string, text string")


def test_long_conversations_keep_their_pairs_apart(spark, tmp_path):
    folder = _long_conversations(spark, tmp_path)
    got = {r.stage: (r.n, r.exact_match, r.n_passages) for r in QUERIES["stage_comparison"](spark, folder).collect()}
    assert got == {1: (3, 1.0, 9), 3: (3, 1.0, 9)}
    assert {r.stage: (r.n, r.exact_match) for r in QUERIES["four_stage_eval"](spark, folder).collect()} == {s: (3, 1.0) for s in (1, 2, 3, 4)}


@pytest.mark.parametrize("far", [7, 1 << 60])
def test_long_conversations_stay_apart_in_the_stream(spark, tmp_path, far):
    folder = _long_conversations(spark, tmp_path, [(far, 5, "red")])
    asked = sorted((r.conv_id, r.turn) for r in QUERIES["question_stream"](spark, folder).collect())
    assert asked == [(0, 0), (0, 1000), (1, 0), (far, 5)]


def test_four_stages_cover_all_pairs(spark, tmp_path):
    folder = _long_conversations(spark, tmp_path, [(c, 0, "red") for c in range(2, 120)])
    assert {r.stage: (r.n, r.exact_match) for r in QUERIES["four_stage_eval"](spark, folder).collect()} == {s: (121, 1.0) for s in (1, 2, 3, 4)}


@pytest.mark.parametrize("name", ["stage_comparison", "agent_loop", "four_stage_eval"])
def test_queries_notice_a_broken_part(spark, monkeypatch, name):
    """With another number of passages, another threshold or another verdict, the SQL no longer agrees."""
    from tarnwick.plans import agent

    if name == "stage_comparison":
        monkeypatch.setattr(agent, "adaptive", lambda found, questions: found)
    else:
        whole = agent.verify
        worse = lambda a, r: whole(a, r, supported=2.0)
        monkeypatch.setattr(agent, "verify", worse)
        monkeypatch.setattr(agent.agent_loop, "__defaults__", (worse, 3))
    with pytest.raises(AssertionError):
        compare(spark, QUERIES[name], ORACLE_SQL[name])
