import random

import numpy as np
import pyarrow as pa
import pytest

from tarnwick.llm import repeats, scan
from tests.llm.helpers import made_documents, words


@pytest.mark.parametrize("chunk", [64, 4 << 20])
def test_words_and_hashes(monkeypatch, chunk):
    texts = [r[1] for r in made_documents()] + ["w" * n for n in (7, 8, 9, 16, 17, 255, 256, 257, 5000)]
    monkeypatch.setattr(scan, "pieces", lambda off, most=chunk, f=scan.pieces: f(off, chunk))
    seen, rows = {}, []
    for w in scan.words(pa.array(texts, pa.string())):
        h0, h1 = w.hashes(), w.hashes(1)
        for r in range(w.n_rows):
            own = []
            for i in range(w.first[r], w.first[r + 1]):
                word = w.data[w.starts[i] : w.ends[i]].tobytes()
                own.append(word.decode())
                assert seen.setdefault(word, (h0[i], h1[i])) == (h0[i], h1[i])
            rows.append(own)
    assert rows == [words(t) for t in texts]
    assert len(set(seen.values())) == len(seen) == len({a for a, _ in seen.values()})


def test_slices_of_columns_and_large_strings():
    a = pa.array(["skip", "one two", None, "", "three"], pa.string())
    for column in (a.slice(1), a.slice(1).cast(pa.large_string()), pa.chunked_array([a.slice(1, 2), a.slice(3)])):
        assert [(int(w.first[-1]), w.n_rows) for w in scan.words(column)] == [(3, 4)]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 8, 13, 20])
def test_runs_and_minimum(k):
    rng = np.random.default_rng(k)
    h = rng.integers(0, 3, 200).astype(np.uint64)
    g, low = scan.runs(h, k), scan.run_minimum(h, k)
    known = {}
    for i in range(200 - k + 1):
        assert known.setdefault(tuple(h[i : i + k]), g[i]) == g[i]
        assert low[i] == h[i : i + k].min()
    assert len(set(known.values())) == len(known)


def test_sketch_never_misses_a_repeat(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(2**62),) for _ in range(3000)]
    again = [rng.choice(rows) for _ in range(200)]
    df = spark.createDataFrame(rows + again, "x long").repartition(70)
    got, heavy, n = repeats.build(df, lambda b: iter([scan.mix64(b.column(0).to_numpy().view(np.uint64))]), 2, 21, heavy=1)
    twice = scan.mix64(np.array([r[0] for r in again], dtype=np.uint64))
    once = scan.mix64(np.array([r[0] for r in set(rows) - set(again)], dtype=np.uint64))
    assert got.maybe(twice).all() and got.maybe(once).mean() < 0.01
    assert n.sum() == 3200 and (np.diff(heavy.astype(object)) > 0).all()
