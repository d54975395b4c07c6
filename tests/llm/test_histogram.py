"""Packing by the histogram of lengths, and encoding in batches, against plain versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tarnwick.llm import histogram, packing
from tarnwick.llm.histogram import Plan, enumerated, rounded, solve
from tarnwick.llm.tokens import BatchEncoder
from tests.llm.helpers import frame, made_documents


def _whole(text):
    tokenizer = packing.encoder(packing.tokenizer_path()).whole
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_of_texts_have_the_librarys_ids(seed, monkeypatch):
    from tarnwick.llm import tokens

    monkeypatch.setattr(tokens, "LONG_TEXT", 400)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    rng = random.Random(seed)
    parts = ["a", "b", "é", " ", "\n", " ", "word", "'s", "12", " ", "\t", "中", "<|endoftext|>", ",", "ß.", " the", "\x1c", "  ", "!", " ", "Word; "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["one two\nthree, four." * 60, "x" * 500, "a b", None, ""]
    encode = BatchEncoder(packing.Encoder(packing.tokenizer_path()))
    for lo in range(0, len(texts), 400):
        own = texts[lo : lo + 400]
        ids, bounds = encode.ids(pa.array(own, pa.string()), 0)
        for i, text in enumerate(own):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == _whole(text) + [0], text
    assert len(encode.ids(pa.array([], pa.string()), 0)[0]) == 0


def test_combinations_fill_powers_of_two():
    counts = np.zeros(17)
    counts[[1, 3, 5, 6, 8, 10]] = 1
    got = {tuple(x for x in row if x) for row in enumerated(counts, 16).tolist()}
    have = [1, 3, 5, 6, 8, 10]
    want = {c for c in [(a,) for a in have] + [(a, b) for a in have for b in have if a <= b] + [(a, b, c) for a in have for b in have for c in have if a <= b <= c] if sum(c) in (1, 2, 4, 8, 16)}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_solution_is_least_squares_over_non_negative_counts(seed):
    """No feasible direction descends: the slope is nothing where a count is positive and not downhill where it is zero."""
    rng = np.random.default_rng(seed)
    counts = np.zeros(65)
    counts[1:65] = rng.integers(0, 50, 64)
    combos = enumerated(counts, 64)
    x = solve(combos, counts)
    assert (x >= 0).all()
    left = counts - np.bincount(combos.ravel(), weights=np.repeat(x, combos.shape[1]), minlength=65)
    left[0] = 0
    slope = left[combos].sum(axis=1)
    assert np.abs(slope[x > 1e-6]).max() < 1e-3 * counts.max() and slope.max() < 0.05 * counts.max()
    open_ = counts.astype(np.int64)
    taken = np.zeros(65, dtype=np.int64)
    for combo, n in rounded(combos, x, open_):
        assert sum(combo) & (sum(combo) - 1) == 0
        np.add.at(taken, list(combo), n)
    assert (open_ >= 0).all() and (taken + open_ == counts).all()


@pytest.mark.parametrize("seed", range(40))
def test_plans_cover_the_tape_once(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 2, 16, 64])
    counts = {rng.randint(1, window): rng.randint(1, 40) for _ in range(rng.randint(0, 12))}
    plan = Plan(counts, window)
    total, runs = sum(k * n for k, n in counts.items()), plan.table()
    cover, ends = np.zeros(total, dtype=int), set(plan.edges().tolist()) | set(range(0, total + 1, window))
    for length, _, n, place, each, block, taken, rest in runs.tolist():
        assert (rest >= 0) == (taken < length)
        for i in range(n):
            at = place + i // each * block + i % each * taken
            cover[at : at + taken] += 1
            assert not any(at < e < at + taken for e in ends)
    assert (cover == 1).all()
    for length in np.unique(runs[:, 0]):
        own = runs[runs[:, 0] == length]
        assert own[0, 1] == 0 and (own[1:, 1] == own[:-1, 1] + own[:-1, 2]).all() and own[-1, 1] + own[-1, 2] == plan.made[length]


def _check(rows, docs, window):
    """Pieces are the documents' ids, each once; sequences are full, or as long as a power of two."""
    left, sequences, crcs = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0
    assert sum(max(o + n for o, n in p) < window for p in sequences.values()) <= window.bit_length()
    for d, text in docs:
        crcs[d].append(_whole(text) + [0])
    for r in rows:
        left[r.doc_id].append(r)
    assert set(left) == set(crcs)
    for d, own in left.items():
        # Rows of one id may hold several texts: each piece is one of theirs, and all ids are there.
        assert sum(r.length for r in own) == sum(map(len, crcs[d]))
        for r in own:
            crc = [zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for ids in crcs[d] if len(ids) == r.doc_tokens]
            assert r.ids_crc32 in crc
        if len(crcs[d]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at
                at += r.length


@pytest.mark.parametrize("window", [1024, 32])
def test_documents_are_packed_without_padding(spark, window, monkeypatch):
    monkeypatch.setattr(histogram, "TASKS", 2)  # several rounds
    monkeypatch.setattr(histogram, "PLAN_ROUNDS", 1)
    docs = made_documents(seed=3)
    rows = histogram.pack(frame(spark, docs, 5), packing.tokenizer_path(), window).collect()
    _check(rows, [(r[0], r[1]) for r in docs], window)


def test_a_third_of_the_rows_equal(spark):
    docs = spark.range(30_000).selectExpr("if(id % 3 = 0, 7L, id) as doc_id", "if(id % 3 = 0, 'the same few words', concat('text ', id)) as text")
    out = histogram.pack(docs.repartition(6), packing.tokenizer_path())
    n = sum(len(_whole(r.text)) + 1 for r in docs.collect())
    got = out.selectExpr("sum(length) as n", "count(distinct sequence_id, offset) = count(*) as apart", "max(offset + length) as most").head()
    assert (got.n, got.apart, got.most) == (n, True, 1024)


def test_nothing_and_wrong_windows(spark):
    assert histogram.pack(spark.createDataFrame([], "doc_id long, text string"), packing.tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        histogram.pack(spark.createDataFrame([], "doc_id long, text string"), packing.tokenizer_path(), 1000)
