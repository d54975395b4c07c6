"""Operators on documents against brute force, with nulls, blanks, very long texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import jaccard, language, mixing, packing, pii, quality, substrings, toxicity
from tests.llm.helpers import frame, made_documents, saved, words


# --- mixing --------------------------------------------------------------------------


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Reshare what is above a source's cap, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: share * sum(sizes.values()) * w[s] / sum(w.values()) for s in names}
    while True:
        over = {s for s in names if target[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        excess = sum(target[s] - cap * sizes[s] for s in over)
        target |= {s: cap * sizes[s] for s in over}
        free = [s for s in names if target[s] < cap * sizes[s] * (1 - 1e-12)]
        for s in free:
            target[s] += excess * w[s] / sum(w[f] for f in free)


def test_mix_keeps_targets_and_bounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 4)  # several levels
    rows = made_documents(300)
    folder = saved(spark, rows, tmp_path)
    got = mixing.query(spark, folder).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((x[0], len(words(x[1]))) for x in rows)
    sizes = defaultdict(int)
    for x in rows:
        sizes[x[3]] += len(words(x[1]))
    want = _targets(sizes)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sum(r.partial_words > 0 for r in got) <= len(sizes)  # all others are taken in whole copies
    again = mixing.query(spark, folder).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_mix_is_unbiased(spark):
    """Over many seeds a document is taken as often as its source's rate says."""
    rows = [(i, "w " * (1 + i % 7), "en", "a" if i % 2 else "b", None, *[None] * 7) for i in range(20)]
    docs, total = frame(spark, rows).cache(), Counter()
    for seed in range(12):
        for r in mixing.mix(docs, seed=seed, share=1.25, weights=(1,)).collect():
            total[r.source] += r.taken
    assert total["a"] / total["b"] == pytest.approx(1, rel=0.02)


@pytest.mark.parametrize("buckets", [2, 1024])
def test_targets_of_many_sources(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rng = __import__("random").Random(7)
    sizes = {f"host{i}é" if i else None: rng.choice([0, 1, 5, 5, rng.randrange(1, 10**6)]) for i in range(300)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    for share, cap in ((1.5, 2.0), (0.5, 1.0), (3.0, 2.0), (0.0, 2.0)):
        got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(rows, (3, 1, 2), share, cap).collect()}
        want = _targets(sizes, share=min(share, cap), cap=cap) if share < cap else {s: cap * n for s, n in sizes.items()}
        assert got == {s: (n, pytest.approx(want[s], rel=1e-9, abs=1e-9)) for s, n in sizes.items()}


def test_a_third_of_all_rows_equal(spark, monkeypatch):
    """Equal rows are counted, not gathered, and share what their source's rate gives them."""
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 1000)
    docs = spark.range(40_000).selectExpr("if(id < 30000, 7L, id) as doc_id", "if(id < 30000, 'a b c', 'x y') as text", "if(id % 2 = 0 or id < 30000, 'a', 'b') as source", "if(id < 10, null, 'en') as lang")
    got = mixing.mix(docs).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most"), F.max("target").alias("target")).collect()
    same = next(r for r in got if r.doc_id == 7)
    assert same.n == 30_000 and same.most <= 6 and len(got) == 10_001
    for source in "ab":
        assert abs(sum(r.taken for r in got if r.source == source) - next(r.target for r in got if r.source == source)) <= 1
    rate = same.target / (90_000 + 10_000)
    assert same.taken == pytest.approx(90_000 * rate, abs=3)
    mixed = mixing.mixed_documents(docs)
    assert mixed.filter("doc_id = 7").count() == pytest.approx(30_000 * rate, abs=2)


def test_mixed_documents_repeats_whole_rows(spark):
    rows = made_documents(100, long=False)
    docs = frame(spark, rows).withColumn("_mix_key", F.lit(1))
    got = Counter(map(tuple, mixing.mixed_documents(docs).collect()))
    given = Counter((*r, 1) for r in rows)
    assert set(got) <= set(given) and all(n <= 2 * given[r] for r, n in got.items())
    size = lambda c: sum(n * len(words(r[1])) for r, n in c.items())
    assert size(got) == pytest.approx(1.5 * size(given), rel=0.25)


# --- substrings and near duplicates ------------------------------------------------------


def _kept(rows, size):
    """Which words stay, by comparing all windows with all earlier ones."""
    first, out = {}, []
    docs = sorted(((-(2**63) if r[0] is None else r[0]), words(r[1])) for r in rows)
    for i, w in docs:
        for s in range(len(w) - size + 1):
            first.setdefault(tuple(w[s : s + size]), (i, s))
            first[tuple(w[s : s + size])] = min(first[tuple(w[s : s + size])], (i, s))
    for r in rows:
        i, w = (-(2**63) if r[0] is None else r[0]), words(r[1])
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (i, s):
                gone |= set(range(s, s + size))
        out.append((r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


@pytest.mark.parametrize("size", [3, 20])
@pytest.mark.parametrize("at_a_time", [200, 10**6])
def test_substrings(spark, monkeypatch, size, at_a_time):
    monkeypatch.setattr(substrings, "LOCAL_WINDOWS", at_a_time)
    rows = made_documents(long=size == 20)
    assert Counter(map(tuple, substrings.remove_repeats(frame(spark, rows), size).collect())) == _kept(rows, size)


def test_substrings_of_periodic_texts(spark):
    rows = [(i, t, *[None] * 10) for i, t in enumerate(["a " * 21, "b a " * 30, "a b c " * 25 + "d " * 40, "x " * 19, "a " * 20])]
    assert Counter(map(tuple, substrings.remove_repeats(frame(spark, rows)).collect())) == _kept(rows, 20)


def _lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def _components(rows, k, percent):
    sets = []
    for r in rows:
        w = words(_lower(r[1]))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60)])
def test_components_of_near_copies(spark, k, percent):
    """A chain of ever more edited copies, in groups around the threshold, beside the usual cases."""
    rows = made_documents(60, seed=3)
    base = [f"w{i}" for i in range(90)]
    for c in range(60):
        w = list(base)
        for j in range(c % 9):
            w[(c * 7 + j * 13) % 90] = f"e{c}x{j}"
        rows.append((1000 + c, " ".join(w[: 90 - c % 4]), *[None] * 10))
    sets, root = _components(rows, k, percent)
    ids = defaultdict(list)
    for r, c in zip(rows, root):
        ids[c].append(r[0])
    smallest = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    want = Counter((r[0], len(s), (smallest[c] if s else r[0])) for r, s, c in zip(rows, sets, root))
    got = jaccard.similar_components(frame(spark, rows), k, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_one_of_each_component(spark):
    rows = made_documents(60, seed=4)
    sets, root = _components(rows, 5, 80)
    kept = jaccard.one_of_each(frame(spark, rows)).collect()
    assert {tuple(r) for r in kept} <= set(rows)
    with_words = [tuple(r) for r in kept if words(r.text)]
    chosen = Counter(root[rows.index(r)] for r in with_words)
    assert set(chosen) == {c for s, c in zip(sets, root) if s} and set(chosen.values()) == {1}
    assert Counter(tuple(r) for r in kept if not words(r.text)) == Counter(r for r in rows if not words(r[1]))


# --- packing -----------------------------------------------------------------------------


def _pack_plainly(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return len(left)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, capacity):
    from tokenizers import Tokenizer

    rows = made_documents(long=False) + [(900, "long " * 3000 + "日本 <|endoftext|> \x85 x", *[None] * 10)]
    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    got = packing.pack(frame(spark, rows), path, capacity, with_ids=True).collect()
    want = Counter()
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or min(capacity, len(ids))
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == _pack_plainly([r.length for r in got], capacity)


def test_ids_by_word_equal_those_of_whole_texts(monkeypatch):
    enc, rng = packing.Encoder(packing.tokenizer_path()), __import__("random").Random(3)
    assert enc.by_word
    texts = [r[1] or "" for r in made_documents()] + ["don't  we'LL\n\n  x 123  ", "a" * 3000, " \t", "café naïve ÀÉ", "\x00\x7f", "　x", " a", "a ", "a <|endoftext|> b", "it 's a b\x85 c\u2028 d \xa0 e \x1c f"]
    alphabet = ["a", "b", "'s", " ", " ", " ", "\n", "\t", "\xa0", "\x85", "\x1c", "\u2003", "1", "22", ".", "é", "中", "\u0301", "\U0001f600", "'ll", "<|", "\u200b", "\ufeff", "\x0b", "x y", "\n"]
    import pandas as pd

    texts += pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.dropna().tolist()
    alphabet += [chr(c) for c in range(0xA1, 0x24F, 3)] + [",", "?", "a.", "é!", "中.", "1,"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    for most in (10, 200_000):
        monkeypatch.setattr(packing, "REMEMBERED", most)
        for t in texts[-500:] if most == 10 else texts:
            assert enc.ids(t).tolist() == enc.whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("text", [" " * 2_000_000, "\t" * 2_000_000, "x" * 100_000, " a" * 500_000, "1 " * 300_000], ids=lambda t: repr(t[:3]))
def test_ids_of_hostile_texts(text):
    import time

    enc, began = packing.encoder(packing.tokenizer_path()), time.process_time()
    ids = enc.ids(text)
    assert time.process_time() - began < 30 and enc.whole.decode(ids.tolist(), skip_special_tokens=False) == text


# --- personal data -------------------------------------------------------------------------

PII_TEXTS = [
    "a@b.c", "x.y%z+1@d-e.fg.h.", "@a.b", "a@b", "a@b.c@d.e", "..@x.y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255", "01.002.3.4", "99999.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "1 2", "+1 (743) 555-3824", "+12345678", "+1234567890123456", "+1 ( ) 2345678.", "++1 234 567 890",
    "call (743) 555-3824 or 743-555-3824.", "me (at) home.org", "on 2024-01-02 v1.2.3 at 10:30, 12.50", "", None, "1 " * 5000, "9" * 3000, "é@ü.com", "1.1.1.1 4080166431094600",
]


def _base_plainly(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_personal_data(spark, tmp_path):
    rows = [(9000 + i, t, *[None] * 10) for i, t in enumerate(PII_TEXTS)] + made_documents(60)
    got = pii.query(spark, saved(spark, rows, tmp_path)).collect()
    want = Counter()
    for r in rows:
        spans = _base_plainly(r[1] or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want[r[0], *(sum(k == j for _, k, _ in spans) for j in range(4)), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    by_id = {r.doc_id - 9000: r.spans for r in got if r.doc_id is not None and r.doc_id >= 9000}
    texts = {i: t for i, t in enumerate(PII_TEXTS)}
    added = {i: by_id[i] for i in (19, 20, 21) if by_id.get(i)}
    assert added.get(19) == "phone:5:19,phone:23:35" and added.get(20) == f"email:0:{len(texts[20])}" and 21 not in added


def test_crf_on_sentences_it_has_not_seen():
    model = pii.SemiMarkov()
    model.w = pii.fitted()
    hit = found = true = 0
    for text, spans in pii.examples(150, seed=77):
        got = {(s, e, k) for tokens in pii.stretches(text) for s, k, e in model.best(text, tokens)}
        hit, found, true = hit + len(got & set(spans)), found + len(got), true + len(spans)
    assert hit / true > 0.9 and hit / found > 0.9


def test_best_segmentation_is_the_best_of_all():
    """Dynamic programming against every segmentation of a short stretch."""
    model = pii.SemiMarkov()
    model.w = pii.fitted()
    for text in ("ka +1 23 45", "a@b.co 1.2", "12 34-5 x"):
        tokens = pii.stretches(text)[0]
        segments = model.segments(text, tokens)

        def every(j, y, segments=segments):
            if j == 0:
                if y == 0:
                    yield 0.0, ()
                return
            for i, label, s, _ in segments[j]:
                if label == y:
                    for p in range(5):
                        for v, path in every(i, p):
                            yield v + s + model.w.get((p, y), 0.0), (*path, (i, j, y))

        best = max(x for y in range(5) for x in every(len(tokens), y))
        spans = [(tokens[i][0], y - 1, tokens[j - 1][1]) for i, j, y in best[1] if y]
        assert model.best(text, tokens, lead=0.0) == spans


def test_a_trigger_within_reach_moves_the_end():
    """A spelled-out address right after a word with a digit is read whole."""
    model = pii.Decoder(pii.fitted())
    for text in ("12 jane (at) example.org", "see 12 jane [at] example.org today"):
        a, b = text.index("jane"), text.index("org") + 3
        assert max(t for s in pii.stretches(text) for _, t in s) >= b
        assert [s for s in pii.spans_of(text, model) if s[1] == 0] == [(a, 0, b, False)]
        assert pii.masked(text, pii.spans_of(text, model)) == text.replace(text[a:b], "<email>")


def _plain_best(text, tokens, weights, lead):
    """Viterbi over all candidate segments with whole tables of scores and paths."""
    model = pii.SemiMarkov()
    model.w = weights
    step = lambda p, y: weights.get((p, y), 0.0)
    best = [{0: (0.0, None)}]
    for j, segments in enumerate(model.segments(text, tokens)):
        if j:
            now = {}
            for i, y, s, _ in segments:
                v, p = max((best[i][p][0] + step(p, y), -p) for p in best[i])
                v += s - (lead if y else 0.0)
                if y not in now or v > now[y][0]:
                    now[y] = v, (i, -p)
            best.append(now)
    out, j = [], len(tokens)
    y = max(best[j], key=lambda y: best[j][y][0])
    while j:
        i, p = best[j][y][1]
        out += [(tokens[i][0], y - 1, tokens[j - 1][1])] * (y > 0)
        j, y = i, p
    return out[::-1]


@pytest.mark.parametrize("settle", [17, 64, 4096])
def test_settled_paths_are_the_best_of_all(monkeypatch, settle):
    """Paths are settled now and then; the result is that of whole tables."""
    monkeypatch.setattr(pii, "SETTLE", settle)
    weights, rng = pii.fitted(), __import__("random").Random(5)
    decoder = pii.Decoder(weights)
    texts = [" ".join(t for t, _ in pii.examples(40, seed=seed)) for seed in (3, 4)]
    texts += [" ".join(str(rng.randrange(10 ** rng.randrange(1, 8))) for _ in range(400)), "12 " * 500, "1.2.3.4, " * 100, "(743) 555-3824 " * 60]
    for text in texts:
        for tokens in pii.stretches(text):
            assert list(decoder.spans(text, tokens)) == _plain_best(text, tokens, weights, pii.LEAD)


@pytest.mark.parametrize("text", ["12 " * 100_000, " " * 2_000_000 + "5", "\t" * 2_000_000, "7" * 1_000_000, "@ab" * 100_000, "1." * 300_000, "a." * 400_000 + "@" + "b." * 100_000], ids=lambda t: repr(t[:4]))
def test_personal_data_of_hostile_texts_takes_bounded_memory(text):
    import time
    import tracemalloc

    decoder = pii.Decoder(pii.fitted())
    began = time.process_time()
    spans = pii.spans_of(text, decoder)
    assert time.process_time() - began < 30
    tracemalloc.start()
    assert pii.spans_of(text[:30_000], decoder) is not None
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
    small = text[:2000]
    assert [s[:3] for s in pii.spans_of(small, decoder) if s[3]] == _base_plainly(small)
    assert len(spans) == {"1.": 300_000 // 4, "a.": 1}.get(text[:2], 0)


def test_crf_alone_finds_the_planted_spans_of_the_test_tables():
    """Recall on data that the examples did not make: what the patterns find in the documents, found by the model alone."""
    import pandas as pd

    decoder, hit, found, true = pii.Decoder(pii.fitted()), Counter(), Counter(), Counter()
    for text in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.dropna():
        base = {x for x in pii.base_spans(text)}
        own = {x for tokens in pii.stretches(text) for x in decoder.spans(text, tokens)}
        for name, spans in ((true, base), (found, own), (hit, base & own)):
            name.update(k for _, k, _ in spans)
    assert sum(true.values()) > 20
    assert all(hit[k] >= 0.9 * true[k] for k in range(4)) and sum(hit.values()) >= 0.9 * sum(found.values())


def test_redact(spark):
    rows = [(1, "write a@b.org or +1 (743) 555-3824!", *[None] * 10), (2, None, *[None] * 10), (3, "", *[None] * 10)]
    got = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert got == {1: "write <email> or <phone>!", 2: None, 3: ""}


# --- language ------------------------------------------------------------------------------


def test_language_learns_every_language(spark):
    """More than 200 languages, one of them with too many texts to learn from all."""
    rows = [(i, f"{chr(97 + i % 230 // 15)}{chr(97 + i % 15)} " * 9, f"l{i % 230:03d}", *[None] * 9) for i in range(460)]
    rows += [(1000 + i, "zz yy " * 5, "many", *[None] * 9) for i in range(300)]
    got = {r.lang: r.n for r in language.sample(frame(spark, rows), F.lit(True), 5).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {**{f"l{i:03d}": 2 for i in range(230)}, "many": 5}
    model = language.fit(language.sample(frame(spark, rows), F.lit(True), 5))
    assert model.langs == sorted(got)


def test_language_learns_clusters_and_rejects(spark):
    rng = np.random.default_rng(0)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(40))
    rows = [(i, make("abcde") if i % 2 else make("vwxyz"), "aa" if i % 2 else "vv", None, None, *[None] * 7) for i in range(80)]
    rows += [(100, None, "aa", *[None] * 9), (101, " 12 !?", "vv", *[None] * 9), (102, make("mnopq"), None, *[None] * 9), (103, make("abcde") * 500, None, *[None] * 9), rows[0]]
    docs = frame(spark, rows)
    model = language.fit(language.sample(docs, F.col("doc_id") < 60, per_language=20))
    assert model.langs == ["aa", "vv"] and len(model.vectors) <= 6
    got = defaultdict(list)
    for r in language.identify(docs, model).collect():
        got[r.doc_id].append(r)
    assert all(x.nearest_lang == ("aa" if i % 2 else "vv") and 0.3 < x.score <= 1 for i in range(80) for x in got[i]) and len(got[0]) == 2
    assert all(x.lang == ("und" if x.rejected else x.nearest_lang) for v in got.values() for x in v)
    assert sum(x.rejected for i in range(80) for x in got[i]) < 20
    assert [(got[i][0].lang, got[i][0].nearest_lang, got[i][0].score) for i in (100, 101)] == [("und", "und", 0.0)] * 2
    assert got[102][0].rejected and got[102][0].lang == "und" and got[102][0].nearest_lang in model.langs
    assert got[103][0].nearest_lang == "aa"


def _plain_counts(text):
    """N-grams of the bytes of a text, letters in lower case and all else a space, by bucket."""
    b = [c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()]
    out = Counter()
    for n in language.ORDERS:
        for i in range(len(b) - n + 1):
            h = sum(c << 8 * (n - 1 - k) for k, c in enumerate(b[i : i + n]))
            h = ((h ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
            h ^= h >> 15
            out[((h * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - language.BUCKET_BITS)] += 1
    return out


def test_language_is_that_of_plain_tf_idf_and_centroids(spark):
    """Counts, weights, centroids, cosines, distances and predictions by plain Python over a small sample."""
    rng = np.random.default_rng(5)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 3)) for _ in range(12))
    rows = [(i, make("abcdé") if i % 2 else make("vwxyz") + " 12!", "aa" if i % 2 else "vv", *[None] * 9) for i in range(24)]
    docs = frame(spark, rows)
    model = language.fit(docs.filter("doc_id < 16").select("lang", "text"))
    learned = [(r[2], _plain_counts(r[1])) for r in rows if r[0] < 16]
    seen = Counter(g for _, c in learned for g in c)
    idf = {g: math.log((1 + len(learned)) / (1 + n)) + 1 for g, n in seen.items()}
    nothing = math.log(1 + len(learned)) + 1

    def unit(counts):
        v = {g: math.log1p(n) * idf.get(g, nothing) for g, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    cosine = lambda v, c: sum(x * float(c[g]) for g, x in v.items())
    members = defaultdict(list)
    for lang, counts in learned:
        v = unit(counts)
        own = [j for j in range(len(model.vectors)) if model.langs[model.lang_of[j]] == lang]
        members[max(own, key=lambda j: cosine(v, model.vectors[j]))].append(v)
    assert set(members) == set(range(len(model.vectors)))
    for j, vs in members.items():
        mean = defaultdict(float)
        for v in vs:
            for g, x in v.items():
                mean[g] += x
        size = math.sqrt(sum(x * x for x in mean.values()))
        assert all(float(model.vectors[j][g]) == pytest.approx(x / size, abs=1e-4) for g, x in mean.items())
        far = 1.0
        if len(vs) > 1:
            far = 0.0
            for v in vs:
                rest = {g: x - v.get(g, 0.0) for g, x in mean.items()}
                far = max(far, 1 - sum(x * rest[g] for g, x in v.items()) / math.sqrt(sum(x * x for x in rest.values())))
        assert float(model.far[j]) == pytest.approx(min(1.0, language.SLACK * far), abs=1e-4)
    for r in language.identify(docs, model).collect():
        v = unit(_plain_counts(rows[r.doc_id][1]))
        scores = [cosine(v, c) for c in model.vectors]
        j = int(np.argmax(scores))
        assert r.score == pytest.approx(scores[j], abs=1e-4) and r.nearest_lang == model.langs[model.lang_of[j]]
        if abs(1 - scores[j] - model.far[j]) > 1e-4:
            assert r.rejected == (1 - scores[j] > model.far[j])


def test_language_without_anything_to_learn(spark):
    docs = frame(spark, made_documents(20))
    model = language.fit(language.sample(docs, F.lit(False)))
    assert {(r.lang, r.score) for r in language.identify(docs, model).collect()} == {("und", 0.0)}


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = language.query(spark, folder).join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


# --- toxicity ------------------------------------------------------------------------------


def test_toxicity_on_rows_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.fit(toxicity.labelled(docs, labels.filter(~held)))
    rows = toxicity.score(docs.join(labels.filter(held).select("doc_id"), "doc_id"), model).join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    hit = sum(r.toxic and r.truth == 1 for r in rows)
    assert hit / sum(r.truth == 1 for r in rows) > 0.9 and hit / sum(r.toxic for r in rows) > 0.9
    assert (np.diff(model.thresholds) >= 0).all() and (model.weights >= 0).all()


def test_toxicity_of_grades_and_edges(spark):
    rng = np.random.default_rng(1)
    plain = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30))
    rows = [(i, plain() + " grum" * (i % 3) + (" vilest vilest" if i % 3 == 2 else ""), *[None] * 10) for i in range(150)]
    rows += [(200, None, *[None] * 10), (201, " \n", *[None] * 10), (202, plain() * 3000 + " grum vilest", *[None] * 10), rows[2]]
    docs = frame(spark, rows).withColumn("toxic", F.lit("clash")).withColumn("severity", F.lit(1))
    labels = spark.createDataFrame([(i, i % 3) for i in range(120)] + [(None, 1), (5, None), (999, 2)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(docs, labels))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].grade == i % 3 and abs(got[i].severity - i % 3) < 0.6 for i in range(150))
    assert not got[200].toxic and not got[201].toxic and got[202].toxic
    assert got[202].grade >= 1
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([i for i in range(0, 150, 3)] + [200, 201])
    nothing = toxicity.fit(toxicity.labelled(docs, labels.filter("toxic = 0")))
    assert {r.toxic for r in toxicity.score(docs, nothing).collect()} == {False}


def _loss(w, theta, texts, y, weight):
    """Penalised negative log-likelihood of a cumulative-link model, one text at a time; a text is {feature: value}."""
    logistic = lambda v: 1 / (1 + math.exp(-v))
    total = sum(toxicity.L1 * v + toxicity.L2 / 2 * v * v for v in w)
    for text, grade, share in zip(texts, y, weight):
        z = sum(w[f] * v for f, v in text.items())
        below = logistic(theta[grade - 1] - z) if grade else 0.0
        upto = logistic(theta[grade] - z) if grade < len(theta) else 1.0
        total -= share * math.log(upto - below)
    return total


def test_gradient_is_that_of_the_likelihood():
    """Slopes against differences of a plainly computed likelihood, and the fit against steps away from it."""
    rng = np.random.default_rng(2)
    row, col = np.repeat(np.arange(60), 2), rng.integers(0, 5, 120)
    x = 1 + rng.random(120)
    y = np.minimum(np.bincount(row, weights=col >= 3, minlength=60).astype(int), 2)
    texts = [defaultdict(float) for _ in range(60)]
    for r, c, v in zip(row, col, x):
        texts[r][int(c)] += v
    weight = toxicity._weights_of(y)
    assert weight[y == 0].sum() == pytest.approx(0.5) and weight.sum() == pytest.approx(1)
    w, theta = rng.random(5), np.array([0.4, 1.7])
    loss, dw, dt = toxicity._gradient(w, theta, row, col, x, y, weight)
    assert loss == pytest.approx(_loss(w, theta, texts, y, weight))
    for at, slope in ((w, dw), (theta, dt)):
        for i in range(len(at)):
            near = []
            for e in (1e-6, -1e-6):
                at[i] += e
                near.append(_loss(w, theta, texts, y, weight))
                at[i] -= e
            assert slope[i] == pytest.approx((near[0] - near[1]) / 2e-6, abs=1e-5)
    model = toxicity._train(np.arange(5, dtype=np.uint64), row, col, x, y)
    assert set(model.names.tolist()) <= {3, 4} and len(model.names) == 2
    w = np.zeros(5)
    w[model.names.astype(int)] = model.weights
    best = _loss(w, model.thresholds, texts, y, weight)
    for i in range(5):
        for e in (0.3, -0.3):
            other = w.copy()
            other[i] = max(0.0, other[i] + e)
            assert _loss(other, model.thresholds, texts, y, weight) >= best - 2e-3
    assert _loss(w, model.thresholds + 0.3, texts, y, weight) > best - 2e-3 and _loss(w, model.thresholds - 0.3, texts, y, weight) > best - 2e-3


def test_severity_is_that_of_a_plain_model(spark):
    """Every document's severity, grade and verdict from the fitted weights by plain Python over its words."""
    import pyarrow as pa

    from tarnwick.llm.scan import words as scanned

    rows = made_documents(80)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit(toxicity.labelled(docs, labels))
    weight = dict(zip(model.names.tolist(), model.weights.tolist()))
    assert weight

    def names(word):
        """The word's feature and those of its beginnings, as hashes."""
        w = next(scanned(pa.array([word], pa.binary()), table=None))
        return [int(w.hashes()[0]), *(int(w.prefix_hashes(n)[0]) for n in toxicity.PREFIXES)]

    letters = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
    hashes: dict = {}
    for r in toxicity.score(docs.filter("doc_id < 120"), model).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        if r.doc_id in (5, 2, 7):  # ids of several rows
            continue
        counted = Counter()
        for word in (text or "").encode().translate(letters).split():
            counted.update(hashes.setdefault(word, names(word)))
        z = sum(weight[f] * (1 + math.log(n)) for f, n in counted.items() if f in weight)
        at_least = [1 / (1 + math.exp(min(500, max(-500, t - z)))) for t in model.thresholds]
        grades = [1 - at_least[0], *(a - b for a, b in zip(at_least, [*at_least[1:], 0.0]))]
        assert r.severity == pytest.approx(sum(at_least)) and r.p_toxic == pytest.approx(at_least[0]) and r.toxic == (r.p_toxic >= toxicity.REJECT)
        assert grades[r.grade] == pytest.approx(max(grades))


# --- quality -------------------------------------------------------------------------------


def test_ledger_of_nothing_and_of_white_space(spark):
    none = quality.ledger(frame(spark, made_documents(12, long=False)).filter("doc_id < 0"))
    assert none.count() == 0 and quality.ablation(none).collect() == []
    rows = [(i, t, *[None] * 10) for i, t in enumerate([" " * 300_000, "\t" * 300_000 + "x", "\n" * 100_000, "a" * 300_000, "# " * 2_000])]
    got = {r.doc_id: r for r in quality.ledger(frame(spark, rows, 2)).collect()}
    assert [(got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_letters, got[i].n_letter_words) for i in range(5)] == [
        (0, 0, 0, 0, 0), (1, 1, 0, 1, 1), (0, 0, 0, 0, 0), (1, 300_000, 0, 300_000, 1), (2_000, 2_000, 2_000, 0, 0)]


def test_ledger_policies_and_ablation(spark):
    rows = quality.ledger(frame(spark, made_documents())).cache()
    found = rows.collect()
    for policy in quality.POLICIES:
        hard, soft = quality.mask(policy.hard), quality.mask(policy.soft)
        kept = lambda bits: bits & hard == 0 and (bits & soft).bit_count() <= policy.stands  # noqa: B023, E731
        assert Counter(r.kept for r in quality.apply_policy(rows, policy).collect()) == Counter(kept(r.failed_bits) for r in found)
        want = {}
        for rule in quality.RULES:
            if rule.name in policy.hard + policy.soft:
                bit = 1 << rule.bit
                failed = [r.failed_bits for r in found if r.failed_bits & bit]
                want[rule.name] = (len(failed), sum(not kept(b) and kept(b & ~bit) for b in failed))
        got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(rows, (policy,)).collect()}
        assert got == want
