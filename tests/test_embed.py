import hashlib
import re

import numpy as np

from tarnwick.operators import embed


def test_words_are_hashed_as_before_and_remembered_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(embed, "WORDS", 50)
    texts = ["", None, "İstanbul ẞ K Ünder a_b c d\x1ce １", "a\x00b A\tB", *[f"w{i} w{i + 1} x" for i in range(400)]]
    e = embed.HashingEmbedder(16)
    got = e.encode(texts)
    for row, text in zip(got, texts):
        tokens = [t for t in re.split("[^a-z0-9]+", (text or "").lower()) if t]
        want = np.bincount([int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 16 for t in tokens] or [0], minlength=16) * bool(tokens)
        assert row.tolist() == want.tolist()
    assert len(e._buckets) <= 50 + 3


def test_one_text_and_long_words_stay_within_the_bound_too(monkeypatch):
    monkeypatch.setattr(embed, "WORDS", 50)
    e = embed.HashingEmbedder(16)
    text = " ".join([*[f"w{i}" for i in range(400)], "x" * 1000, "y" * 33, "w1"])
    want = np.bincount([int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 16 for t in text.split()], minlength=16)
    assert e.encode([text])[0].tolist() == want.tolist()
    assert 0 < len(e._buckets) <= 50 and max(map(len, e._buckets)) <= 32
