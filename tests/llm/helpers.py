"""Small tables with the cases that every operator has to stand."""

import random
import re

from tests.helpers import DOCS, frame, saved  # noqa: F401  (the tests of this folder take them from here)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def made_documents(n=120, seed=1, long=True):
    """Copies, near copies, shared passages, blanks, nulls in every column, a very long text, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = sentence(60), sentence(12)
    texts = []
    for i in range(n):
        kind = i % 12
        if kind == 0 and texts:
            t = rng.choice([x for x in texts if x is not None])
        elif kind == 1 and texts:
            w = words(rng.choice([x for x in texts if x is not None]))
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 99))
            t = "  ".join(w)
        elif kind == 2:
            t = sentence(10) + "\n" + passage + "\t" + sentence(rng.randint(0, 30))
        elif kind == 3:
            t = rng.choice(["", " \n\t ", "one", "one two three", None, "a a a a " * 30, "Ünï 中文 \U0001f600 — x", "12 34 !! ??"])
        elif kind == 4:
            t = (line + "\n") * rng.randint(1, 4) + sentence(15)
        else:
            t = sentence(rng.randint(1, 80)).title() + "\x1c " + sentence(3)
        texts.append(t)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "a", None]), None, "k", i, "s", 1, None, "x", "r") for i, t in enumerate(texts)]
    if long:
        rows.append((n, sentence(30_000), "en", "b", 1, "k", 0, "s", 1, None, "x", "r"))
        rows.append((n + 1, "x" * 200_000 + " " + "7" * 5000 + " @" * 50, "en", "b", 1, "k", 0, "s", 1, None, "x", "r"))
    rows += [rows[5], rows[5], rows[2]]
    rows.append((None, texts[5], "en", "a", None, None, None, None, None, None, None, None))
    rows.append((7, "another text under a used id " * 3, None, None, None, None, None, None, None, None, None, None))
    return rows
