"""Personal data: fixed base patterns, and a semi-Markov CRF that adds spans.

``base_spans`` finds the four kinds by pattern, leftmost without overlap per kind.
The CRF reads the stretches of a text around digits and at-signs. Their tokens are
cut into segments: single outside tokens, or spans of one kind of up to
``MOST_TOKENS`` tokens. A segment is scored by features of the whole span (its shape
with digit runs counted, checks such as Luhn's, its neighbours) and of the labels
that follow each other; dynamic programming over bounded segments finds the best
boundaries and kinds together. Weights are fitted by conditional likelihood on
sentences that ``examples`` makes from a seed, in formats the base patterns know and
others (numbers without a plus, spelled-out at-signs), beside numbers that are none.
A CRF span that overlaps a base span, of any kind, is dropped; base spans stay.

Defined results: a null text counts as empty and has no spans; a text of any length
is read whole, in time linear in it and with some bytes a token beside it (see
``Decoder``); repeated rows give equal results; extra columns
are not read by ``find`` and are kept by ``redact``, which leaves null texts null; an
empty table gives an empty result. Places are code points, the end exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import random
import re
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, text_batches

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 14
#: Tokens on either side of a digit or at-sign that belong to its stretch.
CONTEXT = 2
#: Made sentences, passes over them, step and decay of fitting; the lead a span needs over staying outside.
EXAMPLES, PASSES, STEP, DECAY, LEAD = 360, 5, 0.4, 1e-4, 1.0
SEED = 11

# Possessive, as no match needs to give back: long runs take no memory to retry.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind saves retries inside a run of digits, which can match no better.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """A match starts at the first character of the run before an at-sign that no match has used."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in that order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_TOKEN = re.compile(r"[^\W_]+|[^\w\x20\x09-\x0D]|_")
_TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")
_SPACES = " \t\n\r\x0b\x0c"
_WORD_END, _SPACE_END = re.compile(r"[^\x20\x09-\x0D]*+"), re.compile(r"[\x20\x09-\x0D]*+")


def reaches(text: str) -> list[list[int]]:
    """First and last place of each stretch around triggers; neighbours within reach share one."""
    out: list = []
    word = reach = 0
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if at < word:  # in the word of the trigger before, which reaches as far
            continue
        end = at
        for k in range(CONTEXT + 1):  # to the end of this word and some after it
            end = _WORD_END.match(text, end).end()
            if k == 0:
                word = end
            end = _SPACE_END.match(text, end).end()
        if out and at < reach:
            out[-1][1] = reach = end
            continue
        start = at
        for _ in range(CONTEXT + 1):
            while start > 0 and text[start - 1] in _SPACES:
                start -= 1
            while start > 0 and text[start - 1] not in _SPACES:
                start -= 1
        if out and start <= reach:
            out[-1][1] = end
        else:
            out.append([start, end])
        reach = end
    return out


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Tokens (start, end) of each stretch."""
    return [[t.span() for t in _TOKEN.finditer(text, a, b)] for a, b in reaches(text)]


def _shape(span: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 9)}", span)
    return re.sub(r"[^\W\d_]{3,}", "w", re.sub(r"\s+", " ", s))[:24]


def is_quad(span: str) -> bool:
    return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", span) is not None and all(int(p) < 256 for p in span.split("."))


def span_features(text: str, start: int, end: int, n_tokens: int) -> list[str]:
    """Features of a whole candidate span and of what stands beside it."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    n, letters = len(digits), any(c.isalpha() for c in span)
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    beside = lambda c: "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c
    marks = "".join(sorted(set(re.sub(r"[\w\s]", "", span))))
    kind_of = "at" if "@" in span else "words" if letters else "digits"
    out = ["bias", f"n{min(n, 20)}", f"tok{n_tokens}", f"marks{marks[:6]}", f"what{kind_of}", f"b{beside(before)}", f"a{beside(after)}", f"shape{_shape(span)}", f"first{beside(span[0])}", f"last{beside(span[-1])}"]
    if not letters:
        if 12 <= n <= 19:
            out.append("luhn" if luhn(digits) else "noluhn")
        if 9 <= n <= 15:
            out.append("phonelength" + span[0].replace(" ", "s") if not span[0].isdigit() else "phonelength")
        if is_quad(span):
            out.append("quad")
        groups = [len(g) for g in re.findall(r"[0-9]+", span)]
        if len(groups) > 1 and all(g == 4 for g in groups[:-1]):
            out.append("fours")
        if groups[-2:] == [3, 4]:
            out.append("threefour")
    if re.fullmatch(r"[\w.%+-]+\s?(@|\(at\)|\[at\])\s?[\w-]+((\.|\s?\(dot\)\s?|\s?\[dot\]\s?)[\w-]+)+", span):
        out.append("address")
    return out


#: Characters a span may begin and end with.
def _may_begin(c: str) -> bool:
    return c.isalnum() or c in "+("


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Token ranges that may be one span, with their places: bounded in tokens, with a digit or an at-sign."""
    out = []
    n = len(tokens)
    digit = [bool(_DIGIT.search(text, a, b)) for a, b in tokens]
    at = [text[a] == "@" or text[a:b] == "at" for a, b in tokens]
    for i in range(n):
        if not _may_begin(text[tokens[i][0]]):
            continue
        has = marks = False
        for j in range(i, min(n, i + MOST_TOKENS)):
            if j > i and (tokens[j][0] - tokens[j - 1][1] > 1 or "\n" in text[tokens[j - 1][1] : tokens[j][0]]):
                break
            has |= digit[j]
            marks |= at[j]
            if (has or marks) and text[tokens[j][1] - 1].isalnum():
                if marks or not any(text[k].isalpha() for k in range(tokens[i][0], tokens[j][1])):
                    out.append((i, j + 1, tokens[i][0], tokens[j][1]))
    return out


def _logsum(values: list[float]) -> float:
    m = max(values)
    return m + math.log(sum(math.exp(v - m) for v in values)) if m > -math.inf else m


class SemiMarkov:
    """Weights of (feature, label) and (label, label); label 0 is outside."""

    def __init__(self):
        self.w: dict = defaultdict(float)

    def scores(self, features: list[str]) -> list[float]:
        w = self.w
        return [sum(w.get((f, y), 0.0) for f in features) for y in range(1, len(KINDS) + 1)]

    def segments(self, text, tokens, spans=None):
        """By end token: (begin, label, score, features)."""
        by_end: list = [[] for _ in range(len(tokens) + 1)]
        for j in range(len(tokens)):
            by_end[j + 1].append((j, 0, 0.0, None))
        for i, j, a, b in candidates(text, tokens):
            f = span_features(text, a, b, j - i)
            for y, s in enumerate(self.scores(f), 1):
                by_end[j].append((i, y, s, f))
        return by_end

    def best(self, text: str, tokens: list[tuple[int, int]], lead: float = LEAD) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the best segmentation's spans; a span must beat staying outside by ``lead``."""
        return list(Decoder(self.w, lead).spans(text, tokens))

    def fit_one(self, text, tokens, gold: dict, rate: float, decay: float) -> None:
        """One step up the conditional log-likelihood: true counts less expected ones."""
        n, labels = len(tokens), range(len(KINDS) + 1)
        by_end = self.segments(text, tokens)
        w = self.w
        step = [[w[p, y] for y in labels] for p in labels]
        alpha = [[-math.inf] * len(labels) for _ in range(n + 1)]
        alpha[0][0] = 0.0
        enter: dict = {}

        def into(i, y):
            if (i, y) not in enter:
                enter[i, y] = _logsum([alpha[i][p] + step[p][y] for p in labels])
            return enter[i, y]

        for j in range(1, n + 1):
            held: dict = defaultdict(list)
            for i, y, s, _ in by_end[j]:
                held[y].append(into(i, y) + s)
            for y, v in held.items():
                alpha[j][y] = _logsum(v)
        total = _logsum(alpha[n])
        begin: list = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, y, s, f in by_end[j]:
                begin[i].append((j, y, s, f))
        beta = [[-math.inf] * len(labels) for _ in range(n + 1)]
        beta[n] = [0.0] * len(labels)
        change: dict = defaultdict(float)
        for i in range(n - 1, -1, -1):
            for p in labels:
                if alpha[i][p] > -math.inf:
                    beta[i][p] = _logsum([step[p][y] + s + beta[j][y] for j, y, s, _ in begin[i]])
            for j, y, s, f in begin[i]:
                seen = math.exp(into(i, y) + s + beta[j][y] - total)
                d = (gold.get((i, j)) == y) * 1.0 - seen if y else -seen
                if f is not None and abs(d) > 1e-5:
                    for x in f:
                        change[x, y] += d
                if seen > 1e-5:
                    for p in labels:
                        if alpha[i][p] > -math.inf:
                            change[p, y] -= math.exp(alpha[i][p] + step[p][y] + s + beta[j][y] - total)
        at = before = 0
        ends = {i: (j, y) for (i, j), y in gold.items()}
        while at < n:
            at, y = ends.get(at, (at + 1, 0))
            change[before, y] += 1
            before = y
        for k, d in change.items():
            w[k] += rate * (d - decay * w[k])


#: Tokens that are decoded before what all paths agree on is settled, and scores of spans that are remembered.
SETTLE, REMEMBERED = 4096, 50_000
_ZEROS, _NOT_DIGIT = {ord(c): "0" for c in "123456789"}, re.compile(r"[^0-9]+")
#: Characters of the longest span. A span holds one at-sign at most, and one without holds 19 digits at most.
LONGEST = 400


class Decoder:
    """Viterbi over bounded segments, token by token, in memory that does not grow with the text.

    Per place it holds the best score of each label and one byte of back-pointer. Every
    ``SETTLE`` tokens the paths of all labels of the last ``MOST_TOKENS`` places are traced back
    to where they meet; what lies before is settled and given out. That is exact:
    whatever follows, the best path goes through there.

    A span's score depends on its digits only through a few checks, so scores are
    remembered by the span with its digits written as zeros. A label is no candidate where staying
    outside is better whatever stands beside it.
    """

    def __init__(self, weights: dict, lead: float = LEAD):
        self.lead, labels = lead, range(len(KINDS) + 1)
        get = weights.get
        self.step = [[get((p, y), 0.0) for y in labels] for p in labels]
        self.model = SemiMarkov()
        self.model.w = weights
        self.extra = {f: [get((f, y), 0.0) for y in labels] for f in ("luhn", "noluhn", "quad")}
        step, n = self.step, len(labels)
        # The least that a span of label y must score, beyond the lead, to be better than outside tokens somewhere.
        self.least = [
            [min(step[p][0] + (k - 1) * step[0][0] + step[0][q] - step[p][y] - step[y][q] for p in range(n) for q in range(n)) for k in range(MOST_TOKENS + 1)]
            for y in labels
        ]
        # The last span of a text has no label after it.
        self.least_last = [[min(step[p][0] + (k - 1) * step[0][0] - step[p][y] for p in range(n)) for k in range(MOST_TOKENS + 1)] for y in labels]
        self.known: dict = {}

    def _scores(self, text: str, start: int, end: int, n_tokens: int, n_digits: int, letters: bool) -> list[tuple[int, float]]:
        """(label, score less the lead) of the labels that a span can have."""
        key = (text[max(start - 1, 0) : end + 1].translate(_ZEROS), start > 0, end < len(text), n_tokens)
        found = self.known.get(key)
        if found is None:
            found = self.model.scores([x for x in span_features(text, start, end, n_tokens) if x not in self.extra])
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = found
        more = []
        if not letters and n_digits <= 19:
            if n_digits >= 12:
                more.append(self.extra["luhn" if luhn(_NOT_DIGIT.sub("", text[start:end])) else "noluhn"])
            if n_tokens == 7 and is_quad(text[start:end]):
                more.append(self.extra["quad"])
        out = []
        for y, s in enumerate(found, 1):
            s += sum(m[y] for m in more) - self.lead
            if s >= self.least[y][n_tokens] or s >= self.least_last[y][n_tokens]:
                out.append((y, s))
        return out

    def spans(self, text: str, tokens) -> Iterator[tuple[int, int, int]]:
        """(start, kind number, end) of the best segmentation's spans, from tokens in order."""
        n_labels, step = len(KINDS) + 1, self.step
        none = -math.inf
        starts, ends = array("q"), array("q")  # of the tokens not settled yet
        back = array("B", bytes(n_labels))  # (tokens << 3 | label before) of each place and label; 0: no path
        best = deque([[0.0] + [none] * (n_labels - 1)], MOST_TOKENS + 1)
        enter: deque = deque(maxlen=MOST_TOKENS)  # per begin: best score of a path that goes on with each label, and its label
        window: deque = deque(maxlen=MOST_TOKENS)  # start, end, digits, letters, sign, may begin, may end, joins the one before
        last_end = -1
        for a, b in tokens:
            own = text[a:b] if b - a <= LONGEST else ""
            digits = 0 if own.isalpha() else sum(map(own.count, "0123456789")) if own else LONGEST
            joined = last_end >= 0 and a - last_end <= 1 and (a == last_end or text[last_end] != "\n")
            sign = own == "@" or (own == "at" and a > 0 and text[a - 1] in "([")
            letters = not own or (len(own) > digits and any(map(str.isalpha, own)))
            window.append((a, b, digits, letters, sign, own == "at" or own == "@", _may_begin(text[a]), text[b - 1].isalnum(), joined))
            last_end = b
            before = best[-1]
            live = [p for p in range(n_labels) if before[p] > none]
            into = [max((before[p] + step[p][y], -p) for p in live) for y in range(n_labels)]
            enter.append(into)
            now = [into[0][0]] + [none] * (n_labels - 1)
            came = [1 << 3 | -into[0][1]] + [0] * (n_labels - 1)
            if window[-1][7]:
                n_digits, letters, signs, marks = 0, False, 0, False
                for k in range(1, len(window) + 1):
                    t = window[-k]
                    n_digits += t[2]
                    letters |= t[3]
                    signs += t[4]
                    marks |= t[5]
                    if signs > 1 or b - t[0] > LONGEST:
                        break
                    if t[6] and (marks or (0 < n_digits <= 19 and not letters)):
                        for y, s in self._scores(text, t[0], b, k, n_digits, letters):
                            v, p = enter[-k][y]
                            if v + s > now[y]:
                                now[y], came[y] = v + s, k << 3 | -p
                    if not t[8]:
                        break
            starts.append(a)
            ends.append(b)
            best.append(now)
            back.extend(came)
            if len(starts) >= SETTLE and len(starts) % SETTLE == 0:
                done = _meeting(back, n_labels, [(len(starts) - d, y) for d in range(min(len(best), len(starts))) for y in range(n_labels) if best[-1 - d][y] > none])
                if done[0] > 0:
                    yield from _traced(back, n_labels, *done, starts, ends)
                    del starts[: done[0]], ends[: done[0]], back[: done[0] * n_labels]
        n = len(starts)
        yield from _traced(back, n_labels, n, max(range(n_labels), key=lambda y: best[-1][y]), starts, ends)


def _meeting(back: array, n_labels: int, live: list[tuple[int, int]]) -> tuple[int, int]:
    """The last place and label that the paths to all of ``live`` have in common."""
    heap = [(-j, y) for j, y in set(live)]
    heapq.heapify(heap)
    seen = set(heap)
    while len(seen) > 1:
        j, y = heapq.heappop(heap)
        seen.discard((j, y))
        x = back[-j * n_labels + y]
        if not x:
            return 0, 0
        one = (j + (x >> 3), x & 7)
        if one not in seen:
            seen.add(one)
            heapq.heappush(heap, one)
    (j, y) = seen.pop()
    return -j, y


def _traced(back: array, n_labels: int, j: int, y: int, starts: array, ends: array) -> list[tuple[int, int, int]]:
    out = []
    while j > 0:
        x = back[j * n_labels + y]
        i = j - (x >> 3)
        if y:
            out.append((starts[i], y - 1, ends[j - 1]))
        j, y = i, x & 7
    return out[::-1]


def examples(n: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made sentences with their spans (start, end, kind number), all from the seed."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "sen", "du", "ra", "nol", "pe"]) for _ in range(rng.randint(1, 4)))

    def email():
        at, dot = rng.choice([("@", ".")] * 6 + [(" (at) ", "."), (" [at] ", ".")])
        return rng.choice([word, lambda: word() + "." + d(2), lambda: word() + "." + word(), lambda: word() + "_" + word()])() + at + rng.choice([word, lambda: word() + d(1)])() + dot + rng.choice(["com", "org", "net", "example.com", "example.org"])

    def ip():
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))

    def card():
        x = rng.choice("3456") + d(rng.choice([14, 14, 14, 13, 11]))
        x += next(c for c in "0123456789" if luhn(x + c))
        cut = rng.choice(["", "", " ", "-"])
        return cut.join(x[i : i + 4] for i in range(0, len(x), 4)) if cut and len(x) == 16 else x

    def phone():
        area, mid, end = d(3), d(3), d(4)
        return rng.choice([
            f"+{rng.randint(1, 99)} ({area}) {mid}-{end}", f"+1 ({area}) {mid}-{end}", f"+{rng.randint(1, 99)} {area} {mid} {end}", f"+1{area}{mid}{end}",
            f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"({area}) {mid} {end}",
        ])

    def wrong_card():
        x = d(rng.choice([13, 15, 16, 16, 18]))
        return x if not luhn(x) else x[:-1] + str((int(x[-1]) + 1) % 10)

    nothing = [
        lambda: str(rng.randint(1900, 2030)), lambda: d(rng.randint(1, 6)), lambda: f"{d(1)}.{d(2)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}",
        lambda: f"{rng.randint(10, 20)}:{rng.randint(10, 59)}", lambda: f"20{d(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}",
        lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{rng.randint(1, 20)}. ", lambda: f"{rng.randint(1, 9)}.0.", wrong_card, lambda: f"{d(3)}-{d(2)}", lambda: f"{d(4)}-{d(4)}",
        lambda: f"{rng.randint(256, 999)}.{d(3)}.{d(2)}.{d(1)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(18)), lambda: f"{word()}{d(3)}", lambda: f"${d(3)}",
        lambda: f"{d(2)} {d(3)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"@{word()}", lambda: f"{d(10)}", lambda: f"{d(8)}", lambda: f"{d(5)}-{d(4)}", lambda: f"1.2.3.4.{d(1)}",
    ]
    out = []
    for _ in range(n):
        text, spans = word() + " " + word(), []
        for _ in range(rng.randint(1, 3)):
            text += rng.choice([" ", " ", " ", ", ", ": ", " (", "\n"])
            if rng.random() < 0.55:
                k = rng.randrange(4)
                x = (email, ip, card, phone)[k]()
                spans.append((len(text), len(text) + len(x), k))
            else:
                x = rng.choice(nothing)()
            text += x + rng.choice(["", "", "", ",", ".", ")"])
            text += " " + " ".join(word() for _ in range(rng.randint(1, 3)))
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=1)
def fitted(n: int = EXAMPLES, passes: int = PASSES, seed: int = SEED) -> dict:
    """Weights fitted on made sentences; the same on every machine."""
    model, rng = SemiMarkov(), random.Random(seed)
    made = []
    for text, spans in examples(n, seed):
        for tokens in stretches(text):
            first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
            gold = {(first[a], last[b]): k + 1 for a, b, k in spans if a in first and b in last and last[b] - first[a] <= MOST_TOKENS}
            made.append((text, tokens, gold))
    for p in range(passes):
        rng.shuffle(made)
        for text, tokens, gold in made:
            model.fit_one(text, tokens, gold, STEP / (1 + p), DECAY)
    return {k: v for k, v in model.w.items() if abs(v) > 1e-4}


def spans_of(text: str, decoder: Decoder) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, by base pattern) of all spans of a text, by start, then kind."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if _TRIGGER.search(text):
        taken, merged = sorted((s, e) for s, _, e in base), []
        for s, e in taken:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        for a, b in reaches(text):
            for s, k, e in decoder.spans(text, (t.span() for t in _TOKEN.finditer(text, a, b))):
                if not _overlaps(merged, s, e):
                    out.append((s, k, e, False))
    return sorted(out)


def _overlaps(merged: list, start: int, end: int) -> bool:
    import bisect

    i = bisect.bisect_left(merged, [end])
    return i > 0 and merged[i - 1][1] > start


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


_FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of each row, by start, then kind as listed."""
    shared = docs.sparkSession.sparkContext.broadcast(weights if weights is not None else fitted())

    def run(batches):
        model = Decoder(shared.value)
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in spans_of(t, model)] if t else []
                for t in batch.column("text").to_pylist()
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _FOUND)


def masked(text: str, spans) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for s, k, e, *_ in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """``docs`` with the personal data of column text masked; all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(weights if weights is not None else fitted())
    at = docs.columns.index("text")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])

    def run(batches):
        model = Decoder(shared.value)
        for batch in batches:
            texts = [t and masked(t, spans_of(t, model)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return text_batches(docs).mapInArrow(run, schema)


def digest(kinds_starts_ends: str) -> str:
    return hashlib.sha256(kinds_starts_ends.encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the personal data of all documents."""
    found = find(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    n = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *n, F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
