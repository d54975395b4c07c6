"""Token ids of whole batches of texts, with a Python step for each different word alone.

A text whose only white space is single spaces and single line breaks between other
characters is cut there by Arrow; a sign after a letter at a word's end is taken off,
as byte-level pre-tokenizers do. The words become numbers of a dictionary, each word
that is not remembered from an earlier batch is encoded once, and the ids of all texts
are one gather from those of the words. Other texts, and very long ones, which would
make long arrays, go to ``packing.Encoder`` one by one.

Defined results: a null text has no ids, as an empty one.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that is not a single space or line break between other characters.
_OTHER_SPACE = (
    r"^[ \n]|[ \n]$|[ \n][ \n]|"
    r"[\t\x{0b}\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_SIGNED = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}][,.;:!?]$"
#: Bytes of a text from which on it is encoded by itself; words that a worker remembers.
LONG_TEXT, REMEMBERED = 1 << 20, 500_000


class BatchEncoder:
    """Ids of batches by an ``Encoder``; remembers the ids of words in one growing array."""

    def __init__(self, enc):
        self.enc = enc
        self.signs = np.zeros(128, dtype="<u4")
        for c, ids in enc.signs.items():
            self.signs[ord(c)] = struct.unpack("<I", ids)[0]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.store, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.begin, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode words that are new; a word after a line break has the break in front."""
        enc, of_model, letters = self.enc, self.enc.model.tokenize, self.enc.letters
        parts, opening, following = [], enc.first.mark, enc.rest.mark
        for w in words:
            after_break = w[:1] == "\n"
            own = w[1:] if after_break else w
            if own.isalpha() and (own.isascii() or max(own) < "ɐ"):
                if not own.isascii():
                    own = own.encode().decode("latin-1").translate(letters)
                ids = [t.id for t in of_model((opening if after_break else following) + own)]
            else:
                ids = enc.whole.encode(own if after_break else " " + own, add_special_tokens=False).ids
            parts.append(enc.break_ids + ids if after_break else ids)
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        n, at, total = len(parts), len(self.slots), int(size.sum())
        while at + n > len(self.begin):
            self.begin, self.size = (np.append(x, np.zeros_like(x)) for x in (self.begin, self.size))
        while self.used + total + 1 > len(self.store):  # one place is left for a sign
            self.store = np.append(self.store, np.zeros_like(self.store))
        self.size[at : at + n] = size
        self.begin[at : at + n] = self.used + np.cumsum(size) - size
        self.store[self.used : self.used + total] = [i for ids in parts for i in ids]
        self.used += total
        self.slots.update(zip(words, range(at, at + n)))

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by text, where all white space is single."""
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        # A word after a line break keeps the break in front; so does each text's first word, for now.
        one = lambda x: pa.scalar(x, pa.large_string())
        marked = pc.binary_join_element_wise(one("\n"), pc.replace_substring(texts, "\n", " \n"), one(""))
        words = pc.split_pattern(marked, " ")
        first, code = words.offsets.to_numpy()[:-1], words.flatten().dictionary_encode()
        at, different = code.indices.to_numpy(), code.dictionary
        signed = pc.match_substring_regex(different, _SIGNED).to_numpy(zero_copy_only=False)
        sign = np.zeros(len(different), dtype="<u4")
        ends = different.filter(pa.array(signed))
        sign[signed] = self.signs[np.array([ord(c) for c in pc.utf8_slice_codeunits(ends, -1).to_pylist()], dtype=np.int64)]
        stems = pc.if_else(pa.array(signed), pc.utf8_slice_codeunits(different, 0, -1), different).dictionary_encode()
        names = stems.dictionary.to_pylist()
        slots = list(map(self.slots.get, names))
        if None in slots:
            if len(self.slots) > REMEMBERED:
                self._forget()
                slots = [None] * len(names)
            self._learn([w for w, s in zip(names, slots) if s is None])
            slots = list(map(self.slots.get, names))
        slot = np.array(slots, dtype=np.int64)[stems.indices.to_numpy()]
        n, start = (self.size[slot] + signed)[at], self.begin[slot][at]
        skip = len(self.enc.break_ids)
        n[first] -= skip
        start[first] += skip
        before = np.cumsum(n) - n
        ids = self.store[np.repeat(start - before, n) + np.arange(int(n.sum()))]
        with_sign = signed[at]
        ids[(before + n - 1)[with_sign]] = sign[at[with_sign]]
        return ids, np.add.reduceat(n, first)

    def ids(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each begins and the last ends); ``end`` is added to each text."""
        enc, n = self.enc, len(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(texts)
        own = pc.or_(pc.match_substring_regex(texts, _OTHER_SPACE), pc.or_(pc.greater(size, LONG_TEXT), pc.equal(size, 0)))
        for added in enc.added:
            own = pc.or_(own, pc.match_substring(texts, added))
        own = own.to_numpy(zero_copy_only=False) if enc.by_word else np.ones(n, dtype=bool)
        ids, counts = self._regular(texts.filter(pa.array(~own)) if own.any() else texts)
        if own.any():
            at = np.append(0, np.cumsum(counts))
            place = np.cumsum(~own) - 1
            parts = [enc.ids(texts[i].as_py()) if alone else ids[at[place[i]] : at[place[i] + 1]] for i, alone in enumerate(own.tolist())]
            counts, ids = np.fromiter(map(len, parts), dtype=np.int64, count=n), np.concatenate(parts)
        bounds = np.append(0, np.cumsum(counts)).astype(np.int64)
        if end is None:
            return ids.astype("<u4", copy=False), bounds
        bounds = bounds + np.arange(n + 1)
        out, mine = np.full(len(ids) + n, end, dtype="<u4"), np.ones(len(ids) + n, dtype=bool)
        mine[bounds[1:] - 1] = False
        out[mine] = ids
        return out, bounds
