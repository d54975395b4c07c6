"""Best-fit-decreasing packing of tokenised documents into sequences.

Pieces of equal length are interchangeable, so the whole plan follows from the
number of pieces of each length, at most ``capacity`` numbers however many documents
there are. The plan walks lengths downwards; a segment tree over remaining
capacities finds the tightest open bin in logarithmic time. What one piece would do,
and the next of its length after it, is done for all bins of that capacity at once:
each takes as many as it can hold. The result is that of placing every piece by
itself. Pieces then find their place in the plan by their rank within their length.

Ranks come from 256 salts per length: a row number within (length, salt) and the
counts of all (length, salt) pairs, a table of fixed size. So a length that a third
of all pieces share, or a third of equal rows, is ranked by 256 tasks, and no documents reach the driver.

Defined results: a null text counts as empty, which is the end token alone; repeated
rows are packed apart; an empty table packs into nothing; extra columns are not
read, so names cannot clash. A text of any length is tokenised whole.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import stored

from .common import documents, text_batches
from .tokens import BatchEncoder

SALTS = 256
CAPACITY = 2048
END = 0
#: A single space between characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words whose ids an encoder remembers, and the longest of them.
REMEMBERED, LONGEST_WORD = 600_000, 48
_SIGNS, _FOUR = frozenset(",.;:!?"), struct.Struct("<I").pack


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words:
    """Ids of words with ``before`` in front: those met lately, and those before them."""

    def __init__(self, before: str):
        self.before, self.mark, self.new, self.old = before, before.translate(byte_letters()), {}, {}


class Encoder:
    """Token ids by a tokenizer file and its own library, without added special tokens.

    A byte-level pre-tokenizer always cuts before a single space, and before and after
    a single line break, that stand between two other characters; what follows is cut
    as if it stood alone. So lines whose words have single spaces between them are
    taken word by word, and the library encodes each different word once: words
    repeat. What has other white space is encoded in parts from one
    such place to the next, texts with one of the file's added tokens, and all texts
    by files of other kinds, in one.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.by_word = byte_level and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("normalizer")
        self.model, self.letters = self.whole.model, byte_letters()
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.first, self.rest = _Words(""), _Words(" ")
        self.line_break, self.signs = self._encoded("\n"), {c: self._encoded(c) for c in _SIGNS}
        self.break_ids = self.whole.encode("\n", add_special_tokens=False).ids

    def _encoded(self, text: str) -> bytes:
        return struct.pack(f"<{len(ids := self.whole.encode(text, add_special_tokens=False).ids)}I", *ids)

    def _word(self, known: _Words, word: str) -> bytes:
        """Ids of a word that is not among the latest: a sign at the end stands alone after a letter; letters alone are one piece, which goes to the model."""
        last = word[-1:]
        if last in _SIGNS and len(word) > 1 and "A" <= word[-2] < "\u0250" and word[-2].isalpha():
            stem = word[:-1]
            return (known.new.get(stem) or self._word(known, stem)) + self.signs[last]
        ids = known.old.get(word)
        if ids is None:
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = b"".join([_FOUR(t.id) for t in self.model.tokenize(known.mark + letters)])
            else:
                ids = self._encoded(known.before + word)
        if len(word) <= LONGEST_WORD:
            if len(known.new) >= REMEMBERED // 2:
                known.new, known.old = {}, known.new
            known.new[word] = ids
        return ids

    def _of(self, known: _Words, words: list[str]) -> list[bytes]:
        """The ids of each word, with what stands before it in front."""
        found, i = list(map(known.new.get, words)), -1
        for _ in range(found.count(None)):
            i = found.index(None, i + 1)
            found[i] = self._word(known, words[i])
        return found

    def ids(self, text: str) -> np.ndarray:
        if not self.by_word or any(a in text for a in self.added):
            return np.frombuffer(self._encoded(text), dtype="<u4")
        out = []
        for line in text.split("\n"):
            words = line.split()
            if not words or " ".join(words) != line:
                break
            out += self._of(self.first, words[:1])
            out += self._of(self.rest, words[1:])
            out.append(self.line_break)
        else:
            return np.frombuffer(b"".join(out[:-1]), dtype="<u4")
        parts = _CUT.split(text)
        return np.frombuffer(b"".join([*self._of(self.first, parts[:1]), *self._of(self.rest, parts[1:])]), dtype="<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def batch_encoder(path: str) -> BatchEncoder:
    return BatchEncoder(encoder(path))


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than ``capacity``."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def cut(batches):
        enc, made = batch_encoder(path), TaskContext.get().partitionId()
        for batch in batches:
            ids, bounds = enc.ids(batch.column("text"), end)
            n = np.diff(bounds)
            per = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), per)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            # Only the first piece may be shorter than the capacity.
            first = n - (per - 1) * capacity
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            own = [ids[a : a + k] for a, k in zip((bounds[doc] + start).tolist(), length.tolist())]
            crc = np.fromiter((zlib.crc32(x) for x in own), dtype=np.int64, count=len(own))
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            columns += [pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))] * with_ids
            salt = (made + np.arange(len(own))) % SALTS
            made += len(own)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(salt.astype(np.int32))], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)] + ["salt"])

    return cut


class _Tree:
    """Segment tree over remaining capacities: which are open, and the smallest open one from a bound on."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, at: int, on: bool) -> None:
        i = at + self.leaves
        self.open[i] = on
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset in the bin) that place every piece."""
    tree, bins, runs, made = _Tree(capacity), defaultdict(list), [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            bins[left].append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, made, -(-todo // (capacity // length))
                made += n
            else:
                first, n = bins[left].pop()
                if not bins[left]:
                    tree.set(left, False)
            each = left // length
            full = min(n, todo // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - left))
                rank, todo = rank + full * each, todo - full * each
                put(left - each * length, first, full)
            if full < n and todo:  # one bin takes what is left of this length
                runs.append((length, rank, todo, first + full, todo, capacity - left))
                put(left - todo * length, first + full, 1)
                put(left, first + full + 1, n - full - 1)
                todo = 0
            elif full < n:
                put(left, first + full, n - full)
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    spark = docs.sparkSession
    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = _PIECE + ", ids array<long>" * with_ids
    # A salt is a piece's place in the task that writes it, so equal rows have different ones; written once, it is the same wherever it is read.
    pieces = stored(rows.mapInArrow(_pieces(path, capacity, end, with_ids), schema + ", salt int"), "pieces")
    table = (
        pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("length").agg(F.sort_array(F.collect_list(F.struct("salt", "n"))).alias("by"))
    ).toArrow()  # at most capacity rows of 256 counts
    per = np.zeros((capacity + 1, SALTS), dtype=np.int64)
    by = pa.concat_arrays([c.flatten() for c in table.column("by").chunks]) if table.num_rows else None
    if by is not None:
        sizes = pa.compute.list_value_length(table.column("by")).to_numpy()
        at = np.repeat(table.column("length").to_numpy(), sizes)
        per[at, by.field("salt").to_numpy()] = by.field("n").to_numpy()
    plan = best_fit_plan({int(n): int(c) for n, c in enumerate(per.sum(axis=1)) if c}, capacity)
    before = np.cumsum(per, axis=1) - per
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shared = spark.sparkContext.broadcast((before, plan[order]))

    def place(batches):
        before, plan = shared.value
        key = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, salt, nth = (batch.column(c).to_numpy() for c in ("length", "salt", "nth"))
            rank = before[length, salt] + nth - 1
            run = plan[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            i = rank - run[:, 1]
            bin_, slot = i // run[:, 4], i % run[:, 4]
            keep = [n for n in batch.schema.names if n not in ("salt", "nth")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in keep] + [pa.array(run[:, 3] + bin_), pa.array(run[:, 5] + slot * length)],
                names=keep + ["sequence_id", "offset"],
            )

    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(within).cast("long"))
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents in sequences of at most 2048 tokens."""
    return pack(documents(spark, sf_dir), tokenizer_path())
