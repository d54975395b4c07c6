"""Packing by the histogram of lengths: non-negative least squares over shallow combinations.

Documents are cut into full windows and one rest. Rests of one length are
interchangeable, so the plan follows from their histogram, ``window`` numbers at most:

1. All combinations of up to ``DEPTH`` lengths that fill the window, or a smaller power
   of two, are enumerated. A sequence as long as a power of two needs no padding, and
   blocks of such lengths, laid down from large to small, fill windows without a gap.
2. Repeat counts: the non-negative least squares solution of combinations against the
   histogram, by active sets, rounded to whole numbers the histogram can give.
3. What is left is packed greedily, the largest length that fits first; a piece is cut
   where nothing fits the gap, and the rest of it goes back among the lengths. A
   pattern is repeated at once as often as its lengths allow.

All blocks lie on one tape without gaps. It is cut at each multiple of the window, and
its end, shorter than a window, at the powers of two that it is a sum of. So no
sequence needs padding, whatever the lengths; the solution keeps the cuts few.

A task that encodes texts numbers its pieces within their length as it writes them. The
counts by task and length tell where the numbers of a task begin; they are sent out for
``TASKS`` tasks at a time (32 MB at most), so pieces are placed where they are read and
nothing is shuffled but counts. Ids are written for pieces shorter than the window, as
the plan may cut those.

Defined results: a null text counts as empty, which is the end token alone; repeated
rows are packed apart; an empty table packs into nothing; extra columns are not
read, so names cannot clash. A text of any length is tokenised whole.
"""

from __future__ import annotations

import bisect
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.session import stored

from .common import documents, text_batches
from .packing import END, batch_encoder, tokenizer_path

WINDOW, DEPTH = 1024, 3
#: Writing tasks whose counts are sent out at a time, and such rounds of one plan.
TASKS, PLAN_ROUNDS = 4096, 16
#: Combinations that one step of the solver adds, its steps at most, and the residual, as a share of the histogram, that ends it.
ADDED, STEPS, CLOSE = 48, 300, 1e-6


def combinations(lengths: np.ndarray, total: int, depth: int = DEPTH) -> list[np.ndarray]:
    """For each depth the combinations (rows, ascending) of these lengths that sum to ``total``."""
    have = np.zeros(total + 1, dtype=bool)
    lengths = lengths[lengths <= total]
    have[lengths] = True
    out = [np.array([[total]])] if have[total] else []
    if depth > 1:
        pairs = lengths[2 * lengths <= total]
        pairs = pairs[have[total - pairs]]
        out.append(np.stack([pairs, total - pairs], axis=1))
    if depth > 2:
        for a in lengths[3 * lengths <= total]:
            b = lengths[(lengths >= a) & (2 * lengths <= total - a)]
            b = b[have[total - a - b]]
            out.append(np.stack([np.full(len(b), a), b, total - a - b], axis=1))
    return [x for x in out if len(x)]


def enumerated(counts: np.ndarray, window: int, depth: int = DEPTH) -> np.ndarray:
    """Rows of ``depth`` lengths, zeros in front: every combination that fills a power of two up to the window."""
    lengths, size, rows = np.flatnonzero(counts), window, []
    while size:
        for x in combinations(lengths, size, depth):
            rows.append(np.pad(x, ((0, 0), (depth - x.shape[1], 0))))
        size //= 2
    return np.concatenate(rows) if rows else np.zeros((0, depth), dtype=np.int64)


def solve(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that come nearest to the histogram in least squares, by active sets.

    Each step adds the combinations of steepest descent that share no length, solves for
    the chosen ones, and drops those that would go below zero.
    """
    x, top = np.zeros(len(combos)), float(counts.max(initial=0))
    if not len(combos) or not top:
        return x
    target = counts / top
    target[0] = 0.0
    dense = lambda rows: np.stack([np.bincount(r, minlength=len(counts)) for r in combos[rows]], axis=1).astype(float)
    chosen, matrix = np.zeros(0, dtype=np.int64), np.zeros((len(counts), 0))
    residual, norm, before = target.copy(), np.linalg.norm(target), np.inf
    for _ in range(STEPS):
        now = np.linalg.norm(residual)
        if now <= CLOSE * norm or now > before * (1 - 1e-4):
            break
        before, slope = now, residual.copy()
        slope[0] = 0.0
        descent = slope[combos].sum(axis=1)
        descent[chosen] = 0.0
        taken, more = np.zeros(len(counts), dtype=bool), []
        best = np.argpartition(-descent, min(len(descent) - 1, 64 * ADDED))[: 64 * ADDED]
        for c in best[np.lexsort((best, -descent[best]))]:
            if descent[c] <= 1e-12 or len(more) == ADDED:
                break
            if not taken[row := combos[c][combos[c] > 0]].any():
                taken[row] = True
                more.append(c)
        if not more:
            break
        columns = dense(np.array(more))
        columns[0] = 0.0
        chosen, matrix = np.append(chosen, more), np.concatenate([matrix, columns], axis=1)
        value = np.append(x[chosen[: len(chosen) - len(more)]], np.zeros(len(more)))
        while True:
            gram = matrix.T @ matrix
            gram[np.diag_indices_from(gram)] += 1e-9
            wanted = np.linalg.solve(gram, matrix.T @ target)
            if (wanted > 0).all():
                value = wanted
                break
            low = wanted <= 0
            drop = value[low] - wanted[low]
            step = np.min(np.where(drop > 0, value[low] / np.where(drop > 0, drop, 1), 0.0))
            value = value + step * (wanted - value)
            keep = ~(low & (value <= 1e-12))
            if keep.all():
                keep[np.flatnonzero(low)[np.argmin(value[low])]] = False
            x[chosen[~keep]] = 0.0
            chosen, matrix, value = chosen[keep], matrix[:, keep], value[keep]
            if not len(chosen):
                break
        x[chosen] = value
        residual = target - matrix @ value
    return x * top


def rounded(combos: np.ndarray, x: np.ndarray, counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination, whole repeat count), the largest first, none taking more than is left of a length; takes them from ``counts``."""
    out = []
    for c in np.lexsort((np.arange(len(x)), -x)):
        if x[c] < 0.25:
            break
        lengths, uses = np.unique(combos[c][combos[c] > 0], return_counts=True)
        n = min(int(np.ceil(x[c] - 0.25)), *(int(counts[a]) // int(u) for a, u in zip(lengths, uses)))
        if n > 0:
            counts[lengths] -= uses * n
            out.append((tuple(combos[c][combos[c] > 0].tolist()), n))
    return out


class Plan:
    """Runs of pieces: (length, first rank, pieces, place on the tape, pieces a block, block, taken, first rank of the rests or -1)."""

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.total = window, sum(length * n for length, n in counts.items())
        self.made = np.zeros(window + 1, dtype=np.int64)
        for length, n in counts.items():
            self.made[length] = n
        self.used = np.zeros_like(self.made)
        self.runs: list[tuple[int, ...]] = []
        self._solve()

    def _left(self, length: int) -> int:
        return int(self.made[length] - self.used[length])

    def _put(self, length: int, n: int, place: int, each: int, block: int, taken: int | None = None) -> None:
        """The next ``n`` pieces of a length, ``each`` of them in every block from ``place`` on; ``taken`` ids of each, the rest made a piece again."""
        rest = -1
        if taken is not None and taken < length:
            rest = int(self.made[length - taken])
            self.made[length - taken] += n
        self.runs.append((length, int(self.used[length]), n, place, each, block, taken or length, rest))
        self.used[length] += n

    def _solve(self) -> None:
        window, place = self.window, 0
        if full := self._left(window):
            self._put(window, full, 0, 1, window)
            place = full * window
        open_ = self.made - self.used
        combos = enumerated(open_, window)
        chosen = rounded(combos, solve(combos, open_.astype(float)), open_)
        by_size: dict[int, list] = {}
        for combo, n in chosen:
            by_size.setdefault(sum(combo), []).append((combo, n))
        smaller = [(size, by_size[size]) for size in sorted(by_size, reverse=True) if size < window]
        held = np.zeros_like(self.made)  # pieces that the smaller blocks will take
        for size, rows in smaller:
            for combo, n in rows:
                np.add.at(held, list(combo), n)
        place = self._blocks(by_size.get(window, []), window, place)
        place = self._greedy(held, place)
        for size, rows in smaller:
            place = self._blocks(rows, size, place)
        self._end(place)

    def _blocks(self, rows, size: int, place: int) -> int:
        for combo, n in rows:
            at = place
            for length in sorted(set(combo), reverse=True):
                each = combo.count(length)
                self._put(length, n * each, at, each, size)
                at += length * each
            place += n * size
        return place

    def _greedy(self, held: np.ndarray, place: int) -> int:
        """Full windows of what is neither used nor held, the largest that fits first; cuts a piece where nothing fits."""
        left = self.made - self.used - held
        open_ = sorted(np.flatnonzero(left).tolist())
        tokens = int((left * np.arange(len(left))).sum())
        while tokens >= self.window:
            gap, uses, cut = self.window, {}, None
            i = len(open_)
            while gap:
                i = bisect.bisect_right(open_, gap, 0, i) - 1
                if i >= 0:
                    length = open_[i]
                    n = min(gap // length, int(left[length]))
                    uses[length] = n
                    gap -= n * length
                    continue
                # Nothing that is left fits: the smallest longer piece is cut.
                j = bisect.bisect_right(open_, gap)
                while j < len(open_) and left[open_[j]] <= uses.get(open_[j], 0):
                    j += 1
                cut, gap = (open_[j], gap), 0  # there is one, as a window is left
            need = dict(uses)
            if cut:
                need[cut[0]] = need.get(cut[0], 0) + 1
            times = min(int(left[a]) // n for a, n in need.items())
            at = place
            for length, n in uses.items():
                self._put(length, n * times, at, n, self.window)
                at += n * length
            if cut:
                length, taken = cut
                self._put(length, times, at, 1, self.window, taken)
                if not left[length - taken]:
                    bisect.insort(open_, length - taken)
                left[length - taken] += times
            for length, n in need.items():
                left[length] -= n * times
            open_ = [a for a in open_ if left[a]]
            place += times * self.window
            tokens -= times * self.window
        return place

    def _end(self, place: int) -> None:
        """What is left, less than a window, the largest pieces first; cut where a sequence ends."""
        edges = self.edges()
        for length in range(self.window - 1, 0, -1):
            while self._left(length):
                end = int(edges[np.searchsorted(edges, place, side="right")])
                taken = min(length, end - place)
                self._put(length, 1, place, 1, self.window, taken)
                place += taken

    def edges(self) -> np.ndarray:
        """Where the last full windows end, and the shorter sequences after them."""
        whole = self.total // self.window * self.window
        rest, size, out = self.total - whole, self.window, [whole - self.window, whole]
        while size:
            if rest & size:
                out.append(out[-1] + size)
            size //= 2
        return np.array(out, dtype=np.int64)

    def table(self) -> np.ndarray:
        """The runs by length and first rank."""
        runs = np.array(self.runs, dtype=np.int64).reshape(-1, 8)
        return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, window: int, end: int):
    """Rows of full windows and rests, numbered within (task, length); ids (2 bytes each if the vocabulary allows) of those that may be cut."""

    def cut(batches):
        enc = batch_encoder(path)
        kind = "<u2" if enc.enc.whole.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
        part, made = TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            ids, bounds = enc.ids(batch.column("text"), end)
            n = np.diff(bounds)
            per = -(-n // window)
            doc = np.repeat(np.arange(len(n)), per)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * window
            length = np.minimum(window, n[doc] - start)
            at = (bounds[doc] + start).tolist()
            own = [ids[a : a + k] for a, k in zip(at, length.tolist())]
            crc = np.fromiter((zlib.crc32(x) for x in own), dtype=np.int64, count=len(own))
            order = np.argsort(length, kind="stable")
            by = length[order]
            nth = np.empty(len(length), dtype=np.int64)
            nth[order] = np.arange(len(by)) - np.searchsorted(by, by) + made[by]
            made += np.bincount(length, minlength=window + 1)
            kept = [None if k == window else x.astype(kind).tobytes() for x, k in zip(own, length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[doc]),
                    pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(nth), pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "ids"],
            )

    return cut


def _place(shared):
    """Pieces with their sequence and offset; those that the plan cuts become several."""

    def place(batches):
        base, first, runs, edges, window = shared.value
        key, whole = (runs[:, 0] << 50) + runs[:, 1], int(edges[1])
        for batch in batches:
            length, part, nth = (batch.column(c).to_numpy() for c in ("length", "part", "nth"))
            rank, left, row, begin, out = base[part - first, length] + nth, length.astype(np.int64), np.arange(len(length)), np.zeros(len(length), dtype=np.int64), []
            while len(row):
                run = runs[np.searchsorted(key, (left << 50) + rank, side="right") - 1]
                i = rank - run[:, 1]
                out.append((row, begin, run[:, 6], run[:, 3] + i // run[:, 4] * run[:, 5] + i % run[:, 4] * run[:, 6]))
                more = run[:, 7] >= 0
                row, begin, left, rank = row[more], (begin + run[:, 6])[more], (left - run[:, 6])[more], (run[:, 7] + i)[more]
            row, begin, taken, at = (np.concatenate(x) for x in zip(*out))
            crc = batch.column("ids_crc32").to_numpy()[row]
            for j in np.flatnonzero(taken < length[row]):
                ids = np.frombuffer(batch.column("ids")[int(row[j])].as_py(), dtype="<u2" if len(batch.column("ids")[int(row[j])].as_py()) == 2 * length[row[j]] else "<u4")
                crc[j] = zlib.crc32(ids[begin[j] : begin[j] + taken[j]].astype("<u4"))
            tail = np.searchsorted(edges, at, side="right")
            late = at >= whole
            sequence = np.where(late, whole // window + tail - 2, at // window)
            offset = np.where(late, at - edges[np.maximum(tail - 1, 0)], at % window)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows), pa.array(batch.column("start").to_numpy()[row] + begin), pa.array(taken), pa.array(crc),
                    batch.column("doc_tokens").take(rows), pa.array(sequence), pa.array(offset),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return place


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``window`` is a power of two."""
    if window < 1 or window & (window - 1):
        raise ValueError("the window has to be a power of two")
    spark = docs.sparkSession
    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(rows.mapInArrow(_pieces(path, window, end), f"{_SCHEMA}, part int, nth long, ids binary"), "tape-pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "tape-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    last = counts.agg(F.max("part")).head()[0]
    plan = Plan(total, window)
    runs, edges = plan.table(), plan.edges()
    before, out, rounds = np.zeros(window + 1, dtype=np.int64), None, []
    columns = "doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "ids"
    for first in range(0, (last or 0) + 1, TASKS):
        near = F.col("part").between(first, first + TASKS - 1)
        table = counts.filter(near).toArrow()  # TASKS times the window's lengths at most
        per = np.zeros((min(TASKS, (last or 0) + 1 - first), window + 1), dtype=np.int64)
        per[table.column("part").to_numpy() - first, table.column("length").to_numpy()] = table.column("n").to_numpy()
        base = before + np.cumsum(per, axis=0) - per
        before = before + per.sum(axis=0)
        shared = spark.sparkContext.broadcast((base, first, runs, edges, window))
        own = pieces if not last or last < TASKS else pieces.filter(near)
        rounds.append(own.select(*columns).mapInArrow(_place(shared), f"{_SCHEMA}, sequence_id long, offset long"))
        if len(rounds) == PLAN_ROUNDS or first + TASKS > (last or 0):
            one = functools.reduce(DataFrame.unionByName, rounds)
            if (last or 0) >= TASKS * PLAN_ROUNDS:
                one = stored(one, "tape-placed")
            out, rounds = one if out is None else out.unionByName(one), []
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all documents in sequences of at most 1024 tokens, without padding."""
    return pack(documents(spark, sf_dir), tokenizer_path())
