"""Exact top-k retrieval by inner product, for many questions at once.

The corpus is never broadcast. Questions are, in blocks of a fixed number, and each
partition of the corpus returns its k best rows per question, so the shuffle holds
k rows per question and partition. ``top_k_sql`` is the same in expressions alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.session import stored

#: Questions that are broadcast at a time; rows and questions that one product holds.
QUERY_BLOCK, ROW_BLOCK, PART = 32_768, 4096, 256
#: Blocks that one plan scores, decimals of scores that are compared, and retrieved rows that are broadcast (some 40 bytes each).
PLAN_BLOCKS, PLACES, BROADCAST_ROWS = 8, 9, 1_000_000
SCHEMA = "query_id long, passage_id long, score double"
#: Numbers of a field: a single holds two whole numbers below it exactly. The least length of a rounded row, and the share of hits from which on all products are made plainly.
FIELD, LEAST_LENGTH, MOST_HITS = 4096, 64, 1 / 32
#: Questions from which on equal vectors are looked for, so that a vector is scored once however often it is there,
#: and from which on one of ``FIRST`` rows are searched first, to begin all others with the k-th scores among those.
MANY, FIRST = 4096, 32


def _numbers(column: pa.Array) -> np.ndarray:
    """A row per vector, in the precision of the column."""
    kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False) if len(column) else np.zeros((0, 0), dtype=kind)


def few_of_equal(ids: np.ndarray, v: np.ndarray, keep: int, always: np.ndarray) -> np.ndarray:
    """Places of all rows, but of more than ``keep`` equal ones those with the smallest ids, and those of ids in ``always``."""
    mark = v.astype(np.float64) @ np.cos(np.arange(v.shape[1]) + 1.0)
    order = np.lexsort((ids, mark))
    new = np.append(True, mark[order][1:] != mark[order][:-1])
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    if nth.max(initial=0) < keep:
        return np.arange(len(ids))
    # Equal marks are compared in full with the first of them: rows that differ from it all stay.
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same = (v[order] == v[first]).all(axis=1)
    return np.sort(order[(nth < keep) | ~same | np.isin(ids[order], always)])


class Held:
    """The k best rows of each of n questions so far; a place that no row has yet scores minus infinity.

    Rows below ``low``, a score that k rows elsewhere reach, need not be held.
    """

    def __init__(self, n: int, k: int, low: np.ndarray | None = None):
        self.k, self._p, self._s = k, np.zeros((n, k), dtype=np.int64), np.full((n, k), -np.inf)
        self.kth, self._low = self._s[:, -1], np.full(n, -np.inf) if low is None else low

    def least(self) -> np.ndarray:
        """What a row has to reach."""
        return np.maximum(self.kth, self._low)

    def add(self, q: np.ndarray, p: np.ndarray, s: np.ndarray) -> None:
        """Only the questions of these rows are sorted again."""
        some = np.unique(q)
        q, p, s = np.append(q, np.repeat(some, self.k)), np.append(p, self._p[some]), np.append(s, self._s[some])
        order = np.lexsort((p, -s, q))
        best = order[np.searchsorted(q[order], some)[:, None] + np.arange(self.k)]
        self._p[some], self._s[some] = p[best], s[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the question, id and score of all rows that are held."""
        q, nth = np.nonzero(self._s > -np.inf)
        return q, self._p[q, nth], self._s[q, nth]


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))


class Counts:
    """Questions that are counts of something: each a unit times whole numbers from 0 on, as hashed texts of length one are.

    ``level`` is twice the binary logarithm of the whole numbers' length, rounded up; -1 where a question is no such.
    """

    def __init__(self, q: np.ndarray):
        self.unit, self.whole = np.zeros(len(q)), np.zeros(q.shape, dtype=np.float32)
        self.off, self.total, length = (np.zeros(len(q)) for _ in range(3))
        for lo in range(0, len(q), ROW_BLOCK):
            part = slice(lo, lo + ROW_BLOCK)
            self.unit[part], self.whole[part] = self._units(q[part])
            self.off[part] = _lengths(self.whole[part] * self.unit[part, None] - q[part]) * (1 + 1e-6)
            self.total[part], length[part] = self.whole[part].sum(axis=1, dtype=np.float64), _lengths(self.whole[part])
        self.level = np.where(self.unit > 0, np.ceil(2 * np.log2(np.maximum(length, 1)) - 1e-9), -1).astype(int)

    @staticmethod
    def _units(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit, whole = np.zeros(len(q)), np.zeros(q.shape, dtype=np.float32)
        least = np.where(q > 0, q, np.inf).min(axis=1, initial=np.inf).astype(np.float64)
        open_ = (q.dtype == np.float32) & np.isfinite(least) & (q >= 0).all(axis=1) & np.isfinite(q).all(axis=1)
        for part in (1, 2, 3):  # the least of the counts
            some = np.flatnonzero(open_ & (unit == 0))
            u = least[some, None] / part
            w = np.rint(q[some] / u)
            good = (np.abs(w * u - q[some]) <= 1e-4 * u).all(axis=1)
            unit[some[good]], whole[some[good]] = u[good, 0], w[good]
        return unit, whole

    def sort(self) -> np.ndarray:
        """Sort by level; the places where the rows were."""
        order = np.argsort(self.level, kind="stable")
        for name in ("unit", "whole", "off", "total", "level"):
            setattr(self, name, getattr(self, name)[order])
        return order


def _packed(v: np.ndarray, far: float, level: int) -> tuple[np.ndarray, float] | None:
    """Rows of non-negative numbers times a scale, rounded, the second half of them in the upper field of the first, and the scale.

    With questions of the level no product of two such reaches ``FIELD``, and all sums are exact.
    """
    scale = ((FIELD - 2) / 2.0 ** (level / 2) - v.shape[1] ** 0.5 / 2) / max(far, 1e-30)
    if not LEAST_LENGTH <= scale * far <= FIELD or scale > 1e30:
        return None
    whole, half = np.rint(v * np.float32(scale)), -(-len(v) // 2)
    whole[: len(v) - half] += FIELD * whole[half:]
    return whole[:half], float(np.float32(scale))


def _hits(c: Counts, at: slice, low: np.ndarray, packed: np.ndarray, scale: float, far: float, n: int, room: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of the questions and rows whose products may reach ``low``; None where those are many.

    One product has the scores of two rows. Rounding moves a row's component by little more than a half, so a score
    in units is off by that times the sum of the question's whole numbers at most.
    """
    least = (low - c.off[at] * far) * scale / c.unit[at] - 0.501 * c.total[at]
    least = np.clip(np.ceil(least - 1e-3), 0, FIELD)
    shape = len(least), len(packed)
    s = np.matmul(c.whole[at], packed.T, out=room[: shape[0] * shape[1]].reshape(shape))
    high = np.flatnonzero(s.max(axis=1) >= least * FIELD)
    qi, ci = _at_least(s[high], (least[high] * FIELD).astype(np.float32))
    lower = more[: s.size].reshape(shape)
    np.copyto(lower, s, casting="unsafe")
    np.bitwise_and(lower, FIELD - 1, out=lower)
    some = np.flatnonzero(lower.max(axis=1) >= least)
    qj, cj = _at_least(lower[some], least[some].astype(np.int32))
    if len(qi) + len(qj) > MOST_HITS * len(least) * n:
        return None
    q, row = np.append(high[qi], some[qj]), np.append(ci + len(packed), cj)
    return q[row < n], row[row < n]


def _scan(ids: np.ndarray, questions: np.ndarray, k: int, skip_same: bool, places: int, low: np.ndarray | None = None):
    """Per batch one product in single precision, where all numbers are; what may be among the best is scored again in double.

    The error of a product is at most (width + 4) * 2**-23 times the two lengths, so every row is looked
    at that comes so near to the k-th score so far. Of equal rows the k with the smallest ids are enough.

    Where questions are counts and no row has a number below zero, rows are rounded to twelve bits, and two
    of them share one product (``_hits``). Both forms give the same rows. ``low`` has a score for each question
    that k rows reach, in this partition or in others; rows below it are left out.
    """
    low = np.full(len(ids), -np.inf) if low is None else low

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(questions)
        order = counts.sort()
        yield from ordered(batches, ids[order], questions[order], low[order], counts)

    def ordered(batches: Iterator[pa.RecordBatch], ids: np.ndarray, questions: np.ndarray, low: np.ndarray, counts: Counts) -> Iterator[pa.RecordBatch]:
        # A part has questions of one level.
        edges = np.append(np.flatnonzero(np.diff(counts.level, prepend=-2)), len(ids))
        starts = {int(lo): min(int(lo) + PART, int(hi)) for a, hi in zip(edges, edges[1:]) for lo in range(a, hi, PART)}
        held = {lo: Held(hi - lo, k, low[lo:hi]) for lo, hi in starts.items()}
        length, room, more = _lengths(questions), np.empty(PART * ROW_BLOCK, dtype=np.float32), np.empty(PART * -(-ROW_BLOCK // 2), dtype=np.int32)
        for batch in batches:
            rows, vectors = batch.column(0).to_numpy(), _numbers(batch.column(1))
            for at in range(0, len(rows), ROW_BLOCK):
                own, v = rows[at : at + ROW_BLOCK], vectors[at : at + ROW_BLOCK]
                few = few_of_equal(own, v, k + skip_same, ids if skip_same else ids[:0])
                if len(few) < len(own):
                    own, v = own[few], v[few]
                far = _lengths(v).max()
                # Doubles, and what single precision could not hold, are multiplied as doubles.
                single = v.dtype == questions.dtype == np.float32 and far * length.max() < 1e30
                slack = length * (far * (v.shape[1] + 4) * 2.0**-23 if single else 0.0) + 2 * 10.0**-places
                v = v if single else v.astype(np.float64)
                packed = {-1: None} if single and v.size and v.min() >= 0 else None
                for lo, h in held.items():
                    part = slice(lo, starts[lo])
                    q, level = questions[part], counts.level[lo]
                    if packed is not None and (least := h.least()).min() > -np.inf:
                        if level not in packed:
                            packed[level] = _packed(v, far, level)
                        hits = packed[level] and _hits(counts, part, least - 2 * 10.0**-places, *packed[level], far, len(own), room, more)
                        if hits is not None:
                            qi, ci = hits
                            if skip_same:
                                qi, ci = qi[other := ids[part][qi] != own[ci]], ci[other]
                            _score(h, q, own, v, qi, ci, places)
                            continue
                    s = np.matmul(q, v.T, out=room[: len(q) * len(own)].reshape(len(q), len(own))) if single else _products(q, v)
                    if skip_same and (same := np.flatnonzero(np.isin(own, ids[part]))).size:
                        s[:, same] = np.where(ids[part, None] == own[None, same], -np.inf, s[:, same])
                    _take(h, q, own, v, s, slack[part], length[part], places)
        for lo, h in held.items():
            q, p, s = h.rows()
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q + lo]), pa.array(p), pa.array(s)], names=["query_id", "passage_id", "score"])

    return best


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """In double precision; what is no number takes no part."""
    s = q.astype(np.float64) @ v.T
    return np.where(np.isnan(s), -np.inf, s)


def _at_least(s: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the few entries that reach the bound of their row, looked for eight at a time."""
    wide = -(-s.shape[1] // 8) * 8
    hit = np.empty((len(s), wide), dtype=bool)
    hit[:, s.shape[1] :] = False
    np.greater_equal(s, low[:, None], out=hit[:, : s.shape[1]])
    eights = np.flatnonzero(hit.view(np.uint64))
    e, nth = np.nonzero(hit.reshape(-1, 8)[eights])
    return np.divmod(eights[e] * 8 + nth, wide)


def _take(h: Held, q: np.ndarray, own: np.ndarray, v: np.ndarray, s: np.ndarray, slack: np.ndarray, length: np.ndarray, places: int) -> None:
    """Add to the best rows those that the products ``s`` do not rule out."""
    low = h.least() - slack
    if s.shape[1] > h.k and (open_ := np.flatnonzero(np.isinf(low))).size:
        low[open_] = np.partition(s[open_], -h.k, axis=1)[:, -h.k] - 2 * slack[open_]
    # To a question of zeros all rows are equal: those with the smallest ids are enough.
    zero = np.flatnonzero(length == 0)
    if zero.size and np.isfinite(v).all():
        first = np.argsort(own)[: h.k + 1]
        zi, ci = np.nonzero(s[zero][:, first] > -np.inf)
        h.add(zero[zi], own[first[ci]], np.zeros(len(zi)))
        low[zero] = np.inf
    low = np.nextafter(low.astype(s.dtype), s.dtype.type(-np.inf))
    some = np.flatnonzero(s.max(axis=1) >= low)
    qi, ci = _at_least(s[some], low[some])
    qi = some[qi]
    there = s[qi, ci] > -np.inf
    _score(h, q, own, v, qi[there], ci[there], places)


def _score(h: Held, q: np.ndarray, own: np.ndarray, v: np.ndarray, qi: np.ndarray, ci: np.ndarray, places: int) -> None:
    """Score these pairs in double precision, and add those that come up to the k-th score so far."""
    for at in range(0, len(qi), ROW_BLOCK):
        a, c = qi[at : at + ROW_BLOCK], ci[at : at + ROW_BLOCK]
        s = np.round(np.einsum("ij,ij->i", q[a].astype(np.float64), v[c].astype(np.float64)), places)
        if (near := s >= h.least()[a]).any():
            h.add(a[near], own[c[near]], s[near])


def _different(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Of equal vectors the row with the smallest ``key``, and all rows of such vectors: ``_one`` (that smallest) and ``_each``.

    Vectors are equal that have equal hashes of 128 bits; what meets are hashes and ids.
    """
    marks = [F.xxhash64("embedding").alias("_m"), F.xxhash64(F.lit(1), "embedding").alias("_n")]
    marked = rows.select(key, *marks)
    often = marked.groupBy("_m", "_n").agg(F.min(key).alias("_one"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    equal = stored(marked.join(often, ["_m", "_n"]).select("_one", F.col(key).alias("_each")), f"equal-{name}")
    left_out = equal.filter("_each != _one").select(F.col("_each").alias(key))
    n = left_out.count()
    if not n:
        return rows, None
    few = n <= BROADCAST_ROWS
    rest = rows.join(F.broadcast(left_out) if few else left_out, key, "left_anti")
    return rest if few else stored(rest, f"different-{name}"), equal


def _repeated(found: DataFrame, equal: DataFrame, key: str) -> DataFrame:
    """A row for each of the equal vectors that ``key`` stands for."""
    out = found.join(equal, F.col(key) == F.col("_one"), "left")
    return out.withColumn(key, F.coalesce("_each", key)).select(*found.columns)


def top_k(questions: DataFrame, vectors: DataFrame, k: int = 10, skip_same: bool = False, places: int = PLACES) -> DataFrame:
    """query_id, rank, passage_id, score of the min(k, n) best passages; ties to the smaller id.

    ``questions`` has query_id and embedding, ``vectors`` passage_id and embedding, all
    of one width. ``skip_same`` leaves out the passage whose id is the question's.
    Scores are rounded to ``places`` decimals before they are compared, so that the
    order in which products are summed decides nothing.

    Questions are written once, numbered in blocks; a plan scores ``PLAN_BLOCKS`` blocks and
    is written where there are more, so no plan grows with the questions. From ``MANY`` questions on, equal
    questions are asked once, and equal vectors are scored once.
    """
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("query_id is not null and embedding is not null")
    rows = vectors.select(F.col("passage_id").cast("long").alias("passage_id"), "embedding").filter("passage_id is not null and embedding is not null")
    asked = stored(asked, "asked")
    n, alike, equal = asked.count(), None, None
    if n >= MANY and not skip_same:
        asked, alike = _different(asked, "query_id", "questions")
        n = n if alike is None else asked.count()
        rows, equal = _different(rows, "passage_id", "vectors")
    if n >= MANY:
        some = stored(rows.filter(F.pmod(F.xxhash64("passage_id"), F.lit(FIRST)) == 0), "first")
        first = _searched(asked, some, n, k, skip_same, places)
        low = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("low"))
        asked = stored(asked.join(low, "query_id", "left"), "asked-low")
    found = _searched(asked, rows, n, k, skip_same, places)
    if equal is not None:
        # Among the k best are k vectors at most, and of each the k smallest ids at most.
        place = F.row_number().over(W.partitionBy("_one").orderBy("_each"))
        equal = equal.withColumn("_nth", place).filter(F.col("_nth") <= k).drop("_nth")
        found = ranked(_repeated(found.drop("rank"), equal, "passage_id"), k)
    return found if alike is None else _repeated(found, alike, "query_id")


def _searched(asked: DataFrame, rows: DataFrame, n: int, k: int, skip_same: bool, places: int) -> DataFrame:
    """The k best of ``rows`` for each of ``n`` stored questions, which may have a ``low``, a score that k of all rows reach."""
    spark, n_blocks = rows.sparkSession, max(1, -(-n // QUERY_BLOCK))
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    if n_blocks > 1:  # a block is read from its own files
        asked = stored(asked.withColumn("block", block_of).repartition("block").sortWithinPartitions("block"), "asked-blocks")
    parts, found = [], None
    for b in range(n_blocks):
        block = (asked.filter(F.col("block") == b) if n_blocks > 1 else asked).toArrow()  # about QUERY_BLOCK rows
        ids = block.column("query_id").to_numpy().astype(np.int64)
        if len(ids):
            low = np.nan_to_num(block.column("low").to_numpy().astype(np.float64), nan=-np.inf) if "low" in block.column_names else None
            shared = spark.sparkContext.broadcast((ids, _numbers(block.column("embedding").combine_chunks()), low))

            def run(batches, shared=shared):
                ids, questions, low = shared.value
                yield from _scan(ids, questions, k, skip_same, places, low)(batches)

            parts.append((rows.mapInArrow(run, SCHEMA), shared))
        if parts and (len(parts) == PLAN_BLOCKS or b == n_blocks - 1):
            one = functools.reduce(DataFrame.unionByName, [p for p, _ in parts])
            if n_blocks > PLAN_BLOCKS:
                one = stored(ranked(one, k), "best").select("query_id", "passage_id", "score")
                for _, shared in parts:
                    shared.destroy()
            found, parts = one if found is None else found.unionByName(one), []
    return ranked(spark.createDataFrame([], SCHEMA) if found is None else found, k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "passage_id", "score")


def top_k_sql(questions: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """``top_k`` as expressions: the questions are broadcast in blocks of about QUERY_BLOCK.

    Vectors become a column per component, so that a product is plain arithmetic that Spark compiles. All
    rows are scored; so that only few have to be sorted, the k-th score of each question among a part of
    the rows is found first, and what stays below it cannot be among the best of all.
    """
    size = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("w")).head()
    asked_n, n = size(questions), size(vectors)
    wide = lambda rows, key, x: rows.select(key, *[F.get("embedding", F.lit(i)).cast("double").alias(f"{x}{i}") for i in range(width)])
    width = max(asked_n["w"], n["w"])
    asked, rows, n_blocks = wide(questions, "query_id", "_q"), wide(vectors, "passage_id", "_v"), max(1, -(-asked_n["n"] // QUERY_BLOCK))
    product = functools.reduce(lambda a, b: a + b, [F.col(f"_q{i}") * F.col(f"_v{i}") for i in range(width)], F.lit(0.0))
    # Among one of ``part`` rows about as many have to be sorted as there are rows above the k-th of those.
    part = int((n["n"] / k) ** 0.5)

    def scored(asked: DataFrame, rows: DataFrame) -> DataFrame:
        pairs = rows.crossJoin(F.broadcast(asked))
        if "_low" in asked.columns:
            pairs = pairs.filter(F.col("_low").isNull() | (product >= F.col("_low")))
        return pairs.select("query_id", "passage_id", F.round(product, PLACES).alias("score"))

    found = None
    for b in range(n_blocks):
        q = asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
        if part > 1:
            some = ranked(scored(q, rows.filter(F.pmod(F.xxhash64("passage_id"), F.lit(part)) == 0)), k).filter(F.col("rank") == k)
            low = stored(some.select("query_id", (F.col("score") - 2 * 10.0**-PLACES).alias("_low")), "bounds")
            q = q.join(F.broadcast(low), "query_id", "left")
        one = scored(q, rows)
        found = one if found is None else found.unionByName(one)
    return ranked(found, k)


def with_passages(found: DataFrame, passages: DataFrame, texts: bool = True) -> DataFrame:
    """Retrieved rows with title and text, or without ``texts`` with the title alone.

    The k rows per question are written, counted and, up to ``BROADCAST_ROWS`` of them, broadcast: the
    passages stay where they are. More of them meet the passages by id in a shuffle.
    """
    found = stored(found.select("query_id", "rank", "passage_id", "score"), "found")
    few = found.count() <= BROADCAST_ROWS
    shown = ["title", "text"] if texts else ["title"]
    out = passages.select("passage_id", *shown).join(F.broadcast(found) if few else found, "passage_id")
    return out.select("query_id", "rank", "passage_id", *shown, "score")


def gathered(retrieved: DataFrame) -> DataFrame:
    """Per question its passages in rank order, as one array of (rank, passage_id, title, text, score)."""
    one = F.struct("rank", "passage_id", "title", "text", "score")
    return retrieved.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("retrieved"))
