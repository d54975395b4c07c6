"""Exact top-k by inner product, in three phases with a uniform threshold.

A vector's components are split into ``lists`` blocks; a block's inner product with
the query's block is a local score, and the score is the sum of local scores.

1. Every partition gathers, per query and list, the rows with its best local scores,
   and the scores of these rows. The k-th best score of all gathered rows is the
   query's cutoff: k rows reach it, so no row below it is wanted.
2. The cutoff is broadcast. A row whose every local score is below an even share of the
   cutoff is below the cutoff. So a partition collects the entries that reach that
   share, in any list; a row's collected entries and the share for each other
   list bound its score from above, and rows whose bound stays below the cutoff go.
3. What remains is resolved: the entries not collected are looked up, summed exactly and compared;
   k rows per partition and query are merged.

A list of a partition is made where the rows are and never kept as a whole; only k
scores a query and cutoffs move. Queries go in blocks of bounded number, each against
all rows; a plan has ``PLAN_BLOCKS`` of them at most. Components are scaled and floored to integers.
Products are made in the narrowest floats that hold every sum exactly (below
2**24 or 2**53 by the vectors' lengths), in Python integers beyond.

Defined results: rows with a null id, a null vector or a null or non-finite component
take no part, neither as query nor as candidate; rows with the query's id are its
own; vectors of another length are no candidates; repeated rows count each; ties go
to the smaller id; scores beyond 64 bits are set to the nearest 64-bit value; extra
columns are not read, so names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import stored

LISTS = 4
#: Queries that are broadcast at a time, rows and queries that are scored at a time, and query blocks of one plan.
QUERY_BLOCK, ROW_BLOCK, SCORE_BLOCK, PLAN_BLOCKS = 4096, 4096, 256, 16


def _integers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles where the largest is small, else as Python integers."""
    x = np.floor(values.astype(np.float64) * scale)
    if not x.size or np.abs(x).max() < 2.0**20:
        return x
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def _longest(matrix: np.ndarray) -> float:
    """Length of the longest row; no sum of products of some components of two rows is beyond the product of their lengths."""
    if matrix.dtype == object or not matrix.size:
        return np.inf if matrix.dtype == object else 0.0
    return float(np.sqrt((matrix * matrix).sum(axis=1).max()))


def _by_length(ids: np.ndarray, lists: pa.Array, scale: float):
    """(length, ids, matrix, longest row) of the rows of each vector length, some at a time."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        for lo in range(0, len(at), ROW_BLOCK):
            rows = at[lo : lo + ROW_BLOCK]
            matrix = _integers(values[offsets[rows][:, None] + np.arange(d)[None, :]], scale)
            yield int(d), ids[rows], matrix, _longest(matrix)


def _locals(q: np.ndarray, v: np.ndarray, reach: float, n_lists: int) -> list[np.ndarray]:
    """The local scores of all pairs, a matrix for each list; ``reach`` bounds every sum."""
    kind = np.float32 if reach < 2.0**24 else np.float64 if reach < 2.0**53 else object
    if kind is object:
        whole = lambda x: x if x.dtype == object else np.array([int(i) for i in x.ravel()], dtype=object).reshape(x.shape)
        q, v = whole(q), whole(v)
    else:
        q, v = q.astype(kind), v.astype(kind)
    edge = np.linspace(0, q.shape[1], n_lists + 1).astype(int)
    return [q[:, a:b] @ v[:, a:b].T for a, b in zip(edge, edge[1:]) if b > a] or [np.zeros((len(q), len(v)))]


def _sums(parts: list[np.ndarray], qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Exact scores of chosen pairs."""
    total = 0
    for s in parts:
        x = s[qi, vi]
        total = total + (x if x.dtype == object else x.astype(np.float64))
    return total


class _Best:
    """The k best rows of each query of a block so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.q, self.v, self.score = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.kth = np.full(n, -np.inf)

    def add(self, qi: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(qi):
            return
        q, v, score = np.append(self.q, qi), np.append(self.v, ids), np.append(self.score, score)
        order = np.lexsort((v, -score, q)) if score.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -score[i], v[i])))
        q, v, score = q[order], v[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = nth < self.k
        self.q, self.v, self.score = q[keep], v[keep], score[keep]
        last = nth == self.k - 1
        self.kth[q[last]] = [_below(float(x)) for x in score[last]]


def _below(x: float) -> float:
    """A double that is not above a score that it was made from."""
    return x if abs(x) < 2.0**50 else x - abs(x) * 1e-9


def _gather(queries, k: int, n_lists: int, scale: float):
    """Phase 1: per query the k best scores among the rows with the best local scores of some list."""

    def gather(batches):
        best, kth = {}, {}
        for batch in batches:
            for d, row_ids, matrix, far in _by_length(batch.column("vec_id").to_numpy(), batch.column("embedding"), scale):
                for at, q_ids, q, q_far in queries.value.get(d, ()):
                    parts = _locals(q, matrix, far * q_far, n_lists)
                    held = best.setdefault(at[0], _Best(len(q), k))
                    rows = []
                    for j, s in enumerate(parts):
                        # One entry more than k, as the query's own row is often among them.
                        n = min(k + 1, s.shape[1])
                        low = kth.get((at[0], j))
                        if low is None or s.dtype == object:
                            top = np.argsort(-s, axis=1, kind="stable")[:, :n] if s.dtype == object else np.argpartition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n :]
                            qi, vi = np.repeat(np.arange(len(q)), n), top.ravel()
                            kth[at[0], j] = s[qi, vi].reshape(len(q), n).min(axis=1) if n == k + 1 else None
                        else:
                            qi, vi = np.nonzero(s > low[:, None])
                        rows.append(qi * len(row_ids) + vi)
                    pair = np.unique(np.concatenate(rows))
                    qi, vi = pair // len(row_ids), pair % len(row_ids)
                    other = q_ids[qi] != row_ids[vi]
                    held.add(qi[other], row_ids[vi[other]], _sums(parts, qi[other], vi[other]))
        where = {at[0]: at for blocks in queries.value.values() for at, *_ in blocks}
        for first, held in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(where[first][held.q]), pa.array(held.score.astype(np.float64))], names=["q", "score"])

    return gather


def _resolve(queries, cuts, k: int, n_lists: int, scale: float, counts=None):
    """Phases 2 and 3: entries that reach the share are collected; rows that can reach the cutoff are scored exactly."""

    def collect(batches):
        best: dict = {}
        for batch in batches:
            for d, row_ids, matrix, far in _by_length(batch.column("vec_id").to_numpy(), batch.column("embedding"), scale):
                for at, q_ids, q, q_far in queries.value.get(d, ()):
                    held = best.setdefault(at[0], _Best(len(q), k))
                    cut = np.maximum(cuts.value[at], held.kth)  # k rows of this partition may reach higher
                    share = cut / n_lists - np.abs(cut) * 1e-12
                    parts = _locals(q, matrix, far * q_far, n_lists)
                    line = np.nextafter(share.astype(np.float32), np.float32(-np.inf))  # not above the share
                    enough = np.zeros(parts[0].shape, dtype=bool)
                    for s in parts:
                        enough |= (s >= (line if s.dtype == np.float32 else share)[:, None]).astype(bool)
                    qi, vi = np.nonzero(enough)
                    bound = np.zeros(len(qi))
                    for s in parts:
                        x = s[qi, vi].astype(np.float64)
                        bound += np.where(x >= share[qi], x, share[qi])
                    keep = (bound >= cut[qi] - np.abs(cut[qi]) * 1e-9) & (q_ids[qi] != row_ids[vi])
                    if counts is not None:
                        for c, n in zip(counts, (enough.size, len(qi), int(keep.sum()))):
                            c.add(n)
                    qi, vi = qi[keep], vi[keep]
                    score = _sums(parts, qi, vi)
                    reach = score.astype(np.float64) >= cut[qi]
                    held.add(qi[reach], row_ids[vi[reach]], score[reach])
        where = {at[0]: (at, q_ids) for blocks in queries.value.values() for at, q_ids, *_ in blocks}
        for first, held in best.items():
            at, q_ids = where[first]
            score = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in held.score], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at[held.q]), pa.array(q_ids[held.q]), pa.array(held.v), pa.array(score)], names=["q", "query_id", "vec_id", "score"])

    return collect


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, lists: int = LISTS, counts=None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row that ``is_query`` holds for.

    ``vectors`` needs ``vec_id`` and ``embedding`` (array of numbers). ``counts`` may be three
    accumulators: pairs of a query and a row, those collected, and those resolved.
    """
    spark = vectors.sparkSession
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    asked = rows.filter("asks").select("vec_id", "embedding")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    rows = rows.select("vec_id", "embedding")
    if blocks > 1:  # a block is read from its own files
        asked = asked.withColumn("block", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("block"), F.lit(blocks)))  # equal queries go to different blocks
        asked = stored(asked.repartition("block").sortWithinPartitions("block"), "asked")
    out, parts = None, []
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    for b in range(blocks):
        table = (asked.filter(F.col("block") == b).drop("block") if blocks > 1 else asked).toArrow().combine_chunks()  # about QUERY_BLOCK rows
        parts.append(_one_block(spark, rows, table, k, scale, lists, counts).withColumn("block", F.lit(b)))
        if len(parts) == PLAN_BLOCKS or b == blocks - 1:
            one = functools.reduce(DataFrame.unionByName, parts)
            if blocks > PLAN_BLOCKS:
                one = stored(ranked(one).drop("rank"), "best")
            out, parts = one if out is None else out.unionByName(one), []
    return ranked(out).select("query_id", "rank", "vec_id", "score")


def _one_block(spark, rows: DataFrame, table: pa.Table, k: int, scale: float, lists: int, counts) -> DataFrame:
    queries: dict = {}
    n = table.num_rows
    if n:
        table = table.to_batches()[0]
        ids, place = table.column("vec_id").to_numpy(), 0
        # Rows of one length are taken in order, so places are told by counting within each length.
        length = np.diff(table.column("embedding").offsets.to_numpy())
        by_length = np.argsort(length, kind="stable")
        for d, q_ids, matrix, far in _by_length(ids, table.column("embedding"), scale):
            q_at, place = by_length[place : place + len(q_ids)].astype(np.int64), place + len(q_ids)
            for lo in range(0, len(q_ids), SCORE_BLOCK):
                part = slice(lo, lo + SCORE_BLOCK)
                queries.setdefault(d, []).append((q_at[part], q_ids[part], matrix[part], far))
    queries = spark.sparkContext.broadcast(queries)
    gathered = rows.mapInArrow(_gather(queries, k, lists, scale), "q long, score double")
    best = gathered.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("kth"))
    cut = np.full(n, -(2.0**200))
    for r in best.collect():  # a row per query of this block
        if r["kth"]:
            cut[r["q"]] = _below(r["kth"][0])
    cuts = spark.sparkContext.broadcast(cut)
    return rows.mapInArrow(_resolve(queries, cuts, k, lists, scale, counts), "q long, query_id long, vec_id long, score long")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the 5 best rows for every row of embeddings whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL = """
with v as (select vec_id, row_number() over () as r, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
s as (select q.vec_id as query_id, q.r, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v on q.vec_id != v.vec_id and q.vec_id % 50 = 0),
k as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from k where rank <= 5
"""
