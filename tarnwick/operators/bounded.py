"""Exact top-k by inner product that skips what cannot be among the best.

Same rows as ``retrieve.top_k``, by three bounds that lose nothing:

- blocks: a task groups the rows it reads around some of them that lie far apart. No row of a group scores
  more than the product with the group's mean plus the lengths of the question and
  of the group's radius; a group whose bound stays below a question's k-th score so far
  is not scored for it.
- single precision: products are made in single precision first. Their error is at most
  (width + 2) * 2**-23 times the two lengths, so only rows within that of the k-th score
  are scored again, in double precision.
- equal rows: of equal vectors in a task's batch no more than the k with the smallest ids
  (and the question's own) can be wanted, however large the group.

Scores are rounded as ``top_k`` rounds them before they are compared, so the results
are the same to the last digit. How much is skipped depends on the vectors: nearly all where they lie
in clusters, nothing of the blocks where they are spread evenly; ``counts`` tells.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.retrieve import PLACES, PLAN_BLOCKS, QUERY_BLOCK, SCHEMA, Held, few_of_equal, ranked
from tarnwick.session import stored

#: Rows that are grouped at a time, rows of a group on average, and questions of one product.
ROWS, GROUP, PART = 2048, 128, 256
#: Share of (question, group) pairs beyond which a batch is scored in one product.
MOST_NEEDED = 0.6


def _floats(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32) if len(column) else np.zeros((0, 0), dtype=np.float32)


def spread_rows(v: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the farthest from those before it."""
    chosen, apart = [0], ((v - v[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(v)):
        chosen.append(int(np.argmax(apart)))
        apart = np.minimum(apart, ((v - v[chosen[-1]]) ** 2).sum(axis=1))
    return v[chosen]


class Groups:
    """Rows sorted into groups, each with its mean and its radius."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, size: int):
        centres = spread_rows(v[:: max(1, min(8, len(v) // size))], max(1, len(v) // size))
        of = np.argmax(v @ centres.T - (centres.astype(np.float64) ** 2).sum(axis=1) / 2, axis=1)
        order = np.lexsort((ids, of))
        self.ids, self.v, of = ids[order], v[order], of[order]
        self.edge = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
        count = np.diff(self.edge)
        exact = self.v.astype(np.float64)
        self.mean = np.add.reduceat(exact, self.edge[:-1], axis=0) / count[:, None]
        apart = exact - np.repeat(self.mean, count, axis=0)
        self.radius = np.sqrt(np.maximum.reduceat((apart**2).sum(axis=1), self.edge[:-1]))
        self.far = np.sqrt((exact**2).sum(axis=1).max())


def _scan(ids: np.ndarray, questions32: np.ndarray, k: int, skip_same: bool, places: int, counts=None):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = 10.0**-places
        q32, questions = questions32, questions32.astype(np.float64)
        length = np.sqrt((questions**2).sum(axis=1))
        held = {lo: Held(len(ids[lo : lo + PART]), k) for lo in range(0, len(ids), PART)}
        for batch in batches:
            all_ids, all_v = batch.column(0).to_numpy(), _floats(batch.column(1))
            for at in range(0, len(all_ids), ROWS):
                own, v = all_ids[at : at + ROWS], all_v[at : at + ROWS]
                few = few_of_equal(own, v, k + skip_same, ids if skip_same else ids[:0])
                g = Groups(own[few], v[few], GROUP)
                for lo, h in held.items():
                    q, q_own, far = q32[lo : lo + PART], ids[lo : lo + PART], length[lo : lo + PART]
                    slack = (q.shape[1] + 2) * 2.0**-23 * far * g.far + 2 * half
                    bound = questions[lo : lo + PART] @ g.mean.T + far[:, None] * g.radius[None, :] * (1 + 1e-9) + slack[:, None]
                    # A question that has too few rows yet starts from what its best group alone would give.
                    start = np.full(len(q), -np.inf)
                    enough = np.flatnonzero(np.diff(g.edge) > k)
                    open_ = np.flatnonzero(np.isinf(h.kth)) if len(enough) else np.zeros(0, dtype=np.int64)
                    choice = enough[np.argmax(bound[open_][:, enough], axis=1)] if len(open_) else open_
                    for j in np.unique(choice):
                        some = open_[choice == j]
                        s = q[some] @ g.v[g.edge[j] : g.edge[j + 1]].T
                        start[some] = np.partition(s, -k - 1, axis=1)[:, -k - 1] - 2 * slack[some]  # one more than k, as the question's own row may be among them
                    needed = bound >= np.maximum(h.kth, start)[:, None]
                    if counts is not None:
                        counts[0].add(len(q) * len(g.ids))
                        counts[1].add(int((needed * np.diff(g.edge)[None, :]).sum()))
                    whole = needed.mean() > MOST_NEEDED
                    for j in range(1 if whole else len(g.edge) - 1):
                        some = np.arange(len(q)) if whole else np.flatnonzero(needed[:, j])
                        if not len(some):
                            continue
                        part = slice(0, len(g.ids)) if whole else slice(g.edge[j], g.edge[j + 1])
                        s = q[some] @ g.v[part].T
                        if skip_same:
                            s[q_own[some, None] == g.ids[None, part]] = -np.inf
                        low = np.maximum(h.kth[some] - slack[some], start[some])
                        open_ = np.flatnonzero(np.isinf(low))
                        if len(open_) and s.shape[1] > k:
                            low[open_] = np.partition(s[open_], -k, axis=1)[:, -k] - 2 * slack[some[open_]]
                        # Single precision once more: what is rounded down stays a candidate.
                        qi, ci = np.nonzero((s >= np.nextafter(low.astype(np.float32), np.float32(-np.inf))[:, None]) & (s > -np.inf))
                        if len(qi):
                            score = np.einsum("ij,ij->i", questions[lo + some[qi]], g.v[part][ci].astype(np.float64))
                            h.add(some[qi], g.ids[part][ci], np.round(score, places))
        for lo, h in held.items():
            q, p, s = h.rows()
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q + lo]), pa.array(p), pa.array(s)], names=["query_id", "passage_id", "score"])

    return best


def top_k(questions: DataFrame, vectors: DataFrame, k: int = 10, skip_same: bool = False, places: int = PLACES, counts=None) -> DataFrame:
    """query_id, rank, passage_id, score as ``retrieve.top_k`` gives them, for vectors of floats of one width.

    ``counts`` may be two accumulators: pairs of a question and a row, and those whose group was scored.
    Questions are written once, in blocks that are broadcast; a plan scores ``PLAN_BLOCKS`` of them.
    """
    spark = vectors.sparkSession
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("query_id is not null and embedding is not null")
    rows = vectors.select(F.col("passage_id").cast("long").alias("passage_id"), "embedding").filter("passage_id is not null and embedding is not null")
    asked = stored(asked, "asked")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    if n_blocks > 1:  # a block is read from its own files
        block_of = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
        asked = stored(asked.withColumn("block", block_of).repartition("block").sortWithinPartitions("block"), "asked-blocks")
    parts, found = [], None
    for b in range(n_blocks):
        block = (asked.filter(F.col("block") == b) if n_blocks > 1 else asked).toArrow()  # about QUERY_BLOCK rows
        ids = block.column("query_id").to_numpy().astype(np.int64)
        if len(ids):
            shared = spark.sparkContext.broadcast((ids, _floats(block.column("embedding").combine_chunks())))  # a worker keeps those of all blocks

            def run(batches, shared=shared):
                yield from _scan(*shared.value, k, skip_same, places, counts)(batches)

            parts.append(rows.mapInArrow(run, SCHEMA))
        if parts and (len(parts) == PLAN_BLOCKS or b == n_blocks - 1):
            one = functools.reduce(DataFrame.unionByName, parts)
            if n_blocks > PLAN_BLOCKS:
                one = stored(ranked(one, k), "best").select("query_id", "passage_id", "score")
            found, parts = one if found is None else found.unionByName(one), []
    return ranked(spark.createDataFrame([], SCHEMA) if found is None else found, k)
