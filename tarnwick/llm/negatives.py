"""Hard negatives of anchors: blocked dense products, in two passes.

A block of anchors is broadcast; every partition multiplies it with blocks of its
rows, in float64, which is exact while the product of the rows' lengths is below 2**53
(Python integers beyond).

1. Positives: each partition keeps an anchor's best rows of its label, and those of all
   partitions merge into the first ``positives``. They are few numbers an anchor.
2. Negatives: the anchors and their positives' scores are broadcast; each partition keeps,
   for each anchor and positive, the first rows of another label whose score
   lies in the positive's window, and those merge in the same way.

A block has ``ANCHORS`` anchors, fewer where vectors are long (``BLOCK_BYTES``); a plan has
``PLAN_BLOCKS`` blocks, and further ones are written plan by plan. First means
higher score, then smaller id. A group of equal rows, however large, costs no more than
others: of a block of rows no more than the wanted number is taken for each anchor.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component take no part; rows with the anchor's id are its own, neither positive nor
negative; anchors that occur twice are mined twice, and a repeated row counts as often
as it occurs; rows of another length than the anchor's are not compared; an anchor
without positives, and a positive without negatives, give no rows; scores beyond 64
bits count as the nearest 64-bit value, in order and windows too; extra columns are not read, so names cannot
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import stored

from .topk import _by_length

#: Anchors that are broadcast at a time and their bytes at most, anchors of one product, and blocks of one plan.
ANCHORS, BLOCK_BYTES, PART, PLAN_BLOCKS = 8192, 32 << 20, 256, 16
#: Whole numbers up to here are told apart when the place in a block of rows is packed below the score.
PACKED, PLACES = 2.0**40, 4096


def products(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Exact inner products of all rows, to the nearest 64-bit number; ``reach`` bounds every sum."""
    if reach < 2.0**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    whole = lambda x: x if x.dtype == object else np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1)


def firsts(scores: np.ndarray, wanted: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest wanted scores of each row, of equal ones the first columns."""
    if reach < PACKED and scores.shape[1] <= PLACES:
        key = np.where(wanted, scores * PLACES - np.arange(scores.shape[1]), -np.inf)
        n = min(k, scores.shape[1])
        top = np.argpartition(key, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n :] if n < scores.shape[1] else np.tile(np.arange(n), (len(key), 1))
        row, column = np.repeat(np.arange(len(key)), n), top.ravel()
        real = wanted[row, column]
        return row[real], column[real]
    at = [(i, c) for i, w in enumerate(wanted) for c in sorted(np.flatnonzero(w), key=lambda c: (-scores[i, c], c))[:k]]
    row, column = np.array(at, dtype=np.int64).reshape(-1, 2).T
    return row, column


class Firsts:
    """The first k rows of each of n lists so far, by higher score, then smaller id; what is not among them can be told early."""

    def __init__(self, n: int, k: int):
        self.k, self.list, self.id, self.score = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.low, self.last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)

    def wanted(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which columns (by id) may still enter each of these lists."""
        low, last = self.low[lists][:, None], self.last[lists][:, None]
        return np.asarray((scores > low) | ((scores == low) & (ids[None, :] < last)), dtype=bool)

    def add(self, lists: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(lists):
            return
        at, id_, score = np.append(self.list, lists), np.append(self.id, ids), np.append(self.score, scores)
        order = np.lexsort((id_, -score, at)) if score.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], -score[i], id_[i])))
        at, id_, score = at[order], id_[order], score[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        keep = nth < self.k
        self.list, self.id, self.score = at[keep], id_[keep], score[keep]
        full = nth == self.k - 1
        # Beyond 2**53 a double may lie above the whole score it stands for; a step down keeps the test safe.
        self.low[at[full]] = [float(x) if abs(x) < 2**53 else float(x) - abs(float(x)) * 1e-9 for x in score[full]]
        self.last[at[full]] = [i if abs(x) < 2**53 else np.iinfo(np.int64).max for i, x in zip(id_[full], score[full])]


def _rows(batch: pa.RecordBatch, scale: float):
    """(vector length, ids, labels, matrix, longest row) of some rows at a time, ids ascending."""
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    for d, at, matrix, far in _by_length(np.arange(len(ids)), batch.column("embedding"), scale):
        order = np.argsort(ids[at], kind="stable")
        yield d, ids[at][order], labels[at][order], matrix[order], far


def _long(scores: np.ndarray) -> pa.Array:
    return pa.array(np.array([int(x) for x in scores], dtype=np.int64))


def _positives(anchors, k: int, scale: float):
    def mine(batches):
        best: dict = {}
        for batch in batches:
            for d, ids, labels, matrix, far in _rows(batch, scale):
                for place, own, own_label, q, q_far in anchors.value.get(d, ()):
                    s = products(q, matrix, far * q_far)
                    held = best.setdefault(place[0], (place, Firsts(len(place), k)))[1]
                    lists = np.arange(len(place))
                    wanted = (own_label[:, None] == labels[None, :]) & (own[:, None] != ids[None, :]) & held.wanted(lists, s, ids)
                    some = np.flatnonzero(wanted.any(axis=1))
                    row, column = firsts(s[some], wanted[some], k, far * q_far)
                    held.add(some[row], ids[column], s[some[row], column])
        for place, held in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(place[held.list]), pa.array(held.id), _long(held.score)], names=["a", "vec_id", "score"])

    return mine


def _negatives(anchors, positives, k: int, scale: float, low: int, high: int):
    """Lists are numbered by anchor and place of the positive; windows are told by whole numbers."""

    def mine(batches):
        best: dict = {}
        n_positives = positives.value.shape[1] if positives.value.ndim == 2 else 0
        for batch in batches:
            for d, ids, labels, matrix, far in _rows(batch, scale):
                for place, own, own_label, q, q_far in anchors.value.get(d, ()):
                    s = products(q, matrix, far * q_far)
                    held = best.setdefault(place[0], (place, Firsts(len(place) * n_positives, k)))[1]
                    other = (own_label[:, None] != labels[None, :]) & (own[:, None] != ids[None, :])
                    for j in range(n_positives):
                        to = positives.value[place, j]
                        asks = np.array([p is not None for p in to])
                        most = np.array([0 if p is None else p for p in to], dtype=object)
                        least = np.array([-(-low * p // high) for p in most], dtype=object)  # the smallest whole number of the window
                        if s.dtype != object:
                            most, least = most.astype(np.float64), least.astype(np.float64)
                        lists = np.arange(len(place)) * n_positives + j
                        wanted = other & np.asarray((s >= least[:, None]) & (s <= most[:, None]), dtype=bool) & asks[:, None]
                        some = np.flatnonzero(wanted.any(axis=1))
                        wanted = wanted[some] & held.wanted(lists[some], s[some], ids)
                        row, column = firsts(s[some], wanted, k, far * q_far)
                        held.add(lists[some[row]], ids[column], s[some[row], column])
        for place, held in best.values():
            a, j = place[held.list // n_positives], held.list % n_positives
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(j), pa.array(held.id), _long(held.score)], names=["a", "j", "vec_id", "score"])

    return mine


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, scale: float = 256.0, window: tuple[int, int] = (80, 100)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` needs ``vec_id``, ``embedding`` (array of numbers) and ``label`` (a whole
    number). Negatives of a positive score p are rows n of another label with
    window[0] * p <= window[1] * n <= window[1] * p.
    """
    spark, (low, high) = vectors.sparkSession, window
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("asks")
    ).filter("vec_id is not null and label is not null and embedding is not null").filter(finite)
    asked = rows.filter("asks").select("vec_id", "label", "embedding")
    rows = rows.select("vec_id", "label", "embedding")
    n, wide = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).head()
    blocks = max(1, -(-n // max(1, min(ANCHORS, BLOCK_BYTES // (8 * max(1, wide))))))
    if blocks > 1:  # a block is read from its own files; equal anchors go to different blocks
        asked = asked.withColumn("block", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("block"), F.lit(blocks)))
        asked = stored(asked.repartition("block").sortWithinPartitions("block"), "anchors")
    out, parts = None, []
    for b in range(blocks):
        table = (asked.filter(F.col("block") == b).drop("block") if blocks > 1 else asked).toArrow().combine_chunks()
        if table.num_rows:
            parts.append(_one_block(spark, rows, table, positives, negatives, scale, low, high))
        if parts and (len(parts) == PLAN_BLOCKS or b == blocks - 1):
            one = functools.reduce(DataFrame.unionByName, parts)
            if blocks > PLAN_BLOCKS:
                one = stored(one, "negatives")
            out, parts = one if out is None else out.unionByName(one), []
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _merged(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _one_block(spark, rows: DataFrame, table: pa.Table, positives: int, negatives: int, scale: float, low: int, high: int) -> DataFrame:
    batch, n = table.to_batches()[0], table.num_rows
    ids, labels, anchors = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), {}
    for d, at, matrix, far in _by_length(np.arange(n), batch.column("embedding"), scale):
        for lo in range(0, len(at), PART):
            part = slice(lo, lo + PART)
            anchors.setdefault(d, []).append((at[part], ids[at[part]], labels[at[part]], matrix[part], far))
    shared = spark.sparkContext.broadcast(anchors)
    found = _merged(rows.mapInArrow(_positives(shared, positives, scale), "a long, vec_id long, score long"), ["a"], positives).collect()  # a few rows an anchor
    to, who = np.full((n, positives), None, dtype=object), np.zeros((n, positives), dtype=np.int64)
    for r in found:
        to[r["a"], r["rank"] - 1], who[r["a"], r["rank"] - 1] = r["score"], r["vec_id"]
    scores = spark.sparkContext.broadcast(to)
    mined = rows.mapInArrow(_negatives(shared, scores, negatives, scale, low, high), "a long, j long, vec_id long, score long")
    at = [(int(a), int(j), int(ids[a]), int(who[a, j]), int(to[a, j])) for a, j in zip(*np.nonzero(to != None))]  # noqa: E711
    pairs = spark.createDataFrame(pa.table(dict(zip(("a", "j", "anchor_id", "positive_id", "positive_score"), map(list, zip(*at)))))) if at else None
    if pairs is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    ranked = _merged(mined, ["a", "j"], negatives).join(F.broadcast(pairs), ["a", "j"])  # at most ANCHORS times the positives
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: hard negatives of the rows of embeddings whose id is divisible by 100, every seventh label moved on by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


SQL = """
with v as (select vec_id, row_number() over () as r, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and not coalesce(list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))), false)),
s as (select q.vec_id as anchor_id, q.r, v.vec_id, v.label = q.label as same, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v on q.vec_id != v.vec_id and q.vec_id % 100 = 0),
p as (select * from (select *, row_number() over (partition by r order by score desc, vec_id) as place from s where same) where place <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.r, p.place order by s.score desc, s.vec_id) as rank
  from p join s on s.r = p.r and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
