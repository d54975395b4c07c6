"""Toxicity by cumulative-link ordinal regression on sparse word features.

A text's features are its words (letters only, lower case) and their beginnings of
four to six bytes, as 64-bit hashes; a feature counts by one plus the logarithm of
how often it occurs. One weight per feature is shared by all ordered thresholds:
P(grade <= j) = logistic(threshold_j - weights . features). Weights are not negative
(evidence of toxicity only adds up, so a long clean text does not hide a slur), with
a penalty on their sum and squares. The output is the expected grade.

Labels may be grades, or 0 and 1. From 0 and 1, grades are made in the sample:
0 stays, 1 is split at the median number of strongly marked words into mild (1) and
severe (2).

The sample is bounded: ``PER_LABEL`` labelled texts of each label, those with the
smallest hashes. Scoring reads whole texts.

Defined results: null and blank texts have no features, hence the grade of an empty
text; labels that are null, or whose document is missing, teach nothing; a document
labelled twice is learned from twice; without labels of both kinds nothing is
learned and all severities are 0; repeated rows are scored alike; extra columns are
not read, so names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.session import stored

from .common import bounded_sample, documents, text_batches
from .scan import LETTERS, words

PREFIXES = (4, 5, 6)
#: Labelled texts of each label that are learned from, at most.
PER_LABEL = 2500
#: Features that are kept, and texts of the sample a feature must occur in.
MOST_FEATURES, LEAST_TEXTS = 4096, 4
#: Penalties on the weights' sum and squares, rounds of fitting, and the probability of grade 1 or more that rejects.
L1, L2, ROUNDS, REJECT = 0.0005, 0.0002, 400, 0.5


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, feature hashes (one line per kind of feature) and each word's row, some rows at a time."""
    for w in words(column, table=LETTERS):
        kinds = [w.hashes(), *(w.prefix_hashes(n) for n in PREFIXES)]
        yield w.row, np.stack(kinds), w.rows(), w.row + w.n_rows


def _weight(n: np.ndarray) -> np.ndarray:
    return 1 + np.log(n)


@dataclass
class Ordinal:
    """Sorted feature hashes, their weights, and the ordered thresholds: of bounded size."""

    names: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[self.names & np.uint64((1 << 20) - 1)] = True

    def scores(self, column: pa.Array) -> np.ndarray:
        """weights . features of each row."""
        out = np.zeros(len(column))
        if not len(self.names):
            return out
        for _, kinds, rows, _ in features(column):
            flat, row = kinds.ravel(), np.tile(rows, len(kinds))
            at = np.flatnonzero(self.known[flat & np.uint64((1 << 20) - 1)])
            place = np.minimum(np.searchsorted(self.names, flat[at]), len(self.names) - 1)
            hit = self.names[place] == flat[at]
            key, n = np.unique(row[at[hit]] * len(self.names) + place[hit], return_counts=True)
            np.add.at(out, key // len(self.names), self.weights[key % len(self.names)] * _weight(n))
        return out

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j), for j from 1 on, of each row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL) -> DataFrame:
    """At most ``per_label`` texts of each label: columns label, doc_id, text."""
    given = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).dropna()
    given = bounded_sample(given, "label", ["_id"], per_label)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return rows.join(F.broadcast(given), F.col("doc_id") == F.col("_id")).select("label", "doc_id", "text")


def _weights_of(y: np.ndarray) -> np.ndarray:
    """Weights of the texts: each grade weighs the same, so the thresholds stand between them, and grade 0 as much as all others."""
    weight = np.array([len(y) / max((y == j).sum(), 1) for j in range(int(y.max()) + 1)])[y]
    weight[y > 0] *= weight[y == 0].sum() / max(weight[y > 0].sum(), 1e-9)
    return weight / weight.sum()


def _gradient(w: np.ndarray, theta: np.ndarray, row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log-likelihood with the penalties, and its slopes by weights and thresholds."""
    z = np.bincount(row, weights=w[col] * x, minlength=len(y))
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    lo, hi = (1 / (1 + np.exp(-np.clip(edge[y + k] - z, -500, 500))) for k in (0, 1))
    p = np.maximum(hi - lo, 1e-12)
    dlo, dhi = lo * (1 - lo), hi * (1 - hi)
    dw = np.bincount(col, weights=(weight * (dhi - dlo) / p)[row] * x, minlength=len(w)) + L1 + L2 * w
    dt = np.array([(weight * dlo / p)[y == j + 1].sum() - (weight * dhi / p)[y == j].sum() for j in range(len(theta))])
    return float(-(weight * np.log(p)).sum() + L1 * w.sum() + L2 / 2 * (w**2).sum()), dw, dt


def _train(names: np.ndarray, row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray) -> Ordinal:
    """Fit by projected gradient steps with per-weight scaling."""
    n_cols, top = len(names), int(y.max())
    w, theta, weight = np.zeros(n_cols), np.arange(1.0, top + 1), _weights_of(y)
    gw, gt = np.full(n_cols, 1e-8), np.full(top, 1e-8)
    for step in range(ROUNDS):
        _, dw, dt = _gradient(w, theta, row, col, x, y, weight)
        gw, gt = 0.95 * gw + 0.05 * dw**2, 0.95 * gt + 0.05 * dt**2
        rate = 0.1 * (1 - step / ROUNDS) + 0.005
        w = np.maximum(w - rate * dw / np.sqrt(gw + 1e-12), 0)
        theta = np.maximum.accumulate(theta - rate * dt / np.sqrt(gt + 1e-12))
    keep = w > 1e-6
    return Ordinal(names[keep], w[keep], theta)


def _features_of(rows: DataFrame) -> DataFrame:
    """label, doc_id, and each text's distinct features with their numbers of occurrences."""

    def extract(batches):
        for batch in batches:
            label, ids = batch.column("label").to_numpy(), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, kinds, rows_, end in features(batch.column("text")):
                cut = np.searchsorted(rows_, np.arange(first, end + 1))
                out = []
                for a, b in zip(cut[:-1], cut[1:]):
                    names, n = np.unique(kinds[:, a:b], return_counts=True)
                    out.append((names.tobytes(), n.astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[first:end]), pa.array(ids[first:end], pa.int64()), *(pa.array(list(c), pa.binary()) for c in zip(*out))],
                    names=["label", "doc_id", "names", "n"],
                )

    return rows.mapInArrow(extract, "label int, doc_id long, names binary, n binary")


def _texts_with(batches):
    """Of each feature, how many texts of this batch have it, with label 0 and with another."""
    for batch in batches:
        each = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("names").to_pylist()]
        if sum(map(len, each)):
            bad = np.repeat(batch.column("label").to_numpy() > 0, [len(e) for e in each])
            names, at = np.unique(np.concatenate(each), return_inverse=True)
            with_bad = np.bincount(at, weights=bad, minlength=len(names)).astype(np.int64)
            with_any = np.bincount(at, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(with_bad), pa.array(with_any - with_bad)], names=["name", "bad", "good"])


def fit(rows: DataFrame) -> Ordinal:
    """Fit on a bounded sample (label, doc_id, text).

    Features are made, counted and screened on the executors; the driver gets the
    chosen features and their occurrences in the sample.
    """
    none = Ordinal(np.zeros(0, dtype=np.uint64), np.zeros(0), np.full(2, 30.0))
    made = stored(_features_of(rows), "toxicity-sample")
    sizes = {r["label"]: r["count"] for r in made.groupBy("label").count().collect()}
    n_bad = sum(n for y, n in sizes.items() if y > 0)
    if len(sizes) < 2 or not n_bad:
        return none
    counts = made.select("label", "names").mapInArrow(_texts_with, "name long, bad long, good long").groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (sum(sizes.values()) - n_bad + 1))
    z = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    screened = counts.withColumn("odds", odds).withColumn("z", z).filter((F.col("bad") + F.col("good") >= LEAST_TEXTS) & (F.col("odds") > 0))
    top = screened.orderBy(F.desc("z"), "name").limit(MOST_FEATURES).collect()
    if not top:
        return none
    names = np.array([r["name"] for r in top], dtype=np.int64).view(np.uint64)
    marked = np.array([r["odds"] > 2 and r["z"] > 4 for r in top])
    order = np.argsort(names)
    names, marked = names[order], marked[order]

    def chosen(batches):
        for batch in batches:
            out = []
            for x, n in zip(batch.column("names").to_pylist(), batch.column("n").to_pylist()):
                x, n = np.frombuffer(x, dtype=np.uint64), np.frombuffer(n, dtype=np.int32)
                at = np.minimum(np.searchsorted(names, x), len(names) - 1)
                hit = names[at] == x
                out.append((at[hit].astype(np.int32).tobytes(), n[hit].tobytes()))
            cols = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("doc_id"), *(pa.array(list(c), pa.binary()) for c in cols)], names=["label", "doc_id", "at", "n"])

    found = sorted(map(tuple, made.mapInArrow(chosen, "label int, doc_id long, at binary, n binary").collect()), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2], r[3]))
    y = np.array([r[0] for r in found])
    col = np.concatenate([np.frombuffer(r[2], dtype=np.int32) for r in found]).astype(np.int64)
    times = np.concatenate([np.frombuffer(r[3], dtype=np.int32) for r in found])
    row = np.repeat(np.arange(len(found)), [len(r[2]) // 4 for r in found])
    bad = y > 0
    if y.max() == 1:
        hits = np.bincount(row, weights=marked[col] * times, minlength=len(y))
        y = np.where(bad, 1 + (hits > np.median(hits[bad])), 0)
    y = np.unique(y, return_inverse=True)[1]
    return _train(names, row, col, _weight(times), y)


def score(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """doc_id, severity (expected grade), grade (most probable), p_toxic (grade 1 or more), toxic of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        m = shared.value
        for batch in batches:
            at_least = m.grades(m.scores(batch.column("text")))
            one = np.ones((len(at_least), 1))
            each = np.diff(np.hstack([-one, -at_least, 0 * one]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(at_least.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(at_least[:, 0]), pa.array(at_least[:, 0] >= reject)],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(rate, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, all columns, whose probability of grade 1 or more is below ``reject``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        m = shared.value
        for batch in batches:
            at_least = m.grades(m.scores(batch.column(at).cast(pa.string())))
            yield batch.filter(pa.array(at_least[:, 0] < reject))

    return text_batches(docs).mapInArrow(keep, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the severity of all documents, learned from a sample of the labels."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(labelled(docs, labels)))
