"""A verifier that is trained: is an answer supported by the passages it was given?

Features compare an answer with each passage: the shares of its words, of its pairs and
triples of neighbouring words that the passage has, in steps of a tenth, crossed with
each other, the number of its words that are missing, its numbers that are missing, and
its length. For a question the best passage counts, feature by feature. Every feature is
present or absent, so an example is a short list of feature numbers.

The model is multinomial logistic regression. Each step of its optimiser (limited-memory
quasi-Newton with a line search) is one pass over the examples, in which every partition
sums its own loss and gradient; what reaches the driver is one sum per weight. Sums are
of whole numbers of a small unit, so that they are the same in whatever order and
partitions the examples come, and so is the model. Equal examples are counted before the first pass. The confidence is the probability of the
verdict after dividing scores by a temperature, the one that makes a held-out fold most
likely. A model is a table of (verdict, feature, weight) with the temperature beside it.

Defined results: a null answer or text is empty; an empty answer has no words and is
told by that alone; without passages all shares are 0; rows of null labels are not
learned from; training without examples is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions.text import normalize_answer
from tarnwick.session import drop_stored, stored

VERDICTS = ("SUPPORTED", "PARTIAL", "UNSUPPORTED")
#: Steps of a share, and the numbers of missing words, of missing numbers and of words that are told apart.
STEPS, MISSING, NUMBERS, LENGTHS = 11, 8, 4, 6
#: Where each kind of feature begins; the first is always present.
_KINDS = {"one": 1, "words": STEPS, "pairs": STEPS, "triples": STEPS, "words_pairs": STEPS * STEPS, "pairs_triples": STEPS * STEPS, "missing": MISSING, "numbers": NUMBERS, "length": LENGTHS}
FEATURES = sum(_KINDS.values())
_AT = dict(zip(_KINDS, np.cumsum([0, *_KINDS.values()])[:-1].tolist()))
#: Strength of the pull of weights towards zero, steps at most, and the gain in mean loss that ends them.
RIDGE, MOST_STEPS, LEAST_GAIN, MEMORY = 1e-4, 60, 1e-6, 8
#: The largest loss of an example that a sum tells apart. With the default pull no example of a step that is taken comes near it.
MOST_LOSS = 2.0**14
TEMPERATURES = tuple(round(0.25 * 1.12**i, 6) for i in range(32))
_MODEL = "verdict string, feature int, weight double"


def word_list(text: Column) -> Column:
    """Words of a text, lower-case and without punctuation."""
    return F.filter(F.split(normalize_answer(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """All different runs of n words."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def overlaps(answers: DataFrame, passages: DataFrame, by: str = "query_id", on: str | None = None) -> DataFrame:
    """``by`` and the features' raw numbers: n, n_numbers, s1, s2, s3, missing, missing_numbers; shares are the best over the answer's passages.

    Answers (``by``, answer) meet passages (title, text) by ``on``, a column of both, or else
    by ``by``; only numbers are kept of a pair, so no texts of several passages ever meet
    in one row, and a passage of several answers moves once. A run of the
    answer is looked for in the passage's words, written with one space between them.
    """
    keys = [by] if on in (None, by) else [by, on]
    own = answers.select(*keys, word_list(F.col("answer")).alias("own"))
    own = own.select(*keys, F.array_distinct("own").alias("w1"), _runs(F.col("own"), 2).alias("w2"), _runs(F.col("own"), 3).alias("w3"))
    own = own.withColumn("w0", F.filter("w1", lambda w: w.rlike("^[0-9]+$")))
    line = F.concat(F.lit(" "), F.regexp_replace(normalize_answer(F.concat_ws(" ", "title", "text")), r"\s+", " "), F.lit(" "))
    pairs = own.join(passages.select(keys[-1], line.alias("seen")), keys[-1], "left").withColumn("seen", F.coalesce("seen", F.lit("")))
    common = lambda mine: F.size(F.filter(mine, lambda w: F.contains(F.col("seen"), F.concat(F.lit(" "), w, F.lit(" ")))))
    found = pairs.select(by, *[F.size(f"w{i}").alias(f"n{i}") for i in range(4)], *[common(f"w{i}").alias(f"c{i}") for i in range(4)])
    found = found.groupBy(by).agg(*[F.max(c).alias(c) for c in found.columns if c != by])
    share = lambda i: F.when(F.col(f"n{i}") > 0, F.col(f"c{i}") / F.col(f"n{i}")).otherwise(F.lit(0.0)).alias(f"s{i}")
    return found.select(
        by, F.col("n1").alias("n"), F.col("n0").alias("n_numbers"), share(1), share(2), share(3), (F.col("n1") - F.col("c1")).alias("missing"), (F.col("n0") - F.col("c0")).alias("missing_numbers")
    )


def features(numbers: DataFrame, by: str = "query_id") -> DataFrame:
    """``by`` and ``features``, the numbers of those that are present."""
    step = lambda c: F.floor(F.col(c) * (STEPS - 1) + 1e-9).cast("int")
    upto = lambda c, most: F.least(c, F.lit(most - 1)).cast("int")
    length = F.when(F.col("n") == 0, 0).otherwise(F.least(F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double"))) + 1, F.lit(LENGTHS - 1))).cast("int")
    s1, s2, s3 = step("s1"), step("s2"), step("s3")
    at = lambda kind, i: (F.lit(_AT[kind]) + i).cast("int")
    return numbers.select(
        by,
        F.array(
            at("one", F.lit(0)), at("words", s1), at("pairs", s2), at("triples", s3), at("words_pairs", s1 * STEPS + s2), at("pairs_triples", s2 * STEPS + s3),
            at("missing", upto(F.col("missing"), MISSING)), at("numbers", upto(F.col("missing_numbers"), NUMBERS)), at("length", length),
        ).alias("features"),
    )


def unit_of(n: int) -> float:
    """How many parts of one are counted in sums over ``n`` examples: gradients stay below 2**49, losses below 2**63."""
    return 2.0 ** (48 - int(n).bit_length())


def whole(losses: np.ndarray, count: np.ndarray, unit: float) -> int:
    """The sum of counted losses in whole units."""
    return int(np.rint(count * np.minimum(losses, MOST_LOSS) * unit).astype(np.int64).sum())


def loss_and_gradient(weights: np.ndarray, feature: np.ndarray, label: np.ndarray, count: np.ndarray, unit: float | None = None) -> tuple[float, np.ndarray]:
    """Sum of the negative log-likelihood of counted examples, and its gradient; ``feature`` has a row per example.

    With ``unit`` both are whole numbers of units: each example's part is rounded, and what is summed is exact.
    """
    scores = weights[:, feature].sum(axis=2).T
    top = scores.max(axis=1, keepdims=True)
    odds = np.exp(scores - top)
    total = odds.sum(axis=1, keepdims=True)
    own = np.arange(len(label))
    losses = np.log(total[:, 0]) + top[:, 0] - scores[own, label]
    loss = whole(losses, count, unit) if unit else float((count * losses).sum())
    error = odds / total
    error[own, label] -= 1
    error *= count[:, None]
    if unit:
        error = np.rint(error * unit)
    gradient = np.stack([np.bincount(feature.ravel(), weights=np.repeat(error[:, c], feature.shape[1]), minlength=weights.shape[1]) for c in range(len(weights))])
    return loss, gradient


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = batch.column("features")
    flat = wide.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(wide), -1) if len(wide) else np.zeros((0, 1), dtype=np.int64), batch.column("label").to_numpy(), batch.column("n").to_numpy().astype(float)


def _summed(examples: DataFrame, width: int, values) -> np.ndarray:
    """The sum over all batches of ``values(features, labels, counts)``, an array of ``width`` whole numbers: partition by partition, then by place."""

    def run(batches):
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += values(*_arrays(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["i", "x"])

    out = np.zeros(width)
    for r in examples.mapInArrow(run, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():  # a row per number
        out[r["i"]] = r["x"]
    return out


@dataclass(frozen=True)
class Model:
    """Weights by verdict and feature, and the temperature of the confidence."""

    weights: np.ndarray
    temperature: float = 1.0

    def write(self, spark: SparkSession, path: str) -> None:
        """As a table; the temperature is the row without a verdict."""
        c, f = np.nonzero(self.weights)
        rows = pa.table({"verdict": [VERDICTS[i] for i in c] + [None], "feature": [int(i) for i in f] + [0], "weight": self.weights[c, f].tolist() + [self.temperature]})
        spark.createDataFrame(rows).selectExpr("verdict", "cast(feature as int) as feature", "weight").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Model:
        weights, temperature = np.zeros((len(VERDICTS), FEATURES)), 1.0
        for r in spark.read.schema(_MODEL).parquet(path).collect():  # a row per weight
            if r["verdict"] is None:
                temperature = r["weight"]
            else:
                weights[VERDICTS.index(r["verdict"]), r["feature"]] = r["weight"]
        return cls(weights, temperature)

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds verdict and confidence to rows with ``features``, by expressions alone."""
        score = lambda c: F.aggregate(F.transform("features", lambda f: F.element_at(F.array(*[F.lit(float(x)) for x in self.weights[c]]), f + 1)), F.lit(0.0), lambda s, x: s + x)
        scores = rows.withColumn("_scores", F.array(*[score(c) for c in range(len(VERDICTS))])).withColumn("_top", F.array_max("_scores"))
        place = F.array_position("_scores", F.col("_top")).cast("int")  # of equal scores the first verdict
        odds = F.aggregate(F.transform("_scores", lambda s: F.exp((s - F.col("_top")) / self.temperature)), F.lit(0.0), lambda s, x: s + x)
        verdict = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), place)
        return scores.withColumn("verdict", verdict).withColumn("confidence", 1.0 / odds).drop("_scores", "_top")


def minimise(f, start: np.ndarray, steps: int = MOST_STEPS, gain: float = LEAST_GAIN) -> np.ndarray:
    """The minimum of a smooth function that returns value and gradient, by limited-memory quasi-Newton steps."""
    x, (value, slope) = start, f(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = slope.copy(), []
        for s, y in reversed(past):
            a = (s * d).sum() / (s * y).sum()
            d -= a * y
            kept.append(a)
        d *= (past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2).sum() if past else 1.0 / max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(past, reversed(kept)):
            d += s * (a - (y * d).sum() / (s * y).sum())
        down, length = (slope * d).sum(), 1.0
        if down <= 0:
            break
        while True:
            new = x - length * d
            after, new_slope = f(new)
            if after <= value - 1e-4 * length * down or length < 1e-6:
                break
            length /= 2
        if (s := new - x) is not None and ((y := new_slope - slope) * s).sum() > 1e-12:
            past = [*past[-(MEMORY - 1):], (s, y)]
        done = value - after < gain
        if after < value:
            x, value, slope = new, after, new_slope
        if done:
            break
    return x


def fit(examples: DataFrame, held_out: DataFrame, ridge: float = RIDGE) -> Model:
    """A model from examples (``features``, ``verdict``), its temperature from the held-out ones."""
    label = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict")).cast("int") - 1
    counted = lambda rows: rows.filter("verdict is not null").groupBy("features", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    learned, fold = stored(counted(examples), "verifier-examples"), stored(counted(held_out), "verifier-fold")
    n = learned.agg(F.sum("n")).head()[0]
    if not n:
        raise ValueError("there is no example to learn from")
    shape, unit = (len(VERDICTS), FEATURES), unit_of(n)
    of_fold = unit_of(fold.agg(F.sum("n")).head()[0] or 0)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        def values(feature, label, count):
            loss, gradient = loss_and_gradient(w.reshape(shape), feature, label, count, unit)
            return np.append(np.int64(loss), gradient.ravel().astype(np.int64))

        total = _summed(learned, 1 + w.size, values) / (n * unit)
        return total[0] + ridge * (w**2).sum() / 2, total[1:] + ridge * w

    weights = minimise(objective, np.zeros(shape[0] * shape[1])).reshape(shape)

    def by_temperature(feature, label, count):
        scores = weights[:, feature].sum(axis=2).T
        out = []
        for t in TEMPERATURES:
            z = scores / t
            top = z.max(axis=1)
            out.append(whole(np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(label)), label], count, of_fold))
        return np.array(out)

    losses = _summed(fold, len(TEMPERATURES), by_temperature)
    temperature = TEMPERATURES[int(np.argmin(losses))] if losses.any() else 1.0
    drop_stored(learned, fold)
    return Model(weights, temperature)


def verify_with(model: Model):
    """A check of answers against retrieved passages, for the loop: query_id, verdict, confidence."""

    def check(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
        return model.scored(features(overlaps(answers, retrieved))).select("query_id", "verdict", "confidence")

    return check
