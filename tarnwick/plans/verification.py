"""Train, test and evaluate the verifier.

    python -m tarnwick.plans.verification train PASSAGES MODEL
    python -m tarnwick.plans.verification eval PASSAGES MODEL
    python -m tarnwick.plans.verification test MODEL --answer TEXT --context TEXT

PASSAGES is a Parquet table of passage_id, title and text; MODEL is the folder of the
model's table. Training examples are made of the passages themselves, as no labelled
answers are at hand: for each passage, answers that it supports, that it supports in
part, and that it does not, each kind made in two ways (see ``made_answers``). A tenth of
the passages is never learned from, and ``eval`` reports on all of it. Another tenth sets
the temperature of the confidence, and all others are learned from.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import metrics
from tarnwick.operators.verifier import Model, features, fit, overlaps, word_list
from tarnwick.session import drop_stored, local_session, stored

#: Words of a made answer, the folds of passages (0 is evaluated, 1 sets the temperature, the rest is learned from), and passages of a ring.
ANSWER_WORDS, FOLDS, RING = 12, 10, 1000


def hashed(purpose: str) -> Column:
    """A number below 2**48 that depends on the passage's id alone; SQL can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(purpose), F.col("passage_id").cast("string"))), 1, 12), 16, 10).cast("long")


def fold() -> Column:
    return F.pmod(hashed("fold"), F.lit(FOLDS))


def runs(passages: DataFrame) -> DataFrame:
    """passage_id, run, next, other: two runs of words that follow each other in a passage, and one of another passage; stored.

    The other passage is that of the next hash, within buckets of hashes, so that a passage
    meets one other and no more, whatever their number. Passages of too few words give none.
    """
    n = ANSWER_WORDS
    # Words are made once: what comes out of a generator is not made again where it is filtered.
    rows = passages.select("passage_id", F.explode(F.array(word_list(F.concat_ws(" ", "title", "text")))).alias("w")).filter(F.size("w") >= 2 * n)
    place = F.pmod(hashed("place"), F.size("w") - (2 * n - 1)).cast("int") + 1
    rows = stored(rows.select("passage_id", F.slice("w", place, n).alias("run"), F.slice("w", place + n, n).alias("next")), "verifier-runs")
    buckets, order = max(1, rows.count() // RING), hashed("order")
    keyed = rows.select("passage_id", "run", F.pmod(order, F.lit(buckets)).alias("bucket"), order.alias("o"))
    ring = keyed.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("o", "passage_id", "run"))).alias("r"))  # about RING a bucket
    ring = ring.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("r")), lambda i: F.struct(F.element_at("r", i)["passage_id"].alias("passage_id"), F.element_at("r", i % F.size("r") + 1)["run"].alias("other")))).alias("x"))
    out = stored(rows.join(ring.select("x.passage_id", "x.other"), "passage_id"), "verifier-runs")
    drop_stored(rows)
    return out


def made_answers(found: DataFrame) -> DataFrame:
    """example_id, passage_id, kind, verdict, answer: six answers for every passage of ``runs``.

    said: a run of the passage's words; said_short: half as many. half: a run of which the
    second half is from another passage; half_scattered: half a run, and other words of
    the passage in no order of its own. other: a run of another passage. swapped: the
    passage's own words, each moved away from its neighbours, so that all are there and
    nothing that they say is.
    """
    text = lambda words: F.array_join(words, " ")
    half = ANSWER_WORDS // 2
    # Every second word of two runs, backwards: no two of them are neighbours in the passage.
    far = F.filter(F.concat("run", "next"), lambda w, i: i % 2 == 0)
    made = [
        ("said", "SUPPORTED", text("run")), ("said_short", "SUPPORTED", text(F.slice("run", 1, half))),
        ("half", "PARTIAL", text(F.concat(F.slice("run", 1, half), F.slice("other", 1, half)))),
        ("half_scattered", "PARTIAL", text(F.concat(F.slice("run", 1, half), F.slice(F.reverse(far), 1, half)))),
        ("other", "UNSUPPORTED", text("other")), ("swapped", "UNSUPPORTED", text(F.reverse(far))),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("verdict"), a.alias("answer")) for k, v, a in made])).alias("m")
    return found.select("passage_id", each).select(F.concat_ws(" ", F.col("passage_id").cast("string"), "m.kind").alias("example_id"), "passage_id", "m.kind", "m.verdict", "m.answer")


def examples(passages: DataFrame, wanted: Column, found: DataFrame | None = None) -> DataFrame:
    """Made answers with their features and the passage's fold, of the passages that are wanted; any other may lend them words.

    ``found`` are the passages' ``runs``, if they are at hand.
    """
    answers = stored(made_answers((runs(passages) if found is None else found).filter(wanted)), "verifier-answers")
    seen = features(overlaps(answers, passages.filter(wanted), "example_id", "passage_id"), "example_id")
    return answers.join(seen, "example_id").withColumn("fold", fold())


def train(passages: DataFrame, path: str, found: DataFrame | None = None) -> Model:
    """Fit on all passages of all folds but two, set the temperature on all of one, write the model."""
    rows = stored(examples(passages, fold() > 0, found), "verifier-made")
    model = fit(rows.filter("fold > 1"), rows.filter("fold = 1"))
    model.write(passages.sparkSession, path)
    drop_stored(rows)
    return model


def judged(passages: DataFrame, path: str, found: DataFrame | None = None) -> DataFrame:
    """Answers made of the passages that are never learned from, with the stored model's verdict (``predicted``) and confidence."""
    rows = examples(passages, fold() == 0, found).withColumnRenamed("verdict", "label")
    return Model.read(passages.sparkSession, path).scored(rows).withColumnRenamed("verdict", "predicted").select("example_id", "passage_id", "kind", "label", "predicted", "confidence")


def report(rows: DataFrame) -> DataFrame:
    """label, n, right, mean confidence, and the macro F1 and accuracy over all of them."""
    rows = stored(rows, "verifier-judged")
    each = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("predicted")).cast("long")).alias("right"), F.avg("confidence").alias("confidence"))
    return each.crossJoin(F.broadcast(metrics.macro_f1(rows).crossJoin(metrics.accuracy(rows))))  # one row


def tested(spark: SparkSession, path: str, answer: str, context: str) -> tuple[str, float]:
    """Verdict and confidence of one answer and its context."""
    answers = spark.createDataFrame([(0, answer)], "query_id long, answer string")
    passages = spark.createDataFrame([(0, None, context)], "query_id long, title string, text string")
    row = Model.read(spark, path).scored(features(overlaps(answers, passages))).head()
    return row["verdict"], row["confidence"]


def main(arguments: list[str] | None = None, show=print) -> None:
    ask = argparse.ArgumentParser(prog="tarnwick.plans.verification", description=__doc__.split("\n")[0])
    ask.add_argument("mode", choices=("train", "eval", "test"))
    ask.add_argument("paths", nargs="+", help="PASSAGES MODEL, or MODEL alone for test")
    ask.add_argument("--answer", default="")
    ask.add_argument("--context", default="")
    given = ask.parse_args(arguments)
    if len(given.paths) != (1 if given.mode == "test" else 2):
        ask.error("PASSAGES MODEL, or MODEL alone for test")
    spark, model = local_session(), given.paths[-1]
    if given.mode == "test":
        verdict, confidence = tested(spark, model, given.answer, given.context)
        show(f"{verdict} (confidence {confidence:.4f})")
        return
    passages = spark.read.parquet(given.paths[0])
    if given.mode == "train":
        train(passages, model)
    for r in report(judged(passages, model)).orderBy("label").collect():  # a row per verdict
        show(f"{r['label']}: {r['right']} of {r['n']} right, mean confidence {r['confidence']:.4f}; macro F1 {r['macro_f1']:.4f}, accuracy {r['accuracy']:.4f}")


if __name__ == "__main__":
    main()
