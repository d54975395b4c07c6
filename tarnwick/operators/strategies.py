"""Ways to retrieve that a class of question asks for: two hops, a search for each thing compared, and feedback.

Two hops: a passage that answers in part often names the next one. Titles that are
mentioned in the passages found first are bridges; the question is asked again with each
bridge, and the lists are fused by reciprocal ranks. Mentions are found by an equality
join: every run of up to ``TITLE_WORDS`` words of a found passage meets the titles
that have as many words. A passage's runs are made once, whatever the number of
questions that found it, and each run meets one title at most, so no pair of a
passage and a title that it does not mention is ever looked at.

Comparison: the question is cut at its "or" or "and" into the two things named; each is
searched for by itself, and the lists are read in turns, so that neither thing crowds out
the other.

Feedback: a question that found no support is asked again with the words that weigh most
in the passages it found.

Defined results: ties go by passage id, of bridges by title; a title without words is no
bridge, nor is one that a question has found already; a question without a bridge, or
without two things, keeps its plain list; passages of score 0 take no part in a fusion; null questions find what empty ones do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.functions.text import normalize_answer
from tarnwick.operators.embed import embed
from tarnwick.operators.retrieve import PLACES, ranked, top_k
from tarnwick.session import stored

#: Words of a title that can be a bridge, bridges of a question, and the constant of reciprocal ranks.
TITLE_WORDS, BRIDGES, RANK_BASE = 8, 3, 60
#: Words that feedback adds to a question, and the letters of the shortest of them.
FEEDBACK_TERMS, TERM_LETTERS = 5, 4
#: Two things, each of up to four words, around the first "or" or "and" (group 1 and group 2).
TWO_THINGS = r"((?:[^\s,;:.?!]+ ){0,3}[^\s,;:.?!]+) (?:or|and) ((?:[^\s,;:.?!]+ ){0,3}[^\s,;:.?!]+)"
#: Words that only ask.
ASKING = r"\b(what|which|who|where|when|was|were|is|are|the|of|did|does)\b|[?]"


def _words(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _runs(n: int) -> Column:
    """All runs of n words of column w."""
    starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))


def search(questions: DataFrame, index: DataFrame, embedder, k: int) -> DataFrame:
    """query_id, rank, passage_id, score of questions (query_id, text)."""
    return top_k(embed(questions, embedder, keep=("query_id",)), index, k)


def bridges(found: DataFrame, index: DataFrame, most: int = BRIDGES, title_words: int = TITLE_WORDS) -> DataFrame:
    """query_id, place (from 1), bridge: the titles that a question's passages mention.

    The best-ranked passage's first; of one passage the longest title, then by title.
    """
    titles = index.select("passage_id", _words(F.col("title")).alias("w")).filter(F.size("w").between(1, title_words))
    titles = titles.select("passage_id", F.array_join("w", " ").alias("bridge"), F.size("w").alias("n"))
    own = found.select("query_id", "rank", "passage_id")
    read = index.select("passage_id", "text").join(own.select("passage_id").distinct(), "passage_id", "left_semi").select("passage_id", _words(F.col("text")).alias("w"))
    runs = read.select("passage_id", F.explode(F.array_distinct(F.concat(*[_runs(n) for n in range(1, title_words + 1)]))).alias("bridge"))
    mentions = runs.join(titles.select("bridge", "n").distinct(), "bridge")
    said = own.join(mentions, "passage_id").groupBy("query_id", "bridge", "n").agg(F.min("rank").alias("rank"))
    there = own.join(titles.select("passage_id", "bridge"), "passage_id").select("query_id", "bridge").distinct()
    new = said.join(there, ["query_id", "bridge"], "left_anti")
    order = W.partitionBy("query_id").orderBy("rank", F.desc("n"), "bridge")
    return new.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("query_id", "place", "bridge")


def fused(lists: DataFrame, k: int) -> DataFrame:
    """query_id, rank, passage_id, score: lists (query_id, passage_id, rank) of each question, by the sum of reciprocal ranks."""
    score = F.round(F.sum(1.0 / (RANK_BASE + F.col("rank"))), PLACES).alias("score")
    return ranked(lists.groupBy("query_id", "passage_id").agg(score), k)


def two_hops(questions: DataFrame, index: DataFrame, embedder, k: int = 10, most: int = BRIDGES) -> DataFrame:
    """query_id, rank, passage_id, score (of the fusion) of questions that are asked again with each bridge."""
    first = stored(search(questions, index, embedder, k), "hop-1")
    # A number for each follow-up, written once, so that it is the same wherever it is read.
    more = bridges(first, index, most).join(questions, "query_id").withColumn("follow", F.monotonically_increasing_id())
    more = stored(more.select("query_id", "follow", F.concat_ws(" ", "text", "bridge").alias("text")), "follow-ups")
    second = search(more.select(F.col("follow").alias("query_id"), "text"), index, embedder, k).withColumnRenamed("query_id", "follow")
    second = second.join(more.select("follow", "query_id"), "follow")
    # A passage that has nothing in common with what was asked gains no rank from being listed.
    own = lambda rows: rows.filter("score > 0").select("query_id", "passage_id", "rank")
    return fused(own(first).unionByName(own(second)), k)


def things(question: Column) -> Column:
    """What a question compares, as an array of two texts without words that ask; the question alone, if it names no two things."""
    short = lambda i: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(question, TWO_THINGS, i)), ASKING, " "), r"\s+", " "))
    return F.when((F.length(short(1)) > 0) & (F.length(short(2)) > 0), F.array(short(1), short(2))).otherwise(F.array(question))


def compared(questions: DataFrame, index: DataFrame, embedder, k: int = 10) -> DataFrame:
    """query_id, rank, passage_id, score (the best of any list): the lists of the things compared, read in turns."""
    parts = questions.select("query_id", F.posexplode(things(F.col("text"))).alias("part", "text")).withColumn("asked", F.monotonically_increasing_id())
    parts = stored(parts, "compared-things")
    found = search(parts.select(F.col("asked").alias("query_id"), "text"), index, embedder, k).withColumnRenamed("query_id", "asked")
    found = found.join(parts.select("asked", "query_id", "part"), "asked")
    turn = F.struct("rank", "part")
    once = found.groupBy("query_id", "passage_id").agg(F.min(turn).alias("turn"), F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("turn")  # a turn names one list and one place in it
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "passage_id", "score")


def feedback_terms(questions: DataFrame, retrieved: DataFrame, most: int = FEEDBACK_TERMS) -> DataFrame:
    """query_id, place (from 1), term, weight: the words that speak most for a question's passages and are not in it.

    A word weighs the sum over the passages of its share of their words times their
    scores, times the logarithm of one more than the questions asked per question in whose
    passages it occurs. Words of less than ``TERM_LETTERS`` letters do not count; passages of score 0 say nothing.
    """
    words = lambda x: F.filter(_words(x), lambda w: F.length(w) >= TERM_LETTERS)
    read = retrieved.filter("score > 0").join(questions.select("query_id"), "query_id", "left_semi").select("query_id", "score", words(F.concat_ws(" ", "title", "text")).alias("w"))
    each = read.filter(F.size("w") > 0).select("query_id", (F.col("score") / F.size("w")).alias("part"), F.explode("w").alias("term"))
    sums = each.groupBy("query_id", "term").agg(F.sum("part").alias("tf"))
    asked = questions.agg(F.count(F.lit(1)).alias("asked"))  # one row
    spread = sums.groupBy("term").agg(F.count(F.lit(1)).alias("in_questions")).crossJoin(F.broadcast(asked))
    own = questions.select("query_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    new = sums.join(spread, "term").join(own, ["query_id", "term"], "left_anti")
    new = new.withColumn("weight", F.round(F.col("tf") * F.log(1 + F.col("asked") / F.col("in_questions")), PLACES))
    order = W.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return new.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("query_id", "place", "term", "weight")


def widened(questions: DataFrame, retrieved: DataFrame, most: int = FEEDBACK_TERMS) -> DataFrame:
    """query_id and text: questions without words that only ask, and with the feedback terms of their passages."""
    terms = feedback_terms(questions, retrieved, most)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda t: t["term"]), " ")
    short = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), ASKING, " "), r"\s+", " "))
    kept = F.when(F.length(short) > 0, short).otherwise(F.col("text"))
    added = terms.groupBy("query_id").agg(listed.alias("terms"))
    return questions.join(added, "query_id", "left").select("query_id", F.concat_ws(" ", kept, "terms").alias("text"))
