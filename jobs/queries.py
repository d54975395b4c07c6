"""The jobs as registered queries over the test tables, and the same in DuckDB SQL.

Each runs its job twice into one new folder, and returns what is there after the second run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import evaluate_answers, refresh_index
from tarnwick.functions.text import REFUSAL
from tarnwick.plans.queries import _CLASS, _K, _MATCH, _NORMAL, _PAIRS, _Q, _SPARSE, _TITLE, _TOKENS, _WORDS
from tarnwick.session import new_table_path


def _refreshed(spark: SparkSession, sf_dir: str, folder: str, runs: int) -> str:
    for _ in range(runs):  # a table is a folder or a file; a pattern stands for both
        refresh_index.refresh(spark, f"{sf_dir}/documents.parquet*", f"{folder}/index", f"{folder}/checkpoint")
    return f"{folder}/index"


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents as it stands after a run over all of them and a run over nothing new."""
    index = refresh_index.load(spark, _refreshed(spark, sf_dir, new_table_path(spark, "job1"), 2))
    return index.select(
        "passage_id", "title", "lang", "batch", F.length("text").cast("long").alias("n_chars"), F.size("embedding").cast("long").alias("dimensions"),
        F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"),
    )


def job2_evaluate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of all questions after two runs, each with the figures of its class."""
    folder = new_table_path(spark, "job2")
    index = _refreshed(spark, sf_dir, folder, 1)
    for _ in range(2):
        evaluate_answers.run(spark, f"{sf_dir}/conversations.parquet", index, f"{folder}/report")
    results, classes, titles = evaluate_answers.load(spark, f"{folder}/report")
    classes = classes.select("class", F.col("n").alias("class_n"), F.round("exact_match", 6).alias("class_match"), F.col("supported").alias("class_supported"), F.col("refused").alias("class_refused"))
    titles = titles.groupBy("class").agg(F.count(F.lit(1)).alias("class_titles"), F.sum("n").alias("class_retrieved"))
    out = results.join(F.broadcast(classes), "class").join(F.broadcast(titles), "class", "left")  # a row per class
    return out.select(
        "conv_id", "turn", "class", "predicted", F.col("exact_match").cast("long").alias("exact_match"), "verdict", F.round("confidence", 6).alias("confidence"), "n_passages", "best_score",
        "class_n", "class_match", "class_supported", "class_refused", F.coalesce("class_titles", F.lit(0)).alias("class_titles"), F.coalesce("class_retrieved", F.lit(0)).alias("class_retrieved"),
    )


QUERIES = {"job1_refresh_index": job1_refresh_index, "job2_evaluate_answers": job2_evaluate_answers}

_INDEX = f"""
f as materialized (select doc_id, lang, title, text from (select *, row_number() over (partition by title order by doc_id, text, lang) as nth
  from (select doc_id, lang, text, {_TITLE} as title from documents where text is not null)) where nth = 1),
v as materialized ({_SPARSE.format(buckets=256, id='doc_id', tokens=_TOKENS, table='f')})"""
ORACLE_SQL = {
    "job1_refresh_index": f"""
with {_INDEX}
select doc_id as passage_id, title, lang, cast(0 as bigint) as batch, length(text) as n_chars, cast(256 as bigint) as dimensions, round(coalesce(w, 0), 6) as first
from f left join (select id, w from v where b = 0) on id = doc_id""",
    "job2_evaluate_answers": f"""
with {_INDEX},
t as materialized (select row_number() over (order by conv_id, turn) as id, conv_id, turn, question as text, answer as gold from ({_PAIRS})),
s as (select q.id as qid, d.id as did, round(sum(q.w * d.w), 9) as score from ({_SPARSE.format(buckets=256, id='id', tokens=_TOKENS, table='t')}) q join v d using (b) group by all),
r as materialized (select * from (select t.id as qid, class, f.doc_id as did, f.title, coalesce(score, 0) as score, row_number() over (partition by t.id order by coalesce(score, 0) desc, f.doc_id) as rank
  from (select *, {_CLASS} as class from t) t cross join f left join s on s.qid = t.id and s.did = f.doc_id) where rank <= {_K.format('class')}),
said as (select t.*, {_CLASS} as class, coalesce(case when score >= 0.4 then title end, {_Q(REFUSAL)}) as answer, score from t left join (select qid, title, score from r where rank = 1) on qid = id),
w as materialized (select doc_id as did, {_WORDS.format(_NORMAL("(title || ' ' || text)"))} as words from f),
seen as (select qid, flatten(list(words)) as seen, count(*) as n from r join w using (did) group by 1),
checked as (select *, {_MATCH('answer', 'gold')} as m, case when len(own) > 0 then len(list_intersect(own, coalesce(seen, []))) / len(own) else 0 end as confidence
  from (select *, {_WORDS.format(_NORMAL('answer'))} as own from said) left join seen on qid = id),
judged as (select *, case when confidence >= 0.8 then 'SUPPORTED' when confidence >= 0.3 then 'PARTIAL' else 'UNSUPPORTED' end as verdict from checked)
select conv_id, turn, class, answer as predicted, cast(m as bigint) as exact_match, verdict, round(confidence, 6) as confidence, coalesce(n, 0) as n_passages, round(score, 6) as best_score,
  count(*) over c as class_n, round(avg(m) over c, 6) as class_match, count(*) filter (verdict = 'SUPPORTED') over c as class_supported, count(*) filter (answer = {_Q(REFUSAL)}) over c as class_refused,
  coalesce(titles, 0) as class_titles, coalesce(retrieved, 0) as class_retrieved
from judged left join (select class, count(distinct did) as titles, count(*) as retrieved from r group by 1) using (class) window c as (partition by class)""",
}
