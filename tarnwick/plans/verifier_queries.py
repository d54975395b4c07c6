"""The trained verifier as registered queries over the test tables, and the same in SQL where nothing is fitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import generate
from tarnwick.operators.embed import HashingEmbedder, embed
from tarnwick.operators.retrieve import top_k, with_passages
from tarnwick.operators.verifier import overlaps, verify_with
from tarnwick.plans import agent, verification
from tarnwick.plans.queries import _NORMAL, _TITLE, _benchmark, _documents, _index, _said, _search
from tarnwick.schemas import Config
from tarnwick.session import new_table_path, stored
from tarnwick.sources.tables import table


def _passages(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), F.split("text", "\n")[0].alias("title"), "text")


def verifier_answers(spark, d):
    """The answers made of every document, with their verdicts and the document's fold."""
    return verification.made_answers(verification.runs(_passages(spark, d))).select("example_id", "verdict", "answer", verification.fold().alias("fold"))


def verifier_overlaps(spark, d):
    """What the verifier sees of the answer to every benchmark item, and of the item itself, against the passages retrieved for it."""
    e, index, items = HashingEmbedder(256), _index(spark, d), _benchmark(spark, d)
    found = stored(with_passages(top_k(embed(items, e, keep=("query_id",)), index, 10), index), "overlaps-found")
    said = generate.stub_answers(items, found, Config().threshold)
    out = None
    for kind, answers in (("answer", said), ("item", items.withColumnRenamed("text", "answer"))):
        one = overlaps(answers, found).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    shares = [F.round(s, 6).alias(s) for s in ("s1", "s2", "s3")]
    return out.select("query_id", "kind", *[F.col(c).cast("long").alias(c) for c in ("n", "n_numbers", "missing", "missing_numbers")], *shares)


def verifier_eval(spark, d):
    """Train on made answers of the documents, store the model, judge those of held-out documents with it."""
    passages, path = _passages(spark, d), new_table_path(spark, "verifier")
    found = verification.runs(passages)
    verification.train(passages, path, found)
    return verification.report(verification.judged(passages, path, found))


def agent_loop_trained(spark, d):
    """Every benchmark item through the loop, its answers checked by a verifier that is trained on the documents."""
    model = verification.train(_passages(spark, d), new_table_path(spark, "verifier"))
    e, index = HashingEmbedder(256), _index(spark, d)

    def retrieve(pending):
        found = with_passages(top_k(embed(pending, e, keep=("query_id",)), index, max(agent.TOP_K.values())), index)
        return agent.adaptive(found, pending)

    return agent.agent_loop(_benchmark(spark, d), retrieve, lambda q, found: generate.stub_answers(q, found, Config().threshold), verify_with(model), Config().max_iterations)


QUERIES = {f.__name__: f for f in (verifier_answers, verifier_overlaps, verifier_eval, agent_loop_trained)}

_N, _HALF = verification.ANSWER_WORDS, verification.ANSWER_WORDS // 2
_HASH = lambda purpose: f"cast('0x' || substr(md5('{purpose}' || passage_id), 1, 12) as bigint)"
_LIST = lambda x: rf"list_filter(string_split_regex({_NORMAL(x)}, '\s+'), lambda t: t != '')"
_JOIN = lambda x: f"array_to_string({x}, ' ')"
_RUNS = lambda n: f"list_distinct(list_transform(range(1, len(own) - {n - 2}), lambda i: array_to_string(own[i:i + {n - 1}], ' ')))"
_COMMON = lambda w: f"len(list_filter({w}, lambda t: contains(seen, ' ' || t || ' ')))"
_BEST = lambda w: f"max({_COMMON(w)})"
_SHARE = lambda w: f"round(case when len(any_value({w})) > 0 then {_BEST(w)} / len(any_value({w})) else 0 end, 6)"
ORACLE_SQL = {
    "verifier_answers": rf"""
with p as (select doc_id as passage_id, {_LIST(f"({_TITLE} || ' ' || text)")} as w from documents),
r as (select *, {_HASH('place')} % (len(w) - {2 * _N - 1}) + 1 as place, {_HASH('order')} as o from p where len(w) >= {2 * _N}),
s as (select *, w[place:place + {_N - 1}] as run, w[place + {_N}:place + {2 * _N - 1}] as nxt, o % greatest(1, (select count(*) from r) // {verification.RING}) as bucket from r),
t as (select *, coalesce(lead(run) over (partition by bucket order by o, passage_id), first_value(run) over (partition by bucket order by o, passage_id)) as other,
  list_reverse(list_filter(list_concat(run, nxt), lambda x, i: i % 2 = 1)) as far from s),
a as (select passage_id, unnest([
    {{'kind': 'said', 'verdict': 'SUPPORTED', 'answer': {_JOIN('run')}}}, {{'kind': 'said_short', 'verdict': 'SUPPORTED', 'answer': {_JOIN(f'run[1:{_HALF}]')}}},
    {{'kind': 'half', 'verdict': 'PARTIAL', 'answer': {_JOIN(f'list_concat(run[1:{_HALF}], other[1:{_HALF}])')}}},
    {{'kind': 'half_scattered', 'verdict': 'PARTIAL', 'answer': {_JOIN(f'list_concat(run[1:{_HALF}], far[1:{_HALF}])')}}},
    {{'kind': 'other', 'verdict': 'UNSUPPORTED', 'answer': {_JOIN('other')}}}, {{'kind': 'swapped', 'verdict': 'UNSUPPORTED', 'answer': {_JOIN('far')}}}]) as m from t)
select passage_id || ' ' || m.kind as example_id, m.verdict, m.answer, {_HASH('fold')} % {verification.FOLDS} as fold from a""",
    "verifier_overlaps": rf"""
with {_documents()}, {_search('r', 'benchmark', 'item_id')}, {_said('said', 'benchmark', 'item_id', 'r')},
line as (select did, ' ' || regexp_replace({_NORMAL("(title || ' ' || text)")}, '\s+', ' ', 'g') || ' ' as seen from dt where did in (select did from r)),
a as (select 'answer' as kind, query_id, answer from said union all select 'item', item_id, text from benchmark),
b as (select *, {_LIST('answer')} as own from a), c as (select *, list_distinct(own) as w1, {_RUNS(2)} as w2, {_RUNS(3)} as w3 from b),
e as (select *, list_filter(w1, lambda t: regexp_matches(t, '^[0-9]+$')) as w0 from c)
select query_id, kind, any_value(len(w1)) as n, any_value(len(w0)) as n_numbers, any_value(len(w1)) - {_BEST('w1')} as missing, any_value(len(w0)) - {_BEST('w0')} as missing_numbers,
  {_SHARE('w1')} as s1, {_SHARE('w2')} as s2, {_SHARE('w3')} as s3 from e join r on qid = query_id join line using (did) group by query_id, kind""",
}
