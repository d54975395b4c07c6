"""Retrieval by class of question as registered queries over the test tables, and the same in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tarnwick.operators import generate, strategies
from tarnwick.operators.embed import HashingEmbedder
from tarnwick.operators.retrieve import with_passages
from tarnwick.plans import agent
from tarnwick.plans.queries import _CLASS, _K, _NORMAL, _SHORT, _benchmark, _documents, _found, _index, _questions, _said, _search, _verified
from tarnwick.plans.queries import ORACLE_SQL as _SQL
from tarnwick.schemas import Config
from tarnwick.session import new_table_path, stored


def _listed(found):
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "passage_id", F.round("score", 6).alias("score"))


def retrieve_two_hop(spark, d):
    """Every benchmark item over two hops: bridges are titles that its first passages mention."""
    return _listed(strategies.two_hops(_benchmark(spark, d), _index(spark, d), HashingEmbedder(256)))


def bridge_titles(spark, d):
    """The bridges of every benchmark item."""
    index = _index(spark, d)
    found = strategies.search(_benchmark(spark, d), index, HashingEmbedder(256), 10)
    return strategies.bridges(found, index).select("query_id", F.col("place").cast("long").alias("place"), "bridge")


def retrieve_compared(spark, d):
    """Every benchmark item as a comparison of what stands around its first "or" or "and"."""
    return _listed(strategies.compared(_benchmark(spark, d), _index(spark, d), HashingEmbedder(256)))


def _phrased(spark, d):
    """Benchmark items phrased as questions of each class in turn: as they are, after a word that asks for two hops, and as two halves to compare."""
    w = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
    part = lambda a: F.regexp_replace(F.array_join(F.slice(w, a, 3), " "), "[,;:.?!]", "")
    text = F.when(F.col("query_id") % 3 == 0, F.col("text")).when(F.col("query_id") % 3 == 1, F.concat(F.lit("Who is the director of "), F.col("text")))
    return _benchmark(spark, d).select("query_id", text.otherwise(F.concat(F.lit("Which is older, "), part(1), F.lit(" or "), part(4), F.lit("?"))).alias("text"))


def retrieve_by_class(spark, d):
    """Questions of all classes, each retrieved as its class asks for."""
    return _listed(agent.retrieve_by_class(_phrased(spark, d), _index(spark, d), HashingEmbedder(256)))


def reformulated_questions(spark, d):
    """Every benchmark item with the words that speak for the passages it finds."""
    items, index = _benchmark(spark, d), _index(spark, d)
    found = with_passages(strategies.search(items, index, HashingEmbedder(256), 10), index)
    return strategies.widened(items, stored(found, "feedback-found"))


def agent_loop_feedback(spark, d):
    """Every benchmark item through the loop that asks again with feedback."""
    e, index = HashingEmbedder(256), _index(spark, d)
    retrieve = lambda q: stored(agent.adaptive(with_passages(strategies.search(q, index, e, max(agent.TOP_K.values())), index), q), "feedback-found")
    answer = lambda q, found: generate.stub_answers(q, found, Config().threshold)
    return agent.agent_loop(_benchmark(spark, d), retrieve, answer, max_iterations=Config().max_iterations, again=strategies.widened)


def _failing_service():
    """A stand-in for a service: it answers with the prompt's hash, but for one prompt in ten it fails."""

    def ask(text: str) -> str:
        h = hashlib.md5(text.encode()).hexdigest()
        if int(h[:4], 16) % 10 == 0:
            raise ConnectionError("busy")
        return f" {h} "

    return ask


def answers_kept(spark, d):
    """Prompts of all questions answered by a service that fails for some, twice over the same kept answers."""
    prompted, folder = generate.prompts(_questions(spark, d), _found(spark, d)), new_table_path(spark, "kept-answers")
    prompted = stored(prompted.select("query_id", "prompt"), "prompted")
    for _ in range(2):
        said = generate.kept_answers(prompted, _failing_service, folder, tries=1, slice_rows=200)
    return said


QUERIES = {f.__name__: f for f in (retrieve_two_hop, bridge_titles, retrieve_compared, retrieve_by_class, reformulated_questions, agent_loop_feedback, answers_kept)}

_JOINED = lambda x: rf"array_to_string(list_filter(string_split_regex({_NORMAL(x)}, '\s+'), lambda t: t != ''), ' ')"
_COUNT = lambda x: f"len(string_split({x}, ' '))"
_RE = lambda x: x.replace("'", "''")


def _bridges(name: str, found: str) -> str:
    """CTEs, the last of them ``name``: qid, place, bridge of the lists in ``found``."""
    return rf"""
titled as materialized (select did, {_JOINED('title')} as bridge from dt), short as materialized (select did, bridge, {_COUNT('bridge')} as n from titled where bridge != '' and {_COUNT('bridge')} <= {strategies.TITLE_WORDS}),
line as (select did, string_split({_JOINED('text')}, ' ') as w from dt where did in (select did from {found})),
run as (select distinct did, array_to_string(w[i:i + n - 1], ' ') as bridge from (select did, w, unnest(range(1, len(w) + 1)) as i from line), unnest(range(1, {strategies.TITLE_WORDS + 1})) u(n) where i + n - 1 <= len(w)),
said as (select qid, bridge, n, min(rank) as rank from {found} join run using (did) join (select distinct bridge, n from short) using (bridge) group by all),
{name} as materialized (select qid, place, bridge from (select *, row_number() over (partition by qid order by rank, n desc, bridge) as place from said
  where not exists (select 1 from {found} f join short using (did) where f.qid = said.qid and short.bridge = said.bridge)) where place <= {strategies.BRIDGES})"""


def _two_hops(name: str, questions: str, key: str, found: str) -> str:
    """CTEs, the last of them ``name``: qid, rank, did, score of the fusion."""
    return f"""{_bridges('bridged', found)},
follow as materialized (select row_number() over () as fid, qid, text || ' ' || bridge as text from bridged join (select {key} as qid, text from {questions}) using (qid)),
{_search('second', 'follow', 'fid')},
lists as (select qid, did, rank from {found} where score > 0 union all select f.qid, did, rank from second s join follow f on s.qid = fid where score > 0),
{name} as (select * from (select *, row_number() over (partition by qid order by score desc, did) as rank from
  (select qid, did, round(sum(1.0::double / ({strategies.RANK_BASE} + rank)), 9) as score from lists group by all)) where rank <= 10)"""


_THING = lambda i: rf"trim(regexp_replace(regexp_replace(lower(regexp_extract(text, '{_RE(strategies.TWO_THINGS)}', {i})), '{strategies.ASKING}', ' ', 'g'), '\s+', ' ', 'g'))"


def _compared(name: str, questions: str, key: str) -> str:
    """CTEs, the last of them ``name``: qid, rank, did, score of lists that are read in turns."""
    return f"""
cut as (select {key} as qid, text, {_THING(1)} as a, {_THING(2)} as b from {questions}),
thing as materialized (select row_number() over () as tid, qid, part, text from (
  select qid, 0 as part, case when a != '' and b != '' then a else text end as text from cut union all select qid, 1, b from cut where a != '' and b != '')),
{_search('each', 'thing', 'tid')},
{name} as (select * from (select *, row_number() over (partition by qid order by turn) as rank from
  (select t.qid, did, min((rank, part)) as turn, max(score) as score from each e join thing t on e.qid = tid group by all)) where rank <= 10)"""


def _widened(name: str, questions: str, found: str) -> str:
    """CTEs, the last of them ``name``: qid, text of ``questions`` (qid, text) with the feedback of the lists in ``found``."""
    split = lambda x: rf"list_filter(string_split_regex({_NORMAL(x)}, '\s+'), lambda t: t != '')"
    return rf"""
{name}_read as (select qid, score, list_filter({split("(title || ' ' || text)")}, lambda t: length(t) >= {strategies.TERM_LETTERS}) as w from {found} join dt using (did) where score > 0 and qid in (select qid from {questions})),
{name}_sums as materialized (select qid, term, sum(part) as tf from (select qid, score / len(w) as part, unnest(w) as term from {name}_read where len(w) > 0) group by all),
{name}_new as (select s.qid, term, round(tf * ln(1 + (select count(*) from {questions}) / n), 9) as weight from {name}_sums s join (select term, count(*) as n from {name}_sums group by 1) using (term)
  join (select qid, {split('text')} as own from {questions}) q on q.qid = s.qid where not list_contains(own, term)),
{name}_terms as (select qid, string_agg(term, ' ' order by place) as terms from (select *, row_number() over (partition by qid order by weight desc, term) as place from {name}_new) where place <= {strategies.FEEDBACK_TERMS} group by 1),
{name} as materialized (select qid, concat_ws(' ', case when length({_SHORT}) > 0 then regexp_replace({_SHORT}, '\s+', ' ', 'g') else text end, terms) as text from {questions} left join {name}_terms using (qid))"""


def _feedback_loop() -> str:
    """CTEs of the loop with feedback; the last, ``looped``, has query_id, status, answer, iterations, confidence."""
    parts, last = ["p1 as (select item_id as qid, text from benchmark)"], Config().max_iterations
    for i in range(1, last + 1):
        parts += [
            _search(f"r{i}", f"p{i}", "qid"), f"k{i} as materialized (select r{i}.* from r{i} join p{i} using (qid) where rank <= {_K.format(_CLASS)})",
            _said(f"a{i}", f"p{i}", "qid", f"k{i}"), _verified(f"v{i}", f"a{i}", f"k{i}"), f"q{i} as materialized (select qid, text from p{i} join v{i} on qid = query_id where confidence < 0.8)",
        ]
        if i < last:
            parts.append(_widened(f"p{i + 1}", f"q{i}", f"k{i}"))
    ends = [f"select query_id, 'SUPPORTED' as status, answer, {i} as iterations, confidence from v{i} where confidence >= 0.8" for i in range(1, last + 1)]
    ends.append(f"select query_id, 'ABSTAINED' as status, null as answer, {last} as iterations, confidence from v{last} where confidence < 0.8")
    return ",\n".join([*parts, "looped as (" + " union all ".join(ends) + ")"])


_LISTED = "select qid as query_id, rank, did as passage_id, round(score, 6) as score from"
_PART = lambda a: f"regexp_replace(array_to_string(w[{a}:{a + 2}], ' '), '[,;:.?!]', '', 'g')"
ORACLE_SQL = {
    "retrieve_two_hop": f"with {_documents()}, {_search('r', 'benchmark', 'item_id')}, {_two_hops('fused', 'benchmark', 'item_id', 'r')} {_LISTED} fused",
    "bridge_titles": f"with {_documents()}, {_search('r', 'benchmark', 'item_id')}, {_bridges('b', 'r')} select qid as query_id, place, bridge from b",
    "retrieve_compared": f"with {_documents()}, {_compared('turns', 'benchmark', 'item_id')} {_LISTED} turns",
    "retrieve_by_class": f"""
with {_documents()}, w as (select item_id as id, text, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x != '') as w from benchmark),
asked as materialized (select *, {_CLASS} as class from (select id, case id % 3 when 0 then text when 1 then 'Who is the director of ' || text else 'Which is older, ' || {_PART(1)} || ' or ' || {_PART(4)} || '?' end as text from w)),
plain as (select * from asked where class = 'SIMPLE'), hops as (select * from asked where class = 'MULTI_HOP'), both_ as (select * from asked where class = 'COMPARISON'),
{_search('p', 'plain', 'id')}, {_search('h', 'hops', 'id')}, {_two_hops('fused', 'hops', 'id', 'h')}, {_compared('turns', 'both_', 'id')}
{_LISTED} (select qid, rank, did, score from (select p.*, class from p join asked on id = qid) where rank <= {_K.format('class')}
  union all select qid, rank, did, score from fused union all select qid, rank, did, score from turns)""",
    "reformulated_questions": f"""
with {_documents()}, b as (select item_id as qid, text from benchmark), {_search('r', 'benchmark', 'item_id')}, {_widened('wide', 'b', 'r')} select qid as query_id, text from wide""",
    "agent_loop_feedback": f"with {_documents()}, {_feedback_loop()} select query_id, status, answer, cast(iterations as int) as iterations, confidence from looped",
    "answers_kept": f"""
select query_id, case when cast('0x' || substr(h, 1, 4) as int) % 10 != 0 then h end as answer, case when cast('0x' || substr(h, 1, 4) as int) % 10 = 0 then 'ConnectionError: busy' end as error
from (select query_id, md5(prompt) as h from ({_SQL['prompt_full']}))""",
}
