"""Registered queries over the test tables, and the same in DuckDB SQL.

Every query runs over its whole tables. Questions of the vector search are the rows
whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from tarnwick.functions.text import REFUSAL, exact_match, normalize_answer, passage_block, py_strip
from tarnwick.operators import bounded, evaluate, generate, metrics, passages, vectors
from tarnwick.operators.embed import HashingEmbedder, embed
from tarnwick.operators.retrieve import gathered, top_k, top_k_sql, with_passages
from tarnwick.plans import agent, rag, stages
from tarnwick.schemas import Config
from tarnwick.session import new_table_path, stored
from tarnwick.sources import index as index_
from tarnwick.sources.tables import examples_from_documents, question_answer_pairs, questions_from_lines, read_examples, table, write_examples
from tarnwick.streaming.questions import answer_stream, asked_once, read_questions

#: Documented sample questions with their classes (fixed values).
SAMPLES = (
    ("COMPARISON", "Were Scott Derrickson and Ed Wood of the same nationality?"),
    ("COMPARISON", "Which magazine was started first, Arthur's Magazine or First for Women?"),
    ("COMPARISON", "Who is older, Elvis Presley or Michael Jackson?"),
    ("COMPARISON", "Which band was formed first, Radiohead or Coldplay?"),
    ("MULTI_HOP", "Who directed the film Sinister?"),
    ("MULTI_HOP", "Who wrote the novel that the film The Shining is based on?"),
    ("MULTI_HOP", "Who founded the company that makes the iPhone?"),
    ("MULTI_HOP", "What nationality is the director of the film Saw?"),
    ("SIMPLE", "What year was the Eiffel Tower built?"),
    ("SIMPLE", "Who wrote the play Hamlet?"),
    ("SIMPLE", "When was Wikipedia founded?"),
    ("SIMPLE", "Where was Albert Einstein born?"),
)
CAPS = (-1, 0, 1, 10, 55, 300, 926, 1_000_000)


def _flat(spark, d):
    return passages.flatten(examples_from_documents(table(spark, d, "documents")))


def passages_flatten(spark, d):
    return _flat(spark, d)


def passages_first_seen(spark, d):
    return passages.first_seen(_flat(spark, d)).select("example_ord", "pos", "title", "text")


def passages_capped(spark, d):
    return passages.capped_by(_flat(spark, d), CAPS).select("cap", "example_ord", "pos", "title")


def passages_capped_early(spark, d):
    """The passages of a cap from examples that are sorted by their order, read only as far as the cap needs."""
    path = new_table_path(spark, "sorted-examples")
    write_examples(examples_from_documents(table(spark, d, "documents")).repartitionByRange("example_ord").sortWithinPartitions("example_ord"), path, "train")
    found, read = passages.capped_early(read_examples(spark, path, "train"), 300, first=8)
    return found.select("example_ord", "pos", "title", F.lit(read).cast("long").alias("examples_read"))


def unique_passages(spark, d):
    return passages.unique(_flat(spark, d))


def examples_scan(spark, d):
    """The examples written as one split, the question pairs as another; the first read back by its name alone."""
    path = new_table_path(spark, "examples")
    write_examples(examples_from_documents(table(spark, d, "documents")), path, "train")
    write_examples(_numbered_pairs(spark, d).withColumnRenamed("query_id", "example_ord"), path, "validation")
    examples = read_examples(spark, path, "train")
    return examples.select("example_ord", F.size("context.title").cast("long").alias("n_titles"), F.size("context.sentences").cast("long").alias("n_texts"))


def typed_questions(spark, d):
    """Benchmark items as typed lines, each followed by a blank one, read back as questions."""
    path = new_table_path(spark, "typed")
    line = F.translate("text", "\n\r", "  ")
    rows = table(spark, d, "benchmark").select("item_id", F.explode(F.array(F.struct(F.lit(0).alias("i"), line.alias("value")), F.struct(F.lit(1).alias("i"), F.lit(" \t ").alias("value")))).alias("x"))
    rows.select("item_id", "x.i", "x.value").repartition(1).sortWithinPartitions("item_id", "i").select("value").write.text(path)  # a typed file
    return questions_from_lines(spark, path)


def l2_normalize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("passage_id"), "embedding")


def _asked(v):
    return v.filter("passage_id % 100 = 0").select(F.col("passage_id").alias("query_id"), "embedding")


def _rounded(found):
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "passage_id", F.round("score", 6).alias("score"))


def retrieve_topk_dense(spark, d):
    v = _vectors(spark, d)
    return _rounded(top_k(_asked(v), v, 10))


def retrieve_topk_bounded(spark, d):
    """The same by the search that skips what its bounds rule out."""
    v = _vectors(spark, d)
    return _rounded(bounded.top_k(_asked(v), v, 10))


def retrieve_topk_expressions(spark, d):
    v = _vectors(spark, d)
    return _rounded(top_k_sql(_asked(v), v, 10))


def retrieve_topk_text(spark, d):
    e = HashingEmbedder(1024)
    docs = embed(table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text"), e, keep=("passage_id",))
    asked = embed(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), e, keep=("query_id",))
    found = top_k(asked, docs, 10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "passage_id", F.round("score", 4).alias("score"))


def _found(spark, d, k=10):
    """Retrieved passages for the question vectors: documents stand for the passages, without the question itself."""
    v = _vectors(spark, d)
    title = F.split("text", "\n")[0]
    p = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), title.alias("title"), "text")
    # Vectors without a document of their id are no passages.
    own = v.join(p.select("passage_id"), "passage_id", "left_semi")
    return with_passages(top_k(_asked(v), own, k, skip_same=True), p)


def _questions(spark, d):
    return _asked(_vectors(spark, d)).select("query_id", F.concat(F.lit("Question "), F.col("query_id").cast("string")).alias("text"))


def prompt_context(spark, d):
    return generate.contexts(_found(spark, d))


def prompt_full(spark, d):
    return generate.prompts(_questions(spark, d), _found(spark, d))


def normalized_answers(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize_answer(F.col("text")).alias("normalized"))


def stripped_turns(spark, d):
    padded = F.concat(F.lit(" \t\u00a0"), F.col("text"), F.lit("\u2003\n "))
    return table(spark, d, "conversations").select("conv_id", "turn", py_strip(padded).alias("text"))


def _predicted(spark, d):
    """Pairs with a prediction: the answer in other writing for even pairs, the question for the rest."""
    p = question_answer_pairs(table(spark, d, "conversations"))
    even = (F.col("conv_id") + F.col("turn")) % 2 == 0
    said = F.when(even, F.concat(F.lit(" "), F.lower("answer"), F.lit("!? "))).otherwise(F.col("question"))
    return p.select("conv_id", "turn", "question", F.col("answer").alias("gold"), said.alias("predicted"))


def question_pairs(spark, d):
    return question_answer_pairs(table(spark, d, "conversations"))


def exact_match_eval(spark, d):
    return evaluate.scored(_predicted(spark, d)).select("conv_id", "turn", F.col("exact_match").cast("long").alias("exact_match"))


def eval_summary(spark, d):
    return evaluate.summary(evaluate.scored(_predicted(spark, d)))


def eval_sample_prefix(spark, d):
    first = evaluate.sample_prefix(_predicted(spark, d), Config().num_samples, ["conv_id", "turn"])
    return evaluate.scored(first).select("conv_id", "turn", F.col("exact_match").cast("long").alias("exact_match"))


def eval_report_line(spark, d):
    return evaluate.report_lines(evaluate.scored(_predicted(spark, d)))


def eval_report_files(spark, d):
    """The report written as JSON and read back."""
    path = new_table_path(spark, "report")
    rows = evaluate.scored(_predicted(spark, d)).select("conv_id", "turn", "gold", "predicted", "exact_match")
    evaluate.write_report(rows, path)
    back = spark.read.schema("conv_id long, turn long, gold string, predicted string, exact_match long").json(f"{path}/results")
    mean = spark.read.schema("n long, exact_match double").json(f"{path}/summary").select(F.col("exact_match").alias("mean"))
    return back.crossJoin(F.broadcast(mean)).select("conv_id", "turn", "exact_match", F.round("mean", 6).alias("mean"))  # one row


def rag_answer_stub(spark, d):
    return generate.stub_answers(_questions(spark, d), _found(spark, d), Config().threshold)


def retrieved_titles(spark, d):
    t = gathered(_found(spark, d)).select("query_id", F.array_join(F.transform("retrieved", lambda r: r["title"]), " | ").alias("titles"))
    return t


def report_blocks(spark, d):
    found = _found(spark, d)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), passage_block(F.col("rank"), F.col("title"), F.col("text")).alias("block"))


def _labels(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("predicted"))


def macro_f1(spark, d):
    return metrics.macro_f1(_labels(spark, d)).select(F.round("macro_f1", 9).alias("macro_f1"))


def accuracy(spark, d):
    return metrics.accuracy(_labels(spark, d))


def query_class_samples(spark, d):
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(SAMPLES)], "id long, label string, text string")
    return rows.select("id", "label", agent.query_class(F.col("text")).alias("predicted"))


def query_class(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'user'")
    c = agent.query_class(F.col("text"))
    return rows.select("conv_id", "turn", c.alias("class"), agent.top_k_of(c).cast("long").alias("k"))


def index_build_load(spark, d):
    """Build an index, load it again with the same configuration, and rebuild it with another."""
    path, docs = new_table_path(spark, "index"), table(spark, d, "documents")
    make = lambda: docs.select(F.col("doc_id").alias("passage_id"), F.split("text", "\n")[0].alias("title"), "text")
    rows = []
    for dim in (64, 64, 32):
        config = Config(dimensions=dim).index_fields()
        found, built = index_.build_or_load(spark, path, make, HashingEmbedder(dim), config)
        rows.append((len(rows), built, vectors.dimension(found), index_.size(found)))
    return spark.createDataFrame(rows, "step long, built boolean, dimensions long, vectors long")


def index_of_changed_source(spark, d):
    """An index that looks at its source: built, loaded, loaded when the rows were only dealt anew, and rebuilt when one row is missing or one text is another."""
    path, docs = new_table_path(spark, "index"), table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("passage_id"), F.split("text", "\n")[0].alias("title"), "text")
    least = rows.agg(F.min("passage_id")).head()[0]
    first = F.col("passage_id") == least
    sources = [rows, rows, rows.repartition(7, "title"), rows.filter(~first), rows.withColumn("text", F.when(first, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), rows]
    out = []
    for source in sources:
        found, built = index_.build_or_load(spark, path, lambda source=source: source, HashingEmbedder(16), Config(dimensions=16).index_fields(), check_source=True)
        out.append((len(out), built, index_.size(found)))
    return spark.createDataFrame(out, "step long, built boolean, vectors long")


def _index(spark, d):
    path, docs = new_table_path(spark, "index"), table(spark, d, "documents")
    make = lambda: docs.select(F.col("doc_id").alias("passage_id"), F.split("text", "\n")[0].alias("title"), "text")
    return index_.build_or_load(spark, path, make, HashingEmbedder(256), Config(dimensions=256).index_fields())[0]


def index_from_examples(spark, d):
    """The index of the documents as nested examples, with a cap of passages; built, then read."""
    config = Config(dimensions=64, max_passages=300)
    found, _ = index_.from_examples(spark, new_table_path(spark, "index"), examples_from_documents(table(spark, d, "documents")), HashingEmbedder(64), config)
    return found.select("passage_id", "title", F.length("text").cast("long").alias("n_chars"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def _benchmark(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _asked_with_blanks(spark, d):
    """Every benchmark item, and a blank question beside each."""
    questions = _benchmark(spark, d)
    blanks = questions.select((-1 - F.col("query_id")).alias("query_id"), F.lit(" \t\u00a0 ").alias("text"))
    return rag.ask(questions.unionByName(blanks), _index(spark, d), HashingEmbedder(256), Config(dimensions=256))


def rag_questions(spark, d):
    """Every benchmark item asked of all documents; one row each, passages in rank order."""
    ids = F.array_join(F.transform("retrieved", lambda r: r["passage_id"].cast("string")), ",")
    return _asked_with_blanks(spark, d).select("query_id", F.size("retrieved").cast("long").alias("n_retrieved"), ids.alias("passage_ids"), "answer")


def rag_results(spark, d):
    """The nested results, a row for each passage."""
    out = _asked_with_blanks(spark, d).select("query_id", F.explode("retrieved").alias("r"), "answer")
    return out.select("query_id", F.col("r.rank").cast("long").alias("rank"), "r.passage_id", "r.title", F.length("r.text").cast("long").alias("n_chars"), F.round("r.score", 6).alias("score"), "answer")


def rag_report(spark, d):
    """What the console shows of each question."""
    return rag.shown(_asked_with_blanks(spark, d))


def _evaluated(spark, d):
    return rag.evaluate_questions(_numbered_pairs(spark, d), _index(spark, d), HashingEmbedder(256), Config(dimensions=256, num_samples=None))


def evaluate_rag(spark, d):
    """Every question pair answered through retrieval and scored."""
    titles = F.array_join(F.transform("retrieved_titles", lambda t: F.coalesce(t, F.lit(""))), " | ")
    return _evaluated(spark, d).select("question", "gold", "predicted", F.col("exact_match").cast("long").alias("exact_match"), titles.alias("retrieved_titles"))


def eval_report_object(spark, d):
    """The evaluation as one JSON object in one file, written, read back and taken apart."""
    path = new_table_path(spark, "report-object")
    evaluate.write_report_object(stored(_evaluated(spark, d), "evaluated"), path, ["query_id"], leave_out=("query_id",))
    back = evaluate.read_report_object(spark, path).select(F.round("exact_match", 6).alias("mean"), F.posexplode("results").alias("place", "r"))
    return back.select(F.col("place").cast("long").alias("place"), "r.question", "r.predicted", F.col("r.exact_match").cast("long").alias("exact_match"), F.size("r.retrieved_titles").cast("long").alias("n_titles"), "mean")


def _numbered_pairs(spark, d):
    """The question pairs with a query_id for each row, in order of conv_id and turn; stored, so that a row keeps its number."""
    pairs = question_answer_pairs(table(spark, d, "conversations")).orderBy("conv_id", "turn")
    return stored(pairs.select(F.monotonically_increasing_id().alias("query_id"), "question", "answer"), "pairs")


def stage_comparison(spark, d):
    """Exact match of fixed and of class-wise retrieval over the question pairs, and the passages that each reads."""
    pairs = _numbered_pairs(spark, d).select("query_id", F.col("question").alias("text"), F.col("answer").alias("gold"))
    e = HashingEmbedder(256)
    index = _index(spark, d)
    found = stored(with_passages(top_k(embed(pairs, e, keep=("query_id",)), index, 10), index).drop("text"), "compared")
    out = None
    for stage, rows in ((1, found), (3, agent.adaptive(found, pairs))):
        said = generate.stub_answers(pairs, rows, Config().threshold)
        read = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("read"), F.sum(F.col("passage_id") * F.col("rank")).alias("ids"))
        one = pairs.join(said, "query_id").join(read, "query_id", "left").select(
            F.lit(stage).alias("stage"), exact_match(F.col("answer"), F.col("gold")).alias("exact_match"), "read", "ids"
        )
        out = one if out is None else out.unionByName(one)
    return out.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.avg("exact_match").alias("exact_match"), F.sum("read").alias("n_passages"), F.sum("ids").alias("ids_by_rank")
    )


def agent_loop(spark, d):
    """Every benchmark item through the loop of answering, verifying and asking again."""
    e, index = HashingEmbedder(256), _index(spark, d)
    questions = _benchmark(spark, d)

    def retrieve(pending):
        found = with_passages(top_k(embed(pending, e, keep=("query_id",)), index, max(agent.TOP_K.values())), index)
        return agent.adaptive(found, pending)

    return agent.agent_loop(questions, retrieve, lambda q, found: generate.stub_answers(q, found, Config().threshold), max_iterations=Config().max_iterations)


def four_stage_eval(spark, d):
    """All four stages over all question pairs."""
    pairs = _numbered_pairs(spark, d)
    return stages.compared(stages.four_stages(pairs, _index(spark, d), HashingEmbedder(256), Config(dimensions=256, num_samples=None)))


def question_stream(spark, d):
    """All users' turns as a stream of questions, each micro-batch classified by the batch plan."""
    source, out, checkpoint = (new_table_path(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text").write.parquet(source)
    answer = lambda batch: batch.select("conv_id", "turn", agent.query_class(F.col("text")).alias("class"))
    answer_stream(read_questions(spark, source, "conv_id long, turn long, text string"), answer, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("conv_id", "turn", "class")


def question_stream_answers(spark, d):
    """All benchmark items as a stream that delivers each of them twice, every question answered once through retrieval."""
    source, out, checkpoint = (new_table_path(spark, f"answers-{x}") for x in ("in", "out", "checkpoint"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("query_id", F.lit(600)))
    items = _benchmark(spark, d).select("query_id", "text", at.alias("at"))
    half = F.col("query_id") % 2 == 0
    for part in (items.filter(half), items, items.filter(~half)):  # a delivery each; those after the first repeat questions
        part.coalesce(1).write.mode("append").parquet(source)
    index, e, config = _index(spark, d), HashingEmbedder(256), Config(dimensions=256)
    answer = lambda batch: rag.ask(batch, index, e, config).select("query_id", F.size("retrieved").cast("long").alias("n_retrieved"), "answer")
    questions = asked_once(read_questions(spark, source, "query_id long, text string, at timestamp", files_per_batch=1), ["query_id"], "at")
    answer_stream(questions, answer, out, checkpoint, with_state=True).awaitTermination()
    return spark.read.parquet(out).select("query_id", "n_retrieved", "answer")


QUERIES = {
    f.__name__: f
    for f in (
        examples_scan, typed_questions, passages_flatten, passages_first_seen, passages_capped, passages_capped_early, unique_passages, l2_normalize, retrieve_topk_dense, retrieve_topk_bounded, retrieve_topk_expressions, retrieve_topk_text,
        prompt_context, prompt_full, normalized_answers, stripped_turns, question_pairs, exact_match_eval, eval_summary, eval_sample_prefix,
        eval_report_line, eval_report_files, rag_answer_stub, retrieved_titles, report_blocks, macro_f1, accuracy, query_class_samples, query_class,
        index_build_load, index_of_changed_source, index_from_examples, rag_questions, rag_results, rag_report, evaluate_rag, eval_report_object, stage_comparison, agent_loop, four_stage_eval, question_stream, question_stream_answers,
    )
}

# --- the same in SQL -----------------------------------------------------------------

_TITLE = "string_split(text, chr(10))[1]"
_FLAT = f"select doc_id // 10 as example_ord, doc_id % 10 as pos, {_TITLE} as title, replace(text, chr(10), ' ') as text from documents"
_FIRST = f"select * from (select *, row_number() over (partition by title order by example_ord, pos) as nth from ({_FLAT})) where nth = 1"
_SCORES = """
select q.vec_id as query_id, v.vec_id as passage_id,
  list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double))) as score
from embeddings q, embeddings v where q.vec_id % 100 = 0"""
_DENSE = f"""
select query_id, rank, passage_id, round(score, 6) as score from
  (select *, row_number() over (partition by query_id order by score desc, passage_id) as rank from ({_SCORES})) where rank <= 10"""
_FOUND = f"""
select query_id, rank, title, text, score from (select query_id, passage_id, score,
    row_number() over (partition by query_id order by score desc, passage_id) as rank
  from ({_SCORES}) where query_id != passage_id and passage_id in (select doc_id from documents))
join (select doc_id as passage_id, {_TITLE} as title, text from documents) using (passage_id) where rank <= 10"""
_BLOCK = "'[' || rank || '] ' || title || ':' || chr(10) || text"
_PUNCT = string.punctuation.replace("'", "''")
_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\x0b\p{{Z}}]+', ''), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x0b\p{{Z}}]+$', '')"
_NORMAL = lambda x: _STRIP.format(f"translate(lower({x}), '{_PUNCT}', '')")
_PAIRS = """
select conv_id, turn, text as question, answer from (select *, lead(role) over w as next_role, lead(text) over w as answer
  from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant'"""
_PREDICTED = f"""
select conv_id, turn, answer as gold, case when (conv_id + turn) % 2 = 0 then ' ' || lower(answer) || '!? ' else question end as predicted from ({_PAIRS})"""
_SCORED = f"select *, cast({_NORMAL('predicted')} = {_NORMAL('gold')} as bigint) as exact_match from ({_PREDICTED})"
_CLASS = "case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{n}'" for n, p in agent.RULES) + " else 'SIMPLE' end"
_K = "case {} " + " ".join(f"when '{n}' then {k}" for n, k in agent.TOP_K.items()) + " end"
_PROMPT_PARTS = [f'Use nothing but the context below to answer. Where it does not hold the answer, reply "{REFUSAL}"\n\nContext:\n', "\n\nQuestion: ", "\n\nAnswer:"]
_Q = lambda x: "'" + x.replace("'", "''") + "'"
_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t != '')"
_SPARSE = """
select id, b, cast(cast(c / sqrt(sum(c * c) over (partition by id)) as float) as double) as w from (
  select id, cast('0x' || substr(md5(t), 1, 4) as int) % {buckets} as b, cast(count(*) as double) as c from (select {id} as id, unnest({tokens}) as t from {table}) group by all)"""
_NUMBERED = f"(select row_number() over (order by conv_id, turn) as id, question as text, answer as gold from ({_PAIRS}))"


def _documents(buckets: int = 256) -> str:
    """CTEs: the documents' vectors (dv), titles (dt) and the words that verification looks for (dw)."""
    words = _WORDS.format(_NORMAL(f"({_TITLE} || ' ' || text)"))
    return f"""
dv as materialized ({_SPARSE.format(buckets=buckets, id='doc_id', tokens=_TOKENS, table='documents')}),
dt as (select doc_id as did, {_TITLE} as title, text from documents), dw as materialized (select doc_id as did, {words} as words from documents)"""


def _search(name: str, questions: str, key: str, buckets: int = 256) -> str:
    """CTE ``name``: qid, did, score and rank of the ten best documents of each question, those without a common word included."""
    return f"""
{name} as materialized (select * from (select *, row_number() over (partition by qid order by score desc, did) as rank from (
  select q.id as qid, d.doc_id as did, coalesce(s.score, 0) as score from (select {key} as id from {questions}) q cross join documents d left join (
    select q.id as qid, d.id as did, round(sum(q.w * d.w), 9) as score
    from ({_SPARSE.format(buckets=buckets, id=key, tokens=_TOKENS, table=questions)}) q join dv d using (b) group by all) s on s.qid = q.id and s.did = d.doc_id)) where rank <= 10)"""


def _said(name: str, questions: str, key: str, found: str) -> str:
    """CTE ``name``: query_id and the stub's answer from the passages found."""
    return f"""
{name} as (select a.id as query_id, coalesce(case when score >= {Config().threshold} then title end, {_Q(REFUSAL)}) as answer
  from (select {key} as id from {questions}) a left join (select * from {found} where rank = 1) f on a.id = f.qid left join dt using (did))"""


def _verified(name: str, said: str, found: str) -> str:
    """CTE ``name``: query_id, answer and the share of the answer's words in the passages found."""
    return f"""
{name} as materialized (select query_id, answer, case when len(own) > 0 then len(list_intersect(own, coalesce(seen, []))) / len(own) else 0 end as confidence
  from (select *, {_WORDS.format(_NORMAL('answer'))} as own from {said}) left join (select qid, flatten(list(words)) as seen from {found} join dw using (did) group by qid) on qid = query_id)"""


def _loop(questions: str, key: str) -> str:
    """CTEs of the loop; the last, ``looped``, has query_id, status, answer, iterations, confidence."""
    parts, last = [f"p1 as (select {key} as qid, text from {questions})"], Config().max_iterations
    for i in range(1, last + 1):
        parts += [
            _search(f"r{i}", f"p{i}", "qid"), f"k{i} as (select r{i}.* from r{i} join p{i} using (qid) where rank <= {_K.format(_CLASS)})",
            _said(f"a{i}", f"p{i}", "qid", f"k{i}"), _verified(f"v{i}", f"a{i}", f"k{i}"),
            f"p{i + 1} as (select qid, {_SHORTER} as text from p{i} join v{i} on qid = query_id where confidence < 0.8)",
        ]
    ends = [f"select query_id, 'SUPPORTED' as status, answer, {i} as iterations, confidence from v{i} where confidence >= 0.8" for i in range(1, last + 1)]
    ends.append(f"select query_id, 'ABSTAINED' as status, null as answer, {last} as iterations, confidence from v{last} where confidence < 0.8")
    return ",\n".join([*parts, "looped as (" + " union all ".join(ends) + ")"])


_WORDS = r"list_distinct(list_filter(string_split_regex({}, '\s+'), lambda t: t != ''))"
_SHORT = r"trim(regexp_replace(lower(text), '\b(what|which|who|where|when|was|were|is|are|the|of|did|does)\b|[?]', ' ', 'g'))"
_SHORTER = rf"case when length({_SHORT}) > 0 then regexp_replace({_SHORT}, '\s+', ' ', 'g') else text end"
_CLASSWISE = lambda found, questions: f"(select f.* from {found} f join (select id as qid, text from {questions}) using (qid) where rank <= {_K.format(_CLASS)})"
_ITEMS = f"with {_documents()}, {_search('r', 'benchmark', 'item_id')}, {_said('said', 'benchmark', 'item_id', 'r')}"
_MATCH = lambda x, gold: f"cast({_NORMAL(x)} = {_NORMAL(gold)} as int)"
_EVALUATED = f"""
with t as {_NUMBERED}, {_documents()}, {_search('r', 't', 'id')}, {_said('said', 't', 'id', 'r')},
e as (select query_id, text as question, gold, answer as predicted, {_MATCH('answer', 'gold')} as m from said join t on id = query_id),
titles as (select qid as query_id, string_agg(coalesce(title, ''), ' | ' order by rank) as titles, count(*) as n_titles from r join dt using (did) group by 1)"""


ORACLE_SQL = {
    "passages_flatten": _FLAT,
    "passages_first_seen": f"select example_ord, pos, title, text from ({_FIRST})",
    "passages_capped": f"""
with f as ({_FIRST}), n as (select e.example_ord, count(f.title) as n from (select distinct doc_id // 10 as example_ord from documents) e left join f using (example_ord) group by 1),
b as (select example_ord, coalesce(sum(n) over (order by example_ord rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (order by example_ord) as o from n)
select cast(cap as bigint) as cap, example_ord, pos, title from f join b using (example_ord), unnest([{", ".join(map(str, CAPS))}]) c(cap) where o = 1 or before < cap""",
    "passages_capped_early": f"""
with f as ({_FIRST}), e as (select distinct doc_id // 10 as example_ord from documents), n as (select e.example_ord, count(f.title) as n from e left join f using (example_ord) group by 1),
b as (select example_ord, n, coalesce(sum(n) over (order by example_ord rows between unbounded preceding and 1 preceding), 0) as before from n),
u as (select example_ord, n, sum(n) over (order by example_ord) as upto, example_ord - (select min(example_ord) from e) as nth from b),
r as (select min(x) as x from (values (8), (40), (168), (680), (2728), (10920), (43688), (174760), (699048)) v(x) where coalesce((select max(upto) from u where nth < x), 0) >= 300 or x > (select max(nth) from u))
select example_ord, pos, title, (select count(*) from u where nth < (select x from r)) as examples_read from f join b using (example_ord) where before = 0 or before < 300""",
    "l2_normalize": """
select vec_id, i - 1 as i, round(case when n = 0 then x else x / n end, 6) as x from (
  select vec_id, unnest(range(1, len(embedding) + 1)) as i, unnest(list_transform(embedding, lambda x: cast(x as double))) as x,
    sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from embeddings)""",
    "retrieve_topk_dense": _DENSE,
    "retrieve_topk_bounded": _DENSE,
    "retrieve_topk_expressions": _DENSE,
    "retrieve_topk_text": f"""
with {_documents(1024)}, {_search('r', 'benchmark', 'item_id', 1024)} select qid as query_id, rank, did as passage_id, round(score, 4) as score from r""",
    "prompt_context": f"select query_id, string_agg({_BLOCK}, chr(10) || chr(10) order by rank) as context from ({_FOUND}) group by 1",
    "prompt_full": f"""
select query_id, 'Question ' || query_id as question, {_Q(_PROMPT_PARTS[0])} || string_agg({_BLOCK}, chr(10) || chr(10) order by rank) || {_Q(_PROMPT_PARTS[1])} || 'Question ' || query_id || {_Q(_PROMPT_PARTS[2])} as prompt
from ({_FOUND}) group by query_id""",
    "normalized_answers": f"select doc_id, {_NORMAL('text')} as normalized from documents",
    "stripped_turns": "select conv_id, turn, " + _STRIP.format("(' ' || chr(9) || chr(160) || text || chr(8195) || chr(10) || ' ')") + " as text from conversations",
    "question_pairs": _PAIRS,
    "exact_match_eval": f"select conv_id, turn, exact_match from ({_SCORED})",
    "eval_summary": f"select count(exact_match) as n, avg(exact_match) as exact_match from ({_SCORED})",
    "eval_sample_prefix": f"select conv_id, turn, exact_match from ({_SCORED}) order by conv_id, turn limit {Config().num_samples}",
    "eval_report_line": f"""
select 'Exact match over ' || n || ' samples: ' || printf('%.4f', m) || ' (' || printf('%.1f', m * 100) || '%)' as line from (select count(exact_match) as n, avg(exact_match) as m from ({_SCORED}))""",
    "eval_report_files": f"select conv_id, turn, exact_match, round(avg(exact_match) over (), 6) as mean from ({_SCORED})",
    "rag_answer_stub": f"""
select q.vec_id as query_id, coalesce(case when score >= {Config().threshold} then title end, {_Q(REFUSAL)}) as answer
from (select vec_id from embeddings where vec_id % 100 = 0) q left join (select * from ({_FOUND}) where rank = 1) f on f.query_id = q.vec_id""",
    "retrieved_titles": f"select query_id, string_agg(title, ' | ' order by rank) as titles from ({_FOUND}) group by 1",
    "report_blocks": f"select query_id, rank, {_BLOCK} as block from ({_FOUND})",
    "macro_f1": """
with p as (select quality as label, 1 - toxic as predicted from labels),
f as (select c, 2.0 * count(*) filter (label = c and predicted = c) / (count(*) filter (label = c) + count(*) filter (predicted = c)) as f1
  from p, (select label as c from p union select predicted from p) group by c)
select round(avg(f1), 9) as macro_f1 from f""",
    "accuracy": "select avg(cast(quality = 1 - toxic as int)) as accuracy from labels",
    "query_class_samples": "select cast(id as bigint) as id, label, " + _CLASS + " as predicted from (values "
    + ", ".join(f"({i}, '{a}', {_Q(t)})" for i, (a, t) in enumerate(SAMPLES)) + ") v(id, label, text)",
    "query_class": f"select conv_id, turn, class, cast({_K.format('class')} as bigint) as k from (select conv_id, turn, {_CLASS} as class from conversations where role = 'user')",
    "index_build_load": """
select cast(step as bigint) as step, built, cast(dim as bigint) as dimensions, (select count(*) from documents) as vectors
from (values (0, true, 64), (1, false, 64), (2, true, 32)) v(step, built, dim)""",
    "index_of_changed_source": """
select cast(step as bigint) as step, built, (select count(*) from documents) - less as vectors
from (values (0, true, 0), (1, false, 0), (2, false, 0), (3, true, 1), (4, true, 0), (5, true, 0)) v(step, built, less)""",
    "unique_passages": f"select count(*) as n from (select distinct title from ({_FLAT}))",
    "examples_scan": "select doc_id // 10 as example_ord, count(*) as n_titles, count(*) as n_texts from documents group by 1",
    "typed_questions": "select 2 * (row_number() over (order by item_id) - 1) as query_id, " + _STRIP.format("translate(text, chr(10) || chr(13), '  ')") + " as text from benchmark",
    "index_from_examples": f"""
with f as ({_FIRST}), n as (select example_ord, count(*) as n from f group by 1),
b as (select example_ord, coalesce(sum(n) over (order by example_ord rows between unbounded preceding and 1 preceding), 0) as before from n),
v as ({_SPARSE.format(buckets=64, id='example_ord * 1048576 + pos', tokens=_TOKENS, table='f')})
select example_ord * 1048576 + pos as passage_id, title, length(text) as n_chars, round(coalesce(w, 0), 6) as first
from f join b using (example_ord) left join (select * from v where b = 0) x on x.id = example_ord * 1048576 + pos where before = 0 or before < 300""",
    "rag_questions": _ITEMS + """
select query_id, count(did) as n_retrieved, coalesce(string_agg(did, ',' order by rank), '') as passage_ids, any_value(answer) as answer from said left join r on qid = query_id group by query_id""",
    "rag_results": _ITEMS + """
select query_id, rank, did as passage_id, title, length(text) as n_chars, round(score, 6) as score, answer from said join r on qid = query_id join dt using (did)""",
    "rag_report": _ITEMS + f""", q as (select item_id as query_id, {_STRIP.format('text')} as query from benchmark)
select query_id, 'Query: ' || any_value(query) || chr(10) || coalesce(string_agg('  [' || rank || '] ' || title || ' (score: ' || printf('%.4f', score) || ')', chr(10) order by rank), '') || chr(10) || 'Answer: ' || any_value(answer) as report
from said join q using (query_id) left join r on qid = query_id left join dt using (did) group by query_id""",
    "evaluate_rag": _EVALUATED + """
select question, gold, predicted, cast(m as bigint) as exact_match, coalesce(titles, '') as retrieved_titles from e left join titles using (query_id)""",
    "eval_report_object": _EVALUATED + """
select row_number() over (order by query_id) - 1 as place, question, predicted, cast(m as bigint) as exact_match, coalesce(n_titles, 0) as n_titles, round(avg(m) over (), 6) as mean from e left join titles using (query_id)""",
    "stage_comparison": f"""
with t as {_NUMBERED}, {_documents()}, {_search('r', 't', 'id')}, {_said('said', 't', 'id', 'r')},
e as (select {_MATCH('answer', 'gold')} as m from said join t on id = query_id),
u as (select 1 as stage, * from r union all select 3, * from {_CLASSWISE('r', 't')})
select cast(stage as int) as stage, n, exact_match, n_passages, ids_by_rank from (select count(*) as n, avg(m) as exact_match from e)
cross join (select stage, count(*) as n_passages, cast(sum(did * rank) as bigint) as ids_by_rank from u group by 1)""",
    "agent_loop": f"""
with {_documents()}, {_loop('benchmark', 'item_id')}
select query_id, status, answer, cast(iterations as int) as iterations, confidence from looped""",
    "four_stage_eval": f"""
with t as {_NUMBERED}, {_documents()}, {_loop('t', 'id')}, {_search('r', 't', 'id')}, {_said('said', 't', 'id', 'r')}, {_verified('checked', 'said', 'r')},
class_found as {_CLASSWISE('r', 't')}, {_said('class_said', 't', 'id', 'class_found')},
s as (select 1 as stage, query_id, answer, null as status from said
  union all select 2, query_id, answer, case when confidence >= 0.8 then 'SUPPORTED' when confidence >= 0.3 then 'PARTIAL' else 'UNSUPPORTED' end from checked
  union all select 3, query_id, answer, null from class_said union all select 4, query_id, answer, status from looped)
select cast(stage as int) as stage, count(*) as n, avg(coalesce({_MATCH('answer', 'gold')}, 0)) as exact_match,
  avg(cast(coalesce(status, '') = 'SUPPORTED' as int)) as supported, avg(cast(coalesce(status, '') = 'ABSTAINED' as int)) as abstained
from s join t on id = query_id group by 1""",
    "question_stream": f"select conv_id, turn, {_CLASS} as class from conversations where role = 'user'",
    "question_stream_answers": _ITEMS + """
select query_id, count(did) as n_retrieved, any_value(answer) as answer from said left join r on qid = query_id group by query_id""",
}
