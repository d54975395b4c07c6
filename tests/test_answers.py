import json

import pytest
from pyspark.sql import functions as F

from tarnwick.functions.text import REFUSAL
from tarnwick.operators import evaluate, generate, metrics
from tarnwick.operators.embed import HashingEmbedder, ModelEmbedder, embed
from tarnwick.plans import agent, rag
from tarnwick.schemas import Config
from tarnwick.session import new_table_path
from tarnwick.sources import index
from tarnwick.sources.tables import question_answer_pairs, questions_from_lines


def _retrieved(spark, n=12):
    return spark.createDataFrame([(1, r, r, f"t{r}", f"x{r}", 1.0 / r) for r in range(1, n + 1)], "query_id long, rank int, passage_id long, title string, text string, score double")


def test_context_orders_rank_ten_after_nine(spark):
    text = generate.contexts(_retrieved(spark)).head().context
    assert text == "\n\n".join(f"[{r}] t{r}:\nx{r}" for r in range(1, 13))


def test_prompt_without_passages(spark):
    q = spark.createDataFrame([(1, "why?"), (2, "who?")], "query_id long, text string")
    got = {r.query_id: r.prompt for r in generate.prompts(q, _retrieved(spark)).collect()}
    assert "Context:\n\n\nQuestion: who?" in got[2] and got[1].endswith("Question: why?\n\nAnswer:") and REFUSAL in got[1]


def test_stub_refuses_below_the_threshold(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, text string")
    for threshold, first in ((0.5, "t1"), (1.5, REFUSAL)):
        got = {r.query_id: r.answer for r in generate.stub_answers(q, _retrieved(spark), threshold).collect()}
        assert got == {1: first, 2: REFUSAL}


def test_service_retries_and_strips(spark):
    def connect():
        calls = []

        def ask(text):
            calls.append(text)
            if len(calls) == 1:
                raise OSError("busy")
            return f"  said {text}\n"

        return ask

    p = spark.createDataFrame([(1, "hello")], "query_id long, prompt string").coalesce(1)
    assert [tuple(r) for r in generate.service_answers(p, connect, wait=0.0).collect()] == [(1, "said hello")]


def test_chat_service_answers_over_http(spark):
    """One user message per prompt, message.content back, against a server on this machine."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            reply = json.dumps({"message": {"role": "assistant", "content": f" to {body['messages'][0]['content']} "}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = Config(generator="small", service=f"http://127.0.0.1:{server.server_port}/api/chat")
    prompts = spark.createDataFrame([(1, "red"), (2, "blue")], "query_id long, prompt string")
    got = {r.query_id: r.answer for r in generate.service_answers(prompts, generate.connect_of(config)).collect()}
    server.shutdown()
    assert got == {1: "to red", 2: "to blue"} and len(asked) == 2
    assert all(x["model"] == "small" and x["stream"] is False and [m["role"] for m in x["messages"]] == ["user"] for x in asked)
    assert generate.connect_of(Config()) is None


def test_null_titles_and_texts_stay_in_the_prompt(spark):
    rows = spark.createDataFrame([(1, 1, 1, None, "x", 1.0), (1, 2, 2, "t", None, 0.5)], "query_id long, rank int, passage_id long, title string, text string, score double")
    assert generate.contexts(rows).head().context == "[1] :\nx\n\n[2] t:\n"


def test_mean_of_nothing_is_null(spark):
    rows = evaluate.scored(spark.createDataFrame([], "predicted string, gold string"))
    assert tuple(evaluate.summary(rows).head()) == (0, None)
    path = new_table_path(spark, "object")
    evaluate.write_report_object(rows, path, ["gold"])
    assert "".join(r.value for r in spark.read.text(path, wholetext=True).collect()).split() == ['{"exact_match":null,"results":[', "]}"]


def test_report_object_is_one_json_file(spark):
    rows = evaluate.scored(spark.createDataFrame([(i, f"q{i}", "a", "A." if i % 2 else None) for i in range(9)], "query_id long, question string, gold string, predicted string")).repartition(4)
    path = new_table_path(spark, "object")
    evaluate.write_report_object(rows, path, ["query_id"], leave_out=("query_id",))
    files = spark.read.text(path, wholetext=True).collect()
    assert len(files) == 1
    made = json.loads(files[0].value)
    assert made["exact_match"] == 1.0 and [r["question"] for r in made["results"]] == [f"q{i}" for i in range(9)] and made["results"][0]["predicted"] is None


def test_sample_prefix(spark):
    df = spark.range(5)
    assert [r.id for r in evaluate.sample_prefix(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert evaluate.sample_prefix(df, 0, ["id"]).count() == 0 and evaluate.sample_prefix(df, 9, ["id"]).count() == 5


def test_report_line(spark):
    rows = evaluate.scored(spark.createDataFrame([("a", "A!"), ("a", "b"), ("c", "d")], "predicted string, gold string"))
    assert evaluate.report_lines(rows).head().line == "Exact match over 3 samples: 0.3333 (33.3%)"


@pytest.mark.parametrize("rows", [[(0, 0), (0, 0), (1, 0), (2, 1)], [(1, 1)], [(0, 1), (1, 0)]])
def test_macro_f1(spark, rows):
    def f1(c):
        tp = sum(a == b == c for a, b in rows)
        return 2 * tp / (sum(a == c for a, _ in rows) + sum(b == c for _, b in rows))

    classes = {x for r in rows for x in r}
    df = spark.createDataFrame(rows, "label int, predicted int")
    assert metrics.macro_f1(df).head()[0] == pytest.approx(sum(map(f1, classes)) / len(classes))
    assert metrics.accuracy(df).head()[0] == pytest.approx(sum(a == b for a, b in rows) / len(rows))


def _loop(spark, verdicts):
    """Run the loop on one question whose verdicts are given in order."""
    rounds = iter(verdicts)
    answer = lambda q, found: q.select("query_id", F.lit("x").alias("answer"))
    check = lambda a, found: a.select("query_id", F.lit(next(rounds)).alias("verdict"), F.lit(0.9).alias("confidence"))
    q = spark.createDataFrame([(1, "who is it?")], "query_id long, text string")
    r = agent.agent_loop(q, lambda q: q, answer, check).head()
    return r.status, r.answer, r.iterations


def test_loop_transcripts(spark):
    assert _loop(spark, ["SUPPORTED"]) == ("SUPPORTED", "x", 1)
    assert _loop(spark, ["PARTIAL", "SUPPORTED"]) == ("SUPPORTED", "x", 2)
    assert _loop(spark, ["PARTIAL"] * 3) == ("ABSTAINED", None, 3)
    assert _loop(spark, ["UNSUPPORTED", "PARTIAL", "UNSUPPORTED"]) == ("ABSTAINED", None, 3)


def test_verify(spark):
    a = spark.createDataFrame([(1, "t1 x1"), (2, "t1"), (1, "t1 zz yy")], "query_id long, answer string")
    got = {(r.query_id, r.verdict) for r in agent.verify(a, _retrieved(spark, 1)).collect()}
    assert got == {(1, "SUPPORTED"), (2, "UNSUPPORTED"), (1, "PARTIAL")}


def test_index_is_rebuilt_only_if_the_configuration_changes(spark):
    path = new_table_path(spark, "index")
    p = spark.createDataFrame([(1, "a", "one two"), (2, "b", None)], "passage_id long, title string, text string")
    e = HashingEmbedder(16)
    assert index.build_or_load(spark, path, lambda: p, e, {"dimensions": 16})[1]
    found, built = index.build_or_load(spark, path, lambda: p, e, {"dimensions": 16})
    assert not built and index.size(found) == 2
    assert index.build_or_load(spark, path, lambda: p, HashingEmbedder(8), {"dimensions": 8})[1]
    assert [len(r.embedding) for r in index.load_index(spark, path).collect()] == [8, 8]


def test_model_embedder_in_batches(spark):
    e = ModelEmbedder("lengths", lambda: lambda texts: [[len(t), 0.0] for t in texts], batch=2)
    rows = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, text string")
    got = {r.id: list(r.embedding) for r in embed(rows, e, keep=("id",)).collect()}
    assert got == {0: [0.0, 0.0], **{i: [1.0, 0.0] for i in range(1, 5)}}


def test_ask_and_evaluate(spark):
    p = spark.createDataFrame([(1, "red", "red apple"), (2, "blue", "blue sky sea")], "passage_id long, title string, text string")
    e = HashingEmbedder(512)
    found = embed(p, e, keep=("passage_id", "title", "text"))
    q = spark.createDataFrame([(1, " red apple "), (2, "  "), (3, "unknown")], "query_id long, text string")
    got = {r.query_id: r for r in rag.ask(q, found, e, Config(top_k=2, threshold=0.4)).collect()}
    assert set(got) == {1, 3} and got[1].answer == "red" and [x.title for x in got[1].retrieved] == ["red", "blue"] and got[3].answer == REFUSAL
    assert "Query: red apple" in rag.shown(rag.ask(q, found, e, Config(top_k=2))).filter("query_id = 1").head().report
    ex = spark.createDataFrame([(1, "red apple", "Red."), (2, "blue sky", "green")], "query_id long, question string, answer string")
    out = {r.query_id: (r.gold, r.predicted, r.exact_match, r.retrieved_titles) for r in rag.evaluate_questions(ex, found, e, Config(top_k=1)).collect()}
    assert out == {1: ("Red.", "red", 1, ["red"]), 2: ("green", "blue", 0, ["blue"])}


def test_pairs_and_typed_questions(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "q2"), (2, 0, "assistant", "z")]
    got = question_answer_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 1, "q", "a")]
    (tmp_path / "q.txt").write_text(" who? \n\n   \nwhat?\n")
    (tmp_path / "r.txt").write_text("why?")
    assert sorted(tuple(r) for r in questions_from_lines(spark, f"file://{tmp_path}/*.txt").collect()) == [(0, "who?"), (3, "what?"), (5, "why?")]


def test_sample_questions_get_their_classes(spark):
    from tarnwick.plans.queries import query_class_samples

    assert all(r.label == r.predicted for r in query_class_samples(spark, "").collect())


def test_loop_retrieves_again_only_what_is_asked_in_other_words(spark):
    q = spark.createDataFrame([(1, "who is it"), (2, "plain words"), (3, None)], "query_id long, text string")
    asked = []

    def retrieve(pending):
        asked.append(sorted((r.query_id, r.text) for r in pending.collect()))
        return pending.selectExpr("query_id", "1 as rank", "query_id as passage_id", "text as title", "text", "1.0D as score")

    def check(said, found):
        return said.join(found.groupBy("query_id").agg(F.max("title").alias("t")), "query_id").selectExpr("query_id", "'PARTIAL' as verdict", "if(t = 'it', 0.5D, 0.4D) as confidence")

    answer = lambda p, found: p.join(found.select("query_id"), "query_id", "left_semi").selectExpr("query_id", "'x' as answer")
    rows = agent.agent_loop(q, retrieve, answer, check).collect()
    assert sorted((r.query_id, r.status, r.iterations, r.confidence) for r in rows) == [(1, "ABSTAINED", 3, 0.5), (2, "ABSTAINED", 3, 0.4), (3, "ABSTAINED", 3, 0.4)]
    assert asked == [[(1, "who is it"), (2, "plain words"), (3, None)], [(1, "it")]]
    first = q.selectExpr("query_id", "1 as rank", "query_id as passage_id", "text as title", "text", "1.0D as score")
    asked.clear()
    assert len(agent.agent_loop(q, retrieve, answer, check, first=first).collect()) == 3 and asked == [[(1, "it")]]


def test_verify_groups_only_words_that_answers_have(spark):
    a = spark.createDataFrame([(1, "Red, apple!"), (1, "green sky"), (2, "..."), (3, "red"), (4, None)], "query_id long, answer string")
    found = spark.createDataFrame(
        [(1, 1, 1, "Red", "an apple\n a day", 1.0), (1, 2, 2, None, "sky", 0.9), (2, 1, 1, "x", "...", 1.0), (4, 1, 1, "x", None, 1.0)],
        "query_id long, rank int, passage_id long, title string, text string, score double",
    )
    out = agent.verify(a, found)
    assert sorted((r.query_id, r.verdict, r.confidence) for r in out.collect()) == [
        (1, "PARTIAL", 0.5), (1, "SUPPORTED", 1.0), (2, "UNSUPPORTED", 0.0), (3, "UNSUPPORTED", 0.0), (4, "UNSUPPORTED", 0.0)
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(array_intersect" in plan or "collect_list(hit" in plan


def test_verify_reads_a_passage_once_whatever_the_number_of_questions(spark):
    a = spark.createDataFrame([(1, "Red, apple!"), (1, "green sky"), (2, "..."), (3, "red"), (4, None), (5, "an apple"), (6, " day")], "query_id long, answer string")
    p = spark.createDataFrame([(1, "Red", "an apple\n a day "), (2, None, "sky"), (3, "x", "..."), (4, "x", None), (9, "red", "red")], "passage_id long, title string, text string")
    found = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 3), (4, 1, 4), (5, 1, 1), (5, 2, 1), (6, 1, 1)], "query_id long, rank int, passage_id long")
    by_question = agent.verify(a, found.join(p, "passage_id"))
    by_passage = agent.verify(a, found, passages=p)
    rows = lambda out: sorted(tuple(r) for r in out.collect())
    assert rows(by_passage) == rows(by_question) and len(rows(by_passage)) == 7
    # Words are made in a generator on the passages alone, below the join with what was retrieved.
    plan = by_passage._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan
