"""Two hops and comparisons on planted passages, and their edges."""

import pytest

from tarnwick.operators import strategies
from tarnwick.operators.embed import HashingEmbedder, embed
from tarnwick.plans import agent

E = HashingEmbedder(512)


def indexed(spark, rows):
    passages = spark.createDataFrame(rows, "passage_id long, title string, text string")
    return embed(passages, E, keep=("passage_id", "title", "text")).cache()


FILLER = [(100 + i, f"Filler {i}", f"unrelated words about thing{i} and item{i}") for i in range(30)]
FILM = [
    (1, "Sinister (film)", "Sinister film was directed by a man, Scott Derrickson, for release"),
    (900, "Scott Derrickson!", "Scott Derrickson is an American from Denver born in the sixties"),
    (3, "a title of more than eight words that no bridge may be", "release of a title of more than eight words that no bridge may be"),
    (4, "...", "no words in its title"), (5, None, "no title at all"), (6, "release", None),
]


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_second_hop_finds_what_the_first_one_names(spark):
    index = indexed(spark, FILM + FILLER)
    questions = asked(spark, "sinister film director nationality")
    plain = [r.passage_id for r in strategies.search(questions, index, E, 4).orderBy("rank").collect()]
    found = strategies.bridges(strategies.search(questions, index, E, 1), index).collect()
    assert [(r.query_id, r.place, r.bridge) for r in found] == [(0, 1, "scott derrickson"), (0, 2, "release")]
    hops = [r.passage_id for r in strategies.two_hops(questions, index, E, 4).orderBy("rank").collect()]
    assert plain[0] == 1 and 900 not in plain and hops[0] == 1 and 900 in hops
    # A bridge that the question has found already is none.
    assert strategies.bridges(strategies.search(questions, index, E, 40), index).count() == 0
    index.unpersist()


def test_bridges_are_as_many_as_asked_and_in_order(spark):
    titles = [(i, t, "x") for i, t in enumerate(["alpha", "alpha beta", "gamma", "delta", "epsilon"], 10)]
    index = indexed(spark, [(1, "first", "alpha beta gamma"), (2, "second", "epsilon delta alpha"), *titles])
    found = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (8, 1, 2), (9, 1, 99)], "query_id long, rank int, passage_id long")
    got = {}
    for r in strategies.bridges(found, index).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.bridge)
    assert got == {7: ["alpha beta", "alpha", "gamma"], 8: ["alpha", "delta", "epsilon"]}
    assert len(strategies.bridges(found, index, most=1).collect()) == 2
    index.unpersist()


@pytest.mark.parametrize("text,want", [
    ("Who is older, Elvis Presley or Michael Jackson?", ["elvis presley", "michael jackson"]),
    ("Were Scott Derrickson and Ed Wood of the same nationality?", ["scott derrickson", "ed wood"]),
    ("Which band was formed first, Radiohead or Coldplay?", ["radiohead", "coldplay"]),
    ("Where was Einstein born?", ["Where was Einstein born?"]), ("or", ["or"]), ("", [""]), (None, [None]), ("was or is", ["was or is"]),
])
def test_things_compared(spark, text, want):
    df = asked(spark, text)
    row = df.select(strategies.things(df["text"]).alias("t")).head()
    assert row.t == want


def test_comparison_reads_both_lists_in_turns(spark):
    many = [(i, f"Elvis {i}", "elvis presley " * 5 + f"tale{i}") for i in range(20)]
    index = indexed(spark, many + [(50, "Michael", "michael jackson was a singer of songs"), *FILLER])
    questions = asked(spark, "Who is older, Elvis Presley or Michael Jackson?", "elvis presley", None)
    got = {}
    for r in strategies.compared(questions, index, E, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.passage_id)
    assert got[0][1] == 50 and got[0][0] < 20 and got[0][2] < 20 and len(set(got[0])) == 4
    assert len(got[1]) == len(got[2]) == 4 and all(p < 20 for p in got[1])
    plain = [r.passage_id for r in strategies.search(questions.filter("query_id = 0"), index, E, 4).collect()]
    assert 50 not in plain
    index.unpersist()


def test_each_class_its_way(spark):
    index = indexed(spark, FILM + FILLER)
    questions = asked(spark, "sinister", "who directed the sinister film", "Which is older, Denver or release?", None)
    got = {}
    for r in agent.retrieve_by_class(questions, index, E).collect():
        got.setdefault(r.query_id, set()).add(r.passage_id)
    assert {q: len(p) for q, p in got.items() if q != 1} == {0: 5, 2: 10, 3: 5} and 900 in got[1]
    index.unpersist()


def test_strategies_over_nothing(spark):
    index = indexed(spark, FILM)
    for way in (strategies.two_hops, strategies.compared):
        assert way(asked(spark, "x").limit(0), index, E, 3).count() == 0
        assert way(asked(spark, "x"), index.limit(0), E, 3).count() == 0
    index.unpersist()


def test_feedback_adds_what_speaks_for_the_passages(spark):
    questions = asked(spark, "Who is the owner of the red house?", "zzz", "what is")
    found = spark.createDataFrame(
        [(0, "House", "red house owner gardener gardener gardener", 0.9), (0, "x", "house painter", 0.1), (0, "y", "nothing " * 50, 0.0), (1, None, None, 0.5), (2, "of an", "in it", 0.7)],
        "query_id long, title string, text string, score double",
    )
    terms = {(r.query_id, r.place): r.term for r in strategies.feedback_terms(questions, found).collect()}
    assert terms == {(0, 1): "gardener", (0, 2): "painter"}
    wide = {r.query_id: r.text for r in strategies.widened(questions, found).collect()}
    assert wide == {0: "owner red house gardener painter", 1: "zzz", 2: "what is"}


def test_second_round_is_supported_only_through_an_added_word(spark):
    """The first passages do not say the answer; a word in them leads to the one that does."""
    rows = [(1, "Painter", "lighthouse keeper storm lighthouse painter"), (2, "Mabel Grey", "lighthouse painter storm born mabel grey mabel grey storm"), *FILLER]
    index = indexed(spark, rows)
    questions = asked(spark, "who is the keeper")

    def retrieve(q):
        found = strategies.search(q, index, E, 2)
        return index.select("passage_id", "title", "text").join(found, "passage_id").select("query_id", "rank", "passage_id", "title", "text", "score")

    # Only the second passage supports an answer, and only where something is common with the question.
    def answer(q, found):
        said = found.filter("passage_id = 2 and score > 0").select("query_id", "title")
        return q.select("query_id").join(said, "query_id", "left").selectExpr("query_id", "coalesce(title, 'unheard thing') as answer")

    plain = agent.agent_loop(questions, retrieve, answer).head()
    again = agent.agent_loop(questions, retrieve, answer, again=strategies.widened).head()
    assert (plain.status, plain.answer) == ("ABSTAINED", None)
    assert (again.status, again.answer, again.iterations) == ("SUPPORTED", "Mabel Grey", 2)
    index.unpersist()
