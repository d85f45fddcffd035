import pytest
from conftest import rows

from corpusloom.operators import coherence, match, sampling

ARTICLES = [
    (1, "The port", "A harbour crane fell; the c++ port was shut. Cranes stood."), (2, "Trains", "No port_a here, but a Port."), (3, None, "port"), (4, "x", None),
    (5, "Crane", "the the THE"), (6, "Öl und Äpfel", "Das öl-Fass und äpfel2"), (7, "", "port"), (8, "Harbour crane", "harbour crane, harbour  crane"),
]
TOPICS = [(1, ["Port", "crane", "crane", "a", None]), (2, ["c++", "harbour crane", " the "]), (3, ["öl", "äpfel", "--"]), (4, None), (5, [])]


@pytest.mark.parametrize("most", [match.MOST_CHARS, -1])
def test_both_ways_of_matching(spark, monkeypatch, most):
    monkeypatch.setattr(match, "MOST_CHARS", most)
    articles = spark.createDataFrame([(*a, 9) for a in ARTICLES], "row_id bigint, title string, text string, keyword int")
    topics = spark.createDataFrame([(*t, "x") for t in TOPICS], "topic_id bigint, keywords array<string>, title string")
    got = rows(match.keyword_match(articles, topics))
    assert [(t, r, s, n) for t, r, _, s, n, _ in got] == [(1, 1, 4, 3), (1, 2, 1, 1), (1, 5, 4, 2), (1, 8, 4, 2), (2, 1, 4, 3), (2, 5, 1, 1), (2, 8, 2, 1), (3, 6, 4, 2)]
    assert match.keyword_match(articles.limit(0), topics).count() == 0 and match.keyword_match(articles, topics.limit(0)).count() == 0


def test_the_two_ways_agree(spark, monkeypatch):
    articles = spark.createDataFrame(ARTICLES, "row_id bigint, title string, text string")
    topics = spark.createDataFrame(TOPICS, "topic_id bigint, keywords array<string>")
    one = rows(match.keyword_match(articles, topics))
    monkeypatch.setattr(match, "MOST_CHARS", -1)
    assert rows(match.keyword_match(articles, topics)) == one


@pytest.mark.parametrize("most", [match.MOST_CHARS, -1])
def test_words_inside_tokens(spark, monkeypatch, most):
    monkeypatch.setattr(match, "MOST_CHARS", most)
    tokens = spark.createDataFrame([("harbour",), ("arbour",), ("x",)], "token string")
    asked = spark.createDataFrame([("arb",), ("bour",), ("our",), ("zz",)], "word string")
    assert rows(coherence.words_inside(tokens, asked)) == [(t, w) for t in ("arbour", "harbour") for w in ("arb", "bour", "our")]
    assert coherence.words_inside(tokens, asked.limit(0)).count() == 0


def test_budgets(spark):
    df = spark.createDataFrame([(i, 10) for i in range(5)], "i int, t bigint")
    budgets = spark.createDataFrame([("a", 25), ("b", 9), ("c", 100)], "m string, budget bigint")
    assert rows(sampling.token_budget(df, ["i"], "t", budgets)) == [("a", 25, 2, 20), ("b", 9, 0, 0), ("c", 100, 5, 50)]
    assert rows(sampling.token_budget(df.limit(0), ["i"], "t", budgets))[0] == ("a", 25, 0, 0)
