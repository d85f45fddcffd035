import string

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusloom import queries_corpus, queries_models
from corpusloom.functions import jsontext, numbers, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def plain_clean(t):
    import re

    t = re.sub(r"<[^>]+>", "", t).lower()
    for a, b in ((r"\S+@\S+", " "), (r"\s@\S+", " "), ("_", " "), (r"\s'", " "), (r"'\s", " "), (r"\.", "")):
        t = re.sub(a, b, t)
    for c in string.punctuation.replace("'", "").replace(".", "").replace("_", ""):
        t = t.replace(c, " ")
    return re.sub(r"\s", " ", t.replace("'", "")).strip(" ")


@pytest.mark.parametrize("t", ["<b>Hi</b> it's a_b c@d.org @me 'q' U.S. e-mail; (x)", "", "é — “q”\xa0z", "a\tb\nc", "[x]\\^`{|}~"])
def test_clean(spark, t):
    assert one(spark, t, text.clean_text) == plain_clean(t)


def test_tokens(spark):
    clean = F.lit("the abc12 12345 naïve harbour it of crane")
    got = lambda **k: spark.range(1).select(text.tokens(clean, **k)).first()[0]
    assert got(stop_words=["the"]) == ["harbour", "crane"]
    assert got(keep="numbers") == ["the", "12345", "harbour", "crane"]
    assert got(keep="all", min_length=5) == ["abc12", "12345", "naïve", "harbour", "crane"]


@pytest.mark.parametrize(("t", "k", "hit"), [("A Port, here", "port", True), ("airport", "port", False), ("we use c++ now", "c++", True), ("port_x", "port", False), ("café", "caf", False), (r"a \E b", r"\e", True), ("x", "", True), (None, "a", None)])
def test_has_word(spark, t, k, hit):
    df = spark.createDataFrame([(t, k)], "t string, k string")
    assert df.select(text.has_word(F.col("t"), F.col("k"))).first()[0] in ((hit,) if k else (True, False))
    edged = df.select(text.has_word_edged(text.with_edges(F.col("t")), F.col("k"), text.with_edges(F.col("k")))).first()[0]
    assert edged in ((hit,) if k else (True, False))


def test_lines(spark):
    df = spark.createDataFrame([("1", "A | B", None), ("2", " ", "t")], "id string, title string, text string")
    line = text.article_line({"ID": "id", "Title": "title", "Text": "text"})
    assert [r[0] for r in df.select(line).collect()] == ["ID: 1 | Title: A | B", "ID: 2 | Text: t"]
    assert df.select(text.line_field(line, "ID")).first()[0] == "1"


def test_topic_line(spark):
    df = spark.createDataFrame([("L-1_K-23 a b",), ("x",)], "l string")
    layer, number = text.topic_place(F.col("l"))
    assert [tuple(r) for r in df.select(layer, number, F.array_join(text.topic_words(F.col("l")), ",")).collect()] == [(1, 23, "a,b"), (None, None, "x")]


@pytest.mark.parametrize(("tokens", "n", "full", "keyword"), [(100000, 1200, 111, 75), (1000, 10, 3, 3), (50000, 600, 50, 36)])
def test_estimates(spark, tokens, n, full, keyword):
    def plain(per, tops, shares, w, step):
        d = shares[0] if n > tops[0] else shares[1] if n > tops[1] else shares[2]
        return max(3, int(int(tokens / 1000 * per * d) * w + n // step * (1 - w) + 1e-9))

    df = spark.createDataFrame([(tokens, n)], "t bigint, n bigint")
    got = df.select(numbers.topic_estimate(F.col("t"), F.col("n")), numbers.topic_estimate(F.col("t"), F.col("n"), keyword_mode=True)).first()
    assert tuple(got) == (plain(0.8, (1000, 500), (1.2, 1.0, 0.8), 0.7, 8), plain(0.6, (800, 400), (1.1, 1.0, 0.9), 0.6, 10))


def test_sample_size(spark):
    df = spark.createDataFrame([(n,) for n in (10, 300, 499, 500, 999, 1000, 14000)], "n bigint")
    assert [r[0] for r in df.select(numbers.sample_size(F.col("n"))).collect()] == [50, 60, 99, 75, 149, 100, 500]


def test_replies(spark):
    assert one(spark, None, jsontext.yes_no) == "error"
    assert one(spark, '{"answer": "YES"}', jsontext.yes_no) == "yes"
    assert one(spark, '{"answer": "maybe yes"}', jsontext.yes_no) == "no"
    assert one(spark, "Well, yes", jsontext.yes_no) == "yes"
    assert one(spark, None, jsontext.parse_topics) is None and one(spark, "", jsontext.parse_topics) == []
    assert one(spark, 'about "estimated_topics": 12', jsontext.topic_estimate_reply) == 12 and one(spark, "some 7 topics", jsontext.topic_estimate_reply) == 7
    assert one(spark, "['a', 'b, c']", jsontext.keyword_list) == ["a", "b, c"] and one(spark, "['a']", lambda c: jsontext.keyword_list(c, True)) == ["['a']"]
    assert rows(spark.createDataFrame([('x {"evaluation": {"coherence": {"score": 4}}, "overall_score": 3} y',), ("no",)], "r string").select(jsontext.rubric(F.col("r")).alias("r")).select("r.coherence", "r.overall").filter("overall is not null")) == [(4.0, 3.0)]


def test_vocabularies_are_whole(spark, tmp_path):
    letters = "bcdfghjklmnp"
    terms = ["z" + a + b + c + d for a in letters for b in letters for c in letters for d in letters][:2100]
    spark.createDataFrame([(i, " ".join(terms) if i < 3 else "harbour crane vessel storm bridge council") for i in range(8)], "row_id bigint, text string").write.parquet(f"{tmp_path}/nyt_sampled.parquet")
    d = str(tmp_path)
    assert queries_corpus.bow(spark, d).select("term_id").distinct().count() == 2100
    assert queries_corpus.vocab_df(spark, d).count() == 2000
    bow, vocab = queries_models._bow(spark, d)
    assert (vocab.count(), bow.count()) == (2100, 3 * 2100)
