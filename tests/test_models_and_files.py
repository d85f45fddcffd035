import time

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusloom.models import classic, transport
from corpusloom.operators import chat, match, sampling
from corpusloom.plans.order import in_order
from corpusloom.plans.skew import hot_split_join
from corpusloom.sources import files
from corpusloom.streaming import live


def test_transport():
    r = np.random.default_rng(2)
    a, b = np.full(6, 1 / 6), np.array([0.5, 0.3, 0.2])
    plan = transport.sinkhorn(r.random((6, 3)), a, b, 10.0)
    assert np.allclose(plan.sum(1), a, atol=1e-6) and np.allclose(plan.sum(0), b, atol=1e-6)
    assert np.allclose(transport.topic_word_weights(r.random((4, 2)), r.random((7, 2))).sum(0), 1)
    assert np.allclose(transport.embedded_topics(r.random((4, 2)), r.random((7, 2))).sum(1), 1)
    phi = transport.layer_weights(r.random((2, 3)), r.random((5, 3)))
    assert np.allclose(phi.sum(1), 1, atol=1e-5)
    theta = transport.chained_theta(np.full((3, 5), 0.2), [phi])
    assert np.allclose(theta[1].sum(1), 1, atol=1e-5) and transport.chained_beta(r.random((5, 9)), [phi])[1].shape == (2, 9)
    x = transport.into_ball(r.standard_normal((4, 3)))
    d = transport.poincare_distance(x, x)
    assert np.allclose(np.diag(d), 0, atol=1e-5) and np.allclose(d, d.T, atol=1e-6)
    y, z = x[:1], x[1:2]
    exact = np.arccosh(1 + 2 * ((y - z) ** 2).sum() / ((1 - (y**2).sum()) * (1 - (z**2).sum())))
    assert d[0, 1] == pytest.approx(exact, rel=1e-6)


def test_ml_models(spark):
    bow = spark.createDataFrame([(d, t + 5 * (d % 2), 2) for d in range(20) for t in range(5)], "k int, term_id int, cnt int")
    theta, beta = classic.lda(bow, "k", 10, 2, iterations=10)
    assert theta.groupBy("k").agg(F.sum("w").alias("s")).filter("abs(s - 1) > 1e-6").count() == 0
    assert beta.groupBy("topic_id").agg(F.sum("w").alias("s")).filter("abs(s - 1) > 1e-6").count() == 0
    theta, beta = classic.nmf(bow, "k", 10, 2)
    assert theta.filter("w < 0").count() == 0 and beta.filter("w < 0").count() == 0
    v = spark.createDataFrame([(i, [float(i % 2) * 5, 0.1 * i]) for i in range(20)], "k int, v array<double>")
    assert classic.clusters(v, "k", "v", 2).select("topic_id").distinct().count() == 2
    w = classic.transport_topics(v, "k", "v", 2).groupBy("k").agg(F.sum("w").alias("s"))
    assert w.count() == 20 and w.filter("abs(s - 1) > 1e-9").count() == 0


def dense_nmf(x, topics, iterations, seed=1):
    """The factorisation over the whole table of documents by words."""

    def fitted(h):
        w = np.full((len(x), topics), x.mean())
        for _ in range(30):
            w = w * (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        return w

    h = np.random.default_rng(seed).random((topics, x.shape[1])) * np.sqrt(max(x.mean(), 1e-9) / topics) + 1e-6
    for _ in range(iterations):
        w = fitted(h)
        h = h * (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
    return fitted(h), h


def test_factorisation_as_over_the_whole_table(spark):
    r = np.random.default_rng(6)
    x = np.where(r.random((50, 30)) < 0.2, r.integers(1, 5, (50, 30)), 0)
    bow = spark.createDataFrame([(int(d), int(t), int(x[d, t])) for d, t in zip(*np.nonzero(x))], "k int, term_id int, cnt int").repartition(3)
    theta, beta = classic.nmf(bow, "k", 30, 3, iterations=5)
    w, h = dense_nmf(x.astype(float), 3, 5)
    got, topics = np.zeros_like(w), np.zeros_like(h)
    for q in theta.collect():
        got[q.k, q.topic_id] = q.w
    for q in beta.collect():
        topics[q.topic_id, q.term_id] = q.w
    np.testing.assert_allclose(got, w, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(topics, h, rtol=1e-6, atol=1e-8)
    whole = {q.k: q.v for q in classic.nmf(bow, "k", 30, 3, iterations=5, vectors=True)[0].collect()}
    np.testing.assert_allclose([whole[k] for k in range(50)], w, rtol=1e-6, atol=1e-8)


def test_factorisation_of_many_words(spark):
    """No table of documents by words: a vocabulary of 4 million words and 2000 documents would take 64 GB in all."""
    bow = spark.range(2000).select(F.col("id").alias("k"), F.explode(F.array(F.lit(3), F.col("id") * 2000)).alias("term_id"), F.lit(1).alias("cnt")).repartition(1)
    began = time.monotonic()
    theta, _ = classic.nmf(bow, "k", 4_000_000, 1, iterations=1)
    assert theta.count() == 2000 and time.monotonic() - began < 40


def test_order_and_skew(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("a"), (F.col("id") % 5).alias("n")).repartition(5)
    got = in_order(df, ["a"], "n").orderBy("a").collect()
    assert [r.position for r in got] == list(range(1000))
    assert [r.running for r in got] == np.cumsum([r.n for r in got]).tolist()
    assert in_order(df.limit(0), ["a"]).count() == 0
    hot = spark.createDataFrame([("h", i) for i in range(3000)] + [(f"k{i}", i) for i in range(40)] + [(None, 1)], "k string, v int")
    per = hot.filter("k is not null and k <> 'k3'").groupBy("k").agg(F.count("*").alias("uses"), F.max("v").alias("m"))
    assert hot_split_join(hot, per, ["k"], "uses", 3040).count() == 3039
    assert hot_split_join(hot, per, ["k"], "uses", 3040, "left").count() == 3041


def test_match(spark):
    articles = spark.createDataFrame([(1, "Port news", "The crane fell."), (2, "Port news", "c++ and crane and port"), (3, "Other", "airport"), (4, "", "crane"), (5, None, "crane")], "row_id int, title string, text string")
    topics = spark.createDataFrame([(1, ["Port", "crane", "crane", "x"]), (2, ["C++"]), (3, None), (4, [None, "zzz"])], "topic_id int, keywords array<string>")
    got = rows(match.keyword_match(articles, topics))
    assert got == [(1, 1, "Port news", 4, 3, "port|crane|crane"), (2, 2, "Port news", 1, 1, "c++")]
    kept = match.adaptive_cut(match.keyword_match(articles, topics), topics)
    assert rows(kept.select("topic_id", "row_id")) == [(1, 1), (2, 2)]


def test_samples(spark):
    df = spark.range(500).select(F.col("id").alias("k"))
    a, b = (rows(sampling.hash_sample(x, "k", 50)) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 50 and rows(sampling.hash_sample(df, "k", 50, seed=1)) != a
    assert 60 < sampling.train_test(df, "k", 0.2).filter("split = 'test'").count() < 140
    budgets = spark.createDataFrame([("s", 10), ("z", 0)], "m string, budget bigint")
    sized = spark.createDataFrame([(i, 3) for i in range(9)], "k int, n bigint")
    assert rows(sampling.token_budget(sized, ["k"], "n", budgets)) == [("s", 10, 3, 9), ("z", 0, 0, 0)]


def test_chat(spark):
    class Failing:
        def complete(self, prompt, max_tokens, temperature):
            if prompt == "bad":
                raise chat.Unavailable(0.0)
            return prompt.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "k int, p string")
    got = {r.k: (r.reply, r.error is not None) for r in chat.call_all(df, "k", "p", Failing).collect()}
    assert got == {1: ("A", False), 2: (None, True), 3: (None, False)}
    assert chat.call_all(df, "k", "p").filter("reply is not null").count() == 2


def test_files(spark, tmp_path):
    for name, sep, encoding in (("a.csv", ",", "utf-8"), ("b.csv", ";", "latin-1")):
        (tmp_path / name).write_bytes(f'id{sep}title{sep}text\n1{sep}Café{sep}"two\nlines"\n2{sep}{sep}x\n'.encode(encoding))
        got = [tuple(r) for r in files.read_file(spark, str(tmp_path / name)).collect()]
        assert len(got) == 1 and got[0][0] == "1" and got[0][2] == "two\nlines"
    with pytest.raises(ValueError):
        (tmp_path / "c.csv").write_text("a,b\n1,2\n")
        files.sniff(spark, str(tmp_path / "c.csv"))
    (tmp_path / "t.json").write_text('{"file_path": "f", "topics": [{"topic_num": 1, "summary": "s", "keywords": ["a"], "source_titles_with_ids": [{"title": "T", "id": "7", "match_score": 2}]}, null]}')
    topics = files.read_topic_results(spark, str(tmp_path / "t.json"))
    assert topics.count() == 1 and files.assignments_of(topics).first().id == "7"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert files.append_missing(df, str(tmp_path / "out"), "k") == 2 and files.append_missing(df.union(spark.createDataFrame([(3, "c")], "k int, v string")), str(tmp_path / "out"), "k") == 1
    assert files.write_checked(df, str(tmp_path / "p")) == 2
    assert files.topics_from_lists(spark, [list("abcdef")]).first().description == "a, b, c, d, e..."
    assert rows(files.latest_per_id(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, o int, v string"), "k", "o")) == [(1, 2, "y")]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-0{1 + i % 3} 10:00:00", "ab"[i % 2], 1.0) for i in range(30)], "t string, e string, v double").select(F.to_timestamp("t").alias("t"), "e", "v")
    df.write.parquet(str(tmp_path / "in"))
    live_df = live.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", "e", "v")
    q = live_df.writeStream.outputMode("update").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("seen")) == rows(live.windowed_counts(df, "t", "e", "v"))


def test_transport_is_fitted_on_all_rows(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 0.3, (1990, 4)), r.normal(2, 0.3, (10, 4))])
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")
    w = classic.transport_topics(data, "k", "v", 4).groupBy("topic_id").agg(F.avg("w").alias("w")).collect()
    assert [x.w for x in w] == pytest.approx([0.25] * 4, abs=1e-6)


def test_relevance_prompt_holds_the_whole_text(spark):
    text = "x" * 5000 + " harbour"
    df = spark.createDataFrame([(text, "crane", "Ports")], "t string, k string, s string")
    assert f"\nText: {text}\n" in df.select(chat.relevance_prompt(F.col("t"), F.col("k"), F.col("s"))).first()[0]
