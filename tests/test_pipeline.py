import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusloom import cli, queries_study
from corpusloom.functions import jsontext
from corpusloom.models import transport
from corpusloom.operators import chat, languages, pipeline, runner
from corpusloom.sources import files


def clients():
    """Defined inside, so that workers get them whole."""

    class Stored:
        def complete(self, prompt, max_tokens, temperature):
            assert "ID: 1 | Title: Port" in prompt
            return '[{"Topic 1": {"Summary": "Ports", "Keywords": ["harbour", "crane", "cargo", "quay", "ship"]}}, {"Topic 2": {"Summary": "Rail", "Keywords": ["train"]}}]'

    class Nothing:
        def complete(self, prompt, max_tokens, temperature):
            return "I cannot help."

    return Stored, Nothing


def articles(spark):
    data = [(i, str(i), t, b, None, None, None, "x") for i, (t, b) in enumerate([("", "no title"), ("Port", "The harbour crane lifts cargo."), ("Train", "A train leaves."), ("Nil", None)])]
    return spark.createDataFrame(data, "row_id bigint, id string, title string, text string, topic string, pub_date string, keywords string, summary string")


def test_analysis(spark):
    Stored, Nothing = clients()
    topics, matches = pipeline.analyze(articles(spark), "row_id", 4096, Stored)
    assert rows(topics.select("topic_id", "summary", "meets")) == [(1, "Ports", True), (2, "Rail", False)]
    assert rows(matches.select("topic_id", "row_id", "match_score")) == [(1, 1, 3), (2, 2, 2)]
    topics, matches = pipeline.analyze(articles(spark), "row_id", 4096, Nothing)
    assert topics.count() == 0 and matches.count() == 0
    assert pipeline.analyze(articles(spark).limit(0), "row_id", 4096, Stored)[0].count() == 0


def test_input_fits(spark):
    df = spark.range(400).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("id"), F.lit("T").alias("title"), F.lit("word " * 60).alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("topic", "pub_date", "keywords")])
    lines = pipeline.sized_lines(df, "row_id")
    shown = pipeline.prepared_input(lines, 2000)
    assert shown.agg(F.sum("tokens")).first()[0] <= 2000 and shown.count() >= 20
    keys = [r.key for r in shown.orderBy("position").collect()]
    assert keys == sorted(keys)


def test_hierarchies_resume(spark, tmp_path):
    class Narrow:
        def complete(self, prompt, max_tokens, temperature):
            return 'Here: {"secondary_topics": ["a"], "tertiary_topics": "none"}'

    made = pipeline.hierarchies(articles(spark), "row_id", Narrow)
    assert rows(made.select("row_id", "secondary", "tertiary")) == [(i, ["a"], []) for i in range(4)]
    done = articles(spark).filter("row_id < 3").select("row_id")
    assert rows(pipeline.hierarchies(articles(spark), "row_id", Narrow, done).select("row_id")) == [(3,)]


def test_refusals_are_not_tried_again(spark):
    class Refusing:
        def complete(self, prompt, max_tokens, temperature):
            from corpusloom.operators import chat as service

            raise service.failure(int(prompt))

    df = spark.createDataFrame([(1, "401"), (2, "402"), (3, "418")], "k int, p string")
    errors = {r.k: r.error for r in chat.call_all(df, "k", "p", Refusing).collect()}
    assert "key" in errors[1] and "credit" in errors[2] and "418" in errors[3]
    assert chat.failure(429, "7").wait == 7 and chat.failure(429, "soon").wait == 60 and chat.failure(503).wait is None


def test_replies(spark):
    df = spark.createDataFrame([('{"secondary_topics": ["a"], "tertiary_topics": 3}',), ("```json\n{\"secondary_topics\": [\"b\"]}\n```",), ("nothing",), (None,), ("[1]",)], "r string")
    got = [tuple(x.h) for x in df.select(jsontext.hierarchy_topics(F.col("r")).alias("h")).collect()]
    assert got == [(["a"], []), (["b"], []), ([], []), ([], []), ([], [])]
    df = spark.createDataFrame([('x {"redundant_pairs": ["a"], "mergeable_groups": [["a", "b"], ["c"]]} y', 5), ("no", 4)], "r string, n int")
    got = [tuple(x.e) for x in df.select(jsontext.diversity_reply(F.col("r"), F.col("n")).alias("e")).collect()]
    assert got == [(1, 0, 5, 0.8, 3, False), (0, 0, 4, 0.8, 0, True)]
    long = '"Summary": "' + "s" * 2000 + '", "Keywords": [' + ", ".join(f'"k{i}"' for i in range(40)) + "]"
    t = spark.createDataFrame([(long,)], "r string").select(F.explode(jsontext.parse_topics(F.col("r"))).alias("t")).first().t
    assert len(t.summary) == 2000 and len(t.keywords) == 40 and t.rescued


def test_diversity_replies_of_many_topics(spark, tmp_path):
    n = 50_000  # n * (n - 1) is beyond 32 bits
    pairs = spark.range(n).select(
        F.when(F.col("id") % 5 > 0, "m").alias("model"), F.when(F.col("id") % 4 == 0, "redundant_pairs").otherwise("partial_overlap_pairs").alias("pair_list"),
        F.col("id").alias("topic1_id"), (F.col("id") + 1).alias("topic2_id"),
    )
    pairs.union(pairs.withColumn("model", F.lit("big"))).write.parquet(str(tmp_path / "topic_diversity_results.parquet"))
    got = {r.model: (r.n_topics, r.redundant, r.overlap, r.unique_topics, r.diversity, r.overlap_rate) for r in queries_study.diversity_replies(spark, str(tmp_path)).collect()}
    assert got == {"big": (50000, 12500, 37500, 49999, 0.55, 3e-05), "m": (40000, 10000, 30000, 39999, 0.55, 3.8e-05), None: (10000, 2500, 7500, 9999, 0.55, 0.00015)}


def test_languages(spark):
    a, b = spark.createDataFrame([(i,) for i in range(5)], "k int"), spark.createDataFrame([(10,), (11,)], "k int")
    assert rows(languages.zipped_round(a, b, "k")) == [(0, 0, 10), (1, 1, 11), (2, 2, 10), (3, 3, 11), (4, 4, 10)]
    assert languages.zipped_round(a, b.limit(0), "k").count() == 0


def test_runner_goes_on_after_a_failure(spark):
    metrics = {"good": (lambda s, d: s.range(3), "id"), "bad": (lambda s, d: s.range(3), "nowhere")}
    report = runner.run_metrics(spark, "", metrics)
    assert {r.metric: (r.status, r.value) for r in report.collect()} == {"good": ("ok", 1.0), "bad": ("failed", None)}
    assert runner.summary(report).first().success_rate == 0.5


def test_more_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("text|n\nCafé|1\n|2\n".encode("latin-1"))
    assert rows(files.read_texts(spark, str(tmp_path / "t.csv"))) == [("Café",)]
    (tmp_path / "topics.json").write_text('{"topics": [{"keywords": ["a", "b"], "name": "N"}, ["c"]]}')
    assert [(r.name, r.description) for r in files.load_topics(spark, str(tmp_path / "topics.json")).collect()] == [("N", "a, b"), ("Topic_1", "c")]
    with pytest.raises(ValueError):
        files.load_topics(spark, {"a": 1})
    (tmp_path / "stop.txt").write_text("und\noder\n\n")
    assert files.stop_words(spark, str(tmp_path / "stop.txt")) == ["und", "oder"] and "the" in files.stop_words(spark, "English") and files.stop_words(spark, ["x"]) == ["x"]
    df = spark.createDataFrame([(1, 'say "x",\ny', 3, ["a", "b"])], "id int, text string, topic_id int, words array<string>")
    files.write_assignments(df, str(tmp_path / "out"))
    assert rows(files.read_assignments(spark, str(tmp_path / "out"))) == rows(df)
    assert files.first_line(spark, str(tmp_path / "none*")) is None


def test_names(spark, capsys):
    assert transport.distance("poincare", transport.into_ball(transport.np.ones((1, 2))), transport.np.zeros((1, 2))).shape == (1, 1)
    with pytest.raises(ValueError):
        transport.distance("sphere", None, None)
    assert cli.main(["run", "docs_per_slice", "/root/testdata/sf0.001"]) == 0 and "time_slice" in capsys.readouterr().out
