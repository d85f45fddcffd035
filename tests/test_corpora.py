from conftest import rows
from pyspark.sql import functions as F

from corpusloom.models import neural
from corpusloom.sources import corpora

TRAIN = [(1, "The harbour crane lifts cargo cargo", "ports"), (2, "Cargo trains cross bridges", "rail"), (3, None, "ports"), (4, "", None), (5, "crane bridges cargo", None)]
TEST = [(1, "harbour trains", "rail"), (9, "unknownword only", "sea")]


def frames(spark):
    form = "key bigint, body string, topic string, split string"
    return [spark.createDataFrame([(*r, "x") for r in part], form) for part in (TRAIN, TEST)]


def made(spark, **more):
    return corpora.preprocess(*frames(spark), "key", "body", "topic", min_df=2, max_df=0.9, min_terms=1, **more)


def test_both_splits_make_the_vocabulary(spark):
    c = made(spark)
    vocab = {r.term: r.term_id for r in c.vocab.collect()}
    assert sorted(vocab) == ["bridges", "cargo", "crane", "harbour", "trains"] and sorted(vocab.values()) == [0, 1, 2, 3, 4]
    bow = {(r.split, r.key, r.term_id): r.cnt for r in c.bow.collect()}
    assert bow["train", 1, vocab["cargo"]] == 2 and bow["test", 1, vocab["trains"]] == 1
    docs = {(r.split, r.key): (r.label_id, r.text) for r in c.docs.collect()}
    assert docs["train", 1][1] == "harbour crane cargo cargo" and docs["test", 9] == (2, "") and ("train", 3) not in docs
    assert rows(c.labels.select("label")) == [("ports",), ("rail",), ("sea",)] and docs["train", 5][0] is None


def test_folder_round_trip(spark, tmp_path):
    vectors = spark.createDataFrame([("cargo", [1.0, 2.0]), ("nowhere", [0.0, 0.0])], "term string, vector array<double>")
    times = spark.createDataFrame([(1, "2020"), (2, "2021"), (5, "2020")], "key bigint, time string")
    en = corpora.with_times(made(spark, vectors=vectors, lang="en"), times)
    de = made(spark, lang="de")
    both = corpora.both_languages(en, de, spark.createDataFrame([("cargo", "fracht")], "term_a string, term_b string"))
    corpora.write_corpus(both, str(tmp_path / "both"))
    back = corpora.read_corpus(spark, str(tmp_path / "both"), "en")
    assert rows(back.bow) == rows(en.bow) and rows(back.vocab) == rows(en.vocab) and back.dictionary.count() == 1
    corpora.write_corpus(en, str(tmp_path / "en"))
    back = corpora.read_corpus(spark, str(tmp_path / "en"))
    assert back.vectors.count() == 1 and rows(back.times.select("key", "time_slice")) == [(1, 0), (2, 1), (5, 0)]
    docs = corpora.documents(back, "train")
    assert rows(docs.select("key", "grp")) == [(1, 0), (2, 1), (5, 0)]
    model = neural.MODELS["dynamic"](5, 2, hidden=4, groups=2)
    assert len(neural.fit(model, docs, epochs=2, batch=4)) == 1


def test_sizes_and_empty(spark):
    train = spark.range(100).select(F.col("id").alias("key"), F.lit("cargo crane").alias("body"), F.lit("a").alias("topic"))
    c = corpora.preprocess(train, train.filter("key < 30"), "key", "body", "topic", test_size=10, test_share=0.2)
    assert rows(c.docs.groupBy("split").count()) == [("test", 10), ("train", 40)]
    empty = corpora.preprocess(train.limit(0), train.limit(0), "key", "body")
    assert empty.vocab.count() == 0 and empty.bow.count() == 0 and empty.docs.count() == 0
