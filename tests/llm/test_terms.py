import random
from collections import Counter

import pytest
from conftest import rows

from corpusloom.llm.terms import mark_terms, term_frequencies


def brute(lists, n):
    cf, df = Counter(), Counter()
    for x in lists:
        x = [w for w in x or [] if w is not None]
        grams = [tuple(x[i : i + k]) for k in range(1, n + 1) for i in range(len(x) - k + 1)]
        cf.update(grams)
        df.update(set(grams))
    return sorted((list(g), len(g), cf[g], df[g]) for g in cf)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_against_counters(spark, n):
    r = random.Random(n)
    lists = [[r.choice(["a", "b", "c", "é", "the", "the", "the", None]) for _ in range(r.choice([0, 1, 2, 7, 30]))] for _ in range(120)] + [None, []]
    lists += lists[:3]
    df = spark.createDataFrame([(x, "clash", 1) for x in lists], "t array<string>, gram string, cnt int").repartition(3)
    assert sorted((list(x.gram), x.n_terms, x.occurrences, x.n_records) for x in term_frequencies(df, "t", n).collect()) == brute(lists, n)


def test_stretches_meet_in_the_stack(spark, monkeypatch):
    monkeypatch.setattr("corpusloom.llm.terms.STRETCH", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        r = random.Random(9)
        lists = [[r.choice("abcd") for _ in range(r.randint(1, 9))] for _ in range(200)]
        df = spark.createDataFrame([(x,) for x in lists], "t array<string>").repartition(2)
        for n in (1, 3):
            assert sorted((list(x.gram), x.n_terms, x.occurrences, x.n_records) for x in term_frequencies(df, "t", n).collect()) == brute(lists, n)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_record_and_empty(spark):
    df = spark.createDataFrame([(["x", "y"] * 40_000,)], "t array<string>")
    assert rows(term_frequencies(df, "t", 2)) == [(["x"], 1, 40000, 1), (["x", "y"], 2, 40000, 1), (["y"], 1, 40000, 1), (["y", "x"], 2, 39999, 1)]
    assert term_frequencies(df.limit(0), "t", 3).count() == 0


def test_marks(spark):
    df = spark.createDataFrame([(["q"], 1, 9, 2), (["r"], 1, 3, 3), (["s"], 1, 3, 20), (["t"], 1, 3, 21)], "gram array<string>, n_terms int, occurrences bigint, n_records bigint")
    assert [x.mark for x in mark_terms(df, 100).collect()] == ["rare", None, None, "common"]
