import random

from conftest import rows

from corpusloom.llm.components import connected_components


def groups(spark, pairs):
    return rows(connected_components(spark.createDataFrame([(*p, 0, 0) for p in pairs], "a bigint, b bigint, u int, m int"), "a", "b"))


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in root)


def test_chain_star_and_random(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    mixed = [(r.randint(1000, 1200), r.randint(1000, 1200)) for _ in range(90)]
    pairs = chain + star + mixed + [(b, a) for a, b in mixed[:20]] + mixed[:5] + [(7, 7), (None, 3), (4, None)]
    r.shuffle(pairs)
    assert groups(spark, pairs) == brute(pairs)


def test_stretches_that_see_only_parts(spark, monkeypatch):
    monkeypatch.setattr("corpusloom.llm.components.STRETCH", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        pairs = [(i, i + 1) for i in range(1000, 1090)] + [(5, i) for i in range(1500, 1540)] + [(1539, 1090)]
        random.Random(8).shuffle(pairs)
        assert groups(spark, pairs) == brute(pairs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_nodes_are_split(spark, monkeypatch):
    monkeypatch.setattr("corpusloom.llm.components.PLAIN", 5)
    monkeypatch.setattr("corpusloom.llm.components._contract", lambda batches: batches)
    pairs = [(900, i) for i in range(60)] + [(i, i + 70) for i in range(60)]
    assert groups(spark, pairs) == brute(pairs)


def test_nothing_tied(spark):
    assert groups(spark, []) == [] == groups(spark, [(1, 1), (None, 2)])


def test_negative_and_text_keys(spark):
    assert groups(spark, [(-5, 3), (3, 9)]) == [(-5, -5), (3, -5), (9, -5)]
    df = spark.createDataFrame([("b", "a"), ("c", "b")], "x string, y string")
    assert rows(connected_components(df, "x", "y")) == [("a", "a"), ("b", "a"), ("c", "a")]
