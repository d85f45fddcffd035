import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusloom.llm import sets


def joined(spark, records, threshold=0.6, least=3):
    df = spark.createDataFrame(records, "rec_table string, k bigint, v array<string>, id string, h string")
    return sets.similar_sets(sets.value_sets(df, "k", "v", least), threshold)


def brute(records, threshold, least):
    clean = {}
    for t, k, v, *_ in records:
        s = frozenset(" ".join(x.lower().split()) for x in v or [] if x and x.strip())
        if len(s) >= least:
            clean[t, k] = s
    ids = sorted(clean)
    return sorted((*a, *b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(clean[a] & clean[b]) >= threshold * len(clean[a] | clean[b]) - 1e-9)


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_against_all_pairs(spark, threshold):
    r = random.Random(int(threshold * 10))
    records, base = [], []
    for i in range(220):
        if base and r.random() < 0.6:
            v = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = f"w{r.randint(0, 60)}"
        else:
            v = [f"w{r.randint(0, 60)}" for _ in range(r.choice([1, 3, 4, 5, 6, 8, 9, 12, 20, 30]))]
            base.append(v)
        records.append((r.choice("ab"), i, [f" {x.upper()} " if r.random() < 0.2 else x for x in v], "x", "y"))
    records += [("a", 900, None, None, None), ("a", 901, [], None, None), ("b", 902, [None, " ", "w1"], None, None)]
    members, links = joined(spark, records, threshold)
    assert rows(sets.expand_links(members, links).drop("similarity")) == brute(records, threshold, 3)
    report = {x.rec_key: x for x in sets.class_report(members, links).collect()}
    assert len(report) == members.count()


def test_empty_and_copies(spark):
    members, links = joined(spark, [])
    assert sets.expand_links(members, links).count() == 0
    members, links = joined(spark, [("a", i, ["x", "y", "z"], None, None) for i in range(4)])
    assert links.count() == 0 and sets.expand_links(members, links).count() == 6
    assert [x.class_size for x in sets.class_report(members, links).collect()] == [4] * 4


def test_sizes():
    t = sets.Fraction(6, 10)
    for a in range(1, 12):
        for b in sets.partner_sizes(a, t):
            c = sets.needed_overlap(a, b, t)
            assert c >= 0.6 * (a + b - c) and (c - 1) < 0.6 * (a + b - c + 1)
    assert sets.subsets_enumerated(sets.largest_small_size(t), t) <= sets.MAX_SUBSETS < sets.subsets_enumerated(sets.largest_small_size(t) + 1, t)


def test_values_are_cleaned(spark):
    df = spark.createDataFrame([("a", 1, ["A  b", "a b", None, " ", "C\td", "e"])], "rec_table string, k bigint, v array<string>")
    assert sets.value_sets(df, "k", "v", 3).select(F.array_join("items", "|")).first()[0] == "a b|c d|e"
