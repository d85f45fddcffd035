import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import rows

from corpusloom.llm import neardup as nd


def corpus(seed, n, sizes):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = list(r.choice(out))
            for _ in range(r.randint(0, max(1, len(w) // 4))):
                w[r.randrange(len(w))] = f"z{r.randint(0, 5000)}"
        else:
            w = [r.choice(common) if r.random() < 0.6 else f"z{r.randint(0, 5000)}" for _ in range(r.choice(sizes))]
        out.append(w)
    return out


def brute(texts, threshold, least):
    s = {i: frozenset(t) for i, t in enumerate(texts) if t is not None and len(set(t)) >= least}
    return sorted((i, j) for i, j in itertools.combinations(sorted(s), 2) if len(s[i] & s[j]) >= threshold * len(s[i] | s[j]) - 1e-9)


@pytest.mark.parametrize(("threshold", "sizes", "least"), [(0.7, (25, 40, 60), 20), (0.8, (8, 12, 300), 5), (0.5, (30, 90), 20)])
def test_against_all_pairs(spark, threshold, sizes, least):
    texts = corpus(int(threshold * 100), 260, sizes)
    texts += texts[:4] + [None, [], ["a"]]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "i bigint, w array<string>, h int, set_id int")
    members, links = nd.similar_records(nd.word_sets(df, "i", "w", least), threshold, least)
    assert rows(nd.expand_links(members, links).select("a", "b")) == brute(texts, threshold, least)
    report = nd.class_report(members, links)
    assert report.count() == members.count() and report.filter("rec_key < class_id").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "i bigint, w array<string>")
    members, links = nd.similar_records(nd.word_sets(df, "i", "w", 20), 0.7, 20)
    assert nd.expand_links(members, links).count() == 0


def test_allocation_is_least():
    r = np.random.default_rng(1)
    for _ in range(60):
        parts, records = r.integers(1, 5), 4
        cost = r.random((records, parts, 4)) * [0, 1, 2, 3]
        budget = r.integers(0, parts * 3 + 1, records)
        t = nd.allocate(cost, budget)
        assert ((t + 1).sum(1) >= budget).all()
        for i in range(records):
            best = min(sum(cost[i, p, o] for p, o in enumerate(x)) for x in itertools.product(range(4), repeat=parts) if sum(x) >= budget[i])
            assert cost[i, np.arange(parts), t[i] + 1].sum() == pytest.approx(best, rel=1e-5)


def test_allocation_in_blocks_reaches_the_budget():
    r = np.random.default_rng(2)
    parts = 3 * nd.BLOCK + 5
    budget = np.array([0, 1, parts, 2 * parts - 1, 2 * parts])
    t = nd.allocate(r.random((5, parts, 3)), budget)
    assert ((t + 1).sum(1) >= budget).all() and t.min() >= -1 and t.max() <= 1


def test_no_pair_is_lost_with_hot_keys(spark):
    # records of which most words are the same: every partition without a changed word has one key for all
    base = [f"c{i}" for i in range(60)]
    texts = [base[: 60 - i % 7] + [f"n{i}", f"m{i % 50}"] for i in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, w array<string>").repartition(3)
    found = nd.expand_links(*nd.similar_records(nd.word_sets(df, "i", "w", 20), 0.9, 20))
    assert rows(found.select("a", "b")) == brute(texts, 0.9, 20)


def test_copies_of_one_text(spark):
    texts = [[f"c{i}" for i in range(30)]] * 90 + [[f"c{i}" for i in range(29)] + ["x"]] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, w array<string>").repartition(4)
    members, links = nd.similar_records(nd.word_sets(df, "i", "w", 20), 0.7, 20)
    assert links.count() == 1
    assert rows(nd.expand_links(members, links).select("a", "b")) == brute(texts, 0.7, 20)
    report = nd.class_report(members, links).toPandas()
    assert report.class_size.value_counts().to_dict() == {90: 90, 20: 20} and set(report.links) == {1} and set(report.class_id) == {0, 90}


def test_classes_cover_all_sizes():
    t = Fraction(7, 10)
    bounds = nd.size_bounds(20, 5000, t)
    assert bounds[0][0] == 20 and bounds[-1][1] > 5000 and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    for size in range(20, 5000, 7):
        assert 1 <= sum(reach <= size < high for _, high, reach in bounds) <= 2


def test_sketch_never_exceeds_the_distance():
    r = np.random.default_rng(0)
    for _ in range(50):
        a = r.integers(0, 2**63, 60).astype(np.uint64)
        b = np.concatenate([a[:50], r.integers(0, 2**63, 15).astype(np.uint64)])
        s = nd._sketch(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b])).view(np.uint64)
        assert sum(int(x).bit_count() for x in s[0] ^ s[1]) <= 25
