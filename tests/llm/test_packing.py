import itertools
import random

import numpy as np
import pytest
from conftest import rows

from corpusloom.llm import mixing, packing
from corpusloom.llm.tokens import TOKENIZER, load, measured


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def packed(spark, sizes, capacity, parts=2):
    df = spark.createDataFrame([(i, s, i * 7 % 50, "x", 1) for i, s in enumerate(sizes)], "id bigint, size bigint, curve bigint, place string, container int")
    return packing.pack(df, "id", "size", "curve", capacity, parts).toPandas()


def test_every_item_once_and_no_overflow(spark):
    r = np.random.default_rng(4)
    sizes = [int(x) for x in r.integers(0, 60, 3000)] + [100, 101, 250, 0, 300]
    p = packed(spark, sizes, 100)
    per = p.groupby("id").tokens.sum()
    assert [int(per[i]) for i in range(len(sizes))] == sizes
    assert p.groupby("container").tokens.sum().max() <= 100
    for i, s in enumerate(sizes):
        mine = p[p.id == i].sort_values("piece")
        assert len(mine) == max(1, -(-s // 100)) and mine.token_from.tolist() == [100 * k for k in range(len(mine))]
    for _, c in p.groupby("container"):
        assert sorted(c.place) == list(range(1, len(c) + 1))
    assert sum(sizes) / (100 * p.container.nunique()) > 0.98


def span(p, rank):
    """Median distance between the first and the last rank in a container of two items or more."""
    at = p.assign(rank=p.id.map(rank)).groupby("container")["rank"]
    return (at.max() - at.min() + 1)[at.count() > 1].median()


@pytest.mark.parametrize("n", [1000, 9000])
def test_containers_hold_neighbours(spark, n):
    r = np.random.default_rng(n)
    sizes = [int(x) for x in r.lognormal(5, 0.9, n)]
    curve = r.permutation(n)
    df = spark.createDataFrame([(i, s, int(c)) for i, (s, c) in enumerate(zip(sizes, curve))], "id bigint, size bigint, curve bigint")
    p = packing.pack(df, "id", "size", "curve", 4096, 1).toPandas()
    assert p.tokens.sum() == sum(sizes) and p.tokens.sum() / (4096 * p.container.nunique()) > 0.97
    shuffled = dict(enumerate(r.permutation(n)))
    assert span(p, dict(enumerate(curve))) < span(p, shuffled) / 10
    wide = packing.pack(df, "id", "size", "curve", 4096, 1, window=512).toPandas()
    assert span(wide, dict(enumerate(curve))) > span(p, dict(enumerate(curve)))


def test_best_sum():
    r = random.Random(5)
    for _ in range(200):
        sizes, room = [r.randint(0, 30) for _ in range(r.randint(0, 8))], r.randint(0, 60)
        got = packing.best_sum(sizes, room)
        best = max(s for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if (s := sum(c)) <= room)
        assert len(set(got)) == len(got) and sum(sizes[i] for i in got) == best


def test_one_capacity_empty_and_errors(spark):
    assert packed(spark, [1, 1, 0], 1).container.nunique() in (2, 3)
    assert len(packed(spark, [], 10)) == 0
    with pytest.raises(ValueError):
        packed(spark, [1], 0)


def test_texts(spark):
    texts = ["one two", None, "", "long " * 500, "one two", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "tokens bigint, t string").withColumnRenamed("tokens", "k")
    t = load(TOKENIZER)
    counts = dict(rows(measured(df, "k", "t").select("k", "tokens")))
    assert counts == {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in enumerate(texts)}
    assert counts[5] > 1
    sizes = {"small": 64, "large": 4096}
    p = packing.pack_texts(df, "k", "t", sizes).toPandas()
    for name, capacity in sizes.items():
        mine = p[p.name == name]
        assert mine.groupby("k").tokens.sum().to_dict() == counts and mine.groupby("container").tokens.sum().max() <= capacity
    assert [r.containers for r in packing.fill_report(packing.pack_texts(df.limit(0), "k", "t", sizes), sizes).collect()] == [0, 0]
    assert packing.pack_texts(df, "k", "t", {}).count() == 0


def test_mixing(spark):
    texts = [(i, "word " * (1 + i % 9), " Big " if i % 3 else "BIG", 0) for i in range(3000)] + [(5000 + i, "word word", "small", 0) for i in range(60)]
    texts += [(9000, None, None, 0), (9001, "x", "none", 0), (9002, "", "small", 0)]
    docs = spark.createDataFrame(texts, "id bigint, t string, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.7, 1), ("Small", 0.2, 4), ("gone", 0.1, 2), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix_sources(docs, "id", "t", "source", targets)
    d, r = drawn.toPandas(), report.toPandas().set_index("source_key")
    assert d.id.is_unique and set(d.source_key) == {"big", "small"}
    assert d[d.source_key == "small"].uses.max() == 4 and r.loc["small", "capped"] and r.loc["gone", "capped"]
    big = d[d.source_key == "big"]
    assert big.uses.max() == 1 and abs((big.tokens * big.uses).sum() / r.loc["big", "available"] - r.loc["big", "rate"]) < 0.05
    assert abs(r.actual_share.sum() - 1) < 1e-9 and r.loc["none", "used_docs"] == 0
    again, _ = mixing.mix_sources(docs.repartition(7), "id", "t", "source", targets)
    assert rows(again) == rows(drawn)
    nothing, empty = mixing.mix_sources(docs.limit(0), "id", "t", "source", targets)
    assert nothing.count() == 0 and empty.count() == 4
