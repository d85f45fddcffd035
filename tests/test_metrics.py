"""Published statistics recomputed from the counts they come from, and small cases by hand."""

import itertools
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusloom.operators import coherence as co
from corpusloom.operators import theta as th
from corpusloom.operators import topicmetrics as tm


@pytest.mark.parametrize(
    ("counts", "mean", "variance", "std", "cv", "band"),
    [
        ([12, 25, 25, 25, 25, 25, 5, 0, 15, 25, 15, 25, 25], 19.0, 71.23, 8.44, 0.4442, "medium"),
        ([34, 40, 40, 40, 40, 40, 40, 39, 40, 40], 39.3, 3.21, 1.79, 0.0456, "high"),
        ([40, 40, 40, 28, 40, 40, 40, 40, 40, 36], 38.4, 13.44, 3.67, 0.0955, "high"),
    ],
)
def test_distribution(spark, counts, mean, variance, std, cv, band):
    df = spark.createDataFrame([(1, n) for n in counts], "g int, n bigint")
    r = tm.distribution(df, ["g"]).first()
    assert (round(r["mean"], 2), round(r.variance, 2), round(r.std, 2), round(r.cv, 4), r.band) == (mean, variance, std, cv, band)


def test_high_frequency(spark):
    counts = [12, 25, 25, 25, 25, 25, 5, 0, 15, 25, 15, 25, 25]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(counts)], "g int, t int, n bigint")
    r = tm.high_frequency(df, ["g"], "t").first()
    assert (round(r.top_share, 4), round(r.stability, 4), round(r.priority, 2)) == (0.2024, 0.2106, 0.76)
    zero = tm.high_frequency(df.withColumn("n", F.lit(0)), ["g"], "t").first()
    assert (zero.top_share, zero.priority, zero.stability) == (0.0, 0.0, 1.0)


def test_position_bias(spark):
    articles = spark.range(14000).select(F.col("id").alias("row"), F.col("id").cast("string").alias("k"))
    cited = [*range(428), *range(4200, 4473), *range(9800, 9929)]
    refs = spark.createDataFrame([(str(i),) for i in cited + cited[:9]] + [(None,)], "k string")
    r = tm.position_bias(articles, "row", "k", refs).first()
    assert (round(r.front_share, 4), round(r.middle_share, 4), round(r.back_share, 4)) == (0.1019, 0.0488, 0.0307)
    assert (round(r.front_to_middle, 4), round(r.back_to_middle, 4), round(r.front_to_back, 4)) == (2.0483, 0.6174, 3.2132)
    assert (round(r.middle_neglect, 4), round(r.balance, 4), round(r.overall, 4)) == (0.9513, 0.0302, 0.0593)


def test_attempts_and_diversity(spark):
    df = spark.createDataFrame([("m", "a", 64), ("m", "b", 89), ("m", "c", 0)], "m string, r string, made bigint")
    r = tm.attempts(df, ["m"], "r").first()
    assert (r.most, r.average, r.least, r["std"], round(r.success_rate, 2), r.best) == (89, 76.5, 64, 12.5, 0.67, "b")
    pairs = spark.createDataFrame([("overlap",)] * 6, "kind string")
    assert round(tm.judged_diversity(pairs, 10).first().overlap_rate, 4) == 0.1333


def test_decisions(spark):
    df = spark.createDataFrame([(1, " Yes"), (1, "no"), (1, None), (2, "error"), (2, "")], "t int, d string")
    assert sorted(tuple(r)[1:5] for r in tm.decision_rollup(df, "t", "d").collect()) == [(2, 0, 0, 2), (3, 1, 1, 1), (5, 1, 1, 3)]


def test_pair_scores_against_loops(spark):
    r = random.Random(1)
    docs = [[r.choice("abcdefgh") for _ in range(r.randint(1, 25))] for _ in range(60)]
    topics = {0: "abc", 1: "bdz"}
    d = spark.createDataFrame(list(enumerate(docs)), "k int, ws array<string>")
    t = spark.createDataFrame([(k, i, w) for k, ws in topics.items() for i, w in enumerate(ws)], "topic int, pos int, word string")
    pairs = co.word_pairs(t, "topic")
    want = sorted((k, a, b, sum(a in x for x in docs), sum(b in x for x in docs), sum(a in x and b in x for x in docs)) for k, ws in topics.items() for a, b in itertools.combinations(ws, 2))
    got = co.pair_counts(co.presence(d, "k", "ws", t), "k", pairs)
    assert rows(got.select("topic", "w1", "w2", "n1", "n2", "n12")) == want
    near = lambda x, a, b: any(p == a and b in x[max(0, i - 3) : i + 4] for i, p in enumerate(x))
    within = co.window_counts(d, "k", "ws", t, pairs, reach=3)
    assert rows(within.select("topic", "w1", "w2", "n12")) == sorted((k, a, b, sum(near(x, a, b) for x in docs)) for k, ws in topics.items() for a, b in itertools.combinations(ws, 2))
    scores = got.filter("w1 = 'a' and w2 = 'b'").select(co.npmi(60), co.umass()).first()
    n1, n2, n12 = next(w[3:] for w in want if w[1:3] == ("a", "b"))
    if 0 < n12 < 60:
        assert scores[0] == pytest.approx(math.log(n12 * 60 / n1 / n2) / -math.log(n12 / 60)) and -1 <= scores[0] <= 1


def test_rank_biased_overlap(spark):
    df = spark.createDataFrame([(list("abc"), list("acd")), ([], ["a"]), (list("ab"), list("ab"))], "a array<string>, b array<string>")
    got = [x[0] for x in df.select(co.rank_biased_overlap(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.1 * (1 + 0.9 * 0.5 + 0.81 * 2 / 3), 0.0, 0.1 * 1.9])


def test_clustering(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("y", 2), ("z", 2)], "t string, p int")
    r = th.purity_nmi(df, "t", "p").first()
    n = {("x", 1): 2, ("y", 1): 1, ("y", 2): 1, ("z", 2): 1}
    t, p = {"x": 2, "y": 2, "z": 1}, {1: 3, 2: 2}
    mi = sum(v / 5 * math.log(v * 5 / t[a] / p[b]) for (a, b), v in n.items())
    h = lambda c: -sum(v / 5 * math.log(v / 5) for v in c.values())
    assert r.purity == pytest.approx(0.6) and r.nmi == pytest.approx(2 * mi / (h(t) + h(p)))
    f = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    r = th.accuracy_f1(f, "t", "p").first()
    assert (r.accuracy, r.macro_f1) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
