"""Topics in layers: who is whose child, and how well the layers hang together. A topic is (layer, topic) with its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(phi: DataFrame) -> DataFrame:
    """(parent, child): for every parent the round(children / parents) children of the largest weight, at least one (half to even)."""
    sizes = phi.agg(F.countDistinct("parent").alias("k0"), F.countDistinct("child").alias("k1")).first()
    k = max(1, round(sizes.k1 / sizes.k0)) if sizes.k0 else 1
    r = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("w"), "child"))
    return phi.withColumn("r", r).filter(F.col("r") <= k).select("parent", "child")


def _pairs(links: DataFrame, upper: DataFrame, lower: DataFrame) -> DataFrame:
    return links.join(upper.select(F.col("topic").alias("parent"), F.col("word").alias("w1")), "parent").join(lower.select(F.col("topic").alias("child"), F.col("word").alias("w2")), "child")


def cross_level(links: DataFrame, upper: DataFrame, lower: DataFrame, counts, n: int) -> DataFrame:
    """(parent, child, coherence): mean association of the words of a parent with those of its child.

    Words in both cost: each pair of shared words counts -1, and shared words take no part in other pairs.
    ``counts`` turns (w1, w2) into n1, n2, n12 over ``n`` documents.
    """
    pairs = _pairs(links, upper, lower)
    shared = pairs.filter("w1 = w2").select("parent", "child", F.col("w1").alias("s"))
    own = pairs.join(shared.withColumnRenamed("s", "w1"), ["parent", "child", "w1"], "left_anti").join(shared.withColumnRenamed("s", "w2"), ["parent", "child", "w2"], "left_anti")
    p = {x: F.col(x) / n for x in ("n1", "n2", "n12")}
    score = F.when(F.col("n12") == n, 1.0).when((F.col("n1") == 0) | (F.col("n2") == 0), 0.0).otherwise(F.log((p["n12"] + 1e-10) / (p["n1"] * p["n2"])) / -F.log(p["n12"] + 1e-10))
    scored = counts(own).groupBy("parent", "child").agg(F.sum(score).alias("s"), F.count("*").alias("n"))
    cost = shared.groupBy("parent", "child").agg((F.count("*") * F.count("*")).alias("x"))
    both = links.join(scored, ["parent", "child"], "left").join(cost, ["parent", "child"], "left").fillna(0, ["s", "n", "x"])
    total = F.col("n") + F.col("x")
    return both.select("parent", "child", F.when(total > 0, (F.col("s") - F.col("x")) / total).otherwise(0.0).alias("coherence"))


def difference(links: DataFrame, upper: DataFrame, lower: DataFrame) -> DataFrame:
    """(parent, child, diversity): words that only one of the two holds, over the words of both."""
    a = links.join(upper.select(F.col("topic").alias("parent"), "word"), "parent")
    b = links.join(lower.select(F.col("topic").alias("child"), "word"), "child")
    per = a.unionByName(b).groupBy("parent", "child", "word").agg(F.count("*").alias("n"))
    return per.groupBy("parent", "child").agg((F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.sum("n")).alias("diversity"))


def strangers(phi: DataFrame, links: DataFrame) -> DataFrame:
    """(parent, child): topics of the lower layer that are no children. Layers hold few topics."""
    parents, children = phi.select("parent").distinct(), phi.select("child").distinct()
    return parents.join(children, F.lit(True)).join(links, ["parent", "child"], "left_anti")


def sibling_diversity(links: DataFrame, lower: DataFrame) -> DataFrame:
    """(parent, diversity): words that one child only holds, over all words of the parent's children."""
    held = links.join(lower.select(F.col("topic").alias("child"), "word"), "child").groupBy("parent", "word").agg(F.count("*").alias("n"))
    return held.groupBy("parent").agg((F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.sum("n")).alias("diversity"))


def siblings(links: DataFrame) -> DataFrame:
    """(parent, a, b): pairs of children of one parent."""
    x, y = links.select("parent", F.col("child").alias("a")), links.select("parent", F.col("child").alias("b"))
    return x.join(y, "parent").filter(F.col("a") < F.col("b"))


def describe(value: Column) -> Column:
    return F.round(value, 6)
