"""Metrics over topics and what is assigned to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.numbers import band, ratio
from corpusloom.functions.text import plain_keywords
from corpusloom.plans.order import in_order

# Labels of the bands.
LOW, MEDIUM, HIGH = "low", "medium", "high"


def texts_per_topic(topics: DataFrame, assignments: DataFrame, topic: str = "topic_id") -> DataFrame:
    """``topics`` with ``n``: assigned rows, 0 where there are none."""
    counted = assignments.groupBy(topic).agg(F.count("*").alias("n"))
    return topics.join(counted, topic, "left").fillna(0, ["n"])


def distribution(counts: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population variance, spread and evenness of ``n``; the smaller the coefficient of variation, the higher the band."""
    mean, std = F.avg("n"), F.stddev_pop("n")
    cv = ratio(std, mean)
    out = counts.groupBy(*by).agg(F.count("*").alias("topics"), mean.alias("mean"), F.var_pop("n").alias("variance"), std.alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), cv.alias("cv"))
    label = F.when(F.col("cv") < 0.3, HIGH).when(F.col("cv") < 0.6, MEDIUM).otherwise(LOW)
    return out.withColumn("band", label)


def high_frequency(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Share of the most frequent fifth of the topics (one at least), stability 1 / (1 + variance / mean) and priority mean / most."""
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"__rank": F.row_number().over(w.orderBy(F.desc("n"), order)), "__of": F.count("*").over(w)})
    top = F.sum(F.when(F.col("__rank") <= F.greatest(F.lit(1), F.floor(F.col("__of") / 5)), F.col("n")).otherwise(0))
    mean = F.avg("n")
    out = ranked.groupBy(*by).agg(ratio(top, F.sum("n")).alias("top_share"), (1 / (1 + ratio(F.var_pop("n"), mean))).alias("stability"), ratio(mean, F.max("n")).alias("priority"))
    limits = [(0.7, HIGH), (0.5, MEDIUM)]
    return out.withColumns({"priority_band": band(F.col("priority"), limits, LOW), "stability_band": band(F.col("stability"), limits, LOW)})


def position_bias(articles: DataFrame, order: str, key: str, cited: DataFrame) -> DataFrame:
    """How often the first 30 %, the middle and the last 30 % of the articles are cited. ``cited`` has ``key``."""
    placed = in_order(articles.select(order, key), [order])
    n = placed.count()
    front, back = int(n * 0.3), int(n * 0.7)
    segment = F.when(F.col("position") < front, "front").when(F.col("position") < back, "middle").otherwise("back")
    ids = placed.withColumn("segment", segment).filter(F.col(key).isNotNull()).select("segment", key).distinct()
    refs = cited.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("hit", F.lit(1))
    per = ids.join(refs, key, "left").groupBy("segment").agg(F.count("*").alias("n"), F.count("hit").alias("c"))
    of = lambda s, c: F.coalesce(F.max(F.when(F.col("segment") == s, F.col(c))), F.lit(0))
    one = per.agg(*[of(s, c).alias(f"{s}_{c}") for s in ("front", "middle", "back") for c in ("n", "c")])
    share = {s: ratio(F.col(f"{s}_c"), F.col(f"{s}_n")) for s in ("front", "middle", "back")}
    one = one.withColumns({f"{s}_share": c for s, c in share.items()})
    f, m, b = (F.col(f"{s}_share") for s in ("front", "middle", "back"))
    mean = (f + m + b) / 3
    return one.withColumns({
        "front_to_middle": f / (m + 0.001), "back_to_middle": b / (m + 0.001), "front_to_back": f / (b + 0.001), "middle_neglect": 1 - m,
        "balance": F.sqrt(((f - mean) ** 2 + (m - mean) ** 2 + (b - mean) ** 2) / 3), "overall": F.lit(refs.count() / n if n else 0.0),
    })


def relevance(rows: DataFrame, key: str, keywords: str, text: str) -> DataFrame:
    """(key, asked, found, relevance, missing): how many of a row's keywords its text holds; 0 and 0 without keywords."""
    k, t = plain_keywords(F.coalesce(F.col(keywords), F.lit(""))), plain_keywords(F.coalesce(F.col(text), F.lit("")))
    sized = rows.select(key, F.size(k).alias("asked"), F.size(F.array_intersect(k, t)).alias("found"))
    score = ratio(F.col("found"), F.col("asked"))
    return sized.withColumns({"relevance": score, "missing": F.when(F.col("asked") > 0, F.round(1 - score, 4)).otherwise(0.0)})


def relevance_summary(scored: DataFrame) -> DataFrame:
    s = F.col("relevance")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return scored.agg(
        F.count("*").alias("rows"), F.avg(s).alias("mean"), F.percentile(s, F.lit(0.5)).alias("median"), F.stddev_pop(s).alias("std"), F.avg("missing").alias("mean_missing"),
        count(s >= 0.7).alias("high"), count((s >= 0.3) & (s < 0.7)).alias("medium"), count(s < 0.3).alias("low"), count(F.col("missing") > 0.5).alias("severe"),
    )


def attempts(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Statistics of repeated attempts: ``made`` topics each; the best attempt is the first of the most topics."""
    ok = F.when(F.col("made") > 0, F.col("made"))
    w = Window.partitionBy(*by).orderBy(F.desc("made"), order)
    ranked = rows.withColumn("__rank", F.row_number().over(w))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("attempts"), F.max("made").alias("most"), F.coalesce(F.avg(ok), F.lit(0.0)).alias("average"), F.coalesce(F.min(ok), F.lit(0)).alias("least"),
        F.when(F.count(ok) > 1, F.stddev_pop(ok)).otherwise(0.0).alias("std"), (F.count(ok) / F.count("*")).alias("success_rate"), F.max(F.when(F.col("__rank") == 1, F.col(order))).alias("best"),
    )


def judged_diversity(pairs: DataFrame, n_topics: int) -> DataFrame:
    """Shares of redundant and overlapping pairs among all; ``pairs`` has ``kind``."""
    possible = n_topics * (n_topics - 1) / 2
    redundant, overlap = (F.sum(F.when(F.col("kind") == k, 1).otherwise(0)) for k in ("redundant", "overlap"))
    return pairs.agg(redundant.alias("redundant"), overlap.alias("overlap"), (redundant / n_topics).alias("redundancy"), (overlap / possible).alias("overlap_rate"))


def score_summary(rows: DataFrame, scores: list[str], digits: int = 6) -> DataFrame:
    """(score, n, mean, median, std, least, most, level) of complete rows: sample deviation, 0 for one row."""
    full = rows.dropna(subset=scores)
    long = full.select(F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("v")) for s in scores])).alias("x")).select("x.*")
    out = long.groupBy("score").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))
    level = band(F.col("mean"), [(4.5, "excellent"), (4.0, "good"), (3.5, "fair"), (3.0, "passing")], "poor", strict=False)
    return out.select("score", "n", *[F.round(c, digits).alias(c) for c in ("mean", "median", "std", "least", "most")], level.alias("level"))


def decision(c):
    """yes or no in any case and spacing; anything else, null and blank included, is an error."""
    word = F.lower(F.trim(c))
    return F.when(word.isin("yes", "no"), word).otherwise("error")


def decision_rollup(rows: DataFrame, by: str, decided: str) -> DataFrame:
    """(by, total, yes, no, error, yes_share): one row per value of ``by`` and one, with null, overall."""
    d = decision(F.col(decided))
    per = rows.select(by, d.alias("d")).groupBy(by).agg(F.count("*").alias("total"), *[F.sum(F.when(F.col("d") == k, 1).otherwise(0)).alias(k) for k in ("yes", "no", "error")])
    overall = per.agg(*[F.sum(c).alias(c) for c in ("total", "yes", "no", "error")]).select(F.lit(None).cast(per.schema[by].dataType).alias(by), "total", "yes", "no", "error")
    both = per.filter(F.col(by).isNotNull()).unionByName(overall)
    return both.withColumn("yes_share", ratio(F.col("yes"), F.col("total")))
