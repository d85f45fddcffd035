"""Coherence and diversity of topics from the words that stand for them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import match


def top_terms(rows: DataFrame, by: str, terms: str, k: int) -> DataFrame:
    """(by, pos, word): the ``k`` most frequent values of the arrays ``terms``, ties in the order of the values; pos from 1."""
    counted = rows.select(by, F.explode(terms).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))
    return counted.withColumn("pos", r).filter(F.col("pos") <= k).select(by, "pos", "word")


def word_pairs(topics: DataFrame, topic: str) -> DataFrame:
    """(topic, w1, w2) with w1 before w2 in the topic's order; topics hold few words."""
    a = topics.select(topic, F.col("pos").alias("p1"), F.col("word").alias("w1"))
    b = topics.select(topic, F.col("pos").alias("p2"), F.col("word").alias("w2"))
    return a.join(b, topic).filter("p1 < p2").select(topic, "w1", "w2")


def presence(docs: DataFrame, key: str, tokens: str, topics: DataFrame) -> DataFrame:
    """(key, word): which topic words a document holds as tokens."""
    asked = topics.select("word").distinct()
    return docs.select(key, F.explode(F.array_distinct(tokens)).alias("word")).join(asked, "word")


def words_inside(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """(token, word): the words that lie anywhere in a token; ``tokens`` has token and ``asked`` word, each once.

    Up to MOST_CHARS characters of words go to every task, which reads each token once; more of them are tried on every token.
    """
    if not match.ahocorasick or (asked.agg(F.sum(F.length("word"))).first()[0] or 0) > match.MOST_CHARS:
        return tokens.join(asked, F.expr("contains(token, word)")).select("token", "word")
    shared = tokens.sparkSession.sparkContext.broadcast([r.word for r in asked.filter("word <> ''").collect()])  # bounded by MOST_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = match._automaton(shared.value) if shared.value else None
        for b in batches:
            pairs = [(t, w) for t in b.column(0).to_pylist() for w in {w for _, w in automaton.iter(t)}] if automaton else []
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["token", "word"])

    return tokens.mapInArrow(run, "token string, word string")


def presence_within(docs: DataFrame, key: str, tokens: str, topics: DataFrame) -> DataFrame:
    """(key, word): which topic words a document holds anywhere, also inside a token.

    Words meet the vocabulary, not the documents: a word of letters and digits lies within one token.
    """
    held = docs.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    inside = words_inside(held.select("token").distinct(), topics.select("word").distinct())
    return held.hint("merge").join(inside, "token").select(key, "word").distinct()


def pair_counts(present: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """pairs with n1, n2 and n12: documents that hold each word, and both. One pass over the presences for all pairs."""
    single = present.groupBy("word").agg(F.count("*").alias("n"))
    kinds = pairs.select("w1", "w2").distinct()
    a = present.select(key, F.col("word").alias("w1"))
    b = present.select(key, F.col("word").alias("w2"))
    both = a.join(kinds, "w1").join(b, [key, "w2"]).groupBy("w1", "w2").agg(F.count("*").alias("n12"))
    out = pairs.join(both, ["w1", "w2"], "left")
    for i in (1, 2):
        out = out.join(single.select(F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}")), f"w{i}", "left")
    return out.fillna(0, ["n1", "n2", "n12"])


def window_counts(docs: DataFrame, key: str, tokens: str, topics: DataFrame, pairs: DataFrame, reach: int = 10) -> DataFrame:
    """pair_counts where both words must stand within ``reach`` tokens of each other."""
    asked = topics.select("word").distinct()
    at = docs.select(key, F.posexplode(tokens).alias("p", "word")).join(asked, "word")
    single = at.groupBy("word").agg(F.countDistinct(key).alias("n"))
    kinds = pairs.select("w1", "w2").distinct()
    a = at.select(key, F.col("p").alias("p1"), F.col("word").alias("w1"))
    # words within reach share a block of that width, or stand in neighbouring ones
    block = lambda p: F.floor(p / reach)
    b = at.select(key, F.col("p").alias("p2"), F.col("word").alias("w2"), F.explode(F.array(*[block(F.col("p")) + i for i in (-1, 0, 1)])).alias("block"))
    near = a.withColumn("block", block(F.col("p1"))).join(b, [key, "block"]).filter(F.abs(F.col("p1") - F.col("p2")) <= reach)
    both = near.join(kinds, ["w1", "w2"], "left_semi").select(key, "w1", "w2").distinct().groupBy("w1", "w2").agg(F.count("*").alias("n12"))
    out = pairs.join(both, ["w1", "w2"], "left")
    for i in (1, 2):
        out = out.join(single.select(F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}")), f"w{i}", "left")
    return out.fillna(0, ["n1", "n2", "n12"])


def pmi(n: int) -> Column:
    return F.log(F.col("n12") * n / (F.col("n1") * F.col("n2")))


def npmi(n: int) -> Column:
    """Normalised pointwise mutual information; 1 where both words are in every document, null where a count is 0."""
    return F.when(F.col("n12") == 0, None).when(F.col("n12") == n, 1.0).otherwise(pmi(n) / -F.log(F.col("n12") / n))


def smoothed_pmi(n: int) -> Column:
    return F.log((F.col("n12") / n + 1e-10) / (F.col("n1") / n * F.col("n2") / n + 1e-10))


def umass() -> Column:
    return F.when(F.col("n2") > 0, F.log((F.col("n12") + 1) / F.col("n2")))


def word_quality(topics: DataFrame, topic: str, df: DataFrame, stop_words: list[str]) -> DataFrame:
    """Per topic: share of clean words (letters, longer than 2, no stop word), share of different ones, mean document frequency."""
    stop = F.col("word").isin(stop_words)
    clean = F.col("word").rlike("^[a-z]{3,}$") & ~stop
    known = topics.join(df.select(F.col("term").alias("word"), "df"), "word", "left").fillna(0, ["df"])
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = known.groupBy(topic).agg(share(clean).alias("clean_share"), share(stop).alias("stop_share"), (F.countDistinct("word") / F.count("*")).alias("diversity"), F.avg("df").alias("mean_df"))
    return out.withColumn("quality", F.col("clean_share") * F.col("diversity")).withColumn("is_low", F.col("quality") < 0.5)


def topic_diversity(words: DataFrame, by: list[str]) -> DataFrame:
    """Different words over all words."""
    d = F.when(F.count("*") > 0, F.countDistinct("word") / F.count("*")).otherwise(0.0)
    return words.groupBy(*by).agg(d.alias("diversity"), F.count("*").alias("n_words"))


def word_uniqueness(words: DataFrame, by: list[str]) -> DataFrame:
    """Words of one topic only over different words."""
    per = words.groupBy(*by, "word").agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg((F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.count("*")).alias("uniqueness"))


def once_only(words: DataFrame, by: list[str], total: Column) -> DataFrame:
    """Words that occur once in their group over ``total``, an aggregate of words (n) and topics (t)."""
    per = words.groupBy(*by, "word").agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"), F.sum("n").alias("n")).withColumn("share", F.col("once") / total).drop("n")


def rank_biased_overlap(a: Column, b: Column, p: float = 0.9) -> Column:
    """(1 - p) times the sum over depths d of p^(d-1) |A_d and B_d| / d, down to the shorter list; where the other is longer, plus
    the shorter list's whole agreement once more at p^(its length). 0 where a list is empty."""
    depth = F.least(F.size(a), F.size(b))
    agreed = lambda d: F.size(F.array_intersect(F.slice(a, 1, d), F.slice(b, 1, d))) / d
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d - 1) * agreed(d))
    tail = F.when(F.size(a) != F.size(b), agreed(F.greatest(depth, F.lit(1))) * F.pow(F.lit(p), depth)).otherwise(0.0)
    return F.when(depth > 0, (1 - p) * (total + tail)).otherwise(0.0)


def overlap_coefficient(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(0.0)


def shared_words(words: DataFrame, by: list[str], topic: str) -> DataFrame:
    """(by, a, b, shared, size_a, size_b) for all pairs a < b of topics in a group that share a word. ``words`` has ``topic`` and word.

    Pairs meet at their words instead of each with each; topics that share nothing have no row.
    """
    sets = words.select(*by, topic, "word").distinct()
    sizes = sets.groupBy(*by, topic).agg(F.count("*").alias("n"))
    x, y = sets.withColumnRenamed(topic, "a"), sets.withColumnRenamed(topic, "b")
    shared = x.join(y, [*by, "word"]).filter("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("shared"))
    for side in ("a", "b"):
        shared = shared.join(sizes.select(*by, F.col(topic).alias(side), F.col("n").alias(f"size_{side}")), [*by, side])
    return shared


def slice_npmi(docs: DataFrame, key: str, tokens: str, time_slice: str, topics: DataFrame, topic: str) -> DataFrame:
    """(time_slice, topic, pairs, npmi): ``npmi`` over the documents of each slice alone, of pairs that occur together there; null without any."""
    asked = topics.select("word").distinct()
    held = docs.select(time_slice, key, F.explode(F.array_distinct(tokens)).alias("word")).join(asked, "word")
    single = held.groupBy(time_slice, "word").agg(F.count("*").alias("n"))
    kinds = word_pairs(topics, topic)
    a, b = held.withColumnRenamed("word", "w1"), held.withColumnRenamed("word", "w2")
    both = a.join(kinds.select("w1", "w2").distinct(), "w1").join(b, [time_slice, key, "w2"]).groupBy(time_slice, "w1", "w2").agg(F.count("*").alias("n12"))
    total = docs.groupBy(time_slice).agg(F.count("*").alias("n"))
    counted = kinds.join(both, ["w1", "w2"]).join(total, time_slice)
    for i in (1, 2):
        counted = counted.join(single.select(time_slice, F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}")), [time_slice, f"w{i}"])
    v = F.when(F.col("n12") == F.col("n"), 1.0).otherwise(F.log(F.col("n12") * F.col("n") / (F.col("n1") * F.col("n2"))) / -F.log(F.col("n12") / F.col("n")))
    return counted.groupBy(time_slice, topic).agg(F.count("*").alias("pairs"), F.avg(v).alias("npmi"))


def slice_diversity(topics: DataFrame, slice_terms: DataFrame, time_slice: str, topic: str) -> DataFrame:
    """(time_slice, once, diversity): words of one topic only that the slice's vocabulary holds, over topics times the words of the first topic."""
    per = topics.groupBy(time_slice, "word").agg(F.count("*").alias("n")).filter("n = 1")
    once = per.join(slice_terms.select(time_slice, F.col("term").alias("word")).distinct(), [time_slice, "word"]).groupBy(time_slice).agg(F.count("*").alias("once"))
    sizes = topics.groupBy(time_slice, topic).agg(F.count("*").alias("n")).groupBy(time_slice).agg(F.count("*").alias("k"), F.min_by("n", topic).alias("t"))
    return sizes.join(once, time_slice, "left").fillna(0, ["once"]).select(time_slice, "once", (F.col("once") / (F.col("k") * F.col("t"))).alias("diversity"))


def absent_topic_words(topics: DataFrame, slice_terms: DataFrame, time_slice: str) -> DataFrame:
    """(time_slice, word): topic words that a slice does not hold at all. Slices and topic words are few."""
    words = topics.select("word").distinct()
    return slice_terms.select(time_slice).distinct().crossJoin(words).join(slice_terms.select(time_slice, F.col("term").alias("word")), [time_slice, "word"], "left_anti")
