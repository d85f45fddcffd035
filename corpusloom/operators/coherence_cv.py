"""Coherence by indirect confirmation over boolean sliding windows (Röder, Both and Hinneburg, 2015)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_presence(docs: DataFrame, tokens: str, topics: DataFrame, size: int = 110) -> tuple[DataFrame, int]:
    """(w1, w2, n) with w1 <= w2: sliding windows of ``size`` tokens that hold both words (w1 = w2: the word), and the number of windows.

    A text of fewer tokens is one window; an empty one is none. ``topics`` has ``word``; its words are few and
    go to every task.
    """
    asked = {r.word: i for i, r in enumerate(topics.select("word").distinct().orderBy("word").collect())}
    names = list(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), len(names)), np.int64)
        windows = 0
        for pdf in batches:
            for ws in pdf["ws"]:
                if ws is None or not len(ws):
                    continue
                last = max(0, len(ws) - size)  # the last window's start
                windows += last + 1
                at = [(p, asked[w]) for p, w in enumerate(ws) if w in asked]
                ids = sorted({i for _, i in at})
                place = {i: k for k, i in enumerate(ids)}
                edge = np.zeros((len(ids), last + 2), np.int64)
                for p, i in at:
                    edge[place[i], max(0, p - size + 1)] += 1
                    edge[place[i], min(p, last) + 1] -= 1
                held = (np.cumsum(edge[:, :-1], axis=1) > 0).astype(np.int64)
                if ids:
                    total[np.ix_(ids, ids)] += held @ held.T
        i, j = np.nonzero(np.triu(total))
        yield pd.DataFrame({"w1": [*(names[k] for k in i), ""], "w2": [*(names[k] for k in j), ""], "n": [*total[i, j].tolist(), windows]})

    counted = docs.select(F.col(tokens).alias("ws")).mapInPandas(run, "w1 string, w2 string, n bigint").groupBy("w1", "w2").agg(F.sum("n").alias("n"))
    rows = counted.filter("w1 = ''").collect()  # one row: the number of windows
    return counted.filter("w1 <> ''"), int(rows[0].n) if rows else 0


def coherence_cv(docs: DataFrame, tokens: str, topics: DataFrame, topic: str, size: int = 110) -> DataFrame:
    """(topic, coherence): mean cosine between each word's associations with the topic's words and their sum; 0 without any."""
    from corpusloom.plans.durable import durable

    found, windows = window_presence(docs, tokens, topics, size)
    found = durable(found)
    both = found.unionByName(found.filter("w1 <> w2").select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "n"))
    single = found.filter("w1 = w2").select(F.col("w1").alias("w"), "n")
    a, b = topics.select(topic, F.col("word").alias("w1")), topics.select(topic, F.col("word").alias("w2"))
    pairs = a.join(b, topic).join(both.withColumnRenamed("n", "n12"), ["w1", "w2"], "left")
    for i in (1, 2):
        pairs = pairs.join(single.select(F.col("w").alias(f"w{i}"), F.col("n").alias(f"n{i}")), f"w{i}", "left")
    pairs = pairs.fillna(0, ["n12", "n1", "n2"])
    p = F.col("n12") / max(windows, 1) + 1e-12
    score = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.log(p / (F.col("n1") / max(windows, 1) * F.col("n2") / max(windows, 1))) / -F.log(p)).otherwise(0.0)
    # a pair in every window would divide by nothing
    v = pairs.withColumn("v", F.when(F.lit(windows > 0) & (F.col("n12") >= windows), 1.0).otherwise(score)).select(topic, "w1", "w2", "v")
    whole = v.groupBy(topic, "w2").agg(F.sum("v").alias("s"))
    joined = v.join(whole, [topic, "w2"]).groupBy(topic, "w1").agg(F.sum(F.col("v") * F.col("s")).alias("d"), F.sum(F.col("v") ** 2).alias("a"), F.sum(F.col("s") ** 2).alias("b"))
    return joined.groupBy(topic).agg(F.avg(F.when(F.col("a") * F.col("b") > 0, F.col("d") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0)).alias("coherence"))
