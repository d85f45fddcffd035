"""Running metrics over streams of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, by: str, value: str, *, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, by, n, total): per window and value of ``by``; rows later than ``late`` are left out once their window is closed."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")


def decision_counts(decisions: DataFrame, at: str, decided: str, *, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, decision, n): how assignments are decided, week by week."""
    word = F.lower(F.trim(decided))
    d = decisions.withColumn("decision", F.when(word.isin("yes", "no"), word).otherwise("error"))
    w = d.withWatermark(at, late).groupBy(F.window(at, width), "decision").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "decision", "n")
