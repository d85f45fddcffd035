"""Two languages side by side: dictionaries, what they carry over, and rows zipped round the shorter side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.order import in_order


def translations(dictionary: DataFrame, a: str, b: str, vocab_a: DataFrame, vocab_b: DataFrame) -> DataFrame:
    """(term_a, term_b): entries of the dictionary both of whose terms are in the two vocabularies (``term``), each once."""
    known_a, known_b = vocab_a.select(F.col("term").alias("term_a")), vocab_b.select(F.col("term").alias("term_b"))
    return dictionary.select(F.col(a).alias("term_a"), F.col(b).alias("term_b")).distinct().join(known_a, "term_a", "left_semi").join(known_b, "term_b", "left_semi")


def carried_over(pairs: DataFrame, vocab_a: DataFrame, n_b: int) -> DataFrame:
    """(term_a, term_b, w): rows of the map from language a to b, each count of a translated term plus 1, over its row's sum.

    Every term of the other vocabulary of ``n_b`` terms has the 1, so only entries of translations are kept, and ``rest`` is the
    weight of each of the others in the row. ``vocab_a`` has term and cf.
    """
    raised = pairs.join(vocab_a.select(F.col("term").alias("term_a"), "cf"), "term_a")
    whole = raised.groupBy("term_a").agg((F.sum("cf") + n_b).alias("whole"))
    return raised.join(whole, "term_a").select("term_a", "term_b", ((F.col("cf") + 1) / F.col("whole")).alias("w"), (1 / F.col("whole")).alias("rest"))


def zipped_round(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(at, a, b): rows of both sides by their place in the order of ``key``, the shorter side starting again; as many as the longer side has.

    Nothing comes out if a side is empty.
    """
    x = in_order(a.select(F.col(key).alias("a")), ["a"]).withColumnRenamed("position", "pa")
    y = in_order(b.select(F.col(key).alias("b")), ["b"]).withColumnRenamed("position", "pb")
    na, nb = x.count(), y.count()
    if not na or not nb:
        return x.join(y, F.lit(False)).select(F.lit(0).cast("bigint").alias("at"), "a", "b")
    places = a.sparkSession.range(max(na, nb)).select(F.col("id").alias("at"), (F.col("id") % na).alias("pa"), (F.col("id") % nb).alias("pb"))
    return places.join(x, "pa").join(y, "pb").select("at", "a", "b")
