"""Vocabularies, bags of words, labels and time slices as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exploded(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    return docs.select(key, F.explode(tokens).alias("term"))


def document_frequency(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(term, df, cf): documents that hold the term, and its occurrences. Counts are combined before the shuffle."""
    every = F.transform(F.col(tokens), lambda w: F.struct(w.alias("term"), F.lit(0).alias("doc")))
    once = F.transform(F.array_distinct(F.col(tokens)), lambda w: F.struct(w.alias("term"), F.lit(1).alias("doc")))
    rows = docs.select(F.explode(F.concat(every, once)).alias("x")).select("x.term", "x.doc")
    return rows.groupBy("term").agg(F.sum("doc").alias("df"), F.sum(1 - F.col("doc")).alias("cf"))


def vocabulary(docs: DataFrame, key: str, tokens: str, *, min_df: int = 1, max_df: float = 1.0, size: int | None = None) -> DataFrame:
    """(term_id, term, df, cf): terms in at least ``min_df`` documents and at most a share ``max_df`` of all, the ``size``
    most frequent (by df, then term), numbered alphabetically from 0."""
    n = docs.count()
    kept = document_frequency(docs, key, tokens).filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    if size is not None:
        kept = kept.orderBy(F.desc("df"), "term").limit(size)
        return kept.withColumn("term_id", F.row_number().over(Window.orderBy("term")).cast("bigint") - 1).select("term_id", "term", "df", "cf")
    from corpusloom.plans.order import in_order

    return in_order(kept, ["term"]).select(F.col("position").alias("term_id"), "term", "df", "cf")


def bag_of_words(docs: DataFrame, key: str, tokens: str, vocab: DataFrame) -> DataFrame:
    """(key, term_id, cnt)."""
    counted = exploded(docs, key, tokens).groupBy(key, "term").agg(F.count("*").alias("cnt"))
    return counted.join(vocab.select("term", "term_id"), "term").select(key, "term_id", "cnt")


def normalized(bow: DataFrame, key: str) -> DataFrame:
    """Counts as shares of their document."""
    return bow.withColumn("w", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(key)))


def long_enough(docs: DataFrame, tokens: str, least: int) -> DataFrame:
    return docs.filter(F.size(tokens) >= least)


def label_ids(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``label_id``: labels numbered from 0 in their order. Distinct labels are few; null has none."""
    ids = rows.filter(F.col(label).isNotNull()).select(label).distinct().withColumn("label_id", (F.row_number().over(Window.orderBy(label)) - 1).cast("bigint"))
    return rows.join(ids, label, "left")


def slice_frequency(bow: DataFrame, key: str, slices: DataFrame) -> DataFrame:
    """(time_slice, term_id, mean_cnt): occurrences per document of the slice. ``slices`` gives (key, time_slice)."""
    docs = slices.groupBy("time_slice").agg(F.count("*").alias("docs"))
    sums = bow.join(slices, key).groupBy("time_slice", "term_id").agg(F.sum("cnt").alias("s"))
    return sums.join(docs, "time_slice").select("time_slice", "term_id", (F.col("s") / F.col("docs")).alias("mean_cnt"))
