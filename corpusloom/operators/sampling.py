"""Samples that every engine draws alike, the longest rows, token budgets and row ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.plans.order import in_order


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same on every run and partitioning: those of smallest hash of key and seed."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def context_length(*columns: str) -> Column:
    """Characters of all columns; null has none."""
    return sum((F.length(F.coalesce(F.col(c), F.lit(""))) for c in columns), F.lit(0)).cast("bigint")


def longest(df: DataFrame, length: Column, key: str, n: int) -> DataFrame:
    return df.withColumn("context_length", length).orderBy(F.desc("context_length"), key).limit(n)


def digits_or_zero(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{1,18}$"), c.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def token_budget(df: DataFrame, order: list[str], tokens: str, budgets: DataFrame) -> DataFrame:
    """(*budgets, kept_rows, kept_tokens): how many rows, in order, fit in each ``budget`` before the first that does not.

    ``budgets`` is a small fixed table; sizes are not negative, so the running total only grows.
    """
    limits = budgets.collect()  # a row per budget
    run = in_order(df, order, tokens)
    kept = lambda b: F.col("running") <= F.lit(b)
    one = run.agg(
        *[F.sum(F.when(kept(r["budget"]), 1).otherwise(0)).alias(f"n{i}") for i, r in enumerate(limits)],
        *[F.sum(F.when(kept(r["budget"]), F.col(tokens)).otherwise(0)).alias(f"t{i}") for i, r in enumerate(limits)],
        F.count("*").alias("all"),
    ).first()
    form = StructType([*budgets.schema.fields, StructField("kept_rows", LongType()), StructField("kept_tokens", LongType())])
    return df.sparkSession.createDataFrame([(*r, one[f"n{i}"] or 0, one[f"t{i}"] or 0) for i, r in enumerate(limits)], form)


def row_range(df: DataFrame, order: list[str], start: int, rows: int | None = None) -> DataFrame:
    """Rows at positions start .. start + rows - 1 of the order."""
    placed = in_order(df, order).filter(F.col("position") >= start)
    return placed.filter(F.col("position") < start + rows) if rows is not None else placed


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no finished row has: what a resumed run still has to do."""
    return df.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def train_test(df: DataFrame, key: str, test_share: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: test for a share of the rows chosen by hash, else train."""
    u = F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(u < test_share, "test").otherwise("train"))
