"""A suite of metrics run one after the other on the same tables: values, failures and times."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORM = "metric string, status string, rows bigint, value double, seconds double, error string"


def run_metrics(spark: SparkSession, d: str, metrics: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]) -> DataFrame:
    """(metric, status, rows, value, seconds, error): the rows each metric gives and the mean of its named column.

    A metric that fails is a row with its error, and the others still run. The driver holds a row per metric.
    """
    out = []
    for name, (query, column) in metrics.items():
        began = time.monotonic()
        try:
            seen = query(spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("v")).first()
            out.append((name, "ok", seen.n, float(seen.v) if seen.v is not None else None, time.monotonic() - began, None))
        except Exception as e:  # noqa: BLE001 - whatever a metric raises is its row's error
            out.append((name, "failed", 0, None, time.monotonic() - began, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(out, FORM)


def summary(report: DataFrame) -> DataFrame:
    """One row: metrics, those that succeeded, their share, and time in all and on average."""
    ok = F.sum(F.when(F.col("status") == "ok", 1).otherwise(0))
    rate = F.when(F.count("*") > 0, ok / F.count("*")).otherwise(0.0)
    return report.agg(F.count("*").alias("metrics"), F.coalesce(ok, F.lit(0)).alias("succeeded"), rate.alias("success_rate"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"))
