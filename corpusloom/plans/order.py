"""Positions and running totals over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.durable import durable


def in_order(df: DataFrame, order: list[str], size: str | None = None) -> DataFrame:
    """Adds ``position`` (from 0, in the order of ``order``) and, for ``size``, its sum ``running`` up to and with the row.

    Rows are range partitioned and sorted; the driver sees one count and one sum per partition. The sorted
    table is written once, so that partitions stay what they are when a task is run again.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = durable(placed).withColumn("__part", F.shiftright("__at", 33))
    amount = F.coalesce(F.col(size), F.lit(0)) if size else F.lit(0)
    totals = placed.groupBy("__part").agg(F.count("*").alias("n"), F.sum(amount).alias("s")).orderBy("__part").collect()
    n, s, starts = 0, 0, []
    for t in totals:
        starts.append((t["__part"], n, s))
        n, s = n + t.n, s + t.s
    if not starts:
        starts = [(0, 0, 0)]
    kind = placed.select(F.sum(amount).alias("s")).schema["s"].dataType.simpleString()
    table = F.broadcast(df.sparkSession.createDataFrame(starts, f"__part bigint, __n bigint, __s {kind}"))  # a row per partition
    out = placed.join(table, "__part").withColumn("position", F.col("__n") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    if size:
        w = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("running", F.col("__s") + F.sum(amount).over(w))
    return out.drop("__part", "__at", "__n", "__s")
