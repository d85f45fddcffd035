"""Joins against a table with one row per key whose other side may be badly skewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_FRACTION of the rows; so there are fewer than HOT_FRACTION of them.
HOT_FRACTION = 1000


def hot_split_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    uses: str,
    total: int,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` with ``per_key``, which has one row per key and says in ``uses`` how many rows use it.

    Keys that hold more than ``total / HOT_FRACTION`` rows go through a broadcast hash join: there are
    fewer than HOT_FRACTION such keys, which bounds the broadcast whatever the data. All other keys go
    through an ordinary shuffled join, where no key is large. Rows are routed by the same broadcast list.

    ``how`` is ``inner`` or ``left``. Null keys match nothing, as in SQL. Column ``uses`` is dropped.
    """
    limit = max(1, total // HOT_FRACTION)
    hot = per_key.filter(F.col(uses) > limit).drop(uses)
    cold = per_key.filter(F.col(uses) <= limit).drop(uses)
    hot_keys = F.broadcast(hot.select(*keys))
    through_hot = rows.join(F.broadcast(hot), keys, "inner")
    through_cold = rows.join(hot_keys, keys, "left_anti").hint("merge").join(cold, keys, how)  # neither side has a bound: never broadcast
    return through_hot.unionByName(through_cold)


#: Members of a class that travel together when pairs are formed.
CHUNK = 1024


def pairs_of_members(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(a, b, similarity), a < b: the pairs of ``key`` behind ``links`` (a_set, b_set, similarity), and those within each set_id.

    ``members`` (set_id, ``key``) must be a written table, as from ``durable``: its rows are taken in stretches of CHUNK
    as they lie, and the members of one class in one stretch are a list. Lists are joined instead of rows and the
    pairs of lists dealt out anew, so a class of any size is spread over all tasks, each pair of lists being
    at most CHUNK * CHUNK pairs.
    """
    stretch = F.shiftright(F.monotonically_increasing_id(), CHUNK.bit_length() - 1)
    lists = members.select("set_id", key, stretch.alias("at")).groupBy("set_id", "at").agg(F.collect_list(key).alias("keys"))
    a = lists.select(F.col("set_id").alias("a_set"), F.col("at").alias("a_at"), F.col("keys").alias("a_keys"))
    b = lists.select(F.col("set_id").alias("b_set"), F.col("at").alias("b_at"), F.col("keys").alias("b_keys"))
    linked = links.select("a_set", "b_set", "similarity").hint("merge").join(a, "a_set").hint("merge").join(b, "b_set")
    within = a.hint("merge").join(b.withColumnRenamed("b_set", "a_set"), "a_set").filter(F.col("a_at") <= F.col("b_at"))
    within = within.select("a_set", F.col("a_set").alias("b_set"), "a_at", "b_at", "a_keys", "b_keys", F.lit(1.0).alias("similarity"))
    # a list with itself holds pairs only if it has two members
    within = within.filter((F.col("a_at") < F.col("b_at")) | (F.size("a_keys") > 1))
    dealt = linked.select(*within.columns).unionByName(within).repartition("a_set", "b_set", "a_at", "b_at")
    one = dealt.select("a_set", "b_set", "a_at", "b_at", "similarity", F.explode("a_keys").alias("x"), "b_keys").select("*", F.explode("b_keys").alias("y"))
    same_list = (F.col("a_set") == F.col("b_set")) & (F.col("a_at") == F.col("b_at"))
    return one.filter(~same_list | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def run_total(part: list[Column], order: list[Column], value: Column) -> Column:
    """Running sum of ``value`` over ``order`` within ``part``, the current row included."""
    from pyspark.sql import Window

    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(w)
