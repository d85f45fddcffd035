"""All pairs of records whose sets of values are alike: a size-aware overlap join.

Two sets of sizes a and b have a Jaccard similarity of at least t exactly if they share at least
c = ceil(t / (1 + t) * (a + b)) values. Small sets enumerate their subsets of c values for every size of
partner; two small sets share a subset, filed under the same two sizes, exactly if they are a pair. Sets whose
enumeration would be too large are joined through inverted lists of their rarest values, on which every
partner within the threshold must be found. The union is verified with the exact similarity. Equal sets are
joined once, as one class, and expanded at the end.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.durable import durable
from corpusloom.plans.skew import hot_split_join, pairs_of_members

#: A set is small if it enumerates at most so many subsets over all sizes of partners and has at most so many values.
MAX_SUBSETS, MAX_SMALL = 128, 64


def needed_overlap(a: int, b: int, threshold: Fraction) -> int:
    return math.ceil(threshold / (1 + threshold) * (a + b))


def partner_sizes(size: int, threshold: Fraction) -> range:
    return range(math.ceil(size * threshold), math.floor(size / threshold) + 1)


def subsets_enumerated(size: int, threshold: Fraction) -> int:
    return sum(math.comb(size, c) for b in partner_sizes(size, threshold) if (c := needed_overlap(size, b, threshold)) <= size)


def largest_small_size(threshold: Fraction, limit: int = MAX_SUBSETS) -> int:
    size = 1
    while size < MAX_SMALL and subsets_enumerated(size + 1, threshold) <= limit:
        size += 1
    return size


def _clean(values: Column) -> Column:
    trimmed = F.transform(values, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\s\p{Z}\x{85}]+", " ")))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))))


def value_sets(records: DataFrame, key: str, values: str, min_size: int) -> DataFrame:
    """(rec_table, rec_key, items): cleaned sets, lower-cased, trimmed, inner white space as one space; smaller ones left out.

    Null arrays count as empty; null and blank values are dropped; repeats count once.
    """
    return records.select("rec_table", F.col(key).cast("bigint").alias("rec_key"), _clean(F.coalesce(F.col(values), F.array().cast("array<string>"))).alias("items")).filter(F.size("items") >= min_size)


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (set_id, rec_table, rec_key) and distinct sets (set_id, id, size, items as hashes); set_id is a hash of 128 bits, id a number."""
    hashed = sets.withColumn("h", F.array_sort(F.transform("items", lambda x: F.xxhash64(x, F.lit("a")))))
    named = hashed.withColumn("set_id", F.concat_ws("-", F.hex(F.xxhash64("h")), F.hex(F.xxhash64("h", F.lit("b")))))
    members = durable(named.select("set_id", "rec_table", "rec_key", "h"))
    distinct = members.groupBy("set_id").agg(F.first("h").alias("h")).select("set_id", F.size("h").alias("size"), "h", F.monotonically_increasing_id().alias("id"))
    return members.drop("h"), durable(distinct)


def _small_candidates(small: DataFrame, threshold: Fraction, limit_size: int) -> DataFrame:
    """Pairs (x, y) of small sets that share a subset of the needed size for their sizes."""
    spark = small.sparkSession
    rows = []
    for size in range(1, limit_size + 1):
        for b in partner_sizes(size, threshold):
            c = needed_overlap(size, b, threshold)
            if b <= limit_size and c <= size:
                lo, hi = sorted((size, b))
                rows += [(size, b, lo * 10_000 + hi, list(ix)) for ix in combinations(range(1, size + 1), c)]
    # fixed by the threshold and MAX_SUBSETS, whatever the data
    table = F.broadcast(spark.createDataFrame(rows, "size int, partner int, kind int, ix array<int>"))
    keyed = small.join(table, "size").select("id", "size", "partner", F.xxhash64("kind", F.transform("ix", lambda i: F.element_at("h", i))).alias("k"))
    # of two sizes the smaller set is x; equal sizes are on both sides
    x = keyed.filter("size <= partner").select(F.col("id").alias("x"), F.col("size").alias("sx"), F.col("partner").alias("px"), "k")
    y = keyed.filter("size >= partner").select(F.col("id").alias("y"), F.col("size").alias("sy"), F.col("partner").alias("py"), "k")
    same = (F.col("sx") == F.col("py")) & (F.col("sy") == F.col("px")) & ((F.col("sx") < F.col("sy")) | (F.col("x") < F.col("y")))
    return x.hint("merge").join(y, "k").filter(same).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _large_candidates(distinct: DataFrame, threshold: Fraction, limit_size: int) -> DataFrame:
    """Pairs with at least one large set, from the inverted lists of the values each set cannot do without.

    With values in a common order, rarest first, two sets within the threshold share one of the first
    size - ceil(threshold * size) + 1 values of each.
    """
    t = F.lit(float(threshold))
    listed = distinct.select("id", "size", F.explode("h").alias("value"))
    large_values = listed.filter(F.col("size") > limit_size).select("value").distinct()
    rank = listed.groupBy("value").agg(F.count("*").alias("n"))
    reach = F.floor(F.lit(limit_size) * t)
    within = listed.filter(F.col("size") >= reach)
    ranked = within.hint("merge").join(rank, "value")
    order = Window.partitionBy("id").orderBy("n", "value")
    first = (
        ranked.withColumn("at", F.row_number().over(order))
        .filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * t - 1e-9) + 1)
        .hint("merge").join(large_values, "value", "left_semi")
    )
    x = first.filter(F.col("size") > limit_size).select(F.col("id").alias("p"), F.col("size").alias("sp"), "value")
    y = first.select(F.col("id").alias("q"), F.col("size").alias("sq"), "value")
    near = (F.col("sq") >= F.col("sp") * t - 1e-9) & (F.col("sq") * t - 1e-9 <= F.col("sp"))
    return x.hint("merge").join(y, "value").filter(near & (F.col("p") != F.col("q"))).select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()


def similar_sets(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (set_id, rec_table, rec_key) and links (a_set, b_set, similarity) between different sets.

    ``sets`` is the result of ``value_sets``. Equal sets are one class and have no link among themselves.
    """
    t = Fraction(threshold).limit_denominator(10_000)
    members, distinct = _classes(sets)
    limit_size = largest_small_size(t)
    small = _small_candidates(distinct.filter(F.col("size") <= limit_size), t, limit_size)
    large = _large_candidates(distinct, t, limit_size)
    candidates = small.unionByName(large)
    x = distinct.select(F.col("id").alias("x"), F.col("set_id").alias("a_set"), F.col("h").alias("hx"))
    y = distinct.select(F.col("id").alias("y"), F.col("set_id").alias("b_set"), F.col("h").alias("hy"))
    both = candidates.distinct().hint("merge").join(x, "x").hint("merge").join(y, "y").withColumn("shared", F.size(F.array_intersect("hx", "hy")))
    union = F.size("hx") + F.size("hy") - F.col("shared")
    kept = both.filter(F.col("shared") * t.denominator >= union * t.numerator)
    return members, kept.select("a_set", "b_set", (F.col("shared") / union).alias("similarity"))


def expand_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of records (a_table, a_key, b_table, b_key, similarity), those with equal sets included. ``members`` is that of ``similar_sets``."""
    pairs = pairs_of_members(members.select("set_id", F.struct("rec_table", "rec_key").alias("r")), links, "r")
    return pairs.select(F.col("a.rec_table").alias("a_table"), F.col("a.rec_key").alias("a_key"), F.col("b.rec_table").alias("b_table"), F.col("b.rec_key").alias("b_key"), "similarity")


def class_report(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record: its class (equal sets), named by its smallest record, the size of the class, and its number of links to other sets."""
    size = members.groupBy("set_id").agg(F.count("*").alias("class_size"), F.min(F.struct("rec_table", "rec_key")).alias("least"))
    degree = links.select(F.explode(F.array("a_set", "b_set")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("links"))
    per_class = size.hint("merge").join(degree, "set_id", "left").fillna(0, ["links"])
    per_class = durable(per_class.withColumn("uses", F.col("class_size")))
    joined = hot_split_join(members, per_class, ["set_id"], "uses", members.count())
    return joined.select("rec_table", "rec_key", F.concat_ws(":", "least.rec_table", "least.rec_key").alias("class_id"), "class_size", "links")
