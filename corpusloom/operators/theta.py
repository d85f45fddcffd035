"""Topic weights of documents and word weights of topics as long tables: (key, topic, w) and (topic, term, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_vectors(rows: DataFrame, key: str, vector: str, at: str = "dim") -> DataFrame:
    return rows.select(key, F.posexplode(vector).alias(at, "w")).withColumn("w", F.col("w").cast("double"))


def centroids(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, dim, w): mean vectors."""
    return from_vectors(rows.select(key, group, vector), group, vector).groupBy(group, "dim").agg(F.avg("w").alias("w"))


def argmax(theta: DataFrame, key: str, topic: str) -> DataFrame:
    """(key, topic): the topic of the largest weight, the first of equal ones."""
    return theta.groupBy(key).agg(F.max_by(topic, F.struct("w", -F.col(topic))).alias(topic))


def top_of(beta: DataFrame, topic: str, term: str, k: int) -> DataFrame:
    """(topic, pos, term, w): the ``k`` largest weights, of equal ones the largest term."""
    r = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("w"), F.desc(term)))
    return beta.withColumn("pos", r).filter(F.col("pos") <= k).select(topic, "pos", term, "w")


def softmax(long: DataFrame, over: list[str]) -> DataFrame:
    """``w`` as shares of exp(w) within each value of ``over``, the largest taken off first."""
    by = Window.partitionBy(*over)
    e = long.withColumn("w", F.exp(F.col("w") - F.max("w").over(by)))
    return e.withColumn("w", F.col("w") / F.sum("w").over(by))


def matmul(a: DataFrame, b: DataFrame, row: str, inner: str, column: str) -> DataFrame:
    """Sum over ``inner`` of a.w times b.w, for sparse matrices (row, inner, w) and (inner, column, w)."""
    right = b.withColumnRenamed("w", "__w")
    return a.join(right, inner).groupBy(row, column).agg(F.sum(F.col("w") * F.col("__w")).alias("w"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def embedding_coherence(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, coherence): mean cosine over all pairs of a group, from the sum of its unit vectors: (|sum|^2 - n) / (n (n - 1))."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = rows.select(group, F.posexplode(F.transform(vector, lambda x: x / norm)).alias("dim", "w"))
    sums = unit.groupBy(group, "dim").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    out = sums.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return out.select(group, "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def contingency(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("p")).agg(F.count("*").alias("n"))


def purity_nmi(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row (n, purity, nmi); mutual information over the mean of both entropies, 1 where neither has any."""
    c = contingency(rows, truth, guess)
    n = F.sum("n").over(Window.partitionBy(F.lit(1)))
    part = c.withColumns({"nt": F.sum("n").over(Window.partitionBy("t")), "np": F.sum("n").over(Window.partitionBy("p")), "best": F.max("n").over(Window.partitionBy("p")), "all": n})
    x, all_ = F.col("n"), F.col("all")
    info = F.sum(x / all_ * F.log(x * all_ / (F.col("nt") * F.col("np"))))
    ht, hp = (-F.sum(x / all_ * F.log(F.col(s) / all_)) for s in ("nt", "np"))
    # each guess counts its best class once
    best = F.sum(F.col("best") * x / F.col("np"))
    one = part.agg(F.sum("n").alias("n"), (best / F.max("all")).alias("purity"), info.alias("i"), ht.alias("ht"), hp.alias("hp"))
    return one.select("n", "purity", F.when(F.col("ht") + F.col("hp") > 0, 2 * F.col("i") / (F.col("ht") + F.col("hp"))).otherwise(1.0).alias("nmi"))


def accuracy_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row (n, accuracy, macro_f1) over the classes that occur on either side."""
    c = contingency(rows, truth, guess)
    sides = c.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("as_t"), F.lit(0).cast("bigint").alias("as_p")), F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("as_t"), F.col("n").alias("as_p")))).alias("x")).select("x.*")
    hits = c.filter(F.col("t") == F.col("p")).select(F.col("t").alias("c"), F.col("n").alias("tp"))
    per = sides.groupBy("c").agg(F.sum("as_t").alias("nt"), F.sum("as_p").alias("np")).join(hits, "c", "left").fillna(0, ["tp"])
    f1 = 2 * F.col("tp") / (F.col("nt") + F.col("np"))
    return per.agg(F.sum("nt").alias("n"), (F.sum("tp") / F.sum("nt")).alias("accuracy"), F.avg(f1).alias("macro_f1"))
