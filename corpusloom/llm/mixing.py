"""Records drawn from several sources so that each makes up a target share of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import TOKENIZER, measured
from corpusloom.llm.truncation import source_key
from corpusloom.plans.durable import durable
from corpusloom.plans.skew import hot_split_join


def source_rates(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source_key, docs, available, target_share, max_repeats, rate, capped) for each source with rows or a target.

    ``sizes`` has source_key and tokens. ``rate`` is how often each record is to be used on average: the target
    share of ``total`` (by default the tokens of all rows whose source has a target) over the source's own
    tokens, at most ``max_repeats``, which ``capped`` marks. A source without a target, with a null or
    negative one, or without tokens, is drawn at rate 0. Target rows whose names differ in case and outer white
    space only are one source: their shares add up and the largest max_repeats holds; null counts as 0.
    """
    wanted = targets.groupBy(source_key(F.col("source")).alias("source_key")).agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats")
    )
    held = sizes.groupBy("source_key").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    both = held.join(wanted, "source_key", "full").fillna(0, ["docs", "available", "target_share", "max_repeats"])
    if total is None:
        total = both.filter("target_share > 0").agg(F.sum("available")).first()[0] or 0
    free = F.when(F.col("available") > 0, F.col("target_share") * F.lit(float(total)) / F.col("available")).otherwise(0.0)
    return both.withColumns({"rate": F.least(free, F.col("max_repeats").cast("double")), "capped": (free > F.col("max_repeats")) | ((F.col("target_share") > 0) & (F.col("available") == 0))})


def mix_sources(
    documents: DataFrame, key: str, text: str, source: str, targets: DataFrame, *, total: int | None = None, seed: int = 17, path: str = TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """Drawn documents (``key``, source_key, tokens, uses) and a report of the share each source reached.

    Each document is used floor(rate) times, plus once if its hash with ``seed`` falls below the fraction of
    the rate; so no document is used more than its source's max_repeats, and a document's number of uses
    depends on nothing but its key, the seed and the rate. Documents with 0 uses do not come out. Null source
    names are one source, with the key ''. Rows that repeat a key are drawn alike.
    """
    sizes = durable(measured(documents.withColumn("__source", source_key(F.col(source))), key, text, path=path, extra=["__source"]).withColumnRenamed("__source", "source_key"))
    rates = durable(source_rates(sizes, targets, total))
    rows = rates.agg(F.sum("docs")).first()[0] or 0
    joined = hot_split_join(sizes, rates.select("source_key", "rate", "docs"), ["source_key"], "docs", rows)
    # 53 bits of the hash as a number from 0 up to 1
    draw = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) / F.lit(float(2**53))
    uses = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    drawn = joined.withColumn("uses", uses.cast("int")).filter("uses > 0").select(key, "source_key", "tokens", "uses")
    used = drawn.groupBy("source_key").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count("*").alias("used_docs"))
    report = rates.join(used, "source_key", "left").fillna(0, ["used_tokens", "used_docs"])
    report = durable(report)
    whole = report.agg(F.sum("used_tokens")).first()[0] or 0
    return drawn, report.withColumn("actual_share", F.col("used_tokens") / F.lit(float(whole)) if whole else F.lit(0.0))
