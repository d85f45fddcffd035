"""References to keys that another table lacks, lacked yet, or lacked already at the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.durable import durable
from corpusloom.plans.skew import hot_split_join, run_total

#: Outer white space of an id, as a regular expression class.
BLANKS = r"[\s\p{Z}\x{85}]"


def normal_id(c: Column) -> Column:
    """An id without outer white space; whole numbers without leading zeros or zero decimals; blank as null."""
    s = F.regexp_replace(c.cast("string"), rf"^{BLANKS}+|{BLANKS}+$", "")
    whole = F.regexp_extract(s, r"^([+-]?)0*([0-9]+?)(?:\.0*)?$", 2)
    sign = F.when(s.startswith("-") & (whole != "0"), F.lit("-")).otherwise(F.lit(""))
    return F.when(s == "", F.lit(None)).when(whole != "", F.concat(sign, whole)).otherwise(s)


def orphan_references(
    refs: DataFrame, parents: DataFrame, *, key: str, at: str, parent_key: str, valid_from: str, valid_to: str
) -> DataFrame:
    """Rows of ``refs`` whose ``key`` no parent held at time ``at``, with ``reason`` missing, early or removed.

    A parent holds its key from ``valid_from`` (inclusive) until ``valid_to`` (exclusive; null: for ever).
    Keys are compared as they are: normalise them first. Rows with a null key or null time are no references.
    Parents with a null key or null ``valid_from`` hold nothing; an interval that ends before it begins is empty.
    Repeated rows on either side change nothing but are each kept among the references.

    The distinct keys of the references go through a left anti join against the parents' keys; keys that
    exist are tested against two bounds per key (first delivery, start of unlimited validity), and only
    references between those bounds are swept against the intervals, hour by hour, with running totals. Hot
    keys never meet in one task: aggregates are combined before the shuffle, the join back is split, and a
    sweep covers one hour of one key.
    """
    named = refs.withColumns({"__key": F.col(key), "__at": F.col(at)}).filter(F.col("__key").isNotNull() & F.col("__at").isNotNull())
    held = (
        parents.select(F.col(parent_key).alias("__key"), F.col(valid_from).alias("__from"), F.col(valid_to).alias("__to"))
        .filter(F.col("__key").isNotNull() & F.col("__from").isNotNull())
        .filter(F.col("__to").isNull() | (F.col("__to") > F.col("__from")))
    )
    per_key = held.groupBy("__key").agg(
        F.min("__from").alias("__first"),
        F.min(F.when(F.col("__to").isNull(), F.col("__from"))).alias("__open"),
    )
    uses = named.groupBy("__key").agg(F.count("*").alias("__uses"))
    absent = uses.join(per_key.select("__key"), "__key", "left_anti")
    kind = per_key.schema["__first"].dataType
    absent = absent.withColumns({c: F.lit(None).cast(kind) for c in ("__first", "__open")})
    present = uses.join(per_key, "__key").select("__key", "__uses", "__first", "__open")
    known = durable(absent.unionByName(present))
    total = known.agg(F.sum("__uses")).first()[0] or 0
    judged = hot_split_join(named, known, ["__key"], "__uses", total)
    verdict = (
        F.when(F.col("__first").isNull(), "missing")
        .when(F.col("__at") < F.col("__first"), "early")
        .when(F.col("__at") >= F.col("__open"), "held")
        .otherwise("swept")
    )
    judged = judged.withColumn("reason", verdict)
    clear = judged.filter(F.col("reason").isin("missing", "early"))
    swept = _sweep(judged.filter(F.col("reason") == "swept"), held).withColumn("reason", F.lit("removed"))
    columns = [*refs.columns, "reason"]
    return clear.select(*columns).unionByName(swept.select(*columns))


def _sweep(refs: DataFrame, held: DataFrame) -> DataFrame:
    """References that no interval of their key covers, by a running count of open intervals."""
    moves = held.select("__key", F.explode(F.array(
        F.struct(F.col("__from").alias("t"), F.lit(1).alias("step")),
        F.struct(F.col("__to").alias("t"), F.lit(-1).alias("step")),
    )).alias("m")).select("__key", F.col("m.t").alias("__t"), F.col("m.step").alias("__step")).filter(F.col("__t").isNotNull())
    moves = moves.join(refs.select("__key").distinct(), "__key", "left_semi")
    moves = moves.groupBy("__key", "__t").agg(F.sum("__step").alias("__step"))
    hour = lambda c: F.date_trunc("hour", c)
    per_hour = moves.groupBy("__key", hour(F.col("__t")).alias("__hour")).agg(F.sum("__step").alias("__net"))
    before = per_hour.withColumn("__base", run_total([F.col("__key")], [F.col("__hour")], F.col("__net")) - F.col("__net"))
    # each hour of a key opens with what the hours before left
    opening = before.select("__key", "__hour", F.col("__base").alias("__step"))
    asked_hours = refs.select("__key", hour(F.col("__at")).alias("__hour")).distinct()
    quiet = asked_hours.join(per_hour.select("__key", "__hour"), ["__key", "__hour"], "left_anti")
    # hours without a move of their own take the total of the last hour with one
    steps = before.select("__key", "__hour", (F.col("__base") + F.col("__net")).alias("__after")).unionByName(
        quiet.withColumn("__after", F.lit(None).cast("long"))
    )
    from pyspark.sql import Window

    w = Window.partitionBy("__key").orderBy("__hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = steps.withColumn("__step", F.coalesce(F.last("__after", ignorenulls=True).over(w), F.lit(0)))
    quiet_open = filled.filter(F.col("__after").isNull()).select("__key", "__hour", "__step")
    empty = lambda c: F.lit(None).cast(refs.schema[c].dataType).alias(c)
    rows = refs.withColumns({"__hour": hour(F.col("__at")), "__t": F.col("__at"), "__kind": F.lit(2), "__step": F.lit(0).cast("long")})
    others = (
        opening.unionByName(quiet_open).withColumns({"__t": F.lit(None).cast(refs.schema["__at"].dataType), "__kind": F.lit(0)})
        .unionByName(moves.withColumns({"__hour": hour(F.col("__t")), "__kind": F.lit(1)}).select("__key", "__hour", "__step", "__t", "__kind"))
    )
    fill = [c for c in refs.columns if c != "__key"]
    others = others.select("__key", "__hour", "__t", "__kind", "__step", *map(empty, fill))
    line = rows.select("__key", "__hour", "__t", "__kind", "__step", *fill).unionByName(others)
    open_now = run_total([F.col("__key"), F.col("__hour")], [F.col("__t").asc_nulls_first(), F.col("__kind")], F.col("__step"))
    return line.withColumn("__open_now", open_now).filter((F.col("__kind") == 2) & (F.col("__open_now") <= 0))


def orphan_report(orphans: DataFrame, table: str, period: str) -> DataFrame:
    """Orphans per table and period, by reason."""
    return orphans.groupBy(table, period).agg(
        F.count("*").alias("orphans"),
        *[F.sum(F.when(F.col("reason") == r, 1).otherwise(0)).alias(r) for r in ("missing", "early", "removed")],
    )


def article_references(citations: DataFrame, decisions: DataFrame) -> DataFrame:
    """The references of both citing tables in one form: ref_table, ref_id, key, at, ref_month."""
    both = citations.select(F.lit("source_titles_with_ids").alias("ref_table"), F.col("ref_id"), F.col("id").alias("key"), F.col("written_at").alias("at")).unionByName(
        decisions.select(F.lit("assignment_decisions").alias("ref_table"), F.col("ref_id"), F.col("article_id").alias("key"), F.col("decided_at").alias("at"))
    )
    return both.withColumns({"key": normal_id(F.col("key")), "ref_month": F.date_format("at", "yyyy-MM")})


__all__ = ["article_references", "normal_id", "orphan_references", "orphan_report"]
