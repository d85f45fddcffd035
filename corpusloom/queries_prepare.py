"""Queries for orphan references and packed fields, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.orphans import article_references, normal_id, orphan_references, orphan_report
from corpusloom.operators.packed import split_packed
from corpusloom.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = article_references(table(spark, d, "source_titles_with_ids"), table(spark, d, "assignment_decisions"))
    parents = table(spark, d, "nyt_sampled").select(normal_id(F.col("id")).alias("id"), "loaded_at", "removed_at")
    return orphan_references(refs, parents, key="key", at="at", parent_key="id", valid_from="loaded_at", valid_to="removed_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_month", "ref_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), "ref_table", "ref_month")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, field, spaces in (("nyt_sampled", "keywords", False), ("ntm_assignments", "topic_word_list", True)):
        rows = split_packed(table(spark, d, name), "row_id", field, white_space_splits=spaces)
        parts.append(rows.select(F.lit(name).alias("record_table"), "row_id", "pos", "item"))
    return parts[0].unionByName(parts[1])


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found}

_TRIM = "regexp_replace({c}, '^[\\s\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+$', '', 'g')"


def _key(c: str) -> str:
    t = _TRIM.format(c=c)
    return (
        f"case when {t} = '' then null when regexp_full_match({t}, '[+-]?[0-9]+(\\.0*)?') "
        f"then regexp_replace(regexp_replace({t}, '\\.0*$', ''), '^[+]?(-?)0*([0-9])', '\\1\\2') else {t} end"
    )


_ORPHANS = f"""
with refs as (
  select 'source_titles_with_ids' ref_table, ref_id, {_key('id')} k, written_at t from source_titles_with_ids
  union all
  select 'assignment_decisions', ref_id, {_key('article_id')}, decided_at from assignment_decisions
), held as (select {_key('id')} k, loaded_at f, removed_at u from nyt_sampled where loaded_at is not null),
orphans as (
  select ref_table, strftime(t, '%Y-%m') ref_month, ref_id, k, t from refs r
  where k is not null and t is not null
    and not exists (select 1 from held h where h.k = r.k and h.f <= r.t and (h.u is null or h.u > r.t))
)"""

ORACLE = {
    "p5_found": _ORPHANS + " select ref_table, ref_month, ref_id from orphans",
    "p5_report": _ORPHANS
    + """, judged as (
  select o.*, (select min(f) from held h where h.k = o.k and (h.u is null or h.u > h.f)) first from orphans o)
select ref_table, ref_month, count(*) orphans,
  sum(case when first is null then 1 else 0 end)::bigint missing,
  sum(case when t < first then 1 else 0 end)::bigint early,
  sum(case when t >= first then 1 else 0 end)::bigint removed
from judged group by 1, 2""",
}
