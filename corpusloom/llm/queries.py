"""Queries of the training-data operators, with SQL where it can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import components, mixing, neardup, packing, sets, terms, truncation
from corpusloom.operators.packed import split_packed_to_array
from corpusloom.plans.skew import hot_split_join
from corpusloom.sources.tables import table

WORDS = r"[\p{L}\p{N}]+"


def words_of(text):
    """The longest runs of letters and digits in the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _keyword_sets(spark: SparkSession, d: str) -> DataFrame:
    articles = split_packed_to_array(table(spark, d, "nyt_sampled"), "row_id", "keywords").select(F.lit("nyt_sampled").alias("rec_table"), F.col("row_id").alias("k"), F.col("items").alias("v"))
    topics = table(spark, d, "topics").select(F.lit("topics").alias("rec_table"), F.col("topic_id").alias("k"), F.col("keywords").alias("v"))
    return sets.value_sets(articles.unionByName(topics), "k", "v", min_size=3)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = sets.similar_sets(_keyword_sets(spark, d), 0.6)
    return sets.expand_links(members, links).drop("similarity")


def p1_topic_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of ``p1_found`` within topics, whose values SQL needs no splitter for."""
    topics = table(spark, d, "topics").select(F.lit("topics").alias("rec_table"), "topic_id", "keywords")
    members, links = sets.similar_sets(sets.value_sets(topics, "topic_id", "keywords", min_size=3), 0.6)
    return sets.expand_links(members, links).select("a_key", "b_key", F.round("similarity", 9).alias("similarity"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    members, links = sets.similar_sets(_keyword_sets(spark, d), 0.6)
    return sets.class_report(members, links)


def _keyword_terms(spark: SparkSession, d: str) -> DataFrame:
    keywords = split_packed_to_array(table(spark, d, "nyt_sampled"), "row_id", "keywords")
    # values such as "(" aside, every value stays a term: only case and white space are evened out
    items = F.transform("items", lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\s\p{Z}\x{85}]+", " ")))
    return terms.term_frequencies(keywords.select(items.alias("terms")), "terms", 1)


def _text_terms(spark: SparkSession, d: str, max_len: int) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "nyt_sampled").select(words_of(F.col("text")).alias("terms")), "terms", max_len)


def _marked(spark: SparkSession, d: str, by_field: dict[str, DataFrame]) -> DataFrame:
    parts = [c.select(F.lit(f).alias("field"), F.array_join("gram", " ").alias("term"), "n_terms", "occurrences", "n_records") for f, c in by_field.items()]
    counted = parts[0]
    for p in parts[1:]:
        counted = counted.unionByName(p)
    return terms.mark_terms(counted, table(spark, d, "nyt_sampled").count())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    both = _marked(spark, d, {"keywords": _keyword_terms(spark, d), "text": _text_terms(spark, d, 1)})
    return both.filter(F.col("mark").isNotNull()).select("field", "term", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d, {"keywords": _keyword_terms(spark, d), "text": _text_terms(spark, d, 1)}).drop("n_terms")


def p2_text_terms(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``p2_terms`` that SQL can say: those of the texts."""
    return _marked(spark, d, {"text": _text_terms(spark, d, 1)}).drop("n_terms", "field")


def p2_text_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d, {"text": _text_terms(spark, d, 3)}).drop("field", "mark")


def _tied_topics(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "topic_diversity_results")
    score = F.when(F.isnan("similarity_score"), None).when(F.col("similarity_score") > 1, F.col("similarity_score") / 100).otherwise(F.col("similarity_score"))
    return judged.filter(score >= 0.75).select("topic1_id", "topic2_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(_tied_topics(spark, d), "topic1_id", "topic2_id", "topic_id", "group_id")


def _alike_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "nyt_sampled").select("row_id", words_of(F.col("text")).alias("words"))
    return neardup.similar_records(neardup.word_sets(rows, "row_id", "words", min_size=20), 0.7, smallest=20)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.expand_links(*_alike_texts(spark, d))
    return pairs.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.class_report(*_alike_texts(spark, d)).withColumnRenamed("rec_key", "row_id")


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    """The context of every model that has one: a row per model."""
    return {r.model: r.total_context for r in table(spark, d, "model_limits").filter("model is not null and total_context > 0").collect()}


def p7_prompts(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack_texts(table(spark, d, "documents"), "doc_id", "text", _capacities(spark, d))
    return packed.withColumnsRenamed({"name": "model", "container": "prompt_id"})


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    capacities = _capacities(spark, d)
    return packing.fill_report(packing.pack_texts(table(spark, d, "documents"), "doc_id", "text", capacities), capacities).withColumnRenamed("name", "model")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "source_weights"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    drawn, report = _mixed(spark, d)
    shares = report.select("source_key", "target_share", "actual_share", "used_docs")
    rows = report.agg(F.sum("used_docs")).first()[0] or 0
    return hot_split_join(drawn, shares, ["source_key"], "used_docs", rows)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def _cut_texts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_texts(table(spark, d, "documents"), "doc_id", "text", "source", "title")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut_texts(spark, d).filter("is_cut").select("doc_id")


def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(_cut_texts(spark, d))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.storage_limits(table(spark, d, "documents"), "text", "source")


QUERIES = {
    "p1_found": p1_found,
    "p1_topic_pairs": p1_topic_pairs,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p2_text_terms": p2_text_terms,
    "p2_text_trigrams": p2_text_trigrams,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p7_prompts": p7_prompts,
    "p7_fill": p7_fill,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_by_source": p9_by_source,
    "p9_limits": p9_limits,
}

_WORD_SETS = """
with w as (select row_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) ws from nyt_sampled),
s as (select row_id, ws, len(ws) n from w where len(ws) >= 20)"""
_BYTES = "octet_length(encode(t))"
_COUNT = "(length(t) - length(replace(t, {}, '')))"
_LINES = "length(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '[^\n]', '', 'g')) - (length(t) - length(replace(t, chr(13) || chr(10), chr(10))))"
_ENTITIES = f"(4 * {_COUNT.format(chr(39) + '&' + chr(39))} + 3 * {_COUNT.format(chr(39) + '<' + chr(39))} + 3 * {_COUNT.format(chr(39) + '>' + chr(39))})"
_QUOTES = f"(5 * {_COUNT.format('chr(34)')} + 5 * {_COUNT.format('chr(39)')})"
_ESCAPED = "(" + " + ".join(_COUNT.format(f"chr({c})") for c in (34, 92, 10, 13, 9)) + ")"
_OTHER = "length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))"
_ASTRAL = "length(regexp_replace(t, '[\\x{0}-\\x{FFFF}]', '', 'g'))"
_LENGTHS = [
    "length(t)", _BYTES, f"length(t) + {_ASTRAL}", f"length(t) + {_LINES}", f"{_BYTES} + {_LINES}", f"length(t) + {_ENTITIES}", f"length(t) + {_ENTITIES} + {_QUOTES}", f"{_BYTES} + {_ENTITIES}",
    f"{_BYTES} + {_ENTITIES} + {_QUOTES}", f"length(t) + {_ESCAPED}", f"{_BYTES} + {_ESCAPED}", f"length(t) + {_ASTRAL} + {_ESCAPED} + 5 * ({_OTHER} + {_ASTRAL})",
]

ORACLE = {
    "p1_topic_pairs": """
with s as (select topic_id k, list_sort(list_distinct(list_filter(list_transform(keywords, lambda w: trim(regexp_replace(lower(w), '[\\s\\p{Z}]+', ' ', 'g'), ' ')), lambda w: w is not null and w <> ''))) v from topics),
f as (select * from s where len(v) >= 3),
p as (select a.k a_key, b.k b_key, len(list_intersect(a.v, b.v)) o, len(a.v) + len(b.v) n from f a join f b on a.k < b.k)
select a_key, b_key, round(o / (n - o), 9) similarity from p where o * 10 >= (n - o) * 6""",
    "p4_classes": _WORD_SETS + """,
c as (select list_sort(ws) k, min(row_id) class_id, count(*) class_size, any_value(n) n from s group by 1),
p as (select a.class_id x, b.class_id y, a.n + b.n n, len(list_intersect(a.k, b.k)) o from c a join c b on a.class_id < b.class_id and a.n * 10 >= b.n * 7 and b.n * 10 >= a.n * 7),
l as (select x, y from p where o * 10 >= (n - o) * 7), e as (select x from l union all select y from l), d as (select x class_id, count(*) links from e group by 1)
select row_id, class_id, class_size, coalesce(links, 0) links from s join c on c.k = list_sort(s.ws) left join d using (class_id)""",
    "p9_limits": f"""
with d as (select distinct coalesce(lower(trim(regexp_replace(source, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')), '') source_key, text t from documents where text <> ''),
m as (select source_key, t, [{', '.join(_LENGTHS)}] ls from d),
c as (select source_key, e, len, count(*) n from (select source_key, unnest(ls) len, generate_subscripts(ls, 1) - 1 e from m) group by 1, 2, 3),
b as (select *, (sum(n) over (partition by source_key, e order by len range between 20 preceding and 20 following) - sum(n) over (partition by source_key, e order by len range between 3 preceding and current row)) / 37.0 background,
  coalesce(sum(n) over (partition by source_key, e order by len range between 1 following and unbounded following), 0)::bigint n_longer from c),
k as (select *, row_number() over (partition by source_key, len order by n desc, e) r, max(n) over (partition by source_key) top from b where n >= 0.05 * (n + n_longer) and n >= 6 * (background + 0.5)),
peaks as (select *, n * 3 < top weak from k where r = 1),
at_ as (select p.source_key, p.e, p.len, exists (select 1 from peaks q where q.source_key = p.source_key and q.n > p.n and m.ls[q.e + 1] between q.len - case when q.e in (1, 4, 7, 8, 10) then 3 else 0 end and q.len) shared
  from peaks p join m on m.source_key = p.source_key and m.ls[p.e + 1] = p.len where p.weak),
shadows as (select source_key, e, len from at_ group by 1, 2, 3 having avg(shared::int) > 0.5)
select source_key, {str(truncation.ENCODINGS)}[e + 1] encoding, len::int limit_length, n n_at, n_longer from peaks where (source_key, e, len) not in (select (source_key, e, len) from shadows)""",
    "p4_found": """
with w as (select row_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) ws from nyt_sampled),
s as (select row_id, ws, len(ws) n from w where len(ws) >= 20),
p as (select a.row_id row_id_a, b.row_id row_id_b, a.n + b.n n, len(list_intersect(a.ws, b.ws)) o
  from s a join s b on a.row_id < b.row_id and a.n * 10 >= b.n * 7 and b.n * 10 >= a.n * 7)
select row_id_a, row_id_b from p where o * 10 >= (n - o) * 7""",
    "p2_text_terms": """
with w as (select row_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term from nyt_sampled),
c as (select term, count(*) occurrences, count(distinct row_id) n_records from w group by 1)
select *, case when n_records < 3 then 'rare' when n_records * 5 > (select count(*) from nyt_sampled) then 'common' end mark from c""",
    "p2_text_trigrams": """
with w as (select row_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') ws from nyt_sampled),
g as (select row_id, n, array_to_string(ws[i:i + n - 1], ' ') term
  from w, unnest([1, 2, 3]) t(n), unnest(range(1, len(ws) - n + 2)) u(i))
select term, n::int n_terms, count(*) occurrences, count(distinct row_id) n_records from g group by 1, 2""",
    "p3_found": """
with recursive tied as (
  select topic1_id a, topic2_id b from topic_diversity_results
  where not isnan(similarity_score) and topic1_id <> topic2_id
    and case when similarity_score > 1 then similarity_score / 100 else similarity_score end >= 0.75
), e as (select a, b from tied union select b, a from tied),
reach(topic_id, m) as (
  select a, a from e union select e.b, r.m from reach r join e on e.a = r.topic_id where r.m < e.b
)
select topic_id, min(m) group_id from reach group by 1""",
}
