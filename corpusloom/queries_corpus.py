"""Queries over articles: matching, text, vocabularies, samples, budgets and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import numbers, text
from corpusloom.operators import match, sampling, vocabulary
from corpusloom.operators.orphans import normal_id
from corpusloom.plans.durable import durable
from corpusloom.sources.tables import table

WORD = "[\\p{L}\\p{N}]+"


def _articles(spark, d):
    return table(spark, d, "nyt_sampled")


def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    return match.keyword_match(_articles(spark, d), table(spark, d, "topics"))


def topic_enhance(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "topics")
    return match.adaptive_cut(match.keyword_match(_articles(spark, d), topics), topics)


def title_validation(spark: SparkSession, d: str) -> DataFrame:
    kept = match.existing_titles(table(spark, d, "source_titles_with_ids"), _articles(spark, d), by="topic_id")
    return kept.select("topic_id", "title", "ref_id")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


def clean_tokens(spark: SparkSession, d: str) -> DataFrame:
    toks = text.tokens(text.clean_text(F.col("text")), stop_words=text.STOP_WORDS)
    return table(spark, d, "documents").select("doc_id", F.size(toks).alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))


def _tokenized(spark, d):
    toks = text.tokens(text.clean_text(F.col("text")), stop_words=text.STOP_WORDS)
    return _articles(spark, d).filter(F.col("text").isNotNull()).select("row_id", toks.alias("tokens"))


def _vocab(docs, size=None):
    return vocabulary.vocabulary(docs, "row_id", "tokens", min_df=3, max_df=0.5, size=size)


def vocab_df(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(_tokenized(spark, d), size=2000)


def vocab_full(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.vocabulary(_tokenized(spark, d), "row_id", "tokens")


def bow(spark: SparkSession, d: str) -> DataFrame:
    docs = durable(vocabulary.long_enough(_tokenized(spark, d), "tokens", 5))  # read three times
    return vocabulary.bag_of_words(docs, "row_id", "tokens", _vocab(docs))


def bow_shares(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.normalized(bow(spark, d), "row_id").select("row_id", "term_id", F.round("w", 6).alias("w"))


def average_length(spark: SparkSession, d: str) -> DataFrame:
    return bow(spark, d).agg(F.round(F.sum("cnt") / F.countDistinct("row_id"), 6).alias("average_length"))


def label_encode(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.label_ids(_articles(spark, d).select("row_id", "topic"), "topic").select("row_id", "topic", "label_id")


def slice_wordfreq(spark: SparkSession, d: str) -> DataFrame:
    docs = durable(_tokenized(spark, d))
    slices = _articles(spark, d).filter(F.col("text").isNotNull()).select("row_id", F.date_format("loaded_at", "yyyy-MM").alias("time_slice"))
    freq = vocabulary.slice_frequency(vocabulary.bag_of_words(docs, "row_id", "tokens", _vocab(docs)), "row_id", slices)
    return freq.select("time_slice", "term_id", F.round("mean_cnt", 6).alias("mean_cnt"))


def docs_per_slice(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).groupBy(F.date_format("loaded_at", "yyyy-MM").alias("time_slice")).agg(F.count("*").alias("docs"))


_LINE = {"ID": "id", "Title": "title", "Text": "text", "Topic": "topic", "Date": "pub_date", "Keywords": "keywords"}


def serialize_lines(spark: SparkSession, d: str) -> DataFrame:
    line = text.article_line(_LINE)
    return _articles(spark, d).select("row_id", F.md5(line).alias("line"), text.estimated_tokens(line).alias("tokens_up"), text.estimated_tokens(line, up=False).alias("tokens_down"))


def parse_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _articles(spark, d).select("row_id", text.article_line(_LINE).alias("line"))
    return lines.select("row_id", text.line_field(F.col("line"), "ID").alias("id"), text.line_field(F.col("line"), "Title").alias("title"))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_sample(_articles(spark, d).select("row_id", "id", "title"), "row_id", 300)


def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.train_test(_articles(spark, d).select("row_id"), "row_id", 0.2)


def longest_context(spark: SparkSession, d: str) -> DataFrame:
    return sampling.longest(_articles(spark, d), sampling.context_length("title", "text", "topic", "keywords"), "row_id", 100).select("row_id", "context_length")


def context_percentiles(spark: SparkSession, d: str) -> DataFrame:
    n = _articles(spark, d).select(sampling.context_length("title", "text", "topic", "keywords").alias("n"))
    marks = [50, 70, 80, 90, 95, 99]
    out = n.agg(F.count("*").alias("rows"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.floor(F.avg("n")).alias("mean"), F.percentile("n", F.array(*[F.lit(m / 100) for m in marks])).alias("p"))
    return out.select("rows", "shortest", "longest", "mean", *[F.round(F.col("p")[i], 6).alias(f"p{m}") for i, m in enumerate(marks)], numbers.sample_size(F.col("rows")).alias("sample_size"))


def min_length_filter(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).filter(F.length("text") >= 500).select("row_id", F.length("text").alias("n"))


def top_values(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).filter("topic is not null").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(8)


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    lines = _articles(spark, d).filter("trim(id) <> '' and trim(title) <> '' and trim(text) <> ''")
    lines = lines.select("row_id", sampling.digits_or_zero(F.col("id")).alias("number"), text.estimated_tokens(text.article_line(_LINE), up=False).alias("tokens"))
    budgets = table(spark, d, "model_limits").select("model", F.floor(F.greatest(F.col("total_context"), F.lit(32768)) * 0.75).cast("bigint").alias("budget"))
    return sampling.token_budget(lines, ["number", "row_id"], "tokens", budgets)


def row_range(spark: SparkSession, d: str) -> DataFrame:
    return sampling.row_range(_articles(spark, d).select("row_id", "title"), ["row_id"], 100, 250).select("row_id", F.col("position").alias("at"))


def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    todo = _articles(spark, d).select("row_id", normal_id(F.col("id")).alias("k"))
    done = table(spark, d, "assignment_decisions").select(normal_id(F.col("article_id")).alias("k"))
    return sampling.not_done(todo, done, "k").select("row_id")


def decided_articles(spark: SparkSession, d: str) -> DataFrame:
    docs = _articles(spark, d).select(normal_id(F.col("id")).alias("k"), "row_id")
    refs = table(spark, d, "assignment_decisions").select("ref_id", normal_id(F.col("article_id")).alias("k"))
    newest = docs.groupBy("k").agg(F.max("row_id").alias("row_id"))
    return refs.join(newest, "k").select("ref_id", "row_id")


def topic_estimate(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(text.estimated_tokens(F.col("text"))).alias("t"))
    t, n = F.col("t"), F.col("n")
    return per.select("source", n, t, numbers.topic_estimate(t, n).alias("full_topics"), numbers.topic_estimate(t, n, keyword_mode=True).alias("keyword_topics"), numbers.expected_output(n).alias("output_tokens"))


def llm_cost(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "assignment_decisions").select("topic_id", text.estimated_tokens(F.col("text")).alias("i"), text.estimated_tokens(F.col("explanation")).alias("o"))
    runs = table(spark, d, "topics").select("topic_id", "result_id").join(table(spark, d, "topic_results").select("result_id", "model"), "result_id")
    priced = calls.join(runs, "topic_id").join(F.broadcast(table(spark, d, "model_limits")), "model", "left")
    each = numbers.cost(F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0)), F.col("input_cost"), F.col("output_cost"))
    return priced.groupBy("model").agg(F.count("*").alias("calls"), F.sum("i").alias("tokens_in"), F.sum("o").alias("tokens_out"), F.round(F.sum(each), 6).alias("cost"))


def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.coalesce("keywords", F.array().cast("array<string>")))
    return table(spark, d, "topics").select("topic_id", n.alias("n"), n.between(5, 12).alias("meets"))


def file_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_results").select("result_id", text.slug(F.concat_ws("/", "dataset", "model")).alias("slug"))


QUERIES = {f.__name__: f for f in (
    keyword_match, topic_enhance, title_validation, clean_text, clean_tokens, vocab_df, vocab_full, bow, bow_shares, average_length, label_encode,
    slice_wordfreq, docs_per_slice, serialize_lines, parse_lines, hash_sample, train_test_split, longest_context, context_percentiles, min_length_filter,
    top_values, token_budget, row_range, resume_antijoin, decided_articles, topic_estimate, llm_cost, keyword_flags, file_slugs,
)}

_MATCH = r"""
with a as (select row_id, title, lower(title) lt, lower(concat_ws(' ', title, text)) lb from nyt_sampled where trim(title, ' ') <> '' and trim(text, ' ') <> ''),
k0 as (select topic_id, unnest(keywords) keyword, generate_subscripts(keywords, 1) pos from topics),
k as (select topic_id, pos, lower(trim(regexp_replace(keyword, '[\s\p{Z}]+', ' ', 'g'), ' ')) keyword from k0),
ks as (select distinct keyword, '(?:^|[^\p{L}\p{N}_])' || regexp_escape(keyword) || '(?:$|[^\p{L}\p{N}_])' pat from k
  where length(keyword) > 1 and regexp_matches(keyword, '[\p{L}\p{N}]')),
near as materialized (select keyword, pat, row_id, lt, lb from ks, a where contains(lb, keyword)),
hits as materialized (select keyword, row_id, contains(lt, keyword) and regexp_matches(lt, pat) in_title from near where regexp_matches(lb, pat)),
points as (select topic_id, row_id, sum(case when in_title then 2 else 1 end)::bigint match_score, count(*) match_count,
    string_agg(keyword, '|' order by pos) matched_keywords from k join hits using (keyword) group by 1, 2),
ranked as (select p.*, title, row_number() over (partition by topic_id, title order by match_score desc, match_count desc, row_id) r from points p join a using (row_id)),
matched as (select topic_id, row_id, title, match_score, match_count, matched_keywords from ranked where r = 1)"""

_CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    "lower(regexp_replace({c}, '<[^>]+>', '', 'g')), '[^\\s\\p{{Z}}]+@[^\\s\\p{{Z}}]+', ' ', 'g'), '{w}@[^\\s\\p{{Z}}]+', ' ', 'g'), '_', ' ', 'g'), "
    "'{w}''', ' ', 'g'), '''{w}', ' ', 'g'), '\\.', '', 'g'), '[!\"#$%&()*+,\\-/:;<=>?@\\[\\\\\\]\\^`{{|}}~]', ' ', 'g'), '''', '', 'g'), '{w}', ' ', 'g'), ' ')"
).format(c="text", w="[\\s\\x{0b}\\x{85}\\p{Z}]")
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = f"list_filter(string_split_regex({_CLEAN}, ' +'), lambda w: length(w) >= 3 and regexp_full_match(w, '[a-zA-Z_]+') and w not in ({_STOPS}))"
_VOCAB = f"""
with docs as (select row_id, loaded_at, {_TOKENS} toks from nyt_sampled where text is not null),
used as (select * from docs@where),
df as (select term, count(distinct row_id) df, count(*) cf from (select row_id, unnest(toks) term from used) group by 1),
kept as (select * from df where df >= 3 and df <= 0.5 * (select count(*) from used) order by df desc, term@size),
vocab as (select row_number() over (order by term) - 1 term_id, term, df, cf from kept),
bow as (select row_id, term_id, count(*) cnt from (select row_id, unnest(toks) term from used) join vocab using (term) group by 1, 2)"""
_V, _B = (_VOCAB.replace("@size", "").replace("@where", w) for w in ("", " where len(toks) >= 5"))
_FIELD = "nullif(trim({0}, ' '), '')"
_LINE_SQL = "concat_ws(' | ', " + ", ".join(f"'{k}: ' || {_FIELD.format(c)}" for k, c in _LINE.items()) + ")"
_CONTEXT = "length(coalesce(title, '')) + length(coalesce(text, '')) + length(coalesce(topic, '')) + length(coalesce(keywords, ''))"
from corpusloom.queries_prepare import _key  # noqa: E402

_ESTIMATE = "greatest(3, floor(floor(t / 1000 * {p} * case when n > {a} then {x} when n > {b} then {y} else {z} end) * {w} + floor(n / {s}) * (1 - {w}) + 1e-9))::bigint"

ORACLE = {
    "keyword_match": _MATCH + " select * from matched",
    "topic_enhance": _MATCH + """,
cut as (select m.*, avg(match_score) over w mean, stddev_pop(match_score) over w sd, count(*) over w n from matched m window w as (partition by topic_id)),
kept as (select c.*, len(list_distinct(coalesce(t.keywords, []))) + (case when list_contains(list_transform(t.keywords, lambda x: x is null), true) then 1 else 0 end) kinds from cut c join topics t using (topic_id)
  where match_score >= round(case when n <= 1 then 0 when sd > 0.3 * mean then mean + 0.5 * sd else mean end, 9)),
capped as (select *, row_number() over (partition by topic_id order by match_score desc, match_count desc, row_id) r from kept)
select topic_id, row_id, title, match_score, match_count, matched_keywords from capped where r <= case when kinds <= 3 then 15 when kinds <= 6 then 25 else 40 end""",
    "title_validation": "select topic_id, title, min(ref_id) ref_id from source_titles_with_ids where title in (select title from nyt_sampled where title is not null) group by 1, 2",
    "clean_text": f"select doc_id, md5({_CLEAN}) cleaned from documents",
    "clean_tokens": f"select doc_id, len(t)::int n_tokens, array_to_string(t, ' ') tokens from (select doc_id, {_TOKENS} t from documents)",
    "vocab_df": _VOCAB.replace("@size", " limit 2000").replace("@where", "") + " select term_id, term, df, cf from vocab",
    "vocab_full": _V + " select row_number() over (order by term) - 1 term_id, term, df, cf from df",
    "bow": _B + " select * from bow",
    "bow_shares": _B + " select row_id, term_id, round(cnt / sum(cnt) over (partition by row_id), 6) w from bow",
    "average_length": _B + " select round(sum(cnt) / count(distinct row_id), 6) average_length from bow",
    "label_encode": "select row_id, topic, case when topic is null then null else dense_rank() over (order by topic nulls last) - 1 end label_id from nyt_sampled",
    "slice_wordfreq": _V + """, s as (select strftime(loaded_at, '%Y-%m') time_slice, term_id, sum(cnt) s from bow join used using (row_id) group by 1, 2),
n as (select strftime(loaded_at, '%Y-%m') time_slice, count(*) n from used group by 1)
select time_slice, term_id, round(s / n, 6) mean_cnt from s join n using (time_slice)""",
    "docs_per_slice": "select strftime(loaded_at, '%Y-%m') time_slice, count(*) docs from nyt_sampled group by 1",
    "serialize_lines": f"select row_id, md5(l) line, ceil(length(l) / 3.5)::bigint tokens_up, floor(length(l) / 3.5)::bigint tokens_down from (select row_id, {_LINE_SQL} l from nyt_sampled)",
    "parse_lines": f"select row_id, regexp_extract(l, '(?s)ID: (.*?)(?: \\| |$)', 1) id, regexp_extract(l, '(?s)Title: (.*?)(?: \\| |$)', 1) title from (select row_id, {_LINE_SQL} l from nyt_sampled)",
    "hash_sample": "select row_id, id, title from nyt_sampled order by md5(row_id || '|42'), row_id limit 300",
    "train_test_split": "select row_id, case when ('0x' || left(md5(row_id || '|42'), 8))::bigint / 4294967296.0 < 0.2 then 'test' else 'train' end split from nyt_sampled",
    "longest_context": f"select row_id, {_CONTEXT} context_length from nyt_sampled order by 2 desc, 1 limit 100",
    "context_percentiles": f"""with n as (select {_CONTEXT} n from nyt_sampled)
select count(*) rows, min(n) shortest, max(n) longest, floor(avg(n))::bigint mean, {', '.join(f'round(quantile_cont(n, {m / 100}), 6) p{m}' for m in (50, 70, 80, 90, 95, 99))},
least(500, greatest(50, floor(count(*) * case when count(*) >= 1000 then 0.1 when count(*) >= 500 then 0.15 else 0.2 end)))::bigint sample_size from n""",
    "min_length_filter": "select row_id, length(text)::int n from nyt_sampled where length(text) >= 500",
    "top_values": "select topic, count(*) n from nyt_sampled where topic is not null group by 1 order by 2 desc, 1 limit 8",
    "token_budget": f"""with l as (select row_id, case when regexp_full_match(id, '[0-9]{{1,18}}') then id::bigint else 0 end num, floor(length({_LINE_SQL}) / 3.5)::bigint tokens
  from nyt_sampled where trim(id, ' ') <> '' and trim(title, ' ') <> '' and trim(text, ' ') <> ''),
r as (select tokens, sum(tokens) over (order by num, row_id rows unbounded preceding) running from l),
b as (select model, floor(greatest(total_context, 32768) * 0.75)::bigint budget from model_limits)
select model, budget, count(running) kept_rows, coalesce(sum(tokens), 0)::bigint kept_tokens from b left join r on running <= budget group by 1, 2""",
    "row_range": 'select row_id, p "at" from (select row_id, row_number() over (order by row_id) - 1 p from nyt_sampled) where p between 100 and 349',
    "resume_antijoin": f"select row_id from nyt_sampled where coalesce({_key('id')}, '') not in (select {_key('article_id')} from assignment_decisions where {_key('article_id')} is not null)",
    "decided_articles": f"""with n as (select {_key('id')} k, max(row_id) row_id from nyt_sampled group by 1)
select ref_id, row_id from (select ref_id, {_key('article_id')} k from assignment_decisions) join n using (k)""",
    "topic_estimate": f"""with p as (select source, count(*) n, sum(ceil(length(text) / 3.5)::bigint)::bigint t from documents group by 1)
select source, n, t, {_ESTIMATE.format(p=0.8, a=1000, b=500, x=1.2, y=1.0, z=0.8, w=0.7, s=8)} full_topics,
{_ESTIMATE.format(p=0.6, a=800, b=400, x=1.1, y=1.0, z=0.9, w=0.6, s=10)} keyword_topics, least(10000, greatest(1000, n * 50))::bigint output_tokens from p""",
    "llm_cost": """with c as (select topic_id, ceil(length(text) / 3.5)::bigint i, ceil(length(explanation) / 3.5)::bigint o from assignment_decisions)
select r.model, count(*) calls, sum(i)::bigint tokens_in, sum(o)::bigint tokens_out,
round(sum(coalesce(coalesce(i, 0) / 1000 * input_cost + coalesce(o, 0) / 1000 * output_cost, 0)), 6) cost
from c join topics t using (topic_id) join topic_results r using (result_id) left join model_limits m on m.model = r.model group by 1""",
    "keyword_flags": "select topic_id, coalesce(len(keywords), 0)::int n, coalesce(len(keywords), 0) between 5 and 12 meets from topics",
    "file_slugs": "select result_id, translate(concat_ws('/', dataset, model), '/-:', '__') slug from topic_results",
}
