"""Queries of the metric suite: distribution, bias, relevance, coherence, diversity, clustering, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import coherence as co
from corpusloom.operators import hierarchy as hi
from corpusloom.operators import theta as th
from corpusloom.operators import topicmetrics as tm
from corpusloom.operators import vocabulary
from corpusloom.operators.coherence_cv import coherence_cv
from corpusloom.operators.orphans import normal_id
from corpusloom.queries_prepare import _key
from corpusloom.sources.tables import table

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
K = 8


def _counts(spark, d):
    return tm.texts_per_topic(table(spark, d, "topics").select("result_id", "topic_id"), table(spark, d, "source_titles_with_ids"))


def topic_distribution(spark: SparkSession, d: str) -> DataFrame:
    return tm.distribution(_counts(spark, d), ["result_id"]).select("result_id", "topics", *R("mean", "variance", "std"), "least", "most", *R("cv"), "band")


def assignment_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).groupBy("n").agg(F.count("*").alias("topics"))


def high_freq_priority(spark: SparkSession, d: str) -> DataFrame:
    return tm.high_frequency(_counts(spark, d), ["result_id"], "topic_id").select("result_id", *R("top_share", "stability", "priority"), "priority_band", "stability_band")


def position_bias(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "nyt_sampled").select("row_id", normal_id(F.col("id")).alias("k"))
    out = tm.position_bias(articles, "row_id", "k", table(spark, d, "source_titles_with_ids").select(normal_id(F.col("id")).alias("k")))
    return out.select(*[c if c.endswith(("_n", "_c")) else F.round(c, 6).alias(c) for c in out.columns])


def _scored(spark, d):
    rows = table(spark, d, "nyt_sampled").filter("text is not null").withColumn("k", F.concat_ws(" ", "keywords", "topic"))
    return tm.relevance(rows, "row_id", "k", "text")


def topic_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("row_id", "asked", "found", *R("relevance", "missing"))


def relevance_summary(spark: SparkSession, d: str) -> DataFrame:
    return tm.relevance_summary(_scored(spark, d)).select("rows", *R("mean", "median", "std", "mean_missing"), "high", "medium", "low", "severe")


def attempt_stats(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "topics").groupBy("result_id").agg(F.count("*").alias("made"))
    runs = table(spark, d, "topic_results").select("result_id", "model").join(made, "result_id", "left").fillna(0, ["made"])
    return tm.attempts(runs, ["model"], "result_id").select("model", "attempts", "most", *R("average"), "least", *R("std", "success_rate"), "best")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "topic_results")
    return runs.groupBy("method").agg(F.count("*").alias("runs"), F.sum(F.when(F.col("retry_count") == 0, 1).otherwise(0)).alias("clean"), F.round(F.avg("retry_count"), 6).alias("mean_retries"), F.sum("retry_count").alias("retries"))


def judged_diversity(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "topic_diversity_results").filter("topic1_id <> topic2_id")
    n = pairs.select(F.explode(F.array("topic1_id", "topic2_id")).alias("t")).distinct().count()
    kind = F.when(F.col("pair_list") == "redundant_pairs", "redundant").when(F.col("pair_list") == "partial_overlap_pairs", "overlap")
    out = tm.judged_diversity(pairs.withColumn("kind", kind), n)
    return out.select("redundant", "overlap", F.round("redundancy", 6).alias("redundancy"), F.round("overlap_rate", 9).alias("overlap_rate"))


def decision_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = tm.decision_rollup(table(spark, d, "assignment_decisions"), "topic_id", "llm_decision")
    return out.select("topic_id", "total", "yes", "no", "error", *R("yes_share"))


def judged_scores(spark, d):
    """Scores of 1 to 5 from what the judge said of each pair: how alike, in how many areas, and at what length; null where it said nothing."""
    judged = table(spark, d, "topic_diversity_results")
    alike = F.when(~F.isnan("similarity_score"), F.when(F.col("similarity_score") > 1, F.col("similarity_score") / 100).otherwise(F.col("similarity_score")))
    few = lambda n: F.when(n.isNotNull(), F.least(F.lit(5), 1 + n))
    return judged.select("pair_id", (1 + 4 * alike).alias("coherence"), few(F.when(F.col("overlap_areas").isNotNull(), F.size("overlap_areas"))).alias("conciseness"), few(F.floor(F.length("overlap_reason") / 20)).alias("informativity"))


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return tm.score_summary(judged_scores(spark, d), ["coherence", "conciseness", "informativity"])


def _ntm(spark, d, k=K):
    rows = table(spark, d, "ntm_assignments").filter("topic_word_list is not null")
    return co.top_terms(rows.select("topic_id", text.words(F.col("topic_word_list")).alias("ws")), "topic_id", "ws", k)


def _docs(spark, d):
    return table(spark, d, "nyt_sampled").filter("text is not null").select("row_id", text.words(F.col("text")).alias("ws"))


def top_words(spark: SparkSession, d: str) -> DataFrame:
    return _ntm(spark, d)


def _per_topic(scores: DataFrame, *names: str) -> DataFrame:
    return scores.groupBy("topic_id").agg(F.count("*").alias("pairs"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def doc_npmi(spark: SparkSession, d: str) -> DataFrame:
    docs, topics = _docs(spark, d), _ntm(spark, d)
    n = docs.count()
    counted = co.pair_counts(co.presence_within(docs, "row_id", "ws", topics), "row_id", co.word_pairs(topics, "topic_id"))
    return _per_topic(counted.filter("n12 > 0").withColumn("npmi", co.npmi(n)), "npmi")


def token_pmi_umass(spark: SparkSession, d: str) -> DataFrame:
    docs, topics = _docs(spark, d), _ntm(spark, d)
    n = docs.count()
    counted = co.pair_counts(co.presence(docs, "row_id", "ws", topics), "row_id", co.word_pairs(topics, "topic_id")).filter("n12 > 0")
    return _per_topic(counted.withColumns({"npmi": co.npmi(n), "pmi": co.pmi(n), "smoothed": co.smoothed_pmi(n), "umass": co.umass()}), "npmi", "pmi", "smoothed", "umass")


def window_npmi(spark: SparkSession, d: str) -> DataFrame:
    topics = _ntm(spark, d)
    docs = table(spark, d, "nyt_sampled").filter("text is not null").select("row_id", F.filter(text.words(F.col("text")), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(text.STOP_WORDS)).alias("ws"))
    n = docs.count()
    counted = co.window_counts(docs, "row_id", "ws", topics, co.word_pairs(topics, "topic_id"))
    scored = counted.withColumn("npmi", co.npmi(n))
    return scored.groupBy("topic_id").agg(F.count("npmi").alias("pairs"), F.round(F.coalesce(F.avg("npmi"), F.lit(0.0)), 6).alias("npmi"))


def window_coherence(spark: SparkSession, d: str) -> DataFrame:
    return coherence_cv(_docs(spark, d), "ws", _ntm(spark, d), "topic_id").select("topic_id", *R("coherence"))


def word_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    out = co.word_quality(_ntm(spark, d), "topic_id", vocabulary.document_frequency(docs, "row_id", "ws"), text.STOP_WORDS)
    return out.select("topic_id", *R("clean_share", "stop_share", "diversity", "mean_df", "quality"), "is_low")


def topic_diversity(spark: SparkSession, d: str) -> DataFrame:
    return co.topic_diversity(_topic_words(spark, d), ["result_id"]).select("result_id", *R("diversity"), "n_words")


def _topic_words(spark, d):
    return table(spark, d, "topics").select("result_id", "topic_id", F.explode("keywords").alias("w")).select("result_id", "topic_id", F.lower(F.trim("w")).alias("word")).filter("word <> ''")


def word_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return co.word_uniqueness(_topic_words(spark, d), ["result_id"]).select("result_id", *R("uniqueness"))


def multilevel_diversity(spark: SparkSession, d: str) -> DataFrame:
    return co.topic_diversity(_topic_words(spark, d), ["result_id"]).agg(F.round(F.avg("diversity"), 6).alias("mean_diversity"))


def dynamic_diversity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nyt_sampled").filter("text is not null and topic is not null").select("row_id", F.date_format("loaded_at", "yyyy-MM").alias("time_slice"), "topic", text.words(F.col("text")).alias("ws"))
    top = co.top_terms(rows.select(F.struct("time_slice", "topic").alias("g"), "ws"), "g", "ws", 10).select("g.time_slice", "g.topic", "word")
    # the vocabulary leaves out words of most documents, as models see it
    kept = vocabulary.vocabulary(rows, "row_id", "ws", min_df=3, max_df=0.5).select("term")
    held = rows.select("time_slice", F.explode("ws").alias("term")).distinct().join(kept, "term")
    return co.slice_diversity(top, held, "time_slice", "topic").select("time_slice", "once", *R("diversity"))


def _lists(spark, d):
    t = table(spark, d, "topics").filter("keywords is not null")
    return t.select("result_id", "topic_num", F.filter(F.transform("keywords", lambda w: F.lower(F.trim(w))), lambda w: w != "").alias("ws"))


def rbo(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of equally many topics: their topics' words, in order, compared topic by topic."""
    placed = _lists(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("result_id").orderBy("topic_num")))
    sized = placed.join(placed.groupBy("result_id").agg(F.count("*").alias("n")), "result_id")
    a, b = (sized.select("at", "n", F.col("result_id").alias(f"{s}_run"), F.col("ws").alias(s)) for s in ("a", "b"))
    pairs = a.join(b, ["at", "n"]).filter("a_run < b_run")
    return pairs.groupBy("a_run", "b_run").agg(F.round(F.avg(co.rank_biased_overlap(F.col("a"), F.col("b"))), 6).alias("rbo"))


def overlap_coef(spark: SparkSession, d: str) -> DataFrame:
    """The largest overlap between any two topics of a run, 0 where none share a word."""
    words = _topic_words(spark, d)
    most = co.shared_words(words, ["result_id"], "topic_id").groupBy("result_id").agg(F.max(F.col("shared") / F.least("size_a", "size_b")).alias("overlap"))
    return words.select("result_id").distinct().join(most, "result_id", "left").fillna(0.0, ["overlap"]).select("result_id", *R("overlap"))


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def embedding_coherence(spark: SparkSession, d: str) -> DataFrame:
    return th.embedding_coherence(_vectors(spark, d), "label", "embedding").select("label", "n", *R("coherence"))


def theta_argmax(spark: SparkSession, d: str) -> DataFrame:
    return th.argmax(th.from_vectors(_vectors(spark, d), "vec_id", "embedding", "topic_id"), "vec_id", "topic_id")


def beta_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return th.top_of(th.centroids(_vectors(spark, d), "label", "vec_id", "embedding"), "label", "dim", 5).select("label", "pos", "dim", *R("w"))


def theta_softmax(spark: SparkSession, d: str) -> DataFrame:
    return th.softmax(th.from_vectors(_vectors(spark, d), "vec_id", "embedding"), ["vec_id"]).select("vec_id", "dim", *R("w"))


def theta_beta_product(spark: SparkSession, d: str) -> DataFrame:
    theta = th.from_vectors(_vectors(spark, d), "vec_id", "embedding")
    beta = th.centroids(_vectors(spark, d), "label", "vec_id", "embedding").select("dim", "label", "w")
    return th.matmul(theta, beta, "vec_id", "dim", "label").select("vec_id", "label", *R("w"))


def centroid_distances(spark: SparkSession, d: str) -> DataFrame:
    c = th.centroids(_vectors(spark, d), "label", "vec_id", "embedding")
    v = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "w"))), lambda x: x["w"]).alias("v"))
    x, y = v.select(F.col("label").alias("a"), F.col("v").alias("va")), v.select(F.col("label").alias("b"), F.col("v").alias("vb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(th.squared_distance(F.col("va"), F.col("vb")), 6).alias("d2"))


def purity_nmi(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("topic is not null and source is not null")
    return th.purity_nmi(rows, "topic", "source").select("n", *R("purity", "nmi"))


def acc_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """The topic of an article guessed as the commonest one of its source and language."""
    rows = table(spark, d, "documents").filter("topic is not null and source is not null and lang is not null")
    per = rows.groupBy("source", "lang", "topic").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("source", "lang").orderBy(F.desc("n"), "topic"))
    guess = per.withColumn("r", first).filter("r = 1").select("source", "lang", F.col("topic").alias("guess"))
    return th.accuracy_f1(rows.join(F.broadcast(guess), ["source", "lang"]), "topic", "guess").select("n", *R("accuracy", "macro_f1"))


def _phi(spark, d):
    rows = table(spark, d, "documents").filter("topic is not null and source is not null")
    return rows.groupBy(F.col("topic").alias("parent"), F.col("source").alias("child")).agg(F.count("*").alias("w"))


def _level_words(spark, d, by):
    rows = table(spark, d, "documents").filter("topic is not null and source is not null and text is not null")
    return co.top_terms(rows.select(F.col(by).alias("topic"), text.words(F.col("text")).alias("ws")), "topic", "ws", 10)


def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    return hi.edges(_phi(spark, d))


def _all_docs(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.words(F.col("text")).alias("ws"))


def pcc(spark: SparkSession, d: str) -> DataFrame:
    docs, up, low = _all_docs(spark, d), _level_words(spark, d, "topic"), _level_words(spark, d, "source")
    present = co.presence(docs, "doc_id", "ws", up.select("word").unionByName(low.select("word")))
    out = hi.cross_level(hierarchy_edges(spark, d), up, low, lambda pairs: co.pair_counts(present, "doc_id", pairs), docs.count())
    return out.select("parent", "child", *R("coherence"))


def pcd(spark: SparkSession, d: str) -> DataFrame:
    return hi.difference(hierarchy_edges(spark, d), _level_words(spark, d, "topic"), _level_words(spark, d, "source")).select("parent", "child", *R("diversity"))


def pncd(spark: SparkSession, d: str) -> DataFrame:
    apart = hi.strangers(_phi(spark, d), hierarchy_edges(spark, d))
    return hi.difference(apart, _level_words(spark, d, "topic"), _level_words(spark, d, "source")).agg(F.round(F.avg("diversity"), 6).alias("pncd"))


def sibling_td(spark: SparkSession, d: str) -> DataFrame:
    return hi.sibling_diversity(hierarchy_edges(spark, d), _level_words(spark, d, "source")).select("parent", *R("diversity"))


def sibling_npmi(spark: SparkSession, d: str) -> DataFrame:
    docs, low = _all_docs(spark, d), _level_words(spark, d, "source")
    pairs = hi.siblings(hierarchy_edges(spark, d)).select(F.col("a").alias("parent"), F.col("b").alias("child")).distinct()
    present = co.presence(docs, "doc_id", "ws", low)
    out = hi.cross_level(pairs, low, low, lambda p: co.pair_counts(present, "doc_id", p), docs.count())
    return out.select(F.col("parent").alias("a"), F.col("child").alias("b"), *R("coherence"))


QUERIES = {f.__name__: f for f in (
    topic_distribution, assignment_histogram, high_freq_priority, position_bias, topic_relevance, relevance_summary, attempt_stats, run_summary, judged_diversity,
    decision_rollup, score_summary, top_words, doc_npmi, token_pmi_umass, window_npmi, window_coherence, word_quality, topic_diversity, word_uniqueness, multilevel_diversity,
    dynamic_diversity, rbo, overlap_coef, embedding_coherence, theta_argmax, beta_top_terms, theta_softmax, theta_beta_product, centroid_distances,
    purity_nmi, acc_macro_f1, hierarchy_edges, pcc, pcd, pncd, sibling_td, sibling_npmi,
)}

W = "[\\p{L}\\p{N}]+"
_N = "with n as (select t.result_id, t.topic_id, count(s.ref_id) n from topics t left join source_titles_with_ids s using (topic_id) group by 1, 2)"
_REL = """with k as (select row_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(concat_ws(' ', keywords, topic), '')), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{4,}'))) k,
  list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{4,}'))) t from nyt_sampled where text is not null),
s0 as (select row_id, len(k)::int asked, len(list_intersect(k, t))::int found from k),
s as (select *, case when asked > 0 then found / asked else 0 end relevance, case when asked > 0 then round(1 - found / asked, 4) else 0 end missing from s0)"""
_NTM = f"""with c as (select topic_id, word, count(*) n from (select topic_id, unnest(regexp_extract_all(lower(topic_word_list), '{W}')) word from ntm_assignments where topic_word_list is not null) group by 1, 2),
tw as (select topic_id, row_number() over (partition by topic_id order by n desc, word) pos, word from c qualify pos <= {K}),
pairs as (select a.topic_id, a.word w1, b.word w2 from tw a join tw b on a.topic_id = b.topic_id and a.pos < b.pos),
words as (select distinct word from tw), docs as (select row_id, lower(text) t, regexp_extract_all(lower(text), '{W}') ws from nyt_sampled where text is not null),
total as (select count(*) n from docs)"""
_PAIRED = """,
single as (select word, count(*) n from present group by 1),
both_ as (select a.word w1, b.word w2, count(*) n12 from present a join present b using (row_id) where a.word <> b.word group by 1, 2),
counted as (select p.*, coalesce(n12, 0) n12, coalesce(s1.n, 0) n1, coalesce(s2.n, 0) n2, total.n n from pairs p left join both_ using (w1, w2) left join single s1 on s1.word = w1 left join single s2 on s2.word = w2, total)"""
_NPMI = "case when n12 = 0 then null when n12 = n then 1 else ln(n12 * n / (n1 * n2)) / -ln(n12 / n) end"
_TOPW = "with w as (select result_id, topic_id, lower(trim(k, ' ')) word from (select result_id, topic_id, unnest(keywords) k from topics) where trim(k, ' ') <> '')"
_LONG = "with l as (select vec_id, label, unnest(embedding)::double w, generate_subscripts(embedding, 1) - 1 dim from embeddings), c as (select label, dim, avg(w) w from l group by 1, 2)"
_HIER = f"""with rows_ as (select doc_id, topic, source, regexp_extract_all(lower(text), '{W}') ws from documents where topic is not null and source is not null and text is not null),
phi as (select topic parent, source child, count(*) w from documents where topic is not null and source is not null group by 1, 2),
k as (select greatest(1, round_even(count(distinct child) / count(distinct parent), 0)) k from phi),
links as (select parent, child from (select *, row_number() over (partition by parent order by w desc, child) r from phi), k where r <= k),
up as (select topic, word from (select topic, word, row_number() over (partition by topic order by count(*) desc, word) r from (select topic, unnest(ws) word from rows_) group by 1, 2) where r <= 10),
low as (select topic, word from (select topic, word, row_number() over (partition by topic order by count(*) desc, word) r from (select source topic, unnest(ws) word from rows_) group by 1, 2) where r <= 10)"""
_CROSS = """, words as (select word from up union select word from low),
docs as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) ws from documents where text is not null),
present as (select doc_id, word from (select doc_id, unnest(ws) word from docs) where word in (select word from words)),
single as (select word, count(*) n from present group by 1),
both_ as (select a.word w1, b.word w2, count(*) n12 from present a join present b using (doc_id) where a.word <> b.word group by 1, 2),
shared as (select x.parent, x.child, u.word from x join @up u on u.topic = x.parent join low l on l.topic = x.child and l.word = u.word),
own as (select x.parent, x.child, u.word w1, l.word w2 from x join @up u on u.topic = x.parent join low l on l.topic = x.child
  where not exists (select 1 from shared s where s.parent = x.parent and s.child = x.child and s.word in (u.word, l.word))),
scored as (select parent, child, case when coalesce(n12, 0) = t.n then 1 when coalesce(s1.n, 0) = 0 or coalesce(s2.n, 0) = 0 then 0
  else ln((coalesce(n12, 0) / t.n + 1e-10) / (s1.n / t.n * s2.n / t.n)) / -ln(coalesce(n12, 0) / t.n + 1e-10) end s
  from own left join both_ using (w1, w2) left join single s1 on s1.word = w1 left join single s2 on s2.word = w2, (select count(*) n from docs) t),
a as (select parent, child, sum(s) s, count(*) n from scored group by 1, 2), b as (select parent, child, count(*) * count(*) x from shared group by 1, 2),
result as (select x.parent, x.child, round(case when coalesce(n, 0) + coalesce(b.x, 0) > 0 then (coalesce(s, 0) - coalesce(b.x, 0)) / (coalesce(n, 0) + coalesce(b.x, 0)) else 0 end, 6) coherence
  from x left join a using (parent, child) left join b using (parent, child))"""
_DIFF = ", h as (select x.parent, x.child, word from x join up on up.topic = x.parent union all select x.parent, x.child, word from x join low on low.topic = x.child), g as (select parent, child, word, count(*) n from h group by 1, 2, 3), f as (select parent, child, sum(case when n = 1 then 1 else 0 end) / sum(n) diversity from g group by 1, 2)"
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)

JUDGED = """with s as (select pair_id, 1 + 4 * case when isnan(similarity_score) then null when similarity_score > 1 then similarity_score / 100 else similarity_score end coherence,
  case when overlap_areas is not null then least(5, 1 + len(overlap_areas)) end::double conciseness, case when overlap_reason is not null then least(5, 1 + floor(length(overlap_reason) / 20)) end::double informativity from topic_diversity_results)"""

ORACLE = {
    "topic_distribution": _N + """, g as (select result_id, count(*) topics, avg(n) mean, var_pop(n) variance, stddev_pop(n) std, min(n) least, max(n) most from n group by 1),
h as (select *, case when mean <> 0 then std / mean else 0 end cv from g)
select result_id, topics, round(mean, 6) mean, round(variance, 6) variance, round(std, 6) std, least, most, round(cv, 6) cv, case when cv < 0.3 then 'high' when cv < 0.6 then 'medium' else 'low' end band from h""",
    "assignment_histogram": _N + " select n, count(*) topics from n group by 1",
    "high_freq_priority": _N + """, r as (select *, row_number() over (partition by result_id order by n desc, topic_id) r, count(*) over (partition by result_id) c from n),
g as (select result_id, sum(case when r <= greatest(1, floor(c / 5)) then n else 0 end) / nullif(sum(n), 0) top_share, 1 / (1 + coalesce(var_pop(n) / nullif(avg(n), 0), 0)) stability, avg(n) / nullif(max(n), 0) priority from r group by 1)
select result_id, round(coalesce(top_share, 0), 6) top_share, round(stability, 6) stability, round(coalesce(priority, 0), 6) priority,
case when coalesce(priority, 0) > 0.7 then 'high' when coalesce(priority, 0) > 0.5 then 'medium' else 'low' end priority_band, case when stability > 0.7 then 'high' when stability > 0.5 then 'medium' else 'low' end stability_band from g""",
    "position_bias": f"""with a as (select {_key('id')} k, row_number() over (order by row_id) - 1 p, count(*) over () n from nyt_sampled),
s as (select distinct case when p < floor(n * 0.3) then 'front' when p < floor(n * 0.7) then 'middle' else 'back' end segment, k from a where k is not null),
c as (select distinct {_key('id')} k from source_titles_with_ids where {_key('id')} is not null),
g as (select segment, count(*) n, count(c.k) c from s left join c using (k) group by 1),
o as (select max(n) filter (segment = 'front') front_n, max(c) filter (segment = 'front') front_c, max(n) filter (segment = 'middle') middle_n, max(c) filter (segment = 'middle') middle_c,
  max(n) filter (segment = 'back') back_n, max(c) filter (segment = 'back') back_c from g),
r as (select *, front_c / front_n f, middle_c / middle_n m, back_c / back_n b from o)
select front_n, front_c, middle_n, middle_c, back_n, back_c, round(f, 6) front_share, round(m, 6) middle_share, round(b, 6) back_share, round(f / (m + 0.001), 6) front_to_middle, round(b / (m + 0.001), 6) back_to_middle,
round(f / (b + 0.001), 6) front_to_back, round(1 - m, 6) middle_neglect, round((select stddev_pop(v) from unnest([f, m, b]) t(v)), 6) balance,
round((select count(*) from c) / (select count(*) from nyt_sampled), 6) overall from r""",
    "topic_relevance": _REL + " select row_id, asked, found, round(relevance, 6) relevance, round(missing, 6) missing from s",
    "relevance_summary": _REL + """ select count(*) rows, round(avg(relevance), 6) mean, round(quantile_cont(relevance, 0.5), 6) median, round(stddev_pop(relevance), 6) std, round(avg(missing), 6) mean_missing,
count(*) filter (relevance >= 0.7) high, count(*) filter (relevance >= 0.3 and relevance < 0.7) medium, count(*) filter (relevance < 0.3) low, count(*) filter (missing > 0.5) severe from s""",
    "attempt_stats": """with m as (select r.model, r.result_id, count(t.topic_id) made from topic_results r left join topics t using (result_id) group by 1, 2)
select model, count(*) attempts, max(made) most, round(coalesce(avg(made) filter (made > 0), 0), 6) average, coalesce(min(made) filter (made > 0), 0) least,
round(coalesce(stddev_pop(made) filter (made > 0), 0), 6) std, round(count(*) filter (made > 0) / count(*), 6) success_rate, first(result_id order by made desc, result_id) best from m group by 1""",
    "run_summary": "select method, count(*) runs, count(*) filter (retry_count = 0) clean, round(avg(retry_count), 6) mean_retries, sum(retry_count)::bigint retries from topic_results group by 1",
    "judged_diversity": """with p as (select * from topic_diversity_results where topic1_id <> topic2_id), n as (select count(*) n from (select topic1_id from p union select topic2_id from p))
select count(*) filter (pair_list = 'redundant_pairs') redundant, count(*) filter (pair_list = 'partial_overlap_pairs') overlap,
round(count(*) filter (pair_list = 'redundant_pairs') / max(n), 6) redundancy, round(count(*) filter (pair_list = 'partial_overlap_pairs') / (max(n) * (max(n) - 1) / 2), 9) overlap_rate from p, n""",
    "decision_rollup": """with d as (select topic_id, case when lower(trim(llm_decision, ' ')) in ('yes', 'no') then lower(trim(llm_decision, ' ')) else 'error' end d from assignment_decisions),
g as (select topic_id, count(*) total, count(*) filter (d = 'yes') yes, count(*) filter (d = 'no') no, count(*) filter (d = 'error') error from d where topic_id is not null group by 1
  union all select null, count(*), count(*) filter (d = 'yes'), count(*) filter (d = 'no'), count(*) filter (d = 'error') from d)
select *, round(yes / total, 6) yes_share from g""",
    "score_summary": JUDGED + """,
l as (select unnest(['coherence', 'conciseness', 'informativity']) score, unnest([coherence, conciseness, informativity]) v from s where coherence is not null and conciseness is not null and informativity is not null),
g as (select score, count(*) n, avg(v) mean, quantile_cont(v, 0.5) median, coalesce(stddev_samp(v), 0) std, min(v) least, max(v) most from l group by 1)
select score, n, round(mean, 6) mean, round(median, 6) median, round(std, 6) std, round(least, 6) least, round(most, 6) most,
case when mean >= 4.5 then 'excellent' when mean >= 4 then 'good' when mean >= 3.5 then 'fair' when mean >= 3 then 'passing' else 'poor' end level from g""",
    "top_words": _NTM + " select topic_id, pos::int pos, word from tw",
    "doc_npmi": _NTM + ", present as (select row_id, word from docs, words where contains(t, word))" + _PAIRED + f" select topic_id, count(*) pairs, round(avg({_NPMI}), 6) npmi from counted where n12 > 0 group by 1",
    "token_pmi_umass": _NTM + ", present as (select row_id, word from docs, words where list_contains(ws, word))" + _PAIRED + f""" select topic_id, count(*) pairs, round(avg({_NPMI}), 6) npmi, round(avg(ln(n12 * n / (n1 * n2))), 6) pmi,
round(avg(ln((n12 / n + 1e-10) / (n1 / n * n2 / n + 1e-10))), 6) smoothed, round(avg(ln((n12 + 1) / n2)), 6) umass from counted where n12 > 0 group by 1""",
    "window_npmi": _NTM + f""", toks as (select row_id, list_filter(ws, lambda w: regexp_full_match(w, '[a-z]{{3,}}') and w not in ({_STOPS})) ws from docs),
at_ as (select row_id, unnest(ws) word, generate_subscripts(ws, 1) p from toks), present as (select distinct row_id, word from at_ where word in (select word from words)),
single as (select word, count(*) n from present group by 1),
both_ as (select w1, w2, count(*) n12 from (select distinct a.row_id, a.word w1, b.word w2 from at_ a join at_ b on a.row_id = b.row_id and abs(a.p - b.p) <= 10 where a.word in (select word from words) and b.word in (select word from words)) group by 1, 2),
counted as (select p.*, coalesce(n12, 0) n12, coalesce(s1.n, 0) n1, coalesce(s2.n, 0) n2, total.n n from pairs p left join both_ using (w1, w2) left join single s1 on s1.word = w1 left join single s2 on s2.word = w2, total),
v as (select topic_id, {_NPMI} v from counted)
select topic_id, count(v) pairs, round(coalesce(avg(v), 0), 6) npmi from v group by 1""",
    "window_coherence": _NTM + """, at_ as (select row_id, len(ws) n, unnest(ws) word, generate_subscripts(ws, 1) p from docs),
held as (select distinct row_id, word, unnest(range(greatest(1, p - 109), least(p, greatest(1, n - 109)) + 1)) s from at_ where word in (select word from words)),
m as (select sum(greatest(1, len(ws) - 109)) m from docs where len(ws) > 0), single as (select word, count(*) n from held group by 1),
both_ as (select a.word w1, b.word w2, count(*) n12 from held a join held b using (row_id, s) group by 1, 2),
v0 as (select a.topic_id, a.word w1, b.word w2, coalesce(n12, 0) / m + 1e-12 p, coalesce(n12, 0) n12, coalesce(s1.n, 0) n1, coalesce(s2.n, 0) n2, m from tw a join tw b using (topic_id)
  left join both_ on w1 = a.word and w2 = b.word left join single s1 on s1.word = a.word left join single s2 on s2.word = b.word, m),
v as (select topic_id, w1, w2, case when n12 >= m then 1 when n1 > 0 and n2 > 0 then ln(p / (n1 / m * n2 / m)) / -ln(p) else 0 end v from v0),
t as (select topic_id, w2, sum(v) s from v group by 1, 2), cosines as (select topic_id, w1, sum(v * s) d, sum(v * v) a, sum(s * s) b from v join t using (topic_id, w2) group by 1, 2)
select topic_id, round(avg(case when a * b > 0 then d / sqrt(a * b) else 0 end), 6) coherence from cosines group by 1""",
    "word_quality": _NTM + f""", df as (select word, count(*) df from (select unnest(list_distinct(ws)) word from docs) group by 1),
q as (select topic_id, avg(case when regexp_full_match(word, '[a-z]{{3,}}') and word not in ({_STOPS}) then 1.0::double else 0 end) c, avg(case when word in ({_STOPS}) then 1.0::double else 0 end) s, count(distinct word) / count(*) d, avg(coalesce(df, 0)) m from tw left join df using (word) group by 1)
select topic_id, round(c, 6) clean_share, round(s, 6) stop_share, round(d, 6) diversity, round(m, 6) mean_df, round(c * d, 6) quality, c * d < 0.5 is_low from q""",
    "topic_diversity": _TOPW + " select result_id, round(count(distinct word) / count(*), 6) diversity, count(*) n_words from w group by 1",
    "word_uniqueness": _TOPW + ", g as (select result_id, word, count(*) n from w group by 1, 2) select result_id, round(count(*) filter (n = 1) / count(*), 6) uniqueness from g group by 1",
    "multilevel_diversity": _TOPW + ", g as (select count(distinct word) / count(*) v from w group by result_id) select round(avg(v), 6) mean_diversity from g",
    "dynamic_diversity": f"""with w as (select row_id, strftime(loaded_at, '%Y-%m') time_slice, topic, unnest(regexp_extract_all(lower(text), '{W}')) word from nyt_sampled where text is not null and topic is not null),
t as (select time_slice, topic, word, row_number() over (partition by time_slice, topic order by count(*) desc, word) r from w group by 1, 2, 3), top as (select * from t where r <= 10),
kept as (select word from w group by 1 having count(distinct row_id) >= 3 and count(distinct row_id) <= 0.5 * (select count(*) from nyt_sampled where text is not null and topic is not null)),
held as (select distinct time_slice, word from w where word in (select word from kept)),
once as (select time_slice, count(*) once from (select time_slice, word from top group by 1, 2 having count(*) = 1) join held using (time_slice, word) group by 1),
sizes as (select time_slice, count(*) k, first(n order by topic) t from (select time_slice, topic, count(*) n from top group by 1, 2) group by 1)
select time_slice, coalesce(once, 0) once, round(coalesce(once, 0) / (k * t), 6) diversity from sizes left join once using (time_slice)""",
    "rbo": """with l as (select result_id, row_number() over (partition by result_id order by topic_num) i, count(*) over (partition by result_id) n,
  list_filter(list_transform(keywords, lambda w: lower(trim(w, ' '))), lambda w: w <> '') ws from topics where keywords is not null),
p as (select x.result_id a_run, y.result_id b_run, x.ws a, y.ws b, least(len(x.ws), len(y.ws)) m from l x join l y on x.i = y.i and x.n = y.n and x.result_id < y.result_id),
s as (select a_run, b_run, case when m = 0 then 0 else (1 - 0.9::double) * (list_sum(list_transform(range(1, m + 1), lambda d: pow(0.9, d - 1) * len(list_intersect(a[1:d], b[1:d])) / d))
  + case when len(a) <> len(b) then len(list_intersect(a[1:m], b[1:m])) / m * pow(0.9, m) else 0 end) end v from p)
select a_run, b_run, round(avg(v), 6) rbo from s group by 1, 2""",
    "overlap_coef": _TOPW + """, s as (select result_id, topic_id, list(distinct word) ws from w group by 1, 2),
p as (select x.result_id, max(len(list_intersect(x.ws, y.ws)) / least(len(x.ws), len(y.ws))) o from s x join s y on x.result_id = y.result_id and x.topic_id < y.topic_id group by 1)
select result_id, round(coalesce(o, 0), 6) overlap from (select distinct result_id from s) left join p using (result_id)""",
    "embedding_coherence": """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings), u as (select label, vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) v from e),
p as (select a.label, list_dot_product(a.v, b.v) c from u a join u b on a.label = b.label and a.vec_id < b.vec_id)
select n.label, n, round(c, 6) coherence from (select label, count(*) n from e group by 1) n left join (select label, avg(c) c from p group by 1) using (label)""",
    "theta_argmax": _LONG + " select vec_id, first(dim order by w desc, dim)::int topic_id from l group by 1",
    "beta_top_terms": _LONG + " select label, r::int pos, dim::int dim, round(w, 6) w from (select *, row_number() over (partition by label order by w desc, dim desc) r from c) where r <= 5",
    "theta_softmax": _LONG + ", e as (select vec_id, dim, exp(w - max(w) over (partition by vec_id)) w from l) select vec_id, dim::int dim, round(w / sum(w) over (partition by vec_id), 6) w from e",
    "theta_beta_product": _LONG + " select vec_id, c.label, round(sum(l.w * c.w), 6) w from l join c using (dim) group by 1, 2",
    "centroid_distances": _LONG + " select a.label a, b.label b, round(sum((a.w - b.w) * (a.w - b.w)), 6) d2 from c a join c b on a.dim = b.dim and a.label < b.label group by 1, 2",
    "purity_nmi": """with c as (select topic t, source p, count(*) n from documents where topic is not null and source is not null group by 1, 2),
x as (select *, sum(n) over (partition by t) nt, sum(n) over (partition by p) np, max(n) over (partition by p) best, sum(n) over () a from c),
s as (select sum(n)::bigint n, (select sum(m) from (select max(n) m from c group by p)) / max(a) purity, sum(n / a * ln(n * a / (nt * np))) i, -sum(n / a * ln(nt / a)) ht, -sum(n / a * ln(np / a)) hp from x)
select n, round(purity, 6) purity, round(2 * i / (ht + hp), 6) nmi from s""",
    "acc_macro_f1": """with d as (select source, lang, topic from documents where topic is not null and source is not null and lang is not null),
g as (select source, lang, first(topic order by n desc, topic) g from (select source, lang, topic, count(*) n from d group by 1, 2, 3) group by 1, 2), r as (select topic, g from d join g using (source, lang)),
k as (select topic c from r union select g from r), f as (select c, 2 * (select count(*) from r where topic = c and g = c) / ((select count(*) from r where topic = c) + (select count(*) from r where g = c)) f from k)
select (select count(*) from r) n, round((select count(*) from r where topic = g) / (select count(*) from r), 6) accuracy, round(avg(f), 6) macro_f1 from f""",
    "hierarchy_edges": _HIER + " select parent, child from links",
    "pcc": _HIER + ", x as (select parent, child from links)" + _CROSS.replace("@up", "up") + " select * from result",
    "pcd": _HIER + ", x as (select parent, child from links)" + _DIFF + " select parent, child, round(diversity, 6) diversity from f",
    "pncd": _HIER + ", x as (select p.parent, c.child from (select distinct parent from phi) p, (select distinct child from phi) c where not exists (select 1 from links l where l.parent = p.parent and l.child = c.child))" + _DIFF + " select round(avg(diversity), 6) pncd from f",
    "sibling_td": _HIER + ", g as (select parent, word, count(*) n from links join low on low.topic = child group by 1, 2) select parent, round(count(*) filter (n = 1) / sum(n), 6) diversity from g group by 1",
    "sibling_npmi": _HIER + ", x as (select distinct a.child parent, b.child from links a join links b on a.parent = b.parent and a.child < b.child)" + _CROSS.replace("@up", "low") + " select parent a, child b, coherence from result",
}
