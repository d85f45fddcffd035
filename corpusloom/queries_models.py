"""Queries of replies, prompts and trained models."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import jsontext
from corpusloom.models import classic, neural
from corpusloom.operators import chat, sampling, theta, topicmetrics, vocabulary
from corpusloom.plans.durable import durable
from corpusloom.queries_corpus import _tokenized
from corpusloom.queries_metrics import JUDGED, judged_scores
from corpusloom.sources.tables import table
from corpusloom.streaming import live

REPLIES = [
    '[{"Topic 1": {"Summary": "Ports", "Keywords": ["harbour", "crane"], "Source Titles": ["A"]}}, {"Topic 2": {"Summary": "Rail", "Keywords": ["train"]}}]',
    'Here it is:\n```json\n[{"Topic 1": {"Summary": "Ports", "Keywords": ["harbour"]}}]\n```\nDone.',
    '[{"Topic 1": {"Summary": "Ports", "Keywords": ["harbour", "crane",],}},]',
    '<think>Let me [see]</think>[{"Topic 1": {"Summary": "Ports", "Keywords": ["harbour"]}} {"Topic 2": {"Summary": "Rail", "Keywords": ["train"]}}]',
    '[{"Topic 1": {"Summary": "Ports", "Keywords": ["harbour"]}}, {"Topic 2": {"Summary": "Ra',
    'Topics: "Summary": "Ports", "Keywords": ["harbour", "crane"] and "Summary": "Rail"',
    "I cannot help with that.",
]
_PARSED = [(0, 1, "Ports", "harbour|crane", False), (0, 2, "Rail", "train", False), (1, 1, "Ports", "harbour", False), (2, 1, "Ports", "harbour|crane", False), (3, 1, "Ports", "harbour", False), (3, 2, "Rail", "train", False), (4, 1, "Ports", "harbour", False), (5, 1, "Ports", "harbour|crane", True)]


def json_topics(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.createDataFrame(list(enumerate(REPLIES)), "reply_id int, reply string")
    return raw.select("reply_id", F.explode(jsontext.parse_topics(F.col("reply"))).alias("t")).select("reply_id", "t.topic_num", "t.summary", F.array_join("t.keywords", "|").alias("keywords"), "t.rescued")


def yes_no_replies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "assignment_decisions").select("ref_id", "llm_decision")
    reply = F.when(F.col("ref_id") % 2 == 0, F.to_json(F.struct(F.col("llm_decision").alias("answer")))).otherwise(F.col("llm_decision"))
    return rows.select("ref_id", jsontext.yes_no(reply).alias("decision"))


def rubric_averages(spark: SparkSession, d: str) -> DataFrame:
    """Scores as a judge replies with them, parsed again; a row without all of them is no complete judgement."""
    s = judged_scores(spark, d)
    one = lambda c: F.struct(F.col(c).cast("double").alias("score"))
    mean = (F.col("coherence") + F.col("conciseness") + F.col("informativity")) / 3
    reply = F.to_json(F.struct(F.struct(*[one(c).alias(c) for c in ("coherence", "conciseness", "informativity")]).alias("evaluation"), mean.alias("overall_score")))
    scored = s.select(jsontext.rubric(F.concat(F.lit("Sure: "), reply)).alias("r")).select("r.*")
    return topicmetrics.score_summary(scored, ["coherence", "conciseness", "informativity", "overall"])


def keyword_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "assignment_decisions").filter("topic_keywords is not null").select("ref_id", jsontext.keyword_list(F.col("topic_keywords"), strict_compat=True).alias("k"))
    return rows.select("ref_id", F.size("k").alias("n"), F.element_at("k", 1).alias("first")).filter("n > 0")


def assignment_judged_offline(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "assignment_decisions").select("ref_id", "topic_id", chat.relevance_prompt(F.col("text"), F.col("topic_keywords"), F.col("topic_summary")).alias("prompt"))
    replies = chat.call_all(rows, "ref_id", "prompt")
    judged = rows.select("ref_id", "topic_id").join(replies.select("ref_id", jsontext.yes_no(F.col("reply")).alias("d")), "ref_id")
    out = topicmetrics.decision_rollup(judged, "topic_id", "d")
    return out.withColumn("yes_share", F.round("yes_share", 6))


def _bow(spark, d):
    docs = durable(_tokenized(spark, d))
    vocab = durable(vocabulary.vocabulary(docs, "row_id", "tokens", min_df=3, max_df=0.5))
    return durable(vocabulary.bag_of_words(docs, "row_id", "tokens", vocab)), vocab


def _named(beta, vocab, k=8):
    top = theta.top_of(beta, "topic_id", "term_id", k).join(vocab.select("term_id", "term"), "term_id")
    return top.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("words"))


def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    bow, vocab = _bow(spark, d)
    return _named(classic.lda(bow, "row_id", vocab.count(), 12)[1], vocab)


def nmf_topics(spark: SparkSession, d: str) -> DataFrame:
    bow, vocab = _bow(spark, d)
    return _named(classic.nmf(bow, "row_id", vocab.count(), 12)[1], vocab)


def many_topics(spark: SparkSession, d: str) -> DataFrame:
    bow, vocab = _bow(spark, d)
    return _named(classic.many_topics(bow, "row_id", vocab.count(), most=40)[1], vocab)


def theta_classified(spark: SparkSession, d: str) -> DataFrame:
    """Labels of articles told from their topic weights: accuracy and mean F1 on the rows held out."""
    bow, vocab = _bow(spark, d)
    vectors = classic.nmf(bow, "row_id", vocab.count(), 20, vectors=True)[0]
    labels = vocabulary.label_ids(table(spark, d, "nyt_sampled").select("row_id", "topic"), "topic").filter("label_id is not null")
    rows = durable(sampling.train_test(vectors.join(labels, "row_id"), "row_id", 0.3))
    return theta.accuracy_f1(classic.classified(rows, "row_id", "v", "label_id", "split"), "label_id", "guess").select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def _trained(spark, d, name, topics=12, grp=None, rate=0.03, anneal=0.9, **options):
    """A trainer of the named model on the articles, and the documents it was trained on."""
    bow, vocab = _bow(spark, d)
    docs = classic.count_lists(bow, "row_id")
    if grp is not None:
        docs = docs.join(table(spark, d, "nyt_sampled").select("row_id", grp.alias("grp")), "row_id")
    docs = durable(docs)
    trainer = neural.Trainer(neural.MODELS[name](vocab.count(), topics, hidden=64, rate=rate, bits=32, **options), vocab, epochs=60, batch=64, anneal=anneal)
    return trainer, docs


def _used(trainer, docs):
    words, weights = trainer.train(docs, "row_id")
    used = theta.argmax(weights, "row_id", "topic_id").groupBy("topic_id").agg(F.count("*").alias("docs"))
    return words.join(used, "topic_id", "left").fillna(0, ["docs"]).select("topic_id", "docs", "words")


def vae_topics(spark: SparkSession, d: str) -> DataFrame:
    return _used(*_trained(spark, d, "product", rate=0.02, anneal=0.5))


def embedded_topics(spark: SparkSession, d: str) -> DataFrame:
    return _used(*_trained(spark, d, "embedded"))


def dynamic_topics(spark: SparkSession, d: str) -> DataFrame:
    """Top words of every topic in each quarter of the years."""
    quarter = ((F.month("loaded_at") - 1) / 3).cast("int")
    trainer, docs = _trained(spark, d, "dynamic", topics=8, grp=quarter, groups=4)
    trainer.train(docs, "row_id")
    out = None
    for q in range(4):
        one = trainer.get_top_words(8, q).withColumn("quarter", F.lit(q + 1))
        out = one if out is None else out.unionByName(one)
    return out


def layered_topics(spark: SparkSession, d: str) -> DataFrame:
    """Top words of two layers of topics."""
    trainer, docs = _trained(spark, d, "layered", layers=(4,), regular=1.0, temperature=2.0, anneal=0.8)
    trainer.train(docs, "row_id")
    return trainer.get_top_words(8, 0, "L-0: ").unionByName(trainer.get_top_words(8, 1, "L-1: "))


def cluster_terms(spark: SparkSession, d: str) -> DataFrame:
    return classic.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 10).groupBy("topic_id").agg(F.count("*").alias("n"))


def class_terms(spark: SparkSession, d: str) -> DataFrame:
    bow, vocab = _bow(spark, d)
    labels = vocabulary.label_ids(table(spark, d, "nyt_sampled").select("row_id", "topic"), "topic").filter("label_id is not null")
    weights = classic.class_term_weights(bow, labels.select("row_id", F.col("label_id").alias("topic_id")), "row_id")
    return weights.select("topic_id", "term_id", F.round("w", 6).alias("w"))


def transport_topics(spark: SparkSession, d: str) -> DataFrame:
    w = classic.transport_topics(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    return theta.argmax(w, "vec_id", "topic_id").groupBy("topic_id").agg(F.count("*").alias("n"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = live.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


QUERIES = {f.__name__: f for f in (json_topics, yes_no_replies, rubric_averages, keyword_lists, assignment_judged_offline, lda_topics, nmf_topics, many_topics, theta_classified, vae_topics, embedded_topics, dynamic_topics, layered_topics, cluster_terms, class_terms, transport_topics, event_windows)}

from corpusloom.queries_corpus import _V  # noqa: E402

ORACLE = {
    "json_topics": "select * from (values " + ", ".join(f"({a}, {b}, '{c}', '{e}', {str(f).lower()})" for a, b, c, e, f in _PARSED) + ") t(reply_id, topic_num, summary, keywords, rescued)",
    "yes_no_replies": """select ref_id, case when ref_id % 2 = 0 then case when lower(llm_decision) = 'yes' then 'yes' else 'no' end
when llm_decision is null then 'error' when contains(lower(llm_decision), 'yes') then 'yes' else 'no' end decision from assignment_decisions""",
    "rubric_averages": JUDGED + """, c as (select *, (coherence + conciseness + informativity) / 3 o from s where coherence is not null and conciseness is not null and informativity is not null),
l as (select unnest(['coherence', 'conciseness', 'informativity', 'overall']) score, unnest([coherence, conciseness, informativity, o]) v from c),
g as (select score, count(*) n, avg(v) mean, quantile_cont(v, 0.5) median, coalesce(stddev_samp(v), 0) std, min(v) least, max(v) most from l group by 1)
select score, n, round(mean, 6) mean, round(median, 6) median, round(std, 6) std, round(least, 6) least, round(most, 6) most, case when mean >= 4.5 then 'excellent' when mean >= 4 then 'good' when mean >= 3.5 then 'fair' when mean >= 3 then 'passing' else 'poor' end level from g""",
    "keyword_lists": """with k as (select ref_id, list_filter(list_transform(string_split(topic_keywords, ','), lambda w: trim(w, ' ')), lambda w: w <> '') k from assignment_decisions where topic_keywords is not null)
select ref_id, len(k)::int n, k[1] "first" from k where len(k) > 0""",
    "assignment_judged_offline": """with p as (select topic_id, md5('Topic: ' || coalesce(topic_summary, '') || chr(10) || 'Keywords: ' || coalesce(topic_keywords, '') || chr(10) || 'Text: ' || coalesce(text, '') || chr(10)
  || 'Is the text about the topic? Answer as {"answer": "yes"} or {"answer": "no"}.') h from assignment_decisions),
d as (select topic_id, case when h[2] in ('0', '2', '4', '6', '8', 'a', 'c', 'e') then 'yes' else 'no' end d from p),
g as (select topic_id, count(*) total, count(*) filter (d = 'yes') yes, count(*) filter (d = 'no') no, 0 error from d where topic_id is not null group by 1
  union all select null, count(*), count(*) filter (d = 'yes'), count(*) filter (d = 'no'), 0 from d) select *, round(yes / total, 6) yes_share from g""",
    "class_terms": _V + """, l as (select row_id, dense_rank() over (order by topic) - 1 topic_id from nyt_sampled where topic is not null),
p as (select topic_id, term_id, sum(cnt) n from bow join l using (row_id) group by 1, 2), m as (select avg(w) m from (select sum(n) w from p group by topic_id))
select topic_id, term_id, round(n / sum(n) over (partition by topic_id) * ln(1 + m / sum(n) over (partition by term_id)), 6) w from p, m""",
    "event_windows": "select strftime(ts, '%Y-%m-%d') start, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2",
}
