"""Queries that compare topics, runs, slices and languages, parse stored replies, and put metrics together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import queries_corpus as qc
from corpusloom import queries_metrics as qm
from corpusloom.functions import jsontext, numbers, text
from corpusloom.operators import coherence as co
from corpusloom.operators import languages, match, pipeline, sampling, vocabulary
from corpusloom.operators import theta as th
from corpusloom.plans.durable import durable
from corpusloom.plans.order import in_order
from corpusloom.sources import corpora
from corpusloom.sources.tables import table

R = qm.R


def topic_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = co.shared_words(qm._topic_words(spark, d), ["result_id"], "topic_id")
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    return pairs.select("result_id", "a", "b", "shared", F.round(F.col("shared") / union, 6).alias("jaccard"), F.round(F.col("shared") / F.least("size_a", "size_b"), 6).alias("overlap"))


def npmi_compare(spark: SparkSession, d: str) -> DataFrame:
    """Word pairs within reach of each other against word pairs anywhere in a text."""
    improved = qm.window_npmi(spark, d).agg(F.avg("npmi").alias("improved"))
    original = qm.doc_npmi(spark, d).agg(F.avg("npmi").alias("original"))
    return improved.crossJoin(original).select(*R("improved", "original"), F.round(F.col("improved") - F.col("original"), 6).alias("improvement"))


def _months(spark, d):
    rows = table(spark, d, "nyt_sampled").filter("text is not null")
    return rows.select("row_id", F.date_format("loaded_at", "yyyy-MM").alias("time_slice"), text.words(F.col("text")).alias("ws"))


def slice_coherence(spark: SparkSession, d: str) -> DataFrame:
    return co.slice_npmi(_months(spark, d), "row_id", "ws", "time_slice", qm._ntm(spark, d), "topic_id").select("time_slice", "topic_id", "pairs", *R("npmi"))


def mean_slice_coherence(spark: SparkSession, d: str) -> DataFrame:
    per = co.slice_npmi(_months(spark, d), "row_id", "ws", "time_slice", qm._ntm(spark, d), "topic_id").groupBy("time_slice").agg(F.avg("npmi").alias("npmi"))
    return per.agg(F.count("*").alias("slices"), F.round(F.avg("npmi"), 6).alias("npmi"))


def absent_words(spark: SparkSession, d: str) -> DataFrame:
    terms = _months(spark, d).select("time_slice", F.explode("ws").alias("term")).distinct()
    return co.absent_topic_words(qm._ntm(spark, d), terms, "time_slice")


def evaluate_all(spark: SparkSession, d: str) -> DataFrame:
    """Diversity and document coherence of the topics at once."""
    words = qm._ntm(spark, d)
    diversity = co.topic_diversity(words.withColumn("all", F.lit(1)), ["all"]).select("diversity", "n_words")
    return diversity.crossJoin(qm.doc_npmi(spark, d).agg(F.avg("npmi").alias("npmi"))).select(*R("diversity", "npmi"), "n_words")


def theta_top_words(spark: SparkSession, d: str) -> DataFrame:
    words = qm._ntm(spark, d).groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("words"))
    return qm.theta_argmax(spark, d).join(words, "topic_id", "left").select("vec_id", "topic_id", "words")


def layer_means(spark: SparkSession, d: str) -> DataFrame:
    """Clustering scores of two layers of groups against the topics, and their mean."""
    rows = table(spark, d, "documents").filter("topic is not null")
    layers = [th.purity_nmi(rows.filter(F.col(c).isNotNull()), "topic", c).select(F.lit(i).alias("layer"), "purity", "nmi") for i, c in enumerate(("source", "lang"))]
    return layers[0].unionByName(layers[1]).agg(F.count("*").alias("layers"), F.round(F.avg("purity"), 6).alias("purity"), F.round(F.avg("nmi"), 6).alias("nmi"))


def report_order(spark: SparkSession, d: str) -> DataFrame:
    """Cited articles in the order of a report: by number, those without one as 999."""
    ids = table(spark, d, "assignment_decisions").filter("article_id is not null").select("article_id").distinct()
    keyed = ids.withColumn("number", F.when(F.col("article_id").rlike("^[0-9]{1,18}$"), F.col("article_id").cast("bigint")).otherwise(F.lit(999).cast("bigint")))
    return in_order(keyed, ["number", "article_id"]).select("article_id", "number", F.col("position").alias("at"))


def example_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first ten topics of a run, each with its first five keywords."""
    first = table(spark, d, "topics").filter("topic_num <= 10").select("result_id", F.struct("topic_num", F.concat_ws("|", F.slice("keywords", 1, 5)).alias("k")).alias("x"))
    return first.groupBy("result_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["k"]), ";").alias("examples"))


def evaluable_topics(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty topics of a run that have keywords: what a judge is asked about."""
    return table(spark, d, "topics").filter((F.col("topic_num") <= 20) & (F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0)).select("topic_id", "result_id", "topic_num")


def runs_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every dataset with every model: runs made, and whether the pair was left out."""
    runs = table(spark, d, "topic_results")
    asked = runs.select("dataset").distinct().crossJoin(F.broadcast(table(spark, d, "model_limits").select("model")))
    made = runs.groupBy("dataset", "model").agg(F.count("*").alias("runs"), F.sum(F.when(F.col("retry_count") == 0, 1).otherwise(0)).alias("clean"))
    out = asked.join(made, ["dataset", "model"], "left").fillna(0, ["runs", "clean"])
    return out.withColumn("status", F.when(F.col("runs") == 0, "skipped").when(F.col("clean") > 0, "done").otherwise("retried"))


def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Cost of all models: sum, share of calls with a price, and mean per run."""
    per = qc.llm_cost(spark, d)
    runs = table(spark, d, "topic_results").groupBy("model").agg(F.count("*").alias("runs"))
    return per.join(runs, "model").agg(
        F.sum("calls").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.sum(F.when(F.col("cost") > 0, F.col("calls")).otherwise(0)) / F.sum("calls"), 6).alias("priced_share"), F.round(F.sum("cost") / F.sum("runs"), 4).alias("cost_per_run")
    )


def position_bands(spark: SparkSession, d: str) -> DataFrame:
    f, m, b = (F.col(f"{s}_share") for s in ("front", "middle", "back"))
    return qm.position_bias(spark, d).select(numbers.side_bias(f, m).alias("front"), numbers.neglect_band(m, f).alias("middle"), numbers.side_bias(b, m).alias("back"), numbers.balance_band(F.col("balance")).alias("overall"))


def capacity_bands(spark: SparkSession, d: str) -> DataFrame:
    """Topics made by a model against the estimate that its stored reply names."""
    stats = qm.attempt_stats(spark, d)
    runs = table(spark, d, "topic_results").groupBy("model").agg(F.count("*").alias("runs"))
    n = F.col("runs") * 2 + 1
    reply = F.when(F.col("runs") % 2 == 0, F.concat(F.lit('Sure: {"estimated_topics": '), n.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("About "), n.cast("string"), F.lit(" topics can be told apart.")))
    told = runs.select("model", jsontext.topic_estimate_reply(reply).alias("estimate"))
    share = numbers.ratio(F.col("average"), F.col("estimate"))
    return stats.join(told, "model").select("model", "estimate", F.round(share, 6).alias("share"), numbers.estimate_band(share).alias("band"))


def _topic_json(spark, d):
    """Topics as replies hold them, each in another dress by its number."""
    t = table(spark, d, "topics")
    kw = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: F.coalesce(w, F.lit("")))
    inner = F.to_json(F.struct(F.coalesce("summary", F.lit("")).alias("Summary"), kw.alias("Keywords")))
    return t.select("topic_id", "topic_num", "summary", F.concat(F.lit('[{"Topic '), F.col("topic_num").cast("string"), F.lit('": '), inner, F.lit("}]")).alias("plain"), F.array_join(kw, "|").alias("k"))


def _stored(spark, d):
    """(topic_id, t): replies parsed: plain, fenced, after thoughts, with a comma too many, and cut off behind the first topic."""
    p = F.col("plain")
    body = F.expr("left(plain, length(plain) - 1)")
    dressed = (
        F.when(F.col("topic_id") % 5 == 0, p).when(F.col("topic_id") % 5 == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nDone.")))
        .when(F.col("topic_id") % 5 == 2, F.concat(F.lit("<think>Let me [see]</think>"), p)).when(F.col("topic_id") % 5 == 3, F.concat(body, F.lit(",]")))
        .otherwise(F.concat(body, F.lit(', {"Topic 99": {"Summary": "Ra')))
    )
    return _topic_json(spark, d).select("topic_id", F.explode(jsontext.parse_topics(dressed)).alias("t"))


def stored_topics(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select("topic_id", "t.topic_num", F.col("t.summary").alias("summary"), F.array_join("t.keywords", "|").alias("keywords"))


def topic_summaries(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics").filter("summary is not null")
    flat = F.to_json(F.struct(F.when(F.col("topic_id") % 4 == 0, F.col("topic_num")).alias("topic_num"), F.col("summary")))
    name = F.concat(F.lit("Topic "), F.col("topic_num").cast("string"))
    nested = F.to_json(F.create_map(name, F.struct(F.col("summary").alias("Summary"))))
    out = t.select("topic_id", jsontext.topic_summary(F.when(F.col("topic_id") % 2 == 0, flat).otherwise(nested), F.col("topic_num")).alias("t"))
    return out.filter("t is not null").select("topic_id", "t.id", "t.summary")


def hierarchy_replies(spark: SparkSession, d: str) -> DataFrame:
    """Secondary and tertiary topics from stored replies; the work of a resumed run is what has none yet."""
    rows = table(spark, d, "nyt_sampled").filter("topic is not null")
    obj = F.to_json(F.struct(F.array("topic").alias("secondary_topics"), F.array(F.coalesce("title", F.lit("")), F.lit("x")).alias("tertiary_topics")))
    reply = (
        F.when(F.col("row_id") % 4 == 0, obj).when(F.col("row_id") % 4 == 1, F.concat(F.lit("Sure.\n```json\n"), obj, F.lit("\n```")))
        .when(F.col("row_id") % 4 == 2, F.concat(F.lit("The answer is "), obj, F.lit(" as asked"))).otherwise(F.lit("I cannot help"))
    )
    out = rows.select("row_id", jsontext.hierarchy_topics(reply).alias("h"))
    return out.select("row_id", F.array_join("h.secondary", "|").alias("secondary"), F.array_join("h.tertiary", "|").alias("tertiary"))


def diversity_replies(spark: SparkSession, d: str) -> DataFrame:
    """Per model the judged pairs as stored replies of a few thousand pairs each, parsed, with rates and bands."""
    pairs = table(spark, d, "topic_diversity_results").filter("topic1_id <> topic2_id")
    name = F.concat_ws("-", "topic1_id", "topic2_id")
    listed = lambda k: F.collect_list(F.when(F.col("pair_list") == k, name))
    topics = pairs.groupBy("model").agg(F.count_distinct("topic1_id").alias("n_topics"))
    part = F.shiftright(F.monotonically_increasing_id(), 12)  # 4096 rows of one partition; which they are makes no difference to the sums
    stored = pairs.withColumn("part", part).groupBy("model", "part").agg(listed("redundant_pairs").alias("redundant_pairs"), listed("partial_overlap_pairs").alias("partial_overlap_pairs"))
    per = stored.join(topics.withColumnRenamed("model", "m"), F.col("model").eqNullSafe(F.col("m")))
    unique = F.when(F.col("n_topics") % 2 == 0, F.col("n_topics") - 1)
    reply = F.concat(F.lit("Result: "), F.to_json(F.struct("redundant_pairs", "partial_overlap_pairs", unique.alias("unique_topics_count"), F.when(F.col("n_topics") % 2 == 0, F.lit(0.55)).alias("diversity_score"))))
    parsed = per.select("model", "n_topics", jsontext.diversity_reply(reply, F.col("n_topics")).alias("e")).select("model", "n_topics", "e.*")
    sums = [F.sum(c).cast("int").alias(c) for c in ("redundant", "overlap")]
    e = parsed.groupBy("model", "n_topics").agg(*sums, *[F.max(c).alias(c) for c in ("unique_topics", "diversity")])
    redundancy, possible = F.round(F.col("redundant") / F.col("n_topics"), 4), F.col("n_topics") * (F.col("n_topics") - 1) / 2
    out = e.withColumns({"redundancy": redundancy, "overlap_rate": F.round(numbers.ratio(F.col("overlap"), possible), 6), "compression": F.round(F.col("unique_topics") / F.col("n_topics"), 4)})
    bands = numbers.diversity_bands(F.col("diversity"), F.col("redundancy"), F.col("n_topics") - F.col("unique_topics"))
    return out.select("model", F.col("n_topics").cast("int").alias("n_topics"), "redundant", "overlap", "unique_topics", "diversity", "redundancy", "overlap_rate", "compression", *[c.alias(k) for k, c in bands.items()])


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    sized = per.select("source", (F.col("n") * 3).alias("n_train"), F.col("n").alias("n_test"))
    return sized.select("source", numbers.split_sizes(F.col("n_train"), F.col("n_test"), F.lit(40), 0.2).alias("s")).select("source", "s.train", "s.test")


def split_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels and tokens of both splits together: every label once, with its rows in each split."""
    docs = sampling.train_test(table(spark, d, "nyt_sampled").select("row_id", "topic"), "row_id", 0.2)
    count = lambda s: F.sum(F.when(F.col("split") == s, 1).otherwise(0))
    return docs.filter("topic is not null").groupBy("topic").agg(count("train").alias("n_train"), count("test").alias("n_test"))


def split_vocab(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of both splits, by documents of both, with occurrences in each."""
    docs = sampling.train_test(vocabulary.long_enough(qc._tokenized(spark, d), "tokens", 5), "row_id", 0.2)
    vocab = qc._vocab(docs)
    bow = vocabulary.bag_of_words(docs, "row_id", "tokens", vocab).join(docs.select("row_id", "split"), "row_id")
    per = bow.groupBy("term_id").agg(*[F.sum(F.when(F.col("split") == s, F.col("cnt")).otherwise(0)).alias(s) for s in ("train", "test")])
    return vocab.select("term_id", "term").join(per, "term_id")


def _corpus(spark, d):
    rows = sampling.train_test(table(spark, d, "nyt_sampled"), "row_id", 0.2)
    return corpora.preprocess(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "row_id", "text", "topic", min_df=3, max_df=0.5, min_terms=5)


def corpus_bow(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).bow.withColumnRenamed("key", "row_id")


def corpus_docs(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).docs.select("split", F.col("key").alias("row_id"), "label_id", "tokens", F.md5("text").alias("text"))


#: A small dictionary of English and German words for the queries of two languages.
DICTIONARY = [("school", "schule"), ("market", "markt"), ("hospital", "krankenhaus"), ("bridge", "brücke"), ("court", "gericht"), ("harbour", "hafen"), ("mill", "mühle"), ("theatre", "theater"), ("museum", "museum"), ("harvest", "ernte"), ("report", "bericht"), ("city", "stadt"), ("valley", "tal"), ("days", "tage"), ("days", "tagen")]


def _language_terms(spark, d, lang):
    docs = table(spark, d, "documents").filter(F.col("lang") == lang).filter("text is not null").select("doc_id", text.words(F.col("text")).alias("ws"))
    return vocabulary.document_frequency(docs, "doc_id", "ws").filter("df >= 3")


def translation_map(spark: SparkSession, d: str) -> DataFrame:
    dictionary = spark.createDataFrame(DICTIONARY, "en string, de string")
    en, de = _language_terms(spark, d, "en"), _language_terms(spark, d, "de")
    pairs = languages.translations(dictionary, "en", "de", en, de)
    return languages.carried_over(pairs, en, de.count()).select("term_a", "term_b", F.round("w", 9).alias("w"), F.round("rest", 9).alias("rest"))


def language_zip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.zipped_round(docs.filter("lang = 'en'").select("doc_id"), docs.filter("lang = 'de'").select("doc_id"), "doc_id")


def slice_gather(spark: SparkSession, d: str) -> DataFrame:
    """Per document, how its words are used in its time slice: the mean count there of each of its terms, summed."""
    docs = durable(qc._tokenized(spark, d))
    bow = vocabulary.bag_of_words(docs, "row_id", "tokens", qc._vocab(docs))
    slices = table(spark, d, "nyt_sampled").filter("text is not null").select("row_id", F.date_format("loaded_at", "yyyy-MM").alias("time_slice"))
    freq = vocabulary.slice_frequency(bow, "row_id", slices)
    return bow.join(slices, "row_id").join(freq, ["time_slice", "term_id"]).groupBy("row_id").agg(F.round(F.sum("mean_cnt"), 6).alias("use"))


def prepared_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What every model is shown of the articles: the rows drawn for its context, and those of them that fit."""
    lines = durable(pipeline.sized_lines(table(spark, d, "nyt_sampled"), "row_id"))
    out = None
    for r in table(spark, d, "model_limits").select("model", "total_context").collect():  # one row per model
        limit = pipeline.token_limit(r.total_context)
        one = pipeline.prepared_input(lines, limit).agg(F.count("*").alias("shown"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(F.lit(r.model).alias("model"), F.lit(limit).cast("bigint").alias("token_limit"), F.lit(pipeline.rows_that_fit(lines, limit)).cast("bigint").alias("drawn"), "shown", "tokens")
        out = one if out is None else out.unionByName(one)
    return out


def stored_analysis(spark: SparkSession, d: str) -> DataFrame:
    """A whole analysis from stored replies: parsed topics, their keyword flags, and what matching adds to each run."""
    listed = F.filter("t.keywords", lambda w: F.trim(w) != "")
    topics = durable(_stored(spark, d).select("topic_id", listed.alias("keywords")))
    kept = match.adaptive_cut(match.keyword_match(table(spark, d, "nyt_sampled"), topics), topics)
    found = kept.groupBy("topic_id").agg(F.count("*").alias("matches"), F.max("match_score").alias("best"))
    flags = topics.select("topic_id", F.size("keywords").between(5, 12).alias("meets"))
    runs = table(spark, d, "topics").select("topic_id", "result_id")
    one = runs.join(flags, "topic_id").join(found, "topic_id", "left").fillna(0, ["matches"])
    return one.groupBy("result_id").agg(F.count("*").alias("topics"), F.sum(F.when(F.col("meets"), 1).otherwise(0)).alias("meeting"), F.sum("matches").alias("matches"), F.max("best").alias("best"))


def hierarchy_quality(spark: SparkSession, d: str) -> DataFrame:
    """The four scores of a hierarchy in one row."""
    mean = lambda df, c, name: df.agg(F.round(F.avg(c), 4).alias(name))
    out = mean(qm.pcc(spark, d), "coherence", "pcc")
    for df in (mean(qm.pcd(spark, d), "diversity", "pcd"), mean(qm.sibling_td(spark, d), "diversity", "sibling_td"), qm.pncd(spark, d).select(F.round("pncd", 4).alias("pncd"))):
        out = out.crossJoin(df)
    return out


def score_advice(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "topic_diversity_results").filter("similarity_score is not null and not isnan(similarity_score)")
    score = F.when(F.col("similarity_score") > 1, F.col("similarity_score") / 100).otherwise(F.col("similarity_score")) * 4 + 1
    per = judged.groupBy("model").agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    return per.select("model", "n", F.round("mean", 6).alias("mean"), numbers.advice(F.col("mean")).alias("advice"))


def _metrics() -> dict:
    return {
        "distribution": (topicmetrics_of("topic_distribution"), "cv"), "priority": (topicmetrics_of("high_freq_priority"), "priority"), "position": (topicmetrics_of("position_bias"), "balance"),
        "relevance": (topicmetrics_of("relevance_summary"), "mean"), "capacity": (topicmetrics_of("attempt_stats"), "average"), "diversity": (topicmetrics_of("judged_diversity"), "redundancy"),
    }


def topicmetrics_of(name: str):
    return getattr(qm, name)


def metric_report(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of the suite on the same tables, one row each with the mean of its headline number."""
    from corpusloom.operators import runner

    return runner.run_metrics(spark, d, _metrics()).select("metric", "status", "rows", F.round("value", 4).alias("value"))


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import runner

    return runner.summary(runner.run_metrics(spark, d, _metrics())).select("metrics", "succeeded", F.round("success_rate", 6).alias("success_rate"))


QUERIES = {f.__name__: f for f in (
    topic_pairs, npmi_compare, slice_coherence, mean_slice_coherence, absent_words, evaluate_all, theta_top_words, layer_means, report_order, example_lists, evaluable_topics, runs_matrix, cost_rollup,
    position_bands, capacity_bands, stored_topics, topic_summaries, hierarchy_replies, diversity_replies, split_sizes, split_labels, split_vocab, corpus_bow, corpus_docs, translation_map, language_zip, slice_gather,
    prepared_inputs, stored_analysis, hierarchy_quality, score_advice, metric_report, metric_summary,
)}

_O, _C = qm.ORACLE, qc.ORACLE
_KW = "list_transform(coalesce(keywords, []), lambda w: coalesce(w, ''))"
_MONTHS = f"months as (select row_id, strftime(loaded_at, '%Y-%m') time_slice, regexp_extract_all(lower(text), '{qm.W}') ws from nyt_sampled where text is not null)"
_SLICED = qm._NTM + f""", {_MONTHS}, held as (select distinct time_slice, row_id, word from (select time_slice, row_id, unnest(ws) word from months) where word in (select word from words)),
single as (select time_slice, word, count(*) n from held group by 1, 2),
both_ as (select a.time_slice, a.word w1, b.word w2, count(*) n12 from held a join held b using (time_slice, row_id) where a.word <> b.word group by 1, 2, 3),
sizes as (select time_slice, count(*) n from months group by 1),
counted as (select p.*, b.time_slice, n12, s1.n n1, s2.n n2, z.n n from pairs p join both_ b using (w1, w2) join single s1 on s1.word = w1 and s1.time_slice = b.time_slice
  join single s2 on s2.word = w2 and s2.time_slice = b.time_slice join sizes z on z.time_slice = b.time_slice),
scored as (select time_slice, topic_id, count(*) pairs, avg({qm._NPMI}) npmi from counted group by 1, 2)"""
_LANG = """with v as (select lang, term, count(distinct doc_id) df, count(*) cf from (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term from documents where lang in ('en', 'de') and text is not null) group by 1, 2 having count(distinct doc_id) >= 3),
d(en, de) as (values """ + ", ".join(f"('{a}', '{b}')" for a, b in DICTIONARY) + ")"
_SPLIT = "case when ('0x' || left(md5(row_id || '|42'), 8))::bigint / 4294967296.0 < 0.2 then 'test' else 'train' end"
_RUNS = _O["attempt_stats"]
_STATS = {"distribution": ("topic_distribution", "cv"), "priority": ("high_freq_priority", "priority"), "position": ("position_bias", "balance"), "relevance": ("relevance_summary", "mean"), "capacity": ("attempt_stats", "average"), "diversity": ("judged_diversity", "redundancy")}
_REPORT = " union all ".join(f"select '{m}' metric, 'ok' status, count(*) \"rows\", round(avg({c}), 4) \"value\" from ({_O[q]})" for m, (q, c) in _STATS.items())

ORACLE = {
    "topic_pairs": qm._TOPW + """, s as (select result_id, topic_id, list(distinct word) ws from w group by 1, 2),
p as (select x.result_id, x.topic_id a, y.topic_id b, len(list_intersect(x.ws, y.ws)) shared, len(x.ws) na, len(y.ws) nb from s x join s y on x.result_id = y.result_id and x.topic_id < y.topic_id)
select result_id, a, b, shared, round(shared / (na + nb - shared), 6) jaccard, round(shared / least(na, nb), 6) overlap from p where shared > 0""",
    "npmi_compare": f"select round(i, 6) improved, round(o, 6) original, round(i - o, 6) improvement from (select avg(npmi) i from ({_O['window_npmi']})), (select avg(npmi) o from ({_O['doc_npmi']}))",
    "slice_coherence": _SLICED + " select time_slice, topic_id, pairs, round(npmi, 6) npmi from scored",
    "mean_slice_coherence": _SLICED + " select count(*) slices, round(avg(v), 6) npmi from (select avg(npmi) v from scored group by time_slice)",
    "absent_words": qm._NTM + f", {_MONTHS}, held as (select distinct time_slice, unnest(ws) word from months) select time_slice, word from (select distinct time_slice from held), words except select time_slice, word from held",
    "evaluate_all": f"select round(diversity, 6) diversity, round(npmi, 6) npmi, n_words from ({qm._NTM} select count(distinct word) / count(*) diversity, count(*) n_words from tw), (select avg(npmi) npmi from ({_O['doc_npmi']}))",
    "theta_top_words": f"select vec_id, topic_id, words from ({_O['theta_argmax']}) left join ({qm._NTM} select topic_id, string_agg(word, ' ' order by pos) words from tw group by 1) using (topic_id)",
    "layer_means": "select count(*) layers, round(avg(purity), 6) purity, round(avg(nmi), 6) nmi from (" + " union all ".join(
        "(" + _O["purity_nmi"].replace("topic is not null and source is not null", f"topic is not null and {c} is not null").replace("source p", f"{c} p").replace("round(purity, 6)", "purity").replace("round(2 * i / (ht + hp), 6)", "2 * i / (ht + hp)") + ")" for c in ("source", "lang")) + ")",
    "report_order": """with k as (select distinct article_id, case when regexp_full_match(article_id, '[0-9]{1,18}') then article_id::bigint else 999 end number from assignment_decisions where article_id is not null)
select article_id, number, row_number() over (order by number, article_id) - 1 "at" from k""",
    "example_lists": "select result_id, string_agg(array_to_string(list_filter(coalesce(keywords[1:5], []), lambda w: w is not null), '|'), ';' order by topic_num) examples from topics where topic_num <= 10 group by 1",
    "evaluable_topics": "select topic_id, result_id, topic_num from topics where topic_num <= 20 and len(keywords) > 0",
    "runs_matrix": """with a as (select * from (select distinct dataset from topic_results), (select model from model_limits)),
m as (select dataset, model, count(*) runs, count(*) filter (retry_count = 0) clean from topic_results group by 1, 2)
select dataset, model, coalesce(runs, 0) runs, coalesce(clean, 0) clean, case when coalesce(runs, 0) = 0 then 'skipped' when clean > 0 then 'done' else 'retried' end status from a left join m using (dataset, model)""",
    "cost_rollup": f"select sum(calls)::bigint calls, round(sum(cost), 4) cost, round(sum(case when cost > 0 then calls else 0 end) / sum(calls), 6) priced_share, round(sum(cost) / sum(runs), 4) cost_per_run from ({_C['llm_cost']}) join (select model, count(*) runs from topic_results group by 1) using (model)",
    "position_bands": f"""with p as ({_O['position_bias']}) select case when front_share > middle_share * 1.5 then 'high' when front_share > middle_share then 'medium' else 'low' end front,
case when middle_share < front_share * 0.5 then 'severe' when middle_share < front_share * 0.8 then 'medium' else 'slight' end middle, case when back_share > middle_share * 1.5 then 'high' when back_share > middle_share then 'medium' else 'low' end back,
case when balance < 0.1 then 'balanced' when balance < 0.2 then 'slight preference' else 'clear preference' end overall from p""",
    "capacity_bands": f"""with s as (select model, average from ({_RUNS})), e as (select model, (count(*) * 2 + 1)::int estimate from topic_results group by 1), j as (select model, estimate, average / estimate share from s join e using (model))
select model, estimate, round(share, 6) share, case when share between 0.8 and 1.2 then 'accurate' when share < 0.8 then 'overestimated' else 'underestimated' end band from j""",
    "stored_topics": f"select topic_id, 1 topic_num, coalesce(summary, '') summary, array_to_string({_KW}, '|') keywords from topics",
    "topic_summaries": "select topic_id, case when topic_id % 4 = 0 then topic_num::varchar when topic_id % 2 = 0 then 'T' || topic_num else 'Topic ' || topic_num end id, trim(summary, ' ') summary from topics where trim(summary, ' ') <> ''",
    "hierarchy_replies": "select row_id, case when row_id % 4 = 3 then '' else topic end secondary, case when row_id % 4 = 3 then '' else coalesce(title, '') || '|x' end tertiary from nyt_sampled where topic is not null",
    "diversity_replies": """with g as (select model, count(distinct topic1_id) n_topics, count(*) filter (pair_list = 'redundant_pairs') redundant, count(*) filter (pair_list = 'partial_overlap_pairs') overlap from topic_diversity_results where topic1_id <> topic2_id group by 1),
e as (select *, case when n_topics % 2 = 0 then n_topics - 1 else n_topics end unique_topics, case when n_topics % 2 = 0 then 0.55 else 0.8 end::double diversity, round(redundant / n_topics, 4) redundancy from g)
select model, n_topics::int n_topics, redundant::int redundant, overlap::int overlap, unique_topics, diversity, redundancy, round(case when n_topics > 1 then overlap / (n_topics * (n_topics - 1) / 2) else 0 end, 6) overlap_rate, round(unique_topics / n_topics, 4) compression,
case when diversity >= 0.8 then 'excellent' when diversity >= 0.6 then 'good' when diversity >= 0.4 then 'fair' else 'poor' end quality, case when redundancy <= 0.1 then 'slight' when redundancy <= 0.3 then 'medium' else 'severe' end redundancy_band,
case when n_topics - unique_topics <= 5 then 'low' when n_topics - unique_topics <= 15 then 'medium' else 'high' end compression_band,
case when diversity >= 0.7 and redundancy <= 0.2 then 'excellent' when diversity >= 0.5 and redundancy <= 0.4 then 'good' else 'to improve' end overall from e""",
    "split_sizes": """with n as (select source, count(*) * 3 tr, count(*) te from documents group by 1), s as (select *, least(te, 40) a, floor(least(te, 40) / 0.2::double * 0.8::double + 1e-9) b from n)
select source, (case when b > tr then tr else b end)::bigint train, (case when b > tr then floor(tr / 0.8::double * 0.2::double + 1e-9) else a end)::bigint test from s""",
    "split_labels": f"select topic, count(*) filter (s = 'train') n_train, count(*) filter (s = 'test') n_test from (select topic, {_SPLIT} s from nyt_sampled where topic is not null) group by 1",
    "split_vocab": qc._B + f", p as (select term_id, sum(case when s = 'train' then cnt else 0 end)::bigint train, sum(case when s = 'test' then cnt else 0 end)::bigint test from (select *, {_SPLIT} s from bow) group by 1) select term_id, term, train, test from vocab join p using (term_id)",
    "corpus_bow": qc._B + f" select {_SPLIT} split, row_id, term_id, cnt from bow",
    "corpus_docs": qc._B + f""", l as (select row_id, dense_rank() over (order by topic) - 1 label_id from nyt_sampled join used using (row_id) where topic is not null),
t as (select row_id, string_agg(term, ' ' order by pos) t from (select row_id, unnest(toks) term, generate_subscripts(toks, 1) pos from used) join vocab using (term) group by 1)
select {_SPLIT} split, row_id, label_id, len(toks)::int tokens, md5(coalesce(t, '')) "text" from used left join l using (row_id) left join t using (row_id)""",
    "translation_map": _LANG + """, p as (select en, de, e.cf from d join v e on e.lang = 'en' and e.term = en join v g on g.lang = 'de' and g.term = de), n as (select count(*) n from v where lang = 'de'),
w as (select en, sum(cf) + max(n) whole from p, n group by 1) select en term_a, de term_b, round((cf + 1) / whole, 9) w, round(1 / whole, 9) rest from p join w using (en)""",
    "language_zip": """with e as (select doc_id, row_number() over (order by doc_id) - 1 p, count(*) over () n from documents where lang = 'en'), g as (select doc_id, row_number() over (order by doc_id) - 1 p, count(*) over () n from documents where lang = 'de'),
s as (select unnest(range((select greatest(max(e.n), max(g.n)) from e, g))) i) select i "at", e.doc_id a, g.doc_id b from s join e on e.p = i % e.n join g on g.p = i % g.n""",
    "slice_gather": qc._V + """, u as (select row_id, strftime(loaded_at, '%Y-%m') ts from used), n as (select ts, count(*) n from u group by 1),
f as (select ts, term_id, sum(cnt) / max(n) m from bow join u using (row_id) join n using (ts) group by 1, 2) select row_id, round(sum(m), 6) "use" from bow join u using (row_id) join f using (ts, term_id) group by 1""",
    "prepared_inputs": f"""with l as (select row_id, case when regexp_full_match(id, '[0-9]{{1,18}}') then id::bigint else 0 end num, floor(length({qc._LINE_SQL}) / 3.5)::bigint tokens,
  row_number() over (order by md5(row_id || '|42'), row_id) r from nyt_sampled where trim(id, ' ') <> '' and trim(title, ' ') <> '' and trim(text, ' ') <> ''),
a as (select avg(tokens) a from l where r <= 100), b as (select model, floor(greatest(total_context, 32768) * 0.75)::bigint token_limit from model_limits),
s as (select model, token_limit, floor(token_limit / a)::bigint drawn from b, a),
p as (select model, token_limit, drawn, tokens, sum(tokens) over (partition by model order by num, row_id rows unbounded preceding) running from s left join l on l.r <= drawn)
select model, token_limit, drawn, count(*) filter (running <= token_limit) shown, coalesce(sum(tokens) filter (running <= token_limit), 0)::bigint tokens from p group by 1, 2, 3""",
    "stored_analysis": "with tp as (select topic_id, list_filter(coalesce(keywords, []), lambda w: trim(coalesce(w, ''), ' ') <> '') keywords from topics)," + _C["topic_enhance"].lstrip()[4:].replace("from topics", "from tp").replace("join topics t", "join tp t").replace("\nselect topic_id, row_id, title, match_score, match_count, matched_keywords from capped", ",\nenhanced as (select topic_id, row_id, match_score from capped") + """),
m as (select topic_id, count(*) matches, max(match_score) best from enhanced group by 1)
select result_id, count(*) topics, count(*) filter (len(tp.keywords) between 5 and 12) meeting, coalesce(sum(matches), 0)::bigint matches, max(best) best from topics join tp using (topic_id) left join m using (topic_id) group by 1""",
    "hierarchy_quality": f"select round(a, 4) pcc, round(b, 4) pcd, round(c, 4) sibling_td, round(pncd, 4) pncd from (select avg(coherence) a from ({_O['pcc']})), (select avg(diversity) b from ({_O['pcd']})), (select avg(diversity) c from ({_O['sibling_td']})), ({_O['pncd']})",
    "score_advice": """with s as (select model, case when similarity_score > 1 then similarity_score / 100 else similarity_score end * 4 + 1 v from topic_diversity_results where similarity_score is not null and not isnan(similarity_score)),
g as (select model, count(*) n, avg(v) mean from s group by 1) select model, n, round(mean, 6) mean, case when mean >= 4 then 'keep' when mean >= 3 then 'refine' when mean >= 2 then 'improve weak criteria' else 'make anew' end advice from g""",
    "metric_report": _REPORT,
    "metric_summary": f"select count(*) metrics, count(*) filter (status = 'ok') succeeded, round(count(*) filter (status = 'ok') / count(*), 6) success_rate from ({_REPORT})",
}
