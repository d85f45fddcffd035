"""A whole topic analysis: articles sampled and budgeted for a model, asked about, the reply parsed, its topics matched with all articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import jsontext, text
from corpusloom.operators import chat, match, sampling
from corpusloom.plans.durable import durable
from corpusloom.plans.order import in_order

FIELDS = {"ID": "id", "Title": "title", "Text": "text", "Topic": "topic", "Date": "pub_date", "Keywords": "keywords"}


def token_limit(total_context: int, least: int = 32_768, share: float = 0.75) -> int:
    """Tokens of input that a model is given."""
    return int(max(total_context, least) * share)


def sized_lines(articles: DataFrame, key: str, fields: dict[str, str] | None = None) -> DataFrame:
    """(key, number, line, tokens) of the articles that have an id, a title and a text."""
    line = text.article_line(fields or FIELDS)
    usable = articles.filter("trim(id) <> '' and trim(title) <> '' and trim(text) <> ''")
    return usable.select(F.col(key).alias("key"), sampling.digits_or_zero(F.col("id")).alias("number"), line.alias("line"), text.estimated_tokens(line, up=False).alias("tokens"))


def rows_that_fit(lines: DataFrame, limit: int, sample: int = 100, seed: int = 42) -> int:
    """How many rows ``limit`` tokens hold, by the mean of up to ``sample`` rows drawn by hash; all rows if they have no tokens."""
    drawn = sampling.hash_sample(lines, "key", sample, seed).agg(F.avg("tokens")).first()[0]
    return int(limit / drawn) if drawn else lines.count()


def prepared_input(lines: DataFrame, limit: int, *, sample: int = 100, seed: int = 42) -> DataFrame:
    """(key, line, tokens, position): the rows a model is shown, drawn by hash, in the order of their numbers, up to the first that exceeds ``limit`` tokens."""
    drawn = sampling.hash_sample(lines, "key", rows_that_fit(lines, limit, sample, seed), seed)
    return in_order(drawn, ["number", "key"], "tokens").filter(F.col("running") <= limit).select("key", "line", "tokens", "position")


def analyze(
    articles: DataFrame, key: str, total_context: int, client: Callable[[], chat.Client], *, topics: Callable[[Column, Column], Column] | None = None, keyword_mode: bool = False, **calls
) -> tuple[DataFrame, DataFrame]:
    """(topics, matches): topics (topic_id, summary, keywords, meets) of one reply, and what keyword matching keeps of all articles.

    The prompt holds as much as the model takes. A failed call, or a reply without topics, gives no topics and no matches.
    """
    from corpusloom.functions.numbers import topic_estimate

    lines = durable(sized_lines(articles, key))
    shown = prepared_input(lines, token_limit(total_context))
    one = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.sum("tokens").alias("t"), F.count("*").alias("n"))  # no more than the model's context
    asked = (topics or (lambda t, n: topic_estimate(t, n, keyword_mode=keyword_mode)))(F.col("t"), F.col("n"))
    prompts = one.filter("n > 0").select(F.lit(1).alias("run"), chat.topics_prompt(F.col("lines"), asked).alias("prompt"))
    replies = durable(chat.call_all(prompts, "run", "prompt", client, **calls))
    found = replies.select(F.explode(jsontext.parse_topics(F.col("reply"))).alias("t")).select(F.col("t.topic_num").alias("topic_id"), "t.summary", "t.keywords")
    found = durable(found.withColumn("meets", F.size("keywords").between(5, 12)))
    return found, match.adaptive_cut(match.keyword_match(articles, found, key=key), found, key=key)


def hierarchies(articles: DataFrame, key: str, client: Callable[[], chat.Client], done: DataFrame | None = None, *, sample: int | None = None, preview: int | None = None, **calls) -> DataFrame:
    """(key, secondary, tertiary, error) of articles that ``done`` (key) does not hold yet; ``sample`` draws that many by hash."""
    todo = articles if done is None else sampling.not_done(articles, done, key)
    if sample is not None:
        todo = sampling.hash_sample(todo, key, sample)
    prompts = todo.select(key, chat.hierarchy_prompt(F.coalesce("title", F.lit("")), F.coalesce("topic", F.lit("")), F.coalesce("keywords", F.lit("")), F.coalesce("text", F.lit("")), preview).alias("prompt"))
    replies = chat.call_all(prompts, key, "prompt", client, **calls)
    return replies.select(key, jsontext.hierarchy_topics(F.col("reply")).alias("h"), "error").select(key, "h.secondary", "h.tertiary", "error")
