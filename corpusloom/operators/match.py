"""Topics matched with articles by their keywords, ranked, thresholded and capped."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import has_word_edged, with_edges, words

try:
    import ahocorasick
except ImportError:  # keywords then meet articles by their longest word
    ahocorasick = None


#: Characters of different keywords up to which they go to every task.
MOST_CHARS = 4_000_000


def topic_keywords(topics: DataFrame, topic: str, keywords: str, *more: str) -> DataFrame:
    """(topic, *more, pos, keyword): keywords trimmed and lower-cased, those of one character left out; repeats stay."""
    out = topics.select(topic, *more, F.posexplode(keywords).alias("pos", "keyword"))
    out = out.withColumn("keyword", F.lower(F.trim(F.regexp_replace("keyword", r"[\s\p{Z}]+", " "))))
    return out.filter(F.length("keyword") > 1)


def _automaton(keywords: list[str]):
    a = ahocorasick.Automaton()
    for k in keywords:
        a.add_word(k, k)
    a.make_automaton()
    return a


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole_words(automaton, text: str) -> set[str]:
    """The keywords that stand in ``text`` with no letter, digit or underscore next to them."""
    found, n = set(), len(text)
    for end, k in automaton.iter(text):
        start = end - len(k) + 1
        if k not in found and not (start and _inside(text[start - 1])) and not (end + 1 < n and _inside(text[end + 1])):
            found.add(k)
    return found


def _scanned(articles: DataFrame, keywords: list[str], key: str) -> DataFrame:
    """Each article is read once against all keywords."""
    shared = articles.sparkSession.sparkContext.broadcast(keywords)
    built = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "a" not in built:
            built["a"] = _automaton(shared.value)
        for b in batches:
            rows, words, titled = [], [], []
            for i, (title, both) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                found = whole_words(built["a"], both)
                if found:
                    head = whole_words(built["a"], title) if title else ()
                    for k in found:
                        rows.append(i)
                        words.append(k)
                        titled.append(k in head)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), b.column(0).take(pa.array(rows, pa.int64())), pa.array(titled, pa.bool_())], names=["keyword", "key", "in_title"])

    kind = articles.schema[key].dataType.simpleString()
    lowered = articles.select(F.col(key).alias("key"), F.lower("title").alias("title"), F.lower(F.concat_ws(" ", "title", "text")).alias("both"))
    return lowered.mapInArrow(run, f"keyword string, key {kind}, in_title boolean").withColumnRenamed("key", key)


def keyword_hits(articles: DataFrame, keywords: DataFrame, *, key: str = "row_id") -> DataFrame:
    """(keyword, ``key``, in_title) for each keyword that stands as a whole word in ``title`` or ``text``, in any case.

    Each different keyword is looked up once. Up to MOST_CHARS characters of keywords go to every task, which reads
    each article once against all of them. Beyond that, a keyword meets
    the articles that hold its longest word; the exact test then sees only those. Keywords without a letter or
    digit match nothing here.
    """
    distinct = keywords.select("keyword").distinct().withColumn("parts", words(F.col("keyword"))).filter(F.size("parts") > 0)
    if ahocorasick and (distinct.agg(F.sum(F.length("keyword"))).first()[0] or 0) <= MOST_CHARS:
        return _scanned(articles, [r.keyword for r in distinct.select("keyword").collect()], key)  # bounded by MOST_CHARS
    longest = F.element_at(F.array_sort(F.transform("parts", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    asked = distinct.select("keyword", with_edges(F.col("keyword")).alias("edged"), longest.alias("word"))
    both = F.concat_ws(" ", "title", "text")
    held = articles.select(key, F.explode(F.array_distinct(words(both))).alias("word"))
    # only articles' words that some keyword asks for go on; the texts, prepared once each, join the pairs that are left
    pairs = held.hint("merge").join(asked, "word").select(key, "keyword", "edged")
    texts = articles.select(key, with_edges(F.col("title")).alias("in_title"), with_edges(both).alias("in_both"))
    hit = lambda c: has_word_edged(F.col(c), F.col("keyword"), F.col("edged"))
    return pairs.hint("merge").join(texts, key).filter(hit("in_both")).select("keyword", key, F.coalesce(hit("in_title"), F.lit(False)).alias("in_title"))


def keyword_match(articles: DataFrame, topics: DataFrame, *, topic: str = "topic_id", key: str = "row_id") -> DataFrame:
    """(topic, key, title, match_score, match_count, matched_keywords): 2 points for a keyword in the title, 1 for one in the text.

    A keyword that a topic lists twice counts twice. Articles without title or text are left out. Of the
    articles of one title, a topic keeps the one of most points, then most keywords, then the smallest key.
    """
    usable = articles.filter((F.trim("title") != "") & (F.trim("text") != ""))
    listed = topic_keywords(topics, topic, "keywords")
    points = listed.join(keyword_hits(usable, listed, key=key), "keyword").groupBy(topic, key).agg(
        F.sum(F.when(F.col("in_title"), 2).otherwise(1)).alias("match_score"),
        F.count("*").alias("match_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword"))), lambda x: x["keyword"]), "|").alias("matched_keywords"),
    )
    titled = points.join(usable.select(key, "title"), key)
    best = Window.partitionBy(topic, "title").orderBy(F.desc("match_score"), F.desc("match_count"), key)
    return titled.withColumn("r", F.row_number().over(best)).filter("r = 1").select(topic, key, "title", "match_score", "match_count", "matched_keywords")


def adaptive_cut(matches: DataFrame, topics: DataFrame, *, topic: str = "topic_id", key: str = "row_id") -> DataFrame:
    """Matches at or above their topic's threshold, at most 15, 25 or 40 by its number of different keywords (3, 6, more).

    The threshold is the mean score, plus half the standard deviation where that exceeds 0.3 of the mean; a
    topic with one match keeps it.
    """
    by = Window.partitionBy(topic)
    mean, std, n = F.avg("match_score").over(by), F.stddev_pop("match_score").over(by), F.count("*").over(by)
    cut = F.when(n <= 1, 0.0).when(std > 0.3 * mean, mean + 0.5 * std).otherwise(mean)
    kinds = topics.select(topic, F.size(F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>")))).alias("kinds"))
    cap = F.when(F.col("kinds") <= 3, 15).when(F.col("kinds") <= 6, 25).otherwise(40)
    kept = matches.withColumn("cut", F.round(cut, 9)).filter(F.col("match_score") >= F.col("cut")).drop("cut").join(kinds, topic)
    order = by.orderBy(F.desc("match_score"), F.desc("match_count"), key)
    return kept.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap).drop("r", "kinds")


def existing_titles(assignments: DataFrame, articles: DataFrame, *, by: str) -> DataFrame:
    """Assignments whose title is one of the articles', one for each title and ``by``, the first by ref_id."""
    known = assignments.join(articles.select("title").distinct(), "title", "left_semi")
    first = Window.partitionBy(by, "title").orderBy("ref_id")
    return known.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
