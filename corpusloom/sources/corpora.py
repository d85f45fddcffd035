"""Preprocessed corpora: from two splits of texts to vocabulary, bags of words and labels, and their folder of Parquet tables.

A folder holds ``vocab`` (term_id, term), ``bow`` (split, key, term_id, cnt), ``docs`` (split, key, label_id, tokens), ``labels``
(label_id, label) and, where there are such, ``vectors`` (term_id, vector), ``times`` (key, time_slice) and ``dictionary``
(term_a, term_b). A corpus of two languages has ``lang`` in vocab, bow and docs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import STOP_WORDS, clean_text, tokens
from corpusloom.operators import vocabulary
from corpusloom.operators.sampling import hash_order
from corpusloom.plans.durable import durable

TABLES = ("vocab", "bow", "docs", "labels", "vectors", "times", "dictionary")


@dataclass
class Corpus:
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES and name in self.__dict__.get("tables", {}):
            return self.tables[name]
        raise AttributeError(name)

    def split(self, name: str) -> DataFrame:
        """Bags of words of one split."""
        return self.bow.filter(F.col("split") == name).drop("split")


def preprocess(
    train: DataFrame, test: DataFrame, key: str, text: str, label: str | None = None, *, min_df: int = 1, max_df: float = 1.0, size: int | None = None, min_terms: int = 0,
    test_size: int | None = None, test_share: float = 0.2, seed: int = 42, stop_words: list[str] = STOP_WORDS, tokenizer=None, vectors: DataFrame | None = None, lang: str | None = None,
) -> Corpus:
    """The corpus of two splits: document frequencies, vocabulary and labels come from both together.

    Documents of fewer than ``min_terms`` tokens, and null texts, are left out. ``test_size`` draws that many test documents
    by hash, and as many for training as keep ``test_share`` (``numbers.split_sizes``). ``tokenizer`` maps a text column to an array of
    tokens. ``vectors`` (term, vector) are kept for the vocabulary. A key may be in both splits.
    """
    make = tokenizer or (lambda c: tokens(clean_text(c), stop_words=stop_words))
    one = lambda df, s: df.filter(F.col(text).isNotNull()).select(
        F.lit(s).alias("split"), F.col(key).alias("key"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), make(F.col(text)).alias("tokens"))
    docs = vocabulary.long_enough(one(train, "train").unionByName(one(test, "test")), "tokens", min_terms)
    if test_size is not None:
        docs = durable(docs)
        docs = _sampled(docs, test_size, test_share, seed)
    docs = durable(docs.withColumn("doc", F.concat_ws("|", "split", F.col("key").cast("string"))))
    vocab = durable(vocabulary.vocabulary(docs, "doc", "tokens", min_df=min_df, max_df=max_df, size=size).select("term_id", "term"))
    bow = vocabulary.bag_of_words(docs.select(F.struct("split", "key").alias("k"), "tokens"), "k", "tokens", vocab).select("k.split", "k.key", "term_id", "cnt")
    known = vocabulary.label_ids(docs, "label")
    # what of a text is in the vocabulary, in its order
    kept = docs.select("split", "key", F.posexplode("tokens").alias("pos", "term")).join(vocab, "term").groupBy("split", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("text"))
    listed = known.select("split", "key", "label_id", F.size("tokens").alias("tokens")).join(kept, ["split", "key"], "left").fillna("", ["text"])
    tables = {"vocab": vocab, "bow": bow, "docs": listed, "labels": known.filter("label is not null").select("label_id", "label").distinct()}
    if vectors is not None:
        tables["vectors"] = vocab.join(vectors, "term").select("term_id", "vector")
    if lang is not None:
        tables = {n: t.withColumn("lang", F.lit(lang)) if n != "labels" else t for n, t in tables.items()}
    return Corpus(tables)


def _sampled(docs: DataFrame, test_size: int, test_share: float, seed: int) -> DataFrame:
    from corpusloom.functions.numbers import split_sizes

    n = {r.split: r.n for r in docs.groupBy("split").agg(F.count("*").alias("n")).collect()}  # a row per split
    wanted = docs.sparkSession.range(1).select(split_sizes(F.lit(n.get("train", 0)), F.lit(n.get("test", 0)), F.lit(test_size), test_share).alias("s")).first().s
    parts = [docs.filter(F.col("split") == s).orderBy(hash_order(F.col("key"), seed), "key").limit(int(wanted[s])) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


def write_corpus(corpus: Corpus, folder: str) -> None:
    for name, t in corpus.tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_corpus(spark: SparkSession, folder: str, lang: str | None = None) -> Corpus:
    """The tables that are in ``folder``; of one language if asked."""
    jvm = spark.sparkContext._jvm
    found = {}
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            t = spark.read.parquet(f"{folder}/{name}")
            found[name] = t.filter(F.col("lang") == lang) if lang is not None and "lang" in t.columns else t
    return Corpus(found)


def both_languages(a: Corpus, b: Corpus, dictionary: DataFrame | None = None) -> Corpus:
    """Two corpora made with ``lang`` as one."""
    out = {n: t.unionByName(b.tables[n]) if n != "labels" else t.unionByName(b.tables[n]).distinct() for n, t in a.tables.items() if n in b.tables}
    return Corpus(out | ({"dictionary": dictionary} if dictionary is not None else {}))


def with_times(corpus: Corpus, times: DataFrame) -> Corpus:
    """A corpus whose documents (key) have a time slice, the slices numbered from 0 in their order; ``times`` has key and time."""
    numbered = times.select("time").distinct().withColumn("time_slice", (F.row_number().over(Window.orderBy("time")) - 1).cast("int"))  # slices are few
    return Corpus(corpus.tables | {"times": times.join(numbered, "time").select("key", "time_slice", "time")})


def documents(corpus: Corpus, split: str, group: Column | None = None) -> DataFrame:
    """(key, terms, counts[, grp]) as models read them; ``grp`` is the time slice where there is one, or ``group``."""
    rows = corpus.split(split)
    listed = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("term_id").cast("int").alias("t"), F.col("cnt").cast("int").alias("c")))).alias("p"))
    out = listed.select("key", F.transform("p", lambda x: x["t"]).alias("terms"), F.transform("p", lambda x: x["c"]).alias("counts"))
    if "times" in corpus.tables:
        return out.join(corpus.times.select("key", F.col("time_slice").alias("grp")), "key")
    return out if group is None else out.withColumn("grp", group)
