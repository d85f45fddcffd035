"""Files in and out: articles as CSV in guessed form, texts, JSON lines, topic results, word lists, resumable sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS, DELIMITERS = ["UTF-8", "GBK", "ISO-8859-1"], [",", ";", "\t", "|"]
REQUIRED = ["id", "title", "text"]
TOPIC_FILE = "file_path string, total_topics int, topics array<struct<topic_num:int, summary:string, keywords:array<string>, keyword_count:int, meets_requirements:boolean, source_titles_with_ids:array<struct<title:string, id:string, match_score:int, matched_keywords:array<string>>>>>"


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def first_line(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of the first line of the first file at ``path`` (a file, folder or pattern); nothing beyond them is read. Null without a file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.globStatus(where) or [])
    while found and found[0].isDirectory():
        inside = sorted((x for x in fs.listStatus(found[0].getPath()) if x.getPath().getName()[0] not in "._"), key=lambda x: x.getPath().getName())
        found = inside + found[1:]
    if not found:
        return None
    # bytes pass through the one encoding that changes none of them
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(found[0].getPath()), "ISO-8859-1"))
    try:
        return (reader.readLine() or "").encode("latin-1")
    finally:
        reader.close()


def readable_in(spark: SparkSession, path: str, encodings: list[str]) -> list[str]:
    """The encodings that decode every line of the files, in their order: one pass over the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = list(encodings)
        for b in batches:
            lines = b.column(0).to_pylist()
            for e in list(left):
                try:
                    for x in lines:
                        x.decode(e)
                except UnicodeDecodeError:
                    left.remove(e)
        yield pa.RecordBatch.from_arrays([pa.array([e for e in encodings if e not in left], pa.string())], names=["failed"])

    failed = {r.failed for r in spark.read.text(path).select(F.col("value").cast("binary")).mapInArrow(run, "failed string").distinct().collect()}  # of the encodings asked for
    return [e for e in encodings if e not in failed]


def sniff(spark: SparkSession, path: str, required: list[str] | None = None, encodings: list[str] | None = None) -> tuple[str, str]:
    """Encoding and delimiter: the first encoding that decodes the whole file and gives its header the required columns under a known delimiter."""
    required = required or REQUIRED
    head = first_line(spark, path)
    if head is None:
        raise ValueError(f"{path} holds no file")
    for encoding in readable_in(spark, path, encodings or ENCODINGS):
        line = head.decode(encoding).lstrip("\ufeff").strip("\r")
        for delimiter in DELIMITERS:
            if set(required) <= {c.strip().strip('"') for c in line.split(delimiter)}:
                return encoding, delimiter
    raise ValueError(f"{path} has no header with {required}")


def read_articles(spark: SparkSession, path: str, required: list[str] | None = None, encodings: list[str] | None = None) -> DataFrame:
    """Rows of a CSV file with all required fields, trimmed; blank optional fields become empty."""
    required = required or REQUIRED
    encoding, delimiter = sniff(spark, path, required, encodings)
    if encoding == "GBK":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns])
    keep = F.lit(True)
    for c in required:
        keep &= F.col(c) != ""
    return df.filter(keep)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a ``.csv`` file; of any other the whole text as one row."""
    return read_articles(spark, path) if path.lower().endswith(".csv") else read_whole(spark, path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line"))


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_topic_results(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, topic_num, summary, keywords, ...) of result documents; entries that are no topics are skipped."""
    docs = spark.read.schema(TOPIC_FILE).option("multiLine", True).json(path)
    return docs.select("file_path", F.explode("topics").alias("t")).filter("t is not null").select("file_path", "t.*")


def assignments_of(topics: DataFrame) -> DataFrame:
    """One row for each article assigned to a topic."""
    return topics.select("file_path", "topic_num", F.explode("source_titles_with_ids").alias("a")).select("file_path", "topic_num", "a.*")


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, topic_id, words) of a table of neural topics as CSV."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    words = F.filter(F.split(F.trim("topic word list"), r"\s+"), lambda w: w != "")
    return df.select(F.col("ID").cast("int").alias("id"), "text", F.col("topic ID").cast("int").alias("topic_id"), words.alias("words"))


def topics_from_lists(spark: SparkSession, lists: list) -> DataFrame:
    """(id, name, keywords, description): a topic for each list of keywords, or each dict with ``keywords`` and maybe ``name`` and
    ``description``; without one, a topic is described by its first five keywords."""
    if not all(isinstance(x, (list, tuple, dict)) for x in lists):
        raise ValueError("topics are lists of keywords or dicts with keywords")
    given = [x if isinstance(x, dict) else {"keywords": x} for x in lists]
    df = spark.createDataFrame([(i, list(x.get("keywords") or []), x.get("name"), x.get("description")) for i, x in enumerate(given)], "id int, keywords array<string>, name string, description string")
    first = F.array_join(F.slice("keywords", 1, 5), ", ")
    described = F.when(F.size("keywords") > 5, F.concat(first, F.lit("..."))).otherwise(first)
    return df.select("id", F.coalesce("name", F.concat(F.lit("Topic_"), F.col("id"))).alias("name"), "keywords", F.coalesce("description", described).alias("description"))


def load_topics(spark: SparkSession, source) -> DataFrame:
    """``topics_from_lists`` of a list, or of the JSON document at a path: a list, or an object with ``topics``."""
    import json

    if isinstance(source, str):
        source = json.loads(spark.read.text(source, wholetext=True).first().value)
        source = source.get("topics") if isinstance(source, dict) else source
    if not isinstance(source, list):
        raise ValueError("no list of topics")
    return topics_from_lists(spark, source)


def read_texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """The texts of a CSV file in UTF-8 or else Latin-1; blank ones are left out."""
    return read_articles(spark, path, [column], ["UTF-8", "ISO-8859-1"]).select(F.col(column).alias("text"))


def stop_words(spark: SparkSession, source: str | list[str]) -> list[str]:
    """Stop words: a list as it is, a language by Spark's own list, or the words of a file, one a line."""
    if not isinstance(source, str):
        return list(source)
    if source.isalpha():
        from pyspark.ml.feature import StopWordsRemover

        return StopWordsRemover.loadDefaultStopWords(source.lower())
    return [r.line for r in read_lines(spark, source).filter("line <> ''").collect()]  # a word list


def latest_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each id."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def with_vectors(vocab: DataFrame, vectors: DataFrame, term: str, vector: str, size: int) -> DataFrame:
    """Each term with its vector, the zero vector where it has none."""
    return vocab.join(vectors, term, "left").withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), size)))


def write_json(df: DataFrame, path: str, sort_keys: bool = False) -> None:
    (df.select(*sorted(df.columns)) if sort_keys else df).write.mode("overwrite").json(path)


def write_checked(df: DataFrame, path: str) -> int:
    """Write as Parquet, read again, and return the number of rows; an error if they are not as many."""
    wanted = df.count()
    df.write.mode("overwrite").parquet(path)
    got = df.sparkSession.read.parquet(path).count()
    if got != wanted:
        raise OSError(f"{path}: {got} rows of {wanted}")
    return got


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the folder does not hold yet: a run that stopped goes on where it was."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    n = df.count()
    df.write.mode("append").parquet(path)
    return n


def write_report(lines: DataFrame, path: str) -> None:
    """Lines (at, line) as text in the order of ``at``."""
    lines.repartitionByRange("at").sortWithinPartitions("at").select("line").write.mode("overwrite").text(path)


def write_assignments(df: DataFrame, path: str) -> None:
    """Inferred topics (id, text, topic_id, words) as CSV with a header, as ``read_assignments`` reads them."""
    out = df.select(F.col("id").alias("ID"), "text", F.col("topic_id").alias("topic ID"), F.array_join("words", " ").alias("topic word list"))
    out.write.mode("overwrite").csv(path, header=True, escape='"', encoding="UTF-8")
