"""Texts that were cut off before their end.

Lengths are recomputed under alternative encodings (UTF-8 bytes, UTF-16 units, entity and JSON escaping, line
ends of two characters). A length that far more texts of one source reach than its neighbours is a storage
limit, in the encoding that most texts reach it in. Then the endings are inspected: marks of a cut, ends inside
a word, sentence, quotation or bracket. A limit alone proves nothing, since whole texts may fit it exactly. An ending
that stops in the middle of a finished text's line proves a cut by itself; one that could be a list, a short headline, or a
closing line without a full stop is cut only where the text fills a storage limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.durable import durable
from corpusloom.plans.skew import hot_split_join

# Marks that close a sentence, marks that may follow them, and abbreviations that end no sentence.
ENDS = ".!?…。！？"
CLOSERS = "\"”»“'’)\\]›‹«"
ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "Prof", "St", "Nr", "No", "Mme", "Mlle", "Sr", "Sra", "Hr", "Fr", "bzw", "usw", "vs", "approx"]
BLANK = " \t\n\r\x0b\x0c\x85\xa0         　​﻿"

TERMINAL = rf"[{ENDS}][{CLOSERS}]*$"
ELLIPSIS = rf"(?:…|\.\.\.)[{CLOSERS}]*$"
#: Between two sentences; the marks stay with the first.
BETWEEN = rf"(?=\s)(?<=[{ENDS}][{CLOSERS}]{{0,9}})\s+|\n\s*"
CUT_MARK = r"(?:\[[^\]\[]{0,40}(?:\d+\s*\p{L}*|\.\.\.|…)\s*\]|\((?:contin|cont|more|weiter|suite|sigue)\p{L}*\.*\)?)$"
ABBREVIATED = rf"(?:^|[^\p{{L}}])(?:{'|'.join(ABBREVIATIONS)})\.$"
#: A line that stands for itself below a text: a byline after a dash, a labelled line, initials in brackets.
SIGN_OFF = r"^(?:[—–-]{1,2}\s*\S.*|\p{Lu}[\p{L} ]{1,20}:\s+\S.*|\([^()]{1,40}\)|\[[^\[\]]{1,40}\])$"

#: A limit is a length that LIFT times as many different texts of the source have as its neighbours on average, and SHARE_AT of those that long or longer.
SHARE_AT, LIFT, AROUND = 0.05, 6.0, 20
#: A phrase may be meant to end in an ellipsis if this share of the sources that use one, and more than one, close a text so; a headline has no more characters.
MEANT_SHARE, HEADLINE = 0.1, 60
#: Encodings of a text, the plainest first.
ENCODINGS = [
    "characters", "utf8_bytes", "utf16_units", "crlf_characters", "crlf_bytes", "entity_characters", "entity_quote_characters",
    "entity_bytes", "entity_quote_bytes", "json_characters", "json_bytes", "json_ascii",
]


def source_key(c: Column) -> Column:
    """Source names that differ in case and outer white space only are one; null and blank become empty."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))), F.lit(""))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lengths_of(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """[text, encoding] lengths of UTF-8 texts given as offsets into their bytes."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]

    def per_text(is_one: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(is_one, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    size = np.diff(offsets).astype(np.int64)
    chars = size - per_text((data & 0xC0) == 0x80)
    astral, other = per_text(data >= 0xF0), per_text(data >= 0xC0)
    is_line, is_return = data == 10, data == 13
    after_return = np.zeros(len(data), bool)
    after_return[1:] = is_return[:-1]
    starts = offsets[:-1][size > 0]
    after_return[starts] = False
    lines = per_text(is_line & ~after_return)
    double, single = data == 34, data == 39
    entities = per_text(data == 38) * 4 + per_text((data == 60) | (data == 62)) * 3
    quotes = per_text(double | single) * 5
    escaped = per_text(double | (data == 92) | is_line | is_return | (data == 9))
    wide = chars + astral
    return np.stack(
        [
            chars, size, wide, chars + lines, size + lines, chars + entities, chars + entities + quotes,
            size + entities, size + entities + quotes, chars + escaped, size + escaped, wide + escaped + (other + astral) * 5,
        ],
        axis=1,
    )


def with_lengths(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``lengths``: those of ``text``, which holds no nulls, under every encoding; whole Arrow buffers at a time."""
    names = [*rows.columns, "lengths"]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(at).cast(pa.large_string())
            offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
            data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] else np.zeros(0, np.uint8)
            found = lengths_of(offsets, data).astype(np.int32) if len(c) else np.zeros((0, len(ENCODINGS)), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * len(ENCODINGS), pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=names)

    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, form + ", lengths array<int>")


def storage_limits(documents: DataFrame, text: str, source: str) -> DataFrame:
    """(source_key, encoding, limit_length, n_at, n_longer): hidden storage limits of each source, one encoding per limit.

    All texts count, empty and null ones aside; copies of a text in one source count once.
    """
    rows = documents.select(source_key(F.col(source)).alias("source_key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return _limits(with_lengths(rows, "t").select("source_key", "lengths", F.xxhash64("t").alias("same")))


def _limits(measured: DataFrame) -> DataFrame:
    """Limits from (source_key, lengths, same). Copies are merged, and counts combined by source, encoding and length before
    they are shuffled; the neighbours of a length are seen through a window over those counts. A peak that under a third of the
    texts at the highest peak of its source reach is dropped as a shadow if most of its texts also lie at a higher peak, in that one's encoding."""
    rows = durable(measured.filter(F.element_at("lengths", 1) > 0).groupBy("source_key", "same").agg(F.first("lengths").alias("lengths")))
    long = rows.select("source_key", F.posexplode("lengths").alias("e", "len"))
    counts = long.groupBy("source_key", "e", "len").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source_key", "e")
    near = by.orderBy("len").rangeBetween(-AROUND, AROUND)
    # a limit that cuts whole characters of several bytes leaves a few texts just below it
    background = (F.sum("n").over(near) - F.sum("n").over(by.orderBy("len").rangeBetween(-3, 0))) / (2 * AROUND - 3)
    longer = F.coalesce(F.sum("n").over(by.orderBy("len").rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    peaks = counts.withColumns({"background": background, "n_longer": longer}).filter((F.col("n") >= SHARE_AT * (F.col("n") + F.col("n_longer"))) & (F.col("n") >= LIFT * (F.col("background") + 0.5)))
    best = Window.partitionBy("source_key", "len").orderBy(F.desc("n"), "e")
    names = F.array(*[F.lit(n) for n in ENCODINGS])
    peaks = peaks.withColumns({"r": F.row_number().over(best), "top": F.max("n").over(Window.partitionBy("source_key"))}).filter("r = 1")
    peaks = durable(peaks.select("source_key", "e", "len", "n", "n_longer", (F.col("n") * 3 < F.col("top")).alias("weak"), F.element_at(names, F.col("e") + 1).alias("encoding")))
    one = F.struct("n", "e", "len", "weak", F.when(F.col("encoding").endswith("bytes"), 3).otherwise(0).alias("short"))
    per_source = peaks.groupBy("source_key").agg(F.collect_list(one).alias("peaks"), F.max("weak").alias("any")).filter("any").drop("any")
    size = lambda p: F.element_at("lengths", p["e"] + 1)
    at = rows.join(per_source, "source_key").withColumn("p", F.explode(F.filter("peaks", lambda p: p["weak"] & (size(p) == p["len"]))))
    shared = F.exists("peaks", lambda q: (q["n"] > F.col("p.n")) & size(q).between(q["len"] - q["short"], q["len"]))
    shadows = at.groupBy("source_key", "p.e", "p.len").agg(F.avg(shared.cast("int")).alias("share")).filter("share > 0.5")
    return peaks.join(shadows, ["source_key", "e", "len"], "left_anti").select("source_key", "encoding", F.col("len").alias("limit_length"), F.col("n").alias("n_at"), "n_longer")


def _with_limit(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``at_limit``: the text reaches a limit of its source, or stops short of it by less than one character."""
    place = F.create_map(*[x for i, n in enumerate(ENCODINGS) for x in (F.lit(n), F.lit(i + 1))])
    per_source = limits.groupBy("source_key").agg(F.collect_list(F.struct(place[F.col("encoding")].alias("e"), F.col("encoding").endswith("bytes").alias("bytes"), F.col("limit_length").alias("size"))).alias("limits"))
    hit = F.exists("limits", lambda x: F.element_at(F.col("lengths"), x["e"]).between(x["size"] - F.when(x["bytes"], 3).otherwise(0), x["size"]))
    return rows.join(per_source, "source_key", "left").withColumn("at_limit", F.coalesce(hit, F.lit(False))).drop("limits", "lengths")


def _after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def _open_after(text: Column, opening: str, *closing: str) -> Column:
    rest = _after_last(text, opening)
    is_open = text.contains(opening)
    for c in closing:
        is_open &= ~rest.contains(c)
    return is_open


def _unclosed(par: Column) -> Column:
    english = ~par.contains("„") & _open_after(par, "“", "”")
    german = _open_after(par, "„", "“", "”")
    first_close = F.instr(par, "»")
    french = _open_after(par, "«", "»") & ((first_close == 0) | (F.instr(par, "«") < first_close))
    return english | german | french | _open_after(par, "(", ")") | _open_after(par, "[", "]")


def _shape(line: Column) -> Column:
    masked = F.regexp_replace(F.regexp_replace(line, r"[\p{L}\p{M}]+", "a"), r"\p{N}+", "0")
    return F.regexp_replace(masked, r"a(?:[ &.'’-]+a)+", "a")


def _endings(documents: DataFrame, key: str, text: str, source: str, title: str | None) -> DataFrame:
    """One narrow row per document: lengths and what its ending says by itself."""
    name = F.col(title) if title else F.lit(None).cast("string")
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"), source_key(F.col(source)).alias("source_key"), F.trim(name).alias("name"))
    rows = with_lengths(rows, "t")
    rows = rows.withColumn("tail", F.rtrim(F.replace(F.col("t"), F.lit("\r\n"), F.lit("\n")), F.lit(BLANK)))
    rows = rows.withColumns({"par": _after_last(F.col("tail"), "\n\n"), "line": _after_last(F.col("tail"), "\n")})
    rows = rows.withColumn("before", _after_last(F.expr("left(tail, length(tail) - length(line) - 1)"), "\n"))
    tail, line, par, before = (F.col(c) for c in ("tail", "line", "par", "before"))
    phrase = F.element_at(F.split(F.regexp_replace(line, ELLIPSIS, ""), BETWEEN), -1)
    copy = F.xxhash64(F.regexp_replace(tail, r"\s+", " "))
    one_line = ~tail.contains("\n")
    has_end = rf"[{ENDS}][{CLOSERS}]*(?:\s|$)"
    headline = one_line & (tail == F.coalesce(F.col("name"), F.lit("")))
    short_line = one_line & (F.coalesce(F.col("name"), F.lit("")) == "") & (F.length("tail") <= HEADLINE) & ~tail.rlike(has_end) & ~tail.rlike(r"[&<,;:(]\S*$") & ~_unclosed(tail)
    sign_off = line.rlike(SIGN_OFF) & (before != "") & before.rlike(TERMINAL)
    a_list = ~one_line & ~tail.rlike(r"[.!?…]\s") & (_shape(line) == _shape(before))
    why = (
        F.when(tail == "", None)
        .when(tail.rlike(CUT_MARK) & ~sign_off, "mark")
        .when(tail.rlike(ELLIPSIS), F.when(_unclosed(par) | ((_count(par, '"') % 2) == 1), "ellipsis").otherwise("ellipsis?"))
        .when(tail.rlike(TERMINAL), F.when(tail.rlike(ABBREVIATED), "abbreviation").when(_unclosed(par), "unclosed"))
        .when(headline | sign_off, None)
        .when(short_line, "headline?")
        .when(a_list, "list?")
        .when(tail.rlike(r"(?:&#?\w{0,8}|<[^<>]{0,40}|\\u?[0-9a-fA-F]{0,4})$"), "escape")
        # a line of its own below a finished paragraph, that breaks off at nothing that must go on
        .when(F.rtrim(F.expr("left(tail, length(tail) - length(line))"), F.lit(BLANK)).rlike(TERMINAL) & ~line.rlike(has_end) & ~line.rlike(r"[&<,;:(\-–—/]\S*$") & ~_unclosed(par), "line?")
        .otherwise("open end")
    )
    # the last two words, read backwards from the end so that a text of any length is seen in one pass
    last = F.lower(F.reverse(F.regexp_extract(F.reverse(line), rf"^[{ENDS}{CLOSERS}]*(\S+(?:\s+\S+)?)", 1)))
    judged = rows.select("key", "source_key", "lengths", F.xxhash64("t").alias("same"), why.alias("why"), phrase.alias("phrase"), copy.alias("copy"), last.alias("last"))
    asked = F.col("why") == "ellipsis?"
    return judged.withColumns({"phrase": F.when(asked, F.trim("phrase")), "copy": F.when(asked, F.col("copy"))})


def _meant(asked: DataFrame, documents: DataFrame, text: str) -> DataFrame:
    """(phrase, meant): phrases that end different texts of a share of the sources in an ellipsis, and more texts so than
    hold a sentence that begins with the phrase and goes on or closes in another way. Chance repeats of cuts grow with
    the table, but so do the sentences they were cut from. Copies of a text count once.
    """
    often = asked.groupBy("phrase").agg(F.countDistinct("source_key").alias("n"), F.countDistinct("copy").alias("texts"))
    sources = asked.agg(F.countDistinct("source_key")).first()[0]
    least = max(2, math.ceil(MEANT_SHARE * sources))
    often = durable(often.filter((F.col("n") >= least) & (F.col("texts") >= least)))
    if often.isEmpty():
        return often.select("phrase", F.lit(True).alias("meant"))
    start = lambda c: F.regexp_extract(c, r"^\S+\s+\S+", 0)  # noqa: E731 - whole words, as phrases have three
    tail = F.rtrim(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit(BLANK))
    sentences = documents.select(tail.alias("t")).select(F.xxhash64("t").alias("copy"), F.explode(F.split("t", BETWEEN)).alias("s")).withColumn("s", F.trim("s"))
    # one row per sentence and length of a phrase that starts alike, however many phrases do
    sizes = often.groupBy(start("phrase").alias("start")).agg(F.collect_set(F.length("phrase")).alias("sizes"))
    near = sentences.withColumn("start", start("s")).hint("merge").join(sizes, "start")
    heads = near.select("copy", "s", F.explode(F.filter("sizes", lambda n: n <= F.length("s"))).alias("size"))
    heads = heads.select("copy", F.expr("left(s, size)").alias("phrase"), F.expr("substring(s, size + 1)").alias("rest"))
    other = heads.filter(~F.col("rest").rlike(rf"^{ELLIPSIS}")).hint("merge").join(often.select("phrase"), "phrase").groupBy("phrase").agg(F.countDistinct("copy").alias("others"))
    kept = often.join(other, "phrase", "left").filter(F.col("texts") > F.coalesce("others", F.lit(0)))
    return kept.select("phrase", F.lit(True).alias("meant"))


def _closing_words(rows: DataFrame) -> DataFrame:
    """(last, closes): pairs of words that end more whole texts of a full stop than texts that stop without one."""
    n = rows.filter((F.col("last") != "") & (F.col("why").isNull() | F.col("why").isin("line?", "open end"))).groupBy("last").agg(
        F.sum(F.when(F.col("why").isNull(), 1).otherwise(0)).alias("whole"), F.sum(F.when(F.col("why").isNull(), 0).otherwise(1)).alias("open")
    )
    return n.select("last", (F.col("whole") > F.col("open")).alias("closes"), (F.col("whole") + F.col("open")).alias("uses"))


def truncated_texts(documents: DataFrame, key: str, text: str, source: str, title: str | None = None) -> DataFrame:
    """(``key``, source_key, is_cut, why, at_limit) for every document; ``is_cut`` is false for null, empty and blank texts.

    ``why`` names the sign of the cut. Texts without a full stop that are whole are told by their form: the title, a
    sign-off line, and, unless they fill a storage limit, a list whose lines have one form, one short line
    where there is no title, and a line of its own below a finished paragraph whose last two words end more whole
    texts than open ones. A closing ellipsis is meant if the
    phrase before it, of three words or more, ends different texts of several sources so, and more texts than use it
    otherwise. Stray white space at the end is no part of a text. Repeated rows are judged alike. Texts are read whole, of any length; columns besides the
    named ones are not read.
    """
    rows = durable(_endings(documents, key, text, source, title))
    closing = _closing_words(rows)
    rows = _with_limit(rows, _limits(rows))
    known = F.coalesce(F.col("why"), F.lit(""))
    phrases = (known == "ellipsis?") & F.coalesce(F.col("phrase").rlike(r"\S\s+\S+\s+\S"), F.lit(False)) & ~F.col("at_limit")
    meant = _meant(rows.filter(phrases), documents, text)
    asked = known == "line?"
    lines = rows.filter(asked & ~F.col("at_limit"))
    judged = (
        rows.filter(phrases).join(meant, "phrase", "left").select("*", F.lit(None).cast("boolean").alias("closes"))
        .unionByName(hot_split_join(lines, closing, ["last"], "uses", lines.count(), "left"), allowMissingColumns=True)
        .unionByName(rows.filter(~phrases & ~(asked & ~F.col("at_limit"))), allowMissingColumns=True)
    )
    why = (
        F.when(F.col("why") == "ellipsis?", F.when(F.coalesce(F.col("meant"), F.lit(False)), None).otherwise("ellipsis"))
        .when(F.col("why").isin("list?", "headline?"), F.when(F.col("at_limit"), "limit"))
        .when(F.col("why") == "line?", F.when(F.col("at_limit"), "limit").when(F.coalesce(F.col("closes"), F.lit(False)), None).otherwise("open end"))
        .when((F.col("why") == "open end") & F.col("at_limit"), "limit")
        .otherwise(F.col("why"))
    )
    return judged.withColumn("why", why).select(F.col("key").alias(key), "source_key", F.col("why").isNotNull().alias("is_cut"), "why", "at_limit")


def truncation_report(judged: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, their share, and how many texts reach a storage limit."""
    cut = F.sum(F.when(F.col("is_cut"), 1).otherwise(0))
    return judged.groupBy("source_key").agg(
        F.count("*").alias("n_docs"), cut.alias("n_cut"), F.round(cut / F.count("*"), 6).alias("cut_share"), F.sum(F.when(F.col("at_limit"), 1).otherwise(0)).alias("n_at_limit")
    )
