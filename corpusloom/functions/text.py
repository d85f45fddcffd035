"""Scalar text functions: cleaning, tokens, keywords, serialised lines, lengths in tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{0b}\x{85}\p{Z}]"
# The marks that cleaning turns into spaces (all ASCII punctuation but ' . _ < >), and extra stop words.
PUNCTUATION = "!\"#$%&()*+,-/:;=?@[\\]^`{|}~"
STOP_WORDS = ["the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "his", "how", "its", "may", "new", "now", "old", "see", "two", "way", "who", "did", "get", "let", "say", "she", "too", "use", "that", "with", "have", "this", "will", "your", "from", "they", "been", "were", "said", "each", "which", "their", "would", "there"]


def clean_text(text: Column, strip_tags: bool = True) -> Column:
    """Lower-cased text without tags, mail addresses, mentions and punctuation; words separated by single spaces stay as they are."""
    t = F.regexp_replace(text, r"<[^>]+>", "") if strip_tags else F.translate(text, "<>", "()")
    t = F.lower(t)
    steps = [
        (r"[^\s\p{Z}]+@[^\s\p{Z}]+", " "),
        (WS + r"@[^\s\p{Z}]+", " "),
        ("_", " "),
        (WS + "'", " "),
        ("'" + WS, " "),
        (r"\.", ""),
        (r"[!\"#$%&()*+,\-/:;<=>?@\[\\\]\^`{|}~]", " "),
        ("'", ""),
        (WS, " "),
    ]
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, t))


def tokens(cleaned: Column, *, stop_words: list[str] | None = None, keep: str = "letters", min_length: int = 3) -> Column:
    """Words of a cleaned text. ``keep``: ``letters`` (ASCII letters only), ``numbers`` (also words of digits), ``all``."""
    words = F.filter(F.split(cleaned, " +"), lambda w: F.length(w) >= min_length)
    if keep == "letters":
        words = F.filter(words, lambda w: w.rlike("^[a-zA-Z_]+$"))
    elif keep == "numbers":
        words = F.filter(words, lambda w: w.rlike("^(?:[a-zA-Z_]+|[0-9_]+)$"))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(stop_words))
    return words


def words(text: Column) -> Column:
    """The longest runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Lower-cased pieces between white space."""
    return F.filter(F.split(F.lower(text), WS + "+"), lambda w: w != "")


def plain_keywords(text: Column) -> Column:
    """Different lower-cased words of four or more ASCII letters that stand alone."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: w.rlike("^[a-z]{4,}$"))))


def has_word(text: Column, keyword: Column) -> Column:
    """Whether ``keyword`` stands in ``text`` with no letter, digit or underscore next to it, in any case."""
    quoted = F.concat(F.lit(r"(?:^|[^\p{L}\p{N}_])\Q"), F.replace(F.lower(keyword), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?:$|[^\p{L}\p{N}_])"))
    return F.lower(text).contains(F.lower(keyword)) & F.regexp_like(F.lower(text), quoted)


#: A private character that marks where words begin and end.
EDGE = "\ue000"


def with_edges(text: Column) -> Column:
    """Lower-cased text with EDGE at every change between word characters (letters, digits, underscore) and others, and at its ends."""
    w = r"[\p{L}\p{N}_]"
    return F.regexp_replace(F.translate(F.lower(text), EDGE, ""), rf"(?<!{w})(?={w})|(?<={w})(?!{w})", EDGE)


def has_word_edged(edged_text: Column, keyword: Column, edged_keyword: Column) -> Column:
    """``has_word`` on texts prepared by ``with_edges``: a plain search, but for keywords that begin or end with no word character."""
    plain = edged_keyword.startswith(EDGE) & edged_keyword.endswith(EDGE)
    return F.when(plain, edged_text.contains(edged_keyword)).otherwise(has_word(F.translate(edged_text, EDGE, ""), keyword))


def filled(c: Column) -> Column:
    """Trimmed value; blank as null."""
    return F.nullif(F.trim(c), F.lit(""))


def article_line(columns: dict[str, str]) -> Column:
    """``ID: .. | Title: ..``: labelled fields in order; fields without a value are left out."""
    return F.concat_ws(" | ", *[F.when(filled(F.col(c)).isNotNull(), F.concat(F.lit(f"{label}: "), filled(F.col(c)))) for label, c in columns.items()])


def line_field(line: Column, label: str) -> Column:
    """The value of a label in such a line, up to the next separator; empty if it is missing."""
    return F.regexp_extract(line, rf"(?s){label}: (.*?)(?: \| |$)", 1)


def estimated_tokens(text: Column, up: bool = True) -> Column:
    """Characters over 3.5, rounded up (or down)."""
    n = F.length(text) / 3.5
    return (F.ceil(n) if up else F.floor(n)).cast("bigint")


def slug(name: Column) -> Column:
    return F.translate(name, "/-:", "__")


def topic_place(line: Column) -> tuple[Column, Column]:
    """Layer and number of a line ``L-0_K-3 w1 w2``; null for others."""
    at = r"^L-(\d+)_K-(\d+) "
    pick = lambda i: F.nullif(F.regexp_extract(line, at, i), F.lit("")).cast("int")
    return pick(1), pick(2)


def topic_words(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^L-\d+_K-\d+ ", ""), " +")
