"""Replies of language models: JSON cut out, repaired, parsed in steps, with what the last step could save."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOPIC = "struct<Summary:string,Keywords:array<string>,`Source Titles`:array<string>>"
TOPIC_LIST = f"array<map<string,{TOPIC}>>"
CONTROL = r"[\x00-\x1f\x7f-\x9f\x{feff}]"


def without_thoughts(reply: Column) -> Column:
    return F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")


def json_slice(reply: Column) -> Column:
    """The list in a reply: of a fenced block if there is one, from the first ``[`` to the last ``]`` (or to the last ``}``, closed)."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(reply)
    from_first = F.substr(body, F.greatest(F.instr(body, "["), F.lit(1)))
    last = F.length(from_first) - F.instr(F.reverse(from_first), "]") + 1
    brace = F.length(from_first) - F.instr(F.reverse(from_first), "}") + 1
    closed = F.when(F.contains(from_first, F.lit("]")), F.substr(from_first, F.lit(1), last))
    return F.when(F.contains(body, F.lit("[")), F.coalesce(closed, F.concat(F.substr(from_first, F.lit(1), brace), F.lit("]"))))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def repaired(text: Column) -> Column:
    """Trailing commas dropped, missing commas between objects put in, an unfinished tail cut after its last object."""
    steps = [(CONTROL, " "), (r",\s*}", "}"), (r",\s*\]", "]"), (r"\}\s*\{", "},{"), (r"\]\s*\{", "],{")]
    fixed = reduce(lambda c, s: F.regexp_replace(c, *s), steps, text)
    end = F.length(fixed) - F.instr(F.reverse(fixed), "}") + 1
    return F.when(fixed.contains("}"), F.concat(F.rtrim(F.substr(fixed, F.lit(1), end), F.lit(", ")), F.lit("]"))).otherwise(fixed)


def _records(parsed: Column) -> Column:
    """(topic_num, summary, keywords, n, meets, rescued) of the first entry of each map; others are no topics."""
    entries = F.filter(parsed, lambda m: m.isNotNull() & (F.size(m) > 0))
    return F.transform(entries, lambda m, i: F.struct(
        (i + 1).cast("int").alias("topic_num"), F.coalesce(F.map_values(m)[0]["Summary"], F.lit("")).alias("summary"),
        F.coalesce(F.map_values(m)[0]["Keywords"], F.array().cast("array<string>")).alias("keywords"), F.lit(False).alias("rescued"),
    ))


def _rescued(text: Column) -> Column:
    """Summaries and keyword lists found by themselves, whole, and paired in order."""
    summaries = F.regexp_extract_all(text, F.lit(r'"Summary"\s*:\s*"([^"]+)"'), F.lit(1))
    lists = F.regexp_extract_all(text, F.lit(r'"Keywords"\s*:\s*\[([^\]]+)'), F.lit(1))
    n = F.least(F.size(summaries), F.size(lists))
    pairs = F.arrays_zip(F.slice(summaries, 1, n).alias("s"), F.slice(lists, 1, n).alias("k"))
    words = lambda k: F.filter(F.transform(F.split(k, ","), lambda w: F.trim(F.regexp_replace(w, "\"", ""))), lambda w: w != "")
    return F.transform(pairs, lambda p, i: F.struct((i + 1).cast("int").alias("topic_num"), p["s"].alias("summary"), words(p["k"]).alias("keywords"), F.lit(True).alias("rescued")))


def parse_topics(reply: Column) -> Column:
    """array<struct<topic_num, summary, keywords, rescued>> of a reply: as it is, else repaired, else rescued; empty if nothing is left.

    A null reply gives null. The repaired form is used whenever it parses.
    """
    plain = without_thoughts(reply)
    cut = F.coalesce(json_slice(plain), plain)
    # what was cut off is repaired from the first bracket on, where no list is whole
    tail = F.substr(plain, F.greatest(F.instr(plain, "["), F.lit(1)))
    asis, fixed, longer = (F.from_json(x, TOPIC_LIST) for x in (without_controls(cut), repaired(cut), repaired(tail)))
    usable = lambda p: F.when((F.size(p) > 0) & ~F.forall(p, lambda m: m.isNull()), _records(p))
    return F.when(reply.isNotNull(), F.coalesce(usable(asis), usable(fixed), usable(longer), _rescued(plain)))


def yes_no(reply: Column) -> Column:
    """The ``answer`` of a JSON reply in lower case, no if it is neither yes nor no; of other text yes if it holds the word; null is an error."""
    answer = F.lower(F.from_json(reply, "struct<answer:string>")["answer"])
    is_json = F.trim(reply).startswith("{") & F.trim(reply).endswith("}")
    return F.when(reply.isNull(), "error").when(is_json, F.when(answer == "yes", "yes").otherwise("no")).otherwise(F.when(F.lower(reply).contains("yes"), "yes").otherwise("no"))


def rubric(reply: Column) -> Column:
    """struct<coherence, conciseness, informativity, overall> from the outermost braces of a reply; null scores where it has none."""
    inner = "struct<score:double,explanation:string>"
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    e = F.from_json(body, f"struct<evaluation:struct<coherence:{inner},conciseness:{inner},informativity:{inner}>,overall_score:double>")
    return F.struct(*[e["evaluation"][k]["score"].alias(k) for k in ("coherence", "conciseness", "informativity")], e["overall_score"].alias("overall"))


def topic_estimate_reply(reply: Column) -> Column:
    """The number a reply names: of a JSON field, else before the word topics; null without one."""
    field = F.regexp_extract(reply, r'"(?:estimated_topics|max_topics|topic_count)"\s*:\s*(\d{1,9})', 1)
    loose = F.regexp_extract(reply, r"(\d{1,9})\s*topics?", 1)
    return F.coalesce(F.nullif(field, F.lit("")), F.nullif(loose, F.lit(""))).cast("int")


def keyword_list(text: Column, strict_compat: bool = False) -> Column:
    """Keywords of a list in JSON or with single quotes, else of a comma list, without quotes and brackets.

    With ``strict_compat`` single quotes make no list, and the plain comma split keeps quotes and brackets.
    """
    listed = F.from_json(text, "array<string>", {"allowSingleQuotes": str(not strict_compat).lower()})
    bare = text if strict_compat else F.regexp_replace(text, r"^\s*\[|\]\s*$", "")
    parts = F.transform(F.split(bare, ","), lambda w: F.trim(w) if strict_compat else F.trim(F.regexp_replace(F.trim(w), "^['\"]|['\"]$", "")))
    return F.filter(F.coalesce(F.when(F.ltrim(text).startswith("["), listed), parts), lambda w: w != "")


def _outer_object(reply: Column) -> Column:
    """From the first ``{`` to the last ``}``; null without them."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def hierarchy_topics(reply: Column) -> Column:
    """struct<secondary, tertiary> of a reply: the whole reply if it begins with a brace, else a fenced object, else the outermost
    braces. A field that is no list, and any reply that is no object, gives empty lists; null gives empty lists."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```json\s*(\{.*?\})\s*```", 1), F.lit(""))
    body = F.when(F.trim(reply).startswith("{"), F.trim(reply)).otherwise(F.coalesce(fenced, _outer_object(reply)))
    field = lambda name: F.coalesce(F.from_json(F.get_json_object(body, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
    return F.struct(field("secondary_topics").alias("secondary"), field("tertiary_topics").alias("tertiary"))


def diversity_reply(reply: Column, n_topics: Column) -> Column:
    """struct<redundant, overlap, unique_topics, diversity, mergeable, failed> of a reply's outermost object; a missing list counts 0, a
    missing number of unique topics is that of all topics, a missing diversity 0.8. ``failed`` marks a reply without such an object."""
    form = "struct<redundant_pairs:array<string>,partial_overlap_pairs:array<string>,mergeable_groups:array<array<string>>,unique_topics_count:bigint,diversity_score:double>"
    e = F.from_json(_outer_object(reply), form)
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))
    grouped = F.coalesce(F.aggregate(e["mergeable_groups"], F.lit(0), lambda s, g: s + F.coalesce(F.size(g), F.lit(0))), F.lit(0))
    return F.struct(
        size(e["redundant_pairs"]).alias("redundant"), size(e["partial_overlap_pairs"]).alias("overlap"), F.coalesce(e["unique_topics_count"], n_topics.cast("bigint")).alias("unique_topics"),
        F.coalesce(e["diversity_score"], F.lit(0.8)).alias("diversity"), grouped.alias("mergeable"), e.isNull().alias("failed"),
    )


def topic_summary(topic: Column, place: Column) -> Column:
    """struct<id, summary> of a topic given as JSON: a flat one has ``summary`` and maybe ``topic_num`` (else T and its place), a nested one
    ``Summary`` or ``summary`` under its name. Null where there is no summary but white space."""
    flat = F.get_json_object(topic, "$.summary")
    nested = F.from_json(topic, "map<string,map<string,string>>")
    inner = lambda e: F.coalesce(e["value"]["Summary"], e["value"]["summary"])
    first = F.element_at(F.filter(F.map_entries(nested), lambda e: inner(e).isNotNull()), 1)
    found = F.trim(F.when(flat.isNotNull(), flat).otherwise(inner(first)))
    name = F.when(flat.isNotNull(), F.coalesce(F.get_json_object(topic, "$.topic_num"), F.concat(F.lit("T"), place.cast("string")))).otherwise(first["key"])
    return F.when(found != "", F.struct(name.alias("id"), found.alias("summary")))
