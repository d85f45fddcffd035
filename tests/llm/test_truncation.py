import html
import json
import random
import re

import numpy as np

from corpusloom.llm import truncation as tr

WHOLE = [
    "A short notice", "The council met on Monday. It agreed.", "He said “no.”", "Der Plan gilt als „offen“.", "The rest is silence.\n— Jane Doe, Daily Post", "All went well.\nContact: desk, extension 5",
    "It was late.\n(ab/cd)", "North 2, South 1\nEast 0, West 3", "Text with stray space.  \n", "Was it?", "« Oui », dit-il.", "Ends well.\xa0", "",
    "   ", None, "Paragraph one.\r\n\r\nParagraph two (with a note).",
]
CUT = [
    "The council met on Monday. It agr", "He said “we have", "One. Two and the", "It was late [+123 chars]", "It was late. He [...]", "It was late. The man (contin", "Prices rose by &quo", "See the <p",
    "It was late. He spoke to Dr.", "He said “we have seen it.", "The note (see the end.", "The minister said that the bridge over the river would be closed to all…", "Line one is whole.\n\nEl",
]


def judge(spark, texts, titles=None, sources=None):
    data = [(i, t, (sources or ["S"] * len(texts))[i], (titles or [None] * len(texts))[i], "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "k bigint, t string, source string, title string, why string, lengths int")
    return {r.k: r for r in tr.truncated_texts(df, "k", "t", "source", "title").collect()}


def test_endings(spark):
    got = judge(spark, WHOLE + CUT)
    assert [WHOLE[i] for i in range(len(WHOLE)) if got[i].is_cut] == []
    assert [CUT[i] for i in range(len(CUT)) if not got[len(WHOLE) + i].is_cut] == []


def test_headline_is_told_by_its_title(spark):
    text = "Port council weighs the harbour plan"
    got = judge(spark, [text, text], [text, "Another title"])
    assert not got[0].is_cut and got[1].is_cut


def test_meant_ellipsis(spark):
    texts = [f"Number {i} came by. And so they wait..." for i in range(4)] + ["Number 9 came by. The bridge that..."]
    got = judge(spark, texts, sources=["a", "b", "c", "A ", "a"])
    assert [got[i].is_cut for i in range(5)] == [False] * 4 + [True]


def test_repeated_cuts_are_not_meant(spark):
    cut = [f"Number {i} came by. The bridge over the riv..." for i in range(3)]
    whole = [f"Number {i} went. The bridge over the river is closed." for i in range(4)]
    copies = ["Number 8 came by. The minister said that..."] * 3
    meant = [f"Number {i} came by. And so they wait..." for i in range(3)] + ["And so they wait for the bus."]
    got = judge(spark, cut + whole + copies + meant, sources=[*"abc", *"abcd", *"abc", *"abcd"])
    assert [got[i].is_cut for i in range(14)] == [True] * 3 + [False] * 4 + [True] * 3 + [False] * 4


def limit_texts(encode, limit, n=60, seed=1):
    """Texts of many lengths cut where their encoded form reaches the limit."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        t = ""
        while len(encode(t)) < 2 * limit:
            t += r.choice(["été ", "plain ", 'say "so" ', "R&D ", "word. "])
        while len(encode(t)) > limit:
            t = t[:-1]
        out.append(t)
    return out


def test_hidden_limits(spark):
    r = random.Random(2)
    other = [("x" * r.randint(20, 900)) + "." for _ in range(300)]
    data = [(t, "Bytes") for t in limit_texts(lambda t: t.encode(), 300)] + [(t, " CHARS") for t in limit_texts(lambda t: t, 200)] + [(t, "free") for t in other] + [(None, "free"), ("", "free")]
    df = spark.createDataFrame([(t, s, "e", 1) for t, s in data], "t string, source string, encoding string, len int")
    got = {(x.source_key, x.limit_length): x.encoding for x in tr.storage_limits(df, "t", "source").collect()}
    assert got["bytes", 300] == "utf8_bytes" and got["chars", 200] == "characters"
    assert not [k for k in got if k[0] == "free"]


def test_rarer_limit_of_a_source_is_kept(spark):
    data = [(t, "s") for t in limit_texts(lambda t: t, 200, n=120) + limit_texts(lambda t: t, 400, n=25)]
    got = {(x.encoding, x.limit_length) for x in tr.storage_limits(spark.createDataFrame(data, "t string, source string"), "t", "source").collect()}
    assert got == {("characters", 200), ("characters", 400)}


def test_whole_text_at_a_limit_is_kept(spark):
    cut = limit_texts(lambda t: t, 200)
    whole = ["y" * 199 + "."] * 5
    got = judge(spark, cut + whole)
    assert all(got[len(cut) + i].at_limit and not got[len(cut) + i].is_cut for i in range(5))
    assert sum(got[i].is_cut for i in range(len(cut))) >= 0.8 * len(cut)


def test_lengths_under_every_encoding():
    r = random.Random(3)
    texts = ["", "\n", "\r\n", "\r", "a\r", "\nb", "é😀<&>\"'\\\t", *["".join(r.choice('aé😀<&>"\'\\\t\r\n€') for _ in range(r.randint(0, 40))) for _ in range(200)]]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([7, *map(len, data)])
    got = tr.lengths_of(offsets, np.frombuffer(b"#" * 7 + b"".join(data) + b"##", np.uint8))
    for t, row in zip(texts, got.tolist()):
        crlf = re.sub("(?<!\r)\n", "\r\n", t)
        quoted = html.escape(t).replace("&#x27;", "&apos;")
        loose = html.escape(t, quote=False)
        escaped = json.dumps(t, ensure_ascii=False)[1:-1]
        chars, utf8 = [len(x) for x in (t, crlf, loose, quoted, escaped)], [len(x.encode()) for x in (t, crlf, loose, quoted, escaped)]
        by = dict(zip(tr.ENCODINGS, row))
        assert [by[k] for k in ("characters", "crlf_characters", "entity_characters", "entity_quote_characters", "json_characters")] == chars
        assert [by[k] for k in ("utf8_bytes", "crlf_bytes", "entity_bytes", "entity_quote_bytes", "json_bytes")] == utf8
        assert by["utf16_units"] == len(t.encode("utf-16-le")) // 2 and by["json_ascii"] == len(json.dumps(t)) - 2


def test_a_limit_decides_a_line_of_its_own(spark):
    whole = [f"The council met {i} times.\n\nAll went well on Monday." for i in range(40)]
    line = "The mill reopened.\n\nRounds are held on Monday"
    filler = limit_texts(lambda t: t, len(line))
    away = judge(spark, [*whole, line])
    assert not away[len(whole)].is_cut
    at = judge(spark, [*whole, line, *filler])
    assert at[len(whole)].is_cut and at[len(whole)].why == "limit"


def test_copies_make_no_limit(spark):
    r = random.Random(4)
    texts = ["word " * r.randint(20, 200) + f"{i}." for i in range(100)] + ["The very same notice for everybody."] * 60
    df = spark.createDataFrame([(t, "s") for t in texts], "t string, source string")
    assert tr.storage_limits(df, "t", "source").count() == 0


def test_empty_table_long_text_and_report(spark):
    df = spark.createDataFrame([], "k bigint, t string, source string, title string")
    assert tr.truncated_texts(df, "k", "t", "source", "title").count() == 0
    long = "(" * 200_000 + " word " * 200_000
    got = judge(spark, [long, long + "."])
    assert got[0].is_cut and got[1].is_cut
    data = spark.createDataFrame([(1, "It was. It was la", "A"), (2, "It was.", " a"), (3, "It was.", None)], "k bigint, t string, source string")
    report = {r.source_key: (r.n_docs, r.n_cut, r.cut_share) for r in tr.truncation_report(tr.truncated_texts(data, "k", "t", "source")).collect()}
    assert report == {"a": (2, 1, 0.5), "": (1, 0, 0.0)}
