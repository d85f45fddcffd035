import random

import pyarrow as pa
import pytest
from conftest import rows

from corpusloom.operators.packed import split_packed, split_packed_array, split_packed_to_array

DELIMITERS = set(",;|\t\n\r\x0b\x0c\x85  ，；｜﹐﹔￨")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"', "'": "'"}


def plainly(text, spaces):
    """The same split, one character after the other."""
    s = (text or "").strip()
    if s.startswith("["):
        s = s[1:]
        if s.endswith("]"):
            s = s[:-1]
    out, i = [], 0
    cuts = lambda c: c in DELIMITERS or (spaces and c.isspace())
    while i <= len(s):
        while i < len(s) and s[i].isspace() and not cuts(s[i]):
            i += 1
        value = ""
        if i < len(s) and s[i] in "\"'":
            q, i = s[i], i + 1
            while i < len(s):
                if s[i] == "\\" and i + 1 < len(s):
                    if s[i + 1] == "u":
                        value, i = value + chr(int(s[i + 2 : i + 6], 16)), i + 6
                    elif s[i + 1] in ESCAPES:
                        value, i = value + ESCAPES[s[i + 1]], i + 2
                    else:
                        value, i = value + "\\", i + 1
                elif s[i] == q and s[i + 1 : i + 2] == q:
                    value, i = value + q, i + 2
                elif s[i] == q:
                    i += 1
                    break
                else:
                    value, i = value + s[i], i + 1
        while i < len(s) and not cuts(s[i]):
            value, i = value + s[i], i + 1
        if value.strip():
            out.append(value.strip())
        i += 1
    return out


def split(text, spaces=False):
    return split_packed_array(pa.array([text], pa.string()), spaces)[2].to_pylist()


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a, b;c|d", ["a", "b", "c", "d"]),
        ("a，b；c｜d", ["a", "b", "c", "d"]),
        ("a\tb\nc\r\nd", ["a", "b", "c", "d"]),
        ('"Doe, Jane", x', ["Doe, Jane", "x"]),
        ('"""Quiet"" plan",x', ['"Quiet" plan', "x"]),
        ("growers' market; pupils' safety", ["growers' market", "pupils' safety"]),
        ('["caf\\u00e9 culture", "\\"A\\" file"]', ["café culture", '"A" file']),
        ('["\\ud83d\\ude00"]', ["😀"]),
        ("['it''s', \"mayor's office\"]", ["it's", "mayor's office"]),
        (" , ,;; ", []),
        ("[]", []),
        (None, []),
        ("", []),
        ("a,,a", ["a", "a"]),
        ('"a, b', ["a, b"]),
        ("x [y]", ["x [y]"]),
        ("\xa0a\xa0,　b", ["a", "b"]),
    ],
)
def test_values(text, values):
    assert split(text) == values


def test_white_space_splits():
    assert split(' veteran  neuron "hospital beds"\tx ', True) == ["veteran", "neuron", "hospital beds", "x"]


def test_against_plain_split():
    r = random.Random(5)
    pieces = ["a", "bc", "é", '"', "'", ",", " ", '\\"', "\\u00e9", '""', "，", "\t", "[", "]", "\xa0", ";", "x y", "😀"]
    texts = ["".join(r.choice(pieces[:3] + pieces[5:] if r.random() < 0.5 else pieces[:5]) for _ in range(r.randint(0, 9))) for _ in range(400)]
    well_formed = []
    for n in range(3000):
        values = ["".join(r.choice(["a", "b ", "é", "，x", ",", ";", "'", '"', "😀"]) for _ in range(r.randint(1, 5))).strip() or "v" for _ in range(r.randint(0, 6))]
        well_formed.append(r.choice([", ", ";", "|", "，"]).join('"' + v.replace('"', '""') + '"' for v in values))
    for spaces in (False, True):
        parent, pos, items = split_packed_array(pa.array(well_formed), spaces)
        got = {}
        for p, k, v in zip(parent.tolist(), pos.tolist(), items.to_pylist()):
            got.setdefault(p, []).append(v)
            assert k == len(got[p])
        for i, t in enumerate(well_formed):
            assert got.get(i, []) == plainly(t, spaces), t
    split_packed_array(pa.array(texts))  # no text of any form fails


def test_long_text_and_slices():
    long = ",".join(f'"v, {i}"' for i in range(50_000))
    array = pa.array(["skip", long, None, "a,b"]).slice(1)
    parent, pos, items = split_packed_array(array)
    assert len(items) == 50_002 and items[49_999].as_py() == "v, 49999" and parent[-1] == 2 and pos[-1] == 2


def test_frame(spark):
    df = spark.createDataFrame([(1, "a,b", "x"), (2, None, "y"), (2, "c", "z"), (3, " ", None), (1, "a,b", "x")], "row_id bigint, item string, pos string")
    got = rows(split_packed(df, "row_id", "item"))
    assert got == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, 1, "c")]
    assert split_packed(df.limit(0), "row_id", "item").count() == 0
    arrays = {r.row_id: r["items"] for r in split_packed_to_array(df.filter("row_id > 1"), "row_id", "item").collect() if r["items"]}
    assert arrays == {2: ["c"]}
