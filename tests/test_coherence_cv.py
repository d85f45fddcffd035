import math
import random

import pytest

from corpusloom.operators.coherence_cv import coherence_cv, window_presence


def plainly(docs, topics, size):
    windows = [set(d[i : i + size]) for d in docs if d for i in range(max(1, len(d) - size + 1))]
    n = len(windows)
    out = {}
    for t, ws in topics.items():
        count = lambda *x: sum(all(w in s for w in x) for s in windows)

        def v(a, b):
            c = count(a, b)
            if c >= n:
                return 1.0
            if not count(a) or not count(b):
                return 0.0
            p = c / n + 1e-12
            return math.log(p / (count(a) / n * count(b) / n)) / -math.log(p)

        m = {a: [v(a, b) for b in ws] for a in ws}
        total = [sum(m[a][j] for a in ws) for j in range(len(ws))]
        cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)) if any(x) and any(y) else 0.0
        out[t] = sum(cos(m[a], total) for a in ws) / len(ws)
    return n, out


def test_against_loops(spark):
    r = random.Random(3)
    docs = [[r.choice("abcdefghij") for _ in range(r.choice([0, 1, 4, 30]))] for _ in range(40)] + [None]
    topics = {0: "abc", 1: "dzj"}
    n, want = plainly(docs, topics, 6)
    d = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "k int, ws array<string>").repartition(3)
    t = spark.createDataFrame([(k, w) for k, ws in topics.items() for w in ws], "topic int, word string")
    assert window_presence(d, "ws", t, 6)[1] == n
    got = {x.topic: x.coherence for x in coherence_cv(d, "ws", t, "topic", 6).collect()}
    assert got == pytest.approx(want)
    assert [x.coherence for x in coherence_cv(d.limit(0), "ws", t, "topic").collect()] == pytest.approx([0.0, 0.0])
