import random
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from corpusloom.operators.orphans import normal_id, orphan_references, orphan_report

T0 = datetime(2024, 1, 1)
REFS = "ref_id bigint, key string, at timestamp_ntz, loaded_at string, uses string"
HELD = "key string, f timestamp_ntz, u timestamp_ntz, at int"


def orphans(spark, refs, held):
    r = spark.createDataFrame([(*x, "clash", "clash") for x in refs], REFS)
    h = spark.createDataFrame([(*x, 1) for x in held], HELD)
    return orphan_references(r, h, key="key", at="at", parent_key="key", valid_from="f", valid_to="u")


def test_normal_id(spark):
    given = ["007", " 7 ", "7.0", "7.00", "0", "000", "-3", "W-1", "", "  ", None, "7.5", "07.50", "+4", "1e3", "\xa08"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given], "i string").select(normal_id(F.col("i"))).collect()]
    assert got == ["7", "7", "7", "7", "0", "0", "-3", "W-1", None, None, None, "7.5", "07.50", "4", "1e3", "8"]


def test_against_every_pair(spark):
    r = random.Random(3)
    day = lambda: T0 + timedelta(hours=r.randint(0, 400))
    held = [(r.choice("abcde"), day(), r.choice([None, day(), day()])) for _ in range(60)] + [(None, T0, None), ("a", None, None)]
    refs = [(i, r.choice("abcdefg"), day()) for i in range(400)] + [(900, None, T0), (901, "a", None)]
    refs += refs[:5]
    want = sorted(i for i, k, t in refs if k and t and not any(h == k and f and f <= t and (u is None or u > t) for h, f, u in held))
    got = orphans(spark, refs, held)
    assert sorted(x.ref_id for x in got.collect()) == want
    assert got.columns == ["ref_id", "key", "at", "loaded_at", "uses", "reason"]


def test_edges(spark):
    # at the moment of loading it is there; at the moment of removal it is not
    refs = [(1, "a", T0), (2, "a", T0 + timedelta(1)), (3, "a", T0 - timedelta(seconds=1)), (4, "b", T0)]
    got = {x.ref_id: x.reason for x in orphans(spark, refs, [("a", T0, T0 + timedelta(1))]).collect()}
    assert got == {2: "removed", 3: "early", 4: "missing"}


def test_empty(spark):
    assert orphans(spark, [], [("a", T0, None)]).count() == 0
    assert [x.reason for x in orphans(spark, [(1, "a", T0)], []).collect()] == ["missing"]


def test_hot_key(spark):
    refs = [(i, "a", T0 + timedelta(minutes=i)) for i in range(3000)] + [(9000 + i, f"k{i}", T0) for i in range(50)]
    held = [("a", T0 + timedelta(hours=2 * i), T0 + timedelta(hours=2 * i + 1)) for i in range(25)]
    got = orphans(spark, refs, held)
    assert got.filter("key = 'a'").count() == 1500
    report = rows(orphan_report(got.withColumn("month", F.lit("m")), "key", "month").filter("key = 'a'"))
    assert report == [("a", "m", 1500, 0, 0, 1500)]
