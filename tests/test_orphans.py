import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators.orphans import find_orphans, number_key, orphan_report

T0 = dt.datetime(2020, 1, 1)
KIDS = "cite_id long, k string, at timestamp_ntz"
PARENTS = "k string, loaded timestamp_ntz, gone timestamp_ntz"


def day(n, h=0):
    return None if n is None else T0 + dt.timedelta(days=n, hours=h)


def run(spark, kids, parents, **options):
    c, p = spark.createDataFrame(kids, KIDS), spark.createDataFrame(parents, PARENTS)
    return find_orphans(c, p, child_id="cite_id", child_key=F.col("k"), child_time=F.col("at"), parent_key=F.col("k"), loaded=F.col("loaded"), withdrawn=F.col("gone"), **options)


def brute(kids, parents):
    out = set()
    for i, k, at in kids:
        if k is None:
            continue
        when = at or dt.datetime.max
        if not any(p == k and a is not None and a <= when and (b is None or b > when) for p, a, b in parents):
            out.add(i)
    return out


@pytest.mark.parametrize("period", ["day", "month"])
def test_against_brute_force(spark, period):
    rng = random.Random(5)
    parents = [(rng.choice("abcd"), day(rng.randint(0, 40), rng.randint(0, 3)), day(rng.choice([None, rng.randint(0, 60)]))) for _ in range(25)] + [(None, day(0), None), ("e", None, None)]
    kids = [(i, rng.choice(["a", "a", "a", "b", "c", "d", "e", "zz", None]), day(rng.choice([None, *range(70)]), rng.randint(0, 3))) for i in range(300)]
    got = [r.cite_id for r in run(spark, kids + kids[:50], parents, period=period).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(kids, parents)


def test_ties_and_empty(spark):
    parents = [("a", day(1), day(3))]
    assert {r.cite_id for r in run(spark, [(1, "a", day(1)), (2, "a", day(3)), (3, "a", day(0))], parents).collect()} == {2, 3}
    assert {r.cite_id for r in run(spark, [(1, "a", day(1))], []).collect()} == {1}
    assert run(spark, [], parents).count() == 0


def test_number_key(spark):
    values = [" Proc. n.º 12/03.4TB–A ;", "12/03.4tb-a", "(12 / 03 .4TB‑A)", "s/n", "", None, "12 /03.4TB-A.", "7"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(number_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in rows] == ["12/03.4tb-a"] * 3 + [None] * 3 + ["12/03.4tb-a", "7"]


def test_report(spark):
    lost = run(spark, [(1, "a", day(1)), (2, "a", day(2)), (3, "b", day(40)), (4, "c", None)], [])
    rows = {(r.month, r.orphans, r.missing_keys) for r in orphan_report([("kids", "parents", lost)]).collect()}
    assert rows == {("2020-01", 2, 1), ("2020-02", 1, 1), (None, 1, 1)}


def test_clashing_names(spark):
    kids = spark.createDataFrame([(1, "a", day(1), "x")], KIDS + ", period string")
    parents = spark.createDataFrame([("a", day(0), None, 1)], PARENTS + ", cite_id int")
    got = find_orphans(kids, parents, child_id="cite_id", child_key=F.col("k"), child_time=F.col("at"), parent_key=F.col("k"), loaded=F.col("loaded"), withdrawn=F.col("gone"))
    assert got.count() == 0
