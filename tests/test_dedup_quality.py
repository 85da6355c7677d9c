import random

from pyspark.sql import functions as F

from tessella.operators import dedup, quality
from tessella.sources import files
from tessella.streaming import ingest


def test_places_against_plain_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    got = {(r.g, r.x, r.i): r.place for r in dedup.placed(df, "g", ["x", "i"]).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert [got[r] for r in own] == list(range(1, len(own) + 1))
    assert dedup.rechunk(df.limit(0), "g", ["x"], 10).count() == 0


def test_keep_last_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert {(r.k, r.v, r.first_seen.t) for r in dedup.keep_last(df, "k", ["t"]).collect()} == {("a", None, 1), ("b", "z", 1)}
    assert {(r.k, r.v) for r in dedup.keep_first(df, "k", ["t"]).collect()} == {("a", "x"), ("b", "z")}


def test_depth_against_sorted(spark):
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 9)) for g in "ab" for _ in range(rng.randint(20, 60))]
    for r in quality.depth(spark.createDataFrame(rows, "g string, s int"), "g", F.col("s")).collect():
        own = sorted(s for g, s in rows if g == r.g)
        assert r.p95 == own[int(len(own) * 0.95)] and r.largest == own[-1] and r.median == (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2


def test_state_files(spark, tmp_path):
    assert files.read_state(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").write_text('{"a": [1')
    assert files.read_state(spark, str(tmp_path / "bad")).count() == 0


def test_ingest_is_idempotent_and_keeps_failures(spark, tmp_path):
    put = lambda name, text: (tmp_path / "in").mkdir(exist_ok=True) or (tmp_path / "in" / name).write_text(text)
    schema = "doc_id string, v string, scraped_at timestamp_ntz"
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), schema, lambda d: d, failed=lambda d: d.where("v is null"))
    put("1.json", '{"doc_id":"a","v":"1","scraped_at":"2020-01-01T00:00:00"}\n{"doc_id":"b","scraped_at":"2020-01-01T00:00:00"}\n')
    run()
    put("2.json", '{"doc_id":"a","v":"2","scraped_at":"2020-01-02T00:00:00"}\n{"doc_id":"c","v":"3","scraped_at":"2020-01-01T00:00:00"}\n')
    run()
    run()
    rows = ingest.read(spark, str(tmp_path / "out")).collect()
    assert {(r.doc_id, r.v) for r in rows} == {("a", "2"), ("c", "3")}
    assert {r.doc_id for r in spark.read.json(str(tmp_path / "out" / "retry")).collect()} == {"b"}


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    target = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, scraped_at int, v string")
    assert ingest.read(spark, target) is None
    ingest.upsert(target, make([(f"d{i}", 1, "a") for i in range(40)] + [(None, 1, "x")]), "doc_id", "scraped_at", buckets=8)
    one = ingest.current(spark, target)
    ingest.upsert(target, make([("d3", 2, "b"), ("d3", 0, "c")]), "doc_id", "scraped_at", buckets=8)
    two = ingest.current(spark, target)
    assert (one[0], two[0]) == (1, 2) and sum(one[1][b] != two[1][b] for b in one[1]) == 1
    got = {r.doc_id: r.v for r in ingest.read(spark, target).collect()}
    assert len(got) == 40 and got["d3"] == "b" and got["d4"] == "a"
    ingest.upsert(target, make([("d3", 1, "late")]), "doc_id", "scraped_at", buckets=8)
    ingest.upsert(target, make([]), "doc_id", "scraped_at", buckets=8)
    assert {r.doc_id: r.v for r in ingest.read(spark, target).collect()} == got


def test_batch_is_transformed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def transform(d):
        from pyspark.sql import functions as F

        @F.udf("string")
        def model(x):
            calls.add(1)
            return x

        return d.withColumn("v", model("v"))

    spark.createDataFrame([("a", 1, "x"), ("b", 1, None)], "doc_id string, scraped_at int, v string").coalesce(1).write.json(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), "doc_id string, scraped_at int, v string", transform, failed=lambda d: d.where("v is null"))
    assert calls.value == 2 and [r.doc_id for r in ingest.read(spark, str(tmp_path / "out")).collect()] == ["a"]
