import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, queries, readability

CORPUS = "doc_id long, source string, text string"


@pytest.fixture
def texts(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "free"]), rng.choice([None, "", *["palavra " * rng.randint(5, 60)] * 8])) for i in range(900)]
    return spark.createDataFrame(rows, CORPUS).repartition(4)


def test_shares_and_caps(spark, texts):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 5), ("none", 0.1, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    copies, plan = mixing.draw(texts, targets)
    report = {r.source: r for r in mixing.share_report(copies, plan).collect()}
    assert report["none"].rate == 0 and report["none"].copies == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert report[s].rate <= report[s].max_repeats and abs(report[s].actual_share - share) < 0.05
    used = copies.groupBy("doc_id", "source").count().collect()
    assert all(r["count"] <= {"a": 1, "b": 3, "c": 5}[r.source] for r in used)
    again = mixing.draw(texts.repartition(2), targets)[0]
    assert sorted(map(tuple, copies.collect())) == sorted(map(tuple, again.collect()))


def test_larger_total_is_capped(spark, texts):
    targets = spark.createDataFrame([("a", 0.5, None), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    copies, plan = mixing.draw(texts, targets, total_tokens=1e9)
    assert {r.source: r.rate for r in plan.collect()} == {"a": 1.0, "b": 2.0}
    assert mixing.draw(texts.limit(0), targets)[0].count() == 0


def test_measure():
    m = dict(zip(readability.FEATURES, readability.measure("Um dois três.\n\nQuatro cinquenta 7 e... Fim 3.5 x")))
    assert m["words_per_sentence"] == 8 / 3 and m["long_share"] == 1 / 8
    assert readability.measure(None) is readability.measure("") is readability.measure("12 34.") is None


def test_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    y = x + rng.normal(size=200)
    knots, values = readability.isotonic(x, y, np.ones(200))
    assert (np.diff(values) >= -1e-12).all() and abs(np.interp(x, knots, values).mean() - y.mean()) < 1e-9


def graded(n, seed):
    rng = random.Random(seed)
    short, long = ["o rei vai", "a mãe viu", "ele foi lá"], ["circunstanciadamente", "fundamentação", "interpretação", "constitucionalidade", "de", "que"]
    rows, labels = [], []
    for i in range(n):
        g = rng.randint(1, 5)
        parts = []
        for _ in range(6):
            parts.append(" ".join(rng.choice(long if rng.random() < g / 6 else ["sol", "mar", "rei", "pão"]) for _ in range(4 + 7 * g)) + ".")
        rows.append((i, " ".join(parts) if g > 1 else ". ".join(rng.choices(short, k=9)) + "."))
        labels.append((i, min(5, max(1, g + rng.choice([0, 0, 0, 1, -1]))), "r"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = graded(300, 1)
    test, truth = graded(200, 2)
    c = spark.createDataFrame(rows, "doc_id long, text string")
    ranker = readability.train(c, spark.createDataFrame(labels, "doc_id long, grade int, rater string"))
    got = {r.doc_id: r.level for r in readability.measured(spark.createDataFrame(test, "doc_id long, text string"), ranker=ranker).collect()}
    assert np.mean([abs(got[d] - g) for d, g, _ in truth]) < 0.8


def test_levels_and_bands(spark):
    rows, labels = graded(120, 3)
    rows += [(900, None), (901, ""), (902, "sol mar. rei vai. pão bom."), (903, " ".join(["constitucionalidade de fundamentação"] * 20) + ".")]
    c, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(900, None, "x"), (5000, 3, "y")], "doc_id long, grade int, rater string")
    levels = readability.reading_levels(c, lab)
    out = {r.doc_id: r.level for r in levels.collect()}
    assert len(out) == len(rows) and out[900] is None and out[901] is None and out[902] < out[903]
    bands = {r.doc_id: r.reading_band for r in readability.extreme_bands(levels).collect()}
    assert bands[902] == "easy" and bands[903] == "hard" and 900 not in bands
    assert all(r.level is None for r in readability.reading_levels(c, lab.where("false")).collect())


def test_few_contrary_grades_do_not_turn_the_ranking(spark):
    rows, _ = graded(60, 5)
    rows += [(902, "sol mar. rei vai. pão bom."), (903, " ".join(["constitucionalidade de fundamentação"] * 20) + ".")]
    c = spark.createDataFrame(rows, "doc_id long, text string")
    contrary = spark.createDataFrame([(902, 4), (903, 2), (1, 3)], "doc_id long, grade int")
    levels = readability.reading_levels(c, contrary)
    score = {r.doc_id: r.score for r in levels.collect()}
    bands = {r.doc_id: r.reading_band for r in readability.extreme_bands(levels).collect()}
    assert score[902] < score[903] and bands[902] == "easy" and bands[903] == "hard"


def test_grades_decide(spark):
    """Above a few grades nothing is assumed: turned grades turn the ranking, shuffled ones lose it."""
    rows, labels = graded(400, 6)
    c = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, grade int, rater string")
    got = readability.held_out(c, lab)
    assert got["tested"] > 150 and got["accuracy"] > 0.85 and got["error"] < 0.8 < got["guess"] and abs(got["shuffled"] - 0.5) < 0.2
    right, turned = readability.train(c, lab), readability.train(c, lab.selectExpr("doc_id", "6 - grade as grade"))
    assert not right.assumed and right.weights @ turned.weights < 0
    assert readability.train(c, lab.limit(20)).assumed
    assert tuple(readability.calibration(readability.reading_levels(c, lab)).first()) == (400, 0, True)


def test_pair_accuracy_against_all_pairs():
    rng = np.random.default_rng(2)
    score, grades = rng.integers(0, 9, 80).astype(float), rng.integers(1, 6, 80).astype(float)
    pairs = [(i, j) for i in range(80) for j in range(80) if grades[i] > grades[j]]
    assert abs(readability.pair_accuracy(score, grades) - np.mean([(score[i] > score[j]) + 0.5 * (score[i] == score[j]) for i, j in pairs])) < 1e-12


def test_caps_count_documents_that_were_not_drawn(spark, tmp_path, monkeypatch):
    docs = [(i, "a" if i < 6 else "b" if i < 9 else "c", "some words of a text " * 5) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 4), ("d", 0.1, 1)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    caps = lambda: {r.source: (r.documents, r.over_cap, r.off_rate) for r in queries.p7_caps(spark, str(tmp_path)).collect()}
    assert caps() == {"a": (6, 0, 0), "b": (3, 0, 0), "d": (0, 0, 0)}
    drawn = mixing.draw

    def faulty(*args, **options):
        copies, plan = drawn(*args, **options)
        extra = copies.where("source = 'a' and doc_id = 1").withColumns({"source": F.lit("b"), "doc_id": F.lit(3).cast("long")})
        return copies.where("doc_id <> 0 and source = 'a'").unionByName(extra), plan

    monkeypatch.setattr(mixing, "draw", faulty)
    # a lost one of its documents, b all three, and b got one of a's
    assert caps() == {"a": (6, 0, 1), "b": (3, 0, 4), "d": (0, 0, 0)}
