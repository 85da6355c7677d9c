import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import facets, fts, search
from tessella.operators.filters import Filters, has_key


def rrf(lists, weights, k):
    scores, ranks = {}, {}
    for s, hits in lists.items():
        if weights.get(s, 0) > 0:
            for r, d in enumerate(hits, 1):
                scores[d] = scores.get(d, 0) + weights[s] / (k + r)
                ranks.setdefault(d, {})[s] = r
    return scores, ranks


@pytest.mark.parametrize("k", [1, 50])
def test_fusion_against_plain_model(spark, k):
    rng = random.Random(k)
    lists = {s: rng.sample(range(30), 12) for s in search.SOURCES}
    weights = {"embedding": 2.0, "embedding_context": 1.0, "embedding_ratio": 0.0, "fts": 0.5}
    ranked = None
    for s, ids in lists.items():
        one = search.ranked_list(s, spark.createDataFrame([(d, 1 - i / 100) for i, d in enumerate(ids)], "doc_id long, score double"))
        ranked = one if ranked is None else ranked.unionByName(one)
    got = {r.doc_id: (round(r.score, 9), r.ranks) for r in search.fuse(ranked, weights, k).collect()}
    scores, ranks = rrf(lists, weights, k)
    assert got == {d: (round(v, 9), ranks[d]) for d, v in scores.items()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        v = [[rng.gauss(0, 1) for _ in range(4)] if rng.random() > 0.2 else None for _ in range(3)]
        rows.append((i, f"u{i}", rng.choice(["A", "B"]), dt.date(2020, 1, 1 + i % 28), f"p{i}", rng.choice(["Direito Civil", None]), rng.choice([True, False, None]), rng.choice(["prédio rústico encravado", "muro e predios", "nada", None]), "{}", None, None, *v))
    return spark.createDataFrame(rows, "doc_id long, url string, court_short string, decision_date date, process_number string, legal_domain string, is_auj boolean, summary string, metadata string, decision_type string, extraction_confidence string, embedding array<double>, embedding_context array<double>, embedding_ratio array<double>")


def test_modes(docs):
    q = [1.0, 0.5, 0.0, -1.0]
    r = search.SearchRequest(q="prédio", limit=10)
    rows = search.search(docs, r, vector=q).collect()
    assert len(rows) == 10 and [x.place for x in rows] == list(range(1, 11))
    assert all(a.hybrid_score >= b.hybrid_score for a, b in zip(rows, rows[1:]))
    semantic = search.search(docs, search.SearchRequest(q="x", weights={"embedding": 1.0}), "semantic", vector=q).collect()
    assert all(x.hybrid_score is None and x.fts_rank is None for x in semantic)
    text = search.search(docs, r, "fts").collect()
    assert all(x.similarity_scores is None and x.fts_rank > 0 for x in text)


def test_filter_commutes_and_zero_weight(docs):
    q = [1.0, 0.5, 0.0, -1.0]
    f = Filters(court=("A",), date_to=dt.date(2020, 1, 20))
    ids = lambda rows: [x.doc_id for x in rows.collect()]
    r = search.SearchRequest(q="prédio", filters=f)
    assert ids(search.search(docs, r, vector=q)) == ids(search.search(docs.where(f.predicate()), search.SearchRequest(q="prédio"), vector=q))
    no_text = {s: 1.0 for s in search.VECTOR_FIELDS} | {"fts": 0.0}
    assert ids(search.search(docs, search.SearchRequest(q="x", weights=no_text), vector=q)) == ids(search.search(docs, search.SearchRequest(q="x"), "semantic", vector=q))


def test_validation():
    for bad in ({"limit": 0}, {"limit": 101}, {"rrf_k": 0}, {"overfetch": 21}, {"weights": {"embedding": 11}}):
        with pytest.raises(ValueError):
            search.SearchRequest(q="x", **bad)
    r = search.SearchRequest(q="x", q_semantic="")
    with pytest.raises(ValueError):
        r.texts(["embedding"])
    assert r.texts(["fts"]) == ("", "x")
    with pytest.raises(ValueError):
        search.SearchRequest(q="x", weights={}).enabled("hybrid")


def test_filters(spark):
    rows = spark.createDataFrame([(1, "100%", True), (2, "100 por cento", None), (3, None, False)], "doc_id long, legal_domain string, is_auj boolean")
    ids = lambda f: {r.doc_id for r in rows.where(f.predicate()).collect()}
    assert ids(Filters()) == ids(Filters(court=(), legal_domain="")) == {1, 2, 3}
    assert ids(Filters(legal_domain="1_0")) == {1, 2} and ids(Filters(is_auj=False)) == {3}
    j = spark.createDataFrame([('{"a":null}',), ('{"b":1}',), ("{bad",), (None,)], "m string")
    assert [r.x for r in j.select(has_key(F.col("m"), "a").alias("x")).collect()] == [True, False, False, False]


def test_text_rank():
    at = lambda t: {x: [p for y, p in fts.lexemes(t) if y == x] for x, _ in fts.lexemes(t)}
    q = fts.parse("prédio rústico")
    near, far, twice = (fts.score(q, at(t)) for t in ("prédio rústico", "prédio que fica no campo rústico", "prédio rústico prédio rústico"))
    assert twice > near > far > 0 and fts.score(q, at("prédio urbano")) is None
    assert fts.score(fts.parse("muro OR prédio"), at("prédios")) and fts.score(fts.parse("prédio -muro"), at("muro prédio")) is None
    assert fts.score(fts.parse('"prédio rústico"'), at("rústico prédio")) is None and fts.parse("").alternatives == ()


def test_facets(spark):
    d = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "court_short string")
    assert [(r.value, r["count"]) for r in facets.value_counts(d, "court_short").collect()] == [("A", 2), ("B", 1)]
    now = [0.0]
    cache, calls = facets.TtlCache(10, lambda: now[0]), []
    make = lambda: calls.append(1) or len(calls)
    assert (cache.get("k", make), cache.get("k", make)) == (1, 1)
    now[0] = 10
    assert cache.get("k", make) == 2
    with pytest.raises(ValueError):
        facets.domains(d, limit=0)


def test_phrase_words_stand_at_exact_distances():
    at = lambda t, stemmed=True: {x: [p for y, p in fts.lexemes(t, stemmed) if y == x] for x, _ in fts.lexemes(t, stemmed)}
    hit = lambda q, t: fts.score(fts.parse(q), at(t)) is not None
    assert hit('"prédio rústico"', "o prédio, rústico!") and not hit('"prédio rústico"', "prédio muito grande rústico") and not hit('"prédio rústico"', "prédio grande rústico")
    assert hit('"recurso de revista"', "um recurso de revista") and hit('"recurso de revista"', "recurso da revista") and not hit('"recurso de revista"', "recurso revista")
    assert hit("prédio-rústico", "prédio rústico") and not hit('-"prédio rústico"', "prédio rústico") and hit('-"prédio rústico"', "rústico prédio")


def test_index_agrees_with_scan(spark, tmp_path):
    rng = random.Random(8)
    words = ["prédio", "rústico", "muro", "de", "obra", "obras", "licença", "o", "prazo"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))) if i % 9 else None) for i in range(150)] + [(900, "muro " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, t string").repartition(3)
    fts.write_index(docs, F.col("t"), str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    kept = docs.where("doc_id % 2 = 0")
    for q in ("muro", '"prédio rústico" OR obra -prazo', "licença de obras", "-muro", '"muro de obra" OR -prédio', "xyz", "", "de"):
        for some in (None, kept):
            want = sorted(map(tuple, fts.ranked(docs if some is None else some, F.col("t"), q, None).collect()))
            assert sorted(map(tuple, fts.ranked_by_index(index, q, None, kept=some, ids=docs.where("t is not null")).collect())) == want
    capped = [r.doc_id for r in fts.ranked_by_index(index, "muro", None, cap=3).collect()]
    assert sorted(capped) == sorted(r.doc_id for r in fts.ranked(docs, F.col("t"), "muro", None).collect())[:3]
    with pytest.raises(ValueError):
        fts.ranked_by_index(index, "-muro", None)


def vectors(n, groups, seed, dim=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return [(i, s, (middle[i % groups] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n) for s in search.VECTOR_FIELDS]


def test_vector_ranking_against_plain_model(spark):
    rows = vectors(300, 5, 1) + [(900, "embedding", None), (901, "embedding", [0.0] * 16), (902, "embedding", [1.0]), (903, "embedding", [None] * 16)]
    rows += [(950, s, rows[0][2]) for s in search.VECTOR_FIELDS]  # a tie
    df = spark.createDataFrame(rows, "doc_id long, source string, vector array<double>").repartition(4)
    q = rows[0][2]
    cos = lambda v: round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 7)
    for r, want in ((search.vector_lists(df, ["embedding", "embedding_ratio"], q, 7), ("embedding", "embedding_ratio")),):
        got = {(x.source, x.rank): (x.doc_id, x.score) for x in r.collect()}
        for s in want:
            best = sorted(((-cos(v), d) for d, t, v in rows if t == s and v and len(v) == 16 and None not in v and any(v)))[:7]
            assert [got[(s, i)] for i in range(1, 8)] == [(d, -c) for c, d in best]
    assert search.vector_lists(df.limit(0), ["embedding"], q, 3).count() == 0


def test_vector_index_prunes_and_fills(spark, tmp_path):
    """On clustered vectors two of sixteen lists hold the nearest; under a filter lists are added until the limit is filled."""
    rows = vectors(1600, 16, 3)
    df = spark.createDataFrame(rows, "doc_id long, source string, vector array<double>")
    index = search.VectorIndex.build(df, str(tmp_path / "v"), 16, 2)
    assert index.rows.count() == len(rows)
    hits = 0
    for d in range(0, 1600, 100):
        q = rows[3 * d][2]
        exact = {(r.source, r.doc_id) for r in search.vector_lists(df, list(search.VECTOR_FIELDS), q, 10).collect()}
        hits += len(exact & {(r.source, r.doc_id) for r in index.lists(list(search.VECTOR_FIELDS), q, 10).collect()})
    assert hits / (16 * 30) >= 0.9
    assert "PartitionFilters: [list" in index.near(rows[0][2], 2)._jdf.queryExecution().toString()
    kept = df.where("doc_id % 16 = 5").select("doc_id").distinct()
    got = index.lists(["embedding"], rows[0][2], 60, kept).collect()
    assert len(got) == 60 and all(r.doc_id % 16 == 5 for r in got)


def test_hybrid_plan_joins_once_per_need(spark):
    from tessella.plans import search_queries

    plan = search_queries.h8_hybrid(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4
