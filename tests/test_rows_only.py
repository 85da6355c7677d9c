"""Queries whose rows SQL can't state, against plain models on the smallest test data."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tessella.functions.articles import CONTEXTS, expand_clean, spell
from tessella.operators import fts, search
from tessella.plans import audit_queries, data_queries, search_queries, text_queries
from tests.test_whole import law_name

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


def rows(sql):
    return duckdb.sql(sql.replace("{d}", FOLDER)).fetchall()


def normalized(cited):
    """One document's legislation by a loop: (article, law) -> context, in order of first appearance."""
    out: dict = {}
    for _, article, law, context in sorted(cited, key=lambda c: c[0]):
        ctx = (context or "referencing").strip().lower()
        ctx = ctx if ctx in CONTEXTS else "referencing"
        for place in (expand_clean(spell((article or "").strip(" "))) if article and article.strip(" ") else []) or [""]:
            key = (place, law_name((law or "").strip(" ")))
            if key not in out or CONTEXTS[ctx] > CONTEXTS[out[key]]:
                out[key] = ctx
    return [(*k, v, i) for i, (k, v) in enumerate(out.items(), 1)]


def test_legislation_table(spark):
    cited: dict = {}
    for doc, _, *rest in rows("select distinct doc_id, cite_id, pos, article, law, citation_context from '{d}/legislation_cited.parquet'"):
        cited.setdefault(doc, []).append(tuple(rest))
    want = {(d, *r) for d, own in cited.items() for r in normalized(own)}
    got = [(r.doc_id, r.article, r.law, r.citation_context, r.place) for r in text_queries.t7_legislation(spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_places_and_residual(spark):
    made = [p for (a,) in rows("select article from '{d}/legislation_cited.parquet' where article is not null") for p in expand_clean(spell(a))]
    r = text_queries.t5_places(spark, FOLDER).first()
    assert r.places == len(made)
    import re

    rest = Counter(p for p in made if not re.search(audit_queries.CANONICAL, p))
    want = sorted(rest.items(), key=lambda x: (-x[1], x[0]))[:25]
    assert [(x.place, x.n) for x in audit_queries.a23_residual(spark, FOLDER).collect()] == want and r.canonical_after == len(made) - sum(rest.values())


def test_legislation_audit(spark):
    cited: dict = {}
    for doc, own in rows("select doc_id, any_value(llm_extracted.legislation_cited) from '{d}/enhanced_docs.parquet' where llm_extracted is not null group by 1"):
        for i, c in enumerate(own or []):
            if c is not None:
                cited.setdefault(doc, []).append((i, c["article"], c["law"], c["citation_context"]))
    before, after = [c for own in cited.values() for c in own], [n for own in cited.values() for n in normalized(own)]
    got = {r.stage: r for r in audit_queries.a23_audit(spark, FOLDER).collect()}
    assert got["before"].entries == len(before) and got["after"].entries == len(after)
    assert got["before"].laws == len({c[2] for c in before if c[2] is not None}) and got["after"].laws == len({n[1] for n in after})


def searched():
    sql = "select doc_id, concat_ws(' ', summary, legal_domain, process_number, case when json_valid(metadata) then metadata->>'keywords_search_query' end), decision_date from '{d}/documents.parquet'"
    out = {}
    for doc, text, day in rows(sql):
        at: dict = {}
        for x, p in fts.lexemes(text or ""):
            at.setdefault(x, []).append(p)
        out[doc] = (at, day)
    return out


def ranked(scores):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def test_text_search(spark):
    query = fts.parse(search_queries.PHRASE.q_keywords)
    want = ranked({d: s for d, (at, _) in searched().items() if (s := fts.score(query, at)) is not None})[:50]
    got = [(r.doc_id, r.fts_rank) for r in search_queries.h10_fts(spark, FOLDER).orderBy("place").collect()]
    assert got == [(d, round(s, 4)) for d, s in want]


def test_hybrid_search(spark):
    request, docs = search_queries.HYBRID, searched()
    kept = {d for d, (_, day) in docs.items() if day is not None and day >= request.filters.date_from}
    query = fts.parse(request.q)
    vectors = {i: np.array(v, float) for i, v in rows("select vec_id, embedding from '{d}/embeddings.parquet'")}
    q = np.round(vectors[search_queries.QUERY_VECTOR], 7)
    lists = {}
    for name, (a, b) in search.VECTOR_FIELDS.items():
        own = {d: vectors[(d * a + b) % 997] for d in kept if (d * a + b) % 997 in vectors}
        lists[name] = ranked({d: round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 7) for d, v in own.items()})[:80]
    lists["fts"] = ranked({d: s for d in kept if (s := fts.score(query, docs[d][0])) is not None})[:80]
    total, first = Counter(), {}
    for place, s in enumerate(search.SOURCES):
        for rank, (d, _) in enumerate(lists[s], 1):
            total[d] += 1 / (50 + rank)
            first.setdefault(d, (place, rank))
    want = sorted(total, key=lambda d: (-round(total[d], 12), first[d]))[:20]
    got = search_queries.h8_hybrid(spark, FOLDER).orderBy("place").collect()
    assert [r.doc_id for r in got] == want and [r.hybrid_score for r in got] == [round(total[d], 6) for d in want]


def test_small_reports(spark):
    got = {r.stage: (r.files, r.bytes) for r in audit_queries.a17_sizes(spark, FOLDER).collect()}
    assert got == {n: (1, os.path.getsize(f"{FOLDER}/{n}.parquet")) for n in ("raw_docs", "enhanced_docs", "documents")}
    sample = [r.doc_id for r in audit_queries.tk7_sample(spark, FOLDER).collect()]
    assert len(set(sample)) == 10 and sample == [r.doc_id for r in audit_queries.tk7_sample(spark, FOLDER).collect()]


def test_all_values_of_packed_fields(spark):
    from tessella.operators.packed import split_locators, split_phrases

    want = {("article", str(k), i, x) for k, v in rows("select distinct cite_id, article from '{d}/legislation_cited.parquet'") if len(own := split_locators(v)) > 1 for i, x in enumerate(own, 1)}
    want |= {("keywords_search_query", k, i, x) for k, v in rows("select distinct doc_id, llm_extracted.keywords_search_query from '{d}/enhanced_docs.parquet'") if len(own := split_phrases(v)) > 1 for i, x in enumerate(own, 1)}
    got = [(r.field_name, r.rec_key, r.val_pos, r.val) for r in data_queries.p4_found(spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want
