"""Cases where a query once did less than its whole job."""

import datetime as dt
import json
import re
from collections import Counter

import pytest

from tessella.functions.text import LAW_NAMES
from tessella.operators import dedup, models, search
from tessella.plans import audit_queries, search_queries, text_queries
from tessella.sources.corpus import serving


def test_text_search_reads_keywords(spark, tmp_path):
    keys = [None, "predio rustico, muro encravado", "penhora, muro", "predio rustico, penhora"]
    texts = ["prédio rústico encravado", "nada", "prédio rústico encravado", "prédio encravado"]
    rows = [(i, "u", "A", dt.date(2020, 1, 1), f"p{i}", None, False, "t", t, json.dumps({"keywords_search_query": k}) if k else "{bad") for i, (t, k) in enumerate(zip(texts, keys))]
    spark.createDataFrame(rows, "doc_id long, url string, court_short string, decision_date date, process_number string, legal_domain string, is_auj boolean, text string, summary string, metadata string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in search_queries.h10_fts(spark, str(tmp_path)).collect()} == {0, 1}  # 1 by its keywords only; 2 and 3 are excluded by theirs
    request = search.SearchRequest(q="muro", weights={"fts": 1.0})
    for docs in (serving(spark, str(tmp_path)), serving(spark, str(tmp_path)).drop("keywords_search_query")):
        assert {r.doc_id for r in search.search(docs, request).collect()} == {1, 2}


def test_every_rater_has_a_column(spark, tmp_path):
    rows = [(d, f"leitor_{r}", (d + r) % 5 + 1) for d in range(3) for r in range(1, 8) if d < 2 or r == 7]
    labels = spark.createDataFrame([*rows, (9, "leitor_8", None)], "doc_id long, rater string, grade int")
    labels.write.parquet(f"{tmp_path}/reading_labels.parquet")
    got = {(r.doc_id, k, v) for r in audit_queries.j9_pivot(spark, str(tmp_path)).collect() for k, v in r.asDict().items() if k != "doc_id" and v is not None}
    assert got == set(rows)
    with pytest.raises(ValueError):
        models.side_by_side(labels, "doc_id", "rater", "grade", most=7)


def test_completeness_covers_all_documents(spark, tmp_path):
    full, empty = ("s", "q", "o", "v", ["p"], ["i"]), (None, "", None, "", [], None)
    rows = [(f"{i:04}", "TAB", full if i < 100 else empty) for i in range(400)] + [("x", "TAL", full)]
    extracted = "struct<summary: string, legal_question: string, decision_outcome: string, voting: string, parties: array<string>, injuries: array<string>>"
    spark.createDataFrame([*rows, rows[399]], f"doc_id string, court_short string, llm_extracted {extracted}").write.parquet(f"{tmp_path}/enhanced_docs.parquet")
    got = audit_queries.a12_completeness(spark, str(tmp_path)).collect()
    assert len(got) == 12 and {(r.court_short, r.pct, r.mark) for r in got} == {("TAB", 25.0, "poor"), ("TAL", 100.0, "ok")}


def law_name(raw):
    """The plain form of the rules, without regard to Spark."""
    if not raw:
        return raw
    s = re.sub(r",\s*de\s+\d+\s+de\s+\w+(\s+de\s+\d+)?\s*$", "", raw.strip(" "), flags=re.IGNORECASE)
    low = s.lower().strip(" ")
    if name := LAW_NAMES.get(low) or LAW_NAMES.get(low.strip(". ")):
        return name
    for kind, out in ((r"(?:decreto[\s-]?lei|dl)", "Decreto-Lei"), ("lei", "Lei")):
        if m := re.match(kind + r"\s*(?:n[°º.\s]*)?\s*(\d+(?:-[A-Za-z])?/\d+)", s, re.IGNORECASE):
            return f"{out} n.º {m.group(1)}"
    return s


def test_law_table_counts_every_citation(spark, tmp_path):
    laws = ["CPC", "cpc.", "DL 15/93", "Lei 65/2003", "Portaria n.º 1/2001, de 3 de maio", "Regulamento (UE) 2016/679", "Código da Estrada", "Código da Estrada", "lei geral", "", "  ", None]
    spark.createDataFrame([(x,) for x in laws], "law string").write.parquet(f"{tmp_path}/legislation_cited.parquet")
    assert {r["name"]: r.n for r in text_queries.t3_laws(spark, str(tmp_path)).collect()} == {
        "Código de Processo Civil": 2, "Decreto-Lei n.º 15/93": 1, "Lei n.º 65/2003": 1, "Portaria n.º 1/2001": 1, "Regulamento (UE) 2016/679": 1, "Código da Estrada": 2, "lei geral": 1, "": 2,
    }
    folder = "/root/testdata/sf0.01"
    raw = spark.read.parquet(f"{folder}/legislation_cited.parquet").select("law").where("law is not null").collect()
    assert {r["name"]: r.n for r in text_queries.t3_laws(spark, folder).collect()} == Counter(law_name(r.law) for r in raw)


def test_listing_urls_reach_the_last_page(spark, tmp_path):
    counts = {"a": 850, "b": 301, "c": 401, "d": 1, "e": 0, "f": None}
    spark.createDataFrame([(k, k, "v", n) for k, n in counts.items()], "court_short string, db string, view_id string, approx_count long").write.parquet(f"{tmp_path}/court_catalog.parquet")
    got = [r.url for r in text_queries.x7_urls(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(f"https://h.example/{k}/v?OpenView&Start={i}" for k, n in counts.items() for i in range(1, (n or 0) + 1, 100))


def test_keyset_scan_reads_every_page(spark):
    ids = [f"{i * 37 % 100:03}" for i in range(100)]
    pages, last = {}, ""
    while page := sorted(i for i in ids if i > last)[:7]:  # a keyset walk
        pages |= dict.fromkeys(page, len(set(pages.values())))
        last = page[-1]
    rows = spark.createDataFrame([(i,) for i in [*ids, *ids[:30], None]], "doc_id string")
    got = dedup.keyset_pages(rows, "doc_id", 7).collect()
    assert len(got) == 100 and {r.doc_id: r.page for r in got} == pages
