"""Corpus queries whose rows SQL can't state, against plain models on the smallest test data."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessella.llm import mixing, queries
from tessella.llm.words import repair, words

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


def rows(sql):
    return duckdb.sql(sql.replace("{d}", FOLDER)).fetchall()


def test_spans(spark):
    """Every span is a run of the item's words or several that overlap, and no longer run is missed."""
    items = {i: words(repair(t)) for i, t in rows("select item_id, text from '{d}/eval_items.parquet' where text is not null")}
    grams: dict = {}
    for i, w in items.items():
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want: dict = {}
    for d, t in rows("select doc_id, text from '{d}/documents.parquet' where text is not null"):
        w = words(repair(t))
        for k in range(len(w) - 11):
            for i in grams.get(tuple(w[k : k + 12]), ()):
                want.setdefault((d, i), set()).update(range(k, k + 12))
    got: dict = {}
    for r in queries.p6_spans(spark, FOLDER).collect():
        assert 12 <= r.longest <= r.last_word - r.first_word + 1
        got.setdefault((r.doc_id, r.item_id), set()).update(range(r.first_word, r.last_word + 1))
    assert got == want


def test_shares(spark):
    with open(mixing.VOCABULARY, "rb") as file:
        encode = mixing.encoder(file.read()).encode_ordinary
    held, count = Counter(), Counter()
    for source, text in rows("select source, text from '{d}/documents.parquet' where source is not null"):
        held[source] += len(encode(text)) if text else 0
        count[source] += 1
    targets = {s: (share, cap) for s, share, cap in rows("select source, target_share, max_repeats from '{d}/mix_targets.parquet'")}
    usable = {s for s, (share, cap) in targets.items() if held[s] and share and cap}
    whole = sum(targets[s][0] for s in usable)
    size = min(targets[s][1] * held[s] * whole / targets[s][0] for s in usable)
    got = {r.source: r for r in queries.p7_shares(spark, FOLDER).collect()}
    assert set(got) == set(targets)
    for s, r in got.items():
        rate = round(min(size * targets[s][0] / whole / held[s], targets[s][1]), 9) if s in usable else 0
        assert (r.tokens, r.documents) == (held[s], count[s]) and abs(r.rate - rate) < 1e-8
        assert int(rate) * count[s] <= r.copies <= -(-rate // 1) * count[s]
    drawn = Counter()
    for r in queries.p7_draw(spark, FOLDER).collect():
        drawn[r.source] += r.tokens
    assert {s: r.drawn_tokens for s, r in got.items() if r.drawn_tokens} == +drawn


def test_unmatched_are_the_rest(spark):
    laws = dict(rows("select cite_id, any_value(law) from '{d}/legislation_cited.parquet' group by 1"))
    found = {r.cite_id: r.law_id for r in queries.p1_found(spark, FOLDER).collect()}
    known = {n for (n,) in rows("select law_name from '{d}/law_catalog.parquet'")}
    assert set(found) == {c for c, v in laws.items() if v is not None and v.strip() and v not in known}
    assert {r.law: r.citations for r in queries.p1_unmatched(spark, FOLDER).collect()} == Counter(laws[c] for c, i in found.items() if i == 0)


def test_levels(spark):
    levels = {r.doc_id: r.level for r in queries.p8_levels(spark, FOLDER).collect()}
    assert set(levels) == {d for (d,) in rows("select doc_id from '{d}/documents.parquet'")} and all(v is None or 1 <= v <= 5 for v in levels.values())
    assert queries.p1_clashes(spark, FOLDER).count() == 0
