"""Queries of the corpus operators (p1, p5, p6, p7, p8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import canonical, leakage, mixing, neardup, readability
from tessella.sources.tables import table


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    """(cite_id, law, law_id) of every delivered citation whose law is typed freely."""
    catalog = table(spark, folder, "law_catalog")
    names = canonical.gazetteer(catalog, key="law_id", name="law_name", short="short_form", kind="law_kind", year="law_year")
    typed = table(spark, folder, "legislation_cited").select("cite_id", "law").where(F.col("law").rlike("(?U)\\S") & ~F.col("law").isin([e[1] for e in names.entries]))
    return typed.withColumn("law_id", canonical.canonical(F.col("law"), names))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mapped(spark, folder).select("cite_id", "law_id").distinct()


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values that mean no entry, with their citations."""
    lost = _mapped(spark, folder).where("law_id = 0").select("cite_id", "law").distinct()
    return lost.groupBy("law").agg(F.count("*").alias("citations"))


def p1_acts(spark: SparkSession, folder: str) -> DataFrame:
    """Of the mapped citations those that write a numbered act in full, which SQL can check."""
    rows = _mapped(spark, folder).where(F.col("law").rlike(_FULL_ACT))
    return rows.select("cite_id", "law_id").distinct()


def p1_clashes(spark: SparkSession, folder: str) -> DataFrame:
    """Ways of writing that several entries of the catalog share."""
    catalog = table(spark, folder, "law_catalog")
    names = canonical.gazetteer(catalog, key="law_id", name="law_name", short="short_form", kind="law_kind", year="law_year")
    return spark.createDataFrame([(k, v) for k, ids in names.clashes() for v in ids], "written string, law_id bigint")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "raw_docs")
    return neardup.duplicate_pairs(*neardup.near_duplicates(texts, doc_id=F.col("doc_id"), text=F.col("full_text"), size=3, threshold=0.6))


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document at the operator's own settings: five words, similarity of 0.8."""
    texts = table(spark, folder, "raw_docs")
    return neardup.link_counts(*neardup.near_duplicates(texts, doc_id=F.col("doc_id"), text=F.col("full_text")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.draw(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_draw(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.share_report(*_mix(spark, folder))


def p7_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Per target source: its documents, and how many were drawn more often than its cap, or less (also not at all) or more than its rate allows."""
    copies, plan = _mix(spark, folder)
    held = table(spark, folder, "documents").select("source", "doc_id", F.lit(1).alias("held"), F.lit(0).alias("drawn"))
    both = held.unionByName(copies.select("source", "doc_id", F.lit(0).alias("held"), F.lit(1).alias("drawn"))).join(F.broadcast(plan.select("source", "rate", "max_repeats")), "source")  # a row per target
    times = both.groupBy("source", "doc_id", "rate", "max_repeats").agg(F.sum("held").alias("held"), F.sum("drawn").alias("n"))
    off = (F.col("n") < F.floor("rate") * F.col("held")) | (F.col("n") > F.ceil("rate") * F.col("held"))
    drawn = times.groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("over_cap"), F.count_if(off).alias("off_rate"))
    return plan.select("source", "documents").join(drawn, "source", "left").fillna(0, ["over_cap", "off_rate"])


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return readability.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return readability.extreme_bands(_levels(spark, folder))


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).select("doc_id", F.round("level", 6).alias("level"))


#: What the ranker must reach on documents it has not seen, once ENOUGH of them are graded; shuffled grades must fail it.
LEAST_ACCURACY, MOST_ERROR, ENOUGH = 0.65, 0.8, 30


def p8_heldout(spark: SparkSession, folder: str) -> DataFrame:
    """The ranker fitted on half of the graded documents and tested on the rest: whether it reaches the floors, and shuffled grades do not."""
    x = readability.held_out(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))
    enough = x["tested"] >= ENOUGH
    passed = (x["accuracy"] >= LEAST_ACCURACY, x["error"] <= MOST_ERROR and x["error"] < x["guess"], x["shuffled"] < LEAST_ACCURACY)
    row = (int(x["tested"]), *[bool(v) if enough else None for v in passed])
    return spark.createDataFrame([row], "tested bigint, ordered boolean, graded boolean, shuffled_fails boolean")


def p8_calibration(spark: SparkSession, folder: str) -> DataFrame:
    return readability.calibration(_levels(spark, folder))


def queries() -> dict:
    return {
        "p1_acts": p1_acts, "p1_clashes": p1_clashes, "p7_caps": p7_caps, "p8_heldout": p8_heldout, "p8_calibration": p8_calibration,
        "p1_found": p1_found, "p1_unmatched": p1_unmatched, "p5_found": p5_found, "p5_links": p5_links, "p6_found": p6_found, "p6_spans": p6_spans, "p7_draw": p7_draw, "p7_shares": p7_shares,
        "p8_found": p8_found, "p8_levels": p8_levels,
    }


_FULL_ACT = r"^(Lei|Decreto-Lei|Decreto Regulamentar|Portaria) (n\.º )?[0-9]+(-[A-Z])?/[0-9]{4}$"
_SHINGLES = """
w as (select distinct doc_id, regexp_extract_all(lower(full_text), '[\\p{L}\\p{N}]+') as w from raw_docs where doc_id is not null),
s as (select distinct doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from w where len(w) >= 3),
n as (select doc_id, count(*) as n from s group by 1)
"""


# Classes of equal shingle sets (five words), their members, and their shingles.
_FIVE = """
w as (select distinct doc_id, regexp_extract_all(lower(full_text), '[\\p{L}\\p{N}]+') as w from raw_docs where doc_id is not null),
k as (select doc_id, list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) as k from w where len(w) >= 5),
m as (select distinct doc_id, md5(array_to_string(k, '|')) as id from k),
s as (select distinct md5(array_to_string(k, '|')) as id, unnest(k) as s from k),
n as (select c.id, c.n, d.copies, d.class_id from (select id, count(*) as n from s group by 1) c join (select id, count(*) as copies, min(doc_id) as class_id from m group by 1) d on d.id = c.id)
"""


# Equal windows at one shift that follow each other are one run; runs that overlap or touch are one span.
_SPANS = """
with d as ({d}), e as ({e}),
h as (select distinct doc_id, item_id, d.p as i, d.p - e.p as shift from d join e on d.g = e.g),
r as (select doc_id, item_id, min(i) - 1 as a, max(i) + 11 as b from (select *, i - row_number() over (partition by doc_id, item_id, shift order by i) as run from h) group by doc_id, item_id, shift, run),
m as (select *, case when a <= max(b) over (partition by doc_id, item_id order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from r),
s as (select *, sum(new) over (partition by doc_id, item_id order by a, b rows unbounded preceding) as span from m)
select doc_id, item_id, min(a)::int as first_word, (max(b) - 1)::int as last_word, max(b - a)::int as longest from s group by doc_id, item_id, span
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose definition it can state; the others are tested against brute force."""
    fold = "regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"
    windows = "select distinct {k}, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) as g from (select {k}, {f} as w from {t}) where len(w) >= 12"
    places = "select {k}, unnest(generate_series(1, len(w) - 11)) as p, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) as g from (select {k}, {f} as w from {t}) where len(w) >= 12"
    letters = "len(regexp_extract_all({c}, '\\p{{L}}+'))"
    act = _FULL_ACT.replace("(n", "(?:n").replace("[0-9]+(-[A-Z])?/[0-9]{4}", "([0-9]+(?:-[A-Z])?/[0-9]{4})")
    kind = lambda c: f"regexp_extract({c}, '{act}', 1) || ' ' || regexp_extract({c}, '{act}', 2)"
    five = _FIVE
    return {
        "p1_acts": f"select distinct cite_id, coalesce(l.law_id, 0) as law_id from (select * from legislation_cited where regexp_matches(law, '{_FULL_ACT}') and law not in (select law_name from law_catalog)) c left join law_catalog l on l.law_year is not null and {kind('l.law_name')} = {kind('c.law')}",
        "p5_links": f"with {five}, p as (select a.id as x, b.id as y from s a join s b on a.s = b.s and a.id < b.id join n u on u.id = a.id join n v on v.id = b.id group by a.id, b.id, u.n, v.n having count(*) >= 0.8 * (u.n + v.n - count(*))), l as (select id, count(*) as links from (select x as id from p union all select y from p) group by 1) select m.doc_id, n.class_id, n.copies, coalesce(l.links, 0) as links from m join n on n.id = m.id left join l on l.id = m.id",
        "p7_caps": "select t.source, count(d.doc_id) as documents, 0::bigint as over_cap, 0::bigint as off_rate from mix_targets t left join documents d on d.source = t.source group by 1",
        "p8_calibration": "select count(*) as documents, count(*) filter (not coalesce(regexp_matches(text, '\\p{L}'), false)) as without_level, true as rising from documents",
        "p8_heldout": f"with g as (select distinct l.doc_id from reading_labels l join documents d on d.doc_id = l.doc_id where grade is not null and regexp_matches(d.text, '\\p{{L}}')), t as (select count(*) filter (md5(doc_id::varchar)[1] >= '8') as tested from g) select tested, case when tested >= {ENOUGH} then true end as ordered, case when tested >= {ENOUGH} then true end as graded, case when tested >= {ENOUGH} then true end as shuffled_fails from t",
        "p5_found": f"with {_SHINGLES} select a.doc_id as doc_id_a, b.doc_id as doc_id_b from s a join s b on a.s = b.s and a.doc_id < b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having count(*) >= 0.6 * (x.n + y.n - count(*))",
        "p6_found": f"with d as ({windows.format(k='doc_id', f=fold.format(c='text'), t='documents')}), e as ({windows.format(k='item_id', f=fold.format(c='text'), t='eval_items')}) select distinct doc_id, item_id from d join e on d.g = e.g",
        "p6_spans": _SPANS.format(d=places.format(k="doc_id", f=fold.format(c="text"), t="documents"), e=places.format(k="item_id", f=fold.format(c="text"), t="eval_items")),
        "p8_found": f"with m as (select doc_id, {letters.format(c='text')} as n, len(regexp_extract_all(text, '\\p{{L}}{{7,}}')) as l, len(list_filter(regexp_split_to_array(text, '[.!?…]+(\\s|$)|\\n[^\\S\\n]*\\n|\\r\\n[^\\S\\n]*\\r\\n'), lambda p: regexp_matches(p, '\\p{{L}}'))) as s from documents), b as (select doc_id, case when n <= 12 * s and l <= 0.3 * n then 'easy' when n >= 30 * s and l >= 0.4 * n then 'hard' end as reading_band from m where n > 0) select * from b where reading_band is not null",
    }
