"""Queries over references, nested records and packed fields (p2, p3, p4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import nested, orphans, packed
from tessella.session import shared_dir
from tessella.sources.tables import table

READ_EXHIBIT = "ref string, pages int"


def _lost_citations(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.find_orphans(
        table(spark, folder, "jurisprudence_cited"), table(spark, folder, "documents"), child_id="cite_id", child_key=orphans.number_key(F.col("process_number")), child_time=F.col("cited_at"),
        parent_key=orphans.number_key(F.col("process_number")), loaded=F.col("loaded_at"), withdrawn=F.col("withdrawn_at"),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _lost_citations(spark, folder).select("cite_id")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per referring table and month: cited decisions, and citations whose own document is missing."""
    docs = table(spark, folder, "documents")
    parts = [("jurisprudence_cited.process_number", "documents", _lost_citations(spark, folder))]
    for name in ("legislation_cited", "jurisprudence_cited"):
        lost = orphans.find_orphans(table(spark, folder, name), docs, child_id="cite_id", child_key=F.col("doc_id"), child_time=F.col("cited_at"), parent_key=F.col("doc_id"), loaded=F.col("loaded_at"), withdrawn=F.col("withdrawn_at"))
        parts.append((f"{name}.doc_id", "documents", lost))
    return orphans.orphan_report(parts)


def _children(spark: SparkSession, folder: str) -> DataFrame:
    """The tagged table of all children of both record tables, with parents and payload."""
    docs = nested.flatten(table(spark, folder, "documents"), "documents", F.col("doc_id"), F.col("metadata"))
    enhanced = table(spark, folder, "enhanced_docs")
    content = nested.struct_as_json("llm_extracted", enhanced.schema["llm_extracted"].dataType)
    # documents are unique; enhanced rows are delivered more than once
    return docs.unionByName(nested.distinct_children(nested.flatten(enhanced, "enhanced_docs", F.col("doc_id"), content)))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _children(spark, folder).select("rec_table", "rec_key", "child_path", "child_pos")


def p3_exhibits(spark: SparkSession, folder: str) -> DataFrame:
    """One typed child table: the exhibits of timeline events, with the keys of their parents."""
    rows = nested.with_schema(_children(spark, folder), "timeline_events.exhibits", READ_EXHIBIT)
    return rows.select("rec_table", "rec_key", "parent_path", "parent_pos", "child_pos", "ref", "pages")


def p3_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every child table written, partitioned by its tag, and read back: its rows, its records, and the rows that have a parent row."""
    path = f"{shared_dir(spark)}/tessella/children-{uuid.uuid4().hex}"
    nested.write_children(_children(spark, folder), path)
    back = spark.read.schema(nested.TAGGED).parquet(path)
    per_record = back.groupBy("rec_table", "child_path", "rec_key").agg(F.count("*").alias("n"), F.count_if(F.col("parent_path") != "").alias("p"))
    return per_record.groupBy("rec_table", "child_path").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_records"), F.sum("p").alias("with_parent"))


def p3_refused(spark: SparkSession, folder: str) -> DataFrame:
    """Records that yield nothing since their content is missing or no JSON as a whole."""
    return nested.invalid(table(spark, folder, "documents"), "documents", F.col("metadata"))


def _keywords(spark: SparkSession, folder: str) -> DataFrame:
    return packed.unpack(table(spark, folder, "enhanced_docs"), "keywords_search_query", F.col("doc_id"), F.col("llm_extracted.keywords_search_query"), packed.split_phrases)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    articles = packed.unpack_ranges(table(spark, folder, "legislation_cited"), "article", F.col("cite_id"), F.col("article"))
    return _keywords(spark, folder).unionByName(articles)


_KEY = r"replace(lower(regexp_replace(regexp_replace(regexp_extract({c}, '(?s)\p{{Nd}}(?:.*[\p{{L}}\p{{N}}])?'), '[\s\p{{Z}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]+', '', 'g'), '[\p{{Pd}}\x{{2212}}\x{{00AD}}]', '-', 'g')), ' ', '')"
_LOST = f"""
select distinct c.cite_id, c.key, c.cited_at from (select cite_id, cited_at, {_KEY.format(c="process_number")} as key from jurisprudence_cited) c
where c.key <> '' and not exists (
  select 1 from (select {_KEY.format(c="process_number")} as key, loaded_at, withdrawn_at from documents) d
  where d.key = c.key and d.loaded_at <= c.cited_at and (d.withdrawn_at is null or d.withdrawn_at > c.cited_at))
"""
_LOST_DOC = """
select distinct c.cite_id, cast(c.doc_id as varchar) as key, c.cited_at from {t} c
where c.doc_id is not null and not exists (
  select 1 from documents d where d.doc_id = c.doc_id and d.loaded_at <= c.cited_at and (d.withdrawn_at is null or d.withdrawn_at > c.cited_at))
"""
_COUNT = "select '{r}' as ref_table, 'documents' as parent_table, strftime(cited_at, '%Y-%m') as month, count(*) as orphans, count(distinct key) as missing_keys from ({q}) group by all"


# The children of p3, level by level: a node is a JSON value with its path, place and whether it is an element of a list.
_LISTS = "(" + ", ".join(f"'{n}'" for n in nested.LIST_FIELDS) + ")"
_HELD = "case when json_type({x}) = 'VARCHAR' and json_valid({x}->>'$') and json_type(({x}->>'$')::json) in ('OBJECT', 'ARRAY', 'VARCHAR') then ({x}->>'$')::json else {x} end"
_OPENED = _HELD.format(x=f"({_HELD.format(x='({x})')})")
_CHILDREN = f"""
with recursive records as (
  select 'documents' as rec_table, doc_id::varchar as rec_key, metadata::json as v from documents where json_valid(metadata)
  union select 'enhanced_docs', doc_id, to_json(llm_extracted)::json from enhanced_docs where llm_extracted is not null),
node(rec_table, rec_key, path, pos, parent_path, element, v) as (
  select rec_table, rec_key, '', '', '', false, {_OPENED.format(x='v')} from records
  union all
  select rec_table, rec_key, path, pos, parent_path, element, v from (
    select rec_table, rec_key, path, pos || case when pos = '' then '' else '.' end || i as pos, parent_path, true as element, {_OPENED.format(x="json_extract(v, '$[' || (i - 1) || ']')")} as v
    from (select *, unnest(generate_series(1, json_array_length(v)::bigint)) as i from node where json_type(v) = 'ARRAY')
    union all
    select rec_table, rec_key, case when listed then path || case when path = '' then '' else '.' end || key else path end, pos, case when element then path else parent_path end, false,
      case when listed and json_type(c) = 'OBJECT' then json_array(c) else c end
    from (select *, json_type(c) = 'ARRAY' or (json_type(c) = 'OBJECT' and key in {_LISTS}) as listed from (
      select *, {_OPENED.format(x="json_extract(v, '$.' || chr(34) || key || chr(34))")} as c from (select *, unnest(json_keys(v)) as key from node where json_type(v) = 'OBJECT') where key <> 'model_notes'))
    where json_type(c) in ('ARRAY', 'OBJECT'))),
child as (
  select distinct rec_table, rec_key, path as child_path, pos as child_pos, parent_path from node
  where element and json_type(v) = 'OBJECT' and len(list_filter(json_extract(v, '$.*'), lambda x: json_type(x) <> 'NULL')) > 0)
"""


def queries() -> dict:
    return {
        "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_exhibits": p3_exhibits, "p3_tables": p3_tables, "p3_refused": p3_refused,
        "p4_found": p4_found, "p4_keywords": _keywords,
    }


# Phrases: segments inside quotes stay as they are, delimiters outside become one mark, and pieces lose list marks and enclosing quotes.
_QUOTED = '"(?:[^"]|"")*"|«[^«»]*»|“[^“”]*”'
_PHRASES = rf"""
with t as (select distinct doc_id, e.keywords_search_query as t from (select doc_id, llm_extracted as e from enhanced_docs) where regexp_matches(e.keywords_search_query, '\S')),
g as (select doc_id, t, regexp_extract_all(t, '{_QUOTED}|[^"«“]+|["«“]') as s from t),
o as (select doc_id, t, list_transform(s, lambda x, i: case
    when regexp_full_match(x, '{_QUOTED}') then x
    when x = '/' and regexp_full_match(s[i - 1], '{_QUOTED}') and regexp_full_match(s[i + 1], '{_QUOTED}') then chr(1)
    else replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(\d),(\d)', '\1' || chr(2) || '\2', 'g'), '(\d),(\d)', '\1' || chr(2) || '\2', 'g'), '(\s)/', '\1' || chr(1), 'g'), '/(\s)', chr(1) || '\1', 'g'),
      '[;|•\t\r\n\v\f\x{{85}}\x{{2028}}\x{{2029}}]', chr(1), 'g'), ',', chr(1)), chr(2), ',') end) as s from g),
p as (select doc_id, t, list_filter(list_transform(string_split(array_to_string(s, ''), chr(1)), lambda x: trim(regexp_replace(x, '^\s*(?:[-–—*•·▪◦]+\s+|\(?\d{{1,3}}[.)]\s+|[•·▪◦]+\s*)+', ''), ' ' || chr(160))), lambda x: x <> '' and not regexp_full_match(x, '[-–—*•]+')) as p from o),
v as (select doc_id, t, list_filter(list_transform(p, lambda x: case when regexp_full_match(x, '{_QUOTED}') then trim(case when x[1] = '"' then replace(x[2:-2], '""', '"') else x[2:-2] end) else x end), lambda x: x <> '') as v from p)
select distinct 'keywords_search_query' as field_name, doc_id as rec_key, unnest(generate_series(1, len(v))) as val_pos, unnest(v) as val from v where len(v) >= 2
"""


def oracle_sql() -> dict[str, str]:
    report = [_COUNT.format(r="jurisprudence_cited.process_number", q=_LOST)]
    report += [_COUNT.format(r=f"{t}.doc_id", q=_LOST_DOC.format(t=t)) for t in ("legislation_cited", "jurisprudence_cited")]
    return {
        "p2_found": f"select cite_id from ({_LOST})", "p2_report": " union all ".join(report),
        "p3_found": f"{_CHILDREN} select rec_table, rec_key, child_path, child_pos from child",
        "p3_tables": f"{_CHILDREN} select rec_table, child_path, count(*) as n_rows, count(distinct rec_key) as n_records, count(*) filter (parent_path <> '') as with_parent from child group by all",
        "p3_exhibits": f"{_CHILDREN} select distinct rec_table, rec_key, parent_path, regexp_replace(pos, '[.][0-9]+$', '') as parent_pos, pos as child_pos, v->>'ref' as ref, try_cast(v->>'pages' as int) as pages from node where element and path = 'timeline_events.exhibits' and json_type(v) = 'OBJECT' and len(list_filter(json_extract(v, '$.*'), lambda x: json_type(x) <> 'NULL')) > 0",
        "p3_refused": "select 'documents' as rec_table, count(*) as records, count(*) filter (metadata is null) as empty, count(*) filter (not json_valid(metadata)) as refused from documents",
        "p4_keywords": _PHRASES,
    }
