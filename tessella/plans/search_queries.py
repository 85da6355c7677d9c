"""Queries: filters, search, fusion, facets and statistics (F, H, W1, J1-J3, A1-A9, T-K)."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ann, facets, fts, models, search
from tessella.operators.filters import Filters, has_key
from tessella.session import exists, shared_dir
from tessella.sources.corpus import VECTOR_FIELDS, serving, stored_vector, stored_vectors, with_vectors
from tessella.sources.tables import table

QUERY_VECTOR = 7
S = """s as (select doc_id, url, court_short, decision_date, process_number, legal_domain, is_auj, text as full_text, summary,
  case when json_valid(metadata) then metadata end as metadata from documents)"""
_JSON = lambda k: f"(metadata->>'{k}')"
_V = ", ".join(f"(select embedding::double[] from embeddings where vec_id = (doc_id * {a} + {b}) % 997) as {n}" for n, (a, b) in VECTOR_FIELDS.items())
_SIM = "round(list_cosine_similarity({f}, (select embedding::double[] from embeddings where vec_id = 7)), 7)"
V = f"v as (select s.*, {_V} from s)"

FILTERS = {
    "F1_court": (Filters(court=("TAL", "TAB")), "court_short in ('TAL', 'TAB')"),
    "F2_legal_domain": (Filters(legal_domain="direito c_vil"), "legal_domain ilike '%direito c_vil%'"),
    "F3_is_auj": (Filters(is_auj=True), "is_auj = true"),
    "F4_dates": (Filters(date_from=datetime.date(2010, 1, 1), date_to=datetime.date(2015, 6, 30)), "decision_date between date '2010-01-01' and date '2015-06-30'"),
    "F5_decision_type": (Filters(decision_type=("Acórdão", "Despacho")), f"{_JSON('decision_type')} in ('Acórdão', 'Despacho')"),
    "F6_confidence": (Filters(extraction_confidence=("high",)), f"{_JSON('extraction_confidence')} = 'high'"),
    "F0_all_filters": (
        Filters(court=("TAL", "TAB", "TAO"), legal_domain="direito", is_auj=False, date_from=datetime.date(2000, 1, 1), decision_type=("Acórdão", "acordao"), extraction_confidence=("high", "medium")),
        f"court_short in ('TAL', 'TAB', 'TAO') and legal_domain ilike '%direito%' and is_auj = false and decision_date >= date '2000-01-01' and {_JSON('decision_type')} in ('Acórdão', 'acordao') and {_JSON('extraction_confidence')} in ('high', 'medium')",
    ),
}


def _filtered(f: Filters):  # noqa: ANN202
    return lambda spark, folder: serving(spark, folder).where(f.predicate()).select("doc_id", "court_short", "decision_date")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return with_vectors(serving(spark, folder), spark, folder)


def f7_vector_present(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).where("embedding is not null").select("doc_id")


def f8_text_match(spark: SparkSession, folder: str) -> DataFrame:
    """Unstemmed match, which SQL can check: words, without a word."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("full_text"))
    return fts.ranked(docs, F.col("full_text"), "assembleia direção OR menor avós -pericia", None, stemmed=False).select("doc_id")


def f8_phrase(spark: SparkSession, folder: str) -> DataFrame:
    """Unstemmed phrases: their words at exact distances."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("full_text"))
    return fts.ranked(docs, F.col("full_text"), '"prédio rústico" OR "relatório pericial junto" -"nova direção"', None, stemmed=False).select("doc_id")


def f8_excluded(spark: SparkSession, folder: str) -> DataFrame:
    """A query that only excludes, from the stored postings."""
    docs = serving(spark, folder)
    return fts.ranked_by_index(_text_index(spark, folder), "-direito -contrato", None, ids=docs).select("doc_id")


_indexes: dict[tuple[str, str], str] = {}


def _text_index(spark: SparkSession, folder: str) -> DataFrame:
    """The stored postings of the searched text, written once per application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _indexes or not exists(spark, _indexes[key]):
        path = f"{shared_dir(spark)}/tessella/postings-{uuid.uuid4().hex}"
        docs = serving(spark, folder)
        fts.write_index(docs, search.searched_text(docs), path)
        _indexes[key] = path
    return spark.read.parquet(_indexes[key])


def f9_key_exists(spark: SparkSession, folder: str) -> DataFrame:
    docs = serving(spark, folder)
    keys = ("decision_type", "voting", "decision_outcome", "liability_reasoning")
    return docs.agg(*[F.count_if(has_key(F.col("metadata"), k)).alias(f"has_{k}") for k in keys], *[F.count_if(F.try_variant_get(F.try_parse_json("metadata"), f"$.{k}", "string").isNotNull()).alias(f"set_{k}") for k in keys])


def h2_vector_top(spark: SparkSession, folder: str) -> DataFrame:
    kept = serving(spark, folder).where(Filters(court=("TAL", "TAB", "TSVD")).predicate()).select("doc_id")
    return search.vector_top(stored_vectors(spark, folder).join(kept, "doc_id", "left_semi"), "embedding", stored_vector(spark, folder, QUERY_VECTOR), 80)


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    return search.vector_lists(stored_vectors(spark, folder), list(VECTOR_FIELDS), stored_vector(spark, folder, QUERY_VECTOR), 40)


def h3_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    return _ranks(spark, folder).select("source", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


def h5_fusion(spark: SparkSession, folder: str) -> DataFrame:
    fused = search.fuse(_ranks(spark, folder), {"embedding": 2.0, "embedding_context": 1.0, "embedding_ratio": 0.5}, 50)
    return fused.select("doc_id", F.round("score", 9).alias("score"), *[F.col("ranks")[s].cast("bigint").alias(f"rank_{s}") for s in VECTOR_FIELDS])


def h9_semantic(spark: SparkSession, folder: str) -> DataFrame:
    request = search.SearchRequest(q="x", filters=Filters(is_auj=False), weights={"embedding": 1.0, "embedding_context": 0.7, "embedding_ratio": 0.0, "fts": 1.0})
    found = search.search(serving(spark, folder), request, "semantic", vector=stored_vector(spark, folder, QUERY_VECTOR), vectors=stored_vectors(spark, folder))
    return found.select(F.col("place").cast("bigint").alias("place"), "doc_id", "court_short", "hybrid_score", F.col("similarity_scores")["embedding"].alias("sim_embedding"), F.col("source_ranks")["embedding_context"].cast("bigint").alias("rank_context"))


HYBRID = search.SearchRequest(q="contrato prazo OR licença obra", filters=Filters(date_from=datetime.date(2005, 1, 1)))
PHRASE = search.SearchRequest(q_keywords='"prédio rústico" encravado -penhora', limit=50)
LETTERS = "aeiousrntdlm"


def h8_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    found = search.search(serving(spark, folder), HYBRID, vector=stored_vector(spark, folder, QUERY_VECTOR), vectors=stored_vectors(spark, folder), text_index=_text_index(spark, folder))
    return found.select("place", "doc_id", "court_short", "decision_date", "hybrid_score", F.to_json("similarity_scores").alias("similarity_scores"), "fts_rank", F.to_json("source_ranks").alias("source_ranks"))


def h10_fts(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(serving(spark, folder), PHRASE, "fts", text_index=_text_index(spark, folder)).select("place", "doc_id", "fts_rank", "hybrid_score")


def h8_matches(spark: SparkSession, folder: str) -> DataFrame:
    """All documents that the hybrid query's text side matches, by stems and within its filter."""
    kept = serving(spark, folder).where(HYBRID.filters.predicate())
    return fts.ranked_by_index(_text_index(spark, folder), HYBRID.q, None, kept=kept).select("doc_id")


def h10_matches(spark: SparkSession, folder: str) -> DataFrame:
    """All documents that the phrase query matches, by stems."""
    return fts.ranked_by_index(_text_index(spark, folder), PHRASE.q_keywords, None).select("doc_id")


def tk2_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The phrase query with a cap on the documents that are ranked: the first by id."""
    return fts.ranked_by_index(_text_index(spark, folder), PHRASE.q_keywords, None, cap=5).select("doc_id")


def h1_text_query(spark: SparkSession, folder: str) -> DataFrame:
    """A text query embedded by the same function as the documents' summaries, and ranked by likeness."""
    embed = models.counting_embedder(LETTERS)
    docs = serving(spark, folder)
    rows = docs.select("doc_id", F.lit("embedding").alias("source"), models.embedded(F.col("summary"), embed).alias("vector")).where("vector is not null")
    request = search.SearchRequest(q="prazo para recorrer da decisão", weights={"embedding": 1.0}, limit=30)
    found = search.search(docs, request, "semantic", embed=lambda q: embed([q])[0], vectors=rows)
    return found.select(F.col("place").cast("bigint").alias("place"), "doc_id", F.col("similarity_scores")["embedding"].alias("similarity"))


def h4_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency of each unstemmed word of the summaries."""
    return fts.postings(table(spark, folder, "documents"), F.col("summary"), stemmed=False).groupBy("lexeme").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("places"))


def j1_hydrate(spark: SparkSession, folder: str) -> DataFrame:
    docs = serving(spark, folder)
    ids = docs.select("doc_id").orderBy(F.desc("doc_id")).limit(20).select("doc_id").unionByName(docs.sparkSession.createDataFrame([(-1,)], "doc_id bigint"))
    return search.hydrate(ids, docs).select("doc_id", "url", "court_short", "legal_domain")


def j2_lookup(spark: SparkSession, folder: str) -> DataFrame:
    docs = serving(spark, folder)
    return search.lookup(docs, docs.agg(F.min("doc_id")).first()[0]).select("doc_id", "process_number")


def _recall(spark: SparkSession, folder: str, probes: int) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    centres = ann.centroids(vectors, "embedding", 16)
    queries = vectors.where("vec_id % 100 = 0")
    got = ann.search(ann.index(vectors, "embedding", centres), queries, "vec_id", "embedding", centres, probes=probes)
    exact = ann.search(ann.index(vectors, "embedding", centres[:1]), queries, "vec_id", "embedding", centres[:1], probes=1)
    hits = exact.join(got.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return hits.agg(F.count_distinct("query").alias("queries"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 4).alias("recall"))


def h12_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the inverted-file index against exact top-10, queries being every vector whose id is divisible by 100.

    These vectors are all but random, so 12 of 16 lists are needed to reach 0.9.
    """
    return _recall(spark, folder, 12).select("queries", (F.col("recall") >= 0.9).alias("reached"))


def h12_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """A filtered search through the stored index: too few hits in the nearest lists make it probe more, so the limit is filled."""
    index = search.VectorIndex.build(stored_vectors(spark, folder), f"{shared_dir(spark)}/tessella/vectors-{uuid.uuid4().hex}", 16, 1)
    kept = serving(spark, folder).where(Filters(court=("TSVD",)).predicate()).select("doc_id")
    lists = index.lists(list(VECTOR_FIELDS), stored_vector(spark, folder, QUERY_VECTOR), 20, kept)
    return lists.join(kept, "doc_id").groupBy("source").agg(F.count("*").alias("n"))


def tk1_exact_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    centres = ann.centroids(vectors, "embedding", 1)
    return ann.search(ann.index(vectors, "embedding", centres), vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", centres, k=5, probes=1).select("query", "vec_id", F.round("score", 5).alias("score"))


_TOP = f"select doc_id, {_SIM} as score from v where {{f}} is not null {{w}} order by score desc, doc_id limit {{k}}"
_RANKED = " union all ".join(f"select '{f}' as source, row_number() over (order by score desc, doc_id) as rank, doc_id, score from ({_TOP.format(f=f, w='', k=40)})" for f in VECTOR_FIELDS)
_WEIGHTS = {"embedding": 2.0, "embedding_context": 1.0, "embedding_ratio": 0.5}
_SEM = " union all ".join(f"select '{f}' as source, {i} as place, {w} as w, row_number() over (order by score desc, doc_id) as rank, doc_id, score from ({_TOP.format(f=f, w='and is_auj = false', k=80)})" for i, (f, w) in enumerate((("embedding", 1.0), ("embedding_context", 0.7))))
_FACET = "select '{n}' as facet, {e}::varchar as value, count(*) as count from s where {w} group by 2"


def queries() -> dict:
    out = {name: _filtered(f) for name, (f, _) in FILTERS.items()}
    docs = serving
    out |= {
        "F7_vector_present": f7_vector_present, "F8_text_match": f8_text_match, "F9_key_exists": f9_key_exists,
        "H2_vector_top": h2_vector_top, "H3_fan_out": h3_fan_out, "H5_fusion": h5_fusion, "H9_semantic": h9_semantic, "H8_hybrid": h8_hybrid, "H10_fts": h10_fts, "H4_postings": h4_postings,
        "H12_ann_recall": h12_recall, "H12_filtered": h12_filtered, "H1_text_query": h1_text_query, "H8_matches": h8_matches, "H10_matches": h10_matches, "TK2_capped": tk2_capped, "F8_phrase": f8_phrase, "F8_excluded": f8_excluded, "TK1_neighbours": tk1_exact_neighbours, "J1_hydrate": j1_hydrate, "J2_lookup": j2_lookup,
        "A1_stats": lambda s, f: facets.stats(_vectors(s, f), ["embedding", "embedding_context", "embedding_ratio"]),
        "A2_court_facet": lambda s, f: facets.value_counts(docs(s, f), "court_short"),
        "A3_auj_facet": lambda s, f: facets.value_counts(docs(s, f), "is_auj", by_value=True),
        "A4_date_range": lambda s, f: facets.date_range(docs(s, f)),
        "A5_domain_count": lambda s, f: docs(s, f).agg(F.count_distinct("legal_domain").alias("domains")),
        "A6_top_domains": lambda s, f: facets.domains(docs(s, f), "comercial", 10),
        "A7_decision_types": lambda s, f: facets.json_counts(docs(s, f), "decision_type"),
        "A8_facet_payload": lambda s, f: facets.payload(docs(s, f)),
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: f"with {S} select doc_id, court_short, decision_date from s where {w}" for name, (_, w) in FILTERS.items()}
    keys = ("decision_type", "voting", "decision_outcome", "liability_reasoning")
    word = lambda w: f"regexp_matches(t, '(^|[^a-z0-9]){w}($|[^a-z0-9])')"
    phrase = lambda *ws: word("[^a-z0-9]+".join(ws))
    searched = f"with {S}, t as (select doc_id, decision_date, strip_accents(lower(concat_ws(' ', summary, legal_domain, process_number, metadata->>'keywords_search_query'))) as t from s)"
    letters = lambda c: "[" + ", ".join(f"(length({c}) - length(replace({c}, '{x}', '')))::double" for x in LETTERS) + "]"
    out |= {
        "F7_vector_present": f"with {S}, {V} select doc_id from v where embedding is not null",
        "F8_text_match": f"with t as (select doc_id, strip_accents(lower(text)) as t from documents) select doc_id from t where {word('assembleia')} and {word('direcao')} or {word('menor')} and {word('avos')} and not {word('pericia')}",
        "F8_phrase": f"with t as (select doc_id, strip_accents(lower(text)) as t from documents) select doc_id from t where {phrase('predio', 'rustico')} or {phrase('relatorio', 'pericial', 'junto')} and not {phrase('nova', 'direcao')}",
        "F8_excluded": f"{searched} select doc_id from t where not {word('direitos?')} and not {word('contratos?')}",
        "H8_matches": f"{searched} select doc_id from t where decision_date >= date '2005-01-01' and ({word('contratos?')} and {word('prazos?')} or {word('licencas?')} and {word('obras?')})",
        "H10_matches": f"{searched} select doc_id from t where {phrase('predios?', 'rustic[oa]s?')} and {word('encravad[oa]s?')} and not {word('penhor(a|as|es)?')}",
        "TK2_capped": f"{searched} select doc_id from t where {phrase('predios?', 'rustic[oa]s?')} and {word('encravad[oa]s?')} and not {word('penhor(a|as|es)?')} order by doc_id limit 5",
        "H12_ann_recall": "select count(*) filter (vec_id % 100 = 0) as queries, true as reached from embeddings",
        "H12_filtered": f"with {S}, {V}, k as (select * from v where court_short = 'TSVD') " + " union all ".join(f"select '{f}' as source, least(count({f}), 20) as n from k" for f in VECTOR_FIELDS),
        "H1_text_query": f"with d as (select doc_id, {letters('summary')} as v from documents where trim(summary) <> ''), r as (select doc_id, round(list_cosine_similarity(v, {letters(chr(39) + 'prazo para recorrer da decisão' + chr(39))}), 7) as s from d where list_sum(v) > 0), p as (select *, row_number() over (order by s desc, doc_id) as place from r) select place, doc_id, round(s, 4) as similarity from p where place <= 30",
        "F9_key_exists": f"with {S} select " + ", ".join([f"count(*) filter (list_contains(json_keys(metadata), '{k}')) as has_{k}, count(metadata->>'{k}') as set_{k}" for k in keys]) + " from s",
        "H2_vector_top": f"with {S}, {V} " + _TOP.format(f="embedding", w="and court_short in ('TAL', 'TAB', 'TSVD')", k=80),
        "H3_fan_out": f"with {S}, {V} {_RANKED}",
        "H5_fusion": f"with {S}, {V}, r as ({_RANKED}) select doc_id, round(sum(case source " + " ".join(f"when '{k}' then {w}" for k, w in _WEIGHTS.items()) + " end / (50 + rank)), 9) as score, " + ", ".join(f"max(rank) filter (source = '{k}') as rank_{k}" for k in VECTOR_FIELDS) + " from r group by doc_id",
        "H9_semantic": f"with {S}, {V}, r as ({_SEM}), g as (select doc_id, sum(w / (50 + rank)) as score, min(place * 1000 + rank) as first, max(score) filter (source = 'embedding') as e, max(rank) filter (source = 'embedding_context') as c from r group by doc_id), o as (select *, row_number() over (order by round(score, 12) desc, first) as place from g) select place, o.doc_id, court_short, round(score, 6) as hybrid_score, round(e, 4) as sim_embedding, c as rank_context from o join s on o.doc_id = s.doc_id where place <= 20",
        "H4_postings": "with w as (select doc_id, unnest(regexp_extract_all(strip_accents(lower(summary)), '[\\p{L}\\p{N}]+')) as x from documents) select replace(replace(x, 'º', 'o'), 'ª', 'a') as lexeme, count(distinct doc_id) as documents, count(*) as places from w group by 1",
        "TK1_neighbours": "with p as (select a.vec_id as query, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 7) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) select query, vec_id, round(score, 5) as score from (select *, row_number() over (partition by query order by score desc, vec_id) as r from p) where r <= 5",
        "J1_hydrate": f"with {S} select doc_id, url, court_short, legal_domain from s order by doc_id desc limit 20",
        "J2_lookup": f"with {S} select doc_id, process_number from s where doc_id = (select min(doc_id) from s)",
        "A1_stats": f"with {S}, {V} select count(*) as total, count(embedding) as with_embedding, count(embedding_context) as with_embedding_context, count(embedding_ratio) as with_embedding_ratio from v",
        "A2_court_facet": "select court_short as value, count(*) as count from documents where court_short is not null group by 1",
        "A3_auj_facet": "select is_auj as value, count(*) as count from documents where is_auj is not null group by 1",
        "A4_date_range": "select min(decision_date) as min_date, max(decision_date) as max_date, count(decision_date) as count from documents",
        "A5_domain_count": "select count(distinct legal_domain) as domains from documents",
        "A6_top_domains": "select legal_domain as value, count(*) as count from documents where legal_domain ilike '%comercial%' group by 1 order by 2 desc, 1 limit 10",
        "A7_decision_types": f"with {S} select metadata->>'decision_type' as value, count(*) as count from s where list_contains(json_keys(metadata), 'decision_type') group by 1",
        "A8_facet_payload": f"with {S} " + " union all ".join(_FACET.format(n=n, e=e, w=w) for n, e, w in (("court", "court_short", "court_short is not null"), ("is_auj", "is_auj", "is_auj is not null"), *((k, f"(metadata->>'{k}')", f"list_contains(json_keys(metadata), '{k}')") for k in ("decision_type", "extraction_confidence")))),
    }
    return out
