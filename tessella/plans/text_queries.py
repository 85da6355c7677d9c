"""Queries: projections, text and legal normalizers, pages (P, T, X, F10-F24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import articles, html, text
from tessella.operators import models, quality
from tessella.sources.corpus import serving
from tessella.sources.tables import table

# Inputs and the results they must have.
ARTICLES = [
    ("394.º", "394.º"), ("394.º, n.º 1", "394.º, n.º 1"), ("394.º, n.º 1, alínea a)", "394.º, n.º 1, alínea a)"), ("5.º-A", "5.º-A"),
    ("527.º, n.ºs 1 e 2", "527.º, n.º 1|527.º, n.º 2"), ("527.º, n.º 1 e 2", "527.º, n.º 1|527.º, n.º 2"),
    ("672.º, n.º 1, alíneas a) e b)", "672.º, n.º 1, alínea a)|672.º, n.º 1, alínea b)"), ("615.º, n.º 1, b)", "615.º, n.º 1, alínea b)"),
    ("11.º, 12.º, 13.º, 19.º", "11.º|12.º|13.º|19.º"), ("394.º e 395.º", "394.º|395.º"), ("234.º a 240.º", "234.º|235.º|236.º|237.º|238.º|239.º|240.º"),
    ("180.º, n.ºs 2 a 4", "180.º, n.º 2|180.º, n.º 3|180.º, n.º 4"), ("186.º, n.º 1 e 2, alínea d)", "186.º, n.º 1, alínea d)|186.º, n.º 2, alínea d)"),
    ("67-A, alínea b)", "67.º-A, alínea b)"), ("artigo 643.º", "643.º"), ("394°", "394.º"), ("", ""),
    ("180.º, n.ºs 2 a 40", "180.º"), ("225.º, n.º 1, alínea b), n.º 2", "225.º, n.º 1, alínea b)"), ("615.º, n.º 1, B)", "615.º, n.º 1"), ("615.º, b)", "615.º, b)"),
    ("1.º a 40.º", "1.º a 40.º"), ("passim", "passim"),
]
LAWS = [
    ("Código de Processo Civil", "Código de Processo Civil"), ("CPC", "Código de Processo Civil"), ("ncpc", "Código de Processo Civil"), ("c.c.", "Código Civil"), ("CP", "Código Penal"),
    ("CRP", "Constituição da República Portuguesa"), ("Lei nº 65/2003", "Lei n.º 65/2003"), ("Lei 65/2003", "Lei n.º 65/2003"), ("Decreto-Lei 15/93", "Decreto-Lei n.º 15/93"),
    ("DL 15/93", "Decreto-Lei n.º 15/93"), ("Lei n.º 23/2007, de 4 de julho", "Lei n.º 23/2007"), ("Lei n.º 23/2007, de 4 de março de 2007", "Lei n.º 23/2007"), ("Código da Estrada", "Código da Estrada"), ("", ""),
]
UNIFYING = [
    ("RECURSO DE FIXAÇÃO DE JURISPRUDÊNCIA", None, True), ("RECURSO UNIFORIZAÇÃO DE JURISPRUDÊNCIA", None, True), (None, "Recurso para Uniformização de Jurisprudência (Cível)", True), ("Acórdão Uniformizador", None, True),
    ("  recurso para fixar jurisprudência penal  ", None, True), ("REVISTA", "Revista", False), ("RECURSO DE REVISÃO", "Recurso de Revisão", False), (None, None, False), ("", "", False),
]
DATES = [("2020-02-29", "2020-02-29"), ("2020-02-30", None), ("02/13/2020", "2020-02-13"), ("13/02/2020", None), ("13-02-2020", "2020-02-13"), (" 2019-01-05 ", "2019-01-05"), ("2019", None), (None, None), ("", None)]
KEYWORDS = [("Prédio Encravado, multa, prédio-encravado, a b c d e f g", "predio encravado"), ("mora do devedor\nperda total", "mora do devedor, perda total"), ("643.º do código", "643 o do codigo"), ("única", None), ("", None), (None, None)]
CLEAN = [("  Artigo  394º , Nº 2 , al. b)  ", "394.º , n.º 2 , alínea b)"), ("394°", "394.º"), ("67-A", "67.º-A"), ("", "")]
REPLIES = [('```json\n{"a": 1}\n```', '{"a": 1}'), ('```\n{"a": 2}```', '{"a": 2}'), ('{"a": 3}', '{"a": 3}')]
URLS = [("https://h.example/a/b54c?OpenDocument", "b54c"), ("https://h.example/a/ABC/", "ABC"), ("https://h.example/a/x?u=1", "x"), ("abc", "abc")]
SIZES = [(0, "0.0 B"), (1536, "1.5 KB"), (5 * 1024**3, "5.0 GB")]
TIMES = [(59.9, "0:00:59"), (3725.0, "1:02:05"), (90000.0, "25:00:00")]
VECTORS = [("[0.5,-1,2]", "0.5,-1.0,2.0"), ("[1,2]", None), ("[a,b,c]", None)]
PAGES = [
    ("<html><head><title>t</title></head><body><script>x()</script><p>Processo:  12/3 </p><form><b>no</b></form><div>a<br>b\t c</div><style>p{}</style></body></html>", "Processo: 12/3|a|b c"),
    ("plain <b>bold</b>", "plain|bold"), ("", ""),
]
BYTES = [(b"a\xe7\xe3o", "ação"), (b"\xc2\x81x", "\u0081x"), (b"\xff\x81", "��")]
LISTING = '<a href="/j.nsf/0/' + "a1" * 16 + '?OpenDocument">x</a> <a href="/j.nsf/0/' + "b2" * 16 + '?OpenDocument">y</a><a href="?Start=101">Seguinte</a><a href="?Start=201">próximo</a><a href="?Start=1">anterior</a>'


def _rows(spark: SparkSession, schema: str, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _golden(inputs: list, kind: str, apply, out: str = "string"):  # noqa: ANN001, ANN202
    return lambda spark, folder: _rows(spark, f"input {kind}", [(r[0],) for r in inputs]).select("input", apply(F.col("input")).cast(out).alias("result"))


def _lit(v: object) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _values(rows: list, names: str) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) x({names})"


def p3_embedding_texts(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "enhanced_docs").select("doc_id", "llm_extracted.*")
    made = text.embedding_texts(*[F.col(c) for c in ("semantic_search_query", "legal_question", "summary", "ratio_decidendi", "decision_outcome")])
    return x.select("doc_id", *[c.alias(n) for n, c in made.items()]).distinct()


SOURCE_KEYS = ("source_db", "court", "court_short")


def serving_metadata(x: DataFrame, extraction: str = "llm_extracted") -> Column:
    """A record's metadata as JSON: the whole extraction, nulls kept, and the source's keys, which replace fields of the same names."""
    own = [F.col(extraction)[f].alias(f) for f in x.schema[extraction].dataType.names if f not in SOURCE_KEYS]
    source = [F.coalesce(F.col(k), F.lit("")).alias(k) if k == "court" else F.col(k) for k in SOURCE_KEYS]
    return F.to_json(F.struct(*own, *source), {"ignoreNullFields": "false"})


def p2_serving_row(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction records as serving rows, with what their metadata holds when it is read again."""
    x = table(spark, folder, "enhanced_docs").withColumn("m", serving_metadata(table(spark, folder, "enhanced_docs")))
    auj = F.coalesce(F.col("llm_extracted.is_jurisprudence_unification"), F.lit(False))
    again = lambda k: F.get_json_object("m", f"$.{k}").alias(f"m_{k}")
    rows = x.select(
        "doc_id", "court_short", text.iso_date(F.col("llm_extracted.decision_date")).alias("decision_date"), "llm_extracted.legal_domain", auj.alias("is_auj"),
        F.array_join(F.array_sort(F.json_object_keys("m")), ",").alias("m_keys"), again("source_db"), again("court"), again("court_short"), again("summary"), again("liability_found"),
        F.coalesce(F.json_array_length(F.get_json_object("m", "$.parties")), F.lit(-1)).cast("bigint").alias("m_parties"), again("voting"), again("keywords_search_query"),
    )
    return rows.distinct()


def p4_prompt(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "raw_docs").select("doc_id", models.prompt(F.col("court"), F.col("court_short"), F.col("full_text")).alias("p"))
    return x.select("doc_id", F.md5("p").alias("prompt_md5"), F.length("p").cast("bigint").alias("chars")).distinct()


def f_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are long enough, and how many show a number, a judge and a body, by their markers."""
    d = table(spark, folder, "raw_docs").select(F.col("full_text").alias("t"))
    body = F.col("t").contains("Decisão Texto Integral") | F.col("t").contains("Acordam") | F.upper("t").contains("RELATÓRIO")
    return d.agg(F.count_if(F.length("t") >= 200).alias("long_enough"), F.count_if(F.col("t").contains("Processo")).alias("with_number"), F.count_if(F.col("t").contains("Relator")).alias("with_judge"), F.count_if(body).alias("with_body"))


def f12_variants(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "enhanced_docs").where("llm_extracted is not null").select("llm_extracted.*")
    out = [F.count_if(getattr(text, rule)(F.col(c), kind)).alias(f"{rule}_{c}") for rule in ("truthy", "present", "not_blank") for c, kind in (("keywords_search_query", "string"), ("liability_found", "boolean"), ("parties", "array"))]
    return x.agg(*out)


def f_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Date shapes, language heuristic, canonical articles, sentence ends, list sizes, future and early dates, as counts."""
    x = table(spark, folder, "enhanced_docs").where("llm_extracted is not null").select("llm_extracted.*")
    d = text.any_date(F.col("decision_date"))
    return x.agg(
        F.count_if(F.col("decision_date").rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("iso_dates"), F.count_if(F.col("summary").rlike(r"(?iuU)[áéíóúâêôãõç]")).alias("accented"),
        F.count_if(F.rtrim("semantic_search_query").rlike("[.?]$")).alias("sentences"), F.count_if(F.size("parties") > 3).alias("large_lists"), F.count_if(F.year(d) > 2020).alias("late"), F.count_if(F.year(d) < 2000).alias("early"),
    )


def f16_articles(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "legislation_cited")
    ok = F.col("article").rlike(r"^\d+\.º(-[A-Z])?(, n\.º \d+)?(, alínea [a-z]\))?$")
    wide = F.col("article").rlike(r"^\d+\.º(-[A-Za-z])?(, n\.º \d+)?(, alínea [a-z]\))?$")
    return x.agg(F.count_if(ok).alias("canonical"), F.count_if(wide).alias("canonical_wide"), F.count_if(F.col("article").isNotNull() & ~ok).alias("residual"), F.count_if(F.lower("law").contains("artigo")).alias("names_article"), F.count_if(F.upper(F.trim("law")).isin("CPC", "CTS", "CAP")).alias("abbreviated"))


def f18_keywords(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "documents").select(F.try_variant_get(F.try_parse_json("metadata"), "$.keywords_search_query", "string").alias("k")).where("k is not null")
    return x.groupBy(quality.keyword_faults(F.col("k")).alias("fault")).agg(F.count("*").alias("n"))


def t3_laws(spark: SparkSession, folder: str) -> DataFrame:
    """Citations by normalized name; what no rule resolves is counted as it stands."""
    x = table(spark, folder, "legislation_cited").where("law is not null")
    return x.groupBy(text.law_name(F.col("law")).alias("name")).agg(F.count("*").alias("n"))


def t5_places(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical share of the places before and after expansion."""
    ok = lambda c: c.rlike(r"^\d+\.º(-[A-Za-z])?(, n\.º \d+)?(, alínea [a-z]\))?$")
    x = table(spark, folder, "legislation_cited").where("article is not null").select("article", articles.expand_articles(F.col("article")).alias("places"))
    after = F.aggregate("places", F.lit(0), lambda s, p: s + ok(p).cast("int"))
    return x.agg(F.count("*").alias("articles"), F.count_if(ok(F.col("article"))).alias("canonical_before"), F.sum(F.size("places")).alias("places"), F.sum(after).alias("canonical_after"))


def t7_legislation(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "legislation_cited").dropDuplicates(["cite_id"])
    return articles.normalized_legislation(x, ["doc_id"], "pos", "article", "law", "citation_context")


LEGISLATION = [
    (1, 1, "615.º", "CPC", "referencing"), (1, 2, "615.º", "Código de Processo Civil", "supporting"), (2, 1, "672.º, n.º 1, alíneas a) e b)", "CPC", "referencing"),
    (2, 2, "672.º, n.º 1, alínea a)", "Código de Processo Civil", "supporting"), (3, 1, "1.º", "CC", "bogus"), (4, 1, None, "CC", None),
]
LEGISLATION_DONE = [
    (1, "615.º", "Código de Processo Civil", "supporting", 1), (2, "672.º, n.º 1, alínea a)", "Código de Processo Civil", "supporting", 1), (2, "672.º, n.º 1, alínea b)", "Código de Processo Civil", "referencing", 2),
    (3, "1.º", "Código Civil", "referencing", 1), (4, "", "Código Civil", "referencing", 1),
]


def t7_golden(spark: SparkSession, folder: str) -> DataFrame:
    x = _rows(spark, "doc_id bigint, pos int, article string, law string, citation_context string", LEGISLATION)
    return articles.normalized_legislation(x, ["doc_id"], "pos", "article", "law", "citation_context").withColumn("place", F.col("place").cast("bigint"))


def t8_flags(spark: SparkSession, folder: str) -> DataFrame:
    d = serving(spark, folder).select(F.try_variant_get(F.try_parse_json("metadata"), "$.procedural_type", "string").alias("p"), F.try_variant_get(F.try_parse_json("metadata"), "$.case_type", "string").alias("c"))
    return d.agg(F.count_if(text.unifies_case_law(F.col("p"), F.col("c"))).alias("unifying"), F.count("*").alias("total"))


def t9_dates(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "jurisprudence_cited").where("decision_date is not null")
    return x.groupBy(text.iso_date(F.col("decision_date")).alias("day")).agg(F.count("*").alias("n"))


HEADERS = {"process": "Processo", "judge": "Relator", "descriptors": "Descritores", "voting": "Votação", "none": "Nenhum"}


def t10_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The header fields of the raw pages."""
    x = table(spark, folder, "raw_docs").select("doc_id", *[text.header_field(F.col("full_text"), v).alias(k) for k, v in HEADERS.items()])
    return x.distinct()


def t5_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """The places of locators of plain shapes, which SQL can expand in its own way."""
    x = table(spark, folder, "legislation_cited").where(F.col("article").rlike(PLAIN)).select("article").distinct()
    return x.select("article", F.array_join(articles.expand_articles(F.col("article")), "|").alias("places"))


_ART, _LIST = r"\d+\.º(?:-[A-Za-z])?", "(?:, | e )"
#: An article; a list or range of articles; an article with a number, several numbers or a range of numbers; and with letters.
PLAIN = rf"^(?:{_ART}(?:{_LIST}{_ART})*|\d+\.º a \d+\.º|{_ART}, n\.ºs? \d+(?:{_LIST}\d+)*|{_ART}, n\.ºs? \d+ a \d+|{_ART}, n\.º \d+, alíneas? [a-z]\)(?:{_LIST}[a-z]\))*)$"
_PLAIN_SQL = rf"""
with a as (select distinct article as a from legislation_cited where regexp_matches(article, '{PLAIN}')),
p as (select a, regexp_extract(a, '^({_ART})', 1) as h, regexp_extract(a, '^(\d+)\.º a \d+\.º$', 1) as r1, regexp_extract(a, '^\d+\.º a (\d+)\.º$', 1) as r2,
  regexp_extract(a, 'n\.ºs? (\d+) a \d+$', 1) as n1, regexp_extract(a, 'n\.ºs? \d+ a (\d+)$', 1) as n2, regexp_extract_all(regexp_extract(a, 'n\.ºs? ([^a]*)', 1), '\d+') as n, regexp_extract_all(a, '\b([a-z])\)', 1) as l from a)
select a as article, array_to_string(case
  when r1 <> '' then case when r2::int - r1::int between 1 and 20 then list_transform(generate_series(r1::int, r2::int), lambda i: i || '.º') else [a] end
  when n1 <> '' then case when n2::int - n1::int between 1 and 20 then list_transform(generate_series(n1::int, n2::int), lambda i: h || ', n.º ' || i) else [h] end
  when len(l) > 0 then list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: h || ', n.º ' || n[1] || ', alínea ' || x || ')')
  when len(n) > 0 then list_transform(list_filter(n, lambda x, i: list_position(n, x) = i), lambda x: h || ', n.º ' || x)
  else regexp_extract_all(a, '{_ART}') end, '|') as places from p
"""


def x4_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.doc_id_of(F.col("url")).alias("page_id"))


def x_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Raw texts put into pages and read back: what is visible comes out again, short pages are dropped."""
    raw = table(spark, folder, "raw_docs").where("url is not null")
    page = F.concat(F.lit("<html><head><script>var a = 1;</script></head><body><p>"), F.replace(F.replace("full_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p><form>x</form></body></html>"))
    found = raw.select(text.doc_id_of(F.col("url")).alias("doc_id"), html.page_text(page).alias("t")).where(F.length("t") >= 200)
    return found.select(F.lower("doc_id").alias("doc_id"), F.md5("t").alias("text_md5")).distinct()


def p8_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector written as text and read back; one cut short is none."""
    v = table(spark, folder, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ", "), F.lit("]")).alias("t"))
    back = v.select("vec_id", text.vector_of(F.col("t"), 64).alias("v"), text.vector_of(F.concat(F.substring_index("t", ",", 63), F.lit("]")), 64).alias("cut"))
    return back.select("vec_id", F.size("v").cast("bigint").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.col("cut").isNull().alias("cut_is_null"))


def t13_table(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's value as a number of megabytes and of minutes."""
    e = table(spark, folder, "events").where("value is not null")
    return e.select("event_id", text.human_size(F.floor(F.col("value") * (1 << 20)).cast("bigint")).alias("size"), text.human_duration(F.floor(F.col("value") * 60).cast("double")).alias("duration"))


def x5_links(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, "page string", [(LISTING,)]).select(F.explode(html.page_links("https://h.example")("page")).alias("x")).select("x.kind", "x.url")


def x6_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Document ids found by pattern in one long listing per court."""
    pages = table(spark, folder, "documents").where("url is not null").select("court_short", F.concat(F.lit('<a href="'), "url", F.lit('">')).alias("page"))
    return pages.select("court_short", F.explode(text.linked_ids(F.col("page"))).alias("id")).distinct()


def x7_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing page that a court's count calls for, a hundred documents each."""
    c = table(spark, folder, "court_catalog").where("approx_count >= 1")
    starts = F.explode(F.sequence(F.lit(1), F.col("approx_count"), F.lit(100)))
    return c.select("court_short", starts.alias("start")).join(c, "court_short").select(F.concat(F.lit("https://h.example/"), "db", F.lit("/"), "view_id", F.lit("?OpenView&Start="), F.col("start").cast("string")).alias("url"))


def queries() -> dict:
    g = _golden
    return {
        "P2_serving_row": p2_serving_row, "P3_embedding_texts": p3_embedding_texts, "P4_prompt": p4_prompt,
        "P1_projection": lambda s, f: serving(s, f).select("doc_id", "url", "court_short", "decision_date", "process_number", "legal_domain", "is_auj", "summary"),
        "P5_json_fields": lambda s, f: serving(s, f).select("doc_id", "decision_type", "extraction_confidence"),
        "P6_json_guard": lambda s, f: table(s, f, "documents").agg(F.count("metadata").alias("texts"), F.count(F.try_parse_json("metadata")).alias("valid")),
        "P8_vector_text": g(VECTORS, "string", lambda c: F.array_join(text.vector_of(c, 3).cast("array<string>"), ",")),
        "P9_rounding": lambda s, f: table(s, f, "events").select("event_id", F.round("value", 4).alias("four"), F.round("value", 2).alias("two")),
        "P8_table": p8_table, "T13_table": t13_table, "P10_reply": g(REPLIES, "string", text.json_reply),
        "F10_F24_lengths": f_lengths, "F12_nonempty": f12_variants, "F14_F23_shapes": f_shapes, "F16_F17_articles": f16_articles, "F18_keywords": f18_keywords,
        "T1_keywords": g(KEYWORDS, "string", text.keywords),
        "T1_keywords_table": lambda s, f: table(s, f, "documents").select("doc_id", text.keywords(F.try_variant_get(F.try_parse_json("metadata"), "$.keywords_search_query", "string")).alias("k")).where("k is not null"),
        "T2_fold": lambda s, f: table(s, f, "law_catalog").select("law_id", text.fold(F.col("law_name")).alias("folded"), text.fold_exact(F.col("law_name")).alias("exact")),
        "T3_law": g(LAWS, "string", text.law_name), "T3_law_table": t3_laws, "T4_clean": g(CLEAN, "string", articles.clean_article),
        "T5_T6_articles": g(ARTICLES, "string", lambda c: F.array_join(articles.expand_articles(c), "|")), "T5_table": t5_places, "T5_shapes": t5_shapes, "T7_legislation": t7_golden, "T7_table": t7_legislation,
        "T8_unifying": lambda s, f: _rows(s, "p string, c string", [r[:2] for r in UNIFYING]).select("p", "c", text.unifies_case_law(F.col("p"), F.col("c")).alias("result")), "T8_table": t8_flags,
        "T9_dates": g(DATES, "string", text.iso_date, "date"), "T9_table": t9_dates, "T10_headers": t10_headers,
        "T12_any_date": lambda s, f: table(s, f, "jurisprudence_cited").where("decision_date is not null").groupBy(text.any_date(F.col("decision_date")).alias("day")).agg(F.count("*").alias("n")),
        "T13_sizes": g(SIZES, "bigint", text.human_size), "T13_times": g(TIMES, "double", text.human_duration),
        "X1_decode": lambda s, f: _rows(s, "input binary", [(bytearray(b),) for b, _ in BYTES]).select(F.lower(F.hex("input")).alias("input"), html.decoded(F.col("input")).alias("result")),
        "X2_visible_text": g(PAGES, "string", lambda c: F.replace(html.page_text(c), F.lit("\n"), F.lit("|"))), "X3_pages": x_pages, "X4_url_ids": g(URLS, "string", text.doc_id_of), "X4_table": x4_ids, "X5_links": x5_links,
        "X6_listed_ids": x6_listed, "X7_listing_urls": x7_urls,
    }


def _law_sql(c: str) -> str:
    """A law's normal name by patterns: the rules of the operator stated another way."""
    s = rf"regexp_replace(trim({c}), ',\s*de\s+\d+\s+de\s+[\p{{L}}\p{{N}}_]+(?:\s+de\s+\d+)?\s*$', '', 'i')"
    names = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in text.LAW_NAMES.items()) + "}"
    act = lambda kind: rf"regexp_extract({s}, '^{kind}\s*(?:n[°º.\s]*)?\s*(\d+(?:-[A-Za-z])?/\d+)', 1, 'i')"
    decree, law = act(r"(?:decreto[\s-]?lei|dl)"), act("lei")
    return f"case when {c} = '' then {c} else coalesce({names}[trim(lower({s}))], {names}[trim(lower({s}), '. ')], 'Decreto-Lei n.º ' || nullif({decree}, ''), 'Lei n.º ' || nullif({law}, ''), {s}) end"


def oracle_sql() -> dict[str, str]:
    from tessella.plans.audit_queries import _header_sql
    from tessella.plans.search_queries import S

    gold = lambda rows: _values(rows, "input, result")
    m = lambda k: f"(case when json_valid(metadata) then metadata end->>'{k}')"
    nb = lambda xs: "array_to_string(list_filter([" + ", ".join(f"e.{x}" for x in xs) + "], lambda p: p is not null and p <> ''), chr(10) || chr(10))"
    art = r"^\d+\.º(-[{c}])?(, n\.º \d+)?(, alínea [a-z]\))?$"
    iso = r"case when regexp_full_match(trim({c}), '\d{{4}}-\d{{2}}-\d{{2}}') then try_strptime(trim({c}), '%Y-%m-%d') when regexp_full_match(trim({c}), '\d{{2}}/\d{{2}}/\d{{4}}') then try_strptime(trim({c}), '{f}') when regexp_full_match(trim({c}), '\d{{2}}-\d{{2}}-\d{{4}}') then try_strptime(trim({c}), '%d-%m-%Y') end::date"
    x = "(select e.* from (select unnest(llm_extracted) from enhanced_docs where llm_extracted is not null) e)"
    truthy = "count(*) filter (keywords_search_query <> '') as {r}_keywords_search_query, {b} as {r}_liability_found, count(*) filter (len(parties) > 0) as {r}_parties"
    return {
        "P1_projection": "select doc_id, url, court_short, decision_date, process_number, legal_domain, is_auj, summary from documents",
        "P2_serving_row": "select distinct doc_id, court_short, " + iso.format(c="llm_extracted.decision_date", f="%m/%d/%Y") + " as decision_date, llm_extracted.legal_domain as legal_domain, coalesce(llm_extracted.is_jurisprudence_unification, false) as is_auj, array_to_string(list_sort(list_concat((select json_keys(to_json(llm_extracted)) from enhanced_docs where llm_extracted is not null limit 1), ['source_db', 'court', 'court_short'])), ',') as m_keys, source_db as m_source_db, coalesce(court, '') as m_court, court_short as m_court_short, llm_extracted.summary as m_summary, llm_extracted.liability_found::varchar as m_liability_found, coalesce(len(llm_extracted.parties), -1) as m_parties, llm_extracted.voting as m_voting, llm_extracted.keywords_search_query as m_keywords_search_query from enhanced_docs",
        "P3_embedding_texts": f"select distinct doc_id, left(coalesce(nullif(e.semantic_search_query, ''), nullif(e.summary, ''), ''), 12000) as embedding, left({nb(('semantic_search_query', 'legal_question', 'summary'))}, 12000) as embedding_context, left({nb(('ratio_decidendi', 'decision_outcome'))}, 12000) as embedding_ratio from (select doc_id, llm_extracted as e from enhanced_docs)",
        "P4_prompt": "select distinct doc_id, md5(p) as prompt_md5, length(p)::bigint as chars from (select doc_id, 'Court: ' || coalesce(nullif(court, ''), nullif(court_short, ''), '') || chr(10) || chr(10) || left(coalesce(full_text, ''), 80000) as p from raw_docs)",
        "P5_json_fields": f"with {S} select doc_id, metadata->>'decision_type' as decision_type, metadata->>'extraction_confidence' as extraction_confidence from s",
        "P6_json_guard": "select count(metadata) as texts, count(*) filter (json_valid(metadata)) as valid from documents",
        "P8_table": "select vec_id, 64::bigint as dim, round(list_sum(embedding::double[]), 4) as total, true as cut_is_null from embeddings",
        "T13_table": "with e as (select event_id, floor(value * 1048576)::bigint as b, floor(value * 60)::bigint as s from events where value is not null) select event_id, case when b < 1024 then printf('%.1f B', b::double) when b < 1048576 then printf('%.1f KB', b / 1024.0::double) when b < 1073741824 then printf('%.1f MB', b / 1048576.0::double) else printf('%.1f GB', b / 1073741824.0::double) end as size, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) as duration from e",
        "P8_vector_text": gold(VECTORS), "P10_reply": gold(REPLIES),
        "P9_rounding": "select event_id, round(value, 4) as four, round(value, 2) as two from events",
        "F10_F24_lengths": "select count(*) filter (length(full_text) >= 200) as long_enough, count(*) filter (contains(full_text, 'Processo')) as with_number, count(*) filter (contains(full_text, 'Relator')) as with_judge, count(*) filter (contains(full_text, 'Decisão Texto Integral') or contains(full_text, 'Acordam') or contains(upper(full_text), 'RELATÓRIO')) as with_body from raw_docs",
        "T5_shapes": _PLAIN_SQL,
        "F12_nonempty": "select " + ", ".join([truthy.format(r="truthy", b="count(*) filter (liability_found)"), truthy.format(r="present", b="count(liability_found)"), truthy.format(r="not_blank", b="count(liability_found)").replace("keywords_search_query <> ''", "regexp_matches(keywords_search_query, '\\S')", 1)]) + f" from {x}",
        "F14_F23_shapes": "select count(*) filter (regexp_full_match(decision_date, '\\d{4}-\\d{2}-\\d{2}')) as iso_dates, count(*) filter (regexp_matches(lower(summary), '[áéíóúâêôãõç]')) as accented, count(*) filter (regexp_matches(rtrim(semantic_search_query), '[.?]$')) as sentences, count(*) filter (len(parties) > 3) as large_lists, count(*) filter (year(d) > 2020) as late, count(*) filter (year(d) < 2000) as early from (select *, coalesce(try_strptime(trim(decision_date), '%Y-%m-%d'), try_strptime(trim(decision_date), '%d/%m/%Y'), try_strptime(trim(decision_date), '%d-%m-%Y')) as d from " + x + ")",
        "F16_F17_articles": f"select count(*) filter (regexp_matches(article, '{art.format(c='A-Z')}')) as canonical, count(*) filter (regexp_matches(article, '{art.format(c='A-Za-z')}')) as canonical_wide, count(*) filter (article is not null and not regexp_matches(article, '{art.format(c='A-Z')}')) as residual, count(*) filter (contains(lower(law), 'artigo')) as names_article, count(*) filter (upper(trim(law)) in ('CPC', 'CTS', 'CAP')) as abbreviated from legislation_cited",
        "F18_keywords": f"with k as (select list_transform(string_split({m('keywords_search_query')}, ','), lambda p: trim(p)) as p from documents where {m('keywords_search_query')} is not null) select case when len(p) < 5 then 'few' when len(list_filter(p, lambda q: regexp_matches(q, '[^a-z0-9 ]'))) > 0 then 'characters' when len(list_filter(p, lambda q: len(regexp_split_to_array(q, ' +')) not between 2 and 6)) > 0 then 'tokens' end as fault, count(*) as n from k group by 1",
        "T1_keywords": gold(KEYWORDS), "T3_law": gold(LAWS), "T4_clean": gold(CLEAN), "T5_T6_articles": gold(ARTICLES),
        "T1_keywords_table": f"with k as (select doc_id, {m('keywords_search_query')} as r from documents), p as (select doc_id, list_transform(string_split(r, ','), lambda p: trim(regexp_replace(regexp_replace(replace(replace(strip_accents(lower(p)), 'º', 'o'), 'ª', 'a'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) as p from k), f as (select doc_id, list_filter(p, lambda q: q <> '' and len(string_split(q, ' ')) between 2 and 6) as p from p), d as (select doc_id, list_filter(p, lambda q, i: list_position(p, q) = i) as p from f) select doc_id, array_to_string(p, ', ') as k from d where len(p) > 0",
        "T2_fold": "select law_id, replace(replace(strip_accents(law_name), 'º', 'o'), 'ª', 'a') as folded, replace(replace(strip_accents(law_name), 'º', 'o'), 'ª', 'a') as exact from law_catalog",
        "T3_law_table": f"select {_law_sql('law')} as name, count(*) as n from legislation_cited where law is not null group by 1",
        "T7_legislation": _values(LEGISLATION_DONE, "doc_id, article, law, citation_context, place"),
        "T8_unifying": _values(UNIFYING, "p, c, result"),
        "T8_table": f"with {S}, t as (select strip_accents(lower(coalesce(metadata->>'procedural_type', ''))) as p, strip_accents(lower(coalesce(metadata->>'case_type', ''))) as c from s) select count(*) filter (regexp_matches(p, 'unifor[a-z]{{0,6}}zacao|fixacao\\s+de\\s+jurispr|fixar\\s+jurispr|uniformizador') or regexp_matches(c, 'unifor[a-z]{{0,6}}zacao|fixacao\\s+de\\s+jurispr|fixar\\s+jurispr|uniformizador')) as unifying, count(*) as total from t",
        "T9_dates": f"select input, result::date as result from ({gold(DATES)})",
        "T9_table": "select " + iso.format(c="decision_date", f="%m/%d/%Y") + " as day, count(*) as n from jurisprudence_cited where decision_date is not null group by 1",
        "T12_any_date": "select coalesce(try_strptime(trim(decision_date), '%Y-%m-%d'), try_strptime(trim(decision_date), '%d/%m/%Y'), try_strptime(trim(decision_date), '%d-%m-%Y'))::date as day, count(*) as n from jurisprudence_cited where decision_date is not null group by 1",
        "T10_headers": "select distinct doc_id, " + ", ".join(f"{_header_sql('full_text', v)} as {k}" for k, v in HEADERS.items()) + " from raw_docs",
        "T13_sizes": gold(SIZES), "T13_times": gold(TIMES),
        "X1_decode": _values([(b.hex(), r) for b, r in BYTES], "input, result"), "X2_visible_text": gold(PAGES), "X4_url_ids": gold(URLS),
        "X4_table": "select doc_id, string_split(list_extract(string_split(rtrim(url, '/'), '/'), -1), '?')[1] as page_id from documents",
        "X3_pages": r"with l as (select lower(string_split(list_extract(string_split(rtrim(url, '/'), '/'), -1), '?')[1]) as doc_id, list_transform(string_split(replace(replace(full_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))) as l from raw_docs where url is not null), t as (select doc_id, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) as t from l) select distinct doc_id, md5(t) as text_md5 from t where length(t) >= 200",
        "X5_links": _values([("doc", "https://h.example/j.nsf/0/" + "a1" * 16 + "?OpenDocument"), ("doc", "https://h.example/j.nsf/0/" + "b2" * 16 + "?OpenDocument"), ("next", "https://h.example/?Start=201")], "kind, url"),
        "X6_listed_ids": "select distinct court_short, unnest(regexp_extract_all(url, '/([a-f0-9]{32})\\?OpenDocument', 1)) as id from documents",
        "X7_listing_urls": "select 'https://h.example/' || db || '/' || view_id || '?OpenView&Start=' || unnest(generate_series(1, approx_count, 100)) as url from court_catalog",
    }
