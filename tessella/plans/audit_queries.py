"""Queries: duplicates, set operations, audits, files, model calls, ingestion (A10-A27, J4-J10, W2-W5, U, S, K, M, T-K)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import articles, text
from tessella.operators import ann, dedup, models, quality
from tessella.session import shared_dir
from tessella.sources import files
from tessella.sources.corpus import serving
from tessella.sources.tables import table
from tessella.streaming import ingest

RAW = "doc_id string, url string, source_db string, court string, court_short string, full_text string, scraped_at timestamp_ntz"
CANONICAL = r"^\d+\.º(-[A-Za-z])?(, n\.º \d+)?(, alínea [a-z]\))?$"
LETTERS = "aeiousrntdlm"
CONTEXTS = ("supporting", "distinguishing", "criticizing", "referencing")
PRICES = [("small", 0.2, 0.9), ("large", 2.5, 9.0)]  # a million prompt and completion tokens


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_docs")


def _extracted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "enhanced_docs").where("llm_extracted is not null").select("doc_id", "court_short", "llm_extracted.*")


def w3_keep_last(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup.keep_last(_raw(spark, folder).select("doc_id", "scraped_at", "chunk_file", "line_no"), "doc_id", ["scraped_at", "chunk_file", "line_no"])
    return kept.select("doc_id", "scraped_at", "chunk_file", "line_no", F.col("first_seen.scraped_at").alias("first_scraped"))


def w4_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.keep_first(_raw(spark, folder).select("doc_id", "scraped_at", "chunk_file", "line_no"), "doc_id", ["scraped_at", "chunk_file", "line_no"])


def w5_rechunk(spark: SparkSession, folder: str) -> DataFrame:
    rows = dedup.rechunk(_raw(spark, folder).select("source_db", "doc_id", "scraped_at", "chunk_file", "line_no"), "source_db", ["doc_id", "scraped_at", "chunk_file", "line_no"], 100)
    return rows.groupBy("source_db", "chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def w2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling rate of each user's events; the sample number is the growing counter."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    counted = e.withColumn("done", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return quality.rolling_rate(counted, "ts", "done", 30, "user_id").select("event_id", F.round("rate", 6).alias("rate"))


def a10_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.duplicate_stats(_raw(spark, folder), "court_short", "doc_id")


def a11_places(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.duplicate_places(_raw(spark, folder), "doc_id", "chunk_file")


def a12_completeness(spark: SparkSession, folder: str) -> DataFrame:
    x = _extracted(spark, folder).dropDuplicates(["doc_id"])
    fields = {n: (F.col(n), "string") for n in ("summary", "legal_question", "decision_outcome", "voting")} | {n: (F.col(n), "array") for n in ("parties", "injuries")}
    return quality.completeness(x, "court_short", fields)


def a13_flags(spark: SparkSession, folder: str) -> DataFrame:
    return quality.flag_rates(table(spark, folder, "documents"), "court_short", F.col("is_auj"))


def a14_dates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.date_quality(_extracted(spark, folder).dropDuplicates(["doc_id"]), "court_short", F.col("decision_date"), future=2020)


def a16_coverage(spark: SparkSession, folder: str) -> DataFrame:
    catalog = table(spark, folder, "court_catalog").select("court_short", (F.col("approx_count") / 1000).cast("bigint").alias("expected"))
    docs = table(spark, folder, "documents").select("court_short")
    raw = _raw(spark, folder).select("doc_id", F.upper(F.trim("court_short")).alias("court_short")).distinct()
    return quality.coverage(catalog, {"documents": docs, "raw": raw}, "court_short", "expected")


def a18_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    x = _extracted(spark, folder).dropDuplicates(["doc_id"])
    lists = {n: F.col(n) for n in ("parties", "doctrine_cited", "timeline_events")}
    enums = {n: (F.col(n), CONTEXTS) for n in ("legislation_cited", "jurisprudence_cited", "doctrine_cited")}
    return quality.scorecard(x, "court_short", {n: F.col(n) for n in ("summary", "ratio_decidendi")}, lists, F.col("decision_date"), enums, F.col("summary"))


def a18_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _extracted(spark, folder).dropDuplicates(["doc_id"]).groupBy("extraction_confidence").agg(F.count("*").alias("n"))


def a19_depth(spark: SparkSession, folder: str) -> DataFrame:
    x = _extracted(spark, folder).dropDuplicates(["doc_id"]).where("parties is not null")
    return quality.depth(x, "court_short", F.size("parties"))


def a20_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clusters(table(spark, folder, "documents"), "legal_domain")


def a21_parties(spark: SparkSession, folder: str) -> DataFrame:
    return quality.frequencies(_extracted(spark, folder).dropDuplicates(["doc_id"]), F.col("parties"), ["role", "type"])


def a22_leading(spark: SparkSession, folder: str) -> DataFrame:
    x = _extracted(spark, folder).dropDuplicates(["doc_id"]).where("decision_outcome is not null")
    return x.groupBy(F.lower(F.regexp_extract("decision_outcome", r"^\s*([^\s,.;:]+)", 1)).alias("first_word")).agg(F.count("*").alias("n"))


def a23_laws(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "legislation_cited").where("law is not null").groupBy("law").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "law").limit(30)


def a23_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The extraction's legislation before and after normalizing: entries, canonical articles, distinct laws."""
    ok = lambda c: c.rlike(CANONICAL)
    x = _extracted(spark, folder).dropDuplicates(["doc_id"]).select("doc_id", F.posexplode("legislation_cited").alias("pos", "c")).where("c is not null").select("doc_id", "pos", "c.*")
    done = articles.normalized_legislation(x, ["doc_id"], "pos", "article", "law", "citation_context")
    count = lambda rows, stage: rows.agg(F.count("*").alias("entries"), F.count_if(ok(F.trim("article"))).alias("canonical"), F.count_distinct("law").alias("laws")).select(F.lit(stage).alias("stage"), "*")
    return count(x, "before").unionByName(count(done, "after"))


def a23_residual(spark: SparkSession, folder: str) -> DataFrame:
    """What is not canonical after expansion, most frequent first: 25 values."""
    x = table(spark, folder, "legislation_cited").where("article is not null").select(F.explode(articles.expand_articles(F.col("article"))).alias("place"))
    return x.where(~F.col("place").rlike(CANONICAL)).groupBy("place").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "place").limit(25)


def a24_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Extractions with their raw page, if there is one, by what says that they unify case law: labels, thesis, page header, flag."""
    x = _extracted(spark, folder).dropDuplicates(["doc_id"]).withColumn("stem", F.concat(F.lower(F.coalesce("court_short", F.lit(""))), F.lit("_"), "doc_id"))
    raw = dedup.keep_last(_raw(spark, folder).select("doc_id", "scraped_at", "full_text"), "doc_id", ["scraped_at"])
    pages = raw.select(F.col("doc_id").alias("page_id"), text.header_field(F.col("full_text"), "Descritores").alias("header"))
    both = x.withColumn("page_id", F.regexp_replace("stem", "^[^_]*_", "")).join(pages, "page_id", "left")
    signals = {
        "by_label": text.unifies_case_law(F.col("procedural_type"), F.col("case_type")), "by_thesis": text.states_thesis(F.col("summary"), F.col("ratio_decidendi"), F.col("legal_question")),
        "by_header": text.unifies_case_law(F.col("header")), "by_flag": F.col("is_jurisprudence_unification"), "has_page": F.col("header").isNotNull(),
    }
    return quality.signal_combinations(both, signals)


def a25_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Costs of two models over every raw text, tokens taken as characters over four."""
    models_ = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("inp"), F.lit(o).alias("outp")) for m, i, o in PRICES])
    calls = _raw(spark, folder).select(F.floor(F.length("full_text") / 4).alias("prompt_tokens"), F.lit(500).alias("completion_tokens"), F.lit(100).alias("cached_tokens"))
    priced = calls.select("*", F.explode(models_).alias("m")).select("*", "m.*").withColumn("cost", (F.col("prompt_tokens") * F.col("inp") + F.col("completion_tokens") * F.col("outp")) / 1e6)
    return quality.usage_totals(priced, "model", 387_780)


def a17_sizes(spark: SparkSession, folder: str) -> DataFrame:
    parts = [files.sizes(spark, f"{folder}/{n}.parquet").select(F.lit(n).alias("stage"), "bytes") for n in ("raw_docs", "enhanced_docs", "documents")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("stage").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def j4_unprocessed(spark: SparkSession, folder: str) -> DataFrame:
    done = files.progress(table(spark, folder, "enhanced_docs"), "source_db", "doc_id")
    return dedup.unseen(_raw(spark, folder).select("doc_id").distinct(), done, "doc_id")


def j5_missing(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.missing(_raw(spark, folder).select(F.upper("doc_id").alias("doc_id")), table(spark, folder, "enhanced_docs"), "doc_id")


def j6_sample(spark: SparkSession, folder: str) -> DataFrame:
    sample = table(spark, folder, "enhanced_docs").select("doc_id").distinct()
    return _raw(spark, folder).join(sample, "doc_id", "left_semi").groupBy("court_short").agg(F.count("*").alias("n"))


def j9_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The side-by-side table with each document's columns in one text, as the columns differ with the raters there are."""
    wide = j9_pivot(spark, folder)
    raters = sorted(c for c in wide.columns if c != "doc_id")
    named = [F.when(F.col(r).isNotNull(), F.concat(F.lit(f"{r}="), F.col(r).cast("string"))) for r in raters] or [F.lit(None).cast("string")]
    return wide.select("doc_id", F.concat_ws("|", *named).alias("grades"))


def j9_pivot(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "reading_labels").where("grade is not null").groupBy("doc_id", "rater").agg(F.max("grade").alias("grade"))
    return models.side_by_side(x, "doc_id", "rater", "grade")


def j10_lookup(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "court_catalog").select("court_short", "db")
    return table(spark, folder, "documents").join(c, "court_short").groupBy("db").agg(F.count("*").alias("n"))


def u_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Union, difference and intersection of the ids of two stages, by size."""
    raw, enh = (table(spark, folder, n).select("doc_id") for n in ("raw_docs", "enhanced_docs"))
    sets = {"union": raw.union(enh).distinct(), "difference": raw.subtract(enh), "intersection": raw.intersect(enh), "bag": raw.unionByName(enh)}
    out = None
    for name, rows in sets.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def s7_listing(spark: SparkSession, folder: str) -> DataFrame:
    pages = [(i * 100 + 1, n) for i, n in enumerate([90, 50, 0, 0, 30, 0, 0, 0, 5])]
    return dedup.listing_pages(spark.createDataFrame(pages, "page bigint, new bigint"), "page", "new")


def s1_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows written as shards with blank and malformed lines among them, read back."""
    path = _path(spark, "lines")
    lines = _raw(spark, folder).select(F.to_json(F.struct("doc_id", "url", "source_db", "court", "court_short", "full_text", "scraped_at")).alias("value"))
    noise = spark.createDataFrame([("",), ('{"doc_id": "cut',), ("   ",)], "value string")
    lines.union(noise).write.text(path)
    return files.read_lines(spark, path, RAW).where("doc_id is not null").groupBy("source_db").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum(F.length("full_text")).alias("chars"))


def a15_validity(spark: SparkSession, folder: str) -> DataFrame:
    path = _path(spark, "validity")
    table(spark, folder, "documents").select(F.regexp_replace(F.coalesce("metadata", F.lit("")), "[\\r\\n]+", " ").alias("value")).write.text(path)
    return files.validity(spark, path)


def k1_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling write of at most 500 documents a shard, an append, and the reading of both."""
    path = _path(spark, "shards")
    rows = _raw(spark, folder).select("doc_id", "source_db", "court_short", "full_text")
    files.write_shards(rows, path, per_shard=500)
    files.write_shards(rows.where("court_short is null"), path, append=True)
    back = files.read_lines(spark, path, "doc_id string, source_db string, court_short string, full_text string")
    sizes = back.groupBy("shard").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("documents"), (F.max("n") <= 500).alias("within"))


def s4_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document per file: the court catalog, a file for each court."""
    path = _path(spark, "documents")
    table(spark, folder, "court_catalog").select("court_short", "db", "label").repartition(12, "court_short").write.option("maxRecordsPerFile", 1).json(path)
    return files.read_documents(spark, path, "court_short string, db string, label string").where(F.col("key").isNotNull()).select("court_short", "db", "label")


def s11_state(spark: SparkSession, folder: str) -> DataFrame:
    return files.progress(_raw(spark, folder), "source_db", "doc_id").groupBy("source_db").agg(F.count("*").alias("ids"))


def s10_state(spark: SparkSession, folder: str) -> DataFrame:
    """A state file, a corrupt one and a missing one."""
    path = _path(spark, "state")
    spark.createDataFrame([('{"a": ["1", "2"], "b": ["3"]}',)], "value string").coalesce(1).write.text(f"{path}/good")
    spark.createDataFrame([('{"a": ["1", ',)], "value string").coalesce(1).write.text(f"{path}/bad")
    return files.read_state(spark, f"{path}/good").unionByName(files.read_state(spark, f"{path}/bad")).unionByName(files.read_state(spark, f"{path}/none"))


def s3_limited(spark: SparkSession, folder: str) -> DataFrame:
    return files.first_per(_raw(spark, folder).select("source_db", "chunk_file", "line_no", "doc_id"), ["source_db"], ["chunk_file", "line_no", "doc_id"], 5)


def k6_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """A table with repeats replaced in its place by its deduplicated form."""
    path = _path(spark, "rewrite")
    _raw(spark, folder).select("doc_id").write.parquet(path)
    dedup.rewrite_deduplicated(_raw(spark, folder).select("doc_id", "scraped_at", "chunk_file", "line_no"), "doc_id", ["scraped_at", "chunk_file", "line_no"], path)
    return spark.read.parquet(path)


def k4_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over arriving shards, the second with rescraped rows: each id once, in its latest form."""
    path = _path(spark, "ingest")
    lines = _raw(spark, folder).select("doc_id", "court_short", "full_text", "scraped_at")
    newest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("scraped_at")))
    turns = lines.withColumn("turn", newest)
    schema = "doc_id string, court_short string, full_text string, scraped_at timestamp_ntz"
    for late in ("turn > 1", "turn = 1"):
        turns.where(late).drop("turn").write.mode("append").json(f"{path}/in")
        ingest.ingest(spark, f"{path}/in", f"{path}/out", schema, lambda rows: rows.withColumn("chars", F.length("full_text").cast("bigint")).drop("full_text"))
    return ingest.read(spark, f"{path}/out").select("doc_id", "scraped_at", "chars")


def m3_embed(spark: SparkSession, folder: str) -> DataFrame:
    """Batched embeddings by a function that SQL can check, so that every vector must be at its own document."""
    x = table(spark, folder, "documents").select("doc_id", models.embedded(F.col("summary"), models.counting_embedder(LETTERS), 50).alias("v"))
    return x.select("doc_id", F.array_join(F.transform("v", lambda y: y.cast("int").cast("string")), ",").alias("vector"))


def _amounts(pattern: str):  # noqa: ANN202
    """A rule-based extractor in place of a model: number of words and the first amount named."""
    import re

    found = re.compile(pattern)

    def call(value: str) -> dict:
        m = found.search(value)
        return {"words": len(value.split()), "amount": m.group() if m else None, "unknown": 1}

    return call


EXTRACT = T.StructType([T.StructField("words", T.LongType()), T.StructField("amount", T.StringType())])


def m1_extract(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null and text <> ''")
    return d.select("doc_id", models.extracted(F.col("text"), _amounts(r"\d[\d.]*,\d\d(?= euros)"), EXTRACT).alias("x")).select("doc_id", "x.words", "x.amount")


def p10_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Replies as models give them, plain, fenced, cut off or with a field missing, read back against a schema."""
    d = serving(spark, folder).select("doc_id", "summary", F.year("decision_date").alias("year"))
    reply = F.to_json(F.struct("summary", "year", F.lit("x").alias("unknown")))
    kind = F.col("doc_id") % 4
    made = F.when(kind == 0, reply).when(kind == 1, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("```"), reply, F.lit("```"))).otherwise(F.left(reply, F.length(reply) - 2))
    schema = T.StructType([T.StructField("summary", T.StringType()), T.StructField("year", T.IntegerType())])
    return d.select("doc_id", models.parsed_reply(made, schema, ("summary",)).alias("r")).select("doc_id", F.col("r").isNotNull().alias("valid"), "r.summary", "r.year")


def p11_postprocess(spark: SparkSession, folder: str) -> DataFrame:
    """One extraction's keywords, legislation and flag in their final form."""
    x = table(spark, folder, "enhanced_docs").dropDuplicates(["doc_id"])
    done = models.postprocessed(x, "doc_id", "llm_extracted")
    return done.select("doc_id", "keywords", "is_auj", F.coalesce(F.size("legislation"), F.lit(0)).cast("bigint").alias("places") > 0, F.array_join(F.array_sort(F.array_distinct(F.transform("legislation", lambda p: p["citation_context"]))), ",").alias("contexts")).toDF("doc_id", "keywords", "is_auj", "has_places", "contexts")


def s2_enhanced(spark: SparkSession, folder: str) -> DataFrame:
    """The nested records written as JSON lines and read back with their schema, compared field by field through their counts."""
    path = _path(spark, "enhanced")
    rows = table(spark, folder, "enhanced_docs").select("doc_id", "source_db", "llm_extracted")
    files.write_shards(rows, path, per_shard=1000)
    back = files.read_lines(spark, path, rows.schema)
    return back.groupBy("source_db").agg(
        F.count("*").alias("n"), F.count("llm_extracted").alias("extracted"), F.sum(F.coalesce(F.size("llm_extracted.parties"), F.lit(0)) * F.col("llm_extracted.parties").isNotNull().cast("int")).alias("parties"),
        F.count("llm_extracted.summary").alias("summaries"), F.count_if(F.exists("llm_extracted.doctrine_cited", lambda d: d.isNull())).alias("with_empty"), F.round(F.sum(F.coalesce(F.aggregate("llm_extracted.amounts_involved", F.lit(0.0), lambda s, a: s + F.coalesce(a["amount"], F.lit(0.0))), F.lit(0.0))), 2).alias("amounts"),
    )


def a26_left(spark: SparkSession, folder: str) -> DataFrame:
    """Time left of each user to a thousand events, at the rolling rate."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    counted = e.withColumn("done", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return quality.time_left(counted, "ts", "done", F.lit(1000), "user_id").select("user_id", F.col("done").cast("bigint").alias("done"), F.round("seconds_left", 2).alias("seconds_left"))


def tk7_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded sample of ten documents."""
    return table(spark, folder, "documents").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(10)


def t11_thesis(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.agg(F.count_if(text.states_thesis(F.col("summary"), F.col("text"))).alias("by_thesis"), F.count_if(text.unifies_case_law(F.col("text"))).alias("by_words"))


def a27_log(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a log by level; the log is written from the events."""
    path = _path(spark, "log")
    table(spark, folder, "events").select(F.concat_ws(" ", F.when(F.col("value") < 10, "ERROR").otherwise("INFO"), "event_type", F.col("event_id").cast("string")).alias("value")).write.text(path)
    lines = spark.read.text(path)
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.col("value").contains("ERROR")).alias("errors"))


def s8_keyset(spark: SparkSession, folder: str) -> DataFrame:
    """One page of a keyset scan: the thousand ids after the middle one."""
    d = _raw(spark, folder).select("doc_id").distinct()
    return d.where(F.col("doc_id") > "8" + "0" * 31).orderBy("doc_id").limit(1000)


def s8_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages of a keyset scan, a thousand ids each."""
    pages = dedup.keyset_pages(_raw(spark, folder), "doc_id", 1000)
    return pages.groupBy("page").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"))


def k5_concat(spark: SparkSession, folder: str) -> DataFrame:
    """One ordered file per database, read back by line: files, lines, and whether the lines stand in order."""
    path = _path(spark, "concat")
    files.concatenated(_raw(spark, folder).select("source_db", "doc_id", "chunk_file", "line_no"), "source_db", ["chunk_file", "line_no", "doc_id"], path)
    back = spark.read.schema("doc_id string, chunk_file string, line_no bigint, source_db string").json(path).withColumns({"file": F.col("_metadata.file_path"), "at": F.monotonically_increasing_id()})
    at = Window.partitionBy("source_db", "file").orderBy("at")
    place = F.struct("chunk_file", "line_no", "doc_id")
    back = back.withColumn("rising", F.coalesce(place >= F.lag(place).over(at), F.lit(True)))
    return back.groupBy("source_db").agg(F.count_distinct("file").alias("files"), F.count("*").alias("lines"), F.bool_and("rising").alias("ordered"))


def k8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A summary record per court written as JSON and read back."""
    path = _path(spark, "summaries")
    table(spark, folder, "documents").where("court_short is not null").groupBy("court_short").agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("court_short string, n bigint").json(path)


def k9_index(spark: SparkSession, folder: str) -> DataFrame:
    """The vector index stored by list and read back: every vector is in it once."""
    path = _path(spark, "index")
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    ann.index(vectors, "embedding", ann.centroids(vectors, "embedding", 16)).write.partitionBy("list").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("vectors"), F.count_distinct("vec_id").alias("ids"), (F.count_distinct("list") <= 16).alias("lists"))


def m4_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Two stand-in models over every document, with scores and costs, cheapest first."""
    rules = {"large": (_amounts(r"\d[\d.]*,\d\d(?= euros)"), 2.5, 9.0), "small": (_amounts(r"\d+(?= dias)"), 0.2, 0.9)}
    found = models.benchmark(table(spark, folder, "documents"), "text", rules, EXTRACT)
    return found.select(F.col("place").cast("bigint").alias("place"), "model", "calls", "answered", "filled", "prompt_tokens")


def queries() -> dict:
    return {
        "A23_audit": a23_audit, "A23_residual": a23_residual, "A26_time_left": a26_left, "P10_parse": p10_parse, "P11_postprocess": p11_postprocess, "S2_enhanced": s2_enhanced,
        "T11_thesis": t11_thesis, "A27_log_lines": a27_log, "S8_keyset": s8_keyset, "S8_keyset_pages": s8_pages, "K5_concat": k5_concat, "K8_summaries": k8_documents, "K9_index": k9_index, "M4_benchmark": m4_benchmark,
        "S9_scan": lambda s, f: table(s, f, "documents").select("doc_id", "source", "lang"),
        "A10_duplicates": a10_duplicates, "A11_dup_places": a11_places, "A12_completeness": a12_completeness, "A13_flag_rates": a13_flags, "A14_date_quality": a14_dates, "A15_json_validity": a15_validity,
        "A16_coverage": a16_coverage, "A17_sizes": a17_sizes, "A18_scorecard": a18_scorecard, "A18_confidence": a18_confidence, "A19_depth": a19_depth, "A20_clusters": a20_clusters, "A21_parties": a21_parties,
        "A22_leading_word": a22_leading, "A23_law_counts": a23_laws, "A24_signals": a24_signals, "A25_usage": a25_usage, "A26_W2_rolling_rate": w2_rolling,
        "W3_keep_last": w3_keep_last, "W4_keep_first": w4_keep_first, "W5_rechunk": w5_rechunk,
        "J4_unprocessed": j4_unprocessed, "J5_missing": j5_missing, "J6_sample_rows": j6_sample, "J9_models": j9_listing, "J10_lookup": j10_lookup, "U_set_operations": u_sets,
        "S1_S2_lines": s1_lines, "S3_limited": s3_limited, "S4_documents": s4_documents, "S7_listing_walk": s7_listing, "S10_state": s10_state, "S11_state": s11_state,
        "K1_K3_shards": k1_shards, "K4_ingest": k4_ingest, "K6_rewrite": k6_rewrite, "M1_extract": m1_extract, "M3_embed": m3_embed, "TK7_sample": tk7_sample,
    }


_AMOUNT = "nullif(regexp_extract(t, '(\\d[\\d.]*,\\d\\d) euros', 1), '')"
_FOLDED = "replace(replace(strip_accents(lower({c})), 'º', 'o'), 'ª', 'a')"


def _header_sql(c: str, key: str) -> str:
    """The lines under a label up to the next one, by a pattern that reads the next label too."""
    head = f"replace(replace(left({c}, 4000), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"nullif(trim(regexp_extract({head} || chr(10) || 'x:' || chr(10), '(?s)(?:^|\\n){key}:?[ \\t]*\\n(.*?)\\n[^\\n]{{1,60}}:[ \\t]*\\n', 1)), '')"


def oracle_sql() -> dict[str, str]:
    x = "(select doc_id, court_short, llm_extracted as e, row_number() over (partition by doc_id) as r from enhanced_docs where llm_extracted is not null)"
    from tessella.plans.search_queries import S

    last = "select doc_id, scraped_at, chunk_file, line_no from (select *, row_number() over (partition by doc_id order by scraped_at {d}, chunk_file {d}, line_no {d}) as r from raw_docs) where r = 1"
    anydate = "coalesce(try_strptime(trim(e.decision_date), '%Y-%m-%d'), try_strptime(trim(e.decision_date), '%d/%m/%Y'), try_strptime(trim(e.decision_date), '%d-%m-%Y'))::date"
    pct = lambda n, c: f"select court_short, '{n}' as field, round(avg(({c})::int) * 100, 2) as pct from f group by 1"
    strings = ("summary", "legal_question", "decision_outcome", "voting")
    bad = lambda n: f"coalesce(sum(len(list_filter(e.{n}, lambda q: q is not null and (q.citation_context is null or q.citation_context not in {CONTEXTS})))), 0)::bigint as bad_{n}"
    return {
        "T11_thesis": "with t as (select strip_accents(lower(coalesce(text, ''))) as t, strip_accents(lower(concat_ws(' ', summary, text))) as b from documents) select count(*) filter (regexp_matches(b, 'fixa-se a seguinte jurisprudencia|fixa jurisprudencia|uniformiza(?:-se)? (?:a )?jurisprudencia|acordao uniformizador')) as by_thesis, count(*) filter (regexp_matches(t, 'unifor[a-z]{0,6}zacao|fixacao\\s+de\\s+jurispr|fixar\\s+jurispr|uniformizador')) as by_words from t",
        "A27_log_lines": "select count(*) as lines, count(*) filter (value < 10) as errors from events",
        "S8_keyset": "select distinct doc_id from raw_docs where doc_id > '8' || repeat('0', 31) order by doc_id limit 1000",
        "S8_keyset_pages": "select floor((r - 1) / 1000)::bigint as page, min(doc_id) as first_id, max(doc_id) as last_id, count(*) as n from (select doc_id, row_number() over (order by doc_id) as r from (select distinct doc_id from raw_docs where doc_id is not null)) group by 1",
        "K5_concat": "select source_db, 1::bigint as files, count(*) as lines, true as ordered from raw_docs group by 1",
        "K8_summaries": "select court_short, count(*) as n from documents where court_short is not null group by 1",
        "K9_index": "select count(*) as vectors, count(distinct vec_id) as ids, true as lists from embeddings",
        "M4_benchmark": f"with d as (select text as t, floor(length(text) / 4)::bigint as p from documents where text <> ''), m as (select 'large' as model, p, 1 + ({_AMOUNT} is not null)::int as n, 2.5 as price from d union all select 'small', p, 1 + regexp_matches(t, '[0-9]+ dias')::int, 0.2 from d) select row_number() over (order by sum(p) * price) as place, model, count(*) as calls, count(*) as answered, round(avg(n) / 2, 6) as filled, sum(p)::bigint as prompt_tokens from m group by model, price",
        "A26_time_left": "with c as (select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as done from events), s as (select *, (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6 as dt, done - lag(done) over w as dv from c window w as (partition by user_id order by ts, event_id)), r as (select *, sum(dv) over l / nullif(sum(dt) over l, 0) as rate, row_number() over (partition by user_id order by ts desc, event_id desc) as back from s window l as (partition by user_id order by ts, event_id rows between 29 preceding and current row)) select user_id, done, case when rate > 0 then round(greatest(1000 - done, 0) / rate, 2) end as seconds_left from r where back = 1",
        "P10_parse": "select doc_id, valid, case when valid then summary end as summary, case when valid then year end as year from (select doc_id, summary, year(decision_date)::int as year, summary is not null and doc_id % 4 <> 3 as valid from documents)",
        "P11_postprocess": f"with d as (select doc_id, e from {x} where r = 1 union all select distinct doc_id, null from enhanced_docs where doc_id not in (select doc_id from enhanced_docs where llm_extracted is not null)), k as (select *, {_FOLDED.format(c='e.procedural_type')} as p, {_FOLDED.format(c='e.case_type')} as c, e.keywords_search_query as r, list_filter(e.legislation_cited, lambda q: q is not null) as l from d), s as (select *, list_transform(case when contains(r, ',') or not contains(r, chr(10)) then string_split(r, ',') else regexp_split_to_array(r, '\\r\\n|[\\n\\r]') end, lambda q: trim(regexp_replace(regexp_replace({_FOLDED.format(c='q')}, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) as w from k), f as (select *, list_filter(w, lambda q: q <> '' and len(string_split(q, ' ')) between 2 and 6) as v from s) select doc_id, nullif(array_to_string(list_filter(v, lambda q, i: list_position(v, q) = i), ', '), '') as keywords, case when e is not null then coalesce(e.is_jurisprudence_unification, false) or coalesce(regexp_matches(p, '{text.UNIFIES}'), false) or coalesce(regexp_matches(c, '{text.UNIFIES}'), false) end as is_auj, coalesce(len(l) > 0, false) as has_places, case when len(l) > 0 then array_to_string(list_sort(list_distinct(list_transform(l, lambda q: case when lower(trim(q.citation_context)) in {CONTEXTS} then lower(trim(q.citation_context)) else 'referencing' end))), ',') end as contexts from f",
        "S2_enhanced": "select source_db, count(*) as n, count(llm_extracted) as extracted, sum(coalesce(len(llm_extracted.parties), 0))::bigint as parties, count(llm_extracted.summary) as summaries, count(*) filter (len(list_filter(llm_extracted.doctrine_cited, lambda d: d is null)) > 0) as with_empty, round(sum(coalesce(list_sum(list_transform(llm_extracted.amounts_involved, lambda a: coalesce(a.amount, 0))), 0)), 2) as amounts from enhanced_docs group by 1",
        "S9_scan": "select doc_id, source, lang from documents",
        "A10_duplicates": "select court_short, sum(n)::bigint as lines, count(*) as unique_ids, count(*) filter (n > 1) as dup_ids, sum(n - 1)::bigint as extra_lines from (select court_short, doc_id, count(*) as n from raw_docs group by all) group by 1",
        "A11_dup_places": "select count(*) filter (f > 1) as cross_file_ids, count(*) filter (f = 1) as same_file_ids from (select doc_id, count(*) as n, count(distinct chunk_file) as f from raw_docs group by 1) where n > 1",
        "A12_completeness": f"with d as (select * from {x} where r = 1), f as (select * from d), o as (" + " union all ".join([*[pct(n, f"e.{n} is not null and e.{n} <> ''") for n in strings], *[pct(n, f"e.{n} is not null and len(e.{n}) > 0") for n in ("parties", "injuries")]]) + ") select *, case when pct >= 80 then 'ok' when pct >= 50 then 'weak' else 'poor' end as mark from o",
        "A13_flag_rates": "select court_short, count(*) as total, count(*) filter (is_auj) as flagged, round(count(*) filter (is_auj) / count(*) * 100, 4) as rate from documents where court_short is not null group by rollup (court_short)",
        "A14_date_quality": f"with d as (select court_short, e.decision_date as raw, {anydate} as d from {x} where r = 1) select court_short, min(d) as min_date, max(d) as max_date, count(*) filter (coalesce(trim(raw), '') = '') as missing, count(*) filter (coalesce(trim(raw), '') <> '' and d is null) as invalid, count(*) filter (year(d) > 2020) as future, count(*) filter (year(d) < 1900) as too_old from d group by 1",
        "A15_json_validity": "with l as (select regexp_replace(coalesce(metadata, ''), '[\\r\\n]+', ' ', 'g') as v from documents) select count(*) as lines, count(*) filter (trim(v) = '') as blank, count(*) filter (trim(v) <> '' and not json_valid(v)) as invalid from l",
        "A16_coverage": "with c as (select court_short, (approx_count / 1000)::double as q from court_catalog), e as (select court_short, trunc(q)::bigint as expected from c), d as (select court_short, count(*) as n from documents group by 1), r as (select court_short, count(*) as n from (select distinct doc_id, upper(trim(court_short)) as court_short from raw_docs) group by 1) select e.court_short, expected, coalesce(d.n, 0) as documents, coalesce(r.n, 0) as raw, round(coalesce(d.n, 0) / nullif(expected, 0) * 100, 4) as pct, coalesce(d.n, 0) < expected * 0.99 as incomplete from e left join d on d.court_short = e.court_short left join r on r.court_short = e.court_short",
        "A18_scorecard": f"select court_short, count(*) as documents, " + ", ".join(f"round(avg(coalesce(regexp_matches(e.{n}, '\\S'), false)::int), 4) as fill_{n}" for n in ("summary", "ratio_decidendi")) + ", " + ", ".join(f"round(avg(coalesce(len(e.{n}), 0)), 4) as mean_{n}" for n in ("parties", "doctrine_cited", "timeline_events")) + ", count(*) filter (not regexp_full_match(e.decision_date, '\\d{4}-\\d{2}-\\d{2}')) as bad_dates, " + ", ".join(map(bad, ("legislation_cited", "jurisprudence_cited", "doctrine_cited"))) + ", count(*) filter (e.summary is not null and not regexp_matches(lower(e.summary), '[ãõçáéíóúâêôà]|(^|[^\\p{L}\\p{N}_])(de|que|não|para|com|uma|dos|das)($|[^\\p{L}\\p{N}_])')) as foreign" + f" from {x} where r = 1 group by 1",
        "A18_confidence": f"select e.extraction_confidence as extraction_confidence, count(*) as n from {x} where r = 1 group by 1",
        "A19_depth": f"with s as (select court_short, len(e.parties) as s from {x} where r = 1 and e.parties is not null), o as (select *, row_number() over (partition by court_short order by s) as p, count(*) over (partition by court_short) as n from s) select court_short, round(avg(s), 4) as mean, median(s) as median, max(s) filter (p = floor(n * 0.95) + 1) as p95, max(s) as largest from o group by 1",
        "A20_clusters": "with v as (select replace(replace(strip_accents(lower(trim(legal_domain))), 'º', 'o'), 'ª', 'a') as folded, legal_domain as v, count(*) as n from documents where legal_domain is not null group by all) select folded, sum(n)::bigint as total, count(*) as n_variants, string_agg(v || '=' || n, ' | ' order by n desc, v) as variants from v group by 1",
        "A21_parties": f"select p.role as role, p.type as type, count(*) as n from (select unnest(e.parties) as p from {x} where r = 1) where p is not null group by all",
        "A22_leading_word": f"select lower(regexp_extract(e.decision_outcome, '^\\s*([^\\s,.;:]+)', 1)) as first_word, count(*) as n from {x} where r = 1 and e.decision_outcome is not null group by 1",
        "A23_law_counts": "select law, count(*) as n from legislation_cited where law is not null group by 1 order by n desc, law limit 30",
        "A24_signals": f"with p as (select doc_id, {_header_sql('full_text', 'Descritores')} as h from (select doc_id, full_text, row_number() over (partition by doc_id order by scraped_at desc) as r from raw_docs) where r = 1), d as (select e, h from {x} d left join p on p.doc_id = d.doc_id where d.r = 1), u as (select {_FOLDED.format(c='e.procedural_type')} as a, {_FOLDED.format(c='e.case_type')} as b, {_FOLDED.format(c='h')} as h, {_FOLDED.format(c="concat_ws(' ', e.summary, e.ratio_decidendi, e.legal_question)")} as t, e.is_jurisprudence_unification as f from d) select coalesce(regexp_matches(a, '{text.UNIFIES}'), false) or coalesce(regexp_matches(b, '{text.UNIFIES}'), false) as by_label, coalesce(regexp_matches(t, '{text.THESIS}'), false) as by_thesis, coalesce(regexp_matches(h, '{text.UNIFIES}'), false) as by_header, coalesce(f, false) as by_flag, h is not null as has_page, count(*) as n from u group by all",
        "A25_usage": "with p as (select * from (values ('small', 0.2, 0.9), ('large', 2.5, 9.0)) x(model, i, o)), c as (select model, floor(length(full_text) / 4)::bigint as t, (floor(length(full_text) / 4) * i::double + 500 * o::double) / 1e6 as cost from raw_docs, p), g as (select model, count(*) as calls, sum(t)::bigint as prompt_tokens, (count(*) * 500)::bigint as completion_tokens, (count(*) * 100)::bigint as cached_tokens, round(sum(cost), 6) as cost from c group by 1) select *, round(cached_tokens / prompt_tokens * 100, 4) as cached_pct, round(cost / calls, 6) as cost_per_call, round(cost / calls * 387780, 2) as projected_cost from g",
        "A26_W2_rolling_rate": "with c as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as done from events), s as (select *, (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6 as dt, done - lag(done) over w as dv from c window w as (partition by user_id order by ts, event_id)) select event_id, round(sum(dv) over l / nullif(sum(dt) over l, 0), 6) as rate from s window l as (partition by user_id order by ts, event_id rows between 29 preceding and current row)",
        "W3_keep_last": f"select l.*, f.scraped_at as first_scraped from ({last.format(d='desc')}) l join ({last.format(d='asc')}) f on f.doc_id = l.doc_id",
        "W4_keep_first": last.format(d="asc"), "K6_rewrite": last.format(d="desc"),
        "W5_rechunk": "select source_db, floor((r - 1) / 100)::bigint as chunk, count(*) as n, min(doc_id) as first_id from (select *, row_number() over (partition by source_db order by doc_id, scraped_at, chunk_file, line_no) as r from raw_docs) group by all",
        "J4_unprocessed": "select distinct doc_id from raw_docs where doc_id not in (select doc_id from enhanced_docs)",
        "J5_missing": "select distinct lower(doc_id) as id from raw_docs where lower(doc_id) not in (select lower(doc_id) from enhanced_docs)",
        "J6_sample_rows": "select court_short, count(*) as n from raw_docs where doc_id in (select doc_id from enhanced_docs) group by 1",
        "J9_models": "select doc_id, string_agg(rater || '=' || grade, '|' order by rater) as grades from (select doc_id, rater, max(grade) as grade from reading_labels where grade is not null and rater is not null group by 1, 2) group by 1",
        "J10_lookup": "select db, count(*) as n from documents d join court_catalog c on c.court_short = d.court_short group by 1",
        "U_set_operations": "with r as (select doc_id from raw_docs), e as (select doc_id from enhanced_docs) select 'union' as operation, count(*) as n from (select * from r union select * from e) union all select 'difference', count(*) from (select * from r except select * from e) union all select 'intersection', count(*) from (select * from r intersect select * from e) union all select 'bag', count(*) from (select * from r union all select * from e)",
        "S1_S2_lines": "select source_db, count(*) as n, count(distinct doc_id) as ids, sum(length(full_text))::bigint as chars from raw_docs group by 1",
        "S3_limited": "select source_db, chunk_file, line_no, doc_id from (select *, row_number() over (partition by source_db order by chunk_file, line_no, doc_id) as r from raw_docs) where r <= 5",
        "S4_documents": "select court_short, db, label from court_catalog",
        "S7_listing_walk": "select * from (values (1, 90), (101, 50), (201, 0), (301, 0), (401, 30), (501, 0), (601, 0), (701, 0)) x(page, new)",
        "S10_state": "select * from (values ('a', '1'), ('a', '2'), ('b', '3')) x(group_name, id)",
        "S11_state": "select source_db, count(distinct doc_id) as ids from raw_docs group by 1",
        "K1_K3_shards": "select count(*) + count(*) filter (court_short is null) as documents, true as within from raw_docs",
        "K4_ingest": "select doc_id, scraped_at, length(full_text)::bigint as chars from (select *, row_number() over (partition by doc_id order by scraped_at desc) as r from raw_docs) where r = 1",
        "M1_extract": f"select doc_id, len(regexp_extract_all(text, '[^\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+')) as words, {_AMOUNT.replace('(t,', '(text,')} as amount from documents where text <> ''",
        "M3_embed": "select doc_id, case when trim(summary) <> '' then concat_ws(',', " + ", ".join(f"length(summary) - length(replace(summary, '{c}', ''))" for c in LETTERS) + ") end as vector from documents",
    }
