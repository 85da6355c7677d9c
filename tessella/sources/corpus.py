"""The serving table assembled from the stored tables, and the query vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import table

#: Each vector field of a document is the stored vector number (doc_id * a + b) % MODULUS, null where there is none.
VECTOR_FIELDS = {"embedding": (1, 0), "embedding_context": (7, 167), "embedding_ratio": (13, 333)}
MODULUS = 997
DOC_COLUMNS = ("doc_id", "url", "court_short", "decision_date", "process_number", "legal_domain", "is_auj", "summary", "metadata")


def serving(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with full_text, valid JSON metadata only, and its promoted fields decision_type, extraction_confidence and keywords_search_query."""
    docs = table(spark, folder, "documents")
    v = F.try_parse_json("metadata")
    field = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    return docs.select(
        "doc_id", "url", "court_short", "decision_date", "process_number", "legal_domain", "is_auj", F.col("text").alias("full_text"), "summary",
        F.when(v.isNotNull(), F.col("metadata")).alias("metadata"), field("decision_type").alias("decision_type"), field("extraction_confidence").alias("extraction_confidence"),
        field("keywords_search_query").alias("keywords_search_query"),
    )


def with_vectors(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """The three vector fields joined on; the vector table is small and Spark picks the join by its size."""
    stored = table(spark, folder, "embeddings")
    for name, (a, b) in VECTOR_FIELDS.items():
        one = stored.select(F.col("vec_id").alias("_v"), F.transform("embedding", lambda x: x.cast("double")).alias(name))
        docs = docs.withColumn("_k", (F.col("doc_id") * a + b) % MODULUS).join(one, F.col("_k") == F.col("_v"), "left").drop("_k", "_v")
    return docs


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, vector): the documents' vectors in long form, by one join whatever the number of fields."""
    keys = [F.struct(F.lit(n).alias("source"), ((F.col("doc_id") * a + b) % MODULUS).alias("vec_id")) for n, (a, b) in VECTOR_FIELDS.items()]
    wanted = table(spark, folder, "documents").select("doc_id", F.explode(F.array(*keys)).alias("x")).select("doc_id", "x.source", "x.vec_id")
    return wanted.join(table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("doc_id", "source", "vector")


def stored_vector(spark: SparkSession, folder: str, vec_id: int) -> list[float]:
    """One vector, to stand for an embedded query."""
    return [float(x) for x in table(spark, folder, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]
