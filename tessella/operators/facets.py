"""Corpus statistics and facet discovery."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.filters import has_key


def stats(docs: DataFrame, fields: list[str]) -> DataFrame:
    """total and with_<field>: how many rows have each field, in one pass."""
    return docs.agg(F.count("*").alias("total"), *[F.count(f).alias(f"with_{f}") for f in fields])


def value_counts(docs: DataFrame, field: str, limit: int | None = None, by_value: bool = False) -> DataFrame:
    """(value, count) of the values that are not null, most frequent first, ties by value; or the greatest value first."""
    order = [F.desc("value")] if by_value else [F.desc("count"), F.col("value")]
    out = docs.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("count")).orderBy(*order)
    return out if limit is None else out.limit(limit)


def json_counts(docs: DataFrame, key: str) -> DataFrame:
    """(value, count) of a metadata key; documents with the key but a null value are the null group."""
    field = F.col(key) if key in docs.columns else F.get_json_object("metadata", f"$.{key}")
    return docs.where(has_key(F.col("metadata"), key)).groupBy(field.alias("value")).agg(F.count("*").alias("count"))


def date_range(docs: DataFrame) -> DataFrame:
    return docs.agg(F.min("decision_date").alias("min_date"), F.max("decision_date").alias("max_date"), F.count("decision_date").alias("count"))


def domains(docs: DataFrame, prefix: str | None = None, limit: int = 50) -> DataFrame:
    """The commonest domains, those containing ``prefix`` (without case; wildcards allowed) if given."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1-500")
    kept = docs.where(F.col("legal_domain").ilike(f"%{prefix}%")) if prefix else docs
    return value_counts(kept, "legal_domain", limit)


def payload(docs: DataFrame) -> DataFrame:
    """(facet, value, count) of court, unification flag, decision type and confidence: one scan, one aggregation.

    The facets' values are put in long form first, so that a row per distinct value is all that shuffles.
    """
    pair = lambda name, value, on: F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"), on.alias("on"))
    rows = F.array(
        pair("court", F.col("court_short"), F.col("court_short").isNotNull()),
        pair("is_auj", F.col("is_auj"), F.col("is_auj").isNotNull()),
        pair("decision_type", F.col("decision_type"), has_key(F.col("metadata"), "decision_type")),
        pair("extraction_confidence", F.col("extraction_confidence"), has_key(F.col("metadata"), "extraction_confidence")),
    )
    return docs.select(F.explode(rows).alias("x")).where("x.on").groupBy("x.facet", "x.value").agg(F.count("*").alias("count"))


class TtlCache:
    """Results kept on the driver for a while; they are small facet tables."""

    def __init__(self, seconds: float = 300, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key: object, make: Callable[[], object]) -> object:
        now = self.clock()
        if key not in self.held or now - self.held[key][0] >= self.seconds:
            self.held[key] = (now, make())
        return self.held[key][1]
