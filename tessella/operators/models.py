"""Model calls behind pluggable functions: batched embeddings, extraction with retries, model comparison."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import articles, text

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic unit vectors from hashed words: a stand-in where no model can be called."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def counting_embedder(letters: str) -> Embedder:
    """How often each of some letters occurs, as a stand-in that SQL can check."""
    return lambda texts: [[float(t.count(c)) for c in letters] for t in texts]


def embedded(value: Column, embed: Embedder, batch: int = 50) -> Column:
    """array<double>: embeddings by calls of at most ``batch`` texts, in order; blank texts are skipped and stay null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float] | None] = [None] * len(texts)
            todo = [i for i, t in enumerate(texts) if t and t.strip()]
            for a in range(0, len(todo), batch):
                some = todo[a : a + batch]
                for i, v in zip(some, embed([texts.iloc[i] for i in some]), strict=True):
                    out[i] = v
            yield pd.Series(out, index=texts.index, dtype=object)

    return run(value)


class Refused(Exception):  # noqa: N818
    """A reply that another try would not change."""


def wait(attempt: int) -> float:
    """Seconds before the try after ``attempt`` (from 0): 1, 2.5, 5, 9.5 ..."""
    return 2**attempt + attempt * 0.5


def extracted(value: Column, call: Callable[[str], dict], schema: T.StructType, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> Column:
    """A model's structured reply, unknown fields dropped and missing ones null; null after failure, so that the row is retried by a later run.

    Replies that can't be read (ValueError, TypeError, KeyError) and failures of the network (OSError) are tried again,
    up to ``attempts`` times with growing waits; what is Refused is not. Null and empty texts are not sent.
    """

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            row = dict.fromkeys(schema.names)
            for n in range(attempts if t else 0):
                try:
                    row |= {k: v for k, v in call(t).items() if k in schema.names}
                    break
                except Refused:
                    break
                except (ValueError, TypeError, KeyError, OSError):
                    if n + 1 < attempts:
                        sleep(wait(n))
            rows.append(row)
        return pd.DataFrame(rows, columns=schema.names)

    return run(value)


def parsed_reply(raw: Column, schema: T.StructType, required: tuple[str, ...] = ()) -> Column:
    """A reply's text as a struct, without code fences; unknown fields are dropped.

    Null where the reply is no JSON object, where a field's value does not fit its type, or where a required one is missing.
    """
    tried = F.from_json(text.json_reply(raw), T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return text.bound(tried, lambda r: _valid(r, schema, required))


def _valid(reply: Column, schema: T.StructType, required: tuple[str, ...]) -> Column:
    ok = reply.isNotNull() & reply["_corrupt"].isNull()
    for name in required:
        ok = ok & reply[name].isNotNull()
    return F.when(ok, F.struct(*[reply[f.name].alias(f.name) for f in schema.fields]))


def postprocessed(records: DataFrame, key: str, extraction: str) -> DataFrame:
    """(key, keywords, legislation, is_auj) of one extraction per key: plain keywords, single places with full law names, and the flag or what the labels say.

    legislation is an array of (place, article, law, citation_context). Keys must be unique; records without an extraction keep nulls.
    """
    x = records.select(F.col(key).alias("_k"), F.col(extraction).alias("x")).where("_k is not null")
    cited = x.select("_k", F.posexplode("x.legislation_cited").alias("pos", "c")).where("c is not null").select("_k", "pos", "c.*")
    places = articles.normalized_legislation(cited, ["_k"], "pos", "article", "law", "citation_context")
    lists = places.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("place", "article", "law", "citation_context"))).alias("legislation"))
    flag = F.coalesce(F.col("x.is_jurisprudence_unification"), F.lit(False)) | text.unifies_case_law(F.col("x.procedural_type"), F.col("x.case_type"))
    out = x.join(lists, "_k", "left").select(F.col("_k").alias(key), text.keywords(F.col("x.keywords_search_query")).alias("keywords"), "legislation", F.when(F.col("x").isNotNull(), flag).alias("is_auj"))
    return out


def benchmark(docs: DataFrame, body: str, models: dict[str, tuple[Callable[[str], dict], float, float]], schema: T.StructType) -> DataFrame:
    """(model, calls, answered, filled, prompt_tokens, cost, place): several models over the same documents, cheapest first.

    models: name -> (call, price of a million prompt tokens, of a million completion tokens); tokens are characters over
    four. answered: replies with any field; filled: the mean share of fields that have a value.
    """
    out = None
    for name, (call, prompt_price, reply_price) in models.items():
        reply = docs.where(F.col(body).isNotNull() & (F.col(body) != "")).select(F.floor(F.length(body) / 4).alias("p"), extracted(F.col(body), call, schema).alias("x"))
        fields = [F.col(f"x.{n}").isNotNull().cast("int") for n in schema.names]
        one = reply.select("p", F.coalesce(F.floor(F.length(F.to_json("x")) / 4), F.lit(0)).alias("c"), sum(fields[1:], fields[0]).alias("n"))
        one = one.agg(F.count("*").alias("calls"), F.count_if(F.col("n") > 0).alias("answered"), F.round(F.avg("n") / len(fields), 6).alias("filled"), F.sum("p").alias("prompt_tokens"), F.round((F.sum("p") * prompt_price + F.sum("c") * reply_price) / 1e6, 6).alias("cost"))
        one = one.select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("cost", "model")))  # a row per model


def prompt(court: Column, court_short: Column, body: Column, most: int = 80_000) -> Column:
    """The text sent for extraction: the court's name, or its short form, and the start of the document."""
    name = F.coalesce(F.nullif(court, F.lit("")), F.nullif(court_short, F.lit("")), F.lit(""))
    return F.concat(F.lit("Court: "), name, F.lit("\n\n"), F.left(F.coalesce(body, F.lit("")), F.lit(most)))


def side_by_side(results: DataFrame, doc: str, model: str, value: str, models: list[str] | None = None, most: int = 500) -> DataFrame:
    """One row per document with a column for each model's value; without ``models`` for all there are, an error beyond ``most``."""
    if models is None:
        models = [r[0] for r in results.where(F.col(model).isNotNull()).select(model).distinct().orderBy(model).limit(most + 1).collect()]
        if len(models) > most:
            raise ValueError(f"more than {most} values of {model}")
    return results.groupBy(doc).pivot(model, models).agg(F.first(value))
