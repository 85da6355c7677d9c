"""An inverted-file vector index: rows stored by nearest centroid, searched in the nearest lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def centroids(vectors: DataFrame, column: str, lists: int, *, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means on at most ``sample`` vectors, those with the smallest hash; every vector is then indexed."""
    rows = vectors.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(F.col(column).cast("string"), F.lit(seed))).limit(sample).collect()
    x = np.array([r[0] for r in rows], float)
    if not len(x):
        return np.zeros((0, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def nearest_lists(vector: Column, centres: np.ndarray, n: int) -> Column:
    """array<int>: the n nearest lists of a vector, by one matrix product a batch."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(v: pd.Series) -> pd.Series:
        out: list[list[int] | None] = [None] * len(v)
        there = [i for i, x in enumerate(v) if x is not None]
        if there:
            order = np.argsort(-(np.stack([np.asarray(v.iloc[i], float) for i in there]) @ centres.T), axis=1)[:, :n]
            for i, row in zip(there, order, strict=True):
                out[i] = row.tolist()
        return pd.Series(out, index=v.index, dtype=object)

    return run(vector)


def index(vectors: DataFrame, column: str, centres: np.ndarray) -> DataFrame:
    """Every vector with its ``list``; write it partitioned by list for pruned reads."""
    return vectors.where(F.col(column).isNotNull()).withColumn("list", F.element_at(nearest_lists(F.col(column), centres, 1), 1))


def search(indexed: DataFrame, queries: DataFrame, key: str, column: str, centres: np.ndarray, *, k: int = 10, probes: int = 8) -> DataFrame:
    """(query, key, score, rank): approximate top-k of each query, in its ``probes`` nearest lists."""
    q = queries.select(F.col(key).alias("query"), F.col(column).alias("_q"), F.explode(nearest_lists(F.col(column), centres, probes)).alias("list"))
    d = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    pairs = indexed.join(q, "list").where(F.col(key) != F.col("query"))
    scored = pairs.select("query", key, F.round(d(F.col(column), F.col("_q")) / F.sqrt(d(F.col(column), F.col(column)) * d(F.col("_q"), F.col("_q"))), 7).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
