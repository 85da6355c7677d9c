"""Incremental ingestion: new JSON shards, idempotent upsert by id, failures kept for a retry."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is stored in so many buckets by hash of its key; a batch rewrites only those it touches.
BUCKETS = 64
MANIFEST = "version bigint, bucket int, path string"


def current(spark: SparkSession, target: str) -> tuple[int, dict[int, str]]:
    """The number of the newest version and the folder of each of its buckets; (0, {}) before the first.

    Versions are counted, not told apart by time, and a version is one file, so it is there whole or not at all.
    """
    try:
        named = spark.read.schema(MANIFEST).json(f"{target}/current/*")
        newest = named.where(F.col("version") == named.agg(F.max("version").alias("v")).first().v).collect()  # a row per bucket
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return 0, {}
        raise
    return (newest[0].version, {r.bucket: r.path for r in newest}) if newest else (0, {})


def read(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest version of a table, None before the first."""
    _, paths = current(spark, target)
    return spark.read.option("mergeSchema", True).parquet(*paths.values()) if paths else None


def upsert(target: str, rows: DataFrame, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Merge rows into a Parquet table by key, the row of the greatest ``order`` winning; rows without a key are left out.

    Only the buckets of the batch's keys are read and rewritten. The new version becomes current by one file that names
    every bucket's folder, so a run that fails leaves the table as it was, and repeating a batch changes nothing. Two
    writers of one version can't both succeed.
    """
    spark = rows.sparkSession
    version, paths = current(spark, target)
    new = rows.where(F.col(key).isNotNull()).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    held = [paths[b] for b in touched if b in paths]
    if held:
        old = spark.read.option("mergeSchema", True).parquet(*held)
        new = old.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).unionByName(new, allowMissingColumns=True)
    rest = [c for c in new.columns if c not in (key, "_bucket")]
    latest = new.groupBy("_bucket", key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order))).alias("x")).select("_bucket", key, "x.*")
    folder = f"{target}/v-{uuid.uuid4().hex}"
    latest.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)  # rows are one per key by now; a file per bucket
    named = paths | {b: f"{folder}/_bucket={b}" for b in touched}
    record = [(version + 1, b, p) for b, p in sorted(named.items())]
    spark.createDataFrame(record, MANIFEST).coalesce(1).write.json(f"{target}/current/{version + 1:010d}")


def ingest(spark: SparkSession, source: str, target: str, schema: T.StructType | str, transform: Callable[[DataFrame], DataFrame], *, key: str = "doc_id", order: str = "scraped_at", failed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process the shards that arrived since the last run, then stop.

    The checkpoint under the target records what was read. ``failed`` selects transformed rows to be kept under
    target/retry instead of being merged. A batch is transformed once and its result written before it is split,
    since a transformation may call a model, which costs and may not answer twice alike.
    """

    def batch(rows: DataFrame, number: int) -> None:
        path = f"{target}/batches/{number}"
        out = transform(rows)
        out.write.mode("overwrite").parquet(path)
        done = spark.read.schema(out.schema).parquet(path)
        if failed is not None:
            bad = failed(done)
            bad.write.mode("append").json(f"{target}/retry")
            done = done.join(bad.select(key), key, "left_anti")
        upsert(target, done, key, order)

    stream = spark.readStream.schema(schema).json(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(target, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
