"""Exact duplicates, keep-first and keep-last, set differences, re-chunking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import delete, exists, materialize, rename


def duplicate_stats(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: lines, unique ids, ids that occur more than once, and lines in excess. Two aggregations, the first partial."""
    per_key = rows.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.count("*").alias("n"))
    return per_key.groupBy(group).agg(F.sum("n").alias("lines"), F.count("*").alias("unique_ids"), F.count_if(F.col("n") > 1).alias("dup_ids"), F.sum(F.col("n") - 1).alias("extra_lines"))


def duplicate_places(rows: DataFrame, key: str, file: str) -> DataFrame:
    """(cross_file_ids, same_file_ids): repeated ids found in several files, or in one."""
    per_key = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(file).alias("files")).where("n > 1")
    return per_key.agg(F.count_if(F.col("files") > 1).alias("cross_file_ids"), F.count_if(F.col("files") == 1).alias("same_file_ids"))


def keep_last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in an order, with the place of its first as ``first_seen``. One aggregation, no sort."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), at).alias("_last"), F.min(at).alias("first_seen")).select(key, "_last.*", "first_seen")


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("_first")).select(key, "_first.*")


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``place`` of each row in its group by an order, from 1, without gathering a group in one task.

    Rows are sorted over all partitions by range, so that a large group spans many; each row keeps its partition and
    place there, and the partitions' counts (one row per partition and group) give the offsets. The sorted rows are
    kept in the shared folder, since both steps must see the same partitions.
    """
    ranged = rows.repartitionByRange(*[F.col(c) for c in (group, *order)]).sortWithinPartitions(group, *order)
    marked = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    kept = materialize(marked, "placed")
    counts = kept.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_p")) - F.col("_n")
    offsets = counts.select("_group", "_p", (before - F.col("_from") + 1).alias("_shift"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p"))
    return kept.join(offsets, same).withColumn("place", F.col("_at") + F.col("_shift")).drop("_group", "_p", "_part", "_at", "_shift")


def rechunk(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """``chunk`` number of each row: floor((place - 1) / size) within its group."""
    return placed(rows, group, order).withColumn("chunk", F.floor((F.col("place") - 1) / size)).drop("place")


def keyset_pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``page`` of each distinct id: the pages, from 0, of a keyset scan that goes on until nothing is left."""
    ids = rows.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_all", F.lit(0))
    return rechunk(ids, "_all", [key], size).select(key, F.col("chunk").alias("page"))


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not blank and not in the state."""
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).join(done.select(key), key, "left_anti")


def missing(listed: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Listed ids that are not there, compared in lower case."""
    left = listed.select(F.lower(key).alias("id")).distinct()
    return left.join(have.select(F.lower(key).alias("id")).distinct(), "id", "left_anti")


def rewrite_deduplicated(rows: DataFrame, key: str, order: list[str], path: str) -> int:
    """Write keep-last rows to a staging folder, verify the count of ids, and only then put it in the place of ``path``.

    The old table is moved aside first and deleted last, so one of both is there at any time; a failed check leaves it untouched.
    """
    spark = rows.sparkSession
    kept = rows.where(F.col(key).isNotNull())
    wanted = kept.select(key).distinct().count()
    staging, aside = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    keep_last(kept, key, order).drop("first_seen").write.parquet(staging)
    written = spark.read.parquet(staging).agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids")).first()
    if tuple(written) != (wanted, wanted):
        raise ValueError(f"{written.n} rows of {written.ids} ids written, {wanted} ids expected")
    if exists(spark, path):
        rename(spark, path, aside)
    rename(spark, staging, path)
    delete(spark, aside)
    return wanted


def listing_pages(found: DataFrame, page: str, new: str, most_empty: int = 3) -> DataFrame:
    """The pages a walk reads that stops after ``most_empty`` successive pages without new ids (gaps and islands)."""
    w = Window.partitionBy(F.lit(1)).orderBy(page)  # one listing; its pages are few
    island = F.sum((F.col(new) > 0).cast("int")).over(w)
    streak = found.withColumn("_island", island)
    run = F.sum((F.col(new) == 0).cast("int")).over(Window.partitionBy("_island").orderBy(page))
    cut = streak.withColumn("_run", run).agg(F.min(F.when(F.col("_run") >= most_empty, F.col(page))).alias("stop"))
    return found.join(F.broadcast(cut), F.col("stop").isNull() | (F.col(page) <= F.col("stop"))).drop("stop")  # one row
