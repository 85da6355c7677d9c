"""JSON files in and out: line shards, one document per file, rolling writes, progress state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS_PER_SHARD = 15_000


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Line-delimited JSON; blank and malformed lines are skipped. Adds the shard's name as ``shard``."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("shard", F.col("_metadata.file_name"))


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per file; ``key`` is the file's name without its ending."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("key", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def validity(spark: SparkSession, path: str) -> DataFrame:
    """(lines, blank, invalid) of line-delimited JSON."""
    text = spark.read.text(path)
    blank = F.trim("value") == ""
    return text.agg(F.count("*").alias("lines"), F.count_if(blank).alias("blank"), F.count_if(~blank & F.try_parse_json("value").isNull()).alias("invalid"))


def first_per(rows: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group in an order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def write_shards(rows: DataFrame, path: str, *, append: bool = False, per_shard: int = DOCS_PER_SHARD) -> None:
    """Rolling JSON lines of at most ``per_shard`` documents a file."""
    rows.write.option("maxRecordsPerFile", per_shard).mode("append" if append else "errorifexists").json(path)


def concatenated(rows: DataFrame, group: str, order: list[str], path: str) -> None:
    """One ordered file per group, each written by one task, as the format asks for; groups are written side by side."""
    spread = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(spread, group).sortWithinPartitions(group, *order).write.partitionBy(group).json(path)


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the files under a path; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


def progress(done: DataFrame, group: str, key: str) -> DataFrame:
    """Progress state as a table: the distinct processed ids of each group, one row each (not a list, which would not scale)."""
    return done.select(group, key).where(F.col(key).isNotNull()).distinct()


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A state file {group: [ids]} as (group_name, id) rows; a missing or corrupt file gives none."""
    empty = spark.createDataFrame([], "group_name string, id string")
    try:
        text = spark.read.text(path, wholetext=True)
        held = text.select(F.from_json("value", "map<string,array<string>>").alias("m"))
        return held.select(F.explode("m").alias("group_name", "ids")).select("group_name", F.explode("ids").alias("id"))
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise
