"""References to records that are missing, deleted or arrive later.

Parents and children become one long table of tagged events: a parent arrives
(+1), leaves (-1), or a child refers to it (0). A reference is an orphan when
the running count of its key's present parents is not positive at its time.

A key may hold a third of all rows, so no step gathers the events of a key. Events
are first summed per key and moment, with map-side partial aggregation: whoever
refers to a key at one moment gets one answer, and references without a time are
one moment, however many there are. Net changes are summed again per key and period,
running totals are taken over those sums (one row per key and period), and only the
moments of one key *and period* meet in a window. The answers then join the references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HYPHENS = "[\\p{Pd}\\u2212\\u00AD]"
BLANKS = "(?U)[\\s\\u200B\\u200C\\u200D\\u2060\\uFEFF]+"


def number_key(value: Column) -> Column:
    """The part of a free-typed number from its first digit to its last letter or digit.

    Case, white space and the kind of hyphen do not matter. Null where there is no digit.
    """
    core = F.regexp_extract(value, "(?s)\\p{Nd}(?:.*[\\p{L}\\p{N}])?", 0)
    flat = F.lower(F.regexp_replace(F.regexp_replace(core, BLANKS, ""), HYPHENS, "-"))
    return F.when(flat != "", flat)


def find_orphans(
    children: DataFrame,
    parents: DataFrame,
    *,
    child_id: str,
    child_key: Column,
    child_time: Column,
    parent_key: Column,
    loaded: Column,
    withdrawn: Column | None = None,
    period: str = "day",
) -> DataFrame:
    """(child_id, key, at) of every reference that found no parent when it was made.

    children, parents: any tables; only the named columns are read, so further
        columns and clashing names do no harm.
    A parent is present from ``loaded`` until ``withdrawn`` (exclusive; null: for good).
    Rows with a null key are no references. A null reference time counts as after
    everything else, so it is an orphan only if no parent remains. Parents without a
    key or load time are never present. A row delivered twice (same id, key and time)
    is reported once. Empty tables: no parents make every reference an orphan, no
    children give no rows.
    ``period`` is the grain of the pre-aggregation and does not affect the result: a finer
    one makes the windows smaller where a key has very many moments a day.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    time = lambda c: c.cast("timestamp_ntz")
    refs = children.select(child_key.alias("key"), F.coalesce(time(child_time), far).alias("at"), F.col(child_id).alias("ref")).where("key is not null")
    gone = F.lit(None).cast("timestamp_ntz") if withdrawn is None else time(withdrawn)
    stays = parents.select(parent_key.alias("key"), time(loaded).alias("start"), gone.alias("end")).where("key is not null and start is not null and (end is null or end > start)")
    tagged = lambda rows, at, change, asked: rows.select("key", F.col(at).alias("at"), F.lit(change).alias("change"), F.lit(asked).alias("asked"))
    events = tagged(refs, "at", 0, 1).unionByName(tagged(stays, "start", 1, 0)).unionByName(tagged(stays.where("end is not null"), "end", -1, 0))
    moments = events.groupBy("key", "at").agg(F.sum("change").alias("change"), F.max("asked").alias("asked")).withColumn("period", F.date_trunc(period, "at"))

    net = moments.groupBy("key", "period").agg(F.sum("change").alias("net"), F.max("asked").alias("any"))
    before = Window.partitionBy("key").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    opening = net.withColumn("opening", F.coalesce(F.sum("net").over(before), F.lit(0))).where("any = 1").select("key", "period", "opening")

    within = Window.partitionBy("key", "period").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    present = moments.join(opening, ["key", "period"]).withColumn("present", F.col("opening") + F.sum("change").over(within))
    lost = refs.join(present.where("asked = 1 and present <= 0").select("key", "at"), ["key", "at"], "left_semi").distinct()
    return lost.select(F.col("ref").alias(child_id), "key", F.when(F.col("at") != far, F.col("at")).alias("at"))


def orphan_report(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Orphans per referring table, parent table and month.

    parts: (referring table, parent table, result of find_orphans). Columns:
    ref_table, parent_table, month (null where the time is unknown), orphans, missing_keys.
    Keys are counted after a first aggregation per key, so a hot key costs one row.
    """
    tagged = None
    for ref, parent, lost in parts:
        x = lost.select(F.lit(ref).alias("ref_table"), F.lit(parent).alias("parent_table"), F.date_format("at", "yyyy-MM").alias("month"), F.col("key").cast("string").alias("key"))
        tagged = x if tagged is None else tagged.unionByName(x)
    per_key = tagged.groupBy("ref_table", "parent_table", "month", "key").agg(F.count("*").alias("n"))
    return per_key.groupBy("ref_table", "parent_table", "month").agg(F.sum("n").alias("orphans"), F.count("*").alias("missing_keys"))
