"""Completeness, scorecards, audits and progress reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text


def completeness(rows: DataFrame, group: str, fields: dict[str, tuple[Column, str]], rule: str = "present") -> DataFrame:
    """(group, field, pct, mark): the share of filled values of each field, in long form; marks at 80 and 50 per cent.

    rule: truthy, present or not_blank. All fields are averaged in one pass.
    """
    test = getattr(text, rule)
    wide = rows.groupBy(group).agg(*[F.round(F.avg(test(c, kind).cast("double")) * 100, 2).alias(name) for name, (c, kind) in fields.items()])
    long = wide.unpivot([group], list(fields), "field", "pct")
    return long.withColumn("mark", F.when(F.col("pct") >= 80, "ok").when(F.col("pct") >= 50, "weak").otherwise("poor"))


def flag_rates(rows: DataFrame, group: str, flag: Column) -> DataFrame:
    """(group, total, flagged, rate) with a total row, whose group is null."""
    out = rows.where(F.col(group).isNotNull()).rollup(group).agg(F.count("*").alias("total"), F.count_if(flag).alias("flagged"))
    return out.withColumn("rate", F.round(F.try_divide("flagged", "total") * 100, 4))


def date_quality(rows: DataFrame, group: str, raw: Column, future: int = 2026, oldest: int = 1900) -> DataFrame:
    """Per group: first and last date, and how many are missing, unreadable, in the future or too old."""
    d = text.any_date(raw)
    blank = raw.isNull() | (F.trim(raw) == "")
    return rows.groupBy(group).agg(
        F.min(d).alias("min_date"), F.max(d).alias("max_date"), F.count_if(blank).alias("missing"), F.count_if(~blank & d.isNull()).alias("invalid"),
        F.count_if(F.year(d) > future).alias("future"), F.count_if(F.year(d) < oldest).alias("too_old"),
    )


def depth(rows: DataFrame, group: str, size: Column) -> DataFrame:
    """Mean, median, 95th (by place: sorted[int(n * 0.95)]) and largest size of a list per group.

    Sizes are counted first, so a group's values are never gathered: running counts give the places.
    """
    counts = rows.select(F.col(group).alias("g"), size.cast("long").alias("s")).where("s is not null").groupBy("g", "s").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g")
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy("s"))).withColumn("n", F.sum("c").over(w))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("s")))
    n = F.col("n")
    return run.groupBy(F.col("g").alias(group)).agg(
        F.round(F.sum(F.col("s") * F.col("c")) / F.first("n"), 4).alias("mean"), ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"),
        at(F.floor(n * 0.95)).alias("p95"), F.max("s").alias("largest"),
    )


def clusters(values: DataFrame, field: str) -> DataFrame:
    """(folded, total, n_variants, variants): values that differ only by case and accents, most frequent variant first."""
    per = values.where(F.col(field).isNotNull()).groupBy(F.lower(text.fold(F.trim(field))).alias("folded"), F.col(field).alias("v")).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "v", "n")))
    out = per.groupBy("folded").agg(F.sum("n").alias("total"), F.count("*").alias("n_variants"), listed.alias("x"))
    return out.select("folded", "total", "n_variants", F.array_join(F.transform("x", lambda r: F.concat(r["v"], F.lit("="), r["n"].cast("string"))), " | ").alias("variants"))


def frequencies(rows: DataFrame, items: Column, fields: list[str]) -> DataFrame:
    """(fields..., n) over the elements of a nested array."""
    x = rows.select(F.explode(items).alias("x")).where("x is not null")
    return x.groupBy(*[F.col(f"x.{f}").alias(f) for f in fields]).agg(F.count("*").alias("n"))


def coverage(catalog: DataFrame, parts: dict[str, DataFrame], group: str, expected: str) -> DataFrame:
    """Catalog rows with the count of each part, share of the expected count, and a flag under 99 per cent of it (first part)."""
    out = catalog
    for name, part in parts.items():
        counted = part.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias(name))
        out = out.join(counted, F.col(group) == F.col("_g"), "left").drop("_g").fillna(0, [name])
    first = next(iter(parts))
    return out.withColumn("pct", F.round(F.try_divide(F.col(first), F.col(expected)) * 100, 4)).withColumn("incomplete", F.col(first) < F.col(expected) * 0.99)


def rolling_rate(samples: DataFrame, time: str, value: str, window: int = 30, group: str | None = None) -> DataFrame:
    """Duration-weighted mean rate over the last ``window`` samples of a growing counter, within each group."""
    w = Window.partitionBy(group if group else F.lit(1)).orderBy(time)
    dt = (F.unix_micros(F.col(time)) - F.unix_micros(F.lag(time).over(w))) / 1e6
    step = samples.withColumn("_dt", dt).withColumn("_dv", F.col(value) - F.lag(value).over(w))
    last = w.rowsBetween(-(window - 1), 0)
    return step.withColumn("rate", F.try_divide(F.sum("_dv").over(last), F.sum("_dt").over(last))).drop("_dt", "_dv")


def time_left(samples: DataFrame, time: str, done: str, target: Column, group: str, window: int = 30) -> DataFrame:
    """(group, done, rate, seconds_left): each group's newest sample with its rolling rate, and the time to the target at that rate; null where nothing moves."""
    rated = rolling_rate(samples, time, done, window, group)
    last = rated.groupBy(group).agg(F.max_by(F.struct(F.col(done).alias("done"), "rate", target.alias("target")), F.struct(time, done)).alias("x")).select(group, "x.*")
    left = F.when(F.col("rate") > 0, F.greatest(F.col("target") - F.col("done"), F.lit(0)) / F.col("rate"))
    return last.select(group, "done", "rate", left.alias("seconds_left"))


def _outside(allowed: tuple[str, ...]):  # noqa: ANN202
    return lambda x: x.isNotNull() & (x["citation_context"].isNull() | ~x["citation_context"].isin(*allowed))


def scorecard(rows: DataFrame, group: str, texts: dict[str, Column], lists: dict[str, Column], dates: Column, enums: dict[str, tuple[Column, tuple[str, ...]]], prose: Column) -> DataFrame:
    """Per group: fill rates, mean list sizes, misshapen dates, invalid enum values and prose that looks foreign, in one pass."""
    native = prose.rlike(r"(?iuU)[ãõçáéíóúâêôà]|\b(?:de|que|não|para|com|uma|dos|das)\b")
    return rows.groupBy(group).agg(
        F.count("*").alias("documents"),
        *[F.round(F.avg(text.not_blank(c, "string").cast("double")), 4).alias(f"fill_{n}") for n, c in texts.items()],
        *[F.round(F.avg(F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))), 4).alias(f"mean_{n}") for n, c in lists.items()],
        F.count_if(dates.isNotNull() & ~dates.rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("bad_dates"),
        *[F.sum(F.coalesce(F.size(F.filter(c, _outside(ok))), F.lit(0)) * c.isNotNull().cast("int")).alias(f"bad_{n}") for n, (c, ok) in enums.items()],
        F.count_if(prose.isNotNull() & ~native).alias("foreign"),
    )


def keyword_faults(raw: Column, least: int = 5) -> Column:
    """The first fault of a keyword list: few, characters, tokens; null where it has none."""
    parts = F.transform(F.split(raw, ","), lambda p: F.trim(p))
    bad_chars = F.exists(parts, lambda p: p.rlike("[^a-z0-9 ]"))
    bad_sizes = F.exists(parts, lambda p: ~F.size(F.split(p, " +")).between(2, 6))
    return F.when(F.size(parts) < least, "few").when(bad_chars, "characters").when(bad_sizes, "tokens")


def usage_totals(calls: DataFrame, group: str, documents: int) -> DataFrame:
    """Per model: calls, tokens, cached share, cost, cost per call and its projection to a number of documents."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = calls.groupBy(group).agg(F.count("*").alias("calls"), F.sum(zero("prompt_tokens")).alias("prompt_tokens"), F.sum(zero("completion_tokens")).alias("completion_tokens"), F.sum(zero("cached_tokens")).alias("cached_tokens"), F.round(F.sum(zero("cost")), 6).alias("cost"))
    per = F.col("cost") / F.nullif(F.col("calls"), F.lit(0))
    return out.withColumn("cached_pct", F.round(F.try_divide("cached_tokens", "prompt_tokens") * 100, 4)).withColumn("cost_per_call", F.round(per, 6)).withColumn("projected_cost", F.round(per * documents, 2))


def signal_combinations(rows: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """(signals..., n): how often each combination of boolean signals occurs; nulls count as false."""
    return rows.groupBy(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in signals.items()]).agg(F.count("*").alias("n"))
