"""What days a table holds: coverage, gaps, prefixes, sequences, summaries of runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwx.functions.values import percentage


def distinct_days(rows: DataFrame) -> DataFrame:
    return rows.select("obs_date").where("obs_date IS NOT NULL").distinct()


def day_spine(first: str | date, last: str | date, rows: DataFrame) -> DataFrame:
    """One row per day of the range, with the rows of that day."""
    spark = rows.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("obs_date"))
    return days.join(rows, "obs_date", "left")


def _spine(days: DataFrame) -> DataFrame:
    ends = days.agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b"))
    return ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("obs_date"))


def missing_dates(rows: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Days of the range (the table's own, if none is given) without rows."""
    days = distinct_days(rows)
    if first and last:
        spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("obs_date"))
    else:
        spine = _spine(days)
    return spine.join(days, "obs_date", "left_anti")


def date_exists(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    return wanted.join(distinct_days(rows), "obs_date", "left_semi")


def gap_islands(rows: DataFrame) -> DataFrame:
    """First day, last day and length of each run of missing days: what lies between a day and the next one."""
    days = distinct_days(rows).withColumn("century", F.floor(F.year("obs_date") / 100))
    # runs of missing days lie between neighbours; neighbours across a bucket border meet through the buckets' ends
    w = Window.partitionBy("century").orderBy("obs_date")
    inner = days.withColumn("next", F.lead("obs_date").over(w))
    ends = days.groupBy("century").agg(F.min("obs_date").alias("lo"), F.max("obs_date").alias("hi"))
    across = ends.withColumn("next", F.lead("lo").over(Window.orderBy("century"))).select(F.col("hi").alias("obs_date"), "next")
    pairs = inner.select("obs_date", "next").where("next IS NOT NULL").unionByName(across.where("next IS NOT NULL"))
    return pairs.where(F.datediff("next", "obs_date") > 1).select(
        F.date_add("obs_date", 1).alias("gap_start"), F.date_sub("next", 1).alias("gap_end"), (F.datediff("next", "obs_date") - 1).alias("n_days")
    )


def coverage_stats(rows: DataFrame) -> DataFrame:
    """earliest, latest, total, expected, missing, coverage in percent, gaps, next day; an empty table has 0 of 0 days."""
    row = rows.agg(F.min("obs_date").alias("earliest"), F.max("obs_date").alias("latest"), F.count_distinct("obs_date").alias("total_days"))
    expected = F.coalesce(F.datediff("latest", "earliest") + 1, F.lit(0)).cast("long")
    row = row.withColumn("expected_days", expected).withColumn("missing_days", F.col("expected_days") - F.col("total_days"))
    return row.withColumn("coverage_pct", percentage(F.col("total_days"), F.col("expected_days"))).withColumn("has_gaps", F.col("missing_days") > 0).withColumn("next_day", F.date_add("latest", 1))


def freshness(rows: DataFrame, as_of: str | date, warning: int = 7, critical: int = 31) -> DataFrame:
    """Days that are due, and a state."""
    latest = rows.agg(F.max("obs_date").alias("latest"))
    behind = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), "latest"))
    state = F.when(F.col("days_behind") > critical, "CRITICAL").when(F.col("days_behind") > warning, "WARNING").otherwise("OK")
    return latest.withColumn("days_behind", behind).withColumn("state", state)


def sequence_check(manifest: DataFrame, order: str = "seq") -> DataFrame:
    """Each step of the sequence that does not go to the next day: out of order, or a gap of so many days."""
    w = Window.orderBy(order)
    rows = manifest.withColumn("before", F.lag("obs_date").over(w)).withColumn("step", F.datediff("obs_date", F.lag("obs_date").over(w)))
    kind = F.when(F.col("step") <= 0, "order").otherwise("gap")
    return rows.where("step <> 1").select("before", "obs_date", "step", kind.alias("problem"))


def available_prefix(manifest: DataFrame, first: str | date, max_days: int, ok: int = 200) -> DataFrame:
    """The days from `first` on, at most max_days, up to the first that is missing or failed.

    The first bad day is a minimum, so no window over all days is needed.
    """
    start = F.lit(first).cast("date")
    spark = manifest.sparkSession
    days = spark.range(max_days).select(F.date_add(start, F.col("id").cast("int")).alias("obs_date"))
    good = manifest.where(F.col("status") == ok).select("obs_date").distinct().withColumn("good", F.lit(True))
    marked = days.join(good, "obs_date", "left")
    stop = marked.where("good IS NULL").agg(F.min("obs_date").alias("stop"))
    return marked.join(F.broadcast(stop)).where("stop IS NULL OR obs_date < stop").select("obs_date")


def time_index(rows: DataFrame) -> DataFrame:
    """Place of each day among the table's days, from 0."""
    days = distinct_days(rows)
    return days.withColumn("time_index", F.dense_rank().over(Window.orderBy("obs_date")).cast("long") - 1)


def files_for_dates(manifest: DataFrame, first: str | date, last: str | date) -> DataFrame:
    """Each day of the range with its usable file (status 200 and not empty), or without."""
    files = manifest.where("status = 200 AND size_bytes > 0").select("obs_date", "path")
    days = manifest.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("obs_date"))
    return days.join(files, "obs_date", "left").withColumn("found", F.col("path").isNotNull())


def ingest_summary(outcomes: DataFrame, rows: DataFrame) -> DataFrame:
    """outcomes: obs_date, outcome (ok, failed, skipped). Counts, success rate, and the table's coverage afterwards."""
    counts = outcomes.agg(
        F.count_if(F.col("outcome") == "ok").alias("successful"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count(F.lit(1)).alias("attempted"),
    )
    counts = counts.withColumn("success_rate", percentage(F.col("successful"), F.col("attempted")))
    state = coverage_stats(rows).select("latest", "total_days", "coverage_pct", "has_gaps", F.col("next_day").alias("next_expected"))
    return counts.join(F.broadcast(state))


def error_digest(errors: DataFrame, n: int = 10, order: str = "seq") -> DataFrame:
    """seq (from 1), message: the first n messages by `order`, and a line that counts the rest."""
    first = errors.orderBy(order).limit(n).withColumn("seq", F.row_number().over(Window.orderBy(order))).select("seq", "message")
    rest = errors.agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > n)
    rest = rest.select(F.lit(2**31 - 1).alias("seq"), F.concat(F.lit("... and "), (F.col("total") - n).cast("string"), F.lit(" more")).alias("message"))
    return first.unionByName(rest)
