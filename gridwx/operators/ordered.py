"""Order over a whole table without a task that holds it: range partitions, their sums, and offsets from these.

Rows are dealt to ranges of their order and written, so that every later pass sees the same ranges. Each range is summed up
to one row per group; the sums of the ranges before one are its offset, to which the running sum inside the range is added.
Exact quantiles are a selection by such running counts of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwx.workspace import staged


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt to ranges of these columns, with the range's number as `part`; written, as ranges are found by sampling."""
    return staged(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """df with `name`: the sum of value (whole numbers) over the group's rows before the row in order; rows that tie come in any order."""
    parts = in_ranges(df, [*group, *order])
    sums = parts.groupBy(*group, "part").agg(F.sum(value).alias("s"))
    # a group has a row per range, so its list is as long as there are ranges
    ranges = F.array_sort(F.collect_list(F.struct("part", "s")))
    earlier = F.transform("r", lambda x: F.struct(x["part"].alias("part"), F.aggregate(F.filter("r", lambda y: y["part"] < x["part"]), F.lit(0).cast("long"), lambda acc, y: acc + y["s"]).alias("offset")))
    offsets = sums.groupBy(*group).agg(ranges.alias("r")).select(*group, F.inline(earlier))
    rows = Window.partitionBy("part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    inside = F.coalesce(F.sum(value).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = offsets.withColumnsRenamed({c: f"{c}_of" for c in [*group, "part"]})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in [*group, "part"]]
    found = parts.withColumn(name, inside).join(offsets, same)
    return found.select(*df.columns, (F.col(name) + F.col("offset")).alias(name))


def previous(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """df with `previous_<column>` of each row: its value in the row before it in the order of the whole table, null for the
    first. Inside a range that is the row before; a range's first row takes the last row of the ranges before it."""
    parts = in_ranges(df, order)
    last = parts.groupBy("part").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"))
    # a row per range: each looks for the nearest range before it that has rows
    ends = last.agg(F.array_sort(F.collect_list(F.struct("part", "last"))).alias("r"))
    borders = F.transform("r", lambda x: F.struct(x["part"].alias("part"), F.element_at(F.concat(F.array(F.lit(None).cast(last.schema["last"].dataType)), F.transform(F.filter("r", lambda y: y["part"] < x["part"]), lambda y: y["last"])), -1).alias("last")))
    borders = ends.select(F.inline(borders)).select("part", F.col("last").alias("border"))
    rows = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = parts.withColumn("row_in_part", F.row_number().over(rows))
    for c in columns:
        numbered = numbered.withColumn(f"previous_{c}", F.lag(c).over(rows))
    found = numbered.join(F.broadcast(borders), "part")
    first = F.col("row_in_part") == 1
    return found.select(*df.columns, *[F.when(first, F.col("border")[c]).otherwise(F.col(f"previous_{c}")).alias(f"previous_{c}") for c in columns])


def exact_quantiles(df: DataFrame, group: list[str], value: str, levels: list[float]) -> DataFrame:
    """group columns and q, an array: the quantiles of the non-null values at these levels, exact, with linear interpolation.

    Values are counted first, so that a value of a third of all rows is one row; groups without values are left out. No task
    holds the values of a group: they are dealt by range, and those at the wanted ranks are picked by running counts.
    """
    counted = df.select(*group, F.col(value).cast("double").alias("v")).where("v IS NOT NULL").groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(counted, group, ["v"], "n")
    totals = counted.groupBy(*group).agg(F.sum("n").alias("total"))
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(levels)])).alias("l")
    wanted = totals.select(*group, "total", level).select(*group, F.col("l.i").alias("i"), ((F.col("total") - 1) * F.col("l.p")).alias("at"))
    wanted = wanted.groupBy(*group).agg(F.collect_list(F.struct("i", "at")).alias("wanted"))
    if group:
        both = ranked.join(wanted.select(*[F.col(c).alias(f"{c}_of") for c in group], "wanted"), [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in group])
    else:
        both = ranked.join(F.broadcast(wanted))

    def holds(rank: Column) -> Column:
        return (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))

    # of each distinct value: the levels whose lower or upper rank falls on it
    hits = F.filter("wanted", lambda w: holds(F.floor(w["at"])) | holds(F.ceil(w["at"])))
    hit = both.select(*group, "v", "n", "before", F.explode(hits).alias("w"))
    fraction = F.col("w.at") - F.floor("w.at")
    low = F.when(holds(F.floor("w.at")), F.col("v") * (1 - fraction))
    high = F.when(holds(F.ceil("w.at")) & (fraction > 0), F.col("v") * fraction)
    one = hit.groupBy(*group, F.col("w.i").alias("i")).agg((F.sum(low) + F.coalesce(F.sum(high), F.lit(0.0))).alias("x"))
    return one.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q")).where(F.size("q") > 0)
