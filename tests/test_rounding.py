"""One decimal as Python rounds it: the value that a double holds decides, not its printed decimal."""

import math
import random

from pyspark.sql import functions as F

from gridwx.functions.values import one_decimal_text, round1


def both(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", round1(F.col("v"), "py").alias("r"), one_decimal_text(F.col("v")).alias("t")).collect()
    return [(r["v"], r["r"], r["t"]) for r in rows]


def test_multiples_of_a_twentieth(spark):
    found = both(spark, [i / 20 for i in range(-20_000, 20_001)])
    assert all(r == round(v, 1) and math.copysign(1, r) == math.copysign(1, round(v, 1)) and t == f"{v:.1f}" for v, r, t in found)
    assert [t for v, _, t in found if v in (3.15, 0.45, 0.25, -0.35)] == ["-0.3", "0.2", "0.5", "3.1"]


def test_random_doubles_and_neighbours_of_ties(spark):
    rng = random.Random(9)
    values = [rng.uniform(-1000, 1000) for _ in range(100_000)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 14) for _ in range(20_000)]
    for _ in range(20_000):
        tie = rng.randrange(-40_000, 40_000) / 20
        values += [math.nextafter(tie, math.inf), math.nextafter(tie, -math.inf)]
    assert all(r == round(v, 1) and t == f"{v:.1f}" for v, r, t in both(spark, values))


def test_missing_and_endless_values(spark):
    rows = spark.createDataFrame([(None,), (math.nan,), (math.inf,)], "v double").select(round1(F.col("v"), "py").alias("r")).collect()
    assert rows[0]["r"] is None and math.isnan(rows[1]["r"]) and rows[2]["r"] == math.inf
