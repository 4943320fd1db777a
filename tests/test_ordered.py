"""Order and quantiles of whole tables against plain Python, with ties, groups of any size, nulls and empty tables."""

import random

import numpy as np
import pytest

from gridwx.operators import aggregate, ordered


@pytest.mark.parametrize("seed", range(3))
def test_running_sums(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc") if rng.random() < 0.9 else None, rng.random(), rng.randrange(100)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(5)
    found = ordered.running_sum(df, ["g"], ["v"], "n").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["before"] == sum(n for g, v, n in rows if g == r["g"] and v < r["v"])


def test_previous_rows_cross_ranges(spark):
    df = spark.range(1000).selectExpr("id * 3 AS k", "CAST(id AS STRING) s").repartition(7)
    found = {r["k"]: (r["previous_k"], r["previous_s"]) for r in ordered.previous(df, ["k"], ["k", "s"]).collect()}
    assert found == {3 * i: (3 * i - 3, str(i - 1)) if i else (None, None) for i in range(1000)}
    assert ordered.previous(df.limit(0), ["k"], ["k"]).collect() == []


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables are dealt to several ranges too."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


LEVELS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def test_quantiles_of_groups(spark):
    rng = random.Random(4)
    groups = {"many": [rng.gauss(0, 1e3) for _ in range(3000)], "ties": [0.0] * 2000 + [rng.randrange(5) * 0.5 for _ in range(500)], "one": [7.5], "two": [1.0, 2.0], None: [3.0, 9.0, -1.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("many", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    found = {r["g"]: r["q"] for r in ordered.exact_quantiles(df, ["g"], "v", LEVELS).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g] == pytest.approx(np.quantile(values, LEVELS).tolist(), rel=1e-12, abs=1e-12)


def test_quantiles_of_a_table(spark):
    values = [float(i % 977) for i in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v float").repartition(8)
    assert ordered.exact_quantiles(df, [], "v", LEVELS).first()["q"] == pytest.approx(np.quantile(values, LEVELS).tolist())
    assert ordered.exact_quantiles(df.where("v < 0"), [], "v", LEVELS).collect() == []


def test_no_task_holds_a_group(spark):
    """Values of one group are dealt to several ranges."""
    df = spark.range(50_000).selectExpr("'g' AS g", "CAST(id AS DOUBLE) v", "1L n")
    assert ordered.in_ranges(df, ["g", "v"]).groupBy("part").count().count() > 1


def test_profile_without_values(spark):
    df = spark.createDataFrame([(None,)], "precipitation double")
    assert aggregate.percentile_profile(df).collect() == []
