"""Kept monthly state against a full count, after appends, repeats and days that were loaded anew."""

import random
import shutil
from pathlib import Path

import pytest

from gridwx.sources import daylog, kept


def rows(spark, days, seed=1, scale=1.0):
    rng = random.Random(seed)
    data = [(0, c, f"2024-{m:02}-{d:02}", None if rng.random() < 0.1 else 1000 + scale * rng.random()) for m, d in days for c in range(4)]
    return spark.createDataFrame(data, "lat_idx int, lon_idx int, d string, precipitation double").selectExpr("lat_idx", "lon_idx", "CAST(d AS DATE) obs_date", "precipitation")


def same(spark, base, months):
    found = {(r["lon_idx"], r["obs_date"]): r for r in daylog.read(spark, months).collect()}
    wanted = {(r["lon_idx"], r["obs_date"]): r for r in kept.month_state(daylog.read(spark, base)).collect()}
    assert found.keys() == wanted.keys()
    for k, w in wanted.items():
        assert found[k]["n"] == w["n"] and (found[k]["low"], found[k]["high"]) == (w["low"], w["high"])
        assert found[k]["mean"] == pytest.approx(w["mean"], rel=1e-12) and found[k]["squares"] == pytest.approx(w["squares"], rel=1e-6, abs=1e-9)


def test_refreshes_equal_a_full_count_and_read_new_days_only(spark, tmp_path):
    base, months = str(tmp_path / "days"), str(tmp_path / "months")
    daylog.create(spark, base, rows(spark, [(1, d) for d in range(1, 20)]))
    assert kept.refresh(spark, base, months).count() == 1
    same(spark, base, months)
    more = rows(spark, [(1, d) for d in range(15, 32)] + [(2, d) for d in range(1, 9)], seed=2)
    daylog.append(spark, base, more)
    old = sorted(Path(base).glob("load=*"))[0]
    aside = tmp_path / "aside"
    shutil.copytree(old, aside)
    shutil.rmtree(old)
    assert {str(r["obs_date"]) for r in kept.refresh(spark, base, months).collect()} == {"2024-01-01", "2024-02-01"}
    shutil.copytree(aside, old)
    same(spark, base, months)
    assert kept.refresh(spark, base, months).count() == 0
    same(spark, base, months)
    # a day loaded anew makes its month again, from that month's days
    daylog.append(spark, base, rows(spark, [(1, 3)], seed=9, scale=50.0), replace=True)
    assert {str(r["obs_date"]) for r in kept.refresh(spark, base, months).collect()} == {"2024-01-01"}
    same(spark, base, months)


def test_empty_base(spark, tmp_path):
    base, months = str(tmp_path / "days"), str(tmp_path / "months")
    daylog.create(spark, base, rows(spark, [(1, 1)]).limit(0))
    assert kept.refresh(spark, base, months).count() == 0
    daylog.append(spark, base, rows(spark, [(3, 1)]))
    assert kept.refresh(spark, base, months).count() == 1
    same(spark, base, months)
