import random
from datetime import date, timedelta

import numpy as np
import pytest
from helpers import OBSERVED, at, config
from pyspark.sql import functions as F

from skywait.operators import slices, timelines


def hot_rows(spark, n=3000, seed=2, instants=None):
    """One entity with most rows, bursts of one instant in it, and a few small entities."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        days = rng.choice([rng.uniform(0, 80), rng.uniform(30, 30.01), 45.0]) if instants is None else rng.choice(instants)
        rows.append(("hot" if rng.random() < 0.8 else rng.choice("abc"), f"d{rng.random()}", "h", at(0) + timedelta(days=days), 0.0, rng.random() < 0.4, rng.random() < 0.9))
    return spark.createDataFrame(rows, OBSERVED).repartition(4)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("most", [20, 150])
@pytest.mark.parametrize("instants", [None, [1.0, 2.0], [7.25]])
def test_sliced_timelines_equal_whole_ones(spark, most, instants):
    obs = hot_rows(spark, instants=instants)
    names = spark.createDataFrame([(a,) for a in ("hot", "a", "b", "none")], "aoi_id string")
    cfg = config(end=date(2024, 5, 1), aois=("hot",))
    assert slices.heavy_groups(obs, ("aoi_id",)) is None
    same(timelines.waits(obs, names, cfg, slice_rows=most), timelines.waits(obs, names, cfg))
    same(timelines.gaps(obs, slice_rows=most), timelines.gaps(obs))
    same(timelines.timeline(obs, slice_rows=most), timelines.timeline(obs))


def test_no_slice_holds_more_than_twice_its_share(spark):
    obs = hot_rows(spark)
    heavy = slices.heavy_groups(obs, ("aoi_id",), 100)
    cut = slices.sliced(obs, ("aoi_id",), "observed_at", ("datatake_id",), heavy, 100)
    counts = {(r.aoi_id, r["_slice"]): r["count"] for r in cut.groupBy("aoi_id", "_slice").count().collect()}
    assert max(n for (a, _), n in counts.items() if a == "hot") <= 200 and sum(counts.values()) == 3000
    spans = sorted((r.low, r.high) for r in cut.where("aoi_id = 'hot'").groupBy("_slice").agg(F.min("observed_at").alias("low"), F.max("observed_at").alias("high")).collect())
    assert all(b[0] >= a[1] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("values", ["uniform", "few", "heavy tail", "same"])
def test_quantiles_by_histogram_are_exact(spark, values):
    rng = np.random.default_rng(4)
    n = 4000
    v = {"uniform": rng.random(n), "few": rng.integers(0, 3, n) * 0.1, "heavy tail": np.exp(rng.normal(0, 6, n)), "same": np.full(n, 2.5)}[values]
    df = spark.createDataFrame([("a" if k % 3 else "b", float(x)) for k, x in enumerate(v)] + [("a", None), ("c", None), ("d", 1.0), ("e", 1.0), ("e", 4.0)], "g string, x double")
    got = slices.exact_quantiles(df, ("g",), "x", {"m": 0.5, "p90": 0.9, "top": 1.0, "low": 0.0}, bins=8, last=20)
    want = df.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m"), F.percentile("x", F.lit(0.9)).alias("p90"), F.max("x").alias("top"), F.min("x").alias("low")).where("m is not null")
    same(got, want)


def test_statistics_of_heavy_entities(spark):
    obs = hot_rows(spark)
    gaps = timelines.gaps(obs)
    heavy = slices.heavy_groups(obs, ("aoi_id",), 100)
    assert {r.aoi_id for r in heavy.collect()} == {"hot"} or heavy.count() > 1
    same(timelines.gap_statistics(gaps, heavy=heavy), timelines.gap_statistics(gaps))
