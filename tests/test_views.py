from datetime import datetime

import pytest
from helpers import config

from skywait.errors import ConfigError, DataError
from skywait.operators import timelines
from skywait.plans import metric_tables, views

SCHEMA = "aoi_id string, datatake_id string, observed_at timestamp, clear_fraction double, covered_fraction double, catalog_cloud_cover double, usable boolean, complete boolean"
ROWS = [
    ("alpha", "a1", "2024-01-01 12:00", 0.85, 1.0, 5.0, False, True), ("alpha", "low-coverage", "2024-01-05 06:00", 0.99, 0.94, 2.0, True, True),
    ("alpha", "a2", "2024-01-20 18:00", 0.90, 1.0, 15.0, False, True), ("alpha", "incomplete", "2024-02-10 03:00", 1.0, 1.0, 0.0, True, False),
    ("alpha", "a3", "2024-03-05 10:30", 0.60, 1.0, 55.0, False, True), ("beta", "b1", "2024-01-03 05:30", 0.70, 1.0, 30.0, False, True),
    ("beta", "b2", "2024-02-02 17:45", 0.82, 1.0, 12.0, False, True),
]


def rows(spark, extra=()):
    return spark.createDataFrame([(a, d, datetime.fromisoformat(t), *r) for a, d, t, *r in [*ROWS, *extra]], SCHEMA)


def cfg2():
    return config(aois=("alpha", "beta"))


def test_status_and_timeline(spark):
    obs = views.selection(rows(spark), cfg2())
    line = views.observation_timeline(obs, "alpha").collect()
    assert [r.status for r in line] == ["usable", "unusable", "usable", "incomplete", "unusable"]
    assert line[2].gap_days == 19.25 and not any(r.outage for r in line)
    late = views.selection(rows(spark, [("alpha", "a4", "2024-03-25 12:00", 0.95, 1.0, 1.0, False, True)]), cfg2())
    assert [r.gap_days for r in views.observation_timeline(late, "alpha").collect() if r.outage] == [64.75]
    with pytest.raises(DataError):
        views.observation_timeline(obs, "nowhere")
    assert {r.status: r.n for r in views.status_counts(obs).collect()} == {"usable": 3, "unusable": 3, "incomplete": 1}
    assert views.quality_scatter(obs).count() == 6


def test_sensitivity_ignores_stored_flags(spark):
    cfg, grid = cfg2(), views.threshold_grid(0.8)
    names = metric_tables.entity_table(spark, cfg)
    out = views.sensitivity(rows(spark), names, cfg, grid, 7)
    alpha = {r.min_clear: r for r in out.where("aoi_id = 'alpha'").collect()}
    assert len(alpha) == 21 and {r.n_observations for r in alpha.values()} == {4}
    assert [alpha[g].n_usable for g in (0.0, 0.8, 1.0)] == [3, 2, 0]
    rates = [alpha[g].p_within_7d for g in grid]
    assert rates == sorted(rates, reverse=True)
    flipped = rows(spark).selectExpr("* except (usable)", "not usable as usable")
    again = views.sensitivity(flipped, names, cfg, grid, 7)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    base = views.view_metrics(rows(spark), cfg, 7)["aoi_summary"].where("aoi_id = 'alpha'").first()
    assert base.p_within_7d == alpha[0.8].p_within_7d and base.sla_success == alpha[0.8].sla_success
    assert len(views.threshold_grid(0.83)) == 22


def test_selection_errors(spark):
    with pytest.raises(ConfigError):
        views.selection(rows(spark), config(aois=()))
    with pytest.raises(DataError):
        views.selection(rows(spark), config(aois=("alpha", "gamma")))
    with pytest.raises(ConfigError):
        views.view_metrics(rows(spark), cfg2(), 61)


def test_period_edges(spark):
    edge = [("alpha", "x", "2023-12-31 23:59:59", 1.0, 1.0, 0.0, True, True), ("alpha", "y", "2024-04-01 00:00:00", 1.0, 1.0, 0.0, True, True)]
    assert timelines.in_period(rows(spark, edge), cfg2()).count() == len(ROWS)


def test_zero_denominators(spark):
    only = spark.createDataFrame([("alpha", "i", datetime(2024, 1, 2), 1.0, 1.0, 0.0, True, False)], SCHEMA)
    got = views.view_metrics(only, config(), 7)["aoi_summary"].first().asDict()
    assert all(v == 0 for k, v in got.items() if k not in ("aoi_id", "best_month", "worst_month"))


def test_picks_and_dumbbell(spark):
    medians = (8, 1, 7, 2, 6, 3, 5, 4)
    summary = spark.createDataFrame([(f"aoi-{k}", 1.0, float(m)) for k, m in enumerate(medians)], "aoi_id string, nominal_median_gap_days double, effective_median_gap_days double")
    picks = views.survival_picks(summary)
    assert len(set(picks)) == 6 and picks[0] == "aoi-1" and picks[-1] == "aoi-0"
    bell = views.dumbbell(summary).collect()
    assert bell[0].aoi_id == "aoi-1" and bell[-1].delta_days == 7
    assert views.unfold_dumbbell(views.dumbbell(summary)).count() == 16


def test_service_levels_with_median(spark):
    waits = spark.createDataFrame([("a", datetime(2024, 1, 1), 0.0), ("a", datetime(2024, 1, 2), 7.0), ("b", datetime(2024, 1, 1), 1.0), ("b", datetime(2024, 1, 2), 9.0)], "aoi_id string, t0 timestamp, wait_days double")
    out = views.service_levels(waits, waits.select("aoi_id").distinct())
    assert out.count() == 90 and {r.success_rate for r in out.where("window_days = 7").collect()} == {0.5}


def test_map(spark):
    summary = spark.createDataFrame([("a", 0.5)], "aoi_id string, p double")
    places = spark.createDataFrame([("a", "A", "X", 1.0, 2.0)], "aoi_id string, name string, country string, lat double, lon double")
    assert views.map_points(summary, places).first().country == "X"
    with pytest.raises(DataError):
        views.map_points(summary, places.where("aoi_id = 'b'"))
    with pytest.raises(DataError):
        views.map_points(summary, places.union(places))
    assert views.map_metric("longest_outage_days", 7, 12.0).domain == (0.0, 30.0)
    assert views.map_metric("sla_success", 7, 12.0).label == "SLA success (wait < 7 days)"
