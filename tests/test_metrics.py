from datetime import date, datetime

import pytest
from helpers import OBSERVED, at, config, golden, two_entities

from skywait.config import ClassGroups, Config, load_config
from skywait.errors import ConfigError, DataError
from skywait.operators import classifier, reliability, timelines
from skywait.plans import metric_tables, sql_tables


def timeline_of(spark, instants):
    return spark.createDataFrame([("a", f"d{k}", "h", t, None, True, True) for k, t in enumerate(instants)], OBSERVED)


def one(spark):
    return spark.createDataFrame([("a",)], "aoi_id string")


def test_documented_example(spark):
    cfg = config(end=date(2024, 3, 1), horizon_days=20, aois=("a",))
    obs = timeline_of(spark, [at(0), at(5), at(40)])
    waits = timelines.waits(obs, one(spark), cfg).orderBy("t0").collect()
    assert [r.wait_days for r in waits] == [0, 4, 3, 2, 1, 0] + [20] * 14 + list(range(20, -1, -1))
    assert [k for k, r in enumerate(waits) if r.censored] == list(range(6, 20))
    frame = timelines.waits(obs, one(spark), cfg)
    curve = {r.n_days: r.p_waiting for r in reliability.survival(frame, one(spark), 20).collect()}
    assert curve[7] == 27 / 41 and len(curve) == 21 and curve[20] == 0.0
    assert reliability.service_level(frame, 7).first().sla_success == 13 / 41
    assert reliability.within(reliability.survival(frame, one(spark), 20), 20, (7,)).first()[1] == 1 - 27 / 41
    assert sorted(r.gap_days for r in timelines.gaps(obs).where("kind = 'effective'").collect()) == [5, 35]
    with pytest.raises(ConfigError):
        reliability.within(reliability.survival(frame, one(spark), 20), 20, (30,))


def test_fractions_and_horizon(spark):
    cfg = config(end=date(2024, 1, 7), horizon_days=2, aois=("a",))
    obs = timeline_of(spark, [datetime(2024, 1, 3, 6), datetime(2024, 1, 6, 18)])
    rows = timelines.waits(obs, one(spark), cfg).orderBy("t0").collect()
    assert [r.wait_days for r in rows] == [2.0, 1.25, 0.25, 2.0, 1.75]
    assert [r.censored for r in rows] == [True, False, False, True, False]


def test_strict_and_not(spark):
    waits = spark.createDataFrame([("a", at(k), w, False) for k, w in enumerate((0.0, 6.999, 7.0, 8.0))], "aoi_id string, t0 timestamp, wait_days double, censored boolean")
    curve = {r.n_days: r.p_waiting for r in reliability.survival(waits, one(spark), 8).collect()}
    assert curve[7] == 0.25
    assert reliability.service_level(waits, 7).first().sla_success == 0.5
    levels = {r.window_days: r.success_rate for r in reliability.service_curve(waits, one(spark), 8).collect()}
    assert levels[7] == 0.5 and levels[1] == 0.25 and levels[8] == 0.75 and len(levels) == 8
    for bad in ((0, None), (7, 13)):
        with pytest.raises(ConfigError):
            reliability.service_level(waits, *bad)


def test_months(spark):
    waits = spark.createDataFrame([("a", datetime(2024, 1, 31), 4.5, False), ("a", datetime(2024, 2, 1), 10.0, False)], "aoi_id string, t0 timestamp, wait_days double, censored boolean")
    rows = {r.month: (r.p_within_5d, r.p_within_7d, r.p_within_14d, r.n_days) for r in reliability.monthly(waits, one(spark)).collect()}
    assert len(rows) == 12 and rows[1] == (1, 1, 1, 1) and rows[2] == (0, 0, 1, 1) and all(rows[m] == (0, 0, 0, 0) for m in range(3, 13))
    best = reliability.best_and_worst(reliability.monthly(waits, one(spark))).first()
    assert (best.best_month, best.worst_month) == (1, 2)
    names = {r.month: r.month_name for r in reliability.seasonal(reliability.monthly(waits, one(spark))).collect()}
    assert names[3] == "March"
    with pytest.raises(DataError):
        reliability.seasonal(reliability.monthly(waits, one(spark)).where("month > 1"))


def test_gaps(spark):
    obs = timeline_of(spark, [datetime(2024, 1, 1, 12), datetime(2024, 1, 6), datetime(2024, 2, 10, 6)])
    got = timelines.gaps(obs).where("kind = 'nominal'").orderBy("gap_start").collect()
    assert [r.gap_days for r in got] == [4.5, 35.25]
    assert timelines.gaps(timeline_of(spark, [at(0)])).isEmpty()
    assert timelines.long_outages(timelines.gaps(obs)).count() == 1


def test_confusion(spark):
    table = list(zip((10, 15, 20, 25, 30, 5, 0), (True, False, True, False, True, False, True), (True,) * 6 + (False,), strict=True))
    rows = spark.createDataFrame([("alpha", float(c), u, k) for c, u, k in table], "aoi_id string, catalog_cloud_cover double, usable boolean, complete boolean")
    out = classifier.confusion(rows.where("complete"), rows.select("aoi_id").distinct())
    assert out.count() == 42
    t20 = out.where("aoi_id = 'alpha' and threshold = 20").first()
    assert (t20.tp, t20.fp, t20.fn, t20.tn) == (2, 2, 1, 1)
    assert (t20.precision, t20.recall, t20.kept_unusable_rate, t20.discarded_usable_rate) == (0.5, 2 / 3, 0.5, 1 / 3)
    assert t20.f1 == pytest.approx(4 / 7, abs=1e-15)
    t0 = out.where("aoi_id = 'ALL' and threshold = 0").first()
    assert (t0.tp, t0.fp, t0.fn, t0.tn, t0.precision, t0.recall, t0.f1, t0.discarded_usable_rate) == (0, 0, 3, 3, 0, 0, 0, 1)
    with pytest.raises(ConfigError):
        classifier.pooled_at(out, 21)


def test_golden_tables(spark):
    cfg = config()
    tables = metric_tables.build_metric_tables(golden(spark, cfg), cfg)
    assert {k: t.count() for k, t in tables.items()} == {"aoi_wait_daily": 31, "aoi_survival": 61, "aoi_monthly": 12, "aoi_gaps": 7, "aoi_summary": 1, "catalog_filter_eval": 42}
    s = tables["aoi_summary"].first()
    assert (s.n_observations, s.n_usable, s.usable_rate, s.longest_outage_days, s.n_outages_over_30d) == (6, 3, 0.5, 35.0, 1)
    assert (s.catalog_filter_precision_t20, s.catalog_filter_recall_t20) == (0.5, 2 / 3)
    level = metric_tables.query_sla(tables["aoi_wait_daily"], cfg.config_hash, "alpha", 7)
    assert level == tables["aoi_wait_daily"].where("wait_days < 7").count() / 31


@pytest.mark.parametrize("table", ["aoi_wait_daily", "aoi_gaps", "aoi_survival", "aoi_monthly", "catalog_filter_eval", "aoi_summary"])
def test_sql_twins(spark, table):
    cfg = config(aois=("alpha", "beta"))
    obs = metric_tables.scope(two_entities(spark, cfg), cfg)
    names = metric_tables.entity_table(spark, cfg)
    ours = metric_tables.compute(obs, names, cfg)[table]
    twin = sql_tables.sql_table(spark, table, obs, names, cfg)
    assert sorted(ours.columns) == sorted(twin.columns)
    keys = [c for c in ours.columns if dict(ours.dtypes)[c] != "double"]
    a, b = (t.select(sorted(t.columns)).orderBy(*keys).toPandas() for t in (ours, twin))
    assert len(a) == len(b) and a.isna().sum().sum() == 0
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert (a[c] - b[c]).abs().max() <= 1e-12
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all()


def test_entity_without_usable_rows(spark):
    cfg = config(aois=("alpha", "beta"))
    beta = metric_tables.build_metric_tables(two_entities(spark, cfg), cfg)["aoi_summary"].where("aoi_id = 'beta'").first().asDict()
    assert beta["n_observations"] == 1 and beta["n_usable"] == 0
    assert all(v == 0 for k, v in beta.items() if k not in ("aoi_id", "config_hash", "n_observations", "worst_month", "best_month"))


def test_errors(spark):
    cfg = config(aois=("alpha", "gamma"))
    with pytest.raises(DataError):
        metric_tables.build_metric_tables(golden(spark, cfg), cfg)
    with pytest.raises(DataError):
        cfg = config()
        metric_tables.build_metric_tables(golden(spark, cfg).union(golden(spark, cfg)), cfg)
    with pytest.raises(ConfigError):
        config(end=date(2024, 2, 1)).require_horizon()
    for bad in ({"end": date(2023, 1, 1)}, {"aois": ("a", "a")}, {"aois": ("ALL",)}, {"min_clear": 1.5}, {"horizon_days": 0}):
        with pytest.raises(ConfigError):
            config(**bad)
    with pytest.raises(ConfigError):
        ClassGroups(clear=(4, 5))


def test_config_hash_and_file(tmp_path):
    assert config().config_hash == config().config_hash != config(min_clear=0.7).config_hash
    (tmp_path / "c.yaml").write_text("start: 2024-01-01\nend: 2024-03-31\naois: [alpha]\n")
    assert load_config(tmp_path / "c.yaml") == Config(start=date(2024, 1, 1), end=date(2024, 3, 31), aois=("alpha",))
    (tmp_path / "c.yaml").write_text("start: 2024-01-01\nend: 2024-03-31\ncolour: red\n")
    with pytest.raises(ConfigError):
        load_config(tmp_path / "c.yaml")


def test_waits_do_not_square(spark):
    plan = timelines.waits(timeline_of(spark, [at(0)]), one(spark), config(aois=("a",)))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Join" not in plan.split("== Physical Plan ==")[1]
