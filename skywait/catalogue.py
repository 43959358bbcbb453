"""Registered queries over the shared tables, each with SQL that gives the same rows.

The tables hold no satellites: events stand for observations (one user is one entity),
line items for catalogue scenes, embeddings for rasters, suppliers for places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .config import Config
from .functions.columns import relative_orbit, utm_epsg
from .operators import catalogue_upkeep, classifier, composite, rasters, reliability, spatial, timelines
from .operators.slices import heavy_groups
from .plans import metric_tables, sql_tables, views
from .sources import geotiff
from .sources.bucketed import BucketedTable
from .sources.shared import shared_folder

CONFIG = Config(start=date(2024, 1, 1), end=date(2024, 1, 30), aois=("u0",), horizon_days=14)
WITHIN = (3, 5, 7, 14)
LONG = Config(start=date(1995, 1, 1), end=date(2001, 11, 4), aois=("s0",), horizon_days=60)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = _table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("aoi_id"), F.col("event_id").alias("datatake_id"), F.col("ts").alias("observed_at"),
        F.least("value", F.lit(100.0)).alias("catalog_cloud_cover"), (k / F.lit(100.0)).alias("clear_fraction"),
        F.when(k < 5, 0.9).otherwise(1.0).alias("covered_fraction"), (F.col("event_type") != "error").alias("complete"),
    )
    return timelines.derive_usable(rows, CONFIG.min_coverage, CONFIG.min_clear)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("aoi_id").distinct()


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations of suppliers."""
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("aoi_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("datatake_id"),
        F.col("l_shipdate").alias("observed_at"), (2 * F.col("l_quantity")).alias("catalog_cloud_cover"), (F.col("l_discount") >= 0.08).alias("usable"), F.lit(True).alias("complete"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as catalogue scenes; line 7 has no datatake, line 1 no sequence."""
    line = F.col("l_linenumber")
    return _table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("scene_id"), F.col("l_suppkey").cast("string").alias("mgrs_tile"),
        F.when(line != 7, F.date_format("l_shipdate", "yyyy-MM")).alias("datatake_id"), F.when(line != 1, line).alias("sequence"), F.col("l_shipdate").alias("generation_time"),
        F.concat(F.lit("u"), (F.col("l_orderkey") % 10).cast("string")).alias("aoi_id"), (F.col("l_tax") * 10).alias("footprint_overlap_fraction"),
        F.col("l_shipdate").alias("datetime"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("platform"),
        (F.col("l_partkey") % 143).alias("relative_orbit"), F.when(F.col("l_discount") > 0.01, 1000 * F.col("l_discount")).alias("eo_cloud_cover"),
        F.col("l_quantity").cast("long").alias("n_covered"), (F.col("l_linestatus") == "O").alias("read_ok"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 scenes of an entity (label) and datatake."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pixel", "x"))
    return v.select(
        F.col("label").cast("string").alias("aoi_id"), (F.col("vec_id") % 25).alias("datatake_id"), F.col("vec_id").alias("scene_id"), "pixel",
        F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 7).cast("double")).alias("nodata_pct"), (F.floor(F.abs(F.col("x").cast("double")) * 40).cast("int") % 12).alias("class"),
    )


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


# SQL building blocks, in the oracle's dialect.
OBS = """obs AS (SELECT *, complete AND covered_fraction >= 0.95::DOUBLE AND clear_fraction >= 0.8::DOUBLE AS usable FROM (
  SELECT 'u' || user_id AS aoi_id, event_id AS datatake_id, ts AS observed_at, least(value, 100.0::DOUBLE) AS catalog_cloud_cover, k / 100.0::DOUBLE AS clear_fraction,
    CASE WHEN k < 5 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS covered_fraction, event_type <> 'error' AS complete
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events))),
 ent AS (SELECT DISTINCT aoi_id FROM obs)"""
GAPS = """gaps AS (SELECT * FROM (SELECT aoi_id, kind, lag(observed_at) OVER (PARTITION BY aoi_id, kind ORDER BY observed_at, datatake_id) AS gap_start, observed_at AS gap_end,
    (epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY aoi_id, kind ORDER BY observed_at, datatake_id))) / 86400000000.0::DOUBLE AS gap_days
  FROM (SELECT *, 'nominal' AS kind FROM obs WHERE complete UNION ALL SELECT *, 'effective' AS kind FROM obs WHERE complete AND usable)) WHERE gap_start IS NOT NULL)"""


def _waits(first: str, last: str, horizon: int, obs: str = "obs", ent: str = "ent", name: str = "waits") -> str:
    return f"""{name} AS (SELECT aoi_id, t0, CASE WHEN w IS NULL OR w > {horizon} THEN {horizon}::DOUBLE ELSE w END AS wait_days, w IS NULL OR w > {horizon} AS censored FROM (
  SELECT s.aoi_id, s.t0, (epoch_us(u.observed_at) - epoch_us(s.t0)) / 86400000000.0::DOUBLE AS w
  FROM (SELECT aoi_id, d AS t0 FROM {ent}, (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 DAY)) AS d)) s
  ASOF LEFT JOIN (SELECT aoi_id, observed_at FROM {obs} WHERE complete AND usable) u ON s.aoi_id = u.aoi_id AND s.t0 <= u.observed_at))"""


WAITS = _waits("2024-01-01", "2024-01-16", 14)
CURVE = """curve AS (SELECT e.aoi_id, n::INTEGER AS n_days, coalesce(count(*) FILTER (WHERE w.wait_days > n)::DOUBLE / nullif(count(w.t0), 0), 0.0::DOUBLE) AS p_waiting
  FROM (SELECT aoi_id, unnest(range(0, 15)) AS n FROM ent) e LEFT JOIN waits w ON w.aoi_id = e.aoi_id GROUP BY e.aoi_id, n)"""
MONTHS = """months AS (SELECT e.aoi_id, e.month::INTEGER AS month, coalesce(avg((wait_days <= 5)::INTEGER), 0.0::DOUBLE) AS p_within_5d, coalesce(avg((wait_days <= 7)::INTEGER), 0.0::DOUBLE) AS p_within_7d,
    coalesce(avg((wait_days <= 14)::INTEGER), 0.0::DOUBLE) AS p_within_14d, count(w.t0) AS n_days
  FROM (SELECT aoi_id, unnest(range(1, 13)) AS month FROM ent) e LEFT JOIN waits w ON w.aoi_id = e.aoi_id AND month(w.t0) = e.month GROUP BY e.aoi_id, e.month)"""


def _rates() -> str:
    def r(n, d):
        return f"coalesce(({n})::DOUBLE / nullif(({d})::DOUBLE, 0), 0.0::DOUBLE)"

    p, q = r("tp", "tp + fp"), r("tp", "tp + fn")
    return f"{p} AS precision, {q} AS recall, {r(f'2.0::DOUBLE * {p} * {q}', f'{p} + {q}')} AS f1, {r('fp', 'tp + fp')} AS kept_unusable_rate, {r('fn', 'tp + fn')} AS discarded_usable_rate"


def _confusion(source: str, value: str, truth: str, names: str, limits: str) -> str:
    hit = f"coalesce(o.{value} <= s.threshold, false)"
    return f"""evaluated AS (SELECT *, {_rates()} FROM (SELECT s.aoi_id, s.threshold::INTEGER AS threshold,
    count(*) FILTER (WHERE o.{truth} AND {hit}) AS tp, count(*) FILTER (WHERE NOT o.{truth} AND {hit}) AS fp,
    count(*) FILTER (WHERE o.{truth} AND NOT {hit}) AS fn, count(*) FILTER (WHERE NOT o.{truth} AND NOT {hit}) AS tn
  FROM (SELECT aoi_id, unnest({limits}) AS threshold FROM (SELECT aoi_id FROM {names} UNION ALL SELECT 'ALL')) s
  LEFT JOIN (SELECT * FROM {source} UNION ALL SELECT * REPLACE ('ALL' AS aoi_id) FROM {source}) o ON o.aoi_id = s.aoi_id GROUP BY s.aoi_id, s.threshold))"""


EVAL = "comp AS (SELECT * FROM obs WHERE complete), " + _confusion("comp", "catalog_cloud_cover", "usable", "ent", "range(0, 101, 5)")
STATS = """stats AS (SELECT aoi_id, coalesce(median(gap_days) FILTER (WHERE kind = 'nominal'), 0.0::DOUBLE) AS nominal_median_gap_days,
  coalesce(median(gap_days) FILTER (WHERE kind = 'effective'), 0.0::DOUBLE) AS effective_median_gap_days, coalesce((SELECT sum(gap_days * (1 - abs(r - 0.9::DOUBLE * (n - 1)))) FROM (SELECT gap_days, row_number() OVER (ORDER BY gap_days) - 1 AS r, count(*) OVER () AS n FROM gaps g WHERE g.aoi_id = gaps.aoi_id AND kind = 'effective') WHERE abs(r - 0.9::DOUBLE * (n - 1)) < 1), 0.0::DOUBLE) AS effective_p90_gap_days,
  coalesce(max(gap_days) FILTER (WHERE kind = 'effective'), 0.0::DOUBLE) AS longest_outage_days, count(*) FILTER (WHERE kind = 'effective' AND gap_days > 30) AS n_outages_over_30d FROM gaps GROUP BY aoi_id)"""
BEST = """best AS (SELECT e.aoi_id, coalesce(b.month, 0)::INTEGER AS best_month, coalesce(w.month, 0)::INTEGER AS worst_month, coalesce(b.p_within_7d, 0.0::DOUBLE) AS p_within_7d_best_month, coalesce(w.p_within_7d, 0.0::DOUBLE) AS p_within_7d_worst_month
  FROM ent e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY p_within_7d DESC, month) AS r FROM months WHERE n_days > 0) b ON b.aoi_id = e.aoi_id AND b.r = 1
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY p_within_7d, month) AS r FROM months WHERE n_days > 0) w ON w.aoi_id = e.aoi_id AND w.r = 1)"""
SUMMARY = f"""summary AS (SELECT e.aoi_id, (SELECT count(*) FROM obs o WHERE o.aoi_id = e.aoi_id AND complete) AS n_observations, (SELECT count(*) FROM obs o WHERE o.aoi_id = e.aoi_id AND complete AND usable) AS n_usable,
    coalesce((SELECT count(*) FROM obs o WHERE o.aoi_id = e.aoi_id AND complete AND usable)::DOUBLE / nullif((SELECT count(*) FROM obs o WHERE o.aoi_id = e.aoi_id AND complete), 0), 0.0::DOUBLE) AS usable_rate,
    coalesce(s.nominal_median_gap_days, 0.0::DOUBLE) AS nominal_median_gap_days, coalesce(s.effective_median_gap_days, 0.0::DOUBLE) AS effective_median_gap_days, coalesce(s.effective_p90_gap_days, 0.0::DOUBLE) AS effective_p90_gap_days,
    coalesce(s.longest_outage_days, 0.0::DOUBLE) AS longest_outage_days, coalesce(s.n_outages_over_30d, 0) AS n_outages_over_30d,
    {', '.join(f"(SELECT 1.0::DOUBLE - p_waiting FROM curve c WHERE c.aoi_id = e.aoi_id AND n_days = {n}) AS p_within_{n}d" for n in WITHIN)},
    b.best_month, b.worst_month, b.p_within_7d_best_month, b.p_within_7d_worst_month, t.precision AS catalog_filter_precision_t20, t.recall AS catalog_filter_recall_t20
  FROM ent e LEFT JOIN stats s ON s.aoi_id = e.aoi_id JOIN best b ON b.aoi_id = e.aoi_id JOIN evaluated t ON t.aoi_id = e.aoi_id AND t.threshold = 20)"""
ALL = f"WITH {OBS}, {GAPS}, {WAITS}, {CURVE}, {MONTHS}, {EVAL}, {STATS}, {BEST}, {SUMMARY}"
LINES = """lines AS (SELECT 's' || l_suppkey AS aoi_id, l_shipdate AS observed_at, l_discount >= 0.08::DOUBLE AS usable, true AS complete FROM lineitem), sups AS (SELECT DISTINCT aoi_id FROM lines)"""
SCENES = """scenes AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INTEGER AS scene_id, l_suppkey::VARCHAR AS mgrs_tile, CASE WHEN l_linenumber <> 7 THEN strftime(l_shipdate, '%Y-%m') END AS datatake_id,
    CASE WHEN l_linenumber <> 1 THEN l_linenumber END AS sequence, l_shipdate AS generation_time, 'u' || (l_orderkey % 10) AS aoi_id, l_tax * 10 AS footprint_overlap_fraction, l_shipdate AS datetime,
    CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS platform, l_partkey % 143 AS relative_orbit, CASE WHEN l_discount > 0.01::DOUBLE THEN 1000 * l_discount END AS eo_cloud_cover, l_quantity::BIGINT AS n_covered, l_linestatus = 'O' AS read_ok FROM lineitem),
 ranked AS (SELECT *, first_value(scene_id) OVER (PARTITION BY CASE WHEN mgrs_tile IS NULL OR datatake_id IS NULL THEN 'id' || scene_id ELSE mgrs_tile || '|' || datatake_id END
    ORDER BY coalesce(sequence, -1) DESC, generation_time DESC, scene_id DESC) AS winner FROM scenes)"""
PIXELS = """pix AS (SELECT label::VARCHAR AS aoi_id, vec_id % 25 AS datatake_id, vec_id AS scene_id, i - 1 AS pixel, CASE WHEN vec_id % 7 <> 0 THEN (vec_id % 7)::DOUBLE END AS nodata_pct,
    floor(abs(embedding[i]::DOUBLE) * 40)::INTEGER % 12 AS class FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
COMPOSITE = """filled AS (SELECT aoi_id, datatake_id, pixel::INTEGER AS pixel, coalesce(max(CASE WHEN r = 1 THEN class END), 0)::INTEGER AS class FROM (
    SELECT *, CASE WHEN class <> 0 THEN row_number() OVER (PARTITION BY aoi_id, datatake_id, pixel ORDER BY class = 0, coalesce(nodata_pct, 'Infinity'::DOUBLE), scene_id) END AS r FROM pix) GROUP BY aoi_id, datatake_id, pixel)"""
COUNTS = ", ".join(f"count(*) FILTER (WHERE class = {k}) AS count_class_{k}" for k in range(12))


@_query("observations_projection", f"WITH {OBS} SELECT *, CASE WHEN NOT complete THEN 'incomplete' WHEN usable THEN 'usable' ELSE 'unusable' END AS status FROM obs WHERE observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-01-31'")
def observations_projection(spark, sf):
    return timelines.with_status(timelines.in_period(observations(spark, sf), CONFIG))


@_query("gap_table", f"WITH {OBS}, {GAPS} SELECT * FROM gaps")
def gap_table(spark, sf):
    return timelines.gaps(observations(spark, sf))


def waits_of(spark, sf):
    return timelines.waits(observations(spark, sf), entities(spark, sf), CONFIG)


@_query("wait_daily", f"WITH {OBS}, {WAITS} SELECT * FROM waits")
def wait_daily(spark, sf):
    return waits_of(spark, sf)


@_query("wait_daily_large", f"WITH {LINES}, {_waits('1995-01-01', '2001-09-05', 60, 'lines', 'sups')} SELECT * FROM waits")
def wait_daily_large(spark, sf):
    rows = deliveries(spark, sf)
    return timelines.waits(rows, rows.select("aoi_id").distinct(), LONG)


@_query("survival_curve", f"WITH {OBS}, {WAITS}, {CURVE} SELECT * FROM curve")
def survival_curve(spark, sf):
    return reliability.survival(waits_of(spark, sf), entities(spark, sf), CONFIG.horizon_days)


@_query("within_n", f"WITH {OBS}, {WAITS}, {CURVE} SELECT aoi_id, {', '.join(f'max(1.0::DOUBLE - p_waiting) FILTER (WHERE n_days = {n}) AS p_within_{n}d' for n in WITHIN)} FROM curve GROUP BY aoi_id")
def within_n(spark, sf):
    return reliability.within(survival_curve(spark, sf), CONFIG.horizon_days, WITHIN)


@_query("sla_success", f"WITH {OBS}, {WAITS} SELECT aoi_id, avg((wait_days < 7)::INTEGER) AS sla_success FROM waits GROUP BY aoi_id")
def sla_success(spark, sf):
    return reliability.service_level(waits_of(spark, sf), 7)


@_query("sla_by_month", f"WITH {LINES}, {_waits('1995-01-01', '2001-09-05', 60, 'lines', 'sups')} SELECT aoi_id, coalesce(avg((wait_days < 7)::INTEGER) FILTER (WHERE month(t0) = 2), 0.0::DOUBLE) AS sla_success FROM waits GROUP BY aoi_id")
def sla_by_month(spark, sf):
    return reliability.service_level(wait_daily_large(spark, sf), 7, month=2)


SLA_CURVE = "sla AS (SELECT w.aoi_id, n::INTEGER AS window_days, avg((wait_days < n)::INTEGER) AS success_rate FROM waits w, (SELECT unnest(range(1, 15)) AS n) GROUP BY w.aoi_id, n)"


@_query("sla_curve", f"WITH {OBS}, {WAITS}, {SLA_CURVE} SELECT * FROM sla")
def sla_curve(spark, sf):
    return reliability.service_curve(waits_of(spark, sf), entities(spark, sf), 14)


@_query("service_level_median", f"WITH {OBS}, {WAITS}, {SLA_CURVE} SELECT * FROM sla UNION ALL SELECT 'MEDIAN', window_days, median(success_rate) FROM sla GROUP BY window_days")
def service_level_median(spark, sf):
    return reliability.with_median(sla_curve(spark, sf))


@_query("monthly_reliability", f"WITH {OBS}, {WAITS}, {MONTHS} SELECT * FROM months")
def monthly_reliability(spark, sf):
    return reliability.monthly(waits_of(spark, sf), entities(spark, sf))


@_query("seasonal_comparison", f"WITH {OBS}, {WAITS}, {MONTHS} SELECT *, monthname(make_date(2000, month, 1)) AS month_name FROM months")
def seasonal_comparison(spark, sf):
    return reliability.seasonal(monthly_reliability(spark, sf))


@_query("heatmap_pivot", f"WITH {OBS}, {WAITS}, {MONTHS} SELECT aoi_id, {', '.join(f'max(p_within_7d) FILTER (WHERE month = {m}) AS m{m}' for m in range(1, 13))}, ({' + '.join(f'max(p_within_7d) FILTER (WHERE month = {m})' for m in range(1, 13))}) / 12 AS mean FROM months GROUP BY aoi_id")
def heatmap_pivot(spark, sf):
    return views.heatmap(monthly_reliability(spark, sf))


@_query("catalog_filter_eval", f"WITH {OBS}, {EVAL} SELECT * FROM evaluated")
def catalog_filter_eval(spark, sf):
    return classifier.confusion(observations(spark, sf).where("complete"), entities(spark, sf))


@_query("catalog_pooled", f"WITH {OBS}, {EVAL} SELECT * FROM evaluated WHERE aoi_id = 'ALL' AND threshold = 20")
def catalog_pooled(spark, sf):
    return views.evaluation_frames(catalog_filter_eval(spark, sf))


@_query("gap_stats", f"WITH {OBS}, {GAPS}, {STATS} SELECT * FROM stats")
def gap_stats(spark, sf):
    obs = observations(spark, sf)
    heavy = heavy_groups(obs, ("aoi_id",))
    return timelines.gap_statistics(timelines.gaps(obs, heavy=heavy), heavy=heavy)


# One entity with half of all rows, and slices so small that it is cut on any table.
HOT_LINES = LINES.replace("'s' || l_suppkey AS aoi_id", "CASE WHEN l_orderkey % 2 = 0 THEN 's0' ELSE 's' || l_suppkey END AS aoi_id").replace("true AS complete", "true AS complete, l_orderkey, l_linenumber, l_partkey")
HOT_SLICE = 4_000


def hot_deliveries(spark, sf):
    hot = F.col("datatake_id.l_orderkey") % 2 == 0
    return deliveries(spark, sf).withColumn("aoi_id", F.when(hot, "s0").otherwise(F.col("aoi_id")))


@_query("wait_daily_hot", f"WITH {HOT_LINES}, {_waits('1995-01-01', '2001-09-05', 60, 'lines', 'sups')} SELECT * FROM waits")
def wait_daily_hot(spark, sf):
    rows = hot_deliveries(spark, sf)
    return timelines.waits(rows, rows.select("aoi_id").distinct(), LONG, slice_rows=HOT_SLICE)


HOT_GAPS = f"{HOT_LINES}, obs AS (SELECT *, (l_orderkey, l_linenumber, l_partkey) AS datatake_id FROM lines), {GAPS}"


@_query("gap_table_hot", f"WITH {HOT_GAPS} SELECT * FROM gaps")
def gap_table_hot(spark, sf):
    return timelines.gaps(hot_deliveries(spark, sf), slice_rows=HOT_SLICE)


@_query("gap_stats_hot", f"WITH {HOT_GAPS}, {STATS} SELECT * FROM stats")
def gap_stats_hot(spark, sf):
    rows = hot_deliveries(spark, sf)
    heavy = heavy_groups(rows, ("aoi_id",), HOT_SLICE)
    return timelines.gap_statistics(timelines.gaps(rows, slice_rows=HOT_SLICE, heavy=heavy), heavy=heavy)


@_query("best_worst_month", f"WITH {OBS}, {WAITS}, {MONTHS}, {BEST} SELECT * FROM best")
def best_worst_month(spark, sf):
    return reliability.best_and_worst(monthly_reliability(spark, sf))


@_query("entity_summary", f"{ALL} SELECT * FROM summary")
def entity_summary(spark, sf):
    return metric_tables.compute(observations(spark, sf), entities(spark, sf), CONFIG, WITHIN)["aoi_summary"]


GRID = views.threshold_grid(0.83)


@_query(
    "threshold_sensitivity",
    f"""WITH {OBS}, cells AS (SELECT aoi_id, unnest([{', '.join(f'{g}::DOUBLE' for g in GRID)}]) AS min_clear FROM ent),
  use AS (SELECT c.min_clear, o.* FROM obs o JOIN cells c ON c.aoi_id = o.aoi_id WHERE complete AND covered_fraction >= 0.95::DOUBLE AND clear_fraction >= c.min_clear),
  w AS (SELECT s.aoi_id, s.min_clear, least(coalesce((epoch_us(u.observed_at) - epoch_us(s.t0)) / 86400000000.0::DOUBLE, 14.0::DOUBLE), 14.0::DOUBLE) AS wait_days
    FROM (SELECT *, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16', INTERVAL 1 DAY)) AS t0 FROM cells) s
    ASOF LEFT JOIN use u ON s.aoi_id = u.aoi_id AND s.min_clear = u.min_clear AND s.t0 <= u.observed_at)
  SELECT c.aoi_id, c.min_clear, n.n AS n_observations, coalesce(v.n, 0) AS n_usable, r.p_within_7d, r.sla_success, coalesce(coalesce(v.n, 0)::DOUBLE / nullif(n.n, 0), 0.0::DOUBLE) AS usable_rate
  FROM cells c LEFT JOIN (SELECT aoi_id, count(*) FILTER (WHERE complete) AS n FROM obs GROUP BY aoi_id) n ON n.aoi_id = c.aoi_id
  LEFT JOIN (SELECT aoi_id, min_clear, count(*) AS n FROM use GROUP BY aoi_id, min_clear) v ON v.aoi_id = c.aoi_id AND v.min_clear = c.min_clear
  LEFT JOIN (SELECT aoi_id, min_clear, avg((wait_days <= 7)::INTEGER) AS p_within_7d, avg((wait_days < 7)::INTEGER) AS sla_success FROM w GROUP BY aoi_id, min_clear) r ON r.aoi_id = c.aoi_id AND r.min_clear = c.min_clear""",
)
def threshold_sensitivity(spark, sf):
    return views.sensitivity(observations(spark, sf), entities(spark, sf), CONFIG, GRID, 7)


STATUS = "CASE WHEN NOT complete THEN 'incomplete' WHEN usable THEN 'usable' ELSE 'unusable' END"
TIMELINE = f"""line AS (SELECT *, coalesce(gap_days > 30, false) AS outage FROM (SELECT *, CASE WHEN status = 'usable' THEN (epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY aoi_id, status ORDER BY observed_at, datatake_id))) / 86400000000.0::DOUBLE END AS gap_days
  FROM (SELECT *, {STATUS} AS status FROM obs)))"""


@_query("observation_timeline", f"WITH {OBS}, {TIMELINE} SELECT * FROM line WHERE aoi_id = 'u7'")
def observation_timeline(spark, sf):
    return views.observation_timeline(observations(spark, sf), "u7")


@_query("timeline_all", f"WITH {OBS}, {TIMELINE} SELECT * FROM line")
def timeline_all(spark, sf):
    return timelines.timeline(observations(spark, sf))


@_query("long_outages", f"WITH {LINES.replace('true AS complete', 'true AS complete, l_orderkey, l_linenumber, l_partkey')} SELECT aoi_id, gap_start, gap_end, gap_days FROM (SELECT aoi_id, lag(observed_at) OVER w AS gap_start, observed_at AS gap_end, (epoch_us(observed_at) - epoch_us(lag(observed_at) OVER w)) / 86400000000.0::DOUBLE AS gap_days FROM lines WHERE usable WINDOW w AS (PARTITION BY aoi_id ORDER BY observed_at, l_orderkey, l_linenumber, l_partkey)) WHERE gap_days > 30")
def long_outages(spark, sf):
    return timelines.long_outages(timelines.gaps(deliveries(spark, sf)))


@_query("quality_scatter", f"WITH {OBS} SELECT aoi_id, datatake_id, observed_at, catalog_cloud_cover, clear_fraction, usable, {STATUS} AS status FROM obs WHERE complete")
def quality_scatter(spark, sf):
    return views.quality_scatter(observations(spark, sf))


@_query("status_counts", f"WITH {OBS} SELECT {STATUS} AS status, count(*) AS n FROM obs GROUP BY 1")
def status_counts(spark, sf):
    return views.status_counts(observations(spark, sf))


@_query("revisit_dumbbell", f"WITH {OBS}, {GAPS}, {STATS} SELECT aoi_id, nominal_median_gap_days, effective_median_gap_days, effective_median_gap_days - nominal_median_gap_days AS delta_days FROM stats")
def revisit_dumbbell(spark, sf):
    return views.dumbbell(gap_stats(spark, sf))


@_query("dumbbell_unpivot", f"WITH {OBS}, {GAPS}, {STATS} SELECT aoi_id, 'nominal' AS kind, nominal_median_gap_days AS days FROM stats UNION ALL SELECT aoi_id, 'effective', effective_median_gap_days FROM stats")
def dumbbell_unpivot(spark, sf):
    return views.unfold_dumbbell(revisit_dumbbell(spark, sf))


PLACE = "(s_suppkey % 160 - 80)::DOUBLE AS lat, (s_suppkey * 7 % 360 - 180)::DOUBLE AS lon"


def _spot():
    """aoi_id, lat and lon of a supplier."""
    key = F.col("s_suppkey")
    return F.concat(F.lit("s"), key.cast("string")).alias("aoi_id"), (key % 160 - 80).cast("double").alias("lat"), (key * 7 % 360 - 180).cast("double").alias("lon")


def places(spark, sf):
    nations = _table(spark, sf, "nation")
    aoi_id, *spot = _spot()
    joined = _table(spark, sf, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    return joined.select(aoi_id, F.col("s_name").alias("name"), F.col("n_name").alias("country"), *spot)


@_query("map_points", f"WITH {LINES} SELECT l.aoi_id, count(*) AS n_observations, count(*) FILTER (WHERE usable) AS n_usable, s_name AS name, n_name AS country, {PLACE} FROM lines l JOIN supplier ON 's' || s_suppkey = l.aoi_id JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def map_points(spark, sf):
    rates = deliveries(spark, sf).groupBy("aoi_id").agg(F.count("*").alias("n_observations"), F.count_if("usable").alias("n_usable"))
    return views.map_points(rates, places(spark, sf))


@_query("utm_zone", f"SELECT aoi_id, lat, lon, (least(60, floor((lon + 180) / 6) + 1) + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END)::BIGINT AS utm_epsg FROM (SELECT 's' || s_suppkey AS aoi_id, {PLACE} FROM supplier)")
def utm_zone(spark, sf):
    return places(spark, sf).select("aoi_id", "lat", "lon", utm_epsg(F.col("lat"), F.col("lon")).alias("utm_epsg"))


# Customers as footprints: rectangles of 4 to 10 by 2 to 6 degrees, either way round; suppliers as squares of 2 degrees.
FOOT = "(c_custkey * 13 % 3500) / 10.0::DOUBLE - 175 AS x, (c_custkey * 7 % 1500) / 10.0::DOUBLE - 75 AS y, (2 + c_custkey % 4)::DOUBLE AS dx, (1 + c_custkey % 3)::DOUBLE AS dy"


@_query(
    "footprint_overlap",
    f"""SELECT c_custkey, aoi_id, round((least(x + dx, lon + 1) - greatest(x - dx, lon - 1)) * (least(y + dy, lat + 1) - greatest(y - dy, lat - 1)) / 4, 6) AS overlap
  FROM (SELECT c_custkey, {FOOT} FROM customer) c JOIN (SELECT 's' || s_suppkey AS aoi_id, {PLACE} FROM supplier) s ON x - dx < lon + 1 AND x + dx > lon - 1 AND y - dy < lat + 1 AND y + dy > lat - 1""",
)
def footprint_overlap(spark, sf):
    """Which footprints cover which entities, without any tag, and how much of them."""
    key = F.col("c_custkey")

    def box(x, y, dx, dy):
        corners = [F.array(x + i * dx, y + j * dy) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
        return F.array(*corners)

    foot = box(key * 13 % 3500 / F.lit(10.0) - 175, key * 7 % 1500 / F.lit(10.0) - 75, (2 + key % 4).cast("double"), (1 + key % 3).cast("double"))
    feet = _table(spark, sf, "customer").select("c_custkey", F.when(key % 2 == 0, foot).otherwise(F.reverse(foot)).alias("foot"))
    squares = _table(spark, sf, "supplier").select(*_spot()).select("aoi_id", box(F.col("lon"), F.col("lat"), F.lit(1.0), F.lit(1.0)).alias("ring"))
    return spatial.overlapping(feet, squares, "foot", "ring", cell=5.0).select("c_custkey", "aoi_id", F.round("overlap", 6).alias("overlap"))


@_query(
    "extreme_examples",
    f"""WITH {OBS}, c AS (SELECT *, 1.0::DOUBLE - clear_fraction AS cloud_fraction FROM obs WHERE complete)
  SELECT * FROM (SELECT 'catalog-clear_aoi-cloudy' AS "case", * FROM c WHERE catalog_cloud_cover <= 20 AND NOT usable ORDER BY cloud_fraction DESC, clear_fraction, catalog_cloud_cover, aoi_id, datatake_id LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'catalog-cloudy_aoi-clear' AS "case", * FROM c WHERE catalog_cloud_cover > 20 AND usable ORDER BY catalog_cloud_cover DESC, clear_fraction DESC, aoi_id, datatake_id LIMIT 1)""",
)
def extreme_examples(spark, sf):
    return classifier.extreme_examples(observations(spark, sf).withColumn("cloud_fraction", F.lit(1.0) - F.col("clear_fraction")))


def _picks(inner: int = 4) -> str:
    """Best, worst and, in order, the free entity nearest to each quantile: one table a pick."""
    taken = "SELECT aoi_id FROM p0 UNION ALL SELECT aoi_id FROM p9"
    parts = ["p0 AS (SELECT aoi_id FROM m ORDER BY v, aoi_id LIMIT 1)", "p9 AS (SELECT aoi_id FROM m ORDER BY v DESC, aoi_id DESC LIMIT 1)"]
    for k in range(1, inner + 1):
        near = f"abs(v - (SELECT quantile_cont(v, {k}.0::DOUBLE / {inner + 1}) FROM m))"
        parts.append(f"p{k} AS (SELECT aoi_id FROM m WHERE aoi_id NOT IN ({taken}) ORDER BY {near}, v, aoi_id LIMIT 1)")
        taken += f" UNION ALL SELECT aoi_id FROM p{k}"
    rows = " UNION ALL ".join(f"SELECT {k} AS pick, aoi_id FROM p{9 if k > inner else k}" for k in range(inner + 2))
    return f"m AS (SELECT aoi_id, effective_median_gap_days AS v FROM stats), {', '.join(parts)}, picks AS ({rows})"


@_query("survival_picks", f"WITH {OBS}, {GAPS}, {WAITS}, {CURVE}, {STATS}, {_picks()} SELECT pick::INTEGER AS pick, curve.* FROM picks JOIN curve USING (aoi_id)")
def survival_picks(spark, sf):
    picks = views.survival_picks(gap_stats(spark, sf))
    chosen = spark.createDataFrame([(k, a) for k, a in enumerate(picks)], "pick int, aoi_id string")
    return chosen.join(survival_curve(spark, sf), "aoi_id")


@_query("label_classifier", "WITH comp AS (SELECT coalesce(lang, '') AS aoi_id, n_chars, quality = 1 AS good FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), names AS (SELECT DISTINCT aoi_id FROM comp), " + _confusion("comp", "n_chars", "good", "names", "range(0, 101, 5)") + " SELECT * FROM evaluated")
def label_classifier(spark, sf):
    rows = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id").where("quality is not null")
    rows = rows.select(F.coalesce("lang", F.lit("")).alias("aoi_id"), "n_chars", (F.col("quality") == 1).alias("good"))
    return classifier.confusion(rows, rows.select("aoi_id").distinct(), value="n_chars", truth="good")


@_query("dedupe_latest", f"WITH {SCENES} SELECT scene_id, mgrs_tile, datatake_id FROM ranked WHERE scene_id = winner")
def dedupe_latest(spark, sf):
    return catalogue_upkeep.latest(scenes(spark, sf)).select("scene_id", "mgrs_tile", "datatake_id")


@_query("superseded_map", f"WITH {SCENES} SELECT scene_id, winner AS superseded_by FROM ranked WHERE scene_id <> winner")
def superseded_map(spark, sf):
    return catalogue_upkeep.superseded(scenes(spark, sf))


@_query("resolve_chains", "SELECT o_orderkey::VARCHAR AS scene_id, ((o_orderkey // 64) * 64 + 63)::VARCHAR AS superseded_by FROM orders WHERE o_orderkey % 64 <> 63 AND (o_orderkey // 64) * 64 + 63 <= (SELECT max(o_orderkey) FROM orders)")
def resolve_chains(spark, sf):
    """Each order is superseded by the next one of its block of 64."""
    key = F.col("o_orderkey")
    rows = _table(spark, sf, "orders").where((key % 64 != 63) & (F.floor(key / 64) * 64 + 63 <= F.lit(_table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0])))
    return catalogue_upkeep.resolve_chains(rows.select(key.cast("string").alias("scene_id"), (key + 1).cast("string").alias("superseded_by")))


@_query("relink", f"WITH {SCENES} SELECT aoi_id, winner AS scene_id, max(footprint_overlap_fraction) AS footprint_overlap_fraction FROM ranked GROUP BY aoi_id, winner")
def relink(spark, sf):
    s = scenes(spark, sf)
    won = catalogue_upkeep.winner_table(s)
    losers = won.where("scene_id != winner").select("scene_id", F.col("winner").alias("superseded_by"))
    return catalogue_upkeep.relink(s.select("aoi_id", "scene_id", "footprint_overlap_fraction"), losers, won.where("scene_id = winner"))


@_query("upsert", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upsert(spark, sf):
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    incoming = orders.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("U"))
    return catalogue_upkeep.upsert(orders.where("o_orderkey % 2 = 0"), incoming, ["o_orderkey"])


@_query("upsert_repeated", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_custkey % 3 = 0) WHERE r = 1 UNION ALL SELECT o_custkey, min(o_orderkey), '-' FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey % 2 = 0 GROUP BY o_custkey")
def upsert_repeated(spark, sf):
    """Customers' rows overwritten by all their orders: of many with one key the last stays."""
    orders = _table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    old = orders.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.lit("-").alias("o_orderstatus"))
    return catalogue_upkeep.upsert(old, orders.where("o_custkey % 3 = 0"), ["o_custkey"], order="o_orderkey")


@_query("upsert_buckets", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'V' WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def upsert_buckets(spark, sf):
    """upsert in a stored table of buckets, by two batches."""
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    table = BucketedTable(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", ["o_orderkey"], 16)
    table.replace(orders.where("o_orderkey % 2 = 0"))
    for divisor, status in ((3, "U"), (5, "V")):
        table.upsert(orders.where(f"o_orderkey % {divisor} = 0").withColumn("o_orderstatus", F.lit(status)))
    return table.read()


@_query("watermark_overlap", f"WITH {OBS} SELECT aoi_id, watermark, greatest(TIMESTAMP '2024-01-10', watermark - INTERVAL 7 DAY) AS search_start FROM (SELECT aoi_id, max(observed_at) AS watermark FROM obs GROUP BY aoi_id)")
def watermark_overlap(spark, sf):
    state = observations(spark, sf).groupBy("aoi_id").agg(F.max("observed_at").alias("watermark"))
    return catalogue_upkeep.search_starts(state, date(2024, 1, 10), 7)


@_query("watermark_advance", f"WITH {OBS} SELECT aoi_id, greatest(max(observed_at) FILTER (WHERE NOT complete), max(observed_at) FILTER (WHERE complete)) AS watermark FROM obs GROUP BY aoi_id")
def watermark_advance(spark, sf):
    o = observations(spark, sf)
    state = o.where("not complete").groupBy("aoi_id").agg(F.max("observed_at").alias("watermark"))
    return catalogue_upkeep.advance(state, o.where("complete").select("aoi_id", F.col("observed_at").alias("datetime")))


@_query(
    "pending_groups",
    f"""WITH {SCENES}, m AS (SELECT aoi_id, mgrs_tile AS datatake_id, scene_id FROM scenes),
  o AS (SELECT aoi_id, datatake_id, count(*) + (datatake_id::INTEGER % 5 = 0)::INTEGER AS n_scenes FROM m WHERE datatake_id::INTEGER % 7 <> 0 GROUP BY 1, 2),
  st AS (SELECT aoi_id, scene_id FROM scenes WHERE NOT (sequence = 3 AND mgrs_tile::INTEGER % 11 = 0) OR sequence IS NULL)
  SELECT DISTINCT aoi_id, datatake_id FROM (SELECT m.aoi_id, m.datatake_id FROM m ANTI JOIN st ON st.aoi_id = m.aoi_id AND st.scene_id = m.scene_id
    UNION ALL SELECT g.aoi_id, g.datatake_id FROM (SELECT aoi_id, datatake_id, count(*) AS n_scenes FROM m GROUP BY 1, 2) g ANTI JOIN o ON o.aoi_id = g.aoi_id AND o.datatake_id = g.datatake_id AND o.n_scenes = g.n_scenes)""",
)
def pending_groups(spark, sf):
    s = scenes(spark, sf)
    members = s.select("aoi_id", F.col("mgrs_tile").alias("datatake_id"), "scene_id")
    tile = F.col("datatake_id").cast("int")
    done = members.where(tile % 7 != 0).groupBy("aoi_id", "datatake_id").agg(F.count("*").alias("n")).select("aoi_id", "datatake_id", (F.col("n") + (tile % 5 == 0).cast("int")).alias("n_scenes"))
    stats = s.where(~((F.col("sequence") == 3) & (F.col("mgrs_tile").cast("int") % 11 == 0)) | F.col("sequence").isNull()).select("aoi_id", "scene_id")
    return catalogue_upkeep.pending_groups(members, done, stats)


@_query("upkeep_counts", f"WITH {SCENES} SELECT aoi_id, count(*) AS fetched, count(*) FILTER (WHERE scene_id = winner AND NOT coalesce(sequence = 2, false)) AS \"new\", count(*) FILTER (WHERE scene_id <> winner) AS superseded FROM ranked GROUP BY aoi_id")
def upkeep_counts(spark, sf):
    s = scenes(spark, sf)
    return catalogue_upkeep.upkeep_counts(s, s.where("sequence = 2"), catalogue_upkeep.superseded(s))


@_query("search_intervals", "SELECT o_orderkey, s AS chunk_start, least(s + INTERVAL 90 DAY - INTERVAL 1 SECOND, o_orderdate + INTERVAL 365 DAY) AS chunk_end FROM (SELECT o_orderkey, o_orderdate, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 365 DAY, INTERVAL 90 DAY)) AS s FROM orders)")
def search_intervals(spark, sf):
    start = F.col("o_orderdate")
    ranges = _table(spark, sf, "orders").select("o_orderkey", start.alias("start"), (start + F.expr("interval 365 days")).alias("end"))
    return catalogue_upkeep.interval_rows(ranges).select("o_orderkey", "chunk_start", "chunk_end")


@_query("regex_orbit", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(regexp_extract(id, '_R([0-9]{3})_', 1), '')::BIGINT, -1) AS relative_orbit FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 'x' ELSE 'A_R' || lpad((l_partkey % 143)::VARCHAR, 3, '0') || '_T' END AS id FROM lineitem)")
def regex_orbit(spark, sf):
    text = F.when(F.col("l_linenumber") == 1, "x").otherwise(F.concat(F.lit("A_R"), F.lpad((F.col("l_partkey") % 143).cast("string"), 3, "0"), F.lit("_T")))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(relative_orbit(text), F.lit(-1)).alias("relative_orbit"))


@_query("pixel_composite", f"WITH {PIXELS}, {COMPOSITE} SELECT * FROM filled")
def pixel_composite(spark, sf):
    return composite.pixel_composite(pixels(spark, sf))


@_query("array_composite", f"WITH {PIXELS}, {COMPOSITE} SELECT aoi_id, datatake_id, string_agg(class::VARCHAR, ',' ORDER BY pixel) AS classes FROM filled GROUP BY aoi_id, datatake_id")
def array_composite(spark, sf):
    classes = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 40).cast("int") % 12)
    vec = F.col("vec_id")
    rows = _table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("aoi_id"), (vec % 25).alias("datatake_id"), vec.alias("scene_id"), F.when(vec % 7 != 0, (vec % 7).cast("double")).alias("nodata_pct"), classes.alias("classes")
    )
    return composite.array_composite(rows).withColumn("classes", F.array_join(F.col("classes").cast("array<string>"), ","))


# A vector as a raster of 8 x 8 pixels of 10 m in tiles of 4 x 4, read on a grid of 5 x 6 pixels of 17 m that reaches beyond it.
_C = "floor((-13.0::DOUBLE + (k % 5 + 0.5::DOUBLE) * 17) / 10)::INTEGER"
_R = "floor((-4.5::DOUBLE + (k // 5 + 0.5::DOUBLE) * 17) / 10)::INTEGER"


@_query(
    "raster_windows",
    f"""WITH {PIXELS}, spots AS (SELECT k, {_C} AS c, {_R} AS r FROM (SELECT unnest(range(0, 30)) AS k))
  SELECT v.vec_id AS scene_id, string_agg(coalesce(p.class, 0)::VARCHAR, ',' ORDER BY k) AS classes FROM embeddings v, spots
  LEFT JOIN pix p ON p.scene_id = v.vec_id AND c BETWEEN 0 AND 7 AND r BETWEEN 0 AND 7 AND p.pixel = r * 8 + c GROUP BY v.vec_id""",
)
def raster_windows(spark, sf):
    vectors = _table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("scene_id"), F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 40).cast("int") % 12).alias("c"))
    sources = vectors.select("scene_id", F.lit(32633).cast("long").alias("epsg"), F.lit(500000.0).alias("left"), F.lit(80.0).alias("top"), *[F.lit(n).alias(c) for c, n in (("width", 8), ("height", 8))], F.lit(10.0).alias("step"), F.lit(4).alias("tile"))
    numbered = vectors.withColumn("tile_number", F.explode(F.sequence(F.lit(0), F.lit(3))))
    corner = F.floor(F.col("tile_number") / 2) * 32 + (F.col("tile_number") % 2) * 4
    tiles = numbered.select("scene_id", "tile_number", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.get("c", (corner + F.floor(k / 4) * 8 + k % 4).cast("int"))).alias("classes"))
    grid = spark.createDataFrame([("a", 32633, 500000.0 - 13.0, 80.0 + 4.5, 5, 6, 17.0)], "aoi_id string, epsg long, left double, top double, width int, height int, step double")
    read = rasters.on_grids(sources.select(F.lit("a").alias("aoi_id"), "scene_id"), grid, sources, tiles, strip_pixels=10)
    return read.select(F.col("scene_id").cast("long").alias("scene_id"), F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"))


@_query(
    "geotiff_tiles",
    """WITH v AS (SELECT vec_id, max(embedding) AS e FROM embeddings WHERE embedding IS NOT NULL GROUP BY vec_id),
  p AS (SELECT vec_id, coalesce(floor(abs(x::DOUBLE) * 40)::INTEGER % 12, 0) AS class, place FROM (SELECT vec_id, unnest(e) AS x, unnest(range(0, len(e))) AS place FROM v))
  SELECT 'r' || (vec_id // 256) AS scene_id, ((vec_id % 256) // 64)::INTEGER AS tile_number, sum(class * ((vec_id % 64) * 64 + place + 1))::BIGINT AS checksum, count(*) FILTER (WHERE class <> 0) AS n_pixels
  FROM p WHERE place < 64 GROUP BY 1, 2 HAVING sum(class) > 0""",
)
def geotiff_tiles(spark, sf):
    """Rasters of 256 vectors, a line each, written as GeoTIFF files and read again as tiles of 64 lines."""
    classes = F.transform("embedding", lambda x: F.coalesce(F.floor(F.abs(x.cast("double")) * 40).cast("int") % 12, F.lit(0)))
    zeros = F.array_repeat(F.lit(0), 64)
    lines = _table(spark, sf, "embeddings").where("embedding is not null").groupBy("vec_id").agg(F.max("embedding").alias("embedding")).select("vec_id", classes.alias("c"))
    line = F.struct((F.col("vec_id") % 256).cast("int").alias("line"), F.slice(F.concat("c", zeros), 1, 64).alias("c"))
    held = lines.groupBy(F.floor(F.col("vec_id") / 256).alias("k")).agg(F.map_from_entries(F.collect_list(line)).alias("lines"))
    values = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.coalesce(F.col("lines")[k], zeros)))
    layout = (("epsg", 32633), ("left", 500000.0), ("top", 5000000.0), ("width", 64), ("height", 256), ("step", 20.0))
    folder = f"{shared_folder(spark)}/geotiff-{uuid.uuid4().hex}"
    geotiff.write_rasters(held.select(F.concat(F.lit("r"), F.col("k")).alias("name"), *[F.lit(v).alias(c) for c, v in layout], values.alias("classes")), folder)
    _, tiles, _ = geotiff.read_rasters(spark, folder, tile=64)
    weighted = F.aggregate(F.transform("classes", lambda c, k: c.cast("long") * (k + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return tiles.select("scene_id", "tile_number", weighted.alias("checksum"), F.size(F.filter("classes", lambda c: c != 0)).cast("long").alias("n_pixels")).where("checksum > 0")


@_query("run_histogram", f"WITH {PIXELS} SELECT scene_id, {COUNTS} FROM pix GROUP BY scene_id")
def run_histogram(spark, sf):
    """class_histogram on run-length codes, never unfolded."""
    classes = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 40).cast("int") % 12)
    runs = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("scene_id"), rasters.to_runs(classes).alias("runs"))
    return runs.select("scene_id", *[rasters.count_in_runs("runs", k).cast("long").alias(f"count_class_{k}") for k in composite.CLASSES])


@_query("class_histogram", f"WITH {PIXELS} SELECT aoi_id, scene_id, {COUNTS}, count(*) AS n_pixels FROM pix GROUP BY aoi_id, scene_id")
def class_histogram(spark, sf):
    return composite.class_histogram(pixels(spark, sf), ("aoi_id", "scene_id"))


def _share(*classes: int) -> str:
    return f"({' + '.join(f'count_class_{k}' for k in classes)})::DOUBLE / n_pixels"


@_query(
    "class_fractions",
    f"WITH {PIXELS}, {COMPOSITE}, h AS (SELECT aoi_id, datatake_id, {COUNTS}, count(*) AS n_pixels FROM filled GROUP BY aoi_id, datatake_id) "
    f"SELECT *, (n_pixels - count_class_0)::DOUBLE / n_pixels AS covered_fraction, {_share(4, 5, 6)} AS clear_fraction, {_share(8, 9, 10)} AS cloud_fraction, {_share(2, 3)} AS shadow_fraction, {_share(11)} AS snow_fraction, {_share(7)} AS unclassified_fraction, {_share(1)} AS defective_fraction FROM h",
)
def class_fractions(spark, sf):
    return composite.fractions(composite.class_histogram(composite.pixel_composite(pixels(spark, sf)), ("aoi_id", "datatake_id")))


@_query(
    "observation_rollup",
    f"""WITH {SCENES}, g AS (SELECT aoi_id, mgrs_tile AS datatake_id, min(datetime) AS observed_at, count(*) AS n_scenes, bool_and(read_ok) AS complete,
    round(sum(eo_cloud_cover * n_covered) FILTER (WHERE eo_cloud_cover IS NOT NULL AND n_covered > 0) / nullif(sum(n_covered) FILTER (WHERE eo_cloud_cover IS NOT NULL AND n_covered > 0), 0), 6) AS catalog_cloud_cover_wmean FROM scenes GROUP BY 1, 2),
  p AS (SELECT aoi_id, mgrs_tile, scene_id, eo_cloud_cover, row_number() OVER (PARTITION BY aoi_id, mgrs_tile ORDER BY n_covered DESC, scene_id) AS r FROM scenes),
  f AS (SELECT aoi_id, mgrs_tile, platform, row_number() OVER (PARTITION BY aoi_id, mgrs_tile ORDER BY scene_id) AS r FROM scenes WHERE platform IS NOT NULL),
  q AS (SELECT aoi_id, mgrs_tile, relative_orbit, row_number() OVER (PARTITION BY aoi_id, mgrs_tile ORDER BY scene_id) AS r FROM scenes)
  SELECT g.aoi_id, g.datatake_id, observed_at, f.platform, q.relative_orbit, n_scenes, p.scene_id AS primary_scene_id, p.eo_cloud_cover AS catalog_cloud_cover, catalog_cloud_cover_wmean, complete
  FROM g JOIN p ON p.aoi_id = g.aoi_id AND p.mgrs_tile = g.datatake_id AND p.r = 1 LEFT JOIN f ON f.aoi_id = g.aoi_id AND f.mgrs_tile = g.datatake_id AND f.r = 1 JOIN q ON q.aoi_id = g.aoi_id AND q.mgrs_tile = g.datatake_id AND q.r = 1""",
)
def observation_rollup(spark, sf):
    rows = scenes(spark, sf).withColumn("datatake_id", F.col("mgrs_tile"))
    return composite.roll_up(rows).withColumn("catalog_cloud_cover_wmean", F.round("catalog_cloud_cover_wmean", 6))


@_query("dq_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique(spark, sf):
    return quality.unique(_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("dq_range", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < 0.02::DOUBLE OR l_discount > 0.09::DOUBLE")
def dq_range(spark, sf):
    return quality.in_range(_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", 0.02, 0.09)


@_query("dq_not_null", f"WITH {SCENES} SELECT scene_id, datatake_id FROM scenes WHERE datatake_id IS NULL OR sequence IS NULL")
def dq_not_null(spark, sf):
    return quality.not_null(scenes(spark, sf).select("scene_id", "datatake_id", "sequence"), ["datatake_id", "sequence"]).select("scene_id", "datatake_id")


@_query("dq_accepted", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def dq_accepted(spark, sf):
    return quality.accepted(_table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["click", "view"])


@_query("dq_domain", f"WITH {OBS}, {WAITS}, {MONTHS} SELECT 'aoi_monthly.month' AS rule, aoi_id FROM months WHERE month <> 5 GROUP BY aoi_id HAVING count(*) <> 12")
def dq_domain(spark, sf):
    tables = {
        "aoi_monthly": monthly_reliability(spark, sf).where("month != 5"), "aoi_survival": survival_curve(spark, sf), "catalog_filter_eval": catalog_filter_eval(spark, sf),
    }
    return quality.domains(tables, CONFIG, entities(spark, sf).count())


@_query(
    "dq_row_rules",
    """SELECT unnest(['discount', 'quantity', 'flag']) AS rule, unnest([count(*) FILTER (WHERE NOT (l_discount BETWEEN 0.02::DOUBLE AND 0.09::DOUBLE)), count(*) FILTER (WHERE NOT l_quantity <= 45),
    count(*) FILTER (WHERE l_returnflag NOT IN ('N', 'R'))]) AS broken FROM lineitem""",
)
def dq_row_rules(spark, sf):
    """Several rules on rows, compiled into one pass."""
    rules = {"discount": F.col("l_discount").between(0.02, 0.09), "quantity": F.col("l_quantity") <= 45, "flag": F.col("l_returnflag").isin("N", "R")}
    return quality.row_rules(_table(spark, sf, "lineitem"), rules)


@_query("config_scope", f"WITH {OBS} SELECT obs.aoi_id, datatake_id, observed_at FROM obs JOIN (VALUES ('u1'), ('u2'), ('u3')) v(aoi_id) ON v.aoi_id = obs.aoi_id")
def config_scope(spark, sf):
    chosen = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "aoi_id string")
    return observations(spark, sf).join(F.broadcast(chosen), "aoi_id").select("aoi_id", "datatake_id", "observed_at")  # a list from the settings


def _sql(table: str):
    def run(spark, sf):
        obs = observations(spark, sf).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
        return sql_tables.sql_table(spark, table, obs, entities(spark, sf), CONFIG, WITHIN)

    return run


for _name, _rows in (("aoi_wait_daily", "waits"), ("aoi_gaps", "gaps"), ("aoi_survival", "curve"), ("aoi_monthly", "months"), ("catalog_filter_eval", "evaluated"), ("aoi_summary", "summary")):
    QUERIES[f"sql_{_name}"] = _sql(_name)
    ORACLE_SQL[f"sql_{_name}"] = f"{ALL} SELECT * FROM {_rows}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(next usable event within 7 days) per entity, from raw events."""
    return within_n(spark, sf_dir)
