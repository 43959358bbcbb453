"""The metric tables: observations in, six tables out, one plan for all entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..errors import DataError
from ..functions.columns import safe_ratio
from ..operators import classifier, reliability, timelines
from ..operators.slices import heavy_groups
from ..schemas import require_columns, require_unique
from ..sources.shared import settle

OBSERVED = ("aoi_id", "datatake_id", "config_hash", "observed_at", "catalog_cloud_cover", "usable", "complete")


def scope(observations: DataFrame, cfg: Config) -> DataFrame:
    """The observations of these settings and entities; every entity must have some."""
    require_columns(observations, OBSERVED, "observations")
    mine = observations.where((F.col("config_hash") == cfg.config_hash) & F.col("aoi_id").isin(*cfg.aois))
    found = {r.aoi_id for r in mine.select("aoi_id").distinct().collect()}  # at most the configured entities
    if missing := [a for a in cfg.aois if a not in found]:
        raise DataError(f"no observations of {', '.join(missing)} under these settings")
    require_unique(mine, ("aoi_id", "datatake_id", "config_hash"), "observations")
    return mine


def entity_table(spark, cfg: Config) -> DataFrame:
    return spark.createDataFrame([(a,) for a in cfg.aois], "aoi_id string")


def summary(
    obs: DataFrame, entities: DataFrame, gap_rows: DataFrame, curve: DataFrame, months: DataFrame, table: DataFrame, horizon: int, days: Sequence[int] = reliability.WITHIN,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Headline figures, one row an entity; whatever has no rows is 0."""
    counts = obs.where("complete").groupBy("aoi_id").agg(F.count("*").alias("n_observations"), F.count_if("usable").alias("n_usable"))
    t20 = table.where("threshold = 20").select("aoi_id", F.col("precision").alias("catalog_filter_precision_t20"), F.col("recall").alias("catalog_filter_recall_t20"))
    stats = timelines.gap_statistics(gap_rows, heavy=heavy)
    out = entities.select("aoi_id")
    for block in (counts, stats, reliability.within(curve, horizon, days), reliability.best_and_worst(months), t20):
        out = out.join(block, "aoi_id", "left")
    out = out.withColumn("n_observations", F.coalesce("n_observations", F.lit(0))).withColumn("n_usable", F.coalesce("n_usable", F.lit(0)))
    doubles = [c for c, t in out.dtypes if t == "double"]
    out = out.na.fill(0.0, doubles).na.fill(0, ["n_outages_over_30d", "best_month", "worst_month"])
    rate = safe_ratio(F.col("n_usable"), F.col("n_observations")).alias("usable_rate")
    head = ["aoi_id", "n_observations", "n_usable"]
    return out.select(*head, rate, *[c for c in out.columns if c not in head])


def compute(obs: DataFrame, entities: DataFrame, cfg: Config, days: Sequence[int] = reliability.WITHIN) -> dict[str, DataFrame]:
    """The six tables without config_hash, from any observations and entities."""
    heavy = heavy_groups(obs, ("aoi_id",))
    wait_rows = settle(timelines.waits(obs, entities, cfg, heavy=heavy))  # three tables read them
    gap_rows = timelines.gaps(obs, heavy=heavy)
    curve = reliability.survival(wait_rows, entities, cfg.horizon_days)
    months = reliability.monthly(wait_rows, entities)
    table = classifier.confusion(obs.where("complete"), entities)
    return {
        "aoi_wait_daily": wait_rows, "aoi_survival": curve, "aoi_monthly": months, "aoi_gaps": gap_rows,
        "aoi_summary": summary(obs, entities, gap_rows, curve, months, table, cfg.horizon_days, days, heavy), "catalog_filter_eval": table,
    }


def build_metric_tables(observations: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    """Scope, check and compute; every table carries the settings' hash."""
    cfg.require_horizon()
    mine = settle(scope(observations, cfg).select(*OBSERVED))
    tables = compute(mine, entity_table(observations.sparkSession, cfg), cfg)
    return {k: t.select("aoi_id", F.lit(cfg.config_hash).alias("config_hash"), *[c for c in t.columns if c != "aoi_id"]) for k, t in tables.items()}


def query_sla(waits: DataFrame, cfg_hash: str, aoi_id: str, every: int, month: int | None = None) -> float:
    """P(wait < every) of one entity from a persisted wait table (the filters reach the scan)."""
    mine = waits.where((F.col("config_hash") == cfg_hash) & (F.col("aoi_id") == aoi_id)).select("aoi_id", "t0", "wait_days")
    row = reliability.service_level(mine, every, month).first()
    if row is None:
        raise DataError(f"no waits of {aoi_id} under these settings")
    return row.sla_success
