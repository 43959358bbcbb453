"""Declared schemas and primary keys of all tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .errors import DataError

_COUNTS = ", ".join(f"count_class_{k} long" for k in range(12))

# Table and column names, types and keys that other tools read.
SCHEMAS = {
    "aois": "aoi_id string, name string, country string, lat double, lon double, utm_epsg long, area_km2 double, geometry binary",
    "scenes": (
        "scene_id string, collection string, datetime timestamp, platform string, relative_orbit long, mgrs_tile string, "
        "datatake_id string, epsg long, eo_cloud_cover double, nodata_pct double, cloud_shadow_pct double, unclassified_pct double, "
        "medium_cloud_pct double, high_cloud_pct double, thin_cirrus_pct double, snow_ice_pct double, processing_baseline string, "
        "product_uri string, generation_time timestamp, sequence long, scl_href string, visual_href string, geometry string, ingested_at timestamp"
    ),
    "scenes_superseded": "scene_id string, superseded_by string",
    "scene_aoi": "aoi_id string, scene_id string, footprint_overlap_fraction double",
    "ingest_state": "aoi_id string, collection string, watermark timestamp, last_run_at timestamp",
    "scene_aoi_stats": f"aoi_id string, scene_id string, config_hash string, n_aoi_pixels long, n_covered long, {_COUNTS}, read_ok boolean, error string, processed_at timestamp",
    "observations": (
        "aoi_id string, datatake_id string, config_hash string, observed_at timestamp, platform string, relative_orbit long, n_scenes long, "
        "primary_scene_id string, catalog_cloud_cover double, catalog_cloud_cover_wmean double, n_aoi_pixels long, covered_fraction double, "
        "clear_fraction double, cloud_fraction double, shadow_fraction double, snow_fraction double, unclassified_fraction double, "
        "defective_fraction double, usable boolean, complete boolean"
    ),
    "composites": "aoi_id string, datatake_id string, config_hash string, runs array<struct<value:int,count:int>>",
    "aoi_wait_daily": "aoi_id string, config_hash string, t0 timestamp, wait_days double, censored boolean",
    "aoi_survival": "aoi_id string, config_hash string, n_days int, p_waiting double",
    "aoi_monthly": "aoi_id string, config_hash string, month int, p_within_5d double, p_within_7d double, p_within_14d double, n_days long",
    "aoi_gaps": "aoi_id string, config_hash string, kind string, gap_start timestamp, gap_end timestamp, gap_days double",
}

KEYS = {
    "aois": ["aoi_id"],
    "scenes": ["scene_id"],
    "scenes_superseded": ["scene_id"],
    "scene_aoi": ["aoi_id", "scene_id"],
    "ingest_state": ["aoi_id", "collection"],
    "scene_aoi_stats": ["aoi_id", "scene_id", "config_hash"],
    "observations": ["aoi_id", "datatake_id", "config_hash"],
    "composites": ["aoi_id", "datatake_id", "config_hash"],
    "aoi_wait_daily": ["aoi_id", "config_hash", "t0"],
    "aoi_survival": ["aoi_id", "config_hash", "n_days"],
    "aoi_monthly": ["aoi_id", "config_hash", "month"],
    "aoi_gaps": ["aoi_id", "config_hash", "kind", "gap_start", "gap_end"],
    "aoi_summary": ["aoi_id", "config_hash"],
    "catalog_filter_eval": ["aoi_id", "config_hash", "threshold"],
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def require_columns(df: DataFrame, names: Sequence[str], what: str = "input") -> None:
    if missing := [c for c in names if c not in df.columns]:
        raise DataError(f"{what} lacks the columns {', '.join(missing)}")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "input") -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise DataError(f"{what} holds a key ({', '.join(keys)}) twice")
