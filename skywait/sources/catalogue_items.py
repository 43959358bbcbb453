"""Catalogue items (nested JSON) and entity files (CSV, GeoJSON) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.columns import relative_orbit, strip_prefix, utm_epsg

_TEXT = ("platform", "grid:code", "s2:processing_baseline", "s2:product_uri", "s2:generation_time", "s2:datatake_id", "datetime", "s2:sequence", "proj:code")
_NUMBER = (
    "eo:cloud_cover", "s2:nodata_pixel_percentage", "s2:cloud_shadow_percentage", "s2:unclassified_percentage", "s2:medium_proba_clouds_percentage",
    "s2:high_proba_clouds_percentage", "s2:thin_cirrus_percentage", "s2:snow_ice_percentage",
)
_PROPERTIES = ", ".join([f"`{p}`: string" for p in (*_TEXT, "proj:epsg")] + [f"`{p}`: double" for p in _NUMBER])
ITEM = (
    f"struct<id: string, collection: string, geometry: struct<type: string, coordinates: string>, properties: struct<{_PROPERTIES}>, "
    "assets: struct<scl: struct<href: string>, visual: struct<href: string>>>"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The features of FeatureCollection files, one row each; entries that are no objects are skipped.

    page and place tell the order in which they came.
    """
    raw = spark.read.schema("type string, features array<string>").json(path, multiLine=True)
    if not raw.where("features is null").isEmpty():
        raise DataError("a file has no list of features")
    items = raw.select(F.input_file_name().alias("page"), F.posexplode("features").alias("place", "text")).where(F.col("text").startswith("{"))
    return parsed(items, "text")


def parsed(rows: DataFrame, text: str) -> DataFrame:
    """rows of item texts with the items' fields and geometry_json in the text's place."""
    others = [c for c in rows.columns if c not in (text, "id")]
    read = rows.select(*others, F.from_json(text, ITEM).alias("_item"), F.get_json_object(text, "$.geometry").alias("geometry_json"))
    return read.select("_item.*", "geometry_json", *others)


def scene_rows(items: DataFrame, ingested_at: Column) -> DataFrame:
    """Scene table rows: missing properties stay null."""

    def p(name: str) -> Column:
        return F.col(f"properties.`{name}`")

    epsg = F.coalesce(p("proj:epsg").try_cast("bigint"), strip_prefix(p("proj:code"), "EPSG:").try_cast("bigint"))
    return items.select(
        F.col("id").alias("scene_id"), "collection", p("datetime").try_cast("timestamp").alias("datetime"), p("platform").alias("platform"),
        F.coalesce(relative_orbit(p("s2:product_uri")), relative_orbit(p("s2:datatake_id"))).alias("relative_orbit"),
        strip_prefix(p("grid:code"), "MGRS-").alias("mgrs_tile"), p("s2:datatake_id").alias("datatake_id"), epsg.alias("epsg"),
        p("eo:cloud_cover").alias("eo_cloud_cover"), p("s2:nodata_pixel_percentage").alias("nodata_pct"), p("s2:cloud_shadow_percentage").alias("cloud_shadow_pct"),
        p("s2:unclassified_percentage").alias("unclassified_pct"), p("s2:medium_proba_clouds_percentage").alias("medium_cloud_pct"),
        p("s2:high_proba_clouds_percentage").alias("high_cloud_pct"), p("s2:thin_cirrus_percentage").alias("thin_cirrus_pct"), p("s2:snow_ice_percentage").alias("snow_ice_pct"),
        p("s2:processing_baseline").alias("processing_baseline"), p("s2:product_uri").alias("product_uri"),
        p("s2:generation_time").try_cast("timestamp").alias("generation_time"), p("s2:sequence").try_cast("bigint").alias("sequence"),
        F.col("assets.scl.href").alias("scl_href"), F.col("assets.visual.href").alias("visual_href"), F.col("geometry_json").alias("geometry"), ingested_at.alias("ingested_at"),
    )


def merge_pages(items: DataFrame) -> DataFrame:
    """One item an id; of equal ids the one that came last (or, if the order is not known, was generated last)."""
    others = [c for c in items.columns if c != "id"]
    come = [F.col(c) for c in ("page", "place") if c in others] or [F.col("properties.`s2:generation_time`")]
    last_first = Window.partitionBy("id").orderBy(*[c.desc() for c in come], F.xxhash64(F.to_json(F.struct(*others))))
    return items.withColumn("_place", F.row_number().over(last_first)).where("_place = 1").drop("_place")


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """aoi_id, name, country, lat, lon of a CSV file with a header, checked."""
    raw = spark.read.csv(path, header=True)
    if missing := [c for c in ("aoi_id", "name", "country", "lat", "lon") if c not in raw.columns]:
        raise DataError(f"the file lacks the columns {', '.join(missing)}")
    rows = raw.select("aoi_id", "name", "country", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    if rows.isEmpty():
        raise DataError("the file has no entities")
    if not rows.where("aoi_id is null or not aoi_id rlike '^[a-z0-9][a-z0-9-]*$'").isEmpty():
        raise DataError("an entity id may hold lower-case letters, digits and hyphens only")
    if not rows.groupBy("aoi_id").count().where("count > 1").isEmpty():
        raise DataError("an entity id occurs twice")
    return rows


def with_utm(places: DataFrame) -> DataFrame:
    zoned = places.withColumn("utm_epsg", utm_epsg(F.col("lat"), F.col("lon")))
    if not zoned.where("utm_epsg is null").isEmpty():
        raise DataError("a position lies outside of the UTM domain")
    return zoned


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON Features, one a file: aoi_id, name, country, lat, lon, utm_epsg, area_km2, ring."""
    shape = (
        "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, "
        "properties struct<aoi_id: string, name: string, country: string, lat: double, lon: double, utm_epsg: bigint, area_km2: double>"
    )
    rows = spark.read.schema(shape).json(path, multiLine=True)
    if not rows.where("coalesce(geometry.type, '') != 'Polygon'").isEmpty():
        raise DataError("only polygons can be entities")
    return rows.select("properties.*", F.col("geometry.coordinates")[0].alias("ring"))


def read_basemap(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry) texts of a map's FeatureCollection; anything else is an error."""
    raw = spark.read.schema("type string, features array<string>").json(path, multiLine=True)
    if not raw.where("coalesce(type, '') != 'FeatureCollection' or features is null").isEmpty():
        raise DataError(f"{path} is no FeatureCollection")
    each = raw.select(F.explode("features").alias("f"))
    return each.select(F.get_json_object("f", "$.properties").alias("properties"), F.get_json_object("f", "$.geometry").alias("geometry"))


def to_geojson(places: DataFrame) -> DataFrame:
    """(aoi_id, feature): a GeoJSON Feature text for each entity with a ring; keys in order."""
    geometry = F.struct(F.array("ring").alias("coordinates"), F.lit("Polygon").alias("type"))
    names = sorted(c for c in places.columns if c != "ring")
    feature = F.struct(geometry.alias("geometry"), F.struct(*names).alias("properties"), F.lit("Feature").alias("type"))
    return places.select("aoi_id", F.to_json(feature).alias("feature"))


def write_geojson(places: DataFrame, target: str) -> None:
    """A folder target/aoi_id=... with one Feature file for each entity."""
    rows = to_geojson(places).withColumnRenamed("feature", "value").repartition("aoi_id")
    rows.write.mode("overwrite").partitionBy("aoi_id").text(target)
