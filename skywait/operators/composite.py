"""Scene class rasters to observations: histograms, priority composites, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ClassGroups
from ..functions.columns import first_by, safe_ratio

CLASSES = range(12)


def class_histogram(pixels: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Pixels (.., class) -> count_class_0 .. 11 and n_pixels; a class beyond 11 is an error."""
    c = F.col("class")
    checked = pixels.withColumn("class", F.when(c.between(0, 11), c).otherwise(F.raise_error(F.lit("scene class outside 0 .. 11"))))
    return checked.groupBy(*by).agg(*[F.count_if(F.col("class") == k).alias(f"count_class_{k}") for k in CLASSES], F.count("*").alias("n_pixels"))


def pixel_composite(pixels: DataFrame, by: tuple[str, ...] = ("aoi_id", "datatake_id")) -> DataFrame:
    """Each pixel's first non-zero class, by nodata percentage (null last) and scene id; 0 without one.

    One aggregate with map-side combine; no sort and no window over the scenes.
    """
    rank = F.struct(F.coalesce("nodata_pct", F.lit(float("inf"))), F.col("scene_id"))
    first = F.min_by("class", F.when(F.col("class") != 0, rank))
    return pixels.groupBy(*by, "pixel").agg(F.coalesce(first, F.lit(0)).cast("int").alias("class"))


def array_composite(scenes: DataFrame, by: tuple[str, ...] = ("aoi_id", "datatake_id")) -> DataFrame:
    """pixel_composite for scenes with one array of classes each: rows stay whole, pixels are not exploded.

    A group holds the scenes of one datatake over one entity (a handful).
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("nodata_pct", F.lit(float("inf"))).alias("r"), F.col("scene_id").alias("s"), F.col("classes").alias("c"))))
    grouped = scenes.groupBy(*by).agg(F.transform(ordered, lambda x: x["c"]).alias("layers"))
    fill = F.reduce(
        F.slice("layers", 2, F.greatest(F.size("layers") - 1, F.lit(0))),
        F.element_at("layers", 1),
        lambda top, low: F.zip_with(top, low, lambda a, b: F.when(a == 0, b).otherwise(a)),
    )
    return grouped.select(*by, fill.alias("classes"))


def fractions(counts: DataFrame, groups: ClassGroups | None = None, total: str = "n_pixels") -> DataFrame:
    """Shares of each class group in all pixels of the entity; what is not covered is not clear."""
    groups = groups or ClassGroups()

    def share(classes):
        return safe_ratio(sum((F.col(f"count_class_{k}") for k in classes), F.lit(0)), F.col(total))

    named = {f"{g}_fraction": share(getattr(groups, g)) for g in ("clear", "cloud", "shadow", "snow", "unclassified", "defective")}
    covered = safe_ratio(F.col(total) - sum((F.col(f"count_class_{k}") for k in groups.nodata), F.lit(0)), F.col(total))
    return counts.withColumns({"covered_fraction": covered} | named)


def count_of(classes: str, k: int) -> Column:
    """How many entries of an array column are k."""
    return F.size(F.filter(classes, lambda c: c == k))


def scene_statistics(scenes: DataFrame, n_pixels: int | None = None) -> DataFrame:
    """One row a scene and entity from (.., classes, error): counts, n_covered, read_ok.

    A scene that could not be read counts all its pixels as nodata and keeps its error.
    """
    size = F.lit(n_pixels) if n_pixels is not None else F.size("classes")
    ok = F.col("error").isNull()
    counts = {f"count_class_{k}": F.when(ok, count_of("classes", k)).otherwise(size if k == 0 else F.lit(0)).cast("long") for k in CLASSES}
    return (
        scenes.withColumn("n_aoi_pixels", size.cast("long")).withColumns(counts)
        .withColumn("n_covered", F.col("n_aoi_pixels") - F.col("count_class_0")).withColumn("read_ok", ok).drop("classes")
    )


def roll_up(scene_rows: DataFrame, by: tuple[str, ...] = ("aoi_id", "datatake_id")) -> DataFrame:
    """Scenes of a datatake -> one observation's metadata.

    Earliest time, first non-null platform and orbit by scene id, the primary scene (most
    covered pixels, then the smallest id) and its cloud cover, the cover-weighted mean
    cloud cover (null without weights), and complete if every scene was read.
    """
    weight = F.when(F.col("eo_cloud_cover").isNotNull() & (F.col("n_covered") > 0), F.col("n_covered"))
    primary = F.struct(-F.col("n_covered"), F.col("scene_id"))
    return scene_rows.groupBy(*by).agg(
        F.min("datetime").alias("observed_at"),
        first_by(F.col("platform"), F.col("scene_id")).alias("platform"),
        first_by(F.col("relative_orbit"), F.col("scene_id")).alias("relative_orbit"),
        F.count("*").alias("n_scenes"),
        F.min_by("scene_id", primary).alias("primary_scene_id"),
        F.min_by("eo_cloud_cover", primary).alias("catalog_cloud_cover"),
        F.try_divide(F.sum(F.col("eo_cloud_cover") * weight), F.sum(weight)).alias("catalog_cloud_cover_wmean"),
        F.bool_and("read_ok").alias("complete"),
    )
