"""How well a metadata threshold predicts measured usability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.columns import at_most, safe_ratio

THRESHOLDS = tuple(range(0, 101, 5))
POOL = "ALL"


def rates() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": safe_ratio(2.0 * precision * recall, precision + recall),
        "kept_unusable_rate": safe_ratio(fp, tp + fp),
        "discarded_usable_rate": safe_ratio(fn, tp + fn),
    }


def confusion(rows: DataFrame, scopes: DataFrame, value: str = "catalog_cloud_cover", truth: str = "usable", thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """tp, fp, fn, tn and rates per scope and threshold, for each entity and for the pool 'ALL'.

    rows are reduced to counts per (entity, truth, first threshold that predicts usable)
    before thresholds unfold, so the data shuffle once as a small histogram; the pool
    is a grouping set over the counts. Scopes without rows get zeros; a null value predicts unusable.
    """
    never = len(thresholds)
    first = F.lit(never)
    for k in reversed(range(never)):
        first = F.when(at_most(F.col(value), thresholds[k]), k).otherwise(first)
    counts = rows.groupBy("aoi_id", F.col(truth).alias("truth"), first.alias("first")).agg(F.count("*").alias("n"))
    sums = counts.groupingSets([["aoi_id", "truth", "first"], ["truth", "first"]], "aoi_id", "truth", "first").agg(
        F.sum("n").alias("n"), F.grouping("aoi_id").alias("pooled")
    )
    each = sums.select(
        F.when(F.col("pooled") == 1, F.lit(POOL)).otherwise(F.col("aoi_id")).alias("aoi_id"), "truth", "n",
        F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("first") <= k).alias("predicted")) for k, t in enumerate(thresholds)])).alias("at"),
    )
    p, t, n = F.col("at.predicted"), F.col("truth"), F.col("n")
    table = each.groupBy("aoi_id", F.col("at.threshold").alias("threshold")).agg(
        F.sum(F.when(p & t, n).otherwise(0)).alias("tp"), F.sum(F.when(p & ~t, n).otherwise(0)).alias("fp"),
        F.sum(F.when(~p & t, n).otherwise(0)).alias("fn"), F.sum(F.when(~p & ~t, n).otherwise(0)).alias("tn"),
    )
    spark = rows.sparkSession
    names = scopes.select("aoi_id").unionByName(spark.createDataFrame([(POOL,)], "aoi_id string"))
    grid = names.select("aoi_id", F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    return grid.join(table, ["aoi_id", "threshold"], "left").na.fill(0, ["tp", "fp", "fn", "tn"]).withColumns(rates())


def pooled_at(table: DataFrame, threshold: int) -> DataFrame:
    """The pool's row at one of the table's thresholds."""
    if threshold not in THRESHOLDS:
        raise ConfigError("the threshold must be a multiple of 5 in 0 .. 100")
    return table.where((F.col("aoi_id") == POOL) & (F.col("threshold") == threshold))


def extreme_examples(obs: DataFrame, threshold: float = 20.0) -> DataFrame:
    """The worst disagreements either way: metadata clear but measured cloudy, and the reverse."""
    complete, c = obs.where("complete"), F.col("catalog_cloud_cover")
    clear_but = complete.where(at_most(c, threshold) & ~F.col("usable")).orderBy(F.desc_nulls_last("cloud_fraction"), F.asc_nulls_last("clear_fraction"), "catalog_cloud_cover", "aoi_id", "datatake_id").limit(1)
    cloudy_but = complete.where((c > threshold) & F.col("usable")).orderBy(F.desc("catalog_cloud_cover"), F.desc_nulls_last("clear_fraction"), "aoi_id", "datatake_id").limit(1)
    return clear_but.select(F.lit("catalog-clear_aoi-cloudy").alias("case"), "*").unionByName(cloudy_but.select(F.lit("catalog-cloudy_aoi-clear").alias("case"), "*"))
