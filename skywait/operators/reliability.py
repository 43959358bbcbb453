"""Wait-time distributions: survival, within-N, service levels, months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError
from ..functions.columns import month_name, safe_ratio

WITHIN = (3, 5, 7, 14, 30)
MONTHLY = (5, 7, 14)


def _histogram(waits: DataFrame, by: Sequence[str], rounded) -> DataFrame:
    return waits.groupBy(*by, rounded.cast("int").alias("bin")).agg(F.count("*").alias("rows"))


def survival(waits: DataFrame, entities: DataFrame, horizon: int, by: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """S(n) = share of waits over n days, n = 0 .. horizon; entities without waits get 0.

    wait > n is ceil(wait) > n for whole n, so the waits shrink to a histogram first and
    the curve is a running sum of at most horizon + 1 bins.
    """
    bins = _histogram(waits, by, F.ceil("wait_days"))
    grid = entities.select(*by, F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("bin"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = F.coalesce("rows", F.lit(0))
    return grid.join(bins, [*by, "bin"], "left").select(
        *by, F.col("bin").alias("n_days"), safe_ratio(F.sum(rows).over(whole) - F.sum(rows).over(upto), F.sum(rows).over(whole)).alias("p_waiting")
    )


def within(curve: DataFrame, horizon: int, days: Sequence[int] = WITHIN, by: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """p_within_Nd = 1 - S(N) for each N; an N beyond the curve's horizon is an error."""
    if max(days) > horizon:
        raise ConfigError(f"P(within {max(days)} days) needs a horizon of as many days; the curve ends at {horizon}")
    return curve.groupBy(*by).agg(*[F.max(F.when(F.col("n_days") == n, 1.0 - F.col("p_waiting"))).alias(f"p_within_{n}d") for n in days])


def service_level(waits: DataFrame, window_days: int, month: int | None = None, by: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Share of start days whose wait is under window_days (strictly), in all or one month; 0 without days."""
    if window_days <= 0 or (month is not None and not 1 <= month <= 12):
        raise ConfigError("the window must be positive and the month in 1 .. 12")
    hit = F.col("wait_days") < window_days
    mine = F.lit(True) if month is None else F.month("t0") == month
    return waits.groupBy(*by).agg(safe_ratio(F.count_if(hit & mine), F.count_if(mine)).alias("sla_success"))


def service_curve(waits: DataFrame, entities: DataFrame, windows: int, by: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """service_level for W = 1 .. windows in one pass: wait < W is floor(wait) < W."""
    bins = _histogram(waits, by, F.least(F.floor("wait_days"), F.lit(windows)))
    grid = entities.select(*by, F.explode(F.sequence(F.lit(0), F.lit(windows))).alias("bin"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.coalesce("rows", F.lit(0))
    rated = grid.join(bins, [*by, "bin"], "left").select(
        *by, F.col("bin").alias("window_days"), safe_ratio(F.sum(rows).over(before), F.sum(rows).over(whole)).alias("success_rate")
    )
    return rated.where("window_days > 0")


def with_median(curve: DataFrame, label: str = "MEDIAN") -> DataFrame:
    """The curve and, under label, its median over entities."""
    middle = curve.groupBy("window_days").agg(F.median("success_rate").alias("success_rate"))
    return curve.unionByName(middle.withColumn("aoi_id", F.lit(label)))


def monthly(waits: DataFrame, entities: DataFrame, by: Sequence[str] = ("aoi_id",), days: Sequence[int] = MONTHLY) -> DataFrame:
    """Per month of the start day, the share of waits of at most N days; months without days are 0."""
    seen = waits.groupBy(*by, F.month("t0").alias("month")).agg(
        *[F.avg((F.col("wait_days") <= n).cast("double")).alias(f"p_within_{n}d") for n in days], F.count("*").alias("n_days")
    )
    grid = entities.select(*by, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return grid.join(seen, [*by, "month"], "left").na.fill(0.0, [f"p_within_{n}d" for n in days]).na.fill(0, ["n_days"])


def best_and_worst(months: DataFrame, by: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """The months of the highest and lowest p_within_7d among those with days; ties go to the earliest."""
    p, m = F.col("p_within_7d"), F.col("month")
    some = F.col("n_days") > 0
    return months.groupBy(*by).agg(
        F.coalesce(F.max_by(m, F.when(some, F.struct(p, -m))), F.lit(0)).alias("best_month"),
        F.coalesce(F.min_by(m, F.when(some, F.struct(p, m))), F.lit(0)).alias("worst_month"),
        F.coalesce(F.max(F.when(some, p)), F.lit(0.0)).alias("p_within_7d_best_month"),
        F.coalesce(F.min(F.when(some, p)), F.lit(0.0)).alias("p_within_7d_worst_month"),
    )


def seasonal(months: DataFrame, by: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """monthly() with month names; every entity must have the months 1 .. 12 once."""
    odd = months.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("month").alias("m")).where("n != 12 or m != 12")
    if not odd.isEmpty():
        raise DataError("an entity lacks a month or has one twice")
    return months.withColumn("month_name", month_name(F.col("month")))
