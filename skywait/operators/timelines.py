"""Timelines: inter-event gaps, forward waits and long outages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import days_between, is_usable, status
from .slices import SLICE_ROWS, UNKNOWN, exact_quantiles, heavy_groups, previous, upcoming

OUTAGE_DAYS = 30


def in_period(obs: DataFrame, cfg: Config) -> DataFrame:
    """Closed dates as half-open instants; both comparisons reach the Parquet scan."""
    at = F.col("observed_at")
    kind = obs.schema["observed_at"].dataType
    first, after = F.lit(cfg.start).cast(kind), (F.date_add(F.lit(cfg.end), 1)).cast(kind)
    return obs.where((at >= first) & (at < after))


def derive_usable(obs: DataFrame, min_coverage, min_clear) -> DataFrame:
    """Overwrite usable from the fractions; incomplete rows are never usable."""
    return obs.withColumn("usable", F.col("complete") & is_usable(F.col("covered_fraction"), F.col("clear_fraction"), min_coverage, min_clear))


def with_status(obs: DataFrame) -> DataFrame:
    return obs.withColumn("status", status(F.col("complete"), F.col("usable")))


def gaps(obs: DataFrame, by: tuple[str, ...] = ("aoi_id",), slice_rows: int = SLICE_ROWS, heavy: DataFrame | None | object = UNKNOWN) -> DataFrame:
    """Gaps between neighbours of the nominal (complete) and effective (usable too) timelines.

    Both timelines come from one pass: a row belongs to one or two of them, and one
    exchange on (by, kind) serves the window. A timeline that is too long for a task is
    solved in slices of its time. heavy: heavy_groups(obs, by, slice_rows), if at hand.
    """
    if heavy is UNKNOWN:
        heavy = heavy_groups(obs, by, slice_rows)  # a count over all rows reads the keys alone
    kinds = F.when(F.col("usable"), F.array(F.lit("nominal"), F.lit("effective"))).otherwise(F.array(F.lit("nominal")))
    line = obs.where("complete").select(*by, "observed_at", "datatake_id", F.explode(kinds).alias("kind"))
    if heavy is not None:
        heavy = heavy.select(*by, F.explode(F.array(F.lit("nominal"), F.lit("effective"))).alias("kind"))
    return (
        previous(line, (*by, "kind"), "observed_at", ("datatake_id",), "gap_start", heavy, slice_rows).where("gap_start is not null")
        .select(*by, "kind", "gap_start", F.col("observed_at").alias("gap_end"), days_between(F.col("gap_start"), F.col("observed_at")).alias("gap_days"))
    )


def gap_statistics(gap_rows: DataFrame, by: tuple[str, ...] = ("aoi_id",), heavy: DataFrame | None = None) -> DataFrame:
    """Exact median, 90th percentile, maximum and outage count; an empty population gives 0.

    heavy names groups whose gaps no task should hold: their quantiles are found by
    histograms, to the same values.
    """
    days, eff = F.col("gap_days"), F.col("kind") == "effective"

    def of(condition: Column) -> Column:
        return F.when(condition, days)

    rest = [F.coalesce(F.max(of(eff)), F.lit(0.0)).alias("longest_outage_days"), F.count_if(eff & (days > OUTAGE_DAYS)).alias("n_outages_over_30d")]
    light = gap_rows if heavy is None else gap_rows.join(F.broadcast(heavy), list(by), "left_anti")  # few rows: see heavy_groups
    out = light.groupBy(*by).agg(
        F.coalesce(F.median(of(F.col("kind") == "nominal")), F.lit(0.0)).alias("nominal_median_gap_days"),
        F.coalesce(F.median(of(eff)), F.lit(0.0)).alias("effective_median_gap_days"),
        F.coalesce(F.percentile(of(eff), F.lit(0.9)), F.lit(0.0)).alias("effective_p90_gap_days"),
        *rest,
    )
    if heavy is None:
        return out
    mine = gap_rows.join(F.broadcast(heavy), list(by), "left_semi")
    found = exact_quantiles(mine, (*by, "kind"), "gap_days", {"median": 0.5, "p90": 0.9})
    shown = found.groupBy(*by).agg(
        *[F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0.0)).alias(f"{kind}_{c}_gap_days") for kind, c in (("nominal", "median"), ("effective", "median"), ("effective", "p90"))]
    )
    return out.unionByName(mine.groupBy(*by).agg(*rest).join(shown, list(by)))


def long_outages(gap_rows: DataFrame, days: float = OUTAGE_DAYS) -> DataFrame:
    return gap_rows.where((F.col("kind") == "effective") & (F.col("gap_days") > days)).drop("kind")


def start_days(entities: DataFrame, cfg: Config, kind: str = "timestamp") -> DataFrame:
    """Each entity's daily grid of start instants: start .. end - horizon, both included."""
    cfg.require_horizon()
    last = F.date_sub(F.lit(cfg.end), cfg.horizon_days)
    days = entities.select("*", F.explode(F.sequence(F.lit(cfg.start), last)).alias("t0"))
    return days.withColumn("t0", F.col("t0").cast(kind))


def waits(obs: DataFrame, entities: DataFrame, cfg: Config, by: tuple[str, ...] = ("aoi_id",), slice_rows: int = SLICE_ROWS, heavy: DataFrame | None | object = UNKNOWN) -> DataFrame:
    """Days from each start instant to the first usable event at or after it.

    A forward as-of join as one union and one window over start rows and events (an event at
    the same instant counts); timelines too long for a task go in slices of their time. Waits
    over the horizon, or without an event, are censored at it. heavy: heavy_groups(obs, by,
    slice_rows), if at hand.
    """
    if heavy is UNKNOWN:
        heavy = heavy_groups(obs, by, slice_rows)
    kind = obs.schema["observed_at"].dataType.simpleString()
    starts = start_days(entities.select(*by), cfg, kind).select(*by, F.col("t0").alias("at"), F.lit(0).alias("is_event"), F.lit(None).cast(kind).alias("event"))
    events = obs.where("complete and usable").select(*by, F.col("observed_at").alias("at"), F.lit(1).alias("is_event"), F.col("observed_at").alias("event"))
    ahead = upcoming(starts.unionByName(events), by, heavy, slice_rows).where("is_event = 0")
    wait = days_between(F.col("at"), F.col("next"))
    late = wait.isNull() | (wait > cfg.horizon_days)
    horizon = F.lit(float(cfg.horizon_days))
    return ahead.select(*by, F.col("at").alias("t0"), F.when(late, horizon).otherwise(wait).alias("wait_days"), late.alias("censored"))


def timeline(obs: DataFrame, by: tuple[str, ...] = ("aoi_id",), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Events with status and, on usable ones, the gap since the usable event before and if it was an outage."""
    heavy = heavy_groups(obs, by, slice_rows)
    if heavy is not None:
        heavy = heavy.select(*by, F.explode(F.array(*[F.lit(s) for s in ("usable", "unusable", "incomplete")])).alias("status"))
    line = previous(with_status(obs), (*by, "status"), "observed_at", ("datatake_id",), "_before", heavy, slice_rows)
    gap = F.when(F.col("status") == "usable", days_between(F.col("_before"), F.col("observed_at")))
    return line.withColumn("gap_days", gap).withColumn("outage", F.coalesce(F.col("gap_days") > OUTAGE_DAYS, F.lit(False))).drop("_before")
