"""Declarative data checks: each returns the rows that break it; none means it holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import Config
from .errors import DataError
from .operators.classifier import POOL


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(F.greatest(F.lit(False), *[F.col(c).isNull() for c in columns]))


def in_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Nulls pass."""
    c, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return df.where(bad)


def accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Nulls pass."""
    return df.where(~F.col(column).isin(*values))


def domains(tables: dict[str, DataFrame], cfg: Config, entities: int | None = None) -> DataFrame:
    """(rule, aoi_id): months 1..12, horizon + 1 survival rows, 21 thresholds and an 'ALL' scope.

    entities is how many there should be (by default those of the settings).
    """
    scopes_due = (len(cfg.aois) if entities is None else entities) + 1

    def shape(name: str, column: str, count: int, low: int, high: int) -> DataFrame:
        c = F.col(column)
        got = tables[name].groupBy("aoi_id").agg(F.count("*").alias("n"), F.count_distinct(c).alias("d"), F.min(c).alias("lo"), F.max(c).alias("hi"))
        return got.where((F.col("n") != count) | (F.col("d") != count) | (F.col("lo") != low) | (F.col("hi") != high)).select(F.lit(f"{name}.{column}").alias("rule"), "aoi_id")

    scopes = tables["catalog_filter_eval"].select("aoi_id").distinct()
    wrong = scopes.agg(F.count("*").alias("n"), F.count_if(F.col("aoi_id") == POOL).alias("a")).where((F.col("n") != scopes_due) | (F.col("a") != 1))
    return (
        shape("aoi_monthly", "month", 12, 1, 12).unionByName(shape("aoi_survival", "n_days", cfg.horizon_days + 1, 0, cfg.horizon_days))
        .unionByName(shape("catalog_filter_eval", "threshold", 21, 0, 100)).unionByName(wrong.select(F.lit("scopes").alias("rule"), F.lit(POOL).alias("aoi_id")))
    )


def wait_rows(waits: DataFrame, cfg: Config) -> DataFrame:
    """Entities without exactly one wait a start day, or with rows of other settings."""
    got = waits.groupBy("aoi_id").agg(F.count("*").alias("n"), F.count_if(F.col("config_hash") != cfg.config_hash).alias("other"))
    return got.where((F.col("n") != cfg.n_start_days) | (F.col("other") > 0))


def complete_only(observations: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Entities whose summary or confusion counts differ from their complete observations."""
    n = observations.groupBy("aoi_id").agg(F.count_if("complete").alias("complete_rows"))
    cells = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    table = tables["catalog_filter_eval"].where(F.col("aoi_id") != POOL).select("aoi_id", cells.alias("cells"))
    both = n.join(tables["aoi_summary"].select("aoi_id", "n_observations"), "aoi_id").join(table, "aoi_id")
    return both.where("complete_rows != n_observations or complete_rows != cells").distinct()


def invariants(observations: DataFrame) -> DataFrame:
    return observations.where("covered_fraction > 1 or clear_fraction > covered_fraction or n_scenes < 1")


def row_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, broken): how many rows break each rule (a condition that holds where it is true or null), in one pass over df."""
    counted = df.agg(*[F.count_if(~rule).alias(f"r{k}") for k, rule in enumerate(rules.values())])
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{k}").alias("broken")) for k, name in enumerate(rules)])
    return counted.select(F.inline(each))


def enforce(checks: Mapping[str, DataFrame]) -> None:
    """Raise with the names of the checks that have rows; all are looked at in one job."""
    if not checks:
        return
    found = [rows.limit(1).select(F.lit(name).alias("name")) for name, rows in checks.items()]
    broken = {r.name for r in reduce(DataFrame.unionByName, found).collect()}  # a name a check
    if broken:
        raise DataError(f"data checks failed: {', '.join(n for n in checks if n in broken)}")
