"""Windows and quantiles over groups too large for one task.

A group of over twice `most` rows is cut into slices of its time. Slices are solved alone; what
a slice needs from its neighbours comes from a window over one row a slice. Quantiles of
such groups are found by histograms that close in on a rank. Smaller groups are left whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, settle

#: Rows that one task orders at a time, about.
SLICE_ROWS = 1_000_000
_WHOLE = ""
#: For callers that leave it to the operator to find the heavy groups.
UNKNOWN = object()


def heavy_groups(rows: DataFrame, by: Sequence[str], most: int = SLICE_ROWS) -> DataFrame | None:
    """The groups of over twice `most` rows (at most one for so many rows of the table), or None without any."""
    if rows.count() <= 2 * most:  # no group has more rows than the table; this count reads no column
        return None
    heavy = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * most).select(*by)
    return settle(heavy) if heavy.count() else None


def sliced(rows: DataFrame, by: Sequence[str], at: str, tie: Sequence[str], heavy: DataFrame, most: int = SLICE_ROWS) -> DataFrame:
    """rows with _slice: '' in groups that are not heavy, else a name of a stretch of the group's time.

    Stretches are equal cuts of a slice's span, cut again while one holds over twice `most`
    rows. Rows of a single instant are dealt by a hash of tie.
    """
    rows, key = rows.withColumn("_slice", F.lit(_WHOLE)), [*by, "_slice"]
    rank = F.col(at)
    while True:
        mine = rows.join(F.broadcast(heavy), list(by), "left_semi")  # few rows: see heavy_groups
        sizes = mine.groupBy(*key).agg(F.count("*").alias("_n"), F.min(rank).alias("_low"), F.max(rank).alias("_high"))
        large = settle(sizes.where((F.col("_n") > 2 * most) & ~F.contains("_slice", F.lit("#"))))
        if large.isEmpty():
            return rows
        parts = F.ceil(2 * F.col("_n") / most)
        span = F.timestamp_diff("MICROSECOND", F.col("_low"), F.col("_high"))
        cuts = large.select(*key, parts.alias("_parts"), "_low", span.alias("_span"), (F.floor(span / parts) + 1).alias("_width"))
        cell = F.coalesce(F.floor(F.timestamp_diff("MICROSECOND", F.col("_low"), rank) / F.col("_width")), F.lit(0))
        name = F.when(F.col("_span") > 0, F.concat(F.lit("/"), cell.cast("string"))).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64(*tie), "_parts").cast("string")))
        rows = rows.join(F.broadcast(cuts), key, "left").withColumn("_slice", F.concat("_slice", F.coalesce(name, F.lit("")))).drop("_parts", "_low", "_span", "_width")


def previous(rows: DataFrame, by: Sequence[str], at: str, tie: Sequence[str], name: str, heavy: DataFrame | None, most: int = SLICE_ROWS) -> DataFrame:
    """rows with name: `at` of the row before, in the order of (at, tie) within the group."""
    if heavy is None:
        return rows.withColumn(name, F.lag(at).over(Window.partitionBy(*by).orderBy(at, *tie)))
    cut = sliced(rows, by, at, tie, heavy, most)
    edges = cut.where(F.col("_slice") != _WHOLE).groupBy(*by, "_slice").agg(F.min(F.struct(at, *tie)).alias("_first"), F.max(at).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*by).orderBy("_first"))
    carried = settle(edges.select(*by, "_slice", before.alias("_carried")))
    inside = F.lag(at).over(Window.partitionBy(*by, "_slice").orderBy(at, *tie))
    return cut.withColumn(name, inside).join(carried, [*by, "_slice"], "left").withColumn(name, F.coalesce(name, "_carried")).select(*rows.columns, name)


def upcoming(points: DataFrame, by: Sequence[str], heavy: DataFrame | None, most: int = SLICE_ROWS) -> DataFrame:
    """points (by, at, is_event, event) with next: the first event at or after each point.

    Points are ordered backwards in time and each takes the last event seen; events come
    before other points of their instant. The frame only grows, so a slice costs its size.
    """
    back = [F.desc("at"), F.desc("is_event")]

    def seen(*group: str) -> Column:
        return F.last("event", ignorenulls=True).over(Window.partitionBy(*group).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0))

    if heavy is None:
        return points.withColumn("next", seen(*by))
    cut = sliced(points.distinct(), by, "at", ("is_event",), heavy, most)  # one event an instant is enough
    edges = cut.where(F.col("_slice") != _WHOLE).groupBy(*by, "_slice").agg(F.min("event").alias("_event"), F.min("at").alias("_low"))
    later = Window.partitionBy(*by).orderBy(F.desc("_low")).rowsBetween(Window.unboundedPreceding, -1)
    carried = settle(edges.select(*by, "_slice", F.last("_event", ignorenulls=True).over(later).alias("_after")))
    return cut.withColumn("next", seen(*by, "_slice")).join(carried, [*by, "_slice"], "left").withColumn("next", F.coalesce("next", "_after")).select(*points.columns, "next")


def exact_quantiles(rows: DataFrame, key: Sequence[str], value: str, shares: Mapping[str, float], bins: int = 1024, last: int = 10_000) -> DataFrame:
    """(key, a column for each share): interpolated quantiles of value (nulls do not count), exact.

    A quantile lies between two ranks. Each rank's bounds close in round by round: rows
    between them are counted in equal bins, and the bin of the rank, with the least and largest
    value in it, gives the next bounds. When few rows are left, they are sorted.
    """
    v = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"))
    position = {name: (F.col("_n") - 1) * F.lit(share) for name, share in shares.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in position.values()])))
    whole = settle(v.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    state = settle(whole.select(*key, "_low", "_high", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_count"), F.explode(ranks).alias("_rank")))
    wide = (F.col("_low") < F.col("_high")) & (F.col("_count") > last)
    while not state.where(wide).isEmpty():
        inside = v.join(state.where(wide), list(key)).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        spot = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))
        counted = inside.groupBy(*key, "_rank", "_below", spot.alias("_bin")).agg(F.count("*").alias("_count"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_count").over(Window.partitionBy(*key, "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        found = counted.withColumn("_below", F.col("_below") + upto - F.col("_count")).where((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_count")))
        old, state = state, settle(found.select(*state.columns).unionByName(state.where(~wide)))
        forget(old)
    few = v.join(state.where("_low < _high"), list(key)).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    sorted_few = few.groupBy(*key, "_rank", "_below").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    picked = sorted_few.select(*key, "_rank", F.get("_all", (F.col("_rank") - F.col("_below")).cast("int")).alias("_v")).unionByName(state.where("_low = _high").select(*key, "_rank", F.col("_low").alias("_v")))
    held = settle(picked.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")).join(whole.select(*key, "_n"), list(key)))
    out = []
    for name, p in position.items():
        low, high = F.element_at("_at", F.floor(p)), F.element_at("_at", F.ceil(p))
        out.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(name))
    return held.select(*key, *out)
