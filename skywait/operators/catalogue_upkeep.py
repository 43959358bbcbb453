"""Keeping a scene catalogue: duplicates, supersession, links, upserts, watermarks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, settle


def precedence() -> Column:
    """Order of processings of one acquisition: sequence, generation time, id; the largest wins."""
    return F.struct(
        F.coalesce(F.expr("try_cast(sequence AS bigint)"), F.lit(-1)), F.coalesce(F.col("generation_time").cast("timestamp"), F.lit("1900-01-01").cast("timestamp")), F.col("scene_id")
    )


def with_winner(scenes: DataFrame) -> DataFrame:
    """scenes with winner: the id that stands for its (tile, datatake). Rows without either stand alone."""
    whole = F.col("mgrs_tile").isNotNull() & F.col("datatake_id").isNotNull()
    group = [F.when(whole, F.col("mgrs_tile")), F.when(whole, F.col("datatake_id")).otherwise(F.col("scene_id"))]
    best_first = Window.partitionBy(*group).orderBy(precedence().desc())
    return scenes.withColumn("winner", F.first("scene_id").over(best_first))


def latest(scenes: DataFrame) -> DataFrame:
    """The winning processing of every acquisition."""
    return with_winner(scenes).where("scene_id = winner").drop("winner")


def superseded(scenes: DataFrame) -> DataFrame:
    """(scene_id, superseded_by) of all others."""
    return with_winner(scenes).where("scene_id != winner").select("scene_id", F.col("winner").alias("superseded_by"))


def resolve_chains(links: DataFrame) -> DataFrame:
    """Follow scene_id -> superseded_by to the final winner.

    Every round doubles how far a row looks, so a chain of n links takes log2(n) rounds. In
    a cycle there is no last winner: its ids end at one another. Rows that have a last winner
    are done; when a round finishes no more of them, the rest lead into cycles.
    """
    first = now = settle(links.select("scene_id", "superseded_by").dropDuplicates(["scene_id"]))
    open_before = None
    while True:
        hop = now.select(F.col("scene_id").alias("superseded_by"), F.col("superseded_by").alias("_next"))
        step = settle(now.join(hop, "superseded_by", "left").select("scene_id", "superseded_by", "_next"))
        if now is not first:
            forget(now)
        still_open = step.where("_next is not null")
        left = still_open.count()
        if left == 0:
            return step.select("scene_id", "superseded_by")
        if left == open_before:
            own = still_open.select("scene_id").join(first, "scene_id")  # as they came
            return step.where("_next is null").select("scene_id", "superseded_by").unionByName(own)
        open_before = left
        now = settle(step.select("scene_id", F.coalesce("_next", "superseded_by").alias("superseded_by")))
        forget(step)


def winner_table(scenes: DataFrame) -> DataFrame:
    """(scene_id, winner) of all scenes, settled: losers and winners are both read from it."""
    return settle(with_winner(scenes).select("scene_id", "winner"))


def relink(links: DataFrame, winners: DataFrame, active: DataFrame) -> DataFrame:
    """(aoi_id, scene_id, footprint_overlap_fraction) moved to winners, with the largest overlap; inactive scenes go."""
    moved = links.join(winners, "scene_id", "left").withColumn("scene_id", F.coalesce("superseded_by", "scene_id"))
    best = moved.groupBy("aoi_id", "scene_id").agg(F.max("footprint_overlap_fraction").alias("footprint_overlap_fraction"))
    return best.join(active.select("scene_id").distinct(), "scene_id", "left_semi").select("aoi_id", "scene_id", "footprint_overlap_fraction")


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], keep_first: Sequence[str] = (), order: str | None = None, ready: bool = False,
) -> DataFrame:
    """existing overwritten by incoming on keys; the columns of keep_first keep their old value if they have one.

    Of incoming rows with one key the last by `order` stays; without an order, the one that a
    hash of its content puts last, however the rows come. The incoming side
    is settled, as it is read for the rows that go and for those that come; ready tells that it
    is already and that no key repeats.
    """
    incoming = incoming if ready else settle(last_of_key(incoming, keys, order))
    new = incoming
    if keep_first:
        old = existing.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep_first])
        new = incoming.join(old, list(keys), "left")
        new = new.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in keep_first}).select(*incoming.columns)
    return existing.join(incoming, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def last_of_key(rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row a key: the last by order (for merged pages and repeated keys in one batch), then by a hash of the content."""
    others = [c for c in rows.columns if c not in keys]
    last_first = Window.partitionBy(*keys).orderBy(*([F.desc(order)] if order else []), F.xxhash64(*others) if others else F.lit(0))
    return rows.withColumn("_place", F.row_number().over(last_first)).where("_place = 1").select(*rows.columns)


def search_start(configured: datetime, watermark: datetime | None, overlap_days: int, coverage_start: datetime | None = None, backfill: bool = False) -> datetime:
    """Where a search starts: at the watermark less the overlap, not before the configured start.

    With backfill, a stored coverage that is unknown or begins after the configured start
    asks for everything again.
    """
    if backfill and (coverage_start is None or configured < coverage_start):
        return configured
    return configured if watermark is None else max(configured, watermark - timedelta(days=overlap_days))


def search_starts(state: DataFrame, configured: date, overlap_days: int) -> DataFrame:
    """search_start for every row of a watermark table."""
    first = F.lit(configured).cast(state.schema["watermark"].dataType)
    return state.withColumn("search_start", F.greatest(first, F.col("watermark") - F.expr(f"interval {overlap_days} days")))


def coverage_starts(scenes: DataFrame, links: DataFrame) -> DataFrame:
    """(aoi_id, coverage_start): the earliest stored instant of each entity."""
    dated = links.select("aoi_id", "scene_id").join(scenes.select("scene_id", "datetime"), "scene_id")
    return dated.groupBy("aoi_id").agg(F.min("datetime").alias("coverage_start"))


def search_windows(entities: DataFrame, state: DataFrame, coverage: DataFrame, configured: date, last: date, overlap_days: int) -> DataFrame:
    """(aoi_id, start, end): what each entity's search must cover.

    An entity whose stored coverage is unknown or begins after the configured start asks for
    everything; others ask from their watermark less the overlap on.
    """
    known = entities.join(state.select("aoi_id", "watermark"), "aoi_id", "left").join(coverage, "aoi_id", "left")
    first = F.lit(configured).cast("timestamp")
    lacking = F.col("coverage_start").isNull() | (first < F.col("coverage_start"))
    start = F.when(lacking, first).otherwise(F.greatest(first, F.col("watermark") - F.expr(f"interval {overlap_days} days")))
    return known.select("aoi_id", start.alias("start"), (F.date_add(F.lit(last), 1).cast("timestamp") - F.expr("interval 1 microsecond")).alias("end"))


def advance(state: DataFrame, fetched: DataFrame) -> DataFrame:
    """Watermarks moved to the newest fetched instant of each entity, never back."""
    top = fetched.groupBy("aoi_id").agg(F.max("datetime").alias("_top"))
    return state.join(top, "aoi_id", "full").withColumn("watermark", F.greatest("watermark", "_top")).drop("_top")


def interval_rows(ranges: DataFrame, days: int = 90) -> DataFrame:
    """Each row's [start, end] in closed chunks of at most `days`, one second apart; a row whose end lies before its start has none."""
    ranges = ranges.where("start <= end")
    begin = F.explode(F.sequence("start", "end", F.expr(f"interval {days} days")))
    return ranges.withColumn("chunk_start", begin).withColumn("chunk_end", F.least(F.col("chunk_start") + F.expr(f"interval {days} days - interval 1 second"), F.col("end")))


def group_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("aoi_id", "datatake_id").agg(F.count("*").alias("n_scenes"))


def pending_groups(members: DataFrame, observations: DataFrame, stats: DataFrame, force: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """(aoi_id, datatake_id) that still need work: a new group, a changed scene count, or a scene without statistics.

    sizes: group_sizes(members), if at hand.
    """
    key = ["aoi_id", "datatake_id"]
    counted = group_sizes(members) if sizes is None else sizes
    if force:
        return counted.select(*key)
    lacking = members.join(stats.select("aoi_id", "scene_id").distinct(), ["aoi_id", "scene_id"], "left_anti").select(*key)
    changed = counted.join(observations.select(*key, "n_scenes"), [*key, "n_scenes"], "left_anti").select(*key)
    return lacking.unionByName(changed).distinct()


def upkeep_counts(fetched: DataFrame, known: DataFrame, losers: DataFrame) -> DataFrame:
    """Per entity: fetched ids, new ids that stay active, and ids that lost this time."""
    tagged = (
        fetched.select("aoi_id", "scene_id").distinct()
        .join(known.select("scene_id", F.lit(True).alias("_known")).distinct(), "scene_id", "left")
        .join(losers.select("scene_id", F.lit(True).alias("_lost")).distinct(), "scene_id", "left")
    )
    return tagged.groupBy("aoi_id").agg(
        F.count("*").alias("fetched"), F.count_if(F.col("_known").isNull() & F.col("_lost").isNull()).alias("new"), F.count_if(F.col("_lost").isNotNull()).alias("superseded")
    )
