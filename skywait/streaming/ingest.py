"""Incremental ingest: keep the newest processing of each acquisition, upsert by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import upsert_table

STATE = "sequence long, generated long, scene_id string"
RESULT = "mgrs_tile string, datatake_id string, scene_id string, superseded string"


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Report every change of an acquisition's winner, with the id that it replaces."""
    best = state.get if state.exists else None
    before = best
    for rows in batches:
        top = rows.sort_values(["sequence", "generated", "scene_id"]).iloc[-1]
        rank = (int(top["sequence"]), int(top["generated"]), str(top["scene_id"]))
        best = rank if best is None else max(tuple(best), rank)
    if best is not None:
        state.update(tuple(best))
        if before is None or tuple(best) != tuple(before):
            old = None if before is None else before[2]
            yield pd.DataFrame({"mgrs_tile": [key[0]], "datatake_id": [key[1]], "scene_id": [best[2]], "superseded": [old]})


def winners(scenes: DataFrame) -> DataFrame:
    """A stream of scenes -> the stream of winner changes (a late, newer processing replaces the old).

    State is one row an acquisition. Rows without tile or datatake never compete.
    """
    keyed = scenes.select(
        F.coalesce("mgrs_tile", F.lit("")).alias("mgrs_tile"),
        F.when(F.col("mgrs_tile").isNotNull() & F.col("datatake_id").isNotNull(), F.col("datatake_id")).otherwise(F.concat(F.lit("scene|"), F.col("scene_id"))).alias("datatake_id"),
        F.coalesce("sequence", F.lit(-1)).cast("long").alias("sequence"),
        F.coalesce(F.unix_micros(F.col("generation_time").cast("timestamp")), F.lit(-2208988800000000)).cast("long").alias("generated"),
        "scene_id",
    )
    return keyed.groupBy("mgrs_tile", "datatake_id").applyInPandasWithState(_newest, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_stream(rows: DataFrame, data_dir: str, table: str, checkpoint: str, order: str | None = None, keep_first: tuple[str, ...] = ()) -> StreamingQuery:
    """Upsert each micro-batch into a table: it rewrites the buckets that its keys fall into.

    The table's manifest holds the number of the last batch of this checkpoint, so a batch that
    is replayed after its commit changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        upsert_table(batch, data_dir, table, keep_first, order, (checkpoint, number))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usable_counts(observations: DataFrame, delay: str = "7 days", window: str = "30 days") -> DataFrame:
    """Complete and usable events per entity and window; late rows count up to the delay."""
    return (
        observations.withWatermark("observed_at", delay).groupBy(F.window("observed_at", window), "aoi_id")
        .agg(F.count_if("complete").alias("n_observations"), F.count_if(F.col("complete") & F.col("usable")).alias("n_usable"))
        .select(F.col("window.start").alias("window_start"), "aoi_id", "n_observations", "n_usable")
    )
