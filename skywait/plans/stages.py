"""Pipeline stages on stored tables: entities, discovery, processing, metrics, report, whole runs."""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

import pyspark
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..errors import DataError
from ..functions import geometry
from ..functions.columns import is_usable, title_label
from ..operators import catalogue_upkeep, classifier, composite, rasters, spatial
from ..operators.joins import many_to_one
from ..schemas import KEYS, SCHEMAS
from ..sources import catalogue_items, geotiff, search, tables
from ..sources.shared import content_hash, settle, settle_counted
from . import metric_tables, views


def _declared(df: DataFrame, table: str) -> DataFrame:
    """The columns and types of the table's declared schema."""
    shape = df.sparkSession.createDataFrame([], SCHEMAS[table]).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape])


def build_aois(spark: SparkSession, csv: str, data_dir: str, size_km: float = 20.0) -> DataFrame:
    """Entities as squares about the centroids of a CSV file."""
    placed = catalogue_items.with_utm(catalogue_items.read_centroids(spark, csv))

    @F.pandas_udf("struct<ring: array<array<double>>, area_km2: double>")
    def shape(lat, lon, epsg):
        import pandas as pd

        made = [geometry.square(a, b, int(e), size_km) for a, b, e in zip(lat, lon, epsg, strict=True)]
        return pd.DataFrame({"ring": [r for r, _ in made], "area_km2": [a for _, a in made]})

    out = placed.withColumn("s", shape("lat", "lon", "utm_epsg")).select("*", "s.ring", "s.area_km2").drop("s")
    tables.write_table(_declared(out.withColumn("geometry", geometry.wkb("ring")), "aois"), data_dir, "aois")
    return out


def search_windows(spark: SparkSession, cfg: Config, data_dir: str) -> DataFrame:
    """(aoi_id, start, end): what the next discovery must search for each entity of the settings."""
    state = tables.read_or_empty(spark, data_dir, "ingest_state").where(F.col("collection") == cfg.collection)
    coverage = catalogue_upkeep.coverage_starts(tables.read_or_empty(spark, data_dir, "scenes"), tables.read_or_empty(spark, data_dir, "scene_aoi"))
    entities = metric_tables.entity_table(spark, cfg)
    return catalogue_upkeep.search_windows(entities, state, coverage, cfg.start, cfg.end, cfg.late_overlap_days)


def overlap_with(data_dir: str) -> Callable[[DataFrame], DataFrame]:
    """Adds the share of each item's entity that the item's footprint covers."""

    def add(items: DataFrame) -> DataFrame:
        places = _rings(items.sparkSession, data_dir).withColumnRenamed("_place", "aoi_id")
        rings = items.join(places, "aoi_id").withColumn("_foot", _footprint())
        return rings.withColumn("footprint_overlap_fraction", spatial.overlap_fraction(F.col("_ring"), F.col("_foot"))).drop("_ring", "_foot")

    return add


def _rings(spark: SparkSession, data_dir: str) -> DataFrame:
    places = tables.read_or_empty(spark, data_dir, "aois")
    return places.select(F.col("aoi_id").alias("_place"), geometry.ring_of("geometry").alias("_ring"))


def _footprint() -> Column:
    shape = F.from_json("geometry_json", "coordinates array<array<array<double>>>")
    return F.get(shape["coordinates"], F.lit(0))


def tagged_by_overlap(items: DataFrame, data_dir: str, cell: float = spatial.CELL_DEGREES) -> DataFrame:
    """Items once for each stored entity that their footprint overlaps, with aoi_id and footprint_overlap_fraction."""
    pairs = spatial.overlapping(items.withColumn("_foot", _footprint()), _rings(items.sparkSession, data_dir), "_foot", "_ring", cell)
    return pairs.withColumnsRenamed({"_place": "aoi_id", "overlap": "footprint_overlap_fraction"}).drop("_foot", "_ring")


def discover(
    spark: SparkSession, cfg: Config, items: DataFrame | Callable[[DataFrame], DataFrame], data_dir: str,
    overlap: Callable[[DataFrame], DataFrame] | None = None, now: datetime | None = None,
) -> DataFrame:
    """Merge items into scenes, links, supersession and watermarks.

    items: the columns of read_items and aoi_id (without it, items go to the stored entities
    that their footprints overlap), or a function that fetches them for a table of (aoi_id,
    start, end, chunk_start, chunk_end): the entities' search windows (from the watermark less the overlap on, or all where the stored coverage falls short) in chunks of
    at most 90 days. Items of other entities or outside of the windows are left out. overlap adds
    footprint_overlap_fraction (1.0 without it). Returns counts per entity; a second call
    with the same items adds none.
    """
    at = F.lit((now or datetime.now(timezone.utc)).replace(tzinfo=None)).cast("timestamp")
    windows = settle(search_windows(spark, cfg, data_dir))
    found = items(catalogue_upkeep.interval_rows(windows)) if callable(items) else items
    if "aoi_id" not in found.columns:
        found = tagged_by_overlap(found, data_dir)
    taken = F.col("properties.datetime").try_cast("timestamp")
    due = found.join(F.broadcast(windows), "aoi_id")  # one row an entity of the settings
    tagged = settle(due.where(taken.isNull() | taken.between(F.col("start"), F.col("end"))).select(*found.columns))
    if "footprint_overlap_fraction" in tagged.columns:
        links = tagged
    else:
        links = overlap(tagged) if overlap else tagged.withColumn("footprint_overlap_fraction", F.lit(1.0))
    fetched = catalogue_items.scene_rows(catalogue_items.merge_pages(tagged.drop("aoi_id", *[c for c in ("footprint_overlap_fraction",) if c in tagged.columns])), at)
    known = settle(tables.read_or_empty(spark, data_dir, "scenes"))
    everything = settle(catalogue_upkeep.upsert(known, _declared(fetched, "scenes"), KEYS["scenes"], keep_first=("ingested_at",)))
    won = catalogue_upkeep.winner_table(everything)
    lost_now = won.where("scene_id != winner").select("scene_id", F.col("winner").alias("superseded_by"))
    lost_before = tables.read_or_empty(spark, data_dir, "scenes_superseded")
    chains = settle(catalogue_upkeep.resolve_chains(catalogue_upkeep.upsert(lost_before, lost_now, ["scene_id"])))
    active = settle(everything.join(won.where("scene_id = winner").select("scene_id"), "scene_id", "left_semi"))
    all_links = tables.read_or_empty(spark, data_dir, "scene_aoi").unionByName(_declared(links.withColumnRenamed("id", "scene_id"), "scene_aoi"))
    relinked = settle(catalogue_upkeep.relink(all_links, chains, active))
    seen = tagged.select("aoi_id", F.col("id").alias("scene_id"))
    counts = settle(catalogue_upkeep.upkeep_counts(seen, known, lost_now.join(lost_before, "scene_id", "left_anti")))
    state = tables.read_or_empty(spark, data_dir, "ingest_state").where(F.col("collection") == cfg.collection)
    newest = seen.join(fetched.select("scene_id", "datetime"), "scene_id").select("aoi_id", "datetime")
    moved = settle(catalogue_upkeep.advance(state, newest).withColumn("collection", F.lit(cfg.collection)).withColumn("last_run_at", at))
    for name, rows in (("scenes", active), ("scenes_superseded", chains), ("scene_aoi", relinked)):
        tables.write_table(_declared(rows, name), data_dir, name)
    tables.upsert_table(_declared(moved, "ingest_state"), data_dir, "ingest_state")
    return counts


def searched(name: str = "scene_search") -> Callable[[DataFrame], DataFrame]:
    """Items for discover() from the registered search source."""

    def fetch(windows: DataFrame) -> DataFrame:
        return catalogue_items.parsed(search.search(windows.select("aoi_id", "start", "end"), name).drop("datetime"), "item")

    return fetch


def http_source(spark: SparkSession, cfg: Config, url: str, data_dir: str, name: str = "http_search") -> str:
    """Register the search at url for the settings' stored entities; for searched() and discover_stream()."""
    places = tables.read_or_empty(spark, data_dir, "aois").where(F.col("aoi_id").isin(*cfg.aois)).select("aoi_id", geometry.ring_of("geometry").alias("ring"))
    shapes = {r.aoi_id: {"type": "Polygon", "coordinates": [[list(p) for p in r.ring]]} for r in places.collect()}  # the settings' entities
    if missing := [a for a in cfg.aois if a not in shapes]:
        raise DataError(f"build the entities first: there is no {', '.join(missing)}")
    return search.register(spark, search.HttpFetcher(url, cfg.collection, shapes), name)


def discover_stream(
    spark: SparkSession, cfg: Config, data_dir: str, checkpoint: str, name: str = "scene_search", overlap: Callable[[DataFrame], DataFrame] | None = None,
    now: datetime | None = None, **options: str,
) -> StreamingQuery:
    """Discovery as a stream of the registered search source, all that is there now.

    A batch holds what came since the entities' offsets, less the settings' overlap; merging it
    again changes nothing, so the query may stop anywhere and start again.
    """
    period = {"entities": json.dumps(list(cfg.aois)), "start": str(cfg.start), "end": f"{cfg.end}T23:59:59.999999", "overlapDays": str(cfg.late_overlap_days)}
    rows = spark.readStream.format(name).options(**(period | options)).load()

    def merge(batch: DataFrame, _: int) -> None:
        discover(spark, cfg, settle(catalogue_items.parsed(batch.drop("datetime"), "item")), data_dir, overlap, now)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process(spark: SparkSession, cfg: Config, data_dir: str, read_rasters: Callable[[DataFrame], DataFrame], force: bool = False, now: datetime | None = None, keep_rasters: bool = False) -> dict[str, int]:
    """Scenes to observations: read, count, composite and roll up what is not done yet.

    read_rasters takes (aoi_id, scene_id, ...) rows and returns them with classes
    (array<int> over the entity's pixels) and error (null if read); pass a mapInPandas
    decoder, rasters.tile_reader or a join with a table of arrays. A scene that fails is recorded,
    never fatal. keep_rasters stores the composites as runs. Counts come from the writes.
    """
    at = F.lit((now or datetime.now(timezone.utc)).replace(tzinfo=None)).cast("timestamp")
    links = tables.read_or_empty(spark, data_dir, "scene_aoi").select("aoi_id", "scene_id")
    scenes = tables.read_or_empty(spark, data_dir, "scenes")
    members = settle(many_to_one(links, scenes, ["scene_id"]))
    old_stats = tables.read_or_empty(spark, data_dir, "scene_aoi_stats").where(F.col("config_hash") == cfg.config_hash)
    old_obs = tables.read_or_empty(spark, data_dir, "observations").where(F.col("config_hash") == cfg.config_hash)
    sizes, groups = settle_counted(catalogue_upkeep.group_sizes(members), n=F.count("*"))
    todo = settle(catalogue_upkeep.pending_groups(members, old_obs, old_stats, force, sizes))
    work = members.join(todo, ["aoi_id", "datatake_id"], "left_semi")
    layers = settle(read_rasters(work))
    stats = composite.scene_statistics(layers.select("aoi_id", "scene_id", "classes", "error")).withColumn("config_hash", F.lit(cfg.config_hash)).withColumn("processed_at", at)
    joined = layers.join(stats.select("aoi_id", "scene_id", "n_covered", "read_ok", "n_aoi_pixels"), ["aoi_id", "scene_id"])
    merged = composite.array_composite(layers.select("aoi_id", "datatake_id", "scene_id", "nodata_pct", F.when(F.col("error").isNull(), F.col("classes")).otherwise(F.transform("classes", lambda _: F.lit(0))).alias("classes")))
    if keep_rasters:
        merged = settle(merged)  # counted and kept
        kept = merged.select("aoi_id", "datatake_id", F.lit(cfg.config_hash).alias("config_hash"), rasters.to_runs(F.col("classes")).alias("runs"))
        tables.upsert_table(_declared(kept, "composites"), data_dir, "composites")
    counts = merged.withColumn("n_pixels", F.size("classes")).withColumns({f"count_class_{k}": composite.count_of("classes", k) for k in composite.CLASSES}).drop("classes")
    shares = composite.fractions(counts, cfg.classes)
    rolled = composite.roll_up(joined).join(shares, ["aoi_id", "datatake_id"])
    usable = is_usable(F.col("covered_fraction"), F.col("clear_fraction"), cfg.min_coverage, cfg.min_clear)
    obs = rolled.withColumn("n_aoi_pixels", F.col("n_pixels")).withColumn("usable", usable).withColumn("config_hash", F.lit(cfg.config_hash))
    new_obs, done = settle_counted(_declared(obs, "observations"), n=F.count("*"))
    new_stats, read = settle_counted(_declared(stats, "scene_aoi_stats"), n=F.count("*"), failed=F.count_if(~F.col("read_ok")))
    tables.upsert_table(new_stats, data_dir, "scene_aoi_stats", keep_first=("processed_at",))
    tables.upsert_table(new_obs, data_dir, "observations")
    return {"observations": done["n"], "observations_skipped": groups["n"] - done["n"], "scenes": read["n"], "scenes_failed": read["failed"]}


def metrics(spark: SparkSession, cfg: Config, data_dir: str) -> dict[str, dict]:
    """observations to the six metric tables, always recomputed: each one's rows and content, as its write saw them."""
    made = metric_tables.build_metric_tables(tables.read_or_empty(spark, data_dir, "observations"), cfg)
    return {name: tables.write_table(rows, data_dir, name) for name, rows in made.items()}


SUMMARY_COLUMNS = ("AOI", "Observations", "Usable", "Usable rate", "Nominal median (d)", "Effective median (d)", "P(within 7d)", "Longest outage (d)")


def summary_lines(summary: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(aoi_id, line): the summary's rows as Markdown cells."""
    named = summary.join(places.select("aoi_id", "name"), "aoi_id", "left") if places is not None else summary.withColumn("name", F.lit(None).cast("string"))
    cells = [
        F.coalesce("name", title_label(F.col("aoi_id"))), F.format_number("n_observations", 0), F.format_number("n_usable", 0), F.format_string("%.1f%%", 100 * F.col("usable_rate")),
        F.format_string("%.2f", "nominal_median_gap_days"), F.format_string("%.2f", "effective_median_gap_days"), F.format_string("%.1f%%", 100 * F.col("p_within_7d")), F.format_string("%.2f", "longest_outage_days"),
    ]
    return named.select("aoi_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def summary_markdown(summary: DataFrame, places: DataFrame | None = None) -> str:
    rows = summary_lines(summary, places).orderBy("aoi_id").collect()  # one short line an entity
    head = ["| " + " | ".join(SUMMARY_COLUMNS) + " |", "| --- |" + " ---: |" * (len(SUMMARY_COLUMNS) - 1)]
    return "\n".join([*head, *(r.line for r in rows)]) + "\n"


def report_frames(spark: SparkSession, cfg: Config, data_dir: str) -> dict[str, DataFrame]:
    """The data behind the report's figures."""

    def mine(name: str) -> DataFrame:
        scoped = [*cfg.aois, classifier.POOL]
        return tables.read_or_empty(spark, data_dir, name).where((F.col("config_hash") == cfg.config_hash) & F.col("aoi_id").isin(*scoped))

    summary, waits, obs = mine("aoi_summary"), mine("aoi_wait_daily"), mine("observations")
    picks = views.survival_picks(summary)
    frames = {
        "dumbbell": views.dumbbell(summary), "heatmap": views.heatmap(mine("aoi_monthly")),
        "survival": mine("aoi_survival").where(F.col("aoi_id").isin(*picks)), "catalogue": views.quality_scatter(obs),
        "service_levels": views.service_levels(waits, summary.select("aoi_id")), "examples": classifier.extreme_examples(obs),
        "pooled": views.evaluation_frames(mine("catalog_filter_eval")), "summary": summary,
    }
    places = tables.read_or_empty(spark, data_dir, "aois")
    return frames if places.isEmpty() else frames | {"map": views.map_points(summary, places)}


def example_chips(examples: DataFrame, data_dir: str, grids: DataFrame, sources: DataFrame, tiles: DataFrame, nodata: int | None = None) -> DataFrame:
    """The extreme examples' pictures (case, aoi_id, datatake_id, bands): their linked scenes' bands, filled in order of nodata percentage.

    An example without a scene that has bands is an error.
    """
    spark = examples.sparkSession
    scenes = tables.read_or_empty(spark, data_dir, "scenes").where("visual_href is not null").select("scene_id", "datatake_id", "nodata_pct")
    links = tables.read_or_empty(spark, data_dir, "scene_aoi").select("aoi_id", "scene_id")
    wanted = settle(examples.select("case", "aoi_id", "datatake_id"))  # at most two
    members = settle(wanted.join(links, "aoi_id").join(scenes, ["scene_id", "datatake_id"]))
    if not wanted.join(members, "case", "left_anti").isEmpty():
        raise DataError("an example has no linked scene with bands")
    chips = rasters.bands_on_grids(members, grids, sources, tiles, nodata)
    return rasters.band_composite(members.join(chips, ["aoi_id", "scene_id"]), ("case", "aoi_id", "datatake_id"))


def write_report(frames: dict[str, DataFrame], target: str) -> dict[str, dict]:
    """The report's frames as Parquet under target: each one's rows and content, as its write saw them."""
    out = {}
    for name, frame in frames.items():
        seen = Observation()
        frame.observe(seen, F.count("*").alias("rows"), content_hash(frame.columns).alias("content")).write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        out[name] = seen.get
    return out


class RunRecord:
    """A JSON file that tells how far a run came: written at its start, after each stage and on failure."""

    def __init__(self, cfg: Config, path: str | Path) -> None:
        self.path, self.began = Path(path), time.monotonic()
        versions = {"python": platform.python_version(), "pyspark": pyspark.__version__}
        self.data = {"status": "running", "config": json.loads(json.dumps(cfg.__dict__, default=lambda v: getattr(v, "__dict__", str(v)))), "config_hash": cfg.config_hash, "versions": versions, "stages": {}}
        self.write()

    def write(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.data["seconds"] = round(time.monotonic() - self.began, 3)
        self.path.write_text(json.dumps(self.data, indent=2, sort_keys=True) + "\n")

    def stage(self, name: str, work: Callable[[], dict]) -> dict:
        start = time.monotonic()
        try:
            counts = work()
        except BaseException as e:
            self.data |= {"status": "failed", "failure": {"stage": name, "type": type(e).__name__, "message": str(e)[:2000]}}
            self.write()
            raise
        self.data["stages"][name] = {"seconds": round(time.monotonic() - start, 3), "counts": counts}
        self.write()
        return counts

    def done(self) -> None:
        self.data["status"] = "complete"
        self.write()


def stored_grids(spark: SparkSession, data_dir: str) -> DataFrame:
    """The stored entities' pixel grids, with their masks."""
    return rasters.entity_grids(tables.read_or_empty(spark, data_dir, "aois").select("aoi_id", "utm_epsg", geometry.ring_of("geometry").alias("ring")))


def raster_files(spark: SparkSession, data_dir: str, folder: str) -> Callable[[DataFrame], DataFrame]:
    """A reader for process() of a folder of GeoTIFF files, named by scene, on any grid and zone."""
    sources, tiles, _ = geotiff.read_rasters(spark, folder)
    return rasters.tile_reader(stored_grids(spark, data_dir), sources, tiles)


def export_composites(spark: SparkSession, cfg: Config, data_dir: str, folder: str) -> int:
    """Write the settings' kept composites as GeoTIFF files; how many there are."""
    kept = tables.read_or_empty(spark, data_dir, "composites").where(F.col("config_hash") == cfg.config_hash)
    geotiff.write_rasters(geotiff.kept_composites(kept, stored_grids(spark, data_dir)), folder)
    return kept.count()


def stored_rasters(rasters: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A reader for process(): classes and errors of (aoi_id, scene_id) from a table; what it lacks is an error."""

    def read(work: DataFrame) -> DataFrame:
        both = work.join(rasters.select("aoi_id", "scene_id", "classes", "error", F.lit(True).alias("_there")), ["aoi_id", "scene_id"], "left")
        lacking = F.when(F.col("_there").isNull(), F.lit("no raster"))
        return both.withColumn("classes", F.coalesce("classes", F.array().cast("array<int>"))).withColumn("error", F.coalesce("error", lacking)).drop("_there")

    return read


def run(
    spark: SparkSession, cfg: Config, data_dir: str, items: DataFrame | Callable[[DataFrame], DataFrame], read_rasters: Callable[[DataFrame], DataFrame], record: str,
    overlap: Callable[[DataFrame], DataFrame] | None = None, keep_rasters: bool = False,
) -> RunRecord:
    """Discovery, processing, metrics and report frames in one go, with a run record.

    It holds each table's rows and a hash of its content, so runs of equal input can be compared.
    """
    log = RunRecord(cfg, record)

    def places() -> dict:
        if tables.read_or_empty(spark, data_dir, "aois").isEmpty():
            raise DataError("build the entities first")
        return {}

    log.stage("entities", places)
    log.stage("discover", lambda: {r.aoi_id: {"fetched": r.fetched, "new": r.new, "superseded": r.superseded} for r in discover(spark, cfg, items, data_dir, overlap).collect()})
    log.stage("process", lambda: process(spark, cfg, data_dir, read_rasters, keep_rasters=keep_rasters))
    log.stage("metrics", lambda: metrics(spark, cfg, data_dir))
    log.stage("report", lambda: write_report(report_frames(spark, cfg, data_dir), f"{data_dir}/report"))
    log.done()
    return log
