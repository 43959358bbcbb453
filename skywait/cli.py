"""Command line: python -m skywait.cli aois|discover|process|export|metrics|report|run|sla ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, load_config
from .errors import ConfigError, DataError
from .plans import metric_tables, stages, views
from .sources import catalogue_items, tables


def session() -> SparkSession:
    return SparkSession.builder.appName("skywait").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def log(event: str, **fields) -> None:
    print(json.dumps({"event": event} | fields, sort_keys=True, default=str), file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skywait", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("aois", help="build entities from a CSV file of centroids")
    a.add_argument("csv")
    a.add_argument("data_dir")
    a.add_argument("--size-km", type=float, default=20.0)
    d = sub.add_parser("discover", help="merge catalogue items of one entity")
    d.add_argument("items", help="the items' file, a folder with a file for each entity, or the http address of a search")
    d.add_argument("--start", type=date.fromisoformat)
    d.add_argument("--end", type=date.fromisoformat)
    p = sub.add_parser("process", help="read, composite and roll up what is not done yet")
    p.add_argument("--force", action="store_true")
    r = sub.add_parser("run", help="discover, process, metrics and report frames with a run record")
    r.add_argument("items", help="a folder with a file of items for each entity")
    r.add_argument("--record", required=True)
    for x in (p, r):
        x.add_argument("--rasters", required=True, help="a Parquet table of aoi_id, scene_id, classes, error")
        x.add_argument("--geotiff", action="store_true", help="the rasters are a folder of GeoTIFF files, named by scene")
        x.add_argument("--keep-rasters", action="store_true", help="store the composites as runs")
    e = sub.add_parser("export", help="write the kept composites as GeoTIFF files")
    e.add_argument("folder")
    for x in (d, p):
        x.add_argument("--aoi")
    for name in ("metrics", "report"):
        sub.add_parser(name)
    s = sub.add_parser("sla", help="P(wait < N days) of one entity from the stored waits")
    s.add_argument("--aoi", required=True)
    s.add_argument("--every", type=int, required=True)
    s.add_argument("--min-clear", type=float)
    s.add_argument("--month", type=int)
    for name in ("discover", "process", "export", "metrics", "report", "run", "sla"):
        sub.choices[name].add_argument("--config", required=True)
    return top


def chosen(cfg: Config, args: argparse.Namespace) -> Config:
    """The settings with what the command line says of entities and period."""
    said = {"aois": (args.aoi,) if getattr(args, "aoi", None) else None, "start": getattr(args, "start", None), "end": getattr(args, "end", None)}
    return replace(cfg, **{k: v for k, v in said.items() if v is not None})


def read_items(spark: SparkSession, path: str, cfg: Config) -> DataFrame:
    """The items of all entities: from a folder's files aoi_id.json, or one file of one entity."""
    if path.endswith((".json", ".geojson")):
        if len(cfg.aois) != 1:
            raise ConfigError("a file of items is of one entity: name it with --aoi")
        return catalogue_items.read_items(spark, path).withColumn("aoi_id", F.lit(cfg.aois[0]))
    each = [catalogue_items.read_items(spark, f"{path}/{a}.json").withColumn("aoi_id", F.lit(a)) for a in cfg.aois]
    return reduce(DataFrame.unionByName, each)


def raster_reader(spark: SparkSession, args: argparse.Namespace, cfg: Config) -> Callable[[DataFrame], DataFrame]:
    return stages.raster_files(spark, cfg.data_dir, args.rasters) if args.geotiff else stages.stored_rasters(spark.read.parquet(args.rasters))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    try:
        if args.command == "aois":
            log("entities", rows=stages.build_aois(spark, args.csv, args.data_dir, args.size_km).count())
            return 0
        cfg = load_config(args.config)
        if args.command in ("discover", "run") and tables.read_or_empty(spark, cfg.data_dir, "aois").isEmpty():
            raise DataError("build the entities first")
        if args.command == "discover":
            cfg = chosen(cfg, args)
            if args.items.startswith(("http://", "https://")):
                items = stages.searched(stages.http_source(spark, cfg, args.items, cfg.data_dir))
            else:
                items = read_items(spark, args.items, cfg)
            for row in stages.discover(spark, cfg, items, cfg.data_dir, stages.overlap_with(cfg.data_dir)).collect():
                log("discovered", **row.asDict())
        elif args.command == "process":
            cfg = chosen(cfg, args)
            log("processed", **stages.process(spark, cfg, cfg.data_dir, raster_reader(spark, args, cfg), args.force, keep_rasters=args.keep_rasters))
        elif args.command == "run":
            done = stages.run(spark, cfg, cfg.data_dir, read_items(spark, args.items, cfg), raster_reader(spark, args, cfg), args.record, stages.overlap_with(cfg.data_dir), args.keep_rasters)
            log("run", record=str(done.path), status=done.data["status"])
        elif args.command == "export":
            log("exported", files=stages.export_composites(spark, cfg, cfg.data_dir, args.folder))
        elif args.command == "metrics":
            log("metrics", **stages.metrics(spark, cfg, cfg.data_dir))
        elif args.command == "report":
            print(stages.summary_markdown(stages.report_frames(spark, cfg, cfg.data_dir)["summary"]), end="")
        else:
            cfg = cfg if args.min_clear is None else views.with_threshold(cfg, args.min_clear)
            waits = tables.read_or_empty(spark, cfg.data_dir, "aoi_wait_daily")
            print(f"{metric_tables.query_sla(waits, cfg.config_hash, args.aoi, args.every, args.month):.12g}")
    except (ConfigError, DataError) as e:
        log("error", message=str(e))
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
