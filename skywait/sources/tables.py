"""Parquet tables: read or empty, deterministic writes, views, catalogue of signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from ..schemas import KEYS, empty, require_unique
from .bucketed import BucketedTable
from .shared import content_hash


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def bucketed(spark: SparkSession, data_dir: str, table: str) -> BucketedTable:
    return BucketedTable(spark, f"{data_dir}/{table}", KEYS[table])


def stored(spark: SparkSession, data_dir: str, table: str) -> DataFrame | None:
    """The table, in buckets or plain, or None where there is none yet.

    If a write broke off between its two moves, the table that it was to replace is read.
    """
    buckets = bucketed(spark, data_dir, table)
    if buckets.exists():
        return buckets.read()
    found = _whole(spark, f"{data_dir}/{table}.parquet")
    return spark.read.parquet(found) if found else None


def _whole(spark: SparkSession, path: str) -> str | None:
    """path, or what a broken write has moved aside."""
    return next((p for p in (path, f"{path}.old") if _exists(spark, p)), None)


def read_or_empty(spark: SparkSession, data_dir: str, table: str) -> DataFrame:
    """The table, or an empty one with its declared columns where there is none yet."""
    found = stored(spark, data_dir, table)
    return empty(spark, table) if found is None else found


def write_table(df: DataFrame, data_dir: str, table: str, files: int | None = None) -> dict:
    """Replace a table: rows range-partitioned and sorted by key, zstd; a table in buckets stays one.

    Returns what the write saw: rows, and content, a hash that equal rows share whatever the files.

    Equal input gives equal content. The rows are written beside the table, the old files
    move aside and go last: a table may be computed from itself, and a crash loses none.
    """
    spark, keys = df.sparkSession, [k for k in KEYS[table] if k in df.columns]
    if (buckets := bucketed(spark, data_dir, table)).exists():
        return buckets.replace(df)
    path = f"{data_dir}/{table}.parquet"
    dealt = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    seen = Observation()  # above the sort, so that no sample of the ranges is counted
    watched = dealt.sortWithinPartitions(*keys).observe(seen, F.count("*").alias("rows"), content_hash(df.columns).alias("content"))
    watched.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.new")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        fs.delete(hadoop(f"{path}.old"), True)
        fs.rename(hadoop(path), hadoop(f"{path}.old"))
    fs.rename(hadoop(f"{path}.new"), hadoop(path))
    fs.delete(hadoop(f"{path}.old"), True)
    return seen.get


def upsert_table(
    incoming: DataFrame, data_dir: str, table: str, keep_first: tuple[str, ...] = (), order: str | None = None, batch: tuple[str, int] | None = None,
) -> list[int]:
    """Merge rows into a table by key, rewriting only the buckets they fall into (see BucketedTable.upsert).

    The first upsert of a plain table deals it into buckets.
    """
    spark = incoming.sparkSession
    buckets = bucketed(spark, data_dir, table)
    plain = _whole(spark, f"{data_dir}/{table}.parquet")
    if plain and not buckets.exists():
        buckets.replace(spark.read.parquet(plain))
    if plain:  # what a crash before this left is older than the buckets
        for left in (f"{data_dir}/{table}.parquet", f"{data_dir}/{table}.parquet.old"):
            p = spark._jvm.org.apache.hadoop.fs.Path(left)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return buckets.upsert(incoming, keep_first, order, batch)


def register_views(spark: SparkSession, data_dir: str) -> list[str]:
    """A view of each table that exists, named like it."""
    found = {t: df for t in KEYS if (df := stored(spark, data_dir, t)) is not None}
    for t, df in found.items():
        df.createOrReplaceTempView(t)
    return list(found)


def load_observations(spark: SparkSession, data_dir: str) -> DataFrame:
    """All observations; they must be of one settings hash and unique by key."""
    obs = read_or_empty(spark, data_dir, "observations")
    if obs.select("config_hash").distinct().count() > 1:
        raise DataError("observations of several settings are mixed")
    require_unique(obs, KEYS["observations"], "observations")
    return obs.orderBy("aoi_id", "observed_at", "datatake_id")


def load_places(spark: SparkSession, data_dir: str) -> DataFrame:
    """Entity names and positions, checked, without geometry (its column is never read)."""
    places = read_or_empty(spark, data_dir, "aois").select("aoi_id", "name", "country", "lat", "lon")
    require_unique(places, ["aoi_id"], "aois")
    if not places.where(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180)).isEmpty():
        raise DataError("a position lies off the globe")
    return places.orderBy("aoi_id")


class TableCache:
    """Persisted tables, keyed by path, size and time of their files: a new file is a new table."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held = spark, {}

    def signature(self, path: str) -> tuple:
        """(name, size, time) of the files, wherever Spark reads them."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        listed, found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(root, True), []
        while listed.hasNext():
            f = listed.next()
            if f.getPath().getName().endswith(".parquet"):
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(found))

    def read(self, path: str) -> DataFrame:
        """The files under path, or those that a broken write has moved aside."""
        path = _whole(self.spark, path) or path
        key = self.signature(path)
        old = self.held.get(path)
        if old is None or old[0] != key:
            if old:
                old[1].unpersist()
            self.held[path] = (key, self.spark.read.parquet(path).persist())
        return self.held[path][1]


