"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_settled: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. It comes from the session; only local sessions may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage: an executor that is lost later costs a read, not the whole
    history. The shuffle files behind it go with the write, its own files when forget() is
    called for them or the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    with _shuffles_cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    _settled.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """settle(df), and aggregates of its rows that the write itself observes: no job counts them."""
    seen = Observation()
    out = settle(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return out, seen.get


def content_hash(columns: Sequence[str]) -> Column:
    """An aggregate that is equal for equal rows, whatever their order and files: the sum of the rows' hashes."""
    return F.coalesce(F.sum(F.xxhash64(*sorted(columns)).cast("decimal(20,0)")).cast("string"), F.lit("0"))


@contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has run."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def forget(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for table in tables:
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for entry in [e for e in _settled if any(f.endswith(e[1].split(":", 1)[-1]) for f in folders)]:
            _delete(*entry)
            _settled.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for entry in _settled:
        try:
            _delete(*entry)
        except Exception:  # the session has ended; its folder goes with it
            return
