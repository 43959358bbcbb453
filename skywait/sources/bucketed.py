"""Tables in buckets of a key hash: an upsert rewrites the buckets that it touches and no other.

A table is a folder of manifests and data folders. A manifest names the folder of every
bucket that has rows; the one of the highest number holds. A change writes new folders first
and then its manifest, by one rename: a crash before that leaves the old state, and what it
wrote is dropped by a later change. One writer at a time; a second one that
commits the same number fails. Folders of the state before stay until the next
change, so whoever has planned a read can finish it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import DataError
from ..operators.catalogue_upkeep import last_of_key, upsert
from .shared import content_hash, forget, settle

BUCKETS = 8  # of a new table
BUCKET_ROWS = 1_000_000  # a table whose buckets hold more on average is dealt into more of them
_SUFFIX = ".buckets"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


class BucketedTable:
    """A table under root (a folder name without suffix) with a primary key."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.root, self.keys, self.asked, self.bucket_rows = spark, root + _SUFFIX, list(keys), buckets, bucket_rows

    def exists(self) -> bool:
        return bool(self._versions())

    def _versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in _children(self.spark, self.root) if n.startswith("manifest-") and n.endswith(".json"))

    def state(self) -> dict:
        """The manifest that holds: version, buckets, schema, parts (bucket to folder), batches (stream to its last batch)."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "buckets": self.asked, "schema": None, "parts": {}, "batches": {}}
        fs, path = _fs(self.spark, f"{self.root}/manifest-{versions[-1]:012d}.json")
        stream = fs.open(path)
        try:  # a line a bucket
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        state = self.state()
        if state["schema"] is None:
            raise DataError(f"{self.root} has no table yet")
        return self._rows(state, buckets)

    def _rows(self, state: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        wanted = state["parts"] if buckets is None else {b: p for b, p in state["parts"].items() if int(b) in set(buckets)}
        paths = [f"{self.root}/{p}" for p in wanted.values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, state: dict | None = None) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit((state or self.state())["buckets"])).cast("int")

    def upsert(self, incoming: DataFrame, keep_first: Sequence[str] = (), order: str | None = None, batch: tuple[str, int] | None = None) -> list[int]:
        """Merge incoming rows by key; returns the buckets that were rewritten.

        Of incoming rows with one key the last by `order` stays; without an order, the one that a
        hash of its content puts last. keep_first columns keep a value that they have. batch
        (stream, number) makes a batch that was committed before a no-op.
        """
        state = self.state()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return []
        rows = settle(last_of_key(incoming, self.keys, order).withColumn("_bucket", self.bucket(state)))
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most the number of buckets
        new = rows.drop("_bucket")
        if state["schema"] is not None:
            new = upsert(self._rows(state, touched), new, self.keys, keep_first, ready=True)
        self._grow(self._commit(state, new, touched, batch=batch)["rows"], len(touched))
        forget(rows)
        return touched

    def replace(self, rows: DataFrame) -> dict:
        """All rows anew; keys must be unique. Returns what the write saw: rows and content (see content_hash)."""
        state = self.state()
        seen = self._commit(state, rows)
        self._grow(seen["rows"], state["buckets"])
        return seen

    def _grow(self, rows: int, buckets: int) -> None:
        """Deal the table into more buckets if those that were just written are too large.

        The number at least doubles, so over a table's life this costs a few times its size.
        """
        if buckets and rows > self.bucket_rows * buckets:
            self.rebucket(self.state()["buckets"] * max(2, -(-2 * rows // (self.bucket_rows * buckets))))

    def rebucket(self, buckets: int) -> None:
        """Deal the table anew."""
        state = self.state()
        self._commit(state, self._rows(state), buckets=buckets)

    def _commit(self, state: dict, rows: DataFrame, touched: Sequence[int] | None = None, buckets: int | None = None, batch: tuple[str, int] | None = None) -> dict:
        """Write rows as the buckets touched (all without a list), then the manifest that names them."""
        seen = {"rows": 0, "content": "0"}
        buckets = buckets or state["buckets"]
        parts = {} if touched is None else {b: p for b, p in state["parts"].items() if int(b) not in set(touched)}
        folder = f"data-{state['version'] + 1:012d}-{uuid.uuid4().hex}"
        if touched is None or touched:
            number = self.bucket({"buckets": buckets})
            dealt = rows.withColumn("_bucket", number).repartition(buckets if touched is None else len(touched), "_bucket").sortWithinPartitions("_bucket", *self.keys)
            watch = Observation()
            dealt = dealt.observe(watch, F.count("*").alias("rows"), content_hash(rows.columns).alias("content"))
            dealt.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
            seen = watch.get
            parts |= {n.split("=")[1]: f"{folder}/{n}" for n in _children(self.spark, f"{self.root}/{folder}") if n.startswith("_bucket=")}
        batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
        manifest = {"version": state["version"] + 1, "buckets": buckets, "schema": rows.schema.json(), "parts": parts, "batches": batches}
        self._publish(manifest)
        self._sweep(keep=[state, manifest])
        return seen

    def _publish(self, manifest: dict) -> None:
        fs, target = _fs(self.spark, f"{self.root}/manifest-{manifest['version']:012d}.json")
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest, indent=0).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise DataError(f"another writer has changed {self.root}")

    def _sweep(self, keep: Sequence[dict]) -> None:
        """Drop folders and manifests that neither the state nor the one before it names."""
        used = {p.split("/")[0] for m in keep for p in m["parts"].values()} | {f"manifest-{m['version']:012d}.json" for m in keep}
        half = {p for m in keep for p in m["parts"].values()}
        for name in _children(self.spark, self.root):
            if name.startswith(("data-", "manifest-", ".draft-")) and name not in used:
                fs, path = _fs(self.spark, f"{self.root}/{name}")
                fs.delete(path, True)
            elif name.startswith("data-"):
                for part in _children(self.spark, f"{self.root}/{name}"):
                    if part.startswith("_bucket=") and f"{name}/{part}" not in half:
                        fs, path = _fs(self.spark, f"{self.root}/{name}/{part}")
                        fs.delete(path, True)
