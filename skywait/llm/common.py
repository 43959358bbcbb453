"""What several operators share: words, running offsets, batch slices."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class; words are the runs between.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches to 8 MB, unless the session has a bound of its own.

    A worker holds a few batches at a time, in and out, so this bounds its memory whatever
    the texts' lengths.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":  # Spark's default
        spark.conf.set(key, "8m")


def lean(run: Callable) -> Callable:
    """run (a function of batches), giving freed memory back when a task's batches are done.

    Python workers stay for later stages; without this an idle one keeps the most it ever held.
    """

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return tidy


def words(text: Column) -> Column:
    """Words of a text (runs without ASCII white space); null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_hashes(text: Column) -> Column:
    """One 64-bit hash for each word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def others_aside(*used: str) -> Callable:
    """For a function from docs to rows of docs: columns other than `used` go through under numbers.

    So none of them, whatever its name, meets a column that the function makes for itself.
    """

    def wrap(run: Callable) -> Callable:
        @functools.wraps(run)
        def named(docs: DataFrame, *args, **options) -> DataFrame:
            inside = [c.lower() if c.lower() in used else f"_aside_{k}" for k, c in enumerate(docs.columns)]
            return run(docs.toDF(*inside), *args, **options).toDF(*docs.columns)

        return named

    return wrap


def broadcast_if_small(df: DataFrame, most: int = 32_000_000) -> DataFrame:
    """df, marked for a broadcast if its measured bytes are few; larger ones are left to a shuffle."""
    size = F.lit(0)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        own = F.octet_length(c) if kind in ("string", "binary") else 32 * F.size(c) if kind.startswith("array") else F.lit(0)
        size = size + F.lit(16) + F.coalesce(own, F.lit(0))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def is_training(doc_id: Column, folds: int, held_out: int) -> Column:
    """True where crc32(doc_id as text) mod folds is not held_out. A null id counts as text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds != held_out


def chunk_count(rows: int, per_chunk: int = 20_000, least: int = 256) -> int:
    return max(least, -(-rows // per_chunk))


def running_offsets(
    rows: DataFrame, group: str, order: Sequence[str], size: Column, chunks: int
) -> DataFrame:
    """Add start (sum of the sizes before a row in its group) and place (rows before it).

    A group may hold most of all rows, so it is cut into chunks by a hash of the order
    columns: each chunk is summed alone, and the chunks' totals (chunks rows a group)
    give each chunk its base. Rows follow (chunk, order columns). group must not be null.
    """
    dealt = rows.withColumn("_size", size.cast("long")).withColumn(
        "_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks))
    )
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy(group, "_chunk")
        .agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows"))
        .select(
            group,
            "_chunk",
            F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        )
    )
    inside = Window.partitionBy(group, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dealt.withColumn("_start", F.sum("_size").over(upto) - F.col("_size"))
        .withColumn("_place", F.row_number().over(inside) - 1)
        .join(bases, [group, "_chunk"])
        .withColumn("start", F.col("_start") + F.col("_base"))
        .withColumn("place", F.col("_place") + F.col("_rows_before"))
        .drop("_size", "_chunk", "_start", "_place", "_base", "_rows_before")
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads unsigned integers over all bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose weights sum to about most; one heavy row stands alone."""
    if not len(weights):
        return
    part = np.cumsum(weights) // max(1, most)
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(weights)], strict=True)


def list_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of a list column of fixed-width values (null rows are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), lengths.astype(np.int64)


def text_bytes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
