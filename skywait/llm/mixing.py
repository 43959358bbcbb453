"""Mixing sources to target weights, in fixed-length blocks of words.

Each source is a stream of its documents' words, cut into blocks. Output shards draw how
many blocks they take from each source; a source's draws are slots, and a keyed
permutation of its block numbers turns slots into blocks. Only block numbers travel: the
join is by (source, block), never by document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import settle
from .common import chunk_count, lean, mix64, n_words, others_aside, running_offsets, words

BLOCK = 256
SHARD_BLOCKS = 4096
TASK_SHARDS = 8
BROADCAST_SOURCES = 10_000


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Share all words by weight; no source gets over most times its own size.

    What a source cannot take is shared again by weight among the rest.
    """
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = [k for k, s in enumerate(sizes) if s], total
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if unit * weights[k] > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ = [k for k in open_ if k not in full]
    return out


LIBRARY_MOST = 1_000_000_000  # numpy draws from populations below this


def hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """How many of `sample` places, drawn without replacement, are among the `good` ones.

    Exact at any size: above what the library draws, the distribution is inverted. Its
    weights relative to the mode's follow from their ratios; ten standard deviations to
    either side hold all that a double can tell from 1.
    """
    if good + bad < LIBRARY_MOST:
        return int(rng.hypergeometric(good, bad, sample))
    total, low, high = good + bad, max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = 20 + int(10 * (sample * share * (1 - share) * max(0.0, 1 - sample / total)) ** 0.5)
    at = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    step = np.log(good - at[:-1]) + np.log(sample - at[:-1]) - np.log(at[:-1] + 1) - np.log(bad - sample + at[:-1] + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    upto = np.cumsum(np.exp(weight - weight.max()))
    return int(at[np.searchsorted(upto, rng.random() * upto[-1], side="right").clip(0, len(at) - 1)])


def _head(counts: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of counts fall into the first `size` of all places, dealt without replacement."""
    total = int(counts.sum())
    if total < LIBRARY_MOST:
        return rng.multivariate_hypergeometric(counts, size, method="marginals") if total else counts * 0
    out, rest, left = np.zeros_like(counts), total, size
    for k, n in enumerate(counts.tolist()):  # each source's share of what the ones before it leave
        rest -= n
        out[k] = hypergeometric(n, rest, left, rng) if n and rest else min(n, left)
        left -= int(out[k])
    return out


def shard_draws(quotas: np.ndarray, shards: int, shard: int, seed: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(draws of each source in earlier shards, draws of each source in this one).

    Multinomial draws for shards of equal size, conditioned on the sources' quotas (so a
    shard's counts are random and the totals are exact). Ranges of shards are halved down to
    the shard, each range with a generator of its own, so every task finds a shard's draws alone.
    known keeps ranges that a task meets again.
    """
    left, before, lo, hi = np.array(quotas, dtype=np.int64), np.zeros(len(quotas), dtype=np.int64), 0, shards
    total, known = int(left.sum()), {} if known is None else known
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if (lo, hi) not in known:
            known[lo, hi] = _head(left, total * mid // shards - total * lo // shards, np.random.default_rng([seed, lo, hi]))
        head = known[lo, hi]
        if shard < mid:
            left, hi = head, mid
        else:
            before, left, lo = before + head, left - head, mid
    return before, left


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 under key, at index (arrays).

    A swap-or-not shuffle: in each round an index moves to its mirror image about a keyed
    pivot if a keyed coin of the pair says so. Every round is its own inverse, so the whole
    is a bijection for any n.
    """

    with np.errstate(over="ignore"):
        for r in range(24):
            base = mix64(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1))
            pivot = (base % n.astype(np.uint64)).astype(np.int64)
            mirror = (pivot - index) % n
            coin = mix64(base ^ np.maximum(index, mirror).astype(np.uint64)) & np.uint64(1)
            index = np.where(coin == 1, mirror, index)
    return index


def _source_table(docs: DataFrame, weights: Sequence[float]) -> list[dict]:
    """One entry a source (a curated list), by code point, null last."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    shares = targets([r.n for r in rows], [weights[k % len(weights)] for k in range(len(rows))])
    return [
        {"source": r.source, "source_id": k, "source_size": int(r.n), "target": shares[k], "rows": r.rows}
        for k, r in enumerate(rows)
    ]


def _slots(spark: SparkSession, table: list[dict], block: int, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, slot, source_id, epoch, block, words): every block that the mix takes."""
    quotas, parts = [], []
    for t in table:
        n = -(-t["source_size"] // block)
        whole = int(t["target"] // t["source_size"]) if n else 0
        rest = round(t["target"] - whole * t["source_size"]) if n else 0
        last = min(n, -(-rest // block))
        quotas.append(whole * n + last)
        parts.append((n, whole * n + last - 1, rest - (last - 1) * block if last else block))
        t["epochs"] = whole
    quotas, parts = np.array(quotas, dtype=np.int64), np.array(parts, dtype=np.int64).reshape(-1, 3)
    shards = max(1, -(-int(quotas.sum()) // shard_blocks))

    @lean
    def draw(batches):
        known: dict = {}
        for b in batches:
            for shard in b.column("id").to_pylist():
                before, draws = shard_draws(quotas, shards, shard, seed, known)
                source = np.repeat(np.arange(len(draws)), draws)
                slot = np.arange(len(source)) - np.repeat(np.cumsum(draws) - draws, draws)
                index, n, final, cut = before[source] + slot, *(parts[source, c] for c in range(3))
                epoch = index // np.maximum(n, 1)
                with np.errstate(over="ignore"):
                    key = mix64(source.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + epoch.astype(np.uint64)) ^ np.uint64(seed)
                at = permuted(index % np.maximum(n, 1), np.maximum(n, 1), key)
                columns = [np.full(len(source), shard, dtype=np.int32), slot, source.astype(np.int32), epoch, at, np.where(index == final, cut, block)]
                yield pa.record_batch([pa.array(c) for c in columns], ["shard", "slot", "source_id", "epoch", "block", "words"])

    tasks = spark.range(0, shards, 1, -(-shards // TASK_SHARDS))
    return tasks.mapInArrow(draw, "shard int, slot long, source_id int, epoch long, block long, words long")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    block: int = BLOCK,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Draw the mix of docs (doc_id, source, text; other columns stay out).

    Returns (documents, pieces). documents: _row (a number of the row), doc_id, source,
    size (words), source_size, target. pieces: (shard, slot, source_id, epoch, block, _row,
    doc_id, from_word, to_word): the words of documents that each drawn block holds. Each epoch of
    a source takes every block once and a target is at most 3 times its source, so no
    document is taken more than 3 times. Null sources are a source of their own; texts
    without words have size 0 and are in no block; repeated rows are separate documents;
    an empty table gives empty results. Equal seeds and inputs give equal mixes.
    """
    spark = docs.sparkSession
    sized = settle(docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), n_words(F.col("text")).alias("size")))
    table = _source_table(sized, weights)
    slots = _slots(spark, table, block, shard_blocks, seed)
    known = spark.createDataFrame(
        [(t["source"], t["source_id"], t["source_size"], t["target"], t["epochs"]) for t in table],
        "source_name string, source_id int, source_size long, target double, epochs long",
    )
    known = F.broadcast(known) if len(table) <= BROADCAST_SOURCES else known
    tagged = sized.join(known, sized["source"].eqNullSafe(known["source_name"])).drop("source_name")
    chunks = chunk_count(sum(t["rows"] for t in table))
    order = ["doc_id", "text_key", "size"]
    documents = settle(
        running_offsets(tagged, "source_id", order, F.col("size"), chunks)
        .withColumn("_row", F.shiftleft(F.col("source_id").cast("long"), 40) + F.col("place"))
        .drop("place")
    )
    spans = (
        documents.where("size > 0")
        .select("source_id", "_row", "doc_id", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
        .withColumn("low", F.greatest("start", F.col("block") * block))
        .withColumn("high", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block))
    )
    inside = F.least("high", F.col("block") * block + F.col("words"))
    pieces = (
        spans.join(slots.hint("merge"), ["source_id", "block"])  # both sides grow with the data
        .withColumn("high", inside)
        .where("high > low")
        .select("shard", "slot", "source_id", "epoch", "block", "_row", "doc_id", (F.col("low") - F.col("start")).alias("from_word"), (F.col("high") - F.col("start")).alias("to_word"))
    )
    return documents, pieces


def taken_words(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """documents with taken: the words that the mix holds of each, repeats counted."""
    sums = pieces.groupBy("_row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_taken"))
    return documents.join(sums, "_row", "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).drop("_taken")


@others_aside("doc_id", "source", "text", "n_chars")
def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs: a document appears once for each time that it is taken.

    An epoch that takes every block of a source gives whole texts; the last, partial one
    gives the words that its blocks hold of a document, joined by single spaces, in order.
    n_chars, if there, follows the text. Documents that the mix does not take are left out.
    Rows that are equal in id, source and text are taken one by one. Other columns, whatever
    their names, go along.
    """
    keys = ["doc_id", "source", "_text_key"]
    documents, pieces = mix(docs, **options)
    last = pieces.join(documents.select("_row", "epochs"), "_row").where("epoch = epochs")
    spans = last.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("_rest"))
    none = F.array().cast("array<struct<from_word:bigint,to_word:bigint>>")
    plan = documents.join(spans, "_row", "left").select("doc_id", "source", F.col("text_key").alias("_text_key"), F.col("epochs").alias("_whole"), F.coalesce("_rest", none).alias("_rest"), F.col("size").alias("_words"))
    plan = settle(plan)
    repeated = settle(plan.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    keyed = docs.withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    if repeated.isEmpty():
        joined = _match(keyed, plan, keys)
    else:  # equal rows are numbered alike on both sides; all others need no number
        again, ours = (_numbered(t.join(repeated, _equal(t, repeated, keys), "left_semi"), keys) for t in (keyed, plan))
        once = _match(keyed.join(repeated, _equal(keyed, repeated, keys), "left_anti"), plan.join(repeated, _equal(plan, repeated, keys), "left_anti"), keys)
        joined = once.unionByName(_match(again, ours, [*keys, "_twin"]).drop("_twin"))
    taken = joined.where("_words > 0 and (_whole > 0 or size(_rest) > 0)")

    def part(split: Column) -> Column:
        return F.concat_ws(" ", F.flatten(F.transform("_rest", lambda s: F.slice(split, (s["from_word"] + 1).cast("int"), (s["to_word"] - s["from_word"]).cast("int")))))

    # the words stand in an array of one, so that a text is split once and not for each of its spans
    rest = F.when(F.size("_rest") > 0, F.transform(F.array(words(F.col("text"))), part)).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(F.col("text"), F.col("_whole").cast("int")), rest)
    out = taken.withColumn("_out", F.explode(texts))
    kept = [F.col("_out").alias(c) if c == "text" else F.length("_out").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return out.select(*kept)


def _equal(a: DataFrame, b: DataFrame, keys: list[str]) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def _match(docs: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """docs' rows with their plan."""
    mine = plan.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [docs[k].eqNullSafe(mine[f"_of_{k}"]) for k in keys]
    return docs.join(mine, same).drop(*[f"_of_{k}" for k in keys])


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number rows that are equal in keys, so that each joins with one."""
    return rows.withColumn("_twin", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
