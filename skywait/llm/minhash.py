"""BagMinHash near-duplicate detection on word shingles.

Each shingle with weight w owns a Poisson process on [0, w): points arrive at exponential
times, each for one random signature component; a component's value is its first point.
The processes depend on the shingle alone, so two signatures agree in a component with
the probability of the weighted Jaccard similarity. Weights (counts) are cut into the
intervals [0,1), [1,2), [2,4), [4,8) ..., each with its own process. An interval's first
point halves it, down to the unit interval that holds the point; the halves beside the
path go on from its time, and what lies above the weight is left out. Every weight thus
sees the same points below it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle
from .common import broadcast_if_small, lean, list_parts, mix64, others_aside, slices, small_batches, word_hashes

SHINGLE = 5
COMPONENTS = 80
ROWS = 4
THRESHOLD = 0.8
SLICE_WORDS = 250_000


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and how many each text has; shorter texts are one shingle."""
    n, total = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1)), len(hashes)
    w = mix64(hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes)
    row = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(row)) + np.repeat((np.cumsum(counts) - counts) - (np.cumsum(n) - n), n)
    out, end = np.zeros(len(row), dtype=np.uint64), np.cumsum(counts)[row] if len(row) else at
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = at + k < end
            out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, w[np.minimum(at + k, max(0, total - 1))] if total else 0, np.uint64(k + 1))
    return mix64(out), n


def weighted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with how often it occurs: text numbers, shingles, weights."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], keys[first], np.diff(np.append(first, len(keys)))


def _draw(key: np.ndarray, low: np.ndarray, high: np.ndarray, nth: np.ndarray, use: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = low.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + high.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        salt += nth.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(use * 0x8EBC6AF09C88C6E3 % (1 << 64))
        return mix64(key ^ salt)


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, texts: int, components: int = COMPONENTS) -> np.ndarray:
    """First arrival of each component, [texts, components]; texts without shingles stay infinite."""
    sig = np.full(texts * components, np.inf)
    parts = [(np.arange(len(row)), np.zeros(len(row), dtype=np.int64), np.ones(len(row), dtype=np.int64))]
    level = 0
    while True:
        which = np.flatnonzero(weight > (1 << level))
        if not len(which):
            break
        parts.append((which, np.full(len(which), 1 << level), np.full(len(which), 2 << level)))
        level += 1
    item = np.concatenate([p[0] for p in parts])
    low, high = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    time, nth = np.zeros(len(item)), np.zeros(len(item), dtype=np.int64)
    while len(item):
        coin = _draw(key[item], low, high, nth, 1)
        time = time - np.log1p(-(coin >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (high - low)
        limit = sig.reshape(texts, components).max(1)
        live = time < limit[row[item]]
        item, low, high, time, nth = item[live], low[live], high[live], time[live], nth[live] + 1
        unit = high - low == 1
        _emit(sig, components, row, key, item[unit], low[unit], high[unit], time[unit], nth[unit])
        more = [(item[unit], low[unit], high[unit], time[unit], nth[unit])]
        wide = ~unit
        i, lo, hi, t = item[wide], low[wide], high[wide], time[wide]
        while len(i):  # the point falls into a half; the other half's process goes on from its time
            middle = (lo + hi) // 2
            right = (_draw(key[i], lo, hi, np.zeros_like(lo), 3) & np.uint64(1)) == 1
            other = (i, np.where(right, lo, middle), np.where(right, middle, hi), t)
            use = other[1] < weight[i]
            more.append((*(x[use] for x in other), np.zeros(int(use.sum()), dtype=np.int64)))
            lo, hi = np.where(right, middle, lo), np.where(right, hi, middle)
            use = lo < weight[i]
            i, lo, hi, t = i[use], lo[use], hi[use], t[use]
            unit = hi - lo == 1
            first = np.ones(int(unit.sum()), dtype=np.int64)
            _emit(sig, components, row, key, i[unit], lo[unit], hi[unit], t[unit], first)
            more.append((i[unit], lo[unit], hi[unit], t[unit], first))
            i, lo, hi, t = i[~unit], lo[~unit], hi[~unit], t[~unit]
        item, low, high, time, nth = (np.concatenate([m[k] for m in more]) for k in range(5))
    return sig.reshape(texts, components)


def _emit(sig, components, row, key, item, low, high, time, nth) -> None:
    if len(item):
        component = (_draw(key[item], low, high, nth, 2) % np.uint64(components)).astype(np.int64)
        np.minimum.at(sig, row[item] * components + component, time)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of `rows` components."""
    bits, out = sig.view(np.uint64), []
    with np.errstate(over="ignore"):
        for b in range(0, sig.shape[1], rows):
            h = np.full(len(sig), np.uint64(b + 1))
            for k in range(b, b + rows):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, k])
            out.append(h)
    return np.stack(out, 1).view(np.int64)


def connected(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach from each linked id.

    Labels spread along links and jump to their labels' labels, round by round, until none
    changes; every round is joins and minimum aggregates on settled tables.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    both = settle(both.where("id != other").distinct())
    labels = settle(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("theirs")), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        moved = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "theirs").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("far"))
        new = settle(moved.join(jump, "via", "left").select("id", "was", F.least("via", F.coalesce("far", "via")).alias("component")))
        labels = new.select("id", "component")
        if new.where("component != was").isEmpty():
            return labels


TILE = 256  # members of a component that a query is compared with at a time
PIVOTS = 4  # members of the largest component that the nodes outside meet first


def profiles(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, profile) of rows (id, hashes): the shingle multiset as a set of (shingle, occurrence) hashes."""

    @lean
    def run(batches):
        for b in batches:
            _, lengths = list_parts(b.column("hashes"))
            for lo, hi in slices(lengths, SLICE_WORDS):
                part = b.slice(lo, hi - lo)
                keys, many = shingles(*list_parts(part.column("hashes")), size)
                row, key, weight = weighted(keys, many)
                each = np.repeat(np.arange(len(key)), weight)
                nth = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
                with np.errstate(over="ignore"):
                    marked = mix64(key[each] + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                offsets = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(offsets, pa.array(marked.view(np.int64)))], ["id", "profile"])

    return rows.select("id", "hashes").mapInArrow(run, "id long, profile array<long>")


def _profiles_of(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, profile) of nodes (node, first_doc, k1, k2), from one copy of each text."""
    wanted = settle(nodes.select("node", "first_doc", "k1", "k2"))
    texts = docs.select("doc_id", "text").join(broadcast_if_small(wanted), docs["doc_id"].eqNullSafe(wanted["first_doc"]))
    hashed = texts.select("node", "k1", word_hashes(F.col("text")).alias("hashes"))
    # an id may occur with other texts: the words decide (not as a join key, which would split every text)
    same = F.xxhash64("hashes").bitwiseXOR(F.col("k1")) == 0
    return settle(profiles(hashed.where(same).select(F.col("node").alias("id"), "hashes"), size).dropDuplicates(["id"]))


def _verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose shingle multisets overlap by threshold (weighted Jaccard)."""
    pairs = settle(pairs.distinct())
    wanted = settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    mine = held.join(broadcast_if_small(wanted), "id")
    both = pairs.join(mine.select(F.col("id").alias("a"), F.col("profile").alias("pa")), "a").join(mine.select(F.col("id").alias("b"), F.col("profile").alias("pb")), "b")
    least = threshold * F.greatest(F.size("pa"), F.size("pb")) <= F.least(F.size("pa"), F.size("pb"))
    shared = F.size(F.array_intersect("pa", "pb"))
    alike = F.when(least, shared >= threshold * (F.size("pa") + F.size("pb") - shared)).otherwise(False)
    return settle(both.where(alike).select("a", "b"))


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, components: int = COMPONENTS, per_band: int = ROWS, size: int = SHINGLE, tile: int = TILE,
) -> DataFrame:
    """One row a document: doc_id, class_id (the smallest doc_id of its class), kept.

    Texts with equal words are one node. Nodes that agree in a band of the signature meet
    in a bucket; each is compared with the bucket's first node, so a group of copies costs
    its size. In a bucket that still holds several components, the nodes outside of the
    largest are compared with some of its members, and those still outside then with all
    of them and with one another, in tiles that report links only (no pair is a row). So
    every pair that meets in a bucket is in one class if it links. Pairs link at a weighted Jaccard similarity of
    threshold of their shingle multisets; classes are the links' components.
    Null texts are alone; blank ones are copies of each other; texts under `size` words are
    one shingle; repeated rows get equal classes; null ids never lead a class that has
    another id; texts of any length are sketched whole; other columns stay out; an empty table gives an empty result.
    """
    sketched, classed = _classes(docs, threshold, components, per_band, size, tile)
    heads = classed.groupBy("component").agg(F.min("first_doc").alias("class_id"))
    by_text = classed.join(heads, "component").select("k1", "k2", "class_id")
    out = sketched.where("not no_text").join(by_text, ["k1", "k2"]).select("doc_id", "class_id")
    alone = sketched.where("no_text").select("doc_id", F.col("doc_id").alias("class_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _classes(
    docs: DataFrame, threshold: float, components: int, per_band: int, size: int, tile: int, carried: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, no_text, k1, k2 ...) of each row, and (k1, k2, node, first_doc, component) of each text.

    k1 and k2 hash a text's words; carried names further long columns of docs to keep.
    """
    small_batches(docs.sparkSession)
    hashed = docs.select("doc_id", F.col("text").isNull().alias("no_text"), word_hashes(F.col("text")).alias("hashes"), *carried)
    keyed = hashed.select("doc_id", "no_text", F.xxhash64("hashes").alias("k1"), F.xxhash64(F.lit(1), "hashes").alias("k2"), "hashes", *carried)
    names = ["doc_id", "no_text", "k1", "k2", *carried]

    @lean
    def run(batches):
        for b in batches:
            _, lengths = list_parts(b.column("hashes"))
            for lo, hi in slices(lengths, SLICE_WORDS):
                part = b.slice(lo, hi - lo)
                keys, many = shingles(*list_parts(part.column("hashes")), size)
                row, key, weight = weighted(keys, many)
                sig = signatures(row, key, weight, part.num_rows, components)
                bands = band_keys(sig, per_band)
                n = np.where(many > 0, bands.shape[1], 0)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(bands[many > 0].reshape(-1)))
                yield pa.record_batch([*(part.column(c) for c in names), lists], [*names, "bands"])

    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, no_text boolean, k1 long, k2 long, {''.join(f'{c} long, ' for c in carried)}bands array<long>"
    sketched = settle(keyed.mapInArrow(run, schema))
    nodes = settle(
        sketched.where("not no_text").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    links = _links(nodes, docs, threshold, size, tile)
    parts = connected(links)
    classed = nodes.select("k1", "k2", "node", "first_doc").join(parts, nodes["node"] == parts["id"], "left")
    classed = classed.withColumn("component", F.coalesce("component", "node"))
    return sketched, classed


def _links(nodes: DataFrame, docs: DataFrame, threshold: float, size: int, tile: int) -> DataFrame:
    members = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    # buckets of one node are done
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    shared = settle(members.join(sizes, "bucket"))
    held = _profiles_of(nodes.join(shared.select("node").distinct(), "node"), docs, size)
    links = _verified(shared.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")), held, threshold)
    parts = connected(links)
    # nodes outside of their bucket's largest component meet some of its members ...
    out = settle(_outside(shared, parts))
    everyone = shared.select("node").distinct().join(parts, F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", "node").alias("top"))
    mine = settle(everyone.join(out.select("top").distinct(), "top"))
    rank = F.row_number().over(Window.partitionBy("top").orderBy(F.xxhash64("node")))
    pivots = mine.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).select("top", F.col("node").alias("pivot"))
    pairs = out.join(pivots, "top").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    links = settle(links.unionByName(_verified(pairs, held, threshold)))
    parts = connected(links)
    # ... and those that are still outside all of them and each other, in tiles
    out = settle(_outside(shared, parts))
    if out.isEmpty():
        return links
    everyone = shared.select("node").distinct().join(parts, F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", "node").alias("top"))
    group = everyone.join(out.select("top").distinct(), "top").select("top", "node").unionByName(out.select("top", "node")).distinct()
    component = everyone.select("node", F.col("top").alias("component"))
    sizes = group.groupBy("top").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = sizes.join(out.groupBy("top").agg(F.ceil(F.count("*") / (2 * tile)).cast("int").alias("asks")), "top")
    placed = group.join(sizes, "top").withColumn("query", F.lit(False)).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    asked = out.join(sizes, "top").withColumn("query", F.lit(True)).withColumn("ask", F.pmod(F.xxhash64("node"), F.col("asks")).cast("int"))
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    key = ["top", "tile", "ask"]
    # the tiles of a component go to partitions one after another: a hash would pile some up
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spot = F.pmod(F.xxhash64("top") + F.col("tile") * F.col("asks") + F.col("ask"), F.lit(tasks)).cast("int").alias("spot")
    both = placed.select(*key, spot, "node", "query").unionByName(asked.select(*key, spot, "node", "query"))
    rows = both.join(component, "node").join(held.withColumnRenamed("id", "node"), "node")

    @lean
    def compare(batches):
        now, parts = None, []
        for b in batches:
            frame = b.to_pandas()
            for at, part in frame.groupby(key, sort=False):
                if at != now:
                    if parts:
                        yield _tile_links(parts, threshold)
                    now, parts = at, []
                parts.append(part)
        if parts:
            yield _tile_links(parts, threshold)

    dealt = rows.select(*key, "spot", "node", "query", "component", "profile").repartitionById(tasks, F.col("spot")).sortWithinPartitions(*key)
    return settle(links.unionByName(dealt.mapInArrow(compare, "a long, b long")))


def _tile_links(parts: list[pd.DataFrame], threshold: float) -> pa.RecordBatch:
    """Links of a tile's queries to its members: one for each other component that a query reaches."""
    batch = pd.concat(parts)
    asked, here = batch[batch["query"]], batch[~batch["query"]]
    sizes = np.array([len(p) for p in here["profile"]], dtype=np.int64)
    node, part = here["node"].to_numpy(), here["component"].to_numpy()
    keys = np.concatenate(list(here["profile"])) if len(here) else np.empty(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(here)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    found = []
    for x, c, profile in zip(asked["node"], asked["component"], asked["profile"], strict=True):
        low, high = np.searchsorted(keys, profile, "left"), np.searchsorted(keys, profile, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(here))
        alike = np.flatnonzero((shared >= threshold * (len(profile) + sizes - shared)) & (part != c) & (node != x))
        _, first = np.unique(part[alike], return_index=True)
        found += [(x, y) for y in node[alike[first]]]
    ends = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _outside(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, top): nodes of buckets that hold several components, but for those of the largest, top."""
    named = shared.join(parts, shared["node"] == parts["id"], "left").withColumn("component", F.coalesce("component", "node"))
    counts = named.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    largest = F.max_by("component", F.struct("c", "component")).alias("top")
    mixed = counts.groupBy("bucket").agg(F.count("*").alias("parts"), largest).where("parts > 1")
    return named.join(mixed, "bucket").where("component != top").select("node", "top").distinct()


@others_aside("doc_id", "text")
def deduplicated(
    docs: DataFrame, threshold: float = THRESHOLD, components: int = COMPONENTS, per_band: int = ROWS, size: int = SHINGLE, tile: int = TILE,
) -> DataFrame:
    """docs with one row of each class of near copies; rows of null text stay, once for each id.

    A row's id and text decide, so rows without an id, or that share one, are judged by
    their texts. The row that stays has the smallest id of its class (a null id only if there
    is no other) and, if several texts of the class have it, the least text key. Other
    columns, whatever their names, go along.
    """
    keys = ("_t1", "_t2")
    marked = docs.withColumns({"_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(1), "text")})
    sketched, classed = _classes(marked, threshold, components, per_band, size, tile, keys)
    classed = settle(classed)
    first = F.struct(F.col("first_doc").isNull(), "first_doc", "k1", "k2")
    heads = classed.groupBy("component").agg(F.min_by(F.struct("k1", "k2", "first_doc"), first).alias("head")).select("head.*")
    same = [sketched["k1"] == heads["k1"], sketched["k2"] == heads["k2"], sketched["doc_id"].eqNullSafe(heads["first_doc"])]
    # one spelling of the head's words, and how many rows have it
    rows = sketched.where("not no_text").join(heads, same).select("doc_id", sketched["k1"], sketched["k2"], *keys)
    spelled = rows.groupBy("doc_id", "k1", "k2", *keys).agg(F.count("*").alias("_n")).groupBy("doc_id", "k1", "k2")
    texts = spelled.agg(F.min_by(F.struct(*keys, "_n"), F.struct(*keys)).alias("t")).select("doc_id", "t.*")
    blank = sketched.where("no_text").groupBy("doc_id", *keys).agg(F.count("*").alias("_n"))
    stay = settle(texts.unionByName(blank))
    gone = _absent(sketched.select("doc_id", *keys).distinct(), stay).withColumn("_n", F.lit(0).cast("long"))
    other = settle(gone.unionByName(stay.where("_n > 1")))
    few = broadcast_if_small(other)
    once = _absent(marked, few)
    again = marked.join(few.where("_n > 1"), _same_row(marked, few), "left_semi").dropDuplicates(["doc_id", *keys])
    out = once if other.where("_n > 1").isEmpty() else once.unionByName(again)
    return out.select(*docs.columns)


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_t1"] == b["_t1"]) & (a["_t2"] == b["_t2"])


def _absent(rows: DataFrame, others: DataFrame) -> DataFrame:
    return rows.join(others, _same_row(rows, others), "left_anti")
