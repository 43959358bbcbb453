"""Embedding near-duplicates by a forest of random-projection trees.

Every tree begins with one leaf for all vectors of a label. As long as leaves are too
large, each gets a subtree of random splits, fitted on a bounded sample of the leaf's own
vectors, and deals all of them to its leaves; vectors within a margin of a threshold go to
both sides (spill). Vectors are compared within leaves only, by exact cosine in double
precision; a pair that shares several leaves counts in the first. Equal vectors travel as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, settle
from .common import list_parts, mix64, small_batches
from .minhash import connected

TREES = 8
LEAF = 192
FULL = 4  # leaves of over so many times LEAF vectors are split again
SPILL = 0.03  # each split copies the vectors about its threshold, so copies grow with the depth; eight trees make up for a small margin
COSINE = 0.93
SAMPLE = 8192  # vectors of a leaf on which its subtree is fitted, at most about so many
SAMPLE_LEAF = 12  # of those, in a leaf of the subtree at least
TILE = 1024
MOST_BOTH = 0.5  # a split must send no more than this share to both sides
TRIES = 4  # directions tried for a split
CHUNK = 20_000  # vectors that a task deals to a subtree
COLUMNS = 4096


def grow(sample: np.ndarray, leaf: int, spill: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, thresholds, [left, right] children) of nodes; leaves have child -1.

    Splits are at the median projection on the difference of two random members, until leaves
    are small. Members too alike to part (most would go to both sides) stay together.
    """
    direction, threshold, child = [], [], []

    def node(rows: np.ndarray) -> int:
        k = len(child)
        direction.append(np.zeros(sample.shape[1]))
        threshold.append(0.0)
        child.append([-1, -1])
        for _ in range(TRIES if len(rows) > leaf else 0):
            a, b = rng.choice(rows, 2, replace=False)
            d = sample[a] - sample[b] + 1e-3 * rng.standard_normal(sample.shape[1])
            d /= np.linalg.norm(d)
            p = sample[rows] @ d
            cut = float(np.median(p))
            left, right = rows[p < cut], rows[p >= cut]
            if len(left) and len(right) and (np.abs(p - cut) < spill).mean() <= MOST_BOTH:
                direction[k], threshold[k] = d, cut
                child[k] = [node(left), node(right)]
                break
        return k

    node(np.arange(len(sample)))
    return np.array(direction), np.array(threshold), np.array(child)


def leaves(direction: np.ndarray, threshold: np.ndarray, child: np.ndarray, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all leaves that each row of x reaches."""
    out_row, out_leaf, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if child[k, 0] < 0:
            out_row.append(rows)
            out_leaf.append(np.full(len(rows), k))
            continue
        p = x[rows] @ direction[k] - threshold[k]
        todo += [(c, r) for c, r in ((child[k, 0], rows[p < spill]), (child[k, 1], rows[p >= -spill])) if len(r)]
    return np.concatenate(out_row), np.concatenate(out_leaf)


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, in double precision, of a column of finite vectors of one length, none zero."""
    values, lengths = list_parts(column)
    x = values.astype(np.float64).reshape(len(lengths), -1)
    x = x / np.abs(x).max(1)[:, None]  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1)[:, None]


def met_before(places: pa.ChunkedArray, i: np.ndarray, j: np.ndarray, place: int) -> np.ndarray:
    """Which pairs of rows share a place below this one."""
    values, lengths = list_parts(places)
    row = np.repeat(np.arange(len(lengths)), lengths)
    used = np.zeros(len(lengths), dtype=bool)
    used[i] = used[j] = True
    some = used[row] & (values < place)
    names, column = np.unique(values[some], return_inverse=True)
    often = np.bincount(column, minlength=len(names)) > 1  # a place of one row is no pair's
    keep = often[column]
    row, column = (np.cumsum(used) - 1)[row[some][keep]], (np.cumsum(often) - 1)[column[keep]]
    i, j = (np.cumsum(used) - 1)[i], (np.cumsum(used) - 1)[j]
    met = np.zeros(len(i), dtype=bool)
    for a in range(0, int(often.sum()), COLUMNS):
        held = np.zeros((int(used.sum()), COLUMNS), dtype=np.float32)
        mine = (column >= a) & (column < a + COLUMNS)
        held[row[mine], column[mine] - a] = 1
        met |= (held @ held.T)[i, j] > 0
    return met


def met_links(x: pa.Table, y: pa.Table | None, place: int, cosine: float) -> pa.Table:
    """(node, n, link): each row's linked weight and one link to its component, for pairs that first meet at place.

    Pairs are those of x with y, or those within x.
    """
    both = pa.concat_tables([x, y]) if y is not None else x
    if not both.num_rows or (y is not None and not (x.num_rows and y.num_rows)):
        return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "link": pa.array([], pa.int64())})
    node, weight, unit = both.column("node").to_numpy(), both.column("weight").to_numpy(), unit_rows(both.column("embedding"))
    hit = unit @ unit.T >= cosine if y is None else unit[: x.num_rows] @ unit[x.num_rows :].T >= cosine
    i, j = np.nonzero(np.triu(hit, 1) if y is None else hit)
    j = j if y is None else j + x.num_rows
    if len(i):
        first = ~met_before(both.column("places"), i, j, place)
        i, j = i[first], j[first]
    n = np.bincount(i, weights=weight[j], minlength=len(node)) + np.bincount(j, weights=weight[i], minlength=len(node))
    linked = np.flatnonzero(n)
    return pa.table({"node": node[linked], "n": n[linked].astype(np.int64), "link": node[_roots(len(node), i, j)[linked]]})


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first row of each row's component under links i - j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _split(assigned: DataFrame, full: DataFrame, leaf: int, spill: float, sample: int, seed: int) -> DataFrame:
    """assigned (label, node, weight, embedding, places) with the leaves of full (label, place, n) split by a subtree each."""
    kind = assigned.schema["label"].dataType.simpleString()
    each = assigned.select("label", "node", "embedding", F.explode("places").alias("place")).join(full, ["label", "place"])
    draw = F.pmod(F.xxhash64(F.lit(seed), "node", "place"), F.lit(1 << 30)) < F.lit(sample) / F.col("n") * (1 << 30)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        n, place = int(group["n"].iloc[0]), int(group["place"].iloc[0])
        group = group.sort_values("node")
        x = unit_rows(pa.array(group["embedding"].tolist(), pa.list_(pa.float64())))
        size = max(SAMPLE_LEAF, leaf * len(x) // n)
        direction, threshold, child = grow(x, size, spill, np.random.default_rng([seed, place & (2**63 - 1)]))
        return pd.DataFrame({"label": group["label"].iloc[:1].to_numpy(), "place": [place], "n": [n], "direction": [direction.reshape(-1)], "threshold": [threshold], "child": [child.reshape(-1)]})

    fitted = settle(each.where(draw).groupBy("label", "place").applyInPandas(fit, f"label {kind}, place long, n long, direction array<double>, threshold array<double>, child array<int>"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = each.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    trees = fitted.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    place = ["label", "place", "chunk"]

    def deal(rows: pa.Table, tree: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "old": pa.array([], pa.int64()), "new": pa.array([], pa.list_(pa.int64()))})
        node, old = rows.column("node").to_numpy(), rows.column("place")[0].as_py()
        x = unit_rows(rows.column("embedding"))
        direction, threshold, child = (tree.column(c)[0].values.to_numpy() for c in ("direction", "threshold", "child"))
        row, k = leaves(direction.reshape(len(threshold), -1), threshold, child.reshape(-1, 2), x, spill)
        order = np.argsort(row, kind="stable")
        new = (mix64(np.array([old])) ^ mix64(k + 1)).view(np.int64)[order]
        new = new | 1 if child[0] < 0 else new & ~1  # odd places are settled: their vectors cannot be parted
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))])
        return pa.table({"node": node, "old": np.full(len(x), old), "new": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(new))})

    moved = members.groupBy(*place).cogroup(trees.groupBy(*place)).applyInArrow(deal, "node long, old long, new array<long>")
    moves = moved.groupBy("node").agg(F.collect_list("old").alias("_old"), F.flatten(F.collect_list("new")).alias("_new"))
    places = F.when(F.col("_old").isNull(), F.col("places")).otherwise(F.concat(F.array_except("places", "_old"), F.col("_new")))
    return settle(assigned.join(moves, "node", "left").select("label", "node", "weight", "embedding", places.alias("places")))


def forest(reps: DataFrame, trees: int, leaf: int, spill: float, sample: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(reps with places, (label, place, n) of all leaves): each vector's leaves in all trees."""
    roots = [F.xxhash64("label", F.size("embedding"), F.lit(seed), F.lit(t)).bitwiseAND(F.lit(-2)) for t in range(trees)]
    assigned = settle(reps.withColumn("places", F.array(*roots)))
    while True:
        counts = settle(assigned.select("label", F.explode("places").alias("place")).groupBy("label", "place").agg(F.count("*").alias("n")))
        full = counts.where((F.col("n") > FULL * leaf) & (F.col("place").bitwiseAND(F.lit(1)) == 0))
        if full.isEmpty():
            return assigned, counts
        before, assigned = assigned, _split(assigned, full, leaf, spill, sample, seed)
        forget(before)


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, tile: int = TILE, seed: int = 11,
) -> DataFrame:
    """One row a vector (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null and their cosine is at least
    `cosine`. Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing; vectors of different lengths do not link. n_links counts the other vectors linked directly;
    component_id is the smallest vec_id in reach; kept rows are their own component.
    Each subtree is fitted on about `sample` rows at most (by hash); every row is indexed, and
    leaves are split again until they hold at most FULL times `leaf` rows, so their size does not grow with the table. A leaf
    with more than `tile` rows (vectors too alike to part) is compared in pairs of tiles, each a task's work of its
    own. Rows with one vec_id, or none, are vectors of their own; other columns stay out; an
    empty table gives an empty result.
    """
    small_batches(vectors.sparkSession)
    rows = settle(vectors.select("vec_id", "embedding", "label").withColumn("node", F.monotonically_increasing_id()))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.where(F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)))
    equal = ["label", "h1", "h2"]
    keyed = usable.select("node", "label", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    heads = settle(keyed.groupBy(*equal).agg(F.min("node").alias("head"), F.count("*").alias("weight")))
    reps = usable.join(heads.select(F.col("head").alias("node"), "weight"), "node").select("label", "node", "weight", "embedding")
    assigned, counts = forest(reps, trees, leaf, spill, sample, seed)

    # leaves of one vector are done; large ones are cut into tiles by hash, and every pair of tiles is a group
    tiles = counts.where("n > 1").select("label", "place", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    each = assigned.select("label", "node", "weight", "places", "embedding", F.explode("places").alias("place")).join(tiles, ["label", "place"])
    each = each.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = each.withColumn("low", F.least("tile", "mate")).withColumn("high", F.greatest("tile", "mate")).drop("mate", "tiles")

    def compare(group: pa.Table) -> pa.Table:
        place, low, high = (group.column(c)[0].as_py() for c in ("place", "low", "high"))
        if low == high:
            return met_links(group, None, place, cosine)
        mine = group.column("tile").to_numpy() == low
        return met_links(group.filter(pa.array(mine)), group.filter(pa.array(~mine)), place, cosine)

    met = settle(paired.groupBy("label", "place", "low", "high").applyInArrow(compare, "node long, n long, link long"))
    sums = met.groupBy("node").agg(F.sum("n").alias("n"))
    parts = connected(met.select(F.col("node").alias("a"), F.col("link").alias("b")))
    part = heads.join(sums, F.col("head") == F.col("node"), "left").drop("node").join(parts, F.col("head") == F.col("id"), "left")
    part = part.select(*equal, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "head").alias("component"))
    mine = keyed.join(part, equal).select(F.col("node").alias("id"), "n_links", "component")
    named = rows.select("vec_id", "node").join(mine, F.col("node") == F.col("id"), "left")
    named = settle(named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component")))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return named.join(least, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
