"""Merkle manifest of a table: hash trees over its rows, inclusion proofs, and their check.

Each source is a tree over its rows, and the sources' roots are the leaves of a tree above.
A tree is worked on in aligned blocks of 16 ** LEVELS nodes. One distributed pass turns each
block into its root by a recursive postorder traversal; the block roots are the nodes of the
next pass, until one is left. On the way back down, a block's own path from above meets its
nodes, and the same traversal gives each of them its siblings while it unwinds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, settle
from .common import broadcast_if_small

FAN = 16
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"
_STEP = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: a row's number within its partition


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row's FIELDS: each `-` if null, else its UTF-8 byte count, ":" and its text."""
    texts = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def traverse(nodes: list[str], levels: int, fan: int = FAN, paths: list[list] | None = None) -> str:
    """The digest over nodes after so many levels, by postorder recursion.

    With paths (a list for each node), every node gets (siblings before, siblings after) of each
    level appended, lowest first.
    """

    def visit(low: int, high: int, level: int) -> str:
        if level == 0:
            return nodes[low]
        step = fan ** (level - 1)
        starts = range(low, high, step)
        children = [visit(a, min(a + step, high), level - 1) for a in starts]
        if paths is not None:
            for k, a in enumerate(starts):
                siblings = ("".join(children[:k]), "".join(children[k + 1 :]))
                for leaf in range(a, min(a + step, high)):
                    paths[leaf].append(siblings)
        return digest(children)

    return visit(0, len(nodes), levels)


def fold(node: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for before, after in path:
        node = digest((before, node, after))
    return node


def ranked(rows: DataFrame, tree: str, order: list[str], fan: int = FAN) -> DataFrame:
    """Add place (from 0, by order within the tree, nulls first) and height (levels up to its root); settled.

    Rows are dealt by ranges of (tree, order) and sorted there; how many rows of a tree earlier
    partitions hold is a window over one row a tree and partition. A tree of any size, and any
    number of equal rows, so spread over many partitions. tree must not be null.
    """
    numbered = settle(rows.withColumn("_row", F.monotonically_increasing_id()))
    keys = [tree, *order, "_row"]
    dealt = settle(
        numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))).drop("_row")
    )
    forget(numbered)
    runs = dealt.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(tree)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    total = F.sum("_n").over(whole)
    height = sum(((total > fan**k).cast("int") for k in range(1, int(62 / math.log2(fan)))), (total > 1).cast("int"))
    shifts = broadcast_if_small(settle(runs.select(tree, "_part", (before - F.col("_first")).alias("_shift"), height.alias("height"))))
    out = settle(dealt.join(shifts, [tree, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))
    forget(dealt)
    return out


def _in_blocks(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """nodes with block (place of their root in the next pass) and up (levels that this pass takes)."""
    up = F.least(F.col("height"), F.lit(levels))
    return nodes.withColumn("up", up).withColumn("block", F.floor(F.col("place") / F.pow(F.lit(float(fan)), up)).cast("long"))


def climb(leaves: DataFrame, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """Passes over (tree, place, height, node): settled tables of the same columns, from the leaves up.

    The last holds roots alone; a tree that is done earlier goes along as it is.
    """

    def root(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        up = group["up"][0].as_py()
        one = group.slice(0, 1)
        top = traverse(group["node"].to_pylist(), up, fan)
        return pa.table({"tree": one["tree"], "place": one["block"], "height": pa.array([one["height"][0].as_py() - up], pa.int32()), "node": pa.array([top])})

    passes = [leaves]
    while passes[-1].agg(F.max("height")).first()[0]:
        blocks = _in_blocks(passes[-1].select("tree", "place", "height", "node"), fan, levels)
        passes.append(settle(blocks.groupBy("tree", "block").applyInArrow(root, "tree string, place long, height int, node string")))
    return passes


def _descend(nodes: DataFrame, above: DataFrame, fan: int, levels: int) -> DataFrame:
    """(tree, place, path, root) of nodes, given the same of their blocks' roots."""

    def spread(group: pa.Table, over: pa.Table) -> pa.Table:
        group, paths = group.sort_by("place"), [[] for _ in range(group.num_rows)]
        traverse(group["node"].to_pylist(), group["up"][0].as_py(), fan, paths)
        upper = over["path"][0].as_py()
        whole = [[{"before": b, "after": a} for b, a in p] + upper for p in paths]
        return pa.table({"tree": group["tree"], "place": group["place"], "path": pa.array(whole, _STEP), "root": pa.array([over["root"][0].as_py()] * len(whole), pa.string())})

    mine = _in_blocks(nodes.select("tree", "place", "height", "node"), fan, levels).groupBy("tree", "block")
    theirs = above.withColumnRenamed("place", "block").groupBy("tree", "block")
    return mine.cogroup(theirs).applyInArrow(spread, f"tree string, place long, path {_PATH}, root string")


def paths(passes: list[DataFrame], tops: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(tree, place, path, root) of the leaves' block roots; tops has the same of the trees' roots, i.e. what lies above them."""
    above = tops
    for nodes in reversed(passes[1:-1]):
        above = settle(_descend(nodes, above, fan, levels))
    return above


def manifest(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs has doc_id, source, lang, n_chars and text; other columns stay out. A source's leaves
    ascend by doc_id (null first), then by digest, so rows of one id have a defined order and
    equal rows are leaves of their own, told apart by nothing but their place. A null source is
    a tree of its own, before all others; texts count whole; null, empty and blank texts differ.
    Rows whose id's crc32 is divisible by 5 are folded from a tampered leaf, with A-Z of the
    text in lower case; rows with a null id are not tampered. A path holds the siblings of at
    most FAN nodes a level. An empty table gives an empty result.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = leaf_digest(text=F.translate(F.col("text"), UPPER, LOWER))
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = docs.select("doc_id", tree.alias("tree"), leaf_digest().alias("node"), F.when(tampered, changed).alias("shown"))
    leaves = ranked(rows, "tree", ["doc_id", "node"], fan)
    passes = climb(leaves, fan, levels)
    roots = passes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    subroots = ranked(roots, "tree", ["name"], fan)  # null first, as its name is the empty text
    above = climb(subroots, fan, levels)
    root, nothing = above[-1].select("node").first(), F.array().cast(_PATH)
    tops = above[-1].select("tree", "place", nothing.alias("path"), F.col("node").alias("root"))
    found = _descend(subroots, paths(above, tops, fan, levels), fan, levels) if len(above) > 1 else tops
    over = subroots.join(found.select("place", "path"), "place").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("node").alias("root"))
    blocks = paths(passes, settle(over), fan, levels)
    whole = root[0] if root else ""

    def proofs(group: pa.Table, upper: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        own, nodes = [[] for _ in range(group.num_rows)], group["node"].to_pylist()
        traverse(nodes, group["up"][0].as_py(), fan, own)
        rest = [(s["before"], s["after"]) for s in upper["path"][0].as_py()]
        shown = [a or b for a, b in zip(group["shown"].to_pylist(), nodes, strict=True)]
        folded = [fold(node, [*path, *rest]) for node, path in zip(shown, own, strict=True)]
        proof = [digest(side for step in [*path, *rest] for side in step) for path in own]
        n = len(nodes)
        return pa.table({
            "doc_id": group["doc_id"], "leaf": group["node"], "subroot": pa.array([upper["root"][0].as_py()] * n, pa.string()), "root": pa.array([whole] * n, pa.string()),
            "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == whole for f in folded], pa.bool_()),
        })

    mine = _in_blocks(leaves, fan, levels).groupBy("tree", "block")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return mine.cogroup(blocks.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(proofs, schema)
