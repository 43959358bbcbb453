"""Context-tree weighting over the running bytes of a text.

A text is coded as its lower-cased words, a space after each, and a line feed. The context
of a byte is the DEPTH bytes before it, across words; a space leads the text, and 0 stands
before that. A byte is eight binary decisions; each decision has Krichevsky-Trofimov counts
at every context depth, and context-tree weighting mixes all depths. Counts come from the
training documents alone and stay fixed.

Texts are dealt into blocks by hash. A block's distinct (context, byte) pairs and distinct
words go to groups, where the blocks' counts add up to tables that grow with the corpus:
FAN_IN blocks to one, again and again, each time in more and smaller groups, so neither the
rows of a block nor the size of a group grows with the corpus.
Subtrees are weighted in groups by the last four bytes of the context, the depths from four to
two in fewer groups by the last two bytes, and the two depths above for each of the eight
decisions; so no two or three frequent bytes make a group. Then the rounds are gone back: tables of many blocks
get what the whole has for their own pairs and words, then tables of fewer, at last every
block, whose texts are scored beside that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, settle
from .common import is_training, lean, mix64, slices, small_batches, text_bytes

#: A context and its byte fit one 64-bit key, sign aside.
DEPTH = 6
#: Depths at which the tree is cut: pairs are grouped below LOW, its nodes between LOW and HIGH.
LOW, HIGH = 4, 2
#: Bytes of texts in a block, and in a slice of one that is worked on at a time.
BLOCK_BYTES, SLICE_BYTES = 24_000_000, 3_000_000
#: Bytes of texts for each group of the whole.
GROUP_BYTES = 16_000_000
#: Groups that a block sends rows to at most, and into how many a round parts each (the last one parts them as far as it must).
LANES, PARTED = 4096, 64
#: Tables that a task adds up before another round.
FAN_IN = 512
#: Groups of pairs for each group of the nodes above them.
PAIRS_A_NODE_GROUP = 128
#: Code lengths travel as whole numbers of this fraction of a decimal digit.
SCALE = 1 << 16
LEAD, END = b"\0" * (DEPTH - 1) + b" ", b"\n"
WORDS, BYTES = 0, 1  # kinds of tables


def joined(texts: pa.Array) -> pa.Array:
    """Lower-cased texts with one space between words and none around."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    return pc.binary_join(pc.ascii_split_whitespace(bare), " ")


def byte_steps(plain: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every coded byte of joined() texts; a key is the context's DEPTH bytes, then the byte."""
    tail = pc.if_else(pc.greater(pc.binary_length(plain), 0), b" " + END, END)
    whole = pc.binary_join_element_wise(LEAD, plain.cast(pa.binary()), tail, b"")
    coded = pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64) - DEPTH
    flat = b"\0" * 8 + b"".join(whole.to_pylist())
    ending = np.ndarray((len(flat) - 8,), dtype=">u8", buffer=flat, offset=1, strides=(1,))  # the eight bytes up to each
    row = np.repeat(np.arange(len(plain), dtype=np.int32), coded)
    at = np.arange(len(row)) + DEPTH * (row.astype(np.int64) + 1)  # a text's lead is not coded
    return row, (ending[at] & np.uint64((1 << (8 * (DEPTH + 1))) - 1)).astype(np.int64)


def word_steps(plain: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, hashes): every word of joined() texts by its number, and the distinct words' hashes."""
    full = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(plain.filter(pa.array(full)), " ")
    row = np.repeat(np.flatnonzero(full), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.binary())
    size = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(b"".join(names.to_pylist()), dtype=np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    with np.errstate(over="ignore"):  # a polynomial in the bytes
        power = np.cumprod(np.full(int(size.max(initial=0)), 0x9E3779B97F4A7C15, dtype=np.uint64))
        terms = (flat + np.uint64(1)) * power[np.arange(len(flat)) - np.repeat(start, size)]
        sums = np.add.reduceat(terms, start) if len(start) else terms
    return row, coded.indices.to_numpy(zero_copy_only=False), mix64(sums).view(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, byte planes side by side."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.diff(keys, prepend=0))


def unpack_keys(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(packed, n))


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of (keys, counts) tables, and their counts' sums."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, np.diff(keys) != 0)) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


class Held:
    """Tables that add up as they come, in bounded memory."""

    def __init__(self) -> None:
        self.parts, self.loose = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.loose += len(keys)
        if self.loose > max(2_000_000, 2 * len(self.parts[0][0])) and len(self.parts) > 1:
            self.parts, self.loose = [add_up(self.parts)], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return add_up(self.parts)


def count_slice(texts: pa.Array, training: np.ndarray, words: Held, pairs: Held) -> None:
    """Add a slice's distinct words and (context, byte) pairs with their uses in training texts."""
    plain = joined(texts)
    row, number, hashes = word_steps(plain)
    words.add(hashes, np.bincount(number, weights=training[row], minlength=len(hashes)).astype(np.int64))
    row, key = byte_steps(plain)
    uses = training[row]
    for flag in (True, False):
        found, n = np.unique(key[uses == flag], return_counts=True)
        pairs.add(found, n if flag else np.zeros(len(n), dtype=np.int64))


def group_of(kind: int, keys: np.ndarray, groups: int) -> np.ndarray:
    """Words by their hash, pairs by the last LOW bytes of the context."""
    spread = keys.view(np.uint64) if kind == WORDS else mix64((keys >> 8) & ((1 << (8 * LOW)) - 1))
    return (spread % np.uint64(groups)).astype(np.int64)


def group_of_node(node: np.ndarray, depth: int, groups: int) -> np.ndarray:
    """The group of nodes of a depth (the last byte is their context's first), by all their bytes: as group_of() for depth LOW."""
    back = np.zeros(len(node), dtype=np.int64)
    for d in range(depth):
        back |= ((node >> (8 * (depth - 1 - d))) & 255) << (8 * d)
    return (mix64(back) % np.uint64(groups)).astype(np.int64)


SERVED = "block long, kind int, group long, size long, keys binary, counts binary"
TABLE = "block long, kind int, group long, size long, total long, seen long, keys binary, counts binary"


def _table_rows(block: int, kind: int, group: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(group, kind="stable")  # keys stay sorted in each group
    starts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        at = order[a:b]
        k, n = keys[at], counts[at]
        row = {"block": block, "kind": kind, "group": group[at[0]], "size": len(k), "total": n.sum(), "seen": (n > 0).sum(), "keys": pack_keys(k), "counts": pack(n)}
        yield pa.RecordBatch.from_pylist([{c: v if isinstance(v, bytes) else int(v) for c, v in row.items()}], _arrow(TABLE))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of equal neighbours."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    if len(values):
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)


def block_tables(rows: DataFrame, groups: int) -> DataFrame:
    """TABLE rows of rows (block, training, text) sorted by block: what each block holds, by the first level's groups."""
    lanes = lanes_at_first(groups)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, (Held(), Held())

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, table in zip((WORDS, BYTES), held, strict=True):
                if table.parts:
                    keys, counts = table.total()
                    yield from _table_rows(now, kind, group_of(kind, keys, groups) * lanes // groups, keys, counts)

        for b in batches:
            blocks = b.column("block").to_numpy()
            for lo, hi in runs(blocks):
                if blocks[lo] != now:
                    yield from flush()
                    now, held = blocks[lo], (Held(), Held())
                part = b.slice(lo, hi - lo)
                for a, z in slices(text_bytes(part.column("text")), SLICE_BYTES):
                    piece = part.slice(a, z - a)
                    count_slice(piece.column("text"), piece.column("training").to_numpy(zero_copy_only=False), *held)
        yield from flush()

    return rows.mapInArrow(count, TABLE)


@dataclass
class Level:
    """TABLE rows of one round: how many blocks they come from and in how many groups they are."""

    tables: DataFrame
    blocks: int
    lanes: int


def lanes_at_first(groups: int) -> int:
    return min(groups, LANES)


def gathered(tables: DataFrame, blocks: int, groups: int) -> list[Level]:
    """The levels from the blocks' tables to the whole: FAN_IN tables of a group add up in a task, which parts the sum into smaller groups.

    A group of one level holds whole groups of the next: group g of n is group g * m // n of m.
    """
    levels_ = [Level(tables, blocks, lanes_at_first(groups))]
    while len(levels_) == 1 or levels_[-1].blocks > 1:
        last = levels_[-1]
        blocks = -(-last.blocks // FAN_IN)
        lanes = groups if blocks == 1 else min(groups, last.lanes * PARTED)
        joint = last.tables.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
        tables = settle(joint.groupBy("kind", "group", "block").applyInArrow(_adder(last.lanes, lanes, groups), TABLE))
        levels_.append(Level(tables, blocks, lanes))
    return levels_


def _adder(coarse: int, lanes: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind, group, part = Held(), None, None, None
        for b in batches:
            for r in b.to_pylist():
                kind, group, part = r["kind"], r["group"], r["block"]
                held.add(unpack_keys(r["keys"], r["size"]), unpack(r["counts"], r["size"]))
        keys, counts = held.total()
        yield from _table_rows(part, kind, np.full(len(keys), group) if lanes == coarse else group_of(kind, keys, groups) * lanes // groups, keys, counts)

    return add


_TABLE = 1 << 16
_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 0.5))])  # log of gamma(n + 0.5) / gamma(0.5)
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 1.0))])  # log of n!


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for large numbers."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    total = zeros + ones
    z, o, t = (np.minimum(x, _TABLE) for x in (zeros, ones, total))
    out = _HALVES[z] + _HALVES[o] - _WHOLES[t]
    big = np.flatnonzero(total >= _TABLE)
    if len(big):
        x, y = zeros[big], ones[big]
        half = [np.where(v < _TABLE, _HALVES[np.minimum(v, _TABLE)], _log_gamma(np.maximum(v, 1) + 0.5) - 0.5 * math.log(math.pi)) for v in (x, y)]
        out[big] = half[0] + half[1] - _log_gamma(x + y + 1.0)
    return out


@dataclass
class Levels:
    """A decision's nodes by depth, over pairs sorted by decision and context, the last byte first."""

    order: np.ndarray
    starts: list[np.ndarray]  # the first pair of each node
    zeros: list[np.ndarray]
    ones: list[np.ndarray]

    def up(self, d: int) -> np.ndarray:
        """The parent of each node of depth index d."""
        return np.searchsorted(self.starts[d - 1], self.starts[d], "right") - 1

    def weigh(self, leaves: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log weighted probability of the first depth's nodes, and each depth's share of its own estimate.

        leaves: weighted probabilities of the deepest nodes, if they have children elsewhere.
        """
        half, last = math.log(0.5), len(self.starts) - 1
        mixed = log_estimate(self.zeros[last], self.ones[last]) if leaves is None else leaves
        shares = [np.ones(0)] * (last + 1)
        for d in range(last - 1, -1, -1):
            own = half + log_estimate(self.zeros[d], self.ones[d])
            inner = half + np.add.reduceat(mixed, np.searchsorted(self.starts[d + 1], self.starts[d]))
            mixed = np.logaddexp(own, inner)
            shares[d] = np.exp(own - mixed)
        return mixed, shares

    def descend(self, shares: list[np.ndarray], mix: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the first depth's (mix, left) to the last's; a path ends at its deepest visited node."""
        for d in range(1, len(self.starts)):
            up, seen = self.up(d), (self.zeros[d] + self.ones[d]) > 0
            stop = np.where(seen, shares[d - 1][up], 1.0)
            mix, left = mix[up] + left[up] * stop * self.chance(d - 1)[up], left[up] * (1 - stop)
        return mix, left

    def chance(self, d: int) -> np.ndarray:
        return (self.ones[d] + 0.5) / (self.zeros[d] + self.ones[d] + 1.0)


def levels(code: np.ndarray, shifts: list[int], zeros: np.ndarray, ones: np.ndarray) -> Levels:
    """Nodes of codes that agree but for their lowest bits, one depth for each shift."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = [np.flatnonzero(np.append(True, np.diff(code >> k) != 0)) for k in shifts]
    zeros, ones = zeros[order], ones[order]
    return Levels(order, starts, [np.add.reduceat(zeros, x) for x in starts], [np.add.reduceat(ones, x) for x in starts])


def decisions(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, Levels, np.ndarray]]:
    """(decision, pairs' codes, levels from depth LOW on, bits) for the eight decisions of pairs with counts n."""
    byte, back = keys & 255, np.zeros(len(keys), dtype=np.int64)
    for d in range(DEPTH):
        back |= ((keys >> (8 * (d + 1))) & 255) << (8 * (DEPTH - 1 - d))
    for k in range(8):
        bit = (byte >> (7 - k)) & 1
        code = (((1 << k) | (byte >> (8 - k))) << (8 * DEPTH)) | back
        yield k, code, levels(code, [8 * (DEPTH - d) for d in range(LOW, DEPTH + 1)], n * (bit == 0), n * bit), bit


def code_lengths(pairs: DataFrame, groups: int) -> DataFrame:
    """(kind, group, size, keys, counts) of gathered pairs, with log10 P(byte | context) / SCALE in place of counts."""
    upper, many = 8 * (DEPTH - LOW), max(1, groups // PAIRS_A_NODE_GROUP)
    nodes, served = "node array<long>, zeros array<long>, ones array<long>, weight array<double>", "node array<long>, mix array<double>, left array<double>"

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy()

    def by_bit(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
        for k in range(8):
            part = table.filter(pc.equal(table.column("bit"), k))
            if part.num_rows:
                yield k, part

    def rows(name: str, group: np.ndarray, bit: int, **columns: np.ndarray) -> pa.Table:
        """A row for each group that entries of the columns belong to."""
        order = np.argsort(group, kind="stable")
        parts = list(runs(group[order]))
        lists = {c: pa.array([v[order[a:b]] for a, b in parts], pa.list_(pa.int64() if v.dtype == np.int64 else pa.float64())) for c, v in columns.items()}
        return pa.table({name: pa.array([int(group[order[a]]) for a, _ in parts], pa.int64()), "bit": pa.array([bit] * len(parts), pa.int32()), **lists})

    def climbed(table: pa.Table) -> tuple[Levels, np.ndarray, np.ndarray]:
        """The tree over some nodes, from two depths above on: (levels, its nodes, their own weights)."""
        node, weight = column(table, "node"), column(table, "weight")
        tree = levels(node, [16, 8, 0], column(table, "zeros"), column(table, "ones"))
        return tree, node[tree.order], weight[tree.order]

    @lean
    def bottom_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for k, code, tree, _ in decisions(unpack_keys(r["keys"], r["size"]), unpack(r["counts"], r["size"])):
                    weight, _ = tree.weigh()
                    node = code[tree.order][tree.starts[0]] >> upper
                    over = group_of_node(node >> (8 * (LOW - HIGH)), HIGH, many)
                    yield from rows("over", over, k, node=node, zeros=tree.zeros[0], ones=tree.ones[0], weight=weight).to_batches()

    def middle_up(table: pa.Table) -> pa.Table:
        out = []
        for k, part in by_bit(table):
            tree, node, own = climbed(part)
            weight, _ = tree.weigh(own)
            out.append(rows("over", np.zeros(len(weight), dtype=np.int64), k, node=node[tree.starts[0]] >> (8 * (LOW - HIGH)), zeros=tree.zeros[0], ones=tree.ones[0], weight=weight))
        return pa.concat_tables(out).drop_columns("over")

    def above(table: pa.Table) -> pa.Table:
        tree, node, own = climbed(table)
        _, shares = tree.weigh(own)
        mix, left = tree.descend(shares, np.zeros(len(tree.starts[0])), np.ones(len(tree.starts[0])))
        return rows("over", group_of_node(node, HIGH, many), table.column("bit")[0].as_py(), node=node, mix=mix, left=left)

    def middle_down(table: pa.Table, tops: pa.Table) -> pa.Table:
        out, top = [], dict(by_bit(tops))
        for k, part in by_bit(table):
            tree, node, own = climbed(part)
            _, shares = tree.weigh(own)
            known = column(top[k], "node")
            order = np.argsort(known)
            at = order[np.searchsorted(known[order], node[tree.starts[0]] >> (8 * (LOW - HIGH)))]
            mix, left = tree.descend(shares, column(top[k], "mix")[at], column(top[k], "left")[at])
            out.append(rows("group", group_of_node(node, LOW, groups), k, node=node, mix=mix, left=left))
        return pa.concat_tables(out)

    def top_down(table: pa.Table, tops: pa.Table) -> pa.Table:
        top = {}
        for k, part in by_bit(tops):
            order = np.argsort(column(part, "node"))
            top[k] = [column(part, c)[order] for c in ("node", "mix", "left")]
        out = []
        for r in table.to_pylist():
            keys = unpack_keys(r["keys"], r["size"])
            total = np.zeros(len(keys))
            for k, code, tree, bit in decisions(keys, unpack(r["counts"], r["size"])):
                _, shares = tree.weigh()
                nodes, mix, left = top[k]
                at = np.searchsorted(nodes, code[tree.order][tree.starts[0]] >> upper)
                mix, left = tree.descend(shares, mix[at], left[at])
                chance = mix + left * tree.chance(len(tree.starts) - 1)
                each = np.repeat(chance, np.diff(np.append(tree.starts[-1], len(keys))))
                total[tree.order] += np.log10(np.where(bit[tree.order] == 1, each, 1 - each))
            out.append({"kind": BYTES, "group": r["group"], "size": r["size"], "keys": r["keys"], "counts": pack(np.round(total * SCALE).astype(np.int64))})
        return pa.Table.from_pylist(out, _arrow("kind int, group long, size long, keys binary, counts binary"))

    lower = settle(pairs.select("size", "keys", "counts").mapInArrow(bottom_up, f"over long, bit int, {nodes}"))
    middle = settle(lower.groupBy("over").applyInArrow(middle_up, f"bit int, {nodes}"))
    highest = settle(middle.groupBy("bit").applyInArrow(above, f"over long, bit int, {served}"))
    tops = settle(lower.groupBy("over").cogroup(highest.groupBy("over")).applyInArrow(middle_down, f"group long, bit int, {served}"))
    forget(lower, middle, highest)
    return pairs.groupBy("group").cogroup(tops.groupBy("group")).applyInArrow(top_down, "kind int, group long, size long, keys binary, counts binary")


def looked_up(level: Level, model: DataFrame, lanes: int) -> DataFrame:
    """(block, kind, group, size, keys, counts) of a level: its tables' own keys with the model's values for them.

    model has the values of the level above, in `lanes` groups. A table of that level passes
    once, before the FAN_IN tables at most that it came from.
    """
    place = ["kind", "group", "part"]
    first = model.select("kind", F.expr(f"group * {level.lanes}L div {lanes}L").alias("group"), F.col("block").alias("part"), F.lit(-1).cast("long").alias("block"), "size", "keys", "counts")
    part = F.floor(F.col("block") / FAN_IN).cast("long")
    asked = level.tables.select("kind", "group", part.alias("part"), "block", "size", "keys", F.lit(None).cast("binary").alias("counts"))

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, keys, values = None, [], None, None
        for b in batches:
            for r in b.to_pylist():
                mine = unpack_keys(r["keys"], r["size"])
                if here != (r["kind"], r["group"], r["part"]):
                    here, held, keys = (r["kind"], r["group"], r["part"]), [], None
                if r["block"] < 0:
                    held.append((mine, unpack(r["counts"], r["size"])))
                    continue
                if keys is None:  # the groups of the level above that this one holds
                    keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
                    if len(held) > 1:
                        order = np.argsort(keys, kind="stable")
                        keys, values = keys[order], values[order]
                    held = []
                row = {"block": r["block"], "kind": r["kind"], "group": r["group"], "size": r["size"], "keys": r["keys"], "counts": pack(values[np.searchsorted(keys, mine)])}
                yield pa.RecordBatch.from_pylist([row], _arrow(SERVED))

    dealt = first.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "block")
    return dealt.mapInArrow(find, SERVED)


def _by_block(rows: DataFrame, blocks: int, *then: str) -> DataFrame:
    """Rows sorted by block, one block a partition (a hash of the number would pile some up)."""
    return rows.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", *then)


def score(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    base_score and score are log10 probabilities of the text under the smoothed word
    counts and under the context tree; bits_per_byte is the tree's code length for each
    coded byte. Null texts are empty (one end token). Texts of any length are scored whole,
    in slices; rows that are equal in id and text are scored alike, in one block; null ids
    are in the fold of the empty text; an empty training set gives even odds to every decision; other
    columns, whatever their names, stay out; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", is_training(F.col("doc_id"), folds, held_out).alias("training"), "text")
    size, ends = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("training")).first()
    blocks, groups = max(1, -(-size // BLOCK_BYTES)), max(8, -(-size // GROUP_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    tables = settle(block_tables(_by_block(dealt.select("block", "training", "text"), blocks), groups))
    rounds = gathered(tables, blocks, groups)
    sums = rounds[-1].tables
    words = sums.where(F.col("kind") == WORDS)
    known = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    tokens, distinct = known[0] + ends, known[1] + (ends > 0)
    parts = code_lengths(sums.where(F.col("kind") == BYTES), groups)
    model = settle(parts.unionByName(words.select(*parts.columns)).withColumn("block", F.lit(0).cast("long")))
    forget(sums)
    total = math.log10(tokens + 0.5 * (distinct + 1))
    end_base = math.log10(ends + 0.5) - total

    def scored(part: pa.RecordBatch, index: dict) -> pa.RecordBatch:
        plain, n = joined(part.column("text")), part.num_rows

        def values_of(kind: int, keys: np.ndarray) -> np.ndarray:
            at = index[kind][0].get_indexer(keys)
            if (at < 0).any():
                raise ValueError("a text was another when its block was counted")
            return index[kind][1][at]

        def by_row(row: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(row, weights=weights, minlength=n)

        row, number, hashes = word_steps(plain)
        uses = values_of(WORDS, hashes)
        many, seen = by_row(row) + 1, by_row(row, (uses > 0)[number]) + (ends > 0)
        base = by_row(row, (np.log10(uses + 0.5) - total)[number]) + end_base
        row, key = byte_steps(plain)
        code = by_row(row, values_of(BYTES, key)) / SCALE
        columns = [part.column("doc_id"), pc.invert(part.column("training")), pa.array(many), pa.array(seen.astype(np.int64)), pa.array(np.full(n, tokens)), pa.array(base), pa.array(code), pa.array(-code * math.log2(10) / by_row(row))]
        return pa.record_batch(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    @lean
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, {}, None
        for b in batches:
            blocks, turn = b.column("block").to_numpy(), b.column("turn").to_numpy()
            for lo, hi in runs(2 * blocks + turn):
                if blocks[lo] != now:
                    now, held, index = blocks[lo], {WORDS: [], BYTES: []}, None
                part = b.slice(lo, hi - lo)
                if turn[lo] == 0:
                    for r in part.select(["kind", "size", "keys", "counts"]).to_pylist():
                        held[r["kind"]].append((unpack_keys(r["keys"], r["size"]), unpack(r["counts"], r["size"]).astype(np.int32 if r["kind"] == BYTES else np.int64)))
                    continue
                if index is None:
                    none = np.empty(0, dtype=np.int64)
                    index = {k: (pd.Index(np.concatenate([none, *(x for x, _ in t)])), np.concatenate([none, *(v for _, v in t)])) for k, t in held.items()}
                    held = {}
                for a, z in slices(text_bytes(part.column("text")), SLICE_BYTES):
                    yield scored(part.slice(a, z - a), index)

    kind = docs.schema["doc_id"].dataType.simpleString()
    for below, above in zip(rounds[-2:0:-1], rounds[:1:-1], strict=True):
        whole, model = model, settle(looked_up(below, model, above.lanes))
        forget(whole, below.tables)
    served = looked_up(rounds[0], model, rounds[1].lanes).drop("group").withColumn("turn", F.lit(0))
    both = served.unionByName(dealt.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    return _by_block(both, blocks, "turn").mapInArrow(tell, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
