"""Vector best-fit packing: tokens, documents and attention cost bound every sequence.

Attention within documents is computed in square tiles, so a piece of n tokens costs
ceil(n / tile) squared of them. By default both other capacities are the most that pieces of
a sequence's tokens can ask for: they guide the choice of a bin and cost no sequence.
Tighter ones are the caller's.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import settle
from .common import lean, small_batches
from .tokens import encoded, piece_bounds

LENGTH = 2048
TILE = 128
CELL = 4096


def attention_tiles(length, tile: int = TILE):
    """Tiles that attention within a piece of so many tokens takes."""
    return (-(-length // tile)) ** 2


def most_tiles(length: int, max_documents: int, tile: int) -> int:
    """The most tiles that pieces of so many tokens together can take: a long one, then single tokens.

    Two long pieces never take more than a longer and a shorter one, as squares are convex.
    """
    sizes = range(1, length + 1, tile)  # the shortest piece of each number of tiles
    return max(attention_tiles(n, tile) + min(length - n, max_documents - 1) for n in sizes)


def pieces(docs: DataFrame, length: int = LENGTH, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all documents' token pieces; ids stay behind."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    @lean
    def cut(batches):
        for rows, ids, counts in encoded(batches, ranks_path):
            row, piece, start, size = piece_bounds(counts, length)
            at = (np.cumsum(counts) - counts)[row] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
            yield pa.record_batch(
                [rows.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(
    length: np.ndarray, capacity: int, max_documents: int, max_cost: float,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.05), rule: str = "norm", tile: int = TILE,
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset for each length, taken from the longest to the shortest.

    A piece of n tokens asks for (n, 1, its attention tiles) of a bin's (capacity,
    max_documents, max_cost). A piece that costs more than max_cost by itself stands alone. Among the bins with room in all three, "norm" takes the one whose residual
    after the piece has the least weighted norm, "dot" the one with the largest weighted dot
    product of demand and residual; ties go to the oldest. Without one, a bin is opened.
    """
    order = np.argsort(-length, kind="stable")
    bins, offset = np.empty(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
    w = np.array(weights)[:, None]
    room = np.empty((3, 64))  # residual shares of the open bins
    name = np.empty(64, dtype=np.int64)
    used: list[int] = []
    n_open, slack = 0, 1e-9
    least = length.min() / capacity if len(length) else 0
    for k in order:
        n = int(length[k])
        ask = np.array([n / capacity, 1 / max_documents, min(1.0, attention_tiles(n, tile) / max_cost)])
        live, pick = room[:, :n_open], -1
        fits = np.flatnonzero((live[0] >= ask[0] - slack) & (live[1] >= ask[1] - slack) & (live[2] >= ask[2] - slack))
        if len(fits):
            near = live[:, fits]
            if rule == "norm":
                pick = int(fits[np.argmin((w * (near - ask[:, None]) ** 2).sum(0))])
            else:
                pick = int(fits[np.argmax((w * near * ask[:, None]).sum(0))])
        else:
            if n_open == room.shape[1]:
                room, name = np.concatenate([room, np.empty_like(room)], 1), np.concatenate([name, np.empty_like(name)])
            pick, n_open = n_open, n_open + 1
            room[:, pick], name[pick] = 1.0, len(used)
            used.append(0)
        b = name[pick]
        bins[k], offset[k] = b, used[b]
        used[b] += n
        room[:, pick] -= ask
        if room[0, pick] < least - slack or room[1, pick] < 1 / max_documents - slack or room[2, pick] < 1 / max_cost - slack:
            n_open -= 1
            room[:, pick : n_open] = room[:, pick + 1 : n_open + 1]
            name[pick:n_open] = name[pick + 1 : n_open + 1]
    return bins, offset


def pack(
    docs: DataFrame, length: int = LENGTH, max_documents: int | None = None, max_cost: float | None = None,
    cell: int = CELL, rule: str = "norm", ranks_path: str | None = None, tile: int | None = None,
) -> DataFrame:
    """Pack all documents' pieces: pieces() with sequence_id and offset.

    Pieces are dealt by hash into cells of about `cell` pieces and each cell is packed
    alone, so the last open bins of a cell are all that a global packing could save.
    max_documents bounds a sequence's documents and max_cost its attention tiles (of a
    sixteenth of its length, if tile is not given); a piece over max_cost stands alone. By
    default neither can bind. Null and empty texts are one end token; very long texts become
    whole pieces; repeated rows are packed as often as they come; pieces of equal length are
    taken by id (null last), piece and content; ids of any kind and size, nulls beside them
    too, come back as they are; other columns stay out; an empty table gives an empty result.
    """
    cut = settle(pieces(docs, length, ranks_path))
    n_cells = max(1, round(cut.count() / cell))
    dealt = cut.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n_cells)))
    tile = tile or max(1, length // 16)
    most = max_documents or length
    cost = float(max_cost or most_tiles(length, most, tile))

    def fill(group: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        group = group.take(pc.sort_indices(group, sort_keys=order))
        bins, offset = best_fit(group["length"].to_numpy(), length, most, cost, rule=rule, tile=tile)
        number = (group["_cell"][0].as_py() << 32) + bins
        return group.drop_columns("_cell").append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    schema = T.StructType([*cut.schema.fields]).add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("_cell").applyInArrow(fill, schema)
