"""Token-ID output: best-fit-decreasing packing into fixed-length id rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, small_batches
from .tokens import encoded, piece_bounds

LENGTH = 2048
WINDOW = 2_000_000


class CapacityTree:
    """Segment tree over residual capacities 0 .. most: finds the fullest bin with room.

    Leaf c counts the open bins with c tokens left; an inner node has the sum of its
    leaves. fit(n) walks to the least c >= n that has a bin.
    """

    def __init__(self, most: int) -> None:
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, c: int, d: int) -> None:
        at = c + self.base
        while at:
            self.count[at] += d
            at >>= 1

    def put(self, c: int, bin_: int) -> None:
        if c:
            self.bins[c].append(bin_)
            if len(self.bins[c]) == 1:
                self._add(c, 1)

    def fit(self, n: int) -> int | None:
        """The least residual of at least n that some bin has."""
        at, count = n + self.base, self.count
        if count[at]:
            return n
        while at > 1:  # up to the first right neighbour with a bin, then down to its left
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return None

    def take(self, c: int) -> int:
        out = self.bins[c].pop()
        if not self.bins[c]:
            self._add(c, -1)
        return out


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each length, and how many bins there are."""
    tree, bins, n_bins = CapacityTree(capacity), np.empty(len(lengths), dtype=np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        c = tree.fit(n)
        if c is None:
            b, c, n_bins = n_bins, capacity, n_bins + 1
        else:
            b = tree.take(c)
        bins[k] = b
        tree.put(c - n, b)
    return bins, n_bins


def packed_rows(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, pad: int = 0, ranks_path: str | None = None) -> DataFrame:
    """All documents as packed id rows of exactly length tokens.

    A row: sequence_id, n_tokens (without padding), doc_ids and pieces (one for each
    segment), cu_seqlens (0, then the end of each segment), ids and position_ids (little
    endian unsigned 16-bit, length values each; positions restart at 0 with every segment and
    run on over the padding). Longer documents are cut, first piece shortest, and lose
    nothing. Packing takes windows of about `window` tokens of a partition's documents as
    they are read: token ids are never shuffled and a lost task redoes only its own.
    Ids over 65,535 are an error. Null and empty texts are one end token; repeated rows are
    packed as often as they come; pieces of equal length are taken as they come; other
    columns stay out; an empty table gives an empty result.
    """
    if length > 65_535:
        raise ValueError("segments over 65,535 tokens do not fit 16-bit positions")
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = (
        f"sequence_id long, n_tokens int, doc_ids array<{kind.simpleString()}>, pieces array<int>, "
        "cu_seqlens array<int>, ids binary, position_ids binary"
    )

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        state = {"next": (task.partitionId() if task else 0) << 40}
        held: list[tuple] = []
        tokens = 0
        for rows, ids, counts in encoded(batches, ranks_path):
            if len(ids) and ids.max() > 65_535:
                raise ValueError("this vocabulary has ids that do not fit 16 bits")
            held.append((rows.column("doc_id"), ids.astype("<u2"), counts))
            tokens += len(ids)
            if tokens >= window:
                yield from _emit(held, length, pad, state)
                held, tokens = [], 0
        if held:
            yield from _emit(held, length, pad, state)

    return docs.select("doc_id", "text").mapInArrow(pack, schema)


def _emit(held: list[tuple], length: int, pad: int, state: dict) -> Iterator[pa.RecordBatch]:
    doc_ids = pa.concat_arrays([h[0] for h in held])
    ids, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
    row, piece, start, size = piece_bounds(counts, length)
    at = (np.cumsum(counts) - counts)[row] + start
    bins, n_bins = best_fit_decreasing(size, length)
    order = np.argsort(bins, kind="stable")
    per_bin = np.bincount(bins, minlength=n_bins)
    size_o, first = size[order], np.cumsum(per_bin) - per_bin
    ends = np.cumsum(size_o)
    base = np.repeat(ends[first] - size_o[first], per_bin)
    for a in range(0, n_bins, 256):  # some MB at a time
        b = min(n_bins, a + 256)
        lo, hi = int(first[a]), int(first[b - 1] + per_bin[b - 1])
        part, n = order[lo:hi], size_o[lo:hi]
        place = ends[lo:hi] - n - base[lo:hi]  # of each segment in its row
        matrix = np.full((b - a, length), pad, dtype="<u2")
        position = np.tile(np.arange(length, dtype="<u2"), (b - a, 1))
        flat_at = np.repeat((bins[part] - a) * length + place, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        matrix.reshape(-1)[flat_at + step] = ids[np.repeat(at[part], n) + step]
        position.reshape(-1)[flat_at + step] = step
        filled = np.add.reduceat(n, first[a:b] - lo)
        tail = np.arange(length)[None, :] - filled[:, None]
        last = per_bin[a:b] + first[a:b] - lo - 1
        position = np.where(tail >= 0, tail + n[last][:, None], position).astype("<u2")
        cu = np.insert((place + n).astype(np.int32), first[a:b] - lo, 0)
        offsets = np.concatenate([[0], np.cumsum(per_bin[a:b])]).astype(np.int32)
        yield pa.record_batch(
            [
                pa.array(np.arange(state["next"], state["next"] + b - a), pa.int64()),
                pa.array(filled, pa.int32()),
                pa.ListArray.from_arrays(offsets, doc_ids.take(pa.array(row[part]))),
                pa.ListArray.from_arrays(offsets, pa.array(piece[part], pa.int32())),
                pa.ListArray.from_arrays((offsets + np.arange(b - a + 1)).astype(np.int32), pa.array(cu)),
                pa.array([r.tobytes() for r in matrix], pa.binary()),
                pa.array([r.tobytes() for r in position], pa.binary()),
            ],
            ["sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "position_ids"],
        )
        state["next"] += b - a


def write_rows(packed: DataFrame, target: str) -> None:
    """Write packed rows as Parquet: fixed-width binary id rows with their segment ends."""
    packed.write.option("compression", "zstd").parquet(target)
