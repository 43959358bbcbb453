"""Min-cost-flow resharding: move the fewest bytes from old shards into new capacities.

The flow is solved between shards (one node each, never between documents): its size
depends on the shard counts alone. Each arc of the flow is a block of an old shard's
documents, cut from running byte offsets.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle
from .common import chunk_count, running_offsets


def min_cost_flow(
    supplies: Sequence[int], capacities: Sequence[int], cost: Sequence[Sequence[int]] | None = None
) -> dict[tuple[int, int], int]:
    """Bytes that go from each old to each new shard, at the least total cost.

    cost[i][j] is the price of a byte from i to j; by default a byte that stays (i == j) is
    free and any other costs 1. Capacities must hold the supplies. Successive shortest
    paths with potentials. At default prices all moves pass a hub, so arcs grow with the number
    of shards and not with its square, and the flow has at most as many parts.
    """
    n, m = len(supplies), len(capacities)
    if sum(supplies) > sum(capacities):
        raise ValueError("the new shards cannot hold all bytes")
    if any(c < 0 for row in cost or () for c in row):
        raise ValueError("costs must not be negative")
    source, sink, hub = n + m, n + m + 1, n + m + 2
    arcs: list[list[int]] = []  # to, left, cost; arc k ^ 1 is its reverse
    out: list[list[int]] = [[] for _ in range(n + m + 3)]

    def arc(a: int, b: int, room: int, c: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, room, c])
        out[b].append(len(arcs))
        arcs.append([a, 0, -c])

    for i, s in enumerate(supplies):
        arc(source, i, s, 0)
    for j, c in enumerate(capacities):
        arc(n + j, sink, c, 0)
    for i in range(n):
        if cost is None:
            arc(i, hub, supplies[i], 1)
            if i < m:
                arc(i, n + i, supplies[i], 0)
        for j in range(m if cost is not None else 0):
            arc(i, n + j, supplies[i], cost[i][j])
    for j in range(m if cost is None else 0):
        arc(hub, n + j, capacities[j], 0)
    _augment(arcs, out, source, sink)
    flow: dict[tuple[int, int], int] = {}
    sent, due = [], []  # what the hub gets and gives
    for i in range(n):
        for k in out[i]:
            if k % 2 == 0 and arcs[k ^ 1][1]:
                b = arcs[k][0]
                if b == hub:
                    sent.append([i, arcs[k ^ 1][1]])
                else:
                    flow[i, b - n] = arcs[k ^ 1][1]
    for k in out[hub]:
        if k % 2 == 0 and arcs[k ^ 1][1]:
            due.append([arcs[k][0] - n, arcs[k ^ 1][1]])
    while sent:
        amount = min(sent[-1][1], due[-1][1])
        pair = sent[-1][0], due[-1][0]
        flow[pair] = flow.get(pair, 0) + amount
        for side in (sent, due):
            side[-1][1] -= amount
            if not side[-1][1]:
                side.pop()
    return flow


def _augment(arcs: list[list[int]], out: list[list[int]], source: int, sink: int) -> None:
    """Send all that fits from source to sink along cheapest paths."""
    height = [0] * len(out)
    while True:
        far, via = [None] * len(out), [-1] * len(out)
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k in out[a]:
                b, room, c = arcs[k]
                step = d + c + height[a] - height[b]
                if room > 0 and (far[b] is None or step < far[b]):
                    far[b], via[b] = step, k
                    heapq.heappush(queue, (step, b))
        if far[sink] is None:
            return
        for v, d in enumerate(far):
            if d is not None:
                height[v] += d
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push


def _even(total: int, parts: int) -> list[int]:
    return [total * (k + 1) // parts - total * k // parts for k in range(parts)]


def _blocks(rows: DataFrame, flow: dict[tuple[int, int], float], chunks: int) -> DataFrame:
    """Cut each old shard's rows, in running order, into blocks as large as the flow's arcs."""
    by_old: dict[int, list[tuple[int, float]]] = {}
    for (i, j), amount in sorted(flow.items()):
        if amount > 0:
            by_old.setdefault(i, []).append((j, amount))
    bounds = []
    for i, parts in by_old.items():
        upto, edges = 0.0, []
        for _, amount in parts:
            upto += amount
            edges.append(upto)
        bounds.append((i, edges[:-1], [j for j, _ in parts]))
    table = rows.sparkSession.createDataFrame(
        bounds, "old_shard int, _edges array<double>, _shards array<int>"
    )
    placed = running_offsets(rows, "old_shard", ["doc_id", "size", "text_crc32"], F.col("size"), chunks)
    middle = F.col("start") + F.col("size") / 2
    return (
        placed.join(F.broadcast(table), "old_shard")  # one row for each old shard
        .withColumn(
            "shard",
            F.element_at("_shards", F.size(F.filter("_edges", lambda e: e <= middle)) + 1),
        )
        .drop("_edges", "_shards", "start", "place")
    )


def describe(docs: DataFrame, old_shard: Column) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16 for the frame), text_crc32 and old_shard of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
    )


def reshard(rows: DataFrame, n_shards: int) -> DataFrame:
    """Assign each row of describe() to one of n_shards shards of near-equal bytes.

    Adds shard, slot (its place in the shard, gapless from 0) and moved (the shard is
    another than the old one). Documents above the mean size are dealt first; the smaller
    ones then fill what is left of every arc, so that a shard misses its capacity by a few
    small documents at most. Null texts count 16 bytes, null ids are rows like others,
    repeated rows are dealt one by one (ties in their order go either way), very long texts
    are one row each, other columns stay out, and an empty table gives an empty result.
    """
    rows = settle(rows)
    stats = rows.groupBy("old_shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    total, count = sum(r.s for r in stats), sum(r.n for r in stats)
    supplies = [0] * (max((r.old_shard for r in stats), default=0) + 1)
    for r in stats:
        supplies[r.old_shard] = r.s
    flow = min_cost_flow(supplies, _even(total, n_shards))
    large = F.col("size") > (total / count if count else 0)
    chunks = chunk_count(count)
    shares = {r.old_shard: r.b / supplies[r.old_shard] for r in rows.where(large).groupBy("old_shard").agg(F.sum("size").alias("b")).collect()}
    first = settle(_blocks(rows.where(large), {(i, j): f * shares.get(i, 0) for (i, j), f in flow.items()}, chunks))
    used = {(r.old_shard, r.shard): r.b for r in first.groupBy("old_shard", "shard").agg(F.sum("size").alias("b")).collect()}
    left = {k: max(0.0, f - used.get(k, 0)) for k, f in flow.items()}
    for i in {i for i, _ in flow}:  # what large documents took too much of one arc is short in others
        room = sum(v for (a, _), v in left.items() if a == i)
        need = supplies[i] - sum(b for (a, _), b in used.items() if a == i)
        if room == 0 and need:
            left.update({k: f for k, f in flow.items() if k[0] == i})
            room = supplies[i]
        if room:
            left.update({k: v * need / room for k, v in left.items() if k[0] == i})
    second = _blocks(rows.where(~large), left, chunks)
    return (
        running_offsets(first.unionByName(second), "shard", ["doc_id", "size", "text_crc32"], F.col("size"), chunks)
        .withColumnRenamed("place", "slot")
        .withColumn("moved", F.col("shard") != F.col("old_shard"))
        .drop("start")
    )


def affected_shards(plan: DataFrame) -> list[int]:
    """Shards that lose or gain a row; the files of all others stay as they are."""
    ends = plan.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("s"))
    return sorted(r.s for r in ends.distinct().collect())


def rewrite(docs: DataFrame, plan: DataFrame, target: str) -> DataFrame:
    """Write the affected shards' documents below target (a folder target_shard=k for each, in slot order).

    docs must hold each (doc_id, text) of the plan; rows that are equal in both are
    numbered alike on both sides. Returns (shard, path): folders that were not touched
    have a null path and keep their old files.
    """
    keys = ["doc_id", "text_crc32", "size"]
    text = F.coalesce(F.col("text"), F.lit(""))
    twin = Window.partitionBy(*keys).orderBy(F.lit(0))
    full = docs.select(
        F.struct(*docs.columns).alias("_row"), "doc_id", F.crc32(text).alias("text_crc32"), (F.octet_length(text) + 16).cast("long").alias("size")
    ).withColumn("_twin", F.row_number().over(twin))
    dealt = plan.select(*keys, F.col("shard").alias("target_shard"), F.col("slot").alias("target_slot"), F.row_number().over(twin).alias("_twin"))
    touched = affected_shards(plan)
    same = [full[k].eqNullSafe(dealt[k]) for k in [*keys, "_twin"]]
    moved = dealt.where(F.col("target_shard").isin(touched))
    out = full.join(moved, same).select("_row.*", "target_shard", "target_slot").repartitionByRange("target_shard", "target_slot")
    out.sortWithinPartitions("target_shard", "target_slot").write.partitionBy("target_shard").parquet(target)
    return plan.select("shard").distinct().withColumn("path", F.when(F.col("shard").isin(touched), F.concat(F.lit(f"{target}/target_shard="), F.col("shard").cast("string"))))
