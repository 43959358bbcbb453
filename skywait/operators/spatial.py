"""Polygons by DataFrame functions: clipping, areas, and the join of shapes that overlap.

A ring is array<array<double>>, closed or not. The join deals both sides to the cells of a grid
that their bounds touch and meets on cells. A pair that shares several cells is taken in
the one with the lower left corner of what their bounds share, so nothing repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import computed_once

CELL_DEGREES = 1.0


def _open(ring: Column) -> Column:
    """The ring's points without a closing repeat of the first."""
    repeats = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(repeats, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def _next(points: Column, i: Column) -> Column:
    return F.get(points, (i + 1) % F.size(points))


def _doubled(points: Column) -> Column:
    """Twice the signed area of an open ring (a lambda's variable): positive if it turns left."""

    def term(p: Column, i: Column) -> Column:
        return computed_once(_next(points, i), lambda q: p[0] * q[1] - q[0] * p[1])

    return F.aggregate(F.transform(points, term), F.lit(0.0), lambda a, b: a + b)


def _area(points: Column) -> Column:
    """The area of an open ring, which may be costly: it is planned once."""
    return computed_once(points, lambda p: F.abs(_doubled(p)) / 2)


def ring_area(ring: Column) -> Column:
    return _area(_open(ring))


def clipped(ring: Column, window: Column) -> Column:
    """The part of a ring inside a convex window, as an open ring: cut by one edge of the window after the other."""
    none = F.array().cast("array<array<double>>")

    def cut(points: Column, edge: Column) -> Column:
        a, b = edge[0], edge[1]

        def side(p: Column) -> Column:
            return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

        sided = F.transform(points, lambda p: F.struct(p.alias("p"), side(p).alias("s")))

        def keep(all_: Column, one: Column, i: Column) -> Column:
            def both(other: Column) -> Column:
                p, q, s, t = one["p"], other["p"], one["s"], other["s"]
                r = s / (s - t)
                crossing = F.array(p[0] + r * (q[0] - p[0]), p[1] + r * (q[1] - p[1]))
                return F.when(s >= 0, F.when(t >= 0, F.array(p)).otherwise(F.array(p, crossing))).otherwise(F.when(t >= 0, F.array(crossing)).otherwise(none))

            return computed_once(_next(all_, i), both)

        return computed_once(sided, lambda all_: F.flatten(F.transform(all_, lambda one, i: keep(all_, one, i))))

    def edges(w: Column) -> Column:
        turned = F.when(_doubled(w) >= 0, w).otherwise(F.reverse(w))
        return computed_once(turned, lambda t: F.transform(t, lambda a, i: F.array(a, _next(t, i))))

    points = F.transform(_open(ring), lambda p: F.slice(p, 1, 2))
    return F.aggregate(computed_once(_open(window), edges), points, cut)


def overlap_fraction(entity: Column, footprint: Column) -> Column:
    """Share of a convex entity ring that a footprint ring covers; 0 without a footprint, an error without an area."""
    known = footprint.isNotNull() & (F.size(footprint) >= 3)

    def share(area: Column) -> Column:
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _area(clipped(footprint, entity)) / area))
        return F.when(area == 0, F.raise_error(F.lit("an entity has no area")).cast("double")).when(known, part).otherwise(0.0)

    return computed_once(ring_area(entity), share)


def _is_box(ring: Column) -> Column:
    """Whether a ring is its bounds: four corners, each side along one axis. Without a lambda, so that it is compiled."""

    def at(corner: int, axis: int) -> Column:
        return F.get(F.get(ring, F.lit(corner % 4)), F.lit(axis % 2))

    def along(first: int) -> Column:
        same = [at(i, first + i) == at(i + 1, first + i) for i in range(4)]
        return same[0] & same[1] & same[2] & same[3]

    closed = (F.size(ring) == 5) & (F.get(ring, F.lit(0)) == F.get(ring, F.lit(4)))
    return F.coalesce(((F.size(ring) == 4) | closed) & (along(0) | along(1)), F.lit(False))


def _bounds(ring: Column) -> Column:
    x, y = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    sides = F.array_min(x).alias("left"), F.array_min(y).alias("low"), F.array_max(x).alias("right"), F.array_max(y).alias("high")
    return F.struct(*sides, _is_box(ring).alias("full"))


def in_cells(shapes: DataFrame, ring: str, cell: float = CELL_DEGREES) -> DataFrame:
    """shapes once for each grid cell that their bounds touch, with _box, _cx and _cy; a large shape so spreads over many rows. Null and empty rings go."""

    def numbers(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))

    boxed = shapes.where(F.size(ring) > 0).withColumn("_box", _bounds(F.col(ring)))
    return boxed.withColumn("_cx", numbers("_box.left", "_box.right")).withColumn("_cy", numbers("_box.low", "_box.high"))


def overlapping(shapes: DataFrame, windows: DataFrame, shape: str, window: str, cell: float = CELL_DEGREES) -> DataFrame:
    """Pairs of shapes and convex windows that share some area, with overlap: the share of the window that is covered.

    The column names of both sides must differ. Bounds are compared before anything is clipped;
    shapes that only touch do not overlap. Of two boxes the bounds tell the share; a ring that is
    none travels to the pairs, which clip it.
    """

    def dealt(side: str, rows: DataFrame, ring: str) -> DataFrame:
        part = F.when(~F.col("_box.full"), F.col(ring))
        return in_cells(rows, ring, cell).withColumn(f"_ring_{side}", part).withColumnRenamed("_box", f"_box_{side}")

    def ring(side: str) -> Column:
        left, low, right, high = (F.col(f"_box_{side}.{x}") for x in ("left", "low", "right", "high"))
        return F.coalesce(f"_ring_{side}", F.array(F.array(left, low), F.array(right, low), F.array(right, high), F.array(left, high)))

    left, low = F.greatest("_box_a.left", "_box_b.left"), F.greatest("_box_a.low", "_box_b.low")
    right, high = F.least("_box_a.right", "_box_b.right"), F.least("_box_a.high", "_box_b.high")
    meet, boxes = (left <= right) & (low <= high), F.col("_box_a.full") & F.col("_box_b.full")
    here = (F.floor(left / cell) == F.col("_cx")) & (F.floor(low / cell) == F.col("_cy"))
    area = (F.col("_box_b.right") - F.col("_box_b.left")) * (F.col("_box_b.high") - F.col("_box_b.low"))
    # Pairs may outgrow both sides by far, so they are dealt by cells: a broadcast would leave them to the tasks that read the shapes.
    pairs = dealt("a", shapes, shape).join(dealt("b", windows, window).hint("merge"), ["_cx", "_cy"]).where(meet & here)
    pairs = pairs.withColumn("_common", F.when(boxes & (area > 0), (right - left) * (high - low) / area))
    rings = F.struct(ring("a").alias("shape"), ring("b").alias("window"))
    clip = F.filter(F.array(computed_once(rings, lambda r: overlap_fraction(r["window"], r["shape"]))), lambda x: x > 0)  # once, unlike a column that a filter reads
    # The clip has a column of its own, as an explode that holds it is not compiled.
    shares = pairs.withColumn("_clip", F.when(F.col("_common").isNull(), clip)).drop("_cx", "_cy", "_box_a", "_box_b", "_ring_a", "_ring_b")
    share = F.when(F.col("_common").isNull(), F.col("_clip")).when(F.col("_common") > 0, F.array("_common"))
    return shares.withColumn("overlap", F.explode(share)).drop("_common", "_clip")
