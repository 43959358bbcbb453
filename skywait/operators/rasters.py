"""Class rasters as tiles: windows of them on other grids, and run-length codes.

A raster is a row of sources (where its pixels lie) and rows of tiles. A grid is read in strips
of whole lines. Each strip's pixel centres are mapped to the source once for all rasters of one
layout; strips meet the tiles that they touch in an equi-join, and what several tiles give is
merged. Pixels are entries of arrays throughout, never rows.

    grids    aoi_id, epsg, left, top, width, height, step
    sources  scene_id, epsg, left, top, width, height, step, tile (pixels along a tile's side)
    tiles    scene_id, tile_number (row by row, from 0), classes (tile * tile values, 0 without data)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import computed_once
from ..functions.geometry import between_zones, grid_mask, to_utm

STRIP_PIXELS = 4096
_LAYOUT = ("epsg", "left", "top", "width", "height", "step", "tile")
NO_OVERLAP, NO_TILE = "the grid does not overlap the raster", "a tile of the raster is missing"


def entity_grids(places: DataFrame, step: float = 20.0) -> DataFrame:
    """grids of entities (aoi_id, utm_epsg, ring of lon and lat), with mask: which pixel centres lie inside."""

    @F.pandas_udf("struct<left: double, top: double, width: int, height: int, mask: array<boolean>>")
    def grid(rings, epsg):
        import numpy as np
        import pandas as pd

        out = []
        for ring, zone in zip(rings, epsg, strict=True):
            p = np.array([list(q[:2]) for q in ring])
            x, y = to_utm(p[:, 1], p[:, 0], int(zone))
            (left, _, _, top), inside = grid_mask(np.stack([x, y], 1), step)
            out.append((left, top, inside.shape[1], inside.shape[0], inside.ravel()))
        return pd.DataFrame(out, columns=["left", "top", "width", "height", "mask"])

    return places.select("aoi_id", F.col("utm_epsg").alias("epsg"), grid("ring", "utm_epsg").alias("g"), F.lit(step).alias("step")).select("aoi_id", "epsg", "g.*", "step")


def _source_pixel(col: Column, row: Column, use: Callable[[Column], Column]) -> Column:
    """use(array(column, row)) of a grid pixel's centre in the source, in pixels from its upper left corner."""
    x, y = F.col("left") + (col + 0.5) * F.col("step"), F.col("top") - (row + 0.5) * F.col("step")

    def spot(p: Column) -> Column:
        return F.array((p[0] - F.col("s_left")) / F.col("s_step"), (F.col("s_top") - p[1]) / F.col("s_step"))

    return computed_once(computed_once(between_zones(x, y, F.col("epsg"), F.col("s_epsg")), spot), use)


def _in_tile(c: Column, r: Column) -> tuple[Column, Column, Column]:
    """Whether the source has a pixel, its tile's number and its place in the tile."""
    t = F.col("s_tile")
    inside = (c >= 0) & (c < F.col("s_width")) & (r >= 0) & (r < F.col("s_height"))
    number = F.floor(r / t) * F.ceil(F.col("s_width") / t) + F.floor(c / t)
    return inside, number.cast("int"), ((r % t) * t + c % t).cast("int")


def _nearest(col: Column, row: Column) -> Column:
    """struct(tile_number, at) of the source pixel that holds a grid pixel's centre; null outside of the source."""

    def place(q: Column) -> Column:
        inside, number, at = _in_tile(q[0], q[1])
        return F.when(inside, F.struct(number.alias("tile_number"), at.alias("at")))

    return _source_pixel(col, row, lambda p: computed_once(F.array(F.floor(p[0]), F.floor(p[1])), place))


def _four(col: Column, row: Column) -> Column:
    """The up to four source pixels about a grid pixel's centre, as structs (tile_number, at, weight, nearest)."""

    def around(p: Column) -> Column:
        def corner(dx: int, dy: int) -> Column:
            def place(q: Column) -> Column:
                c, r = F.floor(q[0]) + dx, F.floor(q[1]) + dy
                inside, number, at = _in_tile(c, r)
                weight = (1 - F.abs(q[0] - c)) * (1 - F.abs(q[1] - r))
                holds = (c == F.floor(p[0])) & (r == F.floor(p[1]))
                return F.when(inside & ((weight > 0) | holds), F.struct(number.alias("tile_number"), at.alias("at"), weight.alias("weight"), holds.alias("nearest")))

            return computed_once(F.array(p[0] - 0.5, p[1] - 0.5), place)

        return F.filter(F.array(*[corner(dx, dy) for dy in (0, 1) for dx in (0, 1)]), lambda s: s.isNotNull())

    return _source_pixel(col, row, around)


def _mapped(work: DataFrame, grids: DataFrame, sources: DataFrame, strip_pixels: int, spot: Callable[[Column, Column], Column]) -> DataFrame:
    """(aoi_id, s_ layout, strip, map): spot() of each pixel of each strip, once for all rasters of a layout."""
    layout = sources.select("scene_id", *[F.col(c).alias(f"s_{c}") for c in _LAYOUT])
    names = [f"s_{c}" for c in _LAYOUT]
    met = work.select("aoi_id", "scene_id").join(layout, "scene_id").select("aoi_id", *names).distinct().join(grids, "aoi_id")
    lines = F.greatest(F.lit(1), F.floor(F.lit(strip_pixels) / F.col("width"))).cast("int")
    cut = met.withColumn("lines", lines).withColumn("strip", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / F.col("lines")).cast("int"))))
    first = F.col("strip") * F.col("lines")
    pixels = F.sequence(F.lit(0), F.least(F.col("lines"), F.col("height") - first) * F.col("width") - 1)
    return cut.select("aoi_id", *names, "strip", F.transform(pixels, lambda k: spot(k % F.col("width"), first + F.floor(k / F.col("width")))).alias("map"))


def strips(work: DataFrame, grids: DataFrame, sources: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """(aoi_id, s_ layout, strip, tile_number, spots): for each strip and tile it touches, where its pixels lie in the tile (-1: not there).

    A strip beside the raster has one row without a tile.
    """
    mapped = _mapped(work, grids, sources, strip_pixels, _nearest)
    touched = F.array_distinct(F.filter(F.transform("map", lambda m: m["tile_number"]), lambda n: n.isNotNull()))
    here = F.transform("map", lambda m: F.when(m["tile_number"] == F.col("tile_number"), m["at"]).otherwise(-1))
    return mapped.withColumn("tile_number", F.explode_outer(touched)).withColumn("spots", here).drop("map")


def on_grids(work: DataFrame, grids: DataFrame, sources: DataFrame, tiles: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """(aoi_id, scene_id, classes, error) of work's pairs: the nearest source pixel of each grid pixel, line by line; 0 where there is none.

    error tells of a raster that the grid does not overlap, of a missing tile or of an unknown raster.
    """
    names = [f"s_{c}" for c in _LAYOUT]
    layout = sources.select("scene_id", *[F.col(c).alias(f"s_{c}") for c in _LAYOUT])
    pairs = work.select("aoi_id", "scene_id").distinct()
    asked = pairs.join(layout, "scene_id").join(strips(work, grids, sources, strip_pixels), ["aoi_id", *names]).drop(*names)
    held = tiles.select("scene_id", "tile_number", "classes")
    got = asked.join(held, ["scene_id", "tile_number"], "left")
    values = F.transform("spots", lambda at: F.when(at >= 0, F.coalesce(F.get("classes", at), F.lit(0))).otherwise(0))
    parts = got.select("aoi_id", "scene_id", "strip", values.alias("v"), F.col("tile_number").isNotNull().alias("met"), (F.col("tile_number").isNotNull() & F.col("classes").isNull()).alias("lost"))
    merged = F.reduce(F.slice(F.collect_list("v"), 2, 1 << 30), F.get(F.collect_list("v"), F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    lines = parts.groupBy("aoi_id", "scene_id", "strip").agg(merged.alias("v"), F.bool_or("met").alias("met"), F.bool_or("lost").alias("lost"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("strip", "v"))), lambda s: s["v"]))
    read = lines.groupBy("aoi_id", "scene_id").agg(whole.alias("classes"), F.bool_or("met").alias("met"), F.bool_or("lost").alias("lost"))
    error = F.when(F.col("met").isNull(), "no raster").when(~F.col("met"), NO_OVERLAP).when(F.col("lost"), NO_TILE)
    return pairs.join(read, ["aoi_id", "scene_id"], "left").select("aoi_id", "scene_id", F.coalesce("classes", F.array().cast("array<int>")).alias("classes"), error.alias("error"))


def bands_on_grids(work: DataFrame, grids: DataFrame, sources: DataFrame, tiles: DataFrame, nodata: int | None = None, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """(aoi_id, scene_id, bands, valid) of work's pairs: bilinear values of each grid pixel and whether it is valid.

    tiles has bands, an array of each band's tile * tile values. A pixel is valid if the nearest
    source pixel is not 0 in all bands; else its values are 0. Source pixels that do not exist,
    and with nodata those that have it in a band, give that band nothing: the weights of the
    others count. The four neighbours may lie in four tiles: each tile gives its part of the
    weighted sums, and parts add up. Rasters without tiles are left out.
    """
    names = [f"s_{c}" for c in _LAYOUT]
    layout = sources.select("scene_id", *[F.col(c).alias(f"s_{c}") for c in _LAYOUT])
    mapped = _mapped(work, grids, sources, strip_pixels, _four)
    each = mapped.withColumn("tile_number", F.explode(F.array_distinct(F.transform(F.flatten("map"), lambda m: m["tile_number"]))))
    here = F.transform("map", lambda four: F.filter(four, lambda m: m["tile_number"] == F.col("tile_number")))
    mine = each.withColumn("map", here)
    got = work.select("aoi_id", "scene_id").distinct().join(layout, "scene_id").join(mine, ["aoi_id", *names]).drop(*names).join(tiles.select("scene_id", "tile_number", "bands"), ["scene_id", "tile_number"])

    def partial(four: Column) -> Column:
        """(sum, weight) of each band, and 1 if the nearest pixel is here and valid."""

        def of(band: Column) -> Column:
            used = F.filter(four, lambda m: F.lit(True) if nodata is None else F.get(band, m["at"]) != nodata)

            def both(u: Column) -> Column:
                return F.array(F.aggregate(u, F.lit(0.0), lambda t, m: t + m["weight"] * F.get(band, m["at"])), F.aggregate(u, F.lit(0.0), lambda t, m: t + m["weight"]))

            return computed_once(used, both)

        seen = F.exists(four, lambda m: m["nearest"] & F.exists("bands", lambda band: F.get(band, m["at"]) != 0))
        return F.concat(F.flatten(F.transform("bands", of)), F.array(F.when(seen, 1.0).otherwise(0.0)))

    sums = got.select("aoi_id", "scene_id", "strip", F.transform("map", partial).alias("p"))
    both = F.reduce(F.slice(F.collect_list("p"), 2, 1 << 30), F.get(F.collect_list("p"), F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda v, w: v + w)))
    lines = sums.groupBy("aoi_id", "scene_id", "strip").agg(both.alias("p"))
    blank = lines.select("aoi_id", "scene_id").distinct().join(grids, "aoi_id")
    n = F.greatest(F.lit(1), F.floor(F.lit(strip_pixels) / F.col("width"))).cast("int")
    due = blank.withColumn("strip", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / n).cast("int")))).withColumn("pixels", F.least(n, F.col("height") - F.col("strip") * n) * F.col("width"))
    filled = due.join(lines, ["aoi_id", "scene_id", "strip"], "left").select("aoi_id", "scene_id", "strip", F.coalesce("p", F.array_repeat(F.array().cast("array<double>"), F.col("pixels"))).alias("p"))

    def valid(p: Column) -> Column:
        return (F.size(p) > 0) & (F.element_at(p, -1) > 0)

    def value(p: Column, k: int) -> Column:
        ok = F.when(F.size(p) > 0, (F.element_at(p, -1) > 0) & (F.get(p, F.lit(2 * k + 1)) > 0)).otherwise(False)
        return F.when(ok, F.floor(F.get(p, F.lit(2 * k)) / F.get(p, F.lit(2 * k + 1)) + 0.5).cast("int")).otherwise(0)

    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("strip", "p"))), lambda s: s["p"]))
    out = filled.groupBy("aoi_id", "scene_id").agg(whole.alias("p"))
    return out.select("aoi_id", "scene_id", F.transform("p", lambda p: F.array(*[value(p, k) for k in range(3)])).alias("bands"), F.transform("p", lambda p: F.when(F.size(p) > 0, valid(p)).otherwise(False)).alias("valid"))


def band_composite(chips: DataFrame, by: tuple[str, ...] = ("aoi_id", "datatake_id")) -> DataFrame:
    """(by, bands): each pixel from the first scene in which it is valid, by nodata percentage (null last) and scene id; 0 without one."""
    masked = F.zip_with("bands", "valid", lambda b, v: F.when(v, b))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("nodata_pct", F.lit(float("inf"))).alias("r"), F.col("scene_id").alias("s"), masked.alias("c"))))
    grouped = chips.groupBy(*by).agg(F.transform(ordered, lambda x: x["c"]).alias("layers"))
    fill = F.reduce(F.slice("layers", 2, F.greatest(F.size("layers") - 1, F.lit(0))), F.element_at("layers", 1), lambda top, low: F.zip_with(top, low, lambda a, b: F.coalesce(a, b)))
    return grouped.select(*by, F.transform(fill, lambda b: F.coalesce(b, F.array_repeat(F.lit(0), F.lit(3)))).alias("bands"))


def tile_reader(grids: DataFrame, sources: DataFrame, tiles: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A reader for process(): classes over the pixels inside of each entity (grids with mask)."""

    def read(work: DataFrame) -> DataFrame:
        found = on_grids(work, grids.drop("mask"), sources, tiles).join(grids.select("aoi_id", "mask"), "aoi_id", "left")
        blank = F.transform(F.filter("mask", lambda m: m), lambda _: F.lit(0))
        inside = F.filter(F.zip_with("classes", "mask", lambda c, m: F.when(m, c)), lambda c: c.isNotNull())
        shown = found.select("aoi_id", "scene_id", F.when(F.col("error").isNull(), inside).otherwise(F.coalesce(blank, F.array().cast("array<int>"))).alias("classes"), "error")
        return work.join(shown, ["aoi_id", "scene_id"])

    return read


def to_runs(classes: Column) -> Column:
    """An array of values (without nulls) as array<struct<value, count>> of its runs, in linear time."""

    def cut(values: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == F.size(values) - 1) | (F.get(values, i) != F.get(values, i + 1)))
        runs = computed_once(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.get(values, i).alias("value"), (i - F.when(k > 0, F.get(e, k - 1)).otherwise(-1)).alias("count"))))
        return F.when(F.size(values) > 0, runs).otherwise(F.array().cast("array<struct<value:int,count:int>>"))

    return computed_once(classes, cut)


def from_runs(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["count"])))


def count_in_runs(runs: str, value: int) -> Column:
    """How many entries of the coded array are value."""
    return F.aggregate(runs, F.lit(0), lambda n, r: n + F.when(r["value"] == value, r["count"]).otherwise(0))


def merged_runs(top: Column, low: Column) -> Column:
    """Runs of top with low's values where top is 0: cut at the ends of both, never unfolded."""

    def ends(runs: Column) -> Column:
        empty = F.array().cast("array<int>")
        return F.aggregate(runs, empty, lambda all_, r: F.concat(all_, F.array(F.coalesce(F.try_element_at(all_, F.lit(-1)), F.lit(0)) + r["count"])))

    def at(runs: Column, bounds: Column, end: Column) -> Column:
        """The value of the run that holds the entry before end."""
        return F.get(runs, F.array_position(F.transform(bounds, lambda b: b >= end), True).cast("int") - 1)["value"]

    def laid(both: Column) -> Column:
        a, b = both[0], both[1]
        cuts = F.array_sort(F.array_distinct(F.concat(a, b)))

        def values(c: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                over = at(top, a, end)
                return F.struct(F.when(over == 0, at(low, b, end)).otherwise(over).alias("value"), (end - F.when(k > 0, F.get(c, k - 1)).otherwise(0)).alias("count"))

            return F.transform(c, one)

        return computed_once(cuts, values)

    return computed_once(F.array(ends(top), ends(low)), laid)


def run_composite(scenes: DataFrame, by: tuple[str, ...] = ("aoi_id", "datatake_id")) -> DataFrame:
    """array_composite on run-length codes (column runs): each pixel's first non-zero class by nodata percentage (null last) and scene id."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("nodata_pct", F.lit(float("inf"))).alias("r"), F.col("scene_id").alias("s"), F.col("runs").alias("c"))))
    grouped = scenes.groupBy(*by).agg(F.transform(ordered, lambda x: x["c"]).alias("layers"))
    fill = F.reduce(F.slice("layers", 2, F.greatest(F.size("layers") - 1, F.lit(0))), F.element_at("layers", 1), merged_runs)
    return grouped.select(*by, fill.alias("runs"))
