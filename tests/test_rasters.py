import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywait.functions import geometry
from skywait.operators import composite, rasters

GRID = "aoi_id string, epsg long, left double, top double, width int, height int, step double"
SOURCE = "scene_id string, epsg long, left double, top double, width int, height int, step double, tile int"
TILE = "scene_id string, tile_number int, classes array<int>"


def plain_read(grid, source, image):
    """Nearest pixels by numpy, pixel for pixel."""
    _, epsg, left, top, width, height, step = grid
    _, s_epsg, s_left, s_top, s_width, s_height, s_step, _ = source
    x, y = np.meshgrid(left + (np.arange(width) + 0.5) * step, top - (np.arange(height) + 0.5) * step)
    if epsg != s_epsg:
        x, y = geometry.to_utm(*geometry.from_utm(x, y, epsg), s_epsg)
    c, r = np.floor((x - s_left) / s_step).astype(int), np.floor((s_top - y) / s_step).astype(int)
    inside = (c >= 0) & (c < s_width) & (r >= 0) & (r < s_height)
    return np.where(inside, image[r.clip(0, s_height - 1), c.clip(0, s_width - 1)], 0), inside.any()


def tiled(source, image):
    side, rows = source[-1], []
    across = -(-image.shape[1] // side)
    for r in range(0, image.shape[0], side):
        for c in range(0, image.shape[1], side):
            part = np.zeros((side, side), dtype=int)
            cut = image[r : r + side, c : c + side]
            part[: cut.shape[0], : cut.shape[1]] = cut
            rows.append((source[0], r // side * across + c // side, part.ravel().tolist()))
    return rows


def scene(rng, name, epsg, left, top, width, height, step, tile):
    source = (name, epsg, left, top, width, height, step, tile)
    image = np.array([[rng.randint(0, 11) for _ in range(width)] for _ in range(height)])
    return source, image


@pytest.mark.parametrize("strip", [7, 60, 4096])
def test_windows_equal_a_plain_loop(spark, strip):
    rng = random.Random(1)
    x33, y33 = (float(v[0]) for v in geometry.to_utm(np.array([52.5]), np.array([12.1]), 32633))
    x32, y32 = (float(v[0]) for v in geometry.to_utm(np.array([52.5]), np.array([12.1]), 32632))
    grids = [("here", 32633, x33 - 200, y33 + 200, 21, 17, 20.0), ("other", 32632, x32 - 310, y32 + 90, 9, 30, 20.0), ("far", 32633, x33 + 1e5, y33, 4, 4, 20.0)]
    made = [
        scene(rng, "same", 32633, x33 - 400, y33 + 400, 50, 41, 20.0, 16), scene(rng, "coarse", 32633, x33 - 130, y33 + 115, 7, 9, 60.0, 4),
        scene(rng, "zone", 32632, x32 - 380, y32 + 400, 60, 60, 17.0, 13), scene(rng, "twin", 32632, x32 - 380, y32 + 400, 60, 60, 17.0, 13),
    ]
    tiles = [t for s, i in made for t in tiled(s, i)]
    work = [(g[0], s[0]) for g in grids for s, _ in made] + [("here", "unknown")]
    asked = spark.createDataFrame(work, "aoi_id string, scene_id string")
    out = rasters.on_grids(asked, spark.createDataFrame(grids, GRID), spark.createDataFrame([s for s, _ in made], SOURCE), spark.createDataFrame(tiles, TILE), strip)
    got = {(r.aoi_id, r.scene_id): r for r in out.collect()}
    assert len(got) == len(work) and got["here", "unknown"].error == "no raster"
    for g in grids:
        for s, image in made:
            want, there = plain_read(g, s, image)
            row = got[g[0], s[0]]
            assert (row.error is None) == there and row.classes == want.ravel().tolist(), (g, s)
            assert there or row.error == rasters.NO_OVERLAP
    assert sum(r.error is None for r in got.values()) == 7


def test_a_round_trip_between_zones(spark):
    x, y = (float(v[0]) for v in geometry.to_utm(np.array([48.1]), np.array([11.9]), 32632))
    df = spark.createDataFrame([(x + k * 13.0, y - k * 7.0, 32632, 32633) for k in range(50)] + [(400_000.0, 6_200_000.0, 32733, 32734)], "x double, y double, a long, b long")
    there = df.withColumn("p", geometry.between_zones(F.col("x"), F.col("y"), F.col("a"), F.col("b")))
    back = there.withColumn("q", geometry.between_zones(F.col("p")[0], F.col("p")[1], F.col("b"), F.col("a"))).collect()
    for r in back:
        assert abs(r.q[0] - r.x) < 5e-3 and abs(r.q[1] - r.y) < 5e-3  # the series ends at the third order
        want = geometry.to_utm(*geometry.from_utm(np.array([r.x]), np.array([r.y]), r.a), r.b)
        assert abs(r.p[0] - want[0][0]) < 1e-6 and abs(r.p[1] - want[1][0]) < 1e-6


def test_missing_tiles_and_entities(spark):
    rng = random.Random(5)
    ring = geometry.square(52.52, 13.405, 32633, 0.2)[0]
    places = spark.createDataFrame([("berlin", 32633, ring)], "aoi_id string, utm_epsg long, ring array<array<double>>")
    grids = rasters.entity_grids(places)
    g = grids.first()
    assert g.width * g.height == len(g["mask"]) and 90 <= sum(g["mask"]) <= 110
    source, image = scene(rng, "a", 32633, g.left - 60, g.top + 60, g.width + 6, g.height + 6, 20.0, 8)
    tiles = tiled(source, image)
    sources = spark.createDataFrame([source, ("b", *source[1:])], SOURCE)
    held = spark.createDataFrame([*tiles, *[("b", n, c) for _, n, c in tiles[1:]]], TILE)
    work = spark.createDataFrame([("berlin", "a", 1), ("berlin", "b", 2), ("berlin", "c", 3)], "aoi_id string, scene_id string, more int")
    got = {r.scene_id: r for r in rasters.tile_reader(grids, sources, held)(work).collect()}
    want, _ = plain_read(("berlin", 32633, g.left, g.top, g.width, g.height, 20.0), source, image)
    assert got["a"].error is None and got["a"].classes == want.ravel()[np.array(g["mask"])].tolist() and got["a"].more == 1
    assert got["b"].error == rasters.NO_TILE and got["c"].error == "no raster"
    assert [len(got[k].classes) for k in "abc"] == [sum(g["mask"])] * 3 and set(got["c"].classes) == {0}


def test_runs_are_lossless_and_count_alike(spark):
    rng = random.Random(3)
    arrays = [[], [4], [0, 0, 0], [k for k in range(12) for _ in range(rng.randint(1, 9))], [rng.randint(0, 2) for _ in range(300)]]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(arrays)], "id int, classes array<int>").withColumn("runs", rasters.to_runs(F.col("classes")))
    rows = df.withColumn("back", rasters.from_runs(F.col("runs"))).withColumns({f"n{k}": rasters.count_in_runs("runs", k) for k in range(12)}).collect()
    for r in rows:
        assert r.back == r.classes and [r[f"n{k}"] for k in range(12)] == [r.classes.count(k) for k in range(12)]
        assert all(a.value != b.value for a, b in zip(r.runs, r.runs[1:], strict=False))


def test_composite_on_runs(spark):
    rng = random.Random(8)
    rows = []
    for take in range(6):
        n = rng.randint(1, 40)
        rows += [("a", f"t{take}", f"s{k}", rng.choice([None, 5.0, 5.0, 20.0]), [rng.choice([0, 0, 4, 9]) for _ in range(n)]) for k in range(rng.randint(1, 4))]
    scenes = spark.createDataFrame(rows, "aoi_id string, datatake_id string, scene_id string, nodata_pct double, classes array<int>")
    coded = scenes.withColumn("runs", rasters.to_runs(F.col("classes"))).drop("classes")
    got = {r.datatake_id: r.c for r in rasters.run_composite(coded).select("datatake_id", rasters.from_runs(F.col("runs")).alias("c")).collect()}
    assert got == {r.datatake_id: r.classes for r in composite.array_composite(scenes).collect()}


def plain_bands(grid, source, image, nodata):
    """Bilinear values and validity, pixel by pixel; image is [bands, rows, columns]."""
    _, epsg, left, top, width, height, step = grid
    _, s_epsg, s_left, s_top, s_width, s_height, s_step, _ = source
    values, valid = [], []
    for row in range(height):
        for col in range(width):
            x, y = np.array([left + (col + 0.5) * step]), np.array([top - (row + 0.5) * step])
            if epsg != s_epsg:
                x, y = geometry.to_utm(*geometry.from_utm(x, y, epsg), s_epsg)
            px, py = (x[0] - s_left) / s_step, (s_top - y[0]) / s_step
            c, r = int(np.floor(px)), int(np.floor(py))
            ok = 0 <= c < s_width and 0 <= r < s_height and bool(image[:, r, c].any())
            out = [0, 0, 0]
            for b in range(3):
                total = weight = 0.0
                for j in (0, 1):
                    for i in (0, 1):
                        cc, rr = int(np.floor(px - 0.5)) + i, int(np.floor(py - 0.5)) + j
                        if 0 <= cc < s_width and 0 <= rr < s_height and (nodata is None or image[b, rr, cc] != nodata):
                            w = (1 - abs(px - 0.5 - cc)) * (1 - abs(py - 0.5 - rr))
                            total, weight = total + w * image[b, rr, cc], weight + w
                if ok and weight > 0:
                    out[b] = int(np.floor(total / weight + 0.5))
            values.append(out)
            valid.append(ok)
    return values, valid


@pytest.mark.parametrize(("nodata", "strip"), [(None, 4096), (0, 11)])
def test_bilinear_bands_across_tiles_and_at_invalid_pixels(spark, nodata, strip):
    rng = np.random.default_rng(6)
    grids = [("in", 32633, 500_013.0, 5_800_487.0, 11, 9, 20.0), ("edge", 32633, 499_903.0, 5_800_519.0, 8, 13, 23.0), ("zone", 32632, 910_000.0, 5_818_000.0, 6, 5, 20.0)]
    x, y = geometry.to_utm(*geometry.from_utm(np.array([910_060.0]), np.array([5_817_950.0]), 32632), 32633)
    layouts = [("s1", 32633, 500_000.0, 5_800_500.0, 23, 19, 10.0, 8), ("s2", 32633, 500_040.0, 5_800_500.0, 5, 5, 60.0, 2), ("s3", 32633, float(x[0]) - 90, float(y[0]) + 90, 20, 20, 10.0, 7)]
    images = {s[0]: rng.integers(0, 256, (3, s[5], s[4])) * (rng.random((s[5], s[4])) > 0.3) for s in layouts}
    tiles = []
    for s in layouts:
        cut = [tiled(s, band) for band in images[s[0]]]
        tiles += [(s[0], parts[0][1], [p[2] for p in parts]) for parts in zip(*cut, strict=True)]
    work = [(g[0], s[0]) for g in grids for s in layouts]
    got = rasters.bands_on_grids(
        spark.createDataFrame(work, "aoi_id string, scene_id string"), spark.createDataFrame(grids, GRID), spark.createDataFrame(layouts, SOURCE),
        spark.createDataFrame(tiles, "scene_id string, tile_number int, bands array<array<int>>"), nodata, strip,
    ).collect()
    seen = {(r.aoi_id, r.scene_id): r for r in got}
    for g in grids:
        for s in layouts:
            values, valid = plain_bands(g, s, images[s[0]], nodata)
            if (g[0], s[0]) not in seen:
                assert not any(valid)
                continue
            row = seen[g[0], s[0]]
            assert row.valid == valid and row.bands == values, (g, s)
    assert len(seen) == 5 and any(any(r.valid) and not all(r.valid) for r in got)


def test_pictures_are_filled_in_order(spark):
    rows = [("a", "t", "s2", 5.0, [[1, 1, 1], [2, 2, 2], [0, 0, 0]], [True, True, False]), ("a", "t", "s1", None, [[9, 9, 9]] * 3, [True, True, False]), ("a", "t", "s0", 1.0, [[7, 0, 0], [0, 0, 0], [0, 0, 0]], [True, False, False])]
    df = spark.createDataFrame(rows, "aoi_id string, datatake_id string, scene_id string, nodata_pct double, bands array<array<int>>, valid array<boolean>")
    assert rasters.band_composite(df).first().bands == [[7, 0, 0], [2, 2, 2], [0, 0, 0]]
