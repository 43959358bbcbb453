import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywait.errors import DataError
from skywait.operators import rasters
from skywait.sources import geotiff

MADE = "name string, epsg long, left double, top double, width int, height int, step double, classes array<int>"


def plain_file(image, order="<", strips=None, tile=None, apart=False, deflate=False, differences=False, point=False):
    """A file of image (lines, columns, samples), written the long way."""
    height, width, samples = image.shape
    kind = image.dtype.newbyteorder(order)
    planes = [image[:, :, k : k + 1] for k in range(samples)] if apart else [image]
    blocks = []
    for p in planes:
        for r in range(0, height, tile or strips):
            for c in range(0, width, tile or width):
                cut = p[r : r + (tile or strips), c : c + (tile or width)]
                if tile:
                    cut = np.pad(cut, ((0, tile - cut.shape[0]), (0, tile - cut.shape[1]), (0, 0)))
                if differences:
                    cut = np.concatenate([cut[:, :1], cut[:, 1:] - cut[:, :-1]], 1)
                raw = cut.astype(kind).tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    body, offsets = b"", []
    for b in blocks:
        offsets.append(8 + len(body))
        body += b
    where = [(322, "H", [tile]), (323, "H", [tile]), (324, "I", offsets), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", offsets), (278, "I", [strips]), (279, "I", [len(b) for b in blocks])]
    tags = [
        (256, "I", [width]), (257, "H", [height]), (258, "H", [8 * kind.itemsize] * samples), (259, "H", [8 if deflate else 1]), (277, "H", [samples]), (284, "H", [2 if apart else 1]),
        (317, "H", [2 if differences else 1]), *where, (339, "H", [2 if kind.kind == "i" else 1] * samples), (33550, "d", [10.0, 10.0, 0.0]), (33922, "d", [1.0, 2.0, 0.0, 500.0, 900.0, 0.0]),
        (34735, "H", [1, 1, 0, 2, 1025, 0, 1, 2 if point else 1, 3072, 0, 1, 32633]),
    ]
    at = 8 + len(body)
    entries, tail, codes = b"", b"", {"H": 3, "I": 4, "d": 12}
    for tag, form, items in sorted(tags):
        raw = struct.pack(f"{order}{len(items)}{form}", *items)
        if len(raw) > 4:
            raw, tail = struct.pack(order + "I", at + 2 + 12 * len(tags) + 4 + len(tail)), tail + raw
        entries += struct.pack(order + "HHI", tag, codes[form], len(items)) + raw.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + tail


def pieced(source, tiles, band):
    """The image of a source's tiles."""
    across, down = -(-source.width // source.tile), -(-source.height // source.tile)
    assert sorted(tiles) == list(range(across * down))
    lines = [np.concatenate([np.reshape(tiles[r * across + c][band], (source.tile, source.tile)) for c in range(across)], 1) for r in range(down)]
    return np.concatenate(lines)[: source.height, : source.width]


def test_files_of_all_layouts(spark, tmp_path):
    rng = np.random.default_rng(3)
    forms = {
        "strips": {"strips": 5}, "one": {"strips": 41, "order": ">"}, "tiles": {"tile": 16, "deflate": True}, "apart": {"tile": 16, "apart": True, "order": ">"},
        "steps": {"tile": 32, "deflate": True, "differences": True}, "both": {"strips": 7, "apart": True, "deflate": True, "differences": True, "point": True},
    }
    want = {}
    for k, (name, form) in enumerate(forms.items()):
        kind = ("u1", "u2", "i2", "u1", "u2", "i4")[k]
        image = rng.integers(-300 if kind[0] == "i" else 0, 250, (41, 37, 1 if k == 0 else 3)).astype(kind)
        (tmp_path / f"{name}.tif").write_bytes(plain_file(image, **form))
        want[name] = image
    whole = plain_file(want["tiles"], tile=16, deflate=True)
    (tmp_path / "text.tif").write_bytes(b"no raster")
    (tmp_path / "empty.tiff").write_bytes(b"")
    (tmp_path / "torn.tif").write_bytes(plain_file(want["strips"], strips=5)[:300])
    spoilt = bytearray(whole)
    spoilt[8 + 2000 : 8 + 2400] = bytes(400)
    (tmp_path / "spoilt.tif").write_bytes(spoilt)
    sources, tiles, failures = geotiff.read_rasters(spark, str(tmp_path), tile=12)
    assert {r.scene_id for r in failures.collect()} == {"text", "torn", "spoilt"}
    found = {r.scene_id: r for r in sources.collect()}
    assert set(found) == set(want)
    held = {}
    for r in tiles.where(F.col("scene_id").isin(*want)).collect():
        held.setdefault(r.scene_id, {})[r.tile_number] = r.bands
        assert r.classes == r.bands[0]
    for name, image in want.items():
        s = found[name]
        shift = 5.0 if name == "both" else 0.0
        assert (s.epsg, s.left, s.top, s.step) == (32633, 490.0 - shift, 920.0 + shift, 10.0)
        for band in range(image.shape[2]):
            assert (pieced(s, held[name], band) == image[:, :, band]).all(), (name, band)


def test_what_is_written_is_read(spark, tmp_path):
    rng = random.Random(4)
    made = [(f"raster {k}/{k}%é", 32632 + k, 400_000.0 - k, 5_800_000.0 + k, 300 + k, 7 * k + 1, 20.0, [rng.randint(0, top) for _ in range((300 + k) * (7 * k + 1))]) for k, top in enumerate((11, 300, 70_000))]
    rows = spark.createDataFrame(made, MADE)
    for _ in range(2):  # again over the same files
        geotiff.write_rasters(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 3
    sources, tiles, failures = geotiff.read_rasters(spark, f"file://{tmp_path}/out", tile=128)
    assert failures.isEmpty()
    found = {r.scene_id: r for r in sources.collect()}
    for name, epsg, left, top, width, height, step, classes in made:
        s = found[name]
        assert (s.epsg, s.left, s.top, s.width, s.height, s.step) == (epsg, left, top, width, height, step)
        mine = {r.tile_number: r.bands for r in tiles.where(F.col("scene_id") == name).collect()}
        assert pieced(s, mine, 0).ravel().tolist() == classes
    grid = spark.createDataFrame([("a", *made[0][1:7])], "aoi_id string, epsg long, left double, top double, width int, height int, step double")
    read = rasters.on_grids(spark.createDataFrame([("a", made[0][0])], "aoi_id string, scene_id string"), grid, sources, tiles).first()
    assert read.error is None and read.classes == made[0][7]


def test_kept_composites_are_written_inside_of_their_masks(spark, tmp_path):
    grids = spark.createDataFrame([("a", 32633, 0.0, 40.0, 3, 2, 20.0, [True, False, True, False, True, True])], "aoi_id string, epsg long, left double, top double, width int, height int, step double, mask array<boolean>")
    kept = spark.createDataFrame([("a", "t1", [4, 4, 9, 0])], "aoi_id string, datatake_id string, c array<int>").select("aoi_id", "datatake_id", rasters.to_runs(F.col("c")).alias("runs"))
    geotiff.write_rasters(geotiff.kept_composites(kept, grids), str(tmp_path))
    row = geotiff.read_files(spark, str(tmp_path), tile=3).first()
    assert row.scene_id == "a_t1" and row.bands == [[4, 0, 4, 0, 9, 0, 0, 0, 0]]


def test_rows_that_are_no_rasters(spark, tmp_path):
    row = ("a", 32633, 0.0, 0.0, 1, 1, 20.0, [1])
    for rows in ([row, row], [(None, *row[1:])], [(*row[:-1], None)]):
        with pytest.raises(DataError):
            geotiff.write_rasters(spark.createDataFrame(rows, MADE), str(tmp_path))
    geotiff.write_rasters(spark.createDataFrame([], MADE), str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_command_line_from_files_to_files(spark, tmp_path, monkeypatch):
    from skywait import cli
    from skywait.plans import stages
    from skywait.sources import tables

    monkeypatch.setattr(cli, "session", lambda: spark)
    data = str(tmp_path / "data")
    (tmp_path / "c.csv").write_text("aoi_id,name,country,lat,lon\nberlin,Berlin,Germany,52.52,13.405\n")
    (tmp_path / "c.yaml").write_text(f"start: 2025-01-01\nend: 2025-06-30\naois: [berlin]\ndata_dir: {data}\nhorizon_days: 60\nmin_clear: 0.5\nmin_coverage: 0.5\n")
    common = ["--config", str(tmp_path / "c.yaml")]
    assert cli.main(["aois", str(tmp_path / "c.csv"), data, "--size-km", "0.4"]) == 0
    ring = [[[13, 52], [14, 52], [14, 53], [13, 53], [13, 52]]]
    found = [
        {"id": f"S{k}", "type": "Feature", "geometry": {"type": "Polygon", "coordinates": ring}, "assets": {},
         "properties": {"datetime": f"2025-0{k + 1}-10T10:00:00Z", "s2:datatake_id": f"take{k}", "platform": "sentinel-2a", "s2:mgrs_tile": "33UUU"}}
        for k in range(3)
    ]
    (tmp_path / "berlin.json").write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    assert cli.main(["discover", str(tmp_path / "berlin.json"), *common]) == 0
    grid = stages.stored_grids(spark, data).first()
    made = [(f"S{k}", grid.epsg, grid.left - 60.0, grid.top + 80.0, grid.width + 7, grid.height + 9, 20.0, [4 if k else 9] * ((grid.width + 7) * (grid.height + 9))) for k in range(2)]
    geotiff.write_rasters(spark.createDataFrame(made, MADE), str(tmp_path / "rasters"))  # there is none of S2
    assert cli.main(["process", "--rasters", str(tmp_path / "rasters"), "--geotiff", "--keep-rasters", *common]) == 0
    obs = {r.datatake_id: r for r in tables.read_or_empty(spark, data, "observations").collect()}
    assert {t: (r.complete, r.usable) for t, r in obs.items()} == {"take0": (True, False), "take1": (True, True), "take2": (False, False)}
    assert obs["take1"].n_aoi_pixels == sum(grid.mask)
    assert cli.main(["export", str(tmp_path / "out"), *common]) == 0
    sources, tiles, _ = geotiff.read_rasters(spark, str(tmp_path / "out"))
    heads = {r.scene_id: r for r in sources.collect()}
    assert set(heads) == {f"berlin_take{k}" for k in range(3)}
    for k, value in enumerate((9, 4, 0)):
        name = f"berlin_take{k}"
        got = pieced(heads[name], {r.tile_number: r.bands for r in tiles.where(F.col("scene_id") == name).collect()}, 0).ravel()
        assert got.tolist() == [value if m else 0 for m in grid.mask]
