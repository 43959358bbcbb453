"""Rasters in GeoTIFF files: read as tables of tiles for operators.rasters, written one file a raster.

Files are read by Spark's binary files, decoded in tasks a line of tiles at a time. Read are classic
TIFF files on a north-up grid of square pixels in a projected zone: in strips or tiles, bands
together or apart, whole numbers of 8 or 16 bits or signed ones of 32, plain or DEFLATE, with or
without horizontal differences. The first image counts, others (overviews) do not. A file that cannot
be read is a row of its own with its error. Written files hold one band in tiles, DEFLATE, 0 without data.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..errors import DataError
from .shared import settle

TILE = 256
# Tag and key numbers, type codes and code values of the public TIFF 6.0 and GeoTIFF formats (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_LINES, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
MODEL_KEY, RASTER_KEY, ZONE_KEY = 1024, 1025, 3072
PLAIN, DEFLATE = (1,), (8, 32946)
FORMATS = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d"}

LAYOUT = "epsg long, left double, top double, width int, height int, step double, tile int"
RASTER = f"scene_id string, {LAYOUT}, tile_number int, bands array<array<int>>, error string"
_ARROW = pa.schema(
    [("scene_id", pa.string()), ("epsg", pa.int64()), ("left", pa.float64()), ("top", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("step", pa.float64()),
     ("tile", pa.int32()), ("tile_number", pa.int32()), ("bands", pa.list_(pa.list_(pa.int32()))), ("error", pa.string())]
)


class Image:
    """The first image of a file's bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.order = data, {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if not self.order or self._at("H", 2) != 42:
            raise ValueError("not a classic TIFF file")
        tags = self._tags(self._at("I", 4))
        one = {t: v[0] for t, v in tags.items() if v}
        self.width, self.height, self.samples = one[WIDTH], one[HEIGHT], one.get(SAMPLES, 1)
        self.apart, self.packed, self.differences = one.get(PLANAR, 1) == 2, one.get(COMPRESSION, 1), one.get(PREDICTOR, 1)
        form = (one.get(SAMPLE_FORMAT, 1), one.get(BITS, 1))
        if form not in [(1, 8), (1, 16), (2, 8), (2, 16), (2, 32)] or len(set(tags.get(BITS, ()))) > 1:
            raise ValueError(f"samples of format {form[0]} and {form[1]} bits are not read")
        if self.packed not in PLAIN + DEFLATE or self.differences not in (1, 2):
            raise ValueError(f"compression {self.packed} with predictor {self.differences} is not read")
        self.kind = np.dtype(f"{self.order}{'u' if form[0] == 1 else 'i'}{form[1] // 8}")
        if TILE_OFFSETS in tags:
            self.across, self.down, self.tiled = one[TILE_WIDTH], one[TILE_HEIGHT], True
            self.offsets, self.sizes = tags[TILE_OFFSETS], tags[TILE_BYTES]
        else:
            self.across, self.down, self.tiled = self.width, min(one.get(STRIP_LINES, self.height), self.height), False
            self.offsets, self.sizes = tags[STRIP_OFFSETS], tags[STRIP_BYTES]
        if PIXEL_SCALE not in tags or TIE_POINT not in tags or tags[PIXEL_SCALE][0] != tags[PIXEL_SCALE][1]:
            raise ValueError("no north-up grid of square pixels")
        keys = np.reshape(tags.get(GEO_KEYS, ()), (-1, 4))
        key = {int(k): int(v) for k, place, _, v in keys[1:] if place == 0}
        if ZONE_KEY not in key:
            raise ValueError("no projected zone")
        self.epsg, self.step = key[ZONE_KEY], float(tags[PIXEL_SCALE][0])
        col, row, _, x, y, _ = tags[TIE_POINT][:6]
        half = 0.5 if key.get(RASTER_KEY, 1) == 2 else 0.0  # the point is a pixel's centre
        self.left, self.top = x - (col + half) * self.step, y + (row + half) * self.step
        self.held: dict[tuple[int, int, int], np.ndarray] = {}

    def _at(self, form: str, place: int) -> int:
        return struct.unpack_from(self.order + form, self.data, place)[0]

    def _tags(self, start: int) -> dict[int, tuple]:
        found = {}
        for place in range(start + 2, start + 2 + 12 * self._at("H", start), 12):
            tag, kind, count = struct.unpack_from(self.order + "HHI", self.data, place)
            if form := FORMATS.get(kind):
                here = place + 8 if count * struct.calcsize("=" + form) <= 4 else self._at("I", place + 8)
                found[tag] = struct.unpack_from(f"{self.order}{count}{form}", self.data, here)
        return found

    def block(self, row: int, col: int, plane: int) -> np.ndarray:
        """Lines, columns and samples of a tile or strip; one that the file leaves out is 0."""
        a_line, a_plane = -(-self.width // self.across), -(-self.height // self.down)
        k = plane * a_line * a_plane + row * a_line + col
        lines = self.down if self.tiled else min(self.down, self.height - row * self.down)
        shape = (lines, self.across, 1 if self.apart else self.samples)
        if not self.sizes[k]:
            return np.zeros(shape, dtype=self.kind)
        raw, size = self.data[self.offsets[k] : self.offsets[k] + self.sizes[k]], int(np.prod(shape)) * self.kind.itemsize
        raw = raw[:size] if self.packed in PLAIN else zlib.decompressobj().decompress(raw, size)
        if len(raw) < size:
            raise ValueError("a block of the file is too short")
        values = np.frombuffer(raw, dtype=self.kind).reshape(shape)
        return np.cumsum(values, axis=1, dtype=self.kind.newbyteorder("=")) if self.differences == 2 else values

    def lines(self, lo: int, hi: int) -> np.ndarray:
        """(lines, columns, samples) of lines lo to hi; asked from top to bottom, so blocks above go."""
        self.held = {k: v for k, v in self.held.items() if (k[0] + 1) * self.down > lo}
        out = np.zeros((hi - lo, self.width, self.samples), dtype=np.int32)
        for row in range(lo // self.down, -(-hi // self.down)):
            for col in range(-(-self.width // self.across)):
                for plane in range(self.samples if self.apart else 1):
                    if (row, col, plane) not in self.held:
                        self.held[row, col, plane] = self.block(row, col, plane)
                    top, left = row * self.down, col * self.across
                    part = self.held[row, col, plane][max(lo - top, 0) : hi - top, : self.width - left]
                    at = max(top, lo) - lo
                    out[at : at + len(part), left : left + part.shape[1], slice(plane, plane + 1) if self.apart else slice(None)] = part
        return out


def decoded(scene_id: str, data: bytes, tile: int) -> Iterator[pa.RecordBatch]:
    """RASTER rows of a file, a batch for each line of tiles; the last one tells of an error."""
    try:
        image = Image(data)
        layout = {"scene_id": scene_id, "epsg": image.epsg, "left": image.left, "top": image.top, "width": image.width, "height": image.height, "step": image.step, "tile": tile}
        number = 0
        for lo in range(0, image.height, tile):
            got = image.lines(lo, min(lo + tile, image.height))
            across = -(-image.width // tile)
            whole = np.zeros((tile, across * tile, image.samples), dtype=np.int32)
            whole[: len(got), : image.width] = got
            parts = whole.reshape(tile, across, tile, image.samples).transpose(1, 3, 0, 2)
            rows = [layout | {"tile_number": number + k, "bands": list(part.reshape(image.samples, -1)), "error": None} for k, part in enumerate(parts)]
            number += across
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
        yield pa.RecordBatch.from_pylist([{"scene_id": scene_id, "error": f"not read: {e}"}], _ARROW)


def read_files(spark: SparkSession, folder: str, tile: int = TILE) -> DataFrame:
    """RASTER rows of all GeoTIFF files in a folder and below; scene_id is the file's name. Spark leaves out files without bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                name = unquote(path.as_py().rsplit("/", 1)[-1].rsplit(".", 1)[0])
                yield from decoded(name, content.as_py(), tile)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,tiff}").load(folder)
    return files.select("path", "content").mapInArrow(decode, RASTER)


def read_rasters(spark: SparkSession, folder: str, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, tiles, failures) of a folder, for rasters.on_grids (classes: the first band) and bands_on_grids.

    A file with an error anywhere has no source. Files of one name in several folders are an error too.
    """
    rows = settle(read_files(spark, folder, tile))
    heads = rows.where("tile_number = 0").groupBy("scene_id").agg(F.count("*").alias("n"), *[F.first(c.split()[0]).alias(c.split()[0]) for c in LAYOUT.split(", ")])
    twice = heads.where("n > 1").select("scene_id", F.lit("not read: several files of one name").alias("error"))
    failures = rows.where("error is not null").select("scene_id", "error").unionByName(twice)
    good = heads.drop("n").join(failures, "scene_id", "left_anti")
    return good, rows.where("error is null").select("scene_id", "tile_number", F.get("bands", F.lit(0)).alias("classes"), "bands"), failures


def encoded(values: np.ndarray, epsg: int, left: float, top: float, step: float, tile: int = TILE) -> bytes:
    """A one-band file of a grid of whole numbers."""
    height, width = values.shape
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    kind = np.dtype("<u1" if 0 <= low and high < 256 else "<u2" if 0 <= low and high < 65536 else "<i4")
    blocks = []
    for r in range(0, height, tile):
        for c in range(0, width, tile):
            part = np.zeros((tile, tile), dtype=kind)
            cut = values[r : r + tile, c : c + tile]
            part[: cut.shape[0], : cut.shape[1]] = cut
            blocks.append(zlib.compress(part.tobytes()))
    places = 8 + np.cumsum([0, *map(len, blocks)])
    tags = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * kind.itemsize]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]),
        (TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (TILE_OFFSETS, 4, places[:-1].tolist()), (TILE_BYTES, 4, [len(b) for b in blocks]), (SAMPLE_FORMAT, 3, [2 if kind.kind == "i" else 1]),
        (PIXEL_SCALE, 12, [step, step, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, left, top, 0.0]),
        (GEO_KEYS, 3, [1, 1, 0, 3, MODEL_KEY, 0, 1, 1, RASTER_KEY, 0, 1, 1, ZONE_KEY, 0, 1, epsg]), (NODATA, 2, [b"0", b"\0"]),
    ]
    start = int(places[-1]) + int(places[-1]) % 2
    after, entries, tail = start + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind_, items in tags:
        raw = struct.pack(f"<{len(items)}{FORMATS[kind_]}", *items)
        if len(raw) > 4:
            raw, tail = struct.pack("<I", after + len(tail)), tail + raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, kind_, len(items)) + raw.ljust(4, b"\0")
    body = b"".join(blocks).ljust(start - 8, b"\0")
    return b"II" + struct.pack("<HI", 42, start) + body + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + tail


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _file_system(self.folder)
        for b in iterator:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k] for c in b.schema.names}
                plain = {c: r[c].as_py() for c in ("name", "epsg", "left", "top", "width", "height", "step")}
                values, mask = (np.asarray(r[c].values.to_numpy(zero_copy_only=False)) if r[c].is_valid else None for c in ("classes", "mask"))
                grid = np.zeros(plain["width"] * plain["height"], dtype=np.int64)
                grid[slice(None) if mask is None else mask.astype(bool)] = values
                data = encoded(grid.reshape(plain["height"], plain["width"]), *(plain[c] for c in ("epsg", "left", "top", "step")))
                aside, target = f"{root}/.{uuid.uuid4().hex}", f"{root}/{quote(plain['name'], safe=' ')}.tif"
                with files.open_output_stream(aside) as out:
                    out.write(data)
                files.move(aside, target)
        return WriterCommitMessage()


class GeoTiffSink(DataSource):
    """A sink of rasters; write_rasters() gives it what it wants."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    local = folder.removeprefix("file://").removeprefix("file:")
    return (pa.fs.LocalFileSystem(), local.rstrip("/")) if local.startswith("/") else pa.fs.FileSystem.from_uri(folder.rstrip("/"))


def write_rasters(rasters: DataFrame, folder: str) -> None:
    """One file name.tif for each row (name, epsg, left, top, width, height, step, classes, and mask if classes are the pixels inside of one).

    A file appears whole, by one rename, and equal rows give equal bytes, so a task that runs
    again changes nothing. Names may hold any character and must differ; rows without a name or
    classes are refused. The folder must be one that all executors share.
    """
    rows = rasters if "mask" in rasters.columns else rasters.withColumn("mask", F.lit(None).cast("array<boolean>"))
    rows = settle(rows.select("name", F.col("epsg").cast("int").alias("epsg"), "left", "top", "width", "height", "step", "classes", "mask"))
    if not rows.where("name is null or classes is null").isEmpty():
        raise DataError("a raster without a name or classes")
    if not rows.groupBy("name").count().where("count > 1").isEmpty():
        raise DataError("several rasters of one name")
    files, root = _file_system(folder)
    files.create_dir(root, recursive=True)
    rows.sparkSession.dataSource.register(GeoTiffSink)
    rows.write.format("geotiff").mode("append").save(folder)


def kept_composites(composites: DataFrame, grids: DataFrame) -> DataFrame:
    """Rows for write_rasters() of process()'s kept composites (aoi_id, datatake_id, runs) on their entities' grids (with mask)."""
    from ..operators.rasters import from_runs

    met = composites.select("aoi_id", "datatake_id", "runs").join(grids, "aoi_id")
    return met.select(F.concat_ws("_", "aoi_id", "datatake_id").alias("name"), "epsg", "left", "top", "width", "height", "step", from_runs(F.col("runs")).alias("classes"), "mask")
