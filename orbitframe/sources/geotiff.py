"""Baseline GeoTIFF without a codec library, and a Spark data source over it.

Reads classic TIFF of 8-bit bands in strips or tiles, chunky or planar, stored
plain or deflated with or without the horizontal predictor; writes deflated
strips. The data source lists files through Spark, so paths may be in any store
it reads; a query of metadata columns alone never decodes a pixel.
"""

from __future__ import annotations

import mmap
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# TIFF tag numbers and GeoKeys, as the public specifications name them.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
PIXEL_SCALE, TIEPOINT, MATRIX, GEO_KEYS = 33550, 33922, 34264, 34735
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
_SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 12: ("d", 8)}
_DEFLATE = (8, 32946)

META = "file string, width int, height int, bands int, dtype string, epsg int, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>"
PAYLOAD = "r binary, g binary, b binary, a binary"
_META_NAMES = ("file", "width", "height", "bands", "dtype", "epsg", "transform")


@dataclass
class Header:
    """The first directory's tags."""

    tags: dict[int, tuple]
    order: str

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def transform(self) -> tuple[float, ...]:
        """Affine ``a b c d e f``: x = a col + b row + c, y = d col + e row + f."""
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return (m[0], m[1], m[3], m[4], m[5], m[7])
        if PIXEL_SCALE in self.tags and TIEPOINT in self.tags:
            sx, sy, _ = self.tags[PIXEL_SCALE][:3]
            i, j, _, x, y, _ = self.tags[TIEPOINT][:6]
            return (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
        return (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return found.get(PROJECTED) or found.get(GEOGRAPHIC)


def read_header(data: bytes) -> Header:
    if data[:2] not in (b"II", b"MM") or len(data) < 8:
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise ValueError("only classic TIFF is read")
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _SIZES:
            continue
        code, size = _SIZES[kind]
        place = at + 10 + 12 * i
        if size * count > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        tags[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, place)
    return Header(tags, order)


def _unpack(chunk: bytes, header: Header, rows: int, cols: int, samples: int) -> np.ndarray:
    kind = header.one(COMPRESSION, 1)
    if kind in _DEFLATE:
        chunk = zlib.decompress(chunk)
    elif kind != 1:
        raise ValueError(f"compression {kind} is not read")
    out = np.frombuffer(chunk, np.uint8, rows * cols * samples).reshape(rows, cols, samples)
    return np.cumsum(out, axis=1, dtype=np.uint8) if header.one(PREDICTOR, 1) == 2 else out


def read_bands(data: bytes, header: Header | None = None) -> np.ndarray:
    """``(bands, height, width)`` uint8."""
    h = header or read_header(data)
    width, height, samples = h.one(WIDTH), h.one(HEIGHT), h.one(SAMPLES, 1)
    if any(b != 8 for b in h.tags.get(BITS, (8,))):
        raise ValueError("only 8-bit bands are read")
    planar = h.one(PLANAR, 1) == 2
    per = 1 if planar else samples
    out = np.zeros((height, width, samples), np.uint8)
    tiled = TILE_OFFSETS in h.tags
    step_y, step_x = (h.one(TILE_HEIGHT), h.one(TILE_WIDTH)) if tiled else (min(h.one(ROWS_PER_STRIP, height), height), width)
    places = h.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS]
    counts = h.tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    spots = [(y, x) for y in range(0, height, step_y) for x in range(0, width, step_x)]
    for i, (place, count) in enumerate(zip(places, counts, strict=True)):
        plane, (y, x) = i // len(spots), spots[i % len(spots)]
        rows = step_y if tiled else min(step_y, height - y)
        part = _unpack(data[place : place + count], h, rows, step_x, per)[: height - y, : width - x]
        out[y : y + step_y, x : x + step_x, plane : plane + 1 if planar else samples] = part
    return out.transpose(2, 0, 1)


def write_bands(bands: np.ndarray, transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), epsg: int | None = 3857, rows: int = 64) -> bytes:
    """A deflated, striped, chunky GeoTIFF of ``(bands, height, width)`` bytes."""
    n, height, width = bands.shape
    pixels = np.ascontiguousarray(bands.transpose(1, 2, 0).astype(np.uint8))
    strips = [zlib.compress(pixels[y : y + rows].tobytes(), 6) for y in range(0, height, rows)]
    geo = [1, 1, 0, 2, MODEL_TYPE, 0, 1, 2 if epsg == 4326 else 1, GEOGRAPHIC if epsg == 4326 else PROJECTED, 0, 1, epsg or 0]
    a, b, c, d, e, f = transform
    tags: list[tuple[int, int, list]] = [
        (WIDTH, 3, [width]), (HEIGHT, 3, [height]), (BITS, 3, [8] * n), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [2 if n >= 3 else 1]),
        (STRIP_OFFSETS, 4, [0] * len(strips)), (SAMPLES, 3, [n]), (ROWS_PER_STRIP, 3, [rows]), (STRIP_COUNTS, 4, [len(s) for s in strips]), (PLANAR, 3, [1]),
        (MATRIX, 12, [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1]), (GEO_KEYS, 3, geo),
    ]
    extra = 8 + 2 + 12 * len(tags) + 4
    sizes = {3: 2, 4: 4, 12: 8}
    spill = sum(sizes[k] * len(v) + sizes[k] * len(v) % 2 for _, k, v in tags if sizes[k] * len(v) > 4)
    at = extra + spill
    for i, strip in enumerate(strips):
        tags[5][2][i] = at
        at += len(strip)
    directory, values, place = struct.pack("<H", len(tags)), b"", extra
    for tag, kind, content in tags:
        packed = struct.pack(f"<{len(content)}{_SIZES[kind][0]}", *content)
        directory += struct.pack("<HHI", tag, kind, len(content))
        if len(packed) <= 4:
            directory += packed.ljust(4, b"\0")
        else:
            directory += struct.pack("<I", place)
            packed += b"\0" * (len(packed) % 2)
            values += packed
            place += len(packed)
    return b"II" + struct.pack("<HI", 42, 8) + directory + struct.pack("<I", 0) + values + b"".join(strips)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read_metadata(spark: SparkSession, path: str, glob: str = "*.tif", on_error: str = "raise") -> DataFrame:
    """One row per file from headers alone: of files in a mounted folder, only the pages of the directory are read.

    A store that has no mounted path gives Spark whole files, whose pixels are not decoded.
    """
    if _scheme(spark, path) != "file":
        return read_scenes(spark, path, glob, payload=False, on_error=on_error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_mapped(p, on_error) for p in pdf["path"]], columns=_META_NAMES)

    return _files(spark, path, glob).select("path").mapInPandas(run, META)


def _mounted(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def _mapped(path: str, on_error: str) -> dict:
    with open(_mounted(path), "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        return _row(path, data, False, on_error)


def read_scenes(spark: SparkSession, path: str, glob: str = "*.tif", payload: bool = True, on_error: str = "raise") -> DataFrame:
    """One row per file: metadata and, with ``payload``, up to four byte bands (missing ones null).

    ``on_error="zero"`` gives a damaged file a row of null metadata instead of
    failing the job. Files of no bytes have no row, as Spark leaves them out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_row(p, d, payload, on_error) for p, d in zip(pdf["path"], pdf["content"], strict=True)])

    return _files(spark, path, glob).select("path", "content").mapInPandas(run, META + (", " + PAYLOAD if payload else ""))


def _row(path: str, data: bytes, payload: bool, on_error: str) -> dict:
    names = ("r", "g", "b", "a")
    out = {"file": path.rsplit("/", 1)[-1]}
    try:
        h = read_header(data)
        t = dict(zip("abcdef", map(float, h.transform), strict=True))
        out |= {"width": h.one(WIDTH), "height": h.one(HEIGHT), "bands": h.one(SAMPLES, 1), "dtype": "uint8", "epsg": h.epsg, "transform": t}
        if payload:
            bands = read_bands(data, h)
            out |= {n: bands[i].tobytes() if i < len(bands) else None for i, n in enumerate(names)}
    except (ValueError, struct.error, zlib.error, KeyError, TypeError):
        if on_error != "zero":
            raise
        out |= dict.fromkeys((*_META_NAMES[1:], *(names if payload else ())))
    return out


def write_scenes(scenes: DataFrame, path: str) -> DataFrame:
    """Encodes scene rows (``file, width, height, epsg, transform, r, g, b, a``) as GeoTIFF bytes and writes them, with their names, as Parquet.

    A store of single files is filled from that table by its own tools; Spark
    writes tables.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(row["file"], _encoded(row)) for row in pdf.to_dict("records")], columns=["file", "content"])

    encoded = scenes.mapInPandas(run, "file string, content binary")
    encoded.write.mode("overwrite").parquet(path)
    return scenes.sparkSession.read.parquet(path)


def _encoded(row: dict) -> bytes:
    bands = [np.frombuffer(row[b], np.uint8).reshape(row["height"], row["width"]) for b in ("r", "g", "b", "a") if row[b] is not None]
    return write_bands(np.stack(bands), tuple(row["transform"][k] for k in "abcdef"), row["epsg"])


def write_files(scenes: DataFrame, folder: str) -> DataFrame:
    """Scene rows as single ``.tif`` files in a folder that all executors have mounted; ``file, bytes`` of each.

    A file is written under another name and then renamed, so a task that runs
    twice leaves one whole file. Names must be unique; other rows of a name
    replace it.
    """
    if _scheme(scenes.sparkSession, folder) != "file":
        raise ValueError("single files need a mounted folder; write_scenes fills any store")
    at = _mounted(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(at, exist_ok=True)
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                data, part = _encoded(row), f"{at}/.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, f"{at}/{os.path.basename(row['file'])}")
                rows.append((row["file"], len(data)))
            yield pd.DataFrame(rows, columns=["file", "bytes"])

    written = scenes.mapInPandas(run, "file string, bytes long").collect()
    return scenes.sparkSession.createDataFrame(written, "file string, bytes long")


def _scheme(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discover_cities(spark: SparkSession, *paths: str, prefix: str = "") -> DataFrame:
    """Sorted names of the folders that hold scenes, from the first path that has any."""
    for path in paths:
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/(?:[^/]+/)?[^/]+$", 1)
        if not _exists(spark, path):
            continue
        found = _files(spark, path, "*.tif").select(folder.alias("city")).where(F.col("city").startswith(prefix)).distinct().orderBy("city")
        if not found.isEmpty():
            return found
    return spark.createDataFrame([], "city string")
