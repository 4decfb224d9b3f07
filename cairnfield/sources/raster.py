"""GeoTIFF headers and pixels through Spark's binaryFile source.

A small reader of baseline TIFF: strips or tiles, no or deflate compression, integer and float
samples, the georeference of a pixel scale and one tie point.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes of TIFF field types, and their struct codes.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
HEADER = "path string, crs string, bounds array<double>, width int, height int, bands int, dtype string"
PIXELS = "path string, band int, height int, width int, pixels array<float>"


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    found = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        code = TYPES.get(kind)
        if code is None:
            continue
        form = f"{order}{count}s" if code == "s" else order + code * count
        size = struct.calcsize(form)
        place = struct.unpack(order + "I", entry[8:])[0]
        body = entry[8 : 8 + size] if size <= 4 else data[place : place + size]
        found[tag] = struct.unpack(form, body)
    return order, found


def header(data: bytes) -> tuple:
    """crs, bounds, width, height, bands and dtype; crs and bounds are None without a georeference."""
    _, t = tags(data)
    width, height, bands = t[256][0], t[257][0], t.get(277, (1,))[0]
    bits, form = t.get(258, (8,))[0], t.get(339, (1,))[0]
    dtype = {1: "uint", 2: "int", 3: "float"}[form] + str(bits)
    keys = t.get(34735, ())
    code = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (3072, 2048)), None)
    bounds = None
    if code and 33550 in t and 33922 in t:
        sx, sy = t[33550][:2]
        i, j, _, x, y, _ = t[33922][:6]
        left, top = x - i * sx, y + j * sy
        bounds = [left, top - height * sy, left + width * sx, top]
    return (f"EPSG:{code}" if code else None), bounds, width, height, bands, dtype


@dataclass(frozen=True)
class Layout:
    """Where a file's blocks are and how they are written."""

    width: int
    height: int
    bands: int
    kind: np.dtype
    planar: bool
    tiled: bool
    compression: int
    predictor: int
    block_w: int
    block_h: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.block_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_h)

    def place(self, n: int) -> tuple[int, int, int, int, int]:
        """Of block n: its first band, its bands, its first row and column, and the rows that are written."""
        plane, cell = divmod(n, self.across * self.down) if self.planar else (0, n)
        row, col = divmod(cell, self.across)
        rows = self.block_h if self.tiled else min(self.block_h, self.height - row * self.block_h)
        return plane, 1 if self.planar else self.bands, row * self.block_h, col * self.block_w, rows


def layout(data) -> Layout:
    """Of a file's bytes, or of anything whose slices are its bytes."""
    order, t = tags(data)
    _, _, width, height, bands, dtype = header(data)
    kind = np.dtype(dtype.replace("uint", "u").replace("int", "i").replace("float", "f").replace("8", "1").replace("16", "2").replace("32", "4").replace("64", "8")).newbyteorder(order)
    tiled = 324 in t
    offsets, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    block_w, block_h = (t[322][0], t[323][0]) if tiled else (width, min(height, t.get(278, (height,))[0]))
    compression = t.get(259, (1,))[0]
    if compression not in (1, 8, 32946):
        raise ValueError("Only uncompressed and deflate TIFFs are read")
    return Layout(width, height, bands, kind, t.get(284, (1,))[0] == 2, tiled, compression, t.get(317, (1,))[0], block_w, block_h, offsets, sizes)


def decode(at: Layout, n: int, body: bytes) -> np.ndarray:
    """Samples of block n as (bands, rows, columns), cut to the image."""
    _, depth, y, x, rows = at.place(n)
    if at.compression != 1:
        body = zlib.decompress(body)
    block = np.frombuffer(body, dtype=at.kind, count=rows * at.block_w * depth).reshape(rows, at.block_w, depth)
    if at.predictor == 2:
        block = np.cumsum(block, axis=1, dtype=at.kind)
    return block[: at.height - y, : at.width - x].transpose(2, 0, 1)


def read(data: bytes) -> np.ndarray:
    """Samples as (bands, height, width)."""
    at = layout(data)
    out = np.zeros((at.bands, at.height, at.width), dtype=at.kind.newbyteorder("="))
    for n, (start, size) in enumerate(zip(at.offsets, at.sizes, strict=True)):
        first, depth, y, x, _ = at.place(n)
        part = decode(at, n, data[start : start + size])
        out[first : first + depth, y : y + part.shape[1], x : x + part.shape[2]] = part
    return out


def encode(image: np.ndarray, block: int = 0, deflate: bool = True, crs: int | None = None, bounds: tuple[float, float, float, float] | None = None, strip: int = 64) -> bytes:
    """A baseline TIFF of (bands, height, width), planar: square blocks of ``block`` pixels (a multiple of 16), or strips of rows."""
    bands, height, width = image.shape
    image = image.astype(image.dtype.newbyteorder("<"))
    high, wide = (block, block) if block else (strip, width)
    bodies = []
    for band in image:
        for y in range(0, height, high):
            for x in range(0, width, wide):
                part = band[y : y + high, x : x + wide]
                full = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]))) if block else part
                bodies.append(zlib.compress(full.tobytes(), 1) if deflate else full.tobytes())
    sizes = [len(b) for b in bodies]
    offsets = (8 + np.cumsum([0, *sizes[:-1]])).tolist()
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    fields = {256: (4, [width]), 257: (4, [height]), 258: (3, [8 * image.dtype.itemsize] * bands), 259: (3, [8 if deflate else 1]), 262: (3, [1]), 277: (3, [bands]), 284: (3, [2]), 339: (3, [kind] * bands)}
    fields |= {322: (4, [block]), 323: (4, [block]), 324: (4, offsets), 325: (4, sizes)} if block else {273: (4, offsets), 278: (4, [strip]), 279: (4, sizes)}
    if crs and bounds:
        left, bottom, right, top = bounds
        fields |= {33550: (12, [(right - left) / width, (top - bottom) / height, 0.0]), 33922: (12, [0.0, 0.0, 0.0, left, top, 0.0]), 34735: (3, [1, 1, 0, 1, 3072, 0, 1, crs])}
    at = 8 + sum(sizes)
    entries, far = b"", b""
    for tag, (kind, values) in sorted(fields.items()):
        body = struct.pack("<" + TYPES[kind] * len(values), *values)
        if len(body) > 4:
            body, far = struct.pack("<I", at + 6 + 12 * len(fields) + len(far)), far + body + b"\0" * (len(body) % 2)
        entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + b"".join(bodies) + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + far


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def headers(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(p, *header(bytes(c))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in HEADER.split(", ")])

    return _files(spark, path, glob).mapInPandas(scan, HEADER)


def bands(spark: SparkSession, path: str, glob: str = "*.tif", channels: int | None = None) -> DataFrame:
    """One row for each band of each file, the first ``channels`` of them, as 32-bit floats."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                image = read(bytes(c))
                if channels is not None and len(image) < channels:
                    raise ValueError(f"{p} has {len(image)} bands, {channels} are needed")
                yield pd.DataFrame([(p, b, *band.shape, band.astype("float32").ravel()) for b, band in enumerate(image[:channels])], columns=["path", "band", "height", "width", "pixels"])

    return _files(spark, path, glob).mapInPandas(scan, PIXELS)
