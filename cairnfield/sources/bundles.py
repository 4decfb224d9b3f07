"""Prediction bundles: an ``.npz`` file for each tile with logits, mask, event, tile, CRS and bounds.

Bundles are read in blocks of rows. Members that are stored as they are give each block by a range
read; compressed ones are unpacked once for each file, as they have no way in. Both kinds are written.
No pickled object is ever loaded.
"""

from __future__ import annotations

import ast
import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from cairnfield.sources import files

SCHEMA = "path string, event_id string, tile_id string, crs string, bounds array<double>, block int, row int, height int, width int, classes int, logits array<float>, mask array<int>"
#: Pixels of a block, at most (one row of pixels at least).
BLOCK_PIXELS = 1 << 16
CHUNK = "name string, content binary"


class Member:
    """An array of a bundle, whose leading axes can be read apart where it is stored as it is."""

    def __init__(self, data: files.Ranged, archive: zipfile.ZipFile, info: zipfile.ZipInfo):
        self.data = data
        if info.compress_type == zipfile.ZIP_STORED:
            local = data[info.header_offset : info.header_offset + 30]
            name, extra = struct.unpack("<HH", local[26:30])
            self.start, self.body = info.header_offset + 30 + name + extra, None
            head = data[self.start : self.start + 12]
        else:
            self.start, self.body = 0, archive.read(info)
            head = self.body[:12]
        if head[:6] != b"\x93NUMPY":
            raise ValueError(f"{info.filename} is no array")
        size, skip = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
        text = self.bytes(skip, size).decode("latin-1")
        about = ast.literal_eval(text)  # a dictionary of plain values
        self.kind, self.shape = np.dtype(about["descr"]), tuple(about["shape"])
        if self.kind.hasobject:
            raise ValueError(f"{info.filename} holds objects")
        if about["fortran_order"] and len(self.shape) > 1:
            self.body = self.bytes(0, skip + size) + np.frombuffer(self.bytes(skip + size, self.nbytes()), self.kind).reshape(self.shape, order="F").tobytes()
        self.first = skip + size

    def nbytes(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64)) * self.kind.itemsize

    def bytes(self, at: int, n: int) -> bytes:
        return self.data.read(self.start + at, n) if self.body is None else self.body[at : at + n]

    def flat(self, first: int, n: int) -> np.ndarray:
        """n entries from ``first`` on, in row order."""
        return np.frombuffer(self.bytes(self.first + first * self.kind.itemsize, n * self.kind.itemsize), self.kind)

    def all(self) -> np.ndarray:
        return self.flat(0, int(np.prod(self.shape, dtype=np.int64))).reshape(self.shape)


class _Seekable(io.RawIOBase):
    """A ranged file as zipfile wants it."""

    def __init__(self, data: files.Ranged):
        self.ranged, self.at = data, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.ranged.size)[whence]
        return self.at

    def readinto(self, out) -> int:
        body = self.ranged[self.at : min(self.at + len(out), self.ranged.size)]
        out[: len(body)] = body
        self.at += len(body)
        return len(body)


def opened(path: str, data: files.Ranged) -> dict[str, Member]:
    """The arrays of a bundle. Logits must be (classes, height, width), the mask (height, width)."""
    archive = zipfile.ZipFile(io.BufferedReader(_Seekable(data), files.PAGE))
    found = {i.filename.removesuffix(".npy"): i for i in archive.infolist()}
    missing = {"logits", "mask", "event_id", "tile_id"} - set(found)
    if missing:
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    got = {k: Member(data, archive, found[k]) for k in ("logits", "mask", "event_id", "tile_id", "crs", "bounds") if k in found}
    if len(got["logits"].shape) != 3 or got["logits"].shape[1:] != got["mask"].shape:
        raise ValueError(f"{path}: logits {got['logits'].shape} don't fit the mask {got['mask'].shape}")
    return got


class BundleReader(DataSourceReader):
    def __init__(self, options: dict):  # names in lower case
        self.path, self.suffix = options["path"], options.get("suffix", ".npz")
        self.most = int(options.get("partitionbytes", files.PARTITION_BYTES))
        self.pixels = int(options.get("blockpixels", BLOCK_PIXELS))

    def partitions(self) -> list[files.Spans]:
        return files.partitions([(p, [size]) for p, size in files.listing(self.path, self.suffix)], self.most) or [files.Spans(())]

    def read(self, partition: files.Spans) -> Iterator[pa.RecordBatch]:
        for path, _, _ in partition.spans:
            with files.Ranged(path) as data:
                arrays = opened(path, data)
                logits, mask = arrays["logits"], arrays["mask"]
                classes, height, width = logits.shape
                about = [str(arrays[k].all().item()) if k in arrays else "" for k in ("event_id", "tile_id", "crs")]
                bounds = arrays["bounds"].all().astype(np.float64).ravel().tolist() if "bounds" in arrays else []
                step = max(1, self.pixels // max(1, width))
                for block, row in enumerate(range(0, height, step)):
                    rows = min(step, height - row)
                    z = np.concatenate([logits.flat((c * height + row) * width, rows * width).astype(np.float32) for c in range(classes)])
                    m = mask.flat(row * width, rows * width).astype(np.int32)
                    one = [pa.array([v], pa.string()) for v in (path, *about)]
                    numbers = [pa.array([v], pa.int32()) for v in (block, row, rows, width, classes)]
                    lists = [pa.array([bounds or None], pa.list_(pa.float64())), _list(z), _list(m)]
                    yield pa.RecordBatch.from_arrays([*one, lists[0], *numbers, *lists[1:]], names=[f.split()[0] for f in SCHEMA.split(", ")])


def _list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


class Bundles(DataSource):
    """Source ``prediction_bundles``: options path, suffix, blockPixels, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "prediction_bundles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BundleReader:
        return BundleReader(dict(self.options))


def read_bundles(spark: SparkSession, path: str, block_pixels: int = BLOCK_PIXELS, partition_bytes: int = files.PARTITION_BYTES) -> DataFrame:
    """A row for each block of rows of each bundle below ``path``; logits are class by class, row by row.

    A bundle whose logits and mask differ in shape, or that lacks either, is an error.
    """
    files.ship(spark)
    spark.dataSource.register(Bundles)
    return spark.read.format("prediction_bundles").option("path", path).option("blockPixels", block_pixels).option("partitionBytes", partition_bytes).load()


def write_bundles(rows: DataFrame, path: str, compress: bool = True, mode: str = "overwrite") -> None:
    """One ``{tile_id}.npz`` for each tile of ``rows``: blocks as ``read_bundles`` gives them, without ``path``.

    A tile's blocks meet in one task, in order; nothing is larger there than a tile. Blocks that leave rows out,
    or whose arrays don't fit their sizes, are errors.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            if now:
                name, body = packed(now, compress)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([body], pa.binary())], names=["name", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if now and row["tile_id"].as_py() != now[0]["tile_id"].as_py():
                    yield from done()
                    now.clear()
                now.append(row)
        yield from done()

    files.ship(rows.sparkSession)
    wanted = rows.select("event_id", "tile_id", "crs", "bounds", "block", "row", "height", "width", "classes", F.col("logits").cast("array<float>").alias("logits"), F.col("mask").cast("array<int>").alias("mask"))
    dealt = wanted.repartition("tile_id").sortWithinPartitions("tile_id", "block")
    files.write_files(dealt.mapInArrow(pack, CHUNK), path, mode)


def packed(blocks: list[dict], compress: bool) -> tuple[str, bytes]:
    """Name and content of the bundle of a tile's blocks."""
    head = {k: blocks[0][k].as_py() for k in ("event_id", "tile_id", "crs", "bounds", "width", "classes")}
    logits, masks, row = [], [], 0
    for b in blocks:
        rows = b["height"].as_py()
        z, m = (b[k].values.to_numpy(zero_copy_only=False) for k in ("logits", "mask"))
        if b["row"].as_py() != row or len(m) != rows * head["width"] or len(z) != head["classes"] * len(m):
            raise ValueError(f"Blocks of {head['tile_id']} don't fit together")
        logits.append(z.reshape(head["classes"], rows, head["width"]))
        masks.append(m.reshape(rows, head["width"]))
        row += rows
    out = io.BytesIO()
    (np.savez_compressed if compress else np.savez)(
        out,
        logits=np.concatenate(logits, axis=1),
        mask=np.concatenate(masks),
        event_id=np.asarray(head["event_id"]),
        tile_id=np.asarray(head["tile_id"]),
        crs=np.asarray(head["crs"] or ""),
        bounds=np.asarray(head["bounds"] or (), dtype=np.float64),
    )
    return f"{head['tile_id']}.npz", out.getvalue()
