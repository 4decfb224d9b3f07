"""TIFF pixels by windows: a data source whose partitions are runs of strips or tiles.

The scan is planned from the files' directories, which are read in pages; tasks then read the bytes of
their own blocks and nothing else. A window or a choice of bands leaves out blocks before they
are read. A row holds one band of one block, or of some rows of it where a block is large, so
no row grows with a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, LessThan, LessThanOrEqual

from cairnfield.sources import files, raster

SCHEMA = "path string, band int, row int, col int, height int, width int, values array<double>"
#: Pixels of a row, at most.
MOST_PIXELS = 1 << 17
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
Window = tuple[int, int, int, int]


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):  # names in lower case
        self.path, self.suffix = options["path"], options.get("suffix", ".tif")
        self.most = int(options.get("partitionbytes", files.PARTITION_BYTES))
        self.channels = int(options["channels"]) if "channels" in options else None
        window = options.get("window")
        self.window: Window = tuple(int(v) for v in window.split(",")) if window else (0, 0, 1 << 31, 1 << 31)
        self.bands: set[int] | None = None

    firsts: tuple[int, int] = (1 << 31, 1 << 31)

    def wanted(self, at: raster.Layout, n: int) -> bool:
        top, left, bottom, right = self.window
        first, depth, y, x, _ = at.place(n)
        if not (y < bottom and y + at.block_h > top and x < right and x + at.block_w > left):
            return False
        if self.channels is not None and first >= self.channels:
            return False
        if self.bands is not None and not any(first <= b < first + depth for b in self.bands):
            return False
        return max(y, top) < self.firsts[0] and max(x, left) < self.firsts[1]

    def partitions(self) -> list[files.Spans]:
        found = files.listing(self.path, self.suffix)

        def sizes(path: str, data: files.Ranged) -> tuple[str, list[int]]:
            at = raster.layout(data)
            if self.channels is not None and at.bands < self.channels:
                raise ValueError(f"{path} has {at.bands} bands, {self.channels} are needed")
            return path, [size if self.wanted(at, n) else 0 for n, size in enumerate(at.sizes)]

        runs = [p for p in files.partitions(files.looked_into([p for p, _ in found], sizes), self.most)]
        return runs or [files.Spans(())]

    def read(self, partition: files.Spans) -> Iterator[pa.RecordBatch]:
        top, left, bottom, right = self.window
        for path, begin, end in partition.spans:
            with files.Ranged(path) as data:
                at = raster.layout(data)
                for n in range(begin, end):
                    if not self.wanted(at, n):
                        continue
                    first, depth, y, x, _ = at.place(n)
                    part = raster.decode(at, n, data.read(at.offsets[n], at.sizes[n]))
                    y0, x0 = max(y, top), max(x, left)
                    part = part[:, y0 - y : bottom - y, x0 - x : right - x]
                    step = max(1, MOST_PIXELS // max(1, part.shape[2]))
                    for b in range(first, first + depth):
                        if self.channels is not None and b >= self.channels or self.bands is not None and b not in self.bands:
                            continue
                        for r in range(0, part.shape[1], step):
                            cut = part[b - first, r : r + step]
                            yield row(path, b, y0 + r, x0, cut)


class PushedBlockReader(BlockReader):
    def pushFilters(self, filters: list[Filter]):
        """Bounds on rows, columns and bands narrow what is read; Spark applies every filter again.

        A block's row and col are those of its first pixel, so only bounds from above leave blocks out.
        """
        bottom, right = self.firsts
        for f in filters:
            on = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and on == "band":
                self.bands = {f.value} if self.bands is None else self.bands & {f.value}
            elif isinstance(f, (LessThan, LessThanOrEqual)) and on in ("row", "col"):
                end = f.value + isinstance(f, LessThanOrEqual)
                bottom, right = (min(bottom, end), right) if on == "row" else (bottom, min(right, end))
        self.firsts = (bottom, right)
        return filters


def row(path: str, band: int, y: int, x: int, cut: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array([v], pa.int32()) for v in (band, y, x, *cut.shape)]
    values = pa.ListArray.from_arrays(pa.array([0, cut.size], pa.int32()), pa.array(np.ascontiguousarray(cut).astype(np.float64).ravel()))
    return pa.RecordBatch.from_arrays([pa.array([path]), *numbers, values], names=["path", "band", "row", "col", "height", "width", "values"])


class TiffBlocks(DataSource):
    """Source ``tiff_blocks``: options path, suffix, channels, window (top,left,bottom,right), partitionBytes, pushFilters.

    Spark hands filters to such a source only where PUSHDOWN is set.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        options = dict(self.options)
        return (PushedBlockReader if options.get("pushfilters") == "true" else BlockReader)(options)


def blocks(spark: SparkSession, path: str, suffix: str = ".tif", channels: int | None = None, window: Window | None = None, partition_bytes: int | None = None) -> DataFrame:
    """(path, band, row, col, height, width, values) of every block of every file below ``path``.

    ``row`` and ``col`` are those of a block's first pixel, from 0. ``channels`` takes the first bands only, and a file
    with fewer is an error; ``window`` (top, left, bottom, right; ends excluded) cuts blocks to it. Filters on
    band, and on row and col from above, leave blocks out too where the session's PUSHDOWN is on.
    """
    files.ship(spark)
    spark.dataSource.register(TiffBlocks)
    options = {"path": path, "suffix": suffix, "channels": channels, "window": ",".join(map(str, window)) if window else None, "partitionBytes": partition_bytes, "pushFilters": str(spark.conf.get(PUSHDOWN, "false")).lower()}
    return spark.read.format("tiff_blocks").options(**{k: str(v) for k, v in options.items() if v is not None}).load()


def moments(rows: DataFrame, *by: str) -> DataFrame:
    """n, total, squares, min, max, mean and std of the values of blocks, by ``by``; a block is summed where it is read.

    Values that are not numbers don't count; the variance has a floor of 1e-12.
    """

    @F.arrow_udf("struct<n: bigint, total: double, squares: double, min: double, max: double>")
    def sums(values: pa.Array) -> pa.Array:
        out = []
        for v in values:
            x = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0)
            x = x[~np.isnan(x)]
            out.append({"n": len(x), "total": float(x.sum()), "squares": float((x * x).sum()), "min": float(x.min()) if len(x) else None, "max": float(x.max()) if len(x) else None})
        return pa.array(out, pa.struct([("n", pa.int64()), *[(c, pa.float64()) for c in ("total", "squares", "min", "max")]]))

    parts = rows.select(*by, sums("values").alias("s"))
    found = parts.groupBy(*by).agg(F.sum("s.n").alias("n"), F.sum("s.total").alias("total"), F.sum("s.squares").alias("squares"), F.min("s.min").alias("min"), F.max("s.max").alias("max"))
    mean = F.col("total") / F.nullif(F.col("n"), F.lit(0))
    return found.withColumns({"mean": mean, "std": F.sqrt(F.greatest(F.col("squares") / F.nullif(F.col("n"), F.lit(0)) - mean * mean, F.lit(1e-12)))})
