import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.operators import chunks
from cairnfield.sources import blocks, bundles, files, raster


def image(seed: int, kind: str = "float32", shape=(2, 50, 37)) -> np.ndarray:
    values = np.random.default_rng(seed).integers(0, 200, size=shape).astype(kind)
    return values + np.asarray(0.25, kind) if kind.startswith("float") else values


KINDS = {"strips.tif": ("float32", 0, False), "deflated.tif": ("uint8", 0, True), "tiled.tif": ("int16", 16, False), "tiles_deflated.tif": ("float64", 32, True)}


@pytest.fixture(scope="module")
def rasters(tmp_path_factory):
    root = tmp_path_factory.mktemp("rasters")
    for seed, (name, (kind, block, deflate)) in enumerate(KINDS.items()):
        folder = root / ("deep" if seed % 2 else "flat")
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(raster.encode(image(seed, kind), block, deflate, 32632, (0.0, 0.0, 37.0, 50.0), strip=8))
    (root / "notes.txt").write_text("no raster")
    return root


def whole(rows) -> dict[tuple[str, int], np.ndarray]:
    out: dict[tuple[str, int], np.ndarray] = {}
    for r in rows:
        at = out.setdefault((r.path.rpartition("/")[2], r.band), np.full((50, 37), np.nan))
        assert np.isnan(at[r.row : r.row + r.height, r.col : r.col + r.width]).all()
        at[r.row : r.row + r.height, r.col : r.col + r.width] = np.reshape(r["values"], (r.height, r.width))
    return out


def test_blocks_are_the_images(spark, rasters):
    got = whole(blocks.blocks(spark, str(rasters)).collect())
    assert len(got) == 8
    for seed, (name, (kind, _, _)) in enumerate(KINDS.items()):
        for band in range(2):
            assert (got[name, band] == image(seed, kind)[band]).all()
    assert whole(blocks.blocks(spark, f"file://{rasters}", channels=1).collect()).keys() == {(n, 0) for n in KINDS}
    with pytest.raises(Exception, match="are needed"):
        blocks.blocks(spark, str(rasters), channels=3).collect()


def test_blocks_agree_with_whole_files(spark, rasters):
    for name in KINDS:
        path = next(p for p, _ in files.listing(str(rasters), name) if p.endswith("/" + name))
        want = raster.bands(spark, path, name).select("band", F.explode("pixels").alias("v")).groupBy("band").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"))
        got = {r.band: r for r in blocks.moments(blocks.blocks(spark, path), "band").collect()}
        for r in want.collect():
            g = got[r.band]
            assert (g.n, g.min, g.max) == (r.n, r.min, r.max) and g.total == pytest.approx(r.total) and g.std == pytest.approx(r.std)


def test_a_partition_is_a_run_of_blocks(spark, rasters):
    path = str(rasters / "flat" / "strips.tif")
    strip = 8 * 37 * 4
    read = blocks.blocks(spark, path, partition_bytes=2 * strip)
    assert read.rdd.getNumPartitions() == 7  # 14 strips of two bands
    assert max(r.height * r.width for r in read.collect()) <= 8 * 37
    assert blocks.blocks(spark, str(rasters)).rdd.getNumPartitions() == 1


def test_rows_do_not_grow_with_a_block(spark, tmp_path, monkeypatch):
    high = np.arange(600 * 400, dtype=np.float32).reshape(1, 600, 400)
    (tmp_path / "one.tif").write_bytes(raster.encode(high, deflate=False, strip=600))
    rows = blocks.blocks(spark, str(tmp_path)).collect()
    assert len(rows) > 1 and max(len(r["values"]) for r in rows) <= blocks.MOST_PIXELS
    assert (np.concatenate([r["values"] for r in sorted(rows, key=lambda r: r.row)]) == high.ravel()).all()


@pytest.mark.parametrize("window", [(0, 0, 50, 37), (9, 5, 31, 20), (40, 30, 99, 99), (7, 7, 8, 8)])
def test_a_window_reads_its_blocks_only(spark, rasters, window):
    top, left, bottom, right = window
    rows = blocks.blocks(spark, str(rasters), window=window).collect()
    got = whole(rows)
    for seed, (name, (kind, _, _)) in enumerate(KINDS.items()):
        for band in range(2):
            want = np.full((50, 37), np.nan)
            want[top:bottom, left:right] = image(seed, kind)[band, top:bottom, left:right]
            assert np.array_equal(got[name, band], want, equal_nan=True)
    reader = blocks.BlockReader({"path": str(rasters / "deep"), "window": ",".join(map(str, window))})
    with files.Ranged(files.listing(str(rasters / "deep"), "tiles_deflated.tif")[0][0]) as data:
        at = raster.layout(data)
        touched = sum(reader.wanted(at, n) for n in range(len(at.offsets)))
    assert touched == 2 * (-(-min(bottom, 50) // 32) - top // 32) * (-(-min(right, 37) // 32) - left // 32)


def test_filters_are_pushed_where_the_session_says_so(spark, rasters):
    plain = blocks.blocks(spark, str(rasters)).where("band = 1 AND row < 20").collect()
    spark.conf.set(blocks.PUSHDOWN, "true")
    try:
        pushed = blocks.blocks(spark, str(rasters)).where("band = 1 AND row < 20")
        assert sorted(map(repr, pushed.collect())) == sorted(map(repr, plain))
    finally:
        spark.conf.unset(blocks.PUSHDOWN)
    from pyspark.sql.datasource import EqualTo, LessThan

    reader = blocks.PushedBlockReader({"path": str(rasters / "flat" / "strips.tif")})
    reader.pushFilters([EqualTo(("band",), 1), LessThan(("row",), 20)])
    (part,) = reader.partitions()
    assert {r.column("row")[0].as_py() for r in reader.read(part)} == {0, 8, 16}


def tile(seed: int, height=40, width=21) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    mask = rng.integers(0, 4, size=(height, width))
    mask[rng.random((height, width)) < 0.1] = 255
    return {"logits": rng.normal(size=(4, height, width)).astype(np.float32), "mask": mask.astype(np.int64), "event_id": np.asarray(f"e{seed % 2}"), "tile_id": np.asarray(f"e{seed % 2}_{seed:08d}")}


def save(folder, seed: int, compress: bool, **more) -> None:
    arrays = tile(seed) | more
    (np.savez_compressed if compress else np.savez)(folder / f"{arrays['tile_id'].item()}.npz", **arrays)


def test_bundles_are_read_in_blocks(spark, tmp_path):
    for seed in range(6):
        save(tmp_path, seed, seed % 3 == 0, crs=np.asarray("EPSG:32632"), bounds=np.asarray([0.0, 1.0, 2.0, 3.0]), pre_optical=np.zeros(3))
    read = bundles.read_bundles(spark, str(tmp_path), block_pixels=200, partition_bytes=30_000)
    assert read.rdd.getNumPartitions() > 1
    rows = read.collect()
    assert len(rows) == 6 * 5 and {tuple(r.bounds) for r in rows} == {(0.0, 1.0, 2.0, 3.0)}
    for r in rows:
        want = tile(int(r.tile_id[-8:]))
        assert (np.reshape(r.logits, (4, r.height, r.width)) == want["logits"][:, r.row : r.row + r.height]).all()
        assert r.mask == want["mask"][r.row : r.row + r.height].ravel().tolist() and r.event_id == want["event_id"].item()


@pytest.mark.parametrize("compress", [True, False])
def test_bundles_survive_the_way_through_files(spark, tmp_path, compress):
    (tmp_path / "in").mkdir()
    for seed in range(4):
        save(tmp_path / "in", seed, False)
    read = bundles.read_bundles(spark, str(tmp_path / "in"), block_pixels=100)
    bundles.write_bundles(read, str(tmp_path / "out"), compress)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == sorted(p.name for p in (tmp_path / "in").iterdir())
    for seed, name in enumerate(sorted(names, key=lambda n: n[-12:])):
        with np.load(tmp_path / "out" / name, allow_pickle=False) as got:
            want = tile(seed)
            assert (got["logits"] == want["logits"]).all() and (got["mask"] == want["mask"]).all() and got["tile_id"].item() == want["tile_id"].item()
        with zipfile.ZipFile(tmp_path / "out" / name) as z:
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED}


def test_column_order_arrays_and_faults(spark, tmp_path):
    (tmp_path / "f").mkdir()
    save(tmp_path / "f", 1, False, logits=np.asfortranarray(tile(1)["logits"]))
    rows = bundles.read_bundles(spark, str(tmp_path / "f")).collect()
    assert (np.reshape(rows[0].logits, (4, 40, 21)) == tile(1)["logits"]).all()
    faults = {"shape": {"mask": np.zeros((3, 3), np.int64)}, "lacks": {}, "objects": {"mask": np.array([[None]])}}
    for fault, more in faults.items():
        (tmp_path / fault).mkdir()
        arrays = tile(2) | more
        if fault == "lacks":
            arrays.pop("mask")
        np.savez(tmp_path / fault / "t.npz", **arrays)
        with pytest.raises(Exception, match=fault):
            bundles.read_bundles(spark, str(tmp_path / fault)).collect()


def test_logits_meet_masks_by_position(spark, tmp_path):
    for seed in range(5):
        save(tmp_path, seed, True)
    read = bundles.read_bundles(spark, str(tmp_path), block_pixels=130)
    masks = read.select("tile_id", "block", "mask")
    got = {(r.event_id, r.target, r.pred): r.n for r in chunks.confusion(read.drop("mask"), masks).collect()}
    want = dict.fromkeys(((e, t, p) for e in ("e0", "e1", None) for t in range(4) for p in range(4)), 0)
    for seed in range(5):
        x = tile(seed)
        for t, p in zip(x["mask"].ravel().tolist(), x["logits"].argmax(axis=0).ravel().tolist(), strict=True):
            if t != 255:
                want[x["event_id"].item(), t, p] += 1
                want[None, t, p] += 1
    assert got == want
    flat = chunks.pixels(chunks.aligned(read.drop("mask"), masks, 4), 4).where("tile_id = 'e1_00000003'").collect()
    x = tile(3)
    assert len(flat) == 40 * 21
    for r in flat:
        assert r.target == x["mask"][r.row, r.col] and np.allclose(r.logits, x["logits"][:, r.row, r.col])


def test_chunks_that_do_not_fit_are_errors(spark):
    logits = spark.createDataFrame([("t", 0, "e", [0.0] * 8)], "tile_id string, block int, event_id string, logits array<float>")
    fits = spark.createDataFrame([("t", 0, [1, 255])], "tile_id string, block int, mask array<int>")
    assert sum(r.n for r in chunks.confusion(logits, fits).where("event_id = 'e'").collect()) == 1
    for mask, fault in (([("t", 0, [1])], "differ in shape"), ([("t", 1, [1, 2])], "No counterpart"), ([("t", 0, [1, 7])], "no class")):
        with pytest.raises(Exception, match=fault):
            chunks.confusion(logits, spark.createDataFrame(mask, fits.schema)).collect()


def test_the_file_sink_commits_whole_jobs(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.bin", b"1"), ("y.bin", b"")], "name string, content binary")
    out = tmp_path / "out"
    files.write_files(rows.repartition(2), str(out))
    files.write_files(rows.where("name = 'y.bin'").withColumn("content", F.lit(b"22")), str(out))
    assert [p.relative_to(out).as_posix() for p in out.rglob("*.bin")] == ["y.bin"] and (out / "y.bin").read_bytes() == b"22"
    files.write_files(rows.where("name <> 'y.bin'"), str(out), mode="append")
    for bad in (rows.union(rows), rows.withColumn("name", F.lit("../z")), rows.withColumn("name", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="same file name|can't be a file's name"):
            files.write_files(bad, str(out), mode="append")
    assert {p.relative_to(out).as_posix() for p in out.rglob("*") if p.is_file()} == {"a/x.bin", "y.bin"}
