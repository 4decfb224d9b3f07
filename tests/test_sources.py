import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.sources import catalogue, config, raster


def tiff(path, image, deflate=False, tile=None):
    """A small GeoTIFF (EPSG:32721, origin (712400, 6230150), pixels of 2.5 m): strips of 5 rows or tiles, planar."""
    bands, height, width = image.shape
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    blocks = []
    for band in image:
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile), image.dtype)
                    part = band[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block.tobytes())
        else:
            blocks += [band[y : y + 5].tobytes() for y in range(0, height, 5)]
    blocks = [zlib.compress(b) if deflate else b for b in blocks]
    body, offsets = b"", []
    for b in blocks:
        offsets.append(8 + len(body))
        body += b
    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [image.dtype.itemsize * 8] * bands), (259, 3, [8 if deflate else 1]), (262, 3, [1]), (277, 3, [bands]), (284, 3, [2]), (339, 3, [kind] * bands)]
    if tile:
        fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, [len(b) for b in blocks])]
    else:
        fields += [(273, 4, offsets), (278, 4, [5]), (279, 4, [len(b) for b in blocks])]
    fields += [(33550, 12, [2.5, 2.5, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 712400.0, 6230150.0, 0.0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 32721])]
    fields.sort()
    form = {3: "H", 4: "I", 12: "d"}
    at = 8 + len(body)
    extra, entries = b"", b""
    base = at + 2 + 12 * len(fields) + 4
    for tag, typ, values in fields:
        data = struct.pack("<" + form[typ] * len(values), *values)
        entries += struct.pack("<HHI", tag, typ, len(values))
        if len(data) <= 4:
            entries += data.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", base + len(extra))
            extra += data
    path.write_bytes(b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra)


SUFFIXES = {"pre_optical": ("before", "_pre_disaster.tif"), "post_sar": ("after", "_post_disaster.tif"), "label": ("label", "_building_damage.tif")}
EVENTS = {"rivermouth-flood": "flood", "northgate-wildfire": "wildfire"}


def images(seed: int) -> dict[str, np.ndarray]:
    """A ramp of three bands before, noise after, and a mask whose lower right corner is damaged in steps."""
    rows, columns = np.mgrid[0:9, 0:14]
    damage = np.where((rows > 2) & (columns > 5), (rows + columns + seed) % 4, 0)
    ramp = np.stack([(3 * rows + columns + 40 * band) % 256 for band in range(3)])
    noise = np.random.default_rng(seed).normal(size=(1, 9, 14))
    return {"pre_optical": ramp.astype(np.uint8), "post_sar": noise.astype(np.float32), "label": damage.astype(np.uint8)[None]}


@pytest.fixture(scope="module")
def tiles(tmp_path_factory):
    """Two tiles of one event and one of another, as TIFF files of strips, of tiles and deflated."""
    root = tmp_path_factory.mktemp("tiles")
    names = [f"{event}_{number:08d}" for event, number in (("rivermouth-flood", 4), ("rivermouth-flood", 7), ("northgate-wildfire", 1))]
    for seed, name in enumerate(names):
        for modality, image in images(seed).items():
            folder, suffix = SUFFIXES[modality]
            (root / folder).mkdir(exist_ok=True)
            tiff(root / folder / f"{name}{suffix}", image, deflate=modality == "label", tile=16 if modality == "pre_optical" else None)
    return root


def test_headers_and_pixels(spark, tiles):
    h = raster.headers(spark, str(tiles / "before")).first()
    assert (h.crs, h.width, h.height, h.bands, h.dtype) == ("EPSG:32721", 14, 9, 3, "uint8")
    assert h.bounds == [712400.0, 6230150.0 - 9 * 2.5, 712400.0 + 14 * 2.5, 6230150.0]
    assert raster.headers(spark, str(tiles / "after")).first().dtype == "float32"
    counts = raster.bands(spark, str(tiles / "label")).select(F.explode("pixels").alias("v")).groupBy("v").count().collect()
    values, n = np.unique(np.concatenate([images(seed)["label"].ravel() for seed in range(3)]), return_counts=True)
    assert {int(r.v): r["count"] for r in counts} == dict(zip(values.tolist(), n.tolist(), strict=True))
    assert raster.bands(spark, str(tiles / "before"), channels=2).count() == 6
    with pytest.raises(Exception, match="are needed"):
        raster.bands(spark, str(tiles / "after"), channels=3).collect()


def test_manifest_of_aligned_tiles(spark, tiles):
    found = {k: catalogue.modality_files(spark, str(tiles / d), s) for k, (d, s) in SUFFIXES.items()}
    rows = catalogue.manifest(found).collect()
    assert len(rows) == 3 and {r.event_id: r.disaster_type for r in rows} == EVENTS
    found["label"] = found["label"].where("tile_id NOT LIKE 'north%'")
    with pytest.raises(ValueError, match="do not align"):
        catalogue.manifest(found)


def test_split_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a", "b"], "val": ["c"], "test": ["d"]}, indent=1))
    assert {tuple(r) for r in catalogue.read_split(spark, str(tmp_path / "s.json")).collect()} == {("a", "train"), ("b", "train"), ("c", "val"), ("d", "test")}
    (tmp_path / "bad.json").write_text(json.dumps({"train": ["a"], "val": [], "test": ["d"]}))
    with pytest.raises(ValueError):
        catalogue.read_split(spark, str(tmp_path / "bad.json"))
    for name in ("train", "val", "test"):
        (tmp_path / f"{name}_set.txt").write_text(f"  {name}1 \n\n{name}2\n")
    ids = catalogue.read_official_ids(spark, str(tmp_path))
    assert [r.tile_id for r in ids["val"].collect()] == ["val1", "val2"]


def test_metrics_and_digests(spark, tmp_path):
    for run in ("m3", "m4_heldout"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.json").write_text(json.dumps({"pooled": {"miou": 0.5}}))
    got = {r.run: r.json for r in catalogue.read_metrics(spark, f"{tmp_path}/*/metrics.json").collect()}
    assert set(got) == {"m3", "m4_heldout"}
    found = catalogue.digests(spark, str(tmp_path / "m3"))
    other = found.withColumn("sha256", F.lit("0"))
    assert catalogue.changed_files(found, found).count() == 0 and catalogue.changed_files(other, found).count() == 1


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text("root: ${oc.env:DATA_ROOT,/default}\nmodel: {depth: 3}\n")
    assert config.load(str(path), ["model.depth=5", "data=tiles", "train.lr=0.1"]) == {"root": "/default", "model": {"depth": 5}, "train": {"lr": 0.1}}
    monkeypatch.setenv("DATA_ROOT", "/mnt")
    assert config.load(str(path))["root"] == "/mnt"
    assert config.load(str(path), ["dataset.root=/x"])["root"] == "/x"
    path.write_text("root: /a\ndataset: {root: '${oc.env:DATA_ROOT}'}\nnote: 'at ${oc.env:DATA_ROOT} here'\n")
    assert config.load(str(path)) == {"root": "/mnt", "dataset": {"root": "/mnt"}, "note": "at ${oc.env:DATA_ROOT} here"}
    assert config.section(["train.lr=1", "seed=2", "model.depth=3"], "train") == ["lr=1", "seed=2"]
    with pytest.raises(ValueError):
        config.load(str(path), ["nothing"])
    with pytest.raises(ValueError):
        config.check_bbox(10, 0, 5, 1)


def test_layout_artifacts_and_json(spark, tmp_path):
    from cairnfield.sources import artifacts, files

    root = tmp_path / "root"
    assert artifacts.listing(spark, str(root)).count() == 0
    rows = [("pre-event/deep/a.tif", b"1"), ("target/b.tif", b""), ("out/metadata.json", b'{"event_id": 1}'), ("out/bad.json", b"{"), ("out/blank.json", b" "), ("post-event.txt", b"x")]
    files.write_files(spark.createDataFrame(rows, "name string, content binary"), str(root))
    found = artifacts.listing(spark, f"file://{root}")
    assert {(r.name, r.length) for r in found.collect()} == {(n, len(c)) for n, c in rows}
    assert {(r.folder, r.n_files, r.complete) for r in artifacts.layout(found).collect()} == {("pre-event", 1, True), ("target", 1, True), ("post-event", 0, False)}
    with pytest.raises(ValueError, match="post-event"):
        artifacts.require_layout(spark, str(root))
    artifacts.require_layout(spark, str(root), ("pre-event", "out"))
    asked = spark.createDataFrame([(a,) for a in ("pre-event", "pre-event/deep/a.tif", "target", "target/b.tif", "out", "pre", "out/metadata.json")], "artifact string")
    state = {r.artifact: r.complete for r in artifacts.completeness(found, asked).collect()}
    assert state == {"pre-event": True, "pre-event/deep/a.tif": True, "target": False, "target/b.tif": False, "out": True, "pre": False, "out/metadata.json": True}
    assert {r.name: r.state for r in artifacts.json_files(spark, str(root)).collect()} == {"out/metadata.json": "valid", "out/bad.json": "invalid", "out/blank.json": "missing"}


def test_provenance_and_partitions(spark):
    from cairnfield.sources import artifacts

    rows = spark.createDataFrame([("2020", " ", "test"), ("2021", "x", "train")], "population_year string, population_source string, partition string")
    assert [r.missing for r in artifacts.missing_fields(rows, ("population_year", "population_source", "other")).collect()] == [["population_source", "other"], ["other"]]
    with pytest.raises(ValueError, match="population_source, population_version"):
        artifacts.require_fields(rows)
    artifacts.require_fields(rows, ("population_year",))
    assert artifacts.of_partition(rows).count() == 1 and artifacts.of_partition(rows.drop("partition")).count() == 2


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    from cairnfield.streaming import metrics as streams

    rows = spark.createDataFrame([(1,), (2,)], "v int")
    for mode, want in (("append", [1, 2, 3]), ("complete", [3])):
        table = str(tmp_path / mode)
        for number, batch in ((0, rows), (0, rows), (1, rows.limit(1).selectExpr("3 AS v")), (1, rows.limit(1).selectExpr("3 AS v"))):
            streams.committed(batch, table, number, mode)
        assert sorted(r.v for r in streams.results(spark, table, "v int").collect()) == want


def test_streams_append_each_batch_once(spark, tmp_path):
    from cairnfield.streaming import metrics as streams

    for k in range(3):
        spark.createDataFrame([(k, 10.0 * k)], "event_id long, value double").write.parquet(str(tmp_path / "in" / str(k)))
    files = spark.readStream.schema("event_id long, value double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(r.event_id for r in streams.drained(files, "append").collect()) == [0, 1, 2]
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema("event_id long").parquet(str(tmp_path / "none"))
    assert streams.drained(empty, "append").count() == 0
