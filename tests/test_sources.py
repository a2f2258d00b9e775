"""Recordings by ranges of samples, staged sinks, pictures."""

import io
import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavesift.functions import png, signal
from wavesift.operators import rasters
from wavesift.sources import npz, staged, wav


def made(path, x, rate, width=2, channels=1):
    import wave

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes((np.repeat(x[:, None], channels, 1) * 2**15).astype("<i2").tobytes())


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("recordings")
    x = np.round(np.random.default_rng(1).uniform(-0.9, 0.9, 9000) * 2**15) / 2**15
    made(root / "b.wav", x, 1000)
    made(root / "sub/a.wav", x[:4000], 500, channels=2)
    made(root / "short.wav", x[:100], 1000)
    (root / "bad.wav").write_bytes(b"no sound")
    cut = (root / "b.wav").read_bytes()
    (root / "torn.wav").write_bytes(cut[: 44 + 2 * 3000 + 1])
    return str(root), x


def test_ranges_give_the_same_chunks_as_whole_files(spark, tree):
    root, x = tree
    got = wav.read(spark, root, 1.0, 8.0, overlap=10, size=300)
    rows = {(r["file"], r["first"]): r for r in got.collect()}
    assert {r["file"] for r in rows.values()} == {"b.wav", "sub/a.wav", "short.wav", "bad.wav", "torn.wav"}
    assert rows["bad.wav", None]["error"] and rows["short.wav", 0]["samples"] == [0.0]
    for file, kept in {"b.wav": x[1000:8000], "sub/a.wav": x[500:4000], "torn.wav": x[1000:3000]}.items():
        firsts = sorted(f for name, f in rows if name == file)
        assert firsts == list(range(0, firsts[-1] + 1, 300)) and firsts[-1] + 310 >= len(kept) > firsts[-1]
        for f in firsts:
            r = rows[file, f]
            np.testing.assert_allclose(r["samples"], kept[f : f + 310], atol=1e-6)
            assert r["length"] == len(kept) and r["start_sec"] == f / r["sr"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    old = {(r["file"][-5:], r["first"]): r["samples"] for r in wav.chunks(files, 1.0, 8.0, overlap=10, size=300).collect()}
    assert {(f[-5:], k): r["samples"] for (f, k), r in rows.items()} == old


def test_filters_limits_and_names_reach_the_plan(spark, tree):
    root, _ = tree
    got = wav.read(spark, root, 0.0, None, size=500)
    assert sorted({r["first"] for r in got.where("file = 'b.wav' and first >= 1000 and start_sec < 3").collect()}) == [1000, 1500, 2000, 2500]
    plan = got.where("file = 'b.wav'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "") or "isnotnull" in plan
    reader = wav.Wav({"path": root, "size": "500"}).reader(None)
    assert list(reader.pushFilters([wav.EqualTo(("file",), "b.wav"), wav.GreaterThan(("first",), 7000), wav.EqualTo(("sr",), 5)])) == [wav.EqualTo(("sr",), 5)]
    assert [r for p in reader.partitions() for r in p.ranges] == [wav.Range("b.wav", 18044, [15, 16, 17], None)]
    assert [r["file"] for r in wav.read(spark, root, limit=2).select("file").distinct().orderBy("file").collect()] == ["b.wav", "bad.wav"]
    assert {r["file"] for r in wav.read(spark, root, name="a.wav").collect()} == {"sub/a.wav"}
    with pytest.raises(FileNotFoundError):
        wav.read(spark, f"{root}/none")


def test_long_recording_is_dealt_over_tasks_and_read_by_ranges(spark, tmp_path):
    """Two gigabytes by their header, a hole on disk but for one place: 5 s to 265 s in several tasks."""
    rate, n = 64_000, 1_000_000_000
    path = tmp_path / "long.wav"
    with open(path, "wb") as f:
        f.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 2 * n))
        f.truncate(44 + 2 * n)
        f.seek(44 + 2 * (100 * rate))
        f.write(struct.pack("<h", 16384))
    reader = wav.Wav({"path": str(tmp_path), "start_secs": "5", "end_secs": "265"}).reader(None)
    parts = reader.partitions()
    assert len(parts) >= 4 and max(sum(len(r.chunks) for r in p.ranges) for p in parts) * wav.CHUNK <= wav.PARTITION
    read = []
    real = wav.Recording.samples
    try:
        wav.Recording.samples = lambda self, a, b: read.append(b - a) or real(self, a, b)
        rows = [b.to_pylist()[0] for b in reader.read(parts[1])]
    finally:
        wav.Recording.samples = real
    assert sum(read) <= wav.PARTITION and max(read) <= wav.CHUNK
    hit = [(r["first"] + int(np.argmax(r["samples"]))) for r in rows if max(r["samples"]) > 0]
    assert hit in ([], [95 * rate])
    assert wav.read(spark, str(tmp_path), 5.0, 265.0).agg(F.sum(F.size("samples"))).first()[0] == 260 * rate


def test_written_recordings_come_back(spark, tmp_path):
    x = [[0.5, -0.25, 0.125], [0.0]]
    wav.write(spark.createDataFrame([("p/a.wav", 100, x[0]), ("b.wav", 200, x[1])], "file string, sr int, samples array<float>"), str(tmp_path / "w"))
    got = {r["file"]: (r["sr"], r["samples"]) for r in wav.read(spark, str(tmp_path / "w"), 0.0).collect()}
    assert got == {"p/a.wav": (100, x[0]), "b.wav": (200, x[1])}


def test_samples_beyond_full_scale_come_back(spark, tmp_path):
    """They are kept in floats, in the steps of the files of 16 bits, and read by ranges as those are."""
    x = [0.5, -2.25, 1.0, 1.09417, 0.30001, float("nan")]
    wav.write(spark.createDataFrame([("a.wav", 2, x), ("b.wav", 2, [-1.0, 1 - 2**-15])], "file string, sr int, samples array<float>"), str(tmp_path / "w"))
    want = np.trunc(np.float32(x) * 2**15) / 2**15
    got = {(r["file"], r["first"]): (r["length"], r["samples"]) for r in wav.read(spark, str(tmp_path / "w"), 0.5, size=3).collect()}
    assert got["a.wav", 0] == (5, want[1:4].tolist()) and got["b.wav", 0] == (1, [1 - 2**-15])
    np.testing.assert_array_equal(got["a.wav", 3][1], want[4:])
    raw = (tmp_path / "w/a.wav").read_bytes()
    assert len(raw) == struct.unpack_from("<I", raw, 4)[0] + 8 and len((tmp_path / "w/b.wav").read_bytes()) == 44 + 2 * 2
    double = raw[:20] + struct.pack("<HHIIHH", 3, 2, 2, 32, 16, 64) + struct.pack("<4sI4d", b"data", 32, 1.5, 9.0, -3.0, 9.0)
    long = raw[:16] + struct.pack("<IHHIIHHHHIH14s", 40, 0xFFFE, 1, 2, 4, 2, 16, 22, 16, 4, 1, b"") + struct.pack("<4sI2h", b"data", 4, 16384, -8192)
    assert wav._decode(double[:16] + struct.pack("<I", 16) + double[20:])[0].tolist() == [1.5, -3.0] and wav._decode(long)[0].tolist() == [0.5, -0.25]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    staged.save_files(spark.createDataFrame([("old", bytearray(b"1"))], "name string, content binary"), root)
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("d/"), "id").alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit(b"x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="lost"):
        staged.save_files(rows, root)
    assert os.listdir(root) == ["old"]
    for bad in ([("a", bytearray(b"1")), ("a", bytearray(b"2"))], [("../a", bytearray(b"1"))]):
        with pytest.raises(Exception):
            staged.save_files(spark.createDataFrame(bad, "name string, content binary"), root)
    assert os.listdir(root) == ["old"]
    staged.save_files(rows.where("id < 39"), root)
    assert sorted(os.listdir(root)) == ["d", "old"] and len(os.listdir(f"{root}/d")) == 39


def test_a_task_that_goes_on_after_the_end_brings_nothing_back(tmp_path):
    writer = staged.Files({"path": str(tmp_path / "out")}).writer(None, False)

    def batches():
        for name in ("d/a", "d/b"):
            yield pa.RecordBatch.from_pydict({"name": [name], "content": [b"x"]})
            writer.abort([])

    with pytest.raises(OSError):
        writer.write(batches())
    assert os.listdir(tmp_path / "out") == []


def test_archives_mirror_the_tree(spark, tmp_path):
    frames = [(f, t, [float(t + b) for b in range(3)], 64_000, f"/a/{f}") for f in ("x/a.npz", "b.npz") for t in range(5)]
    df = spark.createDataFrame(frames, "file string, frame long, bins array<double>, sr int, source_path string").repartition(4)
    staged.save_archives(df, str(tmp_path / "z"))
    with np.load(tmp_path / "z/x/a.npz") as a:
        assert a["feature"].shape == (1, 3, 5) and a["feature"].dtype == np.float32 and int(a["sr"]) == 64_000 and str(a["source_path"]) == "/a/x/a.npz"
    got = npz.read(spark, str(tmp_path / "z"), 3)
    assert got.count() == 10 and got.where("error is not null").count() == 0
    assert {(r["frame"], tuple(r["bins"])) for r in got.collect()} == {(t, (t, t + 1, t + 2)) for t in range(5)}


@pytest.mark.parametrize("rate, target", [(44_100, 64_000), (64_000, 44_100), (1000, 125), (3, 7)])
def test_phases_equal_the_kernel(rate, target):
    x = np.random.default_rng(6).normal(size=2000)
    cut = min(1.0, target / rate)
    at = np.arange(signal.resampled_length(len(x), rate, target)) * rate / target
    d = at[:, None] - np.arange(len(x))
    weight = cut * np.sinc(cut * d) * np.where(np.abs(d) * cut < 16, np.cos(np.pi * d * cut / 32) ** 2, 0)
    np.testing.assert_allclose(signal.resampled(x, rate, target), weight @ x, atol=1e-6)
    lo, hi = signal.resampled_span(200, 210, rate, target)
    lo, hi = max(lo, 0), min(hi, len(x))
    np.testing.assert_allclose(signal.resampled(x[lo:hi], rate, target, 200, 210, begin=lo, length=len(x)), (weight @ x)[200:210], atol=1e-6)


def test_pictures(spark):
    rng = np.random.default_rng(7)
    rows = [(f"f{i % 3}.npz", i, rng.normal(size=2).tolist()) for i in range(300)] + [("f0.npz", 500, [9.0, 9.0]), (None, 1, None)]
    scores = spark.createDataFrame(rows, "file string, start_frame long, scores array<double>")
    shares = np.array([0.6, 0.3])
    for picture in (rasters.by_file(scores, shares), rasters.by_window(scores.where("file = 'f1.npz'"), shares), rasters.with_outliers(scores, scores.where("start_frame = 500"), shares)):
        pixels = png.decode(picture)
        assert pixels.shape == (rasters.HEIGHT + 48, rasters.WIDTH + 48, 3) and (pixels < 255).any()
    red = (png.decode(picture) == (210, 30, 30)).all(2)
    assert red.sum() == 9 and red[:40].any()  # the one outlier lies at the top
    many = scores.withColumn("file", F.concat(F.lit("n"), F.col("start_frame")))
    assert png.decode(rasters.by_file(many, shares)).shape[2] == 3
    with pytest.raises(ValueError):
        rasters.by_file(spark.createDataFrame([("a", 0, [1.0])], "file string, start_frame long, scores array<double>"), shares)
    assert png.decode(rasters.by_file(scores.limit(0), shares)).any()


def test_window_grids_are_paged(spark):
    x = np.random.default_rng(8).normal(size=(64, 10))
    frames = spark.createDataFrame([(f, i, r.tolist()) for f in ("s/a.npz", "b.npz") for i, r in enumerate(x)], "file string, frame long, bins array<double>")
    got = rasters.tiles(frames, 8, 4, 5, 4)
    tile = next(np.array(r["tile"]).reshape(5, 4) for r in got.collect() if r["file"] == "b.npz" and r["start_frame"] == 12)
    np.testing.assert_allclose(tile, x[12:20].reshape(4, 2, 5, 2).max((1, 3)).T)
    some = spark.createDataFrame([("b.npz", 12), ("b.npz", 60)], "file string, start_frame long")
    only = rasters.of_outliers(some, frames, 8, 5, 4).collect()
    assert [(r["start_frame"], r["tile"]) for r in only] == [(12, tile.ravel().tolist())]
    files = {r["name"]: png.decode(bytes(r["content"])) for r in rasters.grids(got, 8, 0.008, 3, columns=4, page=10).collect()}
    assert sorted(files) == ["b-1.png", "b.png", "s/a-1.png", "s/a.png"]
    assert png.decode(png.encode(files["b.png"])).tolist() == files["b.png"].tolist() and io.BytesIO(png.encode(files["b.png"])).read(4) == b"\x89PNG"
