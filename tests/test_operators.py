"""Operators against numpy on small arrays, and their corner cases."""

import numpy as np
import pytest

from wavesift.config import Settings
from wavesift.functions import signal
from wavesift.operators import audio, clusters, evaluate, features, outliers, pca, windows
from wavesift.sources import csvs, npz, tables, wav
from wavesift.streaming import score as streaming

FRAMES = "file string, frame long, bins array<double>"


def frames(spark, **files):
    return spark.createDataFrame([(f, i, [float(v) for v in row]) for f, x in files.items() for i, row in enumerate(x)], FRAMES)


def one(df, column="features"):
    return {(r["file"], r["start_frame"]): np.array(r[column]) for r in df.collect()}


def test_settings():
    s = Settings()
    assert s.window_frames == 625 and s.frames(2.5) == 312 and s.stride_frames == 625
    assert s.frames(0) == 1


@pytest.mark.parametrize("t, stride, want", [(7, 8, 0), (8, 8, 1), (15, 8, 1), (16, 8, 2), (13, 3, 2)])
def test_complete_windows_only(spark, t, stride, want):
    x = frames(spark, a=np.zeros((t, 2)))
    assert windows.starts(x, 8, stride).count() == want
    assert features.build(x, 8, stride, "mean_std").count() == want


@pytest.mark.parametrize("size, stride", [(1, 1), (5, 1), (6, 4), (6, 3), (7, 7), (3, 8), (40, 9), (12, 5)])
def test_windows_from_panes(spark, monkeypatch, size, stride):
    """Cells, panes and blocks of any proportion give what each window gives by itself; gaps and repeated numbers break windows."""
    monkeypatch.setattr(features, "CELL", 16)
    x = np.random.default_rng(size).normal(size=(90, 3)) * np.r_[np.full(50, 1e6), np.full(40, 1e-3)][:, None]
    x[60:75, 1] = -0.1
    there = [i for i in range(90) if i != 37]
    rows = [("a", i, x[i].tolist()) for i in there] + [("a", 81, [0.0] * 3), ("a", None, [0.0] * 3), ("a", 37, None)]
    df = spark.createDataFrame(rows, FRAMES).repartition(4)
    starts = [s for s in range(0, 90 - size + 1, stride) if not s <= 37 < s + size and not s <= 81 < s + size]
    aci = lambda w, axis: np.where(w.sum(axis) > 0, np.abs(np.diff(w, axis=axis)).sum(axis) / np.where(w.sum(axis) > 0, w.sum(axis), 1), 0)
    for method, f in {"mean_std": lambda w: np.r_[w.mean(0), w.std(0)], "ACI_both": lambda w: np.r_[aci(w, 0), aci(w, 1)], "full_window": lambda w: w.T.ravel()}.items():
        got = one(features.build(df, size, stride, method))
        assert sorted(s for _, s in got) == starts
        for s in starts:
            np.testing.assert_allclose(got["a", s], f(x[s : s + size]), rtol=1e-9, atol=1e-12)
    flat = [s for s in starts if s >= 60 and s + size <= 75]
    assert all(got_std < 1e-15 for s in flat for got_std in one(features.build(df, size, stride))["a", s][4:5])


def test_gaps_between_windows(spark):
    x = frames(spark, a=np.arange(20)[:, None])
    assert {k[1] for k in one(features.mean_std(x, 3, 5))} == {0, 5, 10, 15}


def test_features(spark):
    x = np.random.default_rng(1).normal(size=(11, 4))
    df = frames(spark, a=x)
    w = x[4:8]
    aci = lambda w, axis: np.where(w.sum(axis) > 0, np.abs(np.diff(w, axis=axis)).sum(axis) / w.sum(axis), 0)
    want = {"mean_std": np.r_[w.mean(0), w.std(0)], "ACI": aci(w, 0), "ACI_time": aci(w, 1), "ACI_both": np.r_[aci(w, 0), aci(w, 1)], "full_window": w.T.ravel()}
    for method, value in want.items():
        got = one(features.build(df, 4, 4, method))
        assert sorted(got) == [("a", 0), ("a", 4)]
        np.testing.assert_allclose(got["a", 4], value, atol=1e-12)
    with pytest.raises(ValueError):
        features.build(df, 4, 4, "other")


def test_aci_signs_and_missing_numbers(spark):
    df = frames(spark, a=[[1, -1, 1], [3, -3, float("nan")], [2, -2, 1]])
    np.testing.assert_allclose(one(features.aci(df, 3, 3))["a", 0], [0.5, 0, 0])


def test_resize(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0],), ([5.0, 6.0],), ([],)], "x array<double>")
    assert [r[0] for r in features.resized(df, "x", 3).collect()] == [[0, 1, 3], [5, 6, 0], [0, 0, 0]]
    assert [r[0] for r in features.resized(df, "x", 4).collect()][1] == [5, 6, 0, 0]


def test_band_and_names(spark):
    df = frames(spark, a=[[0, 1, 2, 3]])
    assert tables.band(df, 1, 99).first()["bins"] == [1, 2, 3]
    with pytest.raises(ValueError):
        tables.band(df, -1)
    r = tables.name_parts(spark.createDataFrame([("x/6230.2209.npz",)], "path string")).first()
    assert (r["name"], r["stem"]) == ("6230.2209.npz", "6230.2209")


def vectors(spark, x):
    return spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)], "file string, start_frame long, features array<double>")


def test_pca_and_distances(spark):
    x = np.random.default_rng(2).normal(size=(60, 6)) @ np.diag([5, 3, 2, 1, 1, 1])
    x[:, 5] = -37.3
    df = vectors(spark, x)
    model = pca.fit(df, 3)
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1)
    u, s, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    np.testing.assert_allclose(model.explained, (s**2 / (s**2).sum())[:3], atol=1e-10)
    np.testing.assert_allclose(np.abs(model.components), np.abs(vt[:3]), atol=1e-8)
    got = {k[1]: v for k, v in one(outliers.distances(pca.transform(df, model)), "distance").items()}
    want = np.sqrt(59 * (u[:, :3] ** 2).sum(1))
    np.testing.assert_allclose([got[i] for i in range(60)], want, atol=1e-8)
    assert outliers.above(outliers.distances(pca.transform(df, model)), 95).count() == (want > np.percentile(want, 95)).sum()
    assert len(one(outliers.distances(pca.transform(df, model, 1)), "distance")) == 60
    assert clusters.sweep(pca.transform(df, model), [2, 3], 2).count() == 5


@pytest.mark.parametrize("rows, width, k", [(12, 40, 4), (90, 40, 4), (30, 12, 12)])
def test_wide_pca_is_the_same_as_narrow(spark, monkeypatch, rows, width, k):
    """Rows of a null file and of repeated keys count like all others, whatever the number of rows."""
    x = np.random.default_rng(3).normal(size=(rows, width))
    keys = [(None if i % 4 == 0 else "a", i % 3) for i in range(rows)]
    df = spark.createDataFrame([(*key, r.tolist()) for key, r in zip(keys, x)], "file string, start_frame long, features array<double>")
    narrow = pca.fit(df, k)
    z = (x - x.mean(0)) / x.std(0)
    np.testing.assert_allclose(narrow.explained, (np.linalg.svd(z)[1] ** 2 / (z**2).sum())[: len(narrow.explained)], atol=1e-9)
    monkeypatch.setattr(pca, "MAX_DIMENSIONS", 10)
    monkeypatch.setattr(pca, "COLUMNS", 16)
    wide = pca.fit(df, k)
    np.testing.assert_allclose(wide.explained, narrow.explained, atol=1e-9)
    np.testing.assert_allclose(wide.components, narrow.components, atol=1e-6)


def test_outlier_corner_cases(spark):
    same = vectors(spark, np.ones((5, 2)))
    assert outliers.above(outliers.distances(same, "euclidean", "features")).count() == 0
    with pytest.raises(ValueError):
        outliers.distances(same, "mahalanobis", "features")
    with pytest.raises(ValueError):
        outliers.distances(same, "other", "features")


def test_matching(spark):
    labels = spark.createDataFrame([(1, "f", 10.0), (2, "f", 14.0), (3, "f", 20.0), (4, "g", 10.0)], "label_id long, file string, start_sec double")
    found = spark.createDataFrame([("f", 12.0), ("f", 15.0)], "file string, start_sec double")
    assert {r["label_id"] for r in evaluate.matched(labels, found, 5.0).collect()} == {1, 2}
    assert {r["label_id"] for r in evaluate.missed(labels, found, 5.0).collect()} == {3, 4}  # 20 - 15 is not below 5
    got = {r["label_id"]: r["detected"] for r in evaluate.matches(labels, found, 5.0).collect()}
    assert got == {1: [12.0], 2: [12.0, 15.0], 3: [], 4: []}
    s = evaluate.score(labels, found.limit(1), 5.0).first()
    assert (s["recall"], s["precision"], s["precision_detections"]) == (0.5, 2.0, 1.0)
    none = evaluate.score(labels, found.where("false"), 5.0).first()
    assert (none["precision"], none["f1"]) == (0.0, 0.0)


@pytest.mark.parametrize("tolerance", [0.1, 1.0, 3.7])
def test_matching_equals_all_pairs(spark, tolerance):
    rng = np.random.default_rng(8)
    rows = lambda n: [(None if f == 3 else f"f{f}", None if i % 17 == 0 else float(t)) for i, (f, t) in enumerate(zip(rng.integers(0, 4, n), np.round(rng.uniform(0, 30, n), 1)))]
    a, b = rows(150), rows(60)
    labels = spark.createDataFrame([(i, *r) for i, r in enumerate(a)], "label_id long, file string, start_sec double").repartition(3)
    found = spark.createDataFrame(b, "file string, start_sec double")
    near = lambda x, others: any(x[0] is not None and x[0] == f and x[1] is not None and t is not None and abs(x[1] - t) < tolerance for f, t in others)
    want = {i for i, r in enumerate(a) if near(r, b)}
    assert {r["label_id"] for r in evaluate.matched(labels, found, tolerance).collect()} == want
    assert {r["label_id"] for r in evaluate.missed(labels, found, tolerance).collect()} == set(range(150)) - want
    hits = sum(near(r, a) for r in b)
    s = evaluate.score(labels, found, tolerance).first()
    assert (s["n_labels"], s["n_matched"], s["n_detections"], s["precision_detections"]) == (150, len(want), 60, hits / 60)


def test_a_million_detections_in_one_cell(spark):
    labels = spark.createDataFrame([(1, "f", 10.0), (2, "f", 11.2), (3, "f", 50.0)], "label_id long, file string, start_sec double")
    crowd = spark.range(1_000_000).selectExpr("'f' as file", "10 + id / 1e7 as start_sec")
    assert sorted(r["label_id"] for r in evaluate.matched(labels, crowd, 1.2).collect()) == [1, 2]
    back = evaluate.score(crowd, labels.drop("label_id"), 1.2).first()
    assert (back["n_labels"], back["n_matched"]) == (1_000_000, 1_000_000)


def _wav(path, x, rate):
    path.write_bytes(wav._encode(x, rate))


def test_recordings_to_spectrogram(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.uniform(-0.5, 0.5, 3000).astype(np.float32)
    (tmp_path / "sub").mkdir()
    _wav(tmp_path / "sub" / "a.wav", x, 1000)
    (tmp_path / "b.wav").write_bytes(b"no sound")
    _wav(tmp_path / "c.wav", x[:10], 1000)
    files = wav.scan(spark, str(tmp_path))
    assert files.count() == 3 and wav.scan(spark, str(tmp_path), limit=1).count() == 1
    parts = wav.chunks(files, 0.0, None, overlap=64, size=500)
    assert parts.where("error is not null").count() == 1
    got = signal.spectrogram(parts, 64, 32).collect()
    kept = np.asarray(wav._decode((tmp_path / "sub" / "a.wav").read_bytes())[0], np.float64)
    padded = np.pad(kept, 32, "reflect")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    want = [10 * np.log10(np.maximum(np.abs(np.fft.rfft(padded[t * 32 : t * 32 + 64] * window)) ** 2 * 1e12, 1e-10)) for t in range(1 + len(kept) // 32)]
    rows = sorted((r["frame"], r["bins"]) for r in got)
    assert [t for t, _ in rows] == list(range(len(want)))
    np.testing.assert_allclose([b for _, b in rows], want, atol=1e-6)


def test_mel_and_resampling():
    w = signal.mel_weights(513, 64, 64_000)
    assert w.shape == (64, 513) and w.max() <= 1 and (w >= 0).all()
    t = np.arange(2000)
    x = np.sin(2 * np.pi * 5 * t / 1000)
    y = signal.resampled(x, 1000, 500)
    np.testing.assert_allclose(y[100:-100], x[::2][100:-100], atol=1e-3)
    assert signal.resampled(x, 1000, 1000) is x


def test_archives(spark, tmp_path):
    s = np.arange(12, dtype=np.float32).reshape(1, 3, 4)
    np.savez(tmp_path / "a.npz", feature=s, sr=64000)
    np.savez(tmp_path / "b.npz", feature=s[0].T)
    np.savez(tmp_path / "c.npz", other=s)
    got = npz.read(spark, str(tmp_path), n_bins=3)
    assert got.where("error is not null").count() == 1
    rows = {(r["file"][-5:], r["frame"]): r["bins"] for r in got.where("error is null").collect()}
    assert rows["a.npz", 1] == rows["b.npz", 1] == [1, 5, 9] and len(rows) == 8


def test_clips_and_stats(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i % 7) - 3) for i in range(1000)], "file string, n long, amplitude double")
    wanted = spark.createDataFrame([("a", 0.0), ("a", 4.5)], "file string, start_sec double")
    got = {r["start_sec"]: (r["first"], len(r["samples"])) for r in audio.clips(df, wanted, 100, 2.0).collect()}
    assert got == {0.0: (500, 200), 4.5: (950, 50)}
    s = audio.stats(df, 100).first()
    x = np.array([i % 7 - 3 for i in range(1000)])
    assert s["peak_abs"] == 3 and s["zcr"] == pytest.approx((np.diff(x < 0) != 0).sum() / 999 * 100)


def test_tables_written_even_if_empty(spark, tmp_path):
    df = spark.createDataFrame([], csvs.LABELS)
    csvs.write(df, str(tmp_path / "x"))
    assert csvs.read(spark, str(tmp_path / "x"), csvs.LABELS).count() == 0


def test_streaming_scores_like_a_table(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(40, 3))
    df = vectors(spark, x)
    model = pca.fit(df, 2)
    mean, root = np.zeros(2), np.eye(2)
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.outliers(live, model, mean, root, 1.5).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == streaming.outliers(df, model, mean, root, 1.5).count() > 0
