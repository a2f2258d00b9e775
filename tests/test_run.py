"""The whole run on a small tree of recordings, its files, and the tables of nothing and of nulls."""

import json
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.config import Settings
from wavesift.functions import order, signal
from wavesift.operators import clusters, outliers, pca, reports, tune
from wavesift.plans import catalogue, run
from wavesift.sources import csvs, wav

SMALL = Settings(sample_rate=1000, n_fft=64, hop=32, start_secs=1.0, end_secs=None, window_secs=0.32, band_start=2, n_components=4, tolerance=0.4, percentile=90.0)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Five recordings with a loud tone somewhere, one too short and one that is none."""
    root = tmp_path_factory.mktemp("audio")
    rng = np.random.default_rng(1)
    for i in range(5):
        x = rng.normal(size=9000).astype(np.float32) * 0.01
        x[3000 + 640 * i : 3320 + 640 * i] += 0.5 * np.sin(np.arange(320))
        folder = root / "sub" if i == 4 else root
        folder.mkdir(exist_ok=True)
        (folder / f"r.{i}.wav").write_bytes(wav._encode(x, 1000))
    (root / "short.wav").write_bytes(wav._encode(np.zeros(1010, np.float32), 1000))
    (root / "bad.wav").write_bytes(b"no sound")
    return str(root)


@pytest.fixture(scope="module")
def done(spark, tree, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    run.run(spark, SMALL, tree, out, clips=f"{out}/wavs")
    return out


def text(path):
    return "".join(open(f"{path}/{p}").read() for p in sorted(os.listdir(path)) if p.startswith("part"))


def test_artifacts(spark, tree, done):
    index = {r["source_path"]: r for r in csvs.read(spark, f"{done}/spectrograms/features_index", csvs.INDEX).collect()}
    assert sorted(index) == [f"{tree}/{n}" for n in ("r.0.wav", "r.1.wav", "r.2.wav", "r.3.wav", "sub/r.4.wav")]
    assert index[f"{tree}/r.0.wav"]["shape"] == "[1, 33, 251]" and index[f"{tree}/r.0.wav"]["sr"] == 1000
    errors = {r[0] for r in spark.read.option("header", True).csv(f"{done}/spectrograms/errors").collect()}
    assert errors == {"short.npz", "bad.npz"}
    found = csvs.read(spark, f"{done}/outliers/outliers.csv", csvs.OUTLIERS).collect()
    tones = {(f"{'sub/' if i == 4 else ''}r.{i}.npz", round((2000 + 640 * i) / 1000 // 0.32 * 0.32, 3)) for i in range(5)}
    got = {(r["File"], round(r["Start Time (s)"], 3)) for r in found}
    assert len({f for f, _ in got & {(f, round(t + d * 0.32, 3)) for f, t in tones for d in (-1, 0, 1)}}) == 5
    scores = {(r["file"], r["start_frame"]): r["scores"] for r in spark.read.parquet(f"{done}/pca/scores").collect()}
    places = {k: i for i, k in enumerate(sorted(scores))}
    for r in found:
        key = r["File"], r["Start Frame"]
        assert r["Index"] == places[key] and (r["PC1"], r["PC2"]) == pytest.approx(scores[key][:2])
    report = text(f"{done}/outliers/outliers_report.txt")
    assert report.count("\n") == 14 + len(found) + len({r["File"] for r in found}) and "\ncut = " in report
    clip = next(r for r in found if r["File"] == "sub/r.4.npz")
    with open(f"{done}/outliers/../wavs/sub/r.4/r.4_t{clip['Start Time (s)']:.2f}s.wav", "rb") as f:
        x, rate = wav._decode(f.read())
    whole, _ = wav._decode(open(f"{tree}/sub/r.4.wav", "rb").read())
    first = int((clip["Start Time (s)"] + 1.0) * 1000)
    assert rate == 1000 and np.abs(x - whole[first : first + 320]).max() <= 2**-15


def test_model_is_the_same_when_read_again(spark, done):
    model, told = pca.load(spark, f"{done}/pca/model")
    again = pca.fit(spark.read.parquet(f"{done}/pca/features"), 4)
    np.testing.assert_allclose(model.components, again.components, atol=1e-9)
    np.testing.assert_allclose(model.scaler.std, again.scaler.std)
    assert told["window_secs"] == 0.32 and Settings(**told) == SMALL


def test_skipped_stages_and_missing_inputs(spark, tree, done):
    before = sorted(r["index"] for r in spark.read.parquet(f"{done}/outliers/outliers").collect())
    again = run.run(spark, replace(SMALL, percentile=50.0), tree, done, skip_extraction=True, skip_pca=True)
    assert again.count() > len(before)
    run.run(spark, SMALL, tree, done, skip_extraction=True)
    assert sorted(r["index"] for r in spark.read.parquet(f"{done}/outliers/outliers").collect()) == before
    with pytest.raises(FileNotFoundError):
        run.extract(spark, SMALL, f"{tree}/nothing", f"{done}/x")
    with pytest.raises(ValueError, match="no complete window"):
        run.components(spark, replace(SMALL, window_secs=100.0), run.frames_at(spark, f"{done}/spectrograms"), f"{done}/y")


def test_evaluation_and_tuning(spark, tree, done, tmp_path):
    labels = str(tmp_path / "labels.csv")
    rows = [f"{(2000 + 640 * i) / 1000:.2f},r.{i}.npz," for i in range(5)]
    open(labels, "w").write("\n".join(["start_sec,file,end_sec", *rows, "0.1,none.npz,"]) + "\n")
    score = run.compare(spark, f"{done}/outliers/outliers.csv", labels, 0.4, str(tmp_path / "report")).first()
    assert (score["n_labels"], score["n_matched"]) == (6, 5) and text(tmp_path / "report").count("\n") == 10 + 1 + 2 + 2 + 5
    grid = dict(run.GRID) | {"n_components": [2, 4], "n_mels": [None, 16], "window_secs": [0.32], "threshold_percentile": [90.0]}
    run.search(spark, replace(SMALL, f_max=500.0), tree, labels, str(tmp_path / "tuned"), grid)
    got = csvs.read(spark, str(tmp_path / "tuned" / "tuning_results.csv"), csvs.TRIALS)
    rows = {r["run_num"]: r for r in got.collect()}
    assert [rows[i]["n_components"] for i in range(1, 5)] == [2, 2, 4, 4] and [rows[i]["n_mels"] for i in range(1, 5)] == [None, 16, None, 16]
    assert tune.best(got).first()["f1"] == max(r["f1"] for r in rows.values()) > 0
    assert rows[3]["n_validation"] == 6 and json.loads(text(tmp_path / "tuned" / "tuning_config.json"))["param_grid"]["n_mels"] == [None, 16]


def test_command_line(spark, tree, done, tmp_path):
    args = ["--sample-rate", "1000", "--n-fft", "64", "--hop", "32", "--start-secs", "1", "--window-secs", "0.32", "--band-start", "2", "--n-components", "4"]
    assert run.main(["all", "--audio-root", tree, "--out", str(tmp_path), "--subset-len", "4", *args]) == 0
    # the first four by path: one of them can't be read
    assert csvs.read(spark, f"{tmp_path}/spectrograms/features_index", csvs.INDEX).count() == 3
    assert run.main(["outliers", "--pca-root", f"{tmp_path}/pca", "--out", f"{tmp_path}/o", *args]) == 0


def test_pictures_archives_and_clusters(spark, tree, done, tmp_path):
    args = ["--sample-rate", "1000", "--n-fft", "64", "--hop", "32", "--start-secs", "1", "--window-secs", "0.32", "--band-start", "2", "--n-components", "4", "--tolerance", "0.4", "--percentile", "90"]
    shots = tmp_path / "shots"
    assert run.main(["pca", "--frames-root", f"{done}/spectrograms", "--out", f"{tmp_path}/pca", "--pictures", str(shots), *args]) == 0
    assert run.main(["outliers", "--pca-root", f"{tmp_path}/pca", "--out", f"{tmp_path}/o", "--frames-root", f"{done}/spectrograms", "--pictures", str(shots), *args]) == 0
    assert run.main(["plots", "--frames-root", f"{done}/spectrograms", "--out", f"{tmp_path}/grids", "--cols", "3", "--file", "sub/r.4.npz", *args]) == 0
    files = sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".png"))
    found = csvs.read(spark, f"{tmp_path}/o/outliers.csv", csvs.OUTLIERS)
    with_outliers = {r["File"].removesuffix(".npz") for r in found.select("File").distinct().collect()}
    assert files == sorted(["grids/sub/r.4.png", "shots/outliers.png", "shots/pca.png", *(f"shots/windows/{n}.png" for n in with_outliers)])
    assert run.main(["extract", "--audio-root", tree, "--out", f"{tmp_path}/again", "--archives-out", f"{tmp_path}/z", *args]) == 0
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path / "z") for d, _, names in os.walk(tmp_path / "z") for f in names) == ["r.0.npz", "r.1.npz", "r.2.npz", "r.3.npz", "sub/r.4.npz"]
    index = csvs.read(spark, f"{tmp_path}/again/features_index", csvs.INDEX).first()
    assert os.path.exists(index["feature_path"])
    same = {n: run.frames_at(spark, p, archives=a).where("error is null").selectExpr("file", "frame", "bround(bins[5], 3) as b").orderBy("file", "frame").collect() for n, p, a in (("z", f"{tmp_path}/z", True), ("f", f"{done}/spectrograms", False))}
    assert [(r["file"], r["frame"]) for r in same["z"]] == [(r["file"], r["frame"]) for r in same["f"]]
    np.testing.assert_allclose([r["b"] for r in same["z"]], [r["b"] for r in same["f"]], atol=2e-3)
    labels = tmp_path / "labels.csv"
    labels.write_text("start_sec,file,end_sec\n" + "".join(f"{(2000 + 640 * i) / 1000:.2f},r.{i}.npz,\n" for i in range(5)))
    assert run.main(["clusters", "--outliers-root", f"{tmp_path}/o", "--out", f"{tmp_path}/c", "--labels-csv", str(labels), "--k", "2", "--k-min", "2", "--k-max", "4", "--dimensions", "3", *args]) == 0
    n = found.count()
    grouped = spark.read.parquet(f"{tmp_path}/c/clusters")
    assert grouped.count() == n and {r["cluster"] for r in grouped.collect()} <= {0, 1} and spark.read.parquet(f"{tmp_path}/c/centres").count() == 2
    swept = spark.read.option("header", True).csv(f"{tmp_path}/c/sweep").groupBy("k").agg(F.sum("n").alias("n"), F.sum("n_validated").alias("v")).collect()
    assert {(r["k"], r["n"]) for r in swept} == {(str(k), n) for k in (2, 3, 4)} and all(r["v"] >= 5 for r in swept)


def test_labels_by_bare_name_and_by_path(spark):
    files = spark.createDataFrame([("a/x.npz",), ("b/x.npz",), ("c/y.npz",), ("z.npz",), ("d/z.npz",)], "file string")
    labels = spark.createDataFrame([("x.npz", 1.0), ("b/x.npz", 2.0), ("y.npz", 3.0), ("z.npz", 4.0), ("none.npz", 5.0), (None, 6.0)], "file string, start_sec double")
    got, ambiguous = run._aligned(labels, files)
    assert {r["start_sec"]: r["file"] for r in got.collect()} == {1.0: "x.npz", 2.0: "b/x.npz", 3.0: "c/y.npz", 4.0: "z.npz", 5.0: "none.npz", 6.0: None}
    assert [tuple(r) for r in ambiguous.collect()] == [("x.npz", 2)]


def test_shared_seeding_is_as_good_as_separate_fits(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 0.5, (60, 3)) for c in rng.uniform(-8, 8, (9, 3))])
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "file string, start_frame long, scores array<double>").repartition(4)
    centres, cost = clusters.fits(rows, (2, 5, 9), 3)
    for k in (2, 5, 9):
        away = ((x[:, None] - centres[k]) ** 2).sum(2)
        assert cost[k] == pytest.approx(away.min(1).sum(), rel=1e-4)
        alone = min(clusters.kmeans(rows, k, 3, seed)[2] for seed in range(3))
        assert cost[k] <= 1.01 * alone
    assert clusters.fits(rows.limit(0), (2,), 3) == ({}, {})
    same = spark.createDataFrame([("a", i, [1.0, 2.0]) for i in range(5)], "file string, start_frame long, scores array<double>")
    assert [len(c) for c in clusters.fits(same, (3,), 2)[0].values()] == [1]


def test_trials_that_cannot_run_say_why(spark, tree, done, tmp_path):
    labels = tmp_path / "labels.csv"
    labels.write_text("start_sec,file,end_sec\n2.0,r.0.npz,\n")
    grid = dict(run.GRID) | {"n_components": [2], "n_mels": [None], "window_secs": [0.32, 100.0], "threshold_percentile": [90.0]}
    os.makedirs(f"{tmp_path}/t")
    os.symlink(f"{done}/spectrograms", f"{tmp_path}/t/spectrograms-None")
    got = {r["window_secs"]: r for r in run.search(spark, SMALL, tree, str(labels), f"{tmp_path}/t", grid, skip_extraction=True).collect()}
    assert got[0.32]["n_outliers"] > 0 and got[0.32]["note"] is None
    assert got[100.0]["f1"] in (0.0, None) and "no complete window" in got[100.0]["note"]


def test_resampled_chunks_have_no_edges(spark):
    x = np.sin(np.arange(5000) / 7).astype(np.float32) * 0.9
    files = spark.createDataFrame([("a", bytearray(wav._encode(x, 1000)))], "path string, content binary")
    got = wav.chunks(files, 0.5, None, overlap=10, size=300, rate=400).orderBy("first").collect()
    whole = signal.resampled(wav._decode(wav._encode(x, 1000))[0][500:], 1000, 400)
    assert got[0]["length"] == len(whole) == 1800 and got[0]["sr"] == 400
    for r in got:
        np.testing.assert_allclose(r["samples"], whole[r["first"] : r["first"] + 310], atol=1e-6)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sample_widths(width):
    import io
    import wave

    x = np.array([0.0, 0.5, -0.5, 0.25])
    raw = (x * 128 + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v * 2 ** (8 * width - 1)).to_bytes(width, "little", signed=True) for v in x)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(width), w.setframerate(8), w.writeframes(raw)
    np.testing.assert_allclose(wav._decode(out.getvalue())[0], x, atol=1e-6)


def test_percentile_is_exact(spark):
    rng = np.random.default_rng(2)
    kinds = [rng.normal(size=501), np.r_[np.zeros(300), rng.normal(size=100)], np.ones(50), np.array([3.0]), np.array([-0.0, 0.0, -1e-320, 1e300, -1e300, np.inf]), rng.integers(-3, 3, 200) * 1e-9, 1 + np.arange(64) * 2.0**-52]
    rows = [(f"g{i}", float(v)) for i, x in enumerate(kinds) for v in x] + [("g0", None), ("g1", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    percents = [0, 5, 50, 95, 99.9, 100]
    got = order.percentiles(df, "v", percents, F.col("g"))
    assert sorted(got) == [f"g{i}" for i in range(len(kinds))]
    for i, x in enumerate(kinds):
        finite = [p for p in percents if np.isfinite(np.percentile(x, p))]
        np.testing.assert_allclose([got[f"g{i}"][percents.index(p)] for p in finite], np.percentile(x, finite), rtol=1e-14, atol=0)
    assert order.percentile(df.where("g = 'g0'"), "v", 95) == pytest.approx(np.percentile(kinds[0], 95), abs=1e-15)
    assert order.percentile(df.limit(0), "v", 50) is None


def test_numbers_and_neighbours_across_cells(spark):
    rows = [(f, n) for f in "cab" for n in range(40)]
    df = spark.createDataFrame(rows, "file string, start_frame long").repartition(5)
    got = {(r["file"], r["start_frame"]): r["index"] for r in order.numbered(df, "file", "start_frame", F.expr("start_frame div 7")).collect()}
    assert got == {k: i for i, k in enumerate(sorted(rows))}
    mixed = spark.createDataFrame([(None if f == "c" else f, n, n % 5) for f, n in rows] + [("d", None, 0)], "file string, t long, tie long").repartition(5)
    place = {(r["file"], r["t"]): r["n"] for r in order.placed(mixed, "file", ["tie", "t"], F.expr("tie div 2"), "n").collect()}
    want = sorted(range(40), key=lambda n: (n % 5, n))
    assert place == {(f, n): want.index(n) for f in (None, "a", "b") for n in range(40)} | {("d", None): 0}
    near = order.with_previous(df.where("start_frame <> 13"), "file", "start_frame", "start_frame", "before", 8).collect()
    assert len(near) == 117 and all(r["before"] == (None if r["start_frame"] in (0, 14) else r["start_frame"] - 1) for r in near)


def test_null_features_have_no_scores(spark):
    x = np.random.default_rng(3).normal(size=(80, 6))
    df = spark.createDataFrame([("a", i, r.tolist()) for i, r in enumerate(x)] + [("b", 0, None), ("b", 1, [None] * 6)], "file string, start_frame long, features array<double>")
    got = pca.transform(df, pca.fit(df, 4))
    assert got.where("scores is null").count() == 2 and outliers.distances(got).where("distance is null").count() == 2


def _tables(spark, folder, events, embeddings):
    kinds = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").schema for n in ("events", "embeddings")}
    for name, rows in (("events", events), ("embeddings", embeddings)):
        schema = T.StructType([T.StructField(f.name, T.ArrayType(T.FloatType()) if f.name == "embedding" else f.dataType) for f in kinds[name]])
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    _tables(spark, folder, [], [])
    return folder


@pytest.fixture(scope="module")
def holes(spark, tmp_path_factory):
    """The tables, with a null in every column of some rows, repeated rows and an extra group of nulls."""
    folder = str(tmp_path_factory.mktemp("holes"))
    given = [spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet").collect() for n in ("events", "embeddings")]
    out = []
    for rows in given:
        rows = [tuple(r) for r in rows]
        for i in range(len(rows[0])):
            for k in range(3):
                at = 11 * (3 * i + k)
                rows[at] = tuple(None if j == i else v for j, v in enumerate(rows[at]))
        out.append(rows + rows[-5:] + [tuple(None for _ in rows[0])] * 3)
    out[1][200] = (out[1][200][0], [None, *out[1][200][1][1:]], out[1][200][2])
    _tables(spark, folder, *out)
    return folder


ONE_ROW = {"prf1", "distance_stats", "best_trial"}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_tables_of_nothing(spark, nothing, name):
    rows = catalogue.queries()[name](spark, nothing).collect()
    assert len(rows) == (12 if name == "grid_trials" else name in ONE_ROW)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_tables_with_holes(spark, holes, name):
    got = catalogue.queries()[name](spark, holes)
    assert got.count() > 0 or name == "point_window"


def test_lines_list_everything(spark):
    found = spark.createDataFrame([(i, f"f{i % 3}", i, float(i), 1.5, [1.0]) for i in range(30)], "index long, file string, start_frame long, start_sec double, distance double, scores array<double>")
    lines = [r[0] for r in reports.outlier_lines(found, found, "euclidean", 95.0, None).collect()]
    assert len(lines) == 1 + 30 + 2 + 3 + 11 and lines[1].startswith("f0 @ 0.000 s: window 0") and lines[33:36] == ["10 in f0", "10 in f1", "10 in f2"]
    assert "windows = 30" in lines and "cut = none" in lines


def test_clusters_against_numpy(spark):
    """Each row is in the cluster of the nearest centre, centres are means, and the cost is theirs."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (40, 4)) for c in (-3, 0, 4)])
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)] + [("a", 500, None)], "file string, start_frame long, scores array<double>")
    got, centres, cost = clusters.kmeans(rows, 3, 3)
    label = {r["start_frame"]: r["cluster"] for r in got.collect()}
    centres = np.array(centres)
    away = ((x[:, None, :3] - centres) ** 2).sum(2)
    assert len(label) == 120 and all(label[i] == k for i, k in enumerate(away.argmin(1)))
    np.testing.assert_allclose(centres, [x[away.argmin(1) == k][:, :3].mean(0) for k in range(3)], atol=1e-9)
    assert cost == pytest.approx(away.min(1).sum()) and sorted(np.bincount(list(label.values()))) == [40, 40, 40]
    few, _, none = clusters.kmeans(rows.where("start_frame < 2"), 3, 3)
    assert sorted(r["cluster"] for r in few.collect()) == [0, 1] and none == 0.0
    marked = rows.withColumn("start_sec", F.col("start_frame").cast("double"))
    swept = clusters.sweep(marked, (2, 3), 3, labels=marked.where("start_frame between 40 and 79").select("file", "start_sec"), tolerance=0.5).collect()
    assert sum(r["n"] for r in swept if r["k"] == 3) == 120 and [r["n_validated"] for r in swept if r["k"] == 3 and r["n_validated"]] == [40]
