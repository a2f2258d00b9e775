"""Registered queries over the supplied tables.

``events`` holds sample series (one for each event type) and label and detection times;
``embeddings`` holds spectrogram frames (one file for each label). Rows that hold a null
where a query computes take no part (see the operators); tables without rows give no
rows, or one row of zeros where a query counts. Features and distances are read several
times, so they are kept until the caller clears the cache.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions import signal
from wavesift.functions.order import percentiles
from wavesift.operators import audio, clusters, evaluate, features, outliers, pca, rasters, tune, windows
from wavesift.sources import npz, tables, wav
from wavesift.sources.stores import scratch

SIZE, STRIDE = 8, 4
RATE = 100
SECS_PER_FRAME = 0.008
TOLERANCE = 21_600.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark, sf_dir):
    return tables.frames_of(_table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"))


def _samples(spark, sf_dir):
    return tables.samples_of(_table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value"))


def _long(df: DataFrame, digits: int = 6) -> DataFrame:
    return features.long_form(df, "file", "start_frame").withColumn("value", F.round("value", digits))


def _pair(spark, sf_dir) -> DataFrame:
    """Mean and deviation over all values of each tumbling window."""
    built = features.full_window(_frames(spark, sf_dir), SIZE, SIZE)
    # a window has a fixed size, so this stays within a row
    mean = F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / F.size("features")
    square = lambda m: F.aggregate("features", F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size("features")
    return built.withColumn("m", mean).select("file", "start_frame", F.array("m", F.sqrt(square(F.col("m")))).alias("features")).persist()


def _mean_std(spark, sf_dir) -> DataFrame:
    return features.build(_frames(spark, sf_dir), SIZE, SIZE, "mean_std").persist()


def _scored(spark, sf_dir, metric: str = "mahalanobis") -> DataFrame:
    return outliers.distances(_pair(spark, sf_dir), metric, "features").persist()


def _times(spark, sf_dir):
    """Labels (error events) and detections (values above the 95th percentile) of all users."""
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    start = (F.col("us") / 1_000_000).alias("start_sec")
    labels = events.where("event_type = 'error'").select(F.col("event_id").alias("label_id"), F.col("user_id").alias("file"), start)
    return labels, outliers.above(events, 95.0, "value").select(F.col("user_id").alias("file"), start)


def frames_scan(spark, sf_dir):
    """Every frame with its number of bins and total."""
    total = F.aggregate("bins", F.lit(0.0), lambda s, x: s + x)
    return _frames(spark, sf_dir).select("file", "frame", F.size("bins").alias("n_bins"), F.round(total, 6).alias("total"))


def trim_series(spark, sf_dir):
    """Samples from 5 s to 15 s of every series."""
    return tables.trimmed(_samples(spark, sf_dir), RATE, 5.0, 15.0)


def band_slice(spark, sf_dir):
    """Bins 9 to 40 of every frame."""
    return tables.band(_frames(spark, sf_dir), 9, 40).select("file", "frame", F.posexplode("bins").alias("bin", "value"))


def window_starts(spark, sf_dir):
    """Starts of all complete sliding windows, in frames and seconds."""
    got = windows.starts(_frames(spark, sf_dir).select("file", "frame"), SIZE, STRIDE)
    return got.withColumn("start_sec", windows.seconds(F.col("start_frame"), SECS_PER_FRAME))


def windows_per_file(spark, sf_dir):
    """Number of complete tumbling windows of every file."""
    return windows.starts(_frames(spark, sf_dir).select("file", "frame"), SIZE, SIZE).groupBy("file").agg(F.count("*").alias("n_windows"))


def point_window(spark, sf_dir):
    """One window of one file by its start in seconds."""
    got = windows.at(_frames(spark, sf_dir), 3, 0.1, SIZE, SECS_PER_FRAME)
    return got.select("file", "frame", F.posexplode("bins").alias("bin", "value"))


def tumbling_mean_std(spark, sf_dir):
    return _long(features.build(_frames(spark, sf_dir), SIZE, SIZE, "mean_std"))


def aci_freq(spark, sf_dir):
    return _long(features.build(_frames(spark, sf_dir), SIZE, STRIDE, "ACI"), 5)


def aci_time(spark, sf_dir):
    return _long(features.build(_frames(spark, sf_dir), SIZE, STRIDE, "ACI_time"), 5)


def aci_both(spark, sf_dir):
    return _long(features.build(_frames(spark, sf_dir), SIZE, STRIDE, "ACI_both"), 5)


def full_window(spark, sf_dir):
    return _long(features.build(_frames(spark, sf_dir), SIZE, SIZE, "full_window"))


def zscore(spark, sf_dir):
    """Standardised mean and deviation features of tumbling windows."""
    built = _mean_std(spark, sf_dir)
    return _long(pca.scaled(built, pca.fit_scaler(built)), 5)


def euclidean_outliers(spark, sf_dir):
    """Windows beyond the 95th percentile of distance on standardised pairs."""
    built = _pair(spark, sf_dir)
    z = pca.scaled(built, pca.fit_scaler(built))
    return outliers.above(outliers.distances(z, "euclidean", "features").persist()).select("file", "start_frame", F.round("distance", 5).alias("distance"))


def mahalanobis_outliers(spark, sf_dir):
    """Windows beyond the 95th percentile of Mahalanobis distance."""
    return outliers.above(_scored(spark, sf_dir)).select("file", "start_frame", F.round("distance", 5).alias("distance"))


def pca_evr_2d(spark, sf_dir):
    """Explained shares of both components of the pair."""
    got = pca.fit(_pair(spark, sf_dir), 2).explained
    rows = [tuple(round(float(x), 6) for x in [*got, 0.0][:2])] if len(got) else []
    return spark.createDataFrame(rows, "evr1 double, evr2 double")


def pca_scores(spark, sf_dir):
    """Scores on 10 components of the mean and deviation features."""
    built = _mean_std(spark, sf_dir)
    got = pca.transform(built, pca.fit(built, 10))
    return got.select("file", "start_frame", F.posexplode("scores").alias("component", "score"))


def distance_stats(spark, sf_dir):
    s = outliers.summary(_scored(spark, sf_dir))
    return s.select("n", *[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max")])


def outliers_per_file(spark, sf_dir):
    return outliers.per_file(outliers.above(_scored(spark, sf_dir), 80.0))


def outlier_table(spark, sf_dir):
    """The table of outliers with the place of each among all windows."""
    got = outliers.table(_scored(spark, sf_dir), SECS_PER_FRAME)
    return got.withColumn("distance", F.round("distance", 5))


def stft_db(spark, sf_dir):
    """Power of 16-sample frames in dB."""
    got = signal.stft_power(_samples(spark, sf_dir), 16, 8)
    return got.select("file", "frame", F.posexplode("power").alias("k", "p")).select("file", "frame", "k", F.round(signal.decibels(F.col("p")), 4).alias("db"))


def mel_db(spark, sf_dir):
    """The same through four mel filters."""
    got = signal.mel_power(signal.stft_power(_samples(spark, sf_dir), 16, 8), signal.mel_weights(9, 4, RATE))
    return got.select("file", "frame", F.posexplode("power").alias("mel", "p")).select("file", "frame", "mel", F.round(signal.decibels(F.col("p")), 4).alias("db"))


def wave_stats(spark, sf_dir):
    """Duration, peak, mean magnitude, RMS and zero crossings of every series around 100."""
    centred = _samples(spark, sf_dir).withColumn("amplitude", F.col("amplitude") - 100)
    got = audio.stats(centred, RATE)
    return got.select("file", *[F.round(c, 5).alias(c) for c in ("duration", "peak_abs", "mean_abs", "rms", "zcr")])


def resize_fixed(spark, sf_dir):
    """Frames thinned to 24 bins."""
    got = features.resized(_frames(spark, sf_dir), "bins", 24)
    return got.select("file", "frame", F.posexplode("bins").alias("bin", "value"))


def whole_file_mean_std(spark, sf_dir):
    got = features.long_form(features.by_file(_frames(spark, sf_dir)), "file")
    return got.withColumn("value", F.round("value", 6))


def match_semi(spark, sf_dir):
    return evaluate.matched(*_times(spark, sf_dir), TOLERANCE).select("label_id", "file", "start_sec")


def match_anti(spark, sf_dir):
    return evaluate.missed(*_times(spark, sf_dir), TOLERANCE).select("label_id", "file", "start_sec")


def match_list(spark, sf_dir):
    """Every label with the number, first and last of the detections near it."""
    got = evaluate.matches(*_times(spark, sf_dir), TOLERANCE)
    return got.select("label_id", "file", F.size("detected").cast("long").alias("n"), F.array_min("detected").alias("first_sec"), F.array_max("detected").alias("last_sec"))


def prf1(spark, sf_dir):
    got = evaluate.score(*_times(spark, sf_dir), TOLERANCE)
    shares = [F.round(c, 6).alias(c) for c in ("recall", "precision", "precision_detections", "f1")]
    return got.select("n_labels", "n_matched", "n_detections", *shares)


GRID = {"n_components": [1, 2], "percentile": [80.0, 90.0, 95.0], "metric": ["euclidean", "mahalanobis"]}


def grid_trials(spark, sf_dir):
    """All combinations of components, percentile and distance, scored against loud frames as labels, in one plan."""
    built = _pair(spark, sf_dir)
    scores = pca.transform(built, pca.fit(built, 2)).select("file", "start_frame", "scores").persist()
    trials = [t | {"source": "pair"} for t in tune.combinations(GRID)]
    found = tune.outliers({"pair": scores}, trials).withColumn("start_sec", windows.seconds(F.col("start_frame"), SECS_PER_FRAME))
    loud = _frames(spark, sf_dir).where(F.get("bins", F.lit(1)) > 1.5)
    labels = tune.of_each(loud.select("file", windows.seconds(F.col("frame"), SECS_PER_FRAME).alias("start_sec")), [t["run_num"] for t in trials])
    got = evaluate.score(labels, found.select("run_num", "file", "start_sec"), 0.02, tune.grid(spark, GRID))
    shares = [F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")]
    return got.select("run_num", *GRID, F.col("n_detections").alias("n_outliers"), "n_matched", F.col("n_labels").alias("n_validation"), *shares)


def best_trial(spark, sf_dir):
    """The tolerance of three with the best F1; all are scored in one plan."""
    labels, found = _times(spark, sf_dir)
    trials = tune.grid(spark, {"tolerance": [3_600.0, 10_800.0, 21_600.0]})
    each = F.explode(F.array(*[F.struct(F.lit(r["run_num"]).alias("run_num"), F.lit(r["tolerance"]).alias("tolerance")) for r in trials.collect()])).alias("t")
    labels, found = (x.select("*", each).select("file", "start_sec", "t.run_num", "t.tolerance") for x in (labels, found))
    got = tune.best(evaluate.score(labels, found, F.col("tolerance"), trials))
    return got.select("run_num", "tolerance", "n_matched", F.round("f1", 6).alias("f1"))


def clip_slice(spark, sf_dir):
    """Clips of 2.5 s at three times of every series, 5 s skipped; the last reach the end."""
    samples = _samples(spark, sf_dir)
    files = samples.select("file").distinct()
    wanted = files.withColumn("start_sec", F.explode(F.array(F.lit(0.0), F.lit(1.5), F.lit(3.7))))
    got = audio.clips(samples, wanted, RATE, 2.5)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    return got.select("file", "start_sec", "first", F.size("samples").cast("long").alias("n"), F.round(total, 4).alias("total"))


def missing_audio(spark, sf_dir):
    """Outliers of files without a frame from 50 on (a left anti join)."""
    found = outliers.above(_scored(spark, sf_dir), 80.0).select("file", "start_frame")
    held = _frames(spark, sf_dir).where("frame >= 50").select("file")
    return audio.without_audio(found, held)


def kmeans(spark, sf_dir):
    """Three clusters of the outliers on five components."""
    return clusters.kmeans(_grouped(spark, sf_dir), 3, 5)[0].select("file", "start_frame", "cluster")


def kmeans_sweep(spark, sf_dir):
    """Sizes of the clusters of the same outliers for 2 to 4 clusters, and how many have a label near."""
    found = _grouped(spark, sf_dir).withColumn("start_sec", windows.seconds(F.col("start_frame"), SECS_PER_FRAME))
    labels = found.where("start_frame % 16 = 0").select("file", "start_sec")
    return clusters.sweep(found, (2, 3, 4), 5, labels=labels, tolerance=SECS_PER_FRAME)


def _grouped(spark, sf_dir) -> DataFrame:
    """Outliers on five components of the mean and deviation features."""
    built = _mean_std(spark, sf_dir)
    got = pca.transform(built, pca.fit(built, 5))
    return outliers.above(outliers.distances(got).persist(), 80.0).persist()


def pca_energy(spark, sf_dir):
    """Sum of squared scores of every window on all components there are."""
    built = _mean_std(spark, sf_dir)
    got = pca.transform(built, pca.fit(built, 2 * 64))
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x * x)
    return got.select("file", "start_frame", F.round(total, 4).alias("energy"))


def outlier_csv(spark, sf_dir):
    """The table of outliers with its components (their size alone, as signs are free) as it is written."""
    built = _pair(spark, sf_dir)
    scored = outliers.distances(pca.transform(built, pca.fit(built, 2)).drop("features").persist()).persist()
    got = outliers.as_written(outliers.table(scored, SECS_PER_FRAME))
    sizes = {c: F.round(F.abs(c), 5) for c in ("Distance", "PC1", "PC2")}
    return got.withColumns(sizes).withColumnsRenamed({"Index": "index", "File": "file", "Start Frame": "start_frame", "Start Time (s)": "start_sec", "Distance": "distance", "PC1": "pc1", "PC2": "pc2"})


def outlier_windows(spark, sf_dir):
    """Every frame of every outlier's window, with its total."""
    found = outliers.above(_scored(spark, sf_dir)).select("file", "start_frame")
    total = F.aggregate("bins", F.lit(0.0), lambda s, x: s + x)
    return outliers.windows_of(found, _frames(spark, sf_dir), SIZE).select("file", "start_frame", "frame", F.round(total, 6).alias("total"))


def wav_samples(spark, sf_dir):
    """Every series longer than a second written as a WAV file (16 bits, or floats in steps of 16 bits beyond full scale), read again by ranges without its first second."""
    series = _samples(spark, sf_dir).where("file is not null and n is not null and amplitude is not null")
    # a file is one object, so its samples come together
    row = F.sort_array(F.collect_list(F.struct("n", (F.col("amplitude") / 512).cast("float").alias("x"))))
    files = series.groupBy("file").agg(F.transform(row, lambda r: r["x"]).alias("samples"))
    # a recording of which nothing is left is read as one zero, which is no sample of the series
    files = files.where(F.size("samples") > RATE)
    folder = scratch(spark, "wav-samples")
    wav.write(files.select(F.concat("file", F.lit(".wav")).alias("file"), F.lit(RATE).alias("sr"), "samples"), folder)
    got = wav.read(spark, folder, 1.0, None, size=300).where("error is null")
    name = F.substring_index("file", ".wav", 1).alias("file")
    return got.select(name, F.posexplode("samples").alias("i", "amplitude"), "first").select("file", (F.col("first") + F.col("i")).alias("n"), F.col("amplitude").cast("double").alias("amplitude"))


def npz_frames(spark, sf_dir):
    """Every spectrogram as an archive, turned half of the time, and read again."""
    frames = _frames(spark, sf_dir).where("file is not null and bins is not null")

    def encoded(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.stack(pdf.sort_values("frame")["bins"].to_numpy()).T.astype(np.float32)
        out, file = io.BytesIO(), int(pdf["file"].iloc[0])
        np.savez(out, feature=s[None] if file % 2 else s.T, sr=64_000)
        return pd.DataFrame({"path": [str(file)], "content": [out.getvalue()]})

    got = npz.decoded(frames.groupBy("file").applyInPandas(encoded, "path string, content binary"), 64).where("error is null")
    total = F.aggregate("bins", F.lit(0.0), lambda s, x: s + x)
    return got.select("file", "frame", F.size("bins").alias("n_bins"), F.round(total, 6).alias("total"))


def score_pixels(spark, sf_dir):
    """Windows and outliers in each pixel of a picture of 32 by 24 of the pairs."""
    scored = _scored(spark, sf_dir)
    found = outliers.above(scored, 80.0).select("file", "start_frame", F.lit(1).alias("hit"))
    x, y = F.get("features", F.lit(0)), F.get("features", F.lit(1))
    box = rasters.bounds(scored, x, y) or (0.0, 0.0, 0.0, 0.0)
    seen = rasters.pixels(scored.join(found, ["file", "start_frame"], "left"), x, y, box, 32, 24)
    return seen.groupBy("px", "py").agg(F.count("*").alias("n"), F.count("hit").alias("n_outliers"))


def window_tiles(spark, sf_dir):
    """Greatest values of every sliding window by 4 rows and 4 columns."""
    got = rasters.tiles(_frames(spark, sf_dir), SIZE, STRIDE, 4, 4)
    return got.select("file", "start_frame", F.posexplode("tile").alias("cell", "value")).withColumn("value", F.round("value", 6))


def sliding_mean_std(spark, sf_dir):
    """Mean and deviation of windows that move on by one frame, from panes."""
    return _long(features.build(_frames(spark, sf_dir), SIZE, 1, "mean_std"))


def value_percentiles(spark, sf_dir):
    """Five exact percentiles of the values of every event type, from one set of counts."""
    percents = [1.0, 25.0, 50.0, 95.0, 99.9]
    got = percentiles(_table(spark, sf_dir, "events").where("event_type is not null"), "value", percents, F.col("event_type"))
    return spark.createDataFrame([(k, p, round(v, 6)) for k, values in got.items() for p, v in zip(percents, values)], "event_type string, percent double, value double")


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    frames_scan, trim_series, band_slice, window_starts, windows_per_file, point_window, tumbling_mean_std,
    aci_freq, aci_time, aci_both, full_window, zscore, euclidean_outliers, mahalanobis_outliers, pca_evr_2d,
    pca_scores, distance_stats, outliers_per_file, outlier_table, stft_db, mel_db, wave_stats, resize_fixed,
    whole_file_mean_std, match_semi, match_anti, match_list, prf1, grid_trials, best_trial, clip_slice,
    missing_audio, kmeans, kmeans_sweep, pca_energy, outlier_csv, outlier_windows, wav_samples, npz_frames,
    score_pixels, window_tiles, sliding_mean_std, value_percentiles,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}
