"""The whole analysis of a tree of recordings: extraction, components, outliers, evaluation, tuning.

Each stage writes tables that the next one reads, so a stage can be left out where its
tables are there. Run ``python -m wavesift.plans.run STAGE --help``.

Recordings are named by their path below the root, with the suffix of an archive.
Those that can't be read, are too short, or have another number of bins than the first
are listed in ``errors`` and the run goes on. A run without a complete window ends with a ValueError.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping, Sequence
from dataclasses import asdict, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.config import Settings
from wavesift.functions import signal
from wavesift.functions.order import numbered, percentile
from wavesift.operators import clusters, evaluate, features, outliers, pca, rasters, reports, tune
from wavesift.sources import csvs, npz, staged, tables, wav
from wavesift.sources.stores import below

#: The grid that tuning goes through (fixed values).
GRID: Mapping[str, Sequence] = {
    "n_components": [2, 4, 8, 16, 32, 42, 52, 62],
    "n_mels": [128],
    "window_secs": [5.0],
    "threshold_percentile": [95.0],
    "distance_metric": ["mahalanobis"],
    "pca_method": ["mean_std"],
}


def _stem(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.+?)(\.[^./]*)?$", 1)


def recordings(spark: SparkSession, root: str) -> DataFrame:
    """stem (path below the root without suffix) of the recordings; their contents are not read."""
    try:
        files = wav.scan(spark, root).select("path")
    except AnalysisException as e:
        raise FileNotFoundError(f"no recordings at {root}") from e
    return files.select(_stem(below(F.col("path"), root)).alias("stem"))


def extract(spark: SparkSession, settings: Settings, audio_root: str, out: str, subset: int = 0, file: str | None = None, archives: str | None = None) -> DataFrame:
    """Write the frames of all recordings to ``frames``, one row each to ``features_index`` or ``errors``.

    With ``archives`` each spectrogram also becomes an archive below that folder, at its recording's place.
    """
    parts = wav.read(spark, audio_root, settings.start_secs, settings.end_secs, overlap=settings.n_fft, rate=settings.resample_rate, limit=subset or None, name=file)
    parts = parts.withColumn("file", F.concat(_stem(F.col("file")), F.lit(".npz")))
    rate = settings.resample_rate or settings.sample_rate
    weights = None if settings.n_mels is None else signal.mel_weights(settings.n_fft // 2 + 1, settings.n_mels, rate, settings.f_min, settings.f_max)
    made = signal.spectrogram(parts, settings.n_fft, settings.hop, weights, settings.reference, settings.window, errors=True)
    made.write.mode("overwrite").parquet(f"{out}/frames")
    frames = spark.read.parquet(f"{out}/frames")
    source = F.concat(F.lit(audio_root.rstrip("/") + "/"), _stem(F.col("file")), F.lit(".wav"))
    feature = F.lit(f"{out}/frames") if archives is None else F.concat(F.lit(archives.rstrip("/") + "/"), F.col("file"))
    if archives is not None:
        staged.save_archives(frames.where("error is null").withColumn("source_path", source), archives)
    shape = frames.where("error is null").groupBy("file").agg((F.max("frame") + 1).alias("t"), F.first(F.size("bins")).alias("f"), F.first("sr").alias("sr"))
    index = shape.select(source.alias("source_path"), feature.alias("feature_path"), "sr", F.format_string("[1, %d, %d]", "f", "t").alias("shape"))
    csvs.write(index.orderBy("source_path"), f"{out}/features_index")
    csvs.write(frames.where("error is not null").select("file", "error").distinct(), f"{out}/errors")
    return csvs.read(spark, f"{out}/features_index", csvs.INDEX)


def frames_at(spark: SparkSession, root: str, n_bins: int | None = None, file: str | None = None, archives: bool = False, key: str = "feature") -> DataFrame:
    """file, frame, bins and error: of an extraction, or of a tree of archives.

    Without ``n_bins`` the first readable recording sets the number of bins; frames with
    another one become errors.
    """
    if archives:
        got = npz.read(spark, root, n_bins, key)
        got = got.withColumn("file", below(F.col("file"), root))
    else:
        got = spark.read.parquet(f"{root}/frames").select("file", "frame", "bins", "error")
    if file is not None:
        got = got.where(F.col("file") == file)
    if n_bins is None:
        first = got.where("error is null").orderBy("file", "frame").select(F.size("bins")).first()
        n_bins = first[0] if first else 0
    other = F.when(F.col("error").isNull() & (F.size("bins") != n_bins), F.format_string("%d bins, not %d", F.size("bins"), F.lit(n_bins)))
    return got.withColumn("error", F.coalesce("error", other))


def components(spark: SparkSession, settings: Settings, frames: DataFrame, out: str) -> DataFrame:
    """Write ``features``, the fitted ``model``, and file, start_frame and ``scores`` of all windows."""
    banded = tables.band(frames.where("error is null"), settings.band_start, settings.band_end)
    built = features.build(banded, settings.window_frames, settings.stride_frames, settings.method)
    built.write.mode("overwrite").parquet(f"{out}/features")
    csvs.write(frames.where("error is not null").select("file", "error").distinct(), f"{out}/errors")
    built = spark.read.parquet(f"{out}/features")
    if built.isEmpty():
        raise ValueError(f"no complete window of {settings.window_frames} frames")
    model = pca.fit(built, settings.n_components)
    pca.save(model, spark, f"{out}/model", asdict(settings))
    pca.transform(built, model).select("file", "start_frame", "scores").write.mode("overwrite").parquet(f"{out}/scores")
    return spark.read.parquet(f"{out}/scores")


def find(spark: SparkSession, settings: Settings, pca_root: str, out: str, audio_root: str | None = None, clips: str | None = None) -> DataFrame:
    """Write ``outliers.csv``, ``outliers_report.txt``, and clips of the recordings, if asked for.

    Clips go to ``clips``, a folder that all executors mount; outliers without a recording
    are listed in ``no_audio``. Results are written also when empty.
    """
    scored = outliers.distances(spark.read.parquet(f"{pca_root}/scores"), settings.metric)
    scored.write.mode("overwrite").parquet(f"{out}/distances")
    scored = spark.read.parquet(f"{out}/distances")
    found = outliers.table(scored, settings.secs_per_frame, settings.percentile)
    found.write.mode("overwrite").parquet(f"{out}/outliers")
    found = spark.read.parquet(f"{out}/outliers")
    csvs.write(outliers.as_written(found).orderBy("File", "`Start Time (s)`"), f"{out}/outliers.csv")
    threshold = percentile(scored, "distance", settings.percentile)
    csvs.write_lines(reports.outlier_lines(scored, found, settings.metric, settings.percentile, threshold), f"{out}/outliers_report.txt")
    if audio_root is not None and clips is not None:
        wanted = found.select(_stem(F.col("file")).alias("stem"), "start_sec")
        files = recordings(spark, audio_root)
        csvs.write(wanted.join(files, "stem", "left_anti").select("stem").distinct(), f"{out}/no_audio")
        wav.save_clips(wav.cut(wanted.join(files, "stem", "left_semi"), audio_root, settings.window_secs, settings.start_secs), clips)
        csvs.write(wav.saved_clips(wanted, clips), f"{out}/clips")
    return found


def _times(df: DataFrame, file: str, start: str) -> DataFrame:
    """file (a path, with slashes only, or a bare name) and start_sec."""
    return df.select(F.translate(file, "\\", "/").alias("file"), F.col(start).cast("double").alias("start_sec"))


def _aligned(labels: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels with the full names of the files they mean, and names that mean several files.

    A label may say the path below the root, or the bare name where one file alone has it. What means several files or
    none keeps its name and so matches nothing, unless a file of the root has just that name.
    """
    names = files.select("file").distinct().select("file", F.element_at(F.split("file", "/"), -1).alias("__name"))
    bare = names.groupBy("__name").agg(F.count("*").alias("__n"), F.min("file").alias("__one"))
    known = names.select(F.col("file").alias("__path"))
    # a label's files and the names they end in, each once, so nothing multiplies
    got = labels.join(known, F.col("file") == F.col("__path"), "left").withColumn("__last", F.element_at(F.split("file", "/"), -1)).join(bare, F.col("__last") == F.col("__name"), "left")
    only_name = F.col("__path").isNull() & (F.col("file") == F.col("__last"))
    ambiguous = got.where(only_name & (F.col("__n") > 1)).groupBy("file").agg(F.first("__n").alias("n_files"))
    whole = F.when(only_name & (F.col("__n") == 1), F.col("__one")).otherwise(F.col("file"))
    return got.select(whole.alias("file"), *[c for c in labels.columns if c != "file"]), ambiguous


def compare(spark: SparkSession, outliers_csv: str, labels_csv: str, tolerance: float = 5.0, out: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Scores of a table of outliers against labels; with ``out`` also the report as text.

    ``files`` are all files of the run (default: those with an outlier); labels that name several of them are reported.
    """
    found = _times(csvs.read(spark, outliers_csv, csvs.OUTLIERS), "File", "`Start Time (s)`")
    labels, ambiguous = _aligned(_times(csvs.read(spark, labels_csv, csvs.LABELS), "file", "start_sec"), found if files is None else files)
    score = evaluate.score(labels, found, tolerance)
    if out is not None:
        csvs.write_lines(reports.score_lines(score, evaluate.matched(labels, found, tolerance), evaluate.missed(labels, found, tolerance), ambiguous), out)
    return score


def scatter(spark: SparkSession, pca_root: str, out: str) -> None:
    """``pca.png`` of all windows: coloured by file, or by time where there is one file only."""
    scores, model = spark.read.parquet(f"{pca_root}/scores"), pca.load(spark, f"{pca_root}/model")[0]
    several = len(scores.select("file").distinct().limit(2).collect()) > 1
    picture = (rasters.by_file if several else rasters.by_window)(scores, model.explained)
    staged.save_files(spark.createDataFrame([("pca.png", bytearray(picture))], "name string, content binary"), out)


def outlier_plots(spark: SparkSession, settings: Settings, pca_root: str, found_root: str, frames: DataFrame, out: str) -> None:
    """``outliers.png`` of all windows and outliers, and below ``windows`` a grid of each file's outliers, up to four in a row."""
    scores, model = spark.read.parquet(f"{pca_root}/scores"), pca.load(spark, f"{pca_root}/model")[0]
    found = spark.read.parquet(f"{found_root}/outliers")
    picture = rasters.with_outliers(scores, found, model.explained)
    staged.save_files(spark.createDataFrame([("outliers.png", bytearray(picture))], "name string, content binary"), out)
    banded = tables.band(frames.where("error is null"), settings.band_start, settings.band_end)
    made = rasters.of_outliers(found.select("file", "start_frame"), banded, settings.window_frames)
    staged.save_files(rasters.grids(made, settings.window_frames, settings.secs_per_frame, 4), f"{out}/windows")


def plots(spark: SparkSession, settings: Settings, frames: DataFrame, out: str, across: int = 2, scale: str = "dusk") -> None:
    """A grid of all windows of each file, below ``out`` at the file's place."""
    banded = tables.band(frames.where("error is null"), settings.band_start, settings.band_end)
    made = rasters.tiles(banded, settings.window_frames, settings.stride_frames)
    staged.save_files(rasters.grids(made, settings.window_frames, settings.secs_per_frame, across, scale), out)


def group(spark: SparkSession, settings: Settings, found_root: str, out: str, labels_csv: str | None = None, k: int = 3, ks: Sequence[int] = range(3, 16), dimensions: int = 10) -> DataFrame:
    """Write ``clusters`` of the outliers, their ``centres`` with inertia, and the ``sweep`` over several numbers of clusters.

    With labels the sweep counts the outliers of each cluster that have one near.
    """
    found = spark.read.parquet(f"{found_root}/outliers")
    labels = None
    if labels_csv is not None:
        labels, _ = _aligned(_times(csvs.read(spark, labels_csv, csvs.LABELS), "file", "start_sec"), found)
    centres, cost = clusters.fits(found, [k], dimensions)
    at = clusters.assigned(found, centres, dimensions) if centres else found.withColumns({"k": F.lit(k), "cluster": F.lit(0)}).limit(0)
    at.drop("scores").write.mode("overwrite").parquet(f"{out}/clusters")
    rows = [(n, i, c.tolist(), cost[n]) for n, table in centres.items() for i, c in enumerate(table)]
    spark.createDataFrame(rows, "k int, cluster int, centre array<double>, inertia double").coalesce(1).write.mode("overwrite").parquet(f"{out}/centres")
    csvs.write(clusters.sweep(found, ks, dimensions, labels=labels, tolerance=settings.tolerance).orderBy("k", "cluster"), f"{out}/sweep")
    return spark.read.parquet(f"{out}/clusters")


def run(spark: SparkSession, settings: Settings, audio_root: str, out: str, npz_root: str | None = None, skip_extraction: bool = False, skip_pca: bool = False, clips: str | None = None, subset: int = 0, pictures: str | None = None) -> DataFrame:
    """All stages; skipped ones take the tables of an earlier run, or archives at ``npz_root``.

    With ``pictures`` the scatters and the grids of outliers go below that folder.
    """
    if not skip_extraction:
        extract(spark, settings, audio_root, f"{out}/spectrograms", subset)
    archives = skip_extraction and npz_root is not None
    frames = frames_at(spark, npz_root if archives else f"{out}/spectrograms", settings.n_mels, archives=archives)
    if not skip_pca:
        components(spark, settings, frames, f"{out}/pca")
    found = find(spark, settings, f"{out}/pca", f"{out}/outliers", audio_root, clips)
    if pictures is not None:
        scatter(spark, f"{out}/pca", pictures)
        outlier_plots(spark, settings, f"{out}/pca", f"{out}/outliers", frames, pictures)
    return found


def search(spark: SparkSession, settings: Settings, audio_root: str, labels_csv: str, out: str, grid: Mapping[str, Sequence] = GRID, skip_extraction: bool = False) -> DataFrame:
    """Score every combination of the grid; write ``tuning_config.json``, ``tuning_results.csv`` and all trials' ``outliers``.

    Spectrograms are made once for each number of mel bins, and components once for each
    kind of features, with the most that any trial asks for. All trials' distances, thresholds, outliers and matches
    then come from one plan. A trial without features scores zeros, and the results say why.
    """
    told = {"audio_root": audio_root, "validation_csv": labels_csv, "tolerance": settings.tolerance, "param_grid": {k: list(v) for k, v in grid.items()}}
    spark.createDataFrame([(json.dumps(told, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/tuning_config.json")
    trials = tune.combinations(grid)
    sources: dict[str, DataFrame] = {}
    reasons: dict[str, str] = {}
    for n_mels, secs, method in dict.fromkeys((t["n_mels"], t["window_secs"], t["pca_method"]) for t in trials):
        chosen = replace(settings.with_mels(n_mels), window_secs=secs, method=method, n_components=max(grid["n_components"]))
        at, name = f"{out}/spectrograms-{n_mels}", f"{n_mels}-{secs}-{method}"
        if not skip_extraction and not any(k.startswith(f"{n_mels}-") for k in [*sources, *reasons]):
            extract(spark, chosen, audio_root, at)
        try:
            scores = components(spark, chosen, frames_at(spark, at, n_mels), f"{out}/features-{name}")
            sources[name] = numbered(scores, "file", "start_frame", F.expr(f"start_frame div {outliers.CELL}"))
        except ValueError as e:
            reasons[name] = str(e)
    for t in trials:
        t |= {"source": f"{t['n_mels']}-{t['window_secs']}-{t['pca_method']}", "metric": t["distance_metric"], "percentile": t["threshold_percentile"]}
        t |= {"output_path": f"{out}/outliers/run_num={t['run_num']}", "note": reasons.get(t["source"])}
    ran = [t for t in trials if t["source"] in sources]
    columns = [c.split()[0] for c in csvs.TRIALS.split(", ")]
    given = [c for c in columns if c in trials[0]] if trials else []
    table = spark.createDataFrame([tuple(t[c] for c in given) for t in trials], ", ".join(c for c in csvs.TRIALS.split(", ") if c.split()[0] in given)) if trials else spark.createDataFrame([], csvs.TRIALS)
    if ran:
        found = tune.outliers(sources, ran).withColumn("start_sec", F.bround(F.col("start_frame") * F.lit(settings.secs_per_frame), 3))
        # run_num is the folder, as with every partitioned table
        outliers.as_written(found, "run_num").write.mode("overwrite").partitionBy("run_num").option("header", True).csv(f"{out}/outliers")
        found = spark.read.schema(f"{csvs.OUTLIERS}, run_num long").option("header", True).csv(f"{out}/outliers")
        found = found.select("run_num", F.col("File").alias("file"), F.col("`Start Time (s)`").alias("start_sec"))
        files = None
        for scores in sources.values():
            files = scores.select("file") if files is None else files.unionByName(scores.select("file"))
        labels, _ = _aligned(_times(csvs.read(spark, labels_csv, csvs.LABELS), "file", "start_sec"), files)
        scored = evaluate.score(tune.of_each(labels, [t["run_num"] for t in ran]), found, settings.tolerance, table.select("run_num"))
        scored = scored.select("run_num", "recall", "precision", "f1", F.col("n_detections").alias("n_outliers"), "n_matched", F.col("n_labels").alias("n_validation"))
        results = table.join(scored, "run_num").select(*columns)
    else:
        results = table.select(*[F.col(c) if c in given else F.lit(0).alias(c) for c in columns])
    csvs.write(results.orderBy("run_num"), f"{out}/tuning_results.csv")
    return csvs.read(spark, f"{out}/tuning_results.csv", csvs.TRIALS)


def _options(parser: argparse.ArgumentParser) -> None:
    for f in fields(Settings):
        kind = next(k for k in (int, float, str) if k.__name__ in str(f.type))
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=kind, default=f.default, help=f"(default: {f.default})")


def main(argv: Sequence[str] | None = None) -> int:
    """Command line: one stage or all of them."""
    parser = argparse.ArgumentParser(prog="wavesift", description=__doc__.split("\n")[0])
    stages = parser.add_subparsers(dest="stage", required=True)
    needed = {
        "extract": ("audio-root", "out"), "pca": ("frames-root", "out"), "outliers": ("pca-root", "out"), "evaluate": ("outliers-csv", "labels-csv"),
        "tune": ("audio-root", "labels-csv", "out"), "plots": ("frames-root", "out"), "clusters": ("outliers-root", "out"), "all": ("audio-root", "out"),
    }
    optional = {
        "extract": ("file", "archives-out"), "pca": ("file", "feature-key", "pictures"), "outliers": ("audio-root", "clips", "frames-root", "pictures"),
        "evaluate": ("out", "pca-root"), "tune": (), "plots": ("file", "feature-key"), "clusters": ("labels-csv",), "all": ("npz-root", "clips", "pictures"),
    }
    numbers = {"extract": {"subset-len": 0}, "all": {"subset-len": 0}, "plots": {"cols": 2}, "clusters": {"k": 3, "k-min": 3, "k-max": 15, "dimensions": 10}}
    switches = {"all": ("skip-extraction", "skip-pca"), "tune": ("skip-extraction",), "pca": ("archives",), "plots": ("archives",), "outliers": ("archives",)}
    for stage, names in needed.items():
        p = stages.add_parser(stage)
        for name in names:
            p.add_argument(f"--{name}", required=True)
        for name in optional[stage]:
            p.add_argument(f"--{name}")
        for name, value in numbers.get(stage, {}).items():
            p.add_argument(f"--{name}", type=int, default=value)
        for name in switches.get(stage, ()):
            p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=False)
        if stage == "plots":
            p.add_argument("--colours", default="dusk")
        _options(p)
    a = parser.parse_args(argv)
    settings = Settings(**{f.name: getattr(a, f.name) for f in fields(Settings)})
    spark = SparkSession.builder.appName("wavesift").getOrCreate()
    frames = lambda: frames_at(spark, a.frames_root, settings.n_mels, getattr(a, "file", None), a.archives, getattr(a, "feature_key", None) or "feature")
    if a.stage == "extract":
        extract(spark, settings, a.audio_root, a.out, a.subset_len, a.file, a.archives_out)
    elif a.stage == "pca":
        components(spark, settings, frames(), a.out)
        if a.pictures is not None:
            scatter(spark, a.out, a.pictures)
    elif a.stage == "outliers":
        find(spark, settings, a.pca_root, a.out, a.audio_root, a.clips)
        if a.pictures is not None:
            if a.frames_root is None:
                parser.error("pictures of outliers need --frames-root")
            outlier_plots(spark, settings, a.pca_root, a.out, frames(), a.pictures)
    elif a.stage == "evaluate":
        files = None if a.pca_root is None else spark.read.parquet(f"{a.pca_root}/scores").select("file")
        compare(spark, a.outliers_csv, a.labels_csv, settings.tolerance, a.out, files).show(truncate=False)
    elif a.stage == "tune":
        tune.best(search(spark, settings, a.audio_root, a.labels_csv, a.out, skip_extraction=a.skip_extraction)).show(truncate=False)
    elif a.stage == "plots":
        plots(spark, settings, frames(), a.out, a.cols, a.colours)
    elif a.stage == "clusters":
        group(spark, settings, a.outliers_root, a.out, a.labels_csv, a.k, range(a.k_min, a.k_max + 1), a.dimensions)
    else:
        run(spark, settings, a.audio_root, a.out, a.npz_root, a.skip_extraction, a.skip_pca, a.clips, a.subset_len, a.pictures)
    return 0


if __name__ == "__main__":
    sys.exit(main())
