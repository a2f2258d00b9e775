"""The same queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from wavesift.functions.signal import mel_weights

_FRAMES = "frames AS (SELECT label AS file, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding::DOUBLE[] AS bins FROM embeddings)"
_CELLS = f"{_FRAMES}, cells AS (SELECT file, frame, unnest(range(64)) AS bin, unnest(bins) AS v FROM frames)"
_SAMPLES = "samples AS (SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, value AS amplitude FROM events)"


def _starts(size: int, stride: int) -> str:
    return f"starts AS (SELECT file, unnest(range(0, t - {size} + 1, {stride})) AS start_frame FROM (SELECT file, max(frame) + 1 AS t FROM frames GROUP BY file) WHERE t >= {size})"


def _windowed(size: int, stride: int) -> str:
    return f"{_CELLS}, {_starts(size, stride)}, w AS (SELECT s.file, s.start_frame, c.frame, c.bin, c.v FROM starts s JOIN cells c ON c.file = s.file AND c.frame >= s.start_frame AND c.frame < s.start_frame + {size})"


_PAIR = f"{_windowed(8, 8)}, pair AS (SELECT file, start_frame, avg(v) AS m, stddev_pop(v) AS s FROM w GROUP BY ALL)"
_ACI = "CASE WHEN sum({x}) > 0 AND NOT isnan(sum({x})) THEN sum(abs({x} - p)) / sum({x}) ELSE 0 END"
_BY_BIN = f"by_bin AS (SELECT file, start_frame, bin AS dim, {_ACI.format(x='v')} AS value FROM (SELECT *, lag(v) OVER (PARTITION BY file, start_frame, bin ORDER BY frame) AS p FROM w) GROUP BY ALL)"
_BY_FRAME = f"by_frame AS (SELECT file, start_frame, frame - start_frame AS dim, {_ACI.format(x='v')} AS value FROM (SELECT *, lag(v) OVER (PARTITION BY file, start_frame, frame ORDER BY bin) AS p FROM w) GROUP BY file, start_frame, frame)"
_DIST = f"""{_PAIR}, c AS (SELECT avg(m) AS mm, avg(s) AS ms, var_samp(m) AS v1, var_samp(s) AS v2, covar_samp(m, s) AS c FROM pair),
d AS (SELECT file, start_frame, sqrt((v2 * (m - mm) ^ 2 - 2 * c * (m - mm) * (s - ms) + v1 * (s - ms) ^ 2) / (v1 * v2 - c ^ 2)) AS distance FROM pair, c)"""
_MEAN_STD = f"""{_windowed(8, 8)}, f AS (SELECT file, start_frame, bin AS dim, avg(v) AS value FROM w GROUP BY ALL
UNION ALL SELECT file, start_frame, bin + 64, stddev_pop(v) FROM w GROUP BY ALL)"""
_STFT = f"""{_SAMPLES}, total AS (SELECT file, count(*) AS t FROM samples GROUP BY file),
spread AS (SELECT s.file, n // 8 - j AS frame, n - 8 * (n // 8 - j) AS i, amplitude * (0.5 - 0.5 * cos(2 * pi() * (n - 8 * (n // 8 - j)) / 16)) AS x, t
  FROM samples s JOIN total USING (file), (SELECT unnest([0, 1]) AS j)),
p AS (SELECT file, frame, k, sum(x * cos(2 * pi() * k * i / 16)) ^ 2 + sum(x * sin(2 * pi() * k * i / 16)) ^ 2 AS p
  FROM spread, (SELECT unnest(range(9)) AS k) WHERE frame >= 0 AND 8 * frame + 16 <= t GROUP BY ALL)"""
_DB = "round(10 * log10(greatest(p * 1e12, 1e-10)), 4) AS db"
_TIMES = """ev AS (SELECT event_id, event_type, user_id AS file, value, epoch_us(ts) / 1000000 AS start_sec FROM events),
l AS (SELECT event_id AS label_id, file, start_sec FROM ev WHERE event_type = 'error'),
d AS (SELECT file, start_sec FROM ev WHERE value > (SELECT quantile_cont(value, 0.95) FROM ev))"""


def _near(tolerance: float, a: str = "l", b: str = "d") -> str:
    return f"EXISTS (SELECT 1 FROM {b} WHERE {b}.file = {a}.file AND abs({b}.start_sec - {a}.start_sec) < {tolerance})"


def _score(tolerance: float) -> str:
    return f"""SELECT *, n_matched / n_labels AS recall, CASE WHEN n_detections > 0 THEN n_matched / n_detections ELSE 0 END AS precision, n_hits / n_detections AS precision_detections FROM
(SELECT (SELECT count(*) FROM l) AS n_labels, (SELECT count(*) FROM l WHERE {_near(tolerance)}) AS n_matched, (SELECT count(*) FROM d) AS n_detections, (SELECT count(*) FROM d WHERE {_near(tolerance, 'd', 'l')}) AS n_hits)"""


_F1 = "CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END"


def _mel() -> str:
    rows = [f"({m}, {k}, {float(x)!r})" for m, row in enumerate(mel_weights(9, 4, 100)) for k, x in enumerate(row)]
    return f"{_STFT}, bank(mel, k, weight) AS (VALUES {', '.join(rows)}), q AS (SELECT file, frame, mel, sum(p * weight::DOUBLE) AS p FROM p JOIN bank USING (k) GROUP BY ALL)"


def _grid() -> str:
    """Both components of a standardised pair have a closed form, so all trials do."""
    return f"""WITH {_PAIR}, q AS (SELECT avg(m) AS mm, avg(s) AS ms, stddev_pop(m) AS sm, stddev_pop(s) AS ss, sign(corr(m, s)) AS r FROM pair),
pcs AS (SELECT file, start_frame, ((m - mm) / sm + r * (s - ms) / ss) / sqrt(2) AS a, ((m - mm) / sm - r * (s - ms) / ss) / sqrt(2) AS b FROM pair, q),
v AS (SELECT var_samp(a) AS va, var_samp(b) AS vb FROM pcs),
dist AS (SELECT file, start_frame, k, metric, sqrt(a * a / CASE metric WHEN 'euclidean' THEN 1 ELSE va END + CASE k WHEN 1 THEN 0 ELSE b * b / CASE metric WHEN 'euclidean' THEN 1 ELSE vb END END) AS distance
  FROM pcs, v, (SELECT unnest([1, 2]) AS k), (SELECT unnest(['euclidean', 'mahalanobis']) AS metric)),
cuts AS (SELECT k, metric, quantile_cont(distance, [0.8, 0.9, 0.95]) AS cut FROM dist GROUP BY ALL),
t AS (SELECT row_number() OVER (ORDER BY k, i, metric) AS run_num, k, [80.0, 90.0, 95.0][i]::DOUBLE AS percentile, metric, cut[i] AS cut FROM cuts, (SELECT unnest([1, 2, 3]) AS i)),
d AS (SELECT run_num, file, round(start_frame * 0.008::DOUBLE, 3) AS start_sec FROM t JOIN dist USING (k, metric) WHERE distance > cut),
l AS (SELECT file, round(frame * 0.008::DOUBLE, 3) AS start_sec FROM frames WHERE bins[2] > 1.5),
n AS (SELECT run_num, (SELECT count(*) FROM d WHERE d.run_num = t.run_num) AS n_outliers, (SELECT count(*) FROM l) AS n_validation,
  (SELECT count(*) FROM l WHERE EXISTS (SELECT 1 FROM d WHERE d.run_num = t.run_num AND d.file = l.file AND abs(d.start_sec - l.start_sec) < 0.02)) AS n_matched FROM t),
s AS (SELECT *, CASE WHEN n_validation > 0 THEN n_matched / n_validation ELSE 0 END AS recall, CASE WHEN n_outliers > 0 THEN n_matched / n_outliers ELSE 0 END AS precision FROM n)
SELECT run_num, k::BIGINT AS n_components, percentile, metric, n_outliers, n_matched, n_validation, round(recall, 6) AS recall, round(precision, 6) AS precision, round({_F1}, 6) AS f1 FROM s JOIN t USING (run_num)"""


def oracle_sql() -> dict[str, str]:
    trials = " UNION ALL ".join(f"SELECT {i} AS run_num, {t} AS tolerance, * FROM ({_score(t)})" for i, t in enumerate((3600.0, 10800.0, 21600.0), 1))
    return {
        "frames_scan": f"WITH {_FRAMES} SELECT file, frame, len(bins)::INT AS n_bins, round(list_sum(bins), 6) AS total FROM frames",
        "trim_series": f"WITH {_SAMPLES} SELECT * FROM samples WHERE n >= 500 AND n < 1500",
        "band_slice": f"WITH {_CELLS} SELECT file, frame, (bin - 9)::INT AS bin, v AS value FROM cells WHERE bin >= 9 AND bin < 40",
        "window_starts": f"WITH {_FRAMES}, {_starts(8, 4)} SELECT file, start_frame, round(start_frame * 0.008::DOUBLE, 3) AS start_sec FROM starts",
        "windows_per_file": f"WITH {_FRAMES}, {_starts(8, 8)} SELECT file, count(*) AS n_windows FROM starts GROUP BY file",
        "point_window": f"WITH {_CELLS} SELECT file, frame, bin::INT AS bin, v AS value FROM cells WHERE file = 3 AND frame BETWEEN 12 AND 19",
        "tumbling_mean_std": f"WITH {_MEAN_STD} SELECT file, start_frame, dim::INT AS dim, round(value, 6) AS value FROM f",
        "aci_freq": f"WITH {_windowed(8, 4)}, {_BY_BIN} SELECT file, start_frame, dim::INT AS dim, round(value, 5) AS value FROM by_bin",
        "aci_time": f"WITH {_windowed(8, 4)}, {_BY_FRAME} SELECT file, start_frame, dim::INT AS dim, round(value, 5) AS value FROM by_frame",
        "aci_both": f"WITH {_windowed(8, 4)}, {_BY_BIN}, {_BY_FRAME} SELECT file, start_frame, dim::INT AS dim, round(value, 5) AS value FROM by_bin UNION ALL SELECT file, start_frame, (dim + 64)::INT, round(value, 5) FROM by_frame",
        "full_window": f"WITH {_windowed(8, 8)} SELECT file, start_frame, (bin * 8 + frame - start_frame)::INT AS dim, round(v, 6) AS value FROM w",
        "zscore": f"WITH {_MEAN_STD} SELECT file, start_frame, dim::INT AS dim, round((value - avg(value) OVER (PARTITION BY dim)) / stddev_pop(value) OVER (PARTITION BY dim), 5) AS value FROM f",
        "euclidean_outliers": f"WITH {_PAIR}, z AS (SELECT avg(m) AS mm, avg(s) AS ms, stddev_pop(m) AS sm, stddev_pop(s) AS ss FROM pair), d AS (SELECT file, start_frame, sqrt(((m - mm) / sm) ^ 2 + ((s - ms) / ss) ^ 2) AS distance FROM pair, z) SELECT file, start_frame, round(distance, 5) AS distance FROM d WHERE distance > (SELECT quantile_cont(distance, 0.95) FROM d)",
        "mahalanobis_outliers": f"WITH {_DIST} SELECT file, start_frame, round(distance, 5) AS distance FROM d WHERE distance > (SELECT quantile_cont(distance, 0.95) FROM d)",
        "pca_evr_2d": f"WITH {_PAIR} SELECT round((1 + abs(corr(m, s))) / 2, 6) AS evr1, round((1 - abs(corr(m, s))) / 2, 6) AS evr2 FROM pair",
        "distance_stats": f"WITH {_DIST} SELECT count(*) AS n, round(avg(distance), 5) AS mean, round(stddev_pop(distance), 5) AS std, round(min(distance), 5) AS min, round(max(distance), 5) AS max FROM d",
        "outliers_per_file": f"WITH {_DIST} SELECT file, count(*) AS n_outliers FROM d WHERE distance > (SELECT quantile_cont(distance, 0.8) FROM d) GROUP BY file",
        "outlier_table": f'WITH {_DIST}, i AS (SELECT *, row_number() OVER (ORDER BY file, start_frame) - 1 AS "index" FROM d) SELECT "index", file, start_frame, round(start_frame * 0.008::DOUBLE, 3) AS start_sec, round(distance, 5) AS distance FROM i WHERE distance > (SELECT quantile_cont(distance, 0.95) FROM d)',
        "stft_db": f"WITH {_STFT} SELECT file, frame, k::INT AS k, {_DB} FROM p",
        "mel_db": f"WITH {_mel()} SELECT file, frame, mel, {_DB} FROM q",
        "wave_stats": f"WITH {_SAMPLES}, x AS (SELECT file, n, amplitude - 100 AS a FROM samples), y AS (SELECT *, ((a < 0) <> lag(a < 0) OVER (PARTITION BY file ORDER BY n))::INT AS flip FROM x) SELECT file, round(count(*) / 100, 5) AS duration, round(max(abs(a)), 5) AS peak_abs, round(avg(abs(a)), 5) AS mean_abs, round(sqrt(avg(a * a)), 5) AS rms, round(coalesce(sum(flip), 0) / (count(*) - 1) * 100, 5) AS zcr FROM y GROUP BY file",
        "resize_fixed": f"WITH {_FRAMES} SELECT file, frame, k::INT AS bin, bins[k * 64 // 24 + 1] AS value FROM frames, (SELECT unnest(range(24)) AS k)",
        "whole_file_mean_std": f"WITH {_CELLS} SELECT file, bin::INT AS dim, round(avg(v), 6) AS value FROM cells GROUP BY ALL UNION ALL SELECT file, (bin + 64)::INT, round(stddev_samp(v), 6) FROM cells GROUP BY file, bin",
        "match_semi": f"WITH {_TIMES} SELECT * FROM l WHERE {_near(21600)}",
        "match_anti": f"WITH {_TIMES} SELECT * FROM l WHERE NOT {_near(21600)}",
        "match_list": f"WITH {_TIMES} SELECT label_id, l.file, count(d.start_sec) AS n, min(d.start_sec) AS first_sec, max(d.start_sec) AS last_sec FROM l LEFT JOIN d ON d.file = l.file AND abs(d.start_sec - l.start_sec) < 21600 GROUP BY ALL",
        "prf1": f"WITH {_TIMES} SELECT n_labels, n_matched, n_detections, round(recall, 6) AS recall, round(precision, 6) AS precision, round(precision_detections, 6) AS precision_detections, round({_F1}, 6) AS f1 FROM ({_score(21600)})",
        "grid_trials": _grid(),
        "best_trial": f"WITH {_TIMES} SELECT run_num, tolerance::DOUBLE AS tolerance, n_matched, round({_F1}, 6) AS f1 FROM ({trials}) ORDER BY {_F1} DESC, run_num LIMIT 1",
        "clip_slice": f"WITH {_SAMPLES}, c AS (SELECT unnest([0.0, 1.5, 3.7])::DOUBLE AS start_sec) SELECT file, start_sec, min(n) AS first, count(*) AS n, round(sum(amplitude), 4) AS total FROM samples, c WHERE n >= trunc((start_sec + 5) * 100)::BIGINT AND n < trunc((start_sec + 7.5::DOUBLE) * 100)::BIGINT GROUP BY file, start_sec",
        "pca_energy": f"WITH {_MEAN_STD}, z AS (SELECT file, start_frame, (value - avg(value) OVER (PARTITION BY dim)) / stddev_pop(value) OVER (PARTITION BY dim) AS z FROM f) SELECT file, start_frame, round(sum(z * z), 4) AS energy FROM z GROUP BY file, start_frame",
        "outlier_csv": f'WITH {_DIST}, i AS (SELECT *, row_number() OVER (ORDER BY file, start_frame) - 1 AS "index" FROM d JOIN pair USING (file, start_frame)), q AS (SELECT avg(m) AS mm, avg(s) AS ms, stddev_pop(m) AS sm, stddev_pop(s) AS ss, sign(corr(m, s)) AS r FROM pair) SELECT "index", file::VARCHAR AS file, start_frame, round(start_frame * 0.008::DOUBLE, 3) AS start_sec, round(distance, 5) AS distance, round(abs((m - mm) / sm + r * (s - ms) / ss) / sqrt(2), 5) AS pc1, round(abs((m - mm) / sm - r * (s - ms) / ss) / sqrt(2), 5) AS pc2 FROM i, q WHERE distance > (SELECT quantile_cont(distance, 0.95) FROM d)',
        "outlier_windows": f"WITH {_DIST} SELECT d.file, start_frame, frame, round(list_sum(bins), 6) AS total FROM d JOIN frames ON frames.file = d.file AND frame >= start_frame AND frame < start_frame + 8 WHERE distance > (SELECT quantile_cont(distance, 0.95) FROM d)",
        "wav_samples": f"WITH {_SAMPLES} SELECT file, n - 100 AS n, (trunc((amplitude / 512)::FLOAT * 32768::FLOAT) / 32768)::DOUBLE AS amplitude FROM samples WHERE n >= 100",
        "npz_frames": f"WITH {_FRAMES} SELECT file::VARCHAR AS file, frame, len(bins)::INT AS n_bins, round(list_sum(bins), 6) AS total FROM frames",
        "score_pixels": f"WITH {_DIST}, x AS (SELECT * FROM d JOIN pair USING (file, start_frame)), e AS (SELECT min(m) AS a, max(m) AS b, min(s) AS c, max(s) AS d FROM x) SELECT least(floor((m - a) / (b - a) * 32), 31)::INT AS px, least(floor((s - c) / (d - c) * 24), 23)::INT AS py, count(*) AS n, count(*) FILTER (distance > (SELECT quantile_cont(distance, 0.8) FROM x)) AS n_outliers FROM x, e GROUP BY ALL",
        "window_tiles": f"WITH {_windowed(8, 4)} SELECT file, start_frame, (bin // 16 * 4 + (frame - start_frame) // 2)::INT AS cell, round(max(v), 6) AS value FROM w GROUP BY ALL",
        "sliding_mean_std": f"WITH {_windowed(8, 1)}, f AS (SELECT file, start_frame, bin AS dim, avg(v) AS value FROM w GROUP BY ALL UNION ALL SELECT file, start_frame, bin + 64, stddev_pop(v) FROM w GROUP BY file, start_frame, bin) SELECT file, start_frame, dim::INT AS dim, round(value, 6) AS value FROM f",
        "value_percentiles": "SELECT event_type, p AS percent, round(v, 6) AS value FROM (SELECT event_type, unnest([1.0, 25.0, 50.0, 95.0, 99.9]::DOUBLE[]) AS p, unnest(quantile_cont(value, [0.01, 0.25, 0.5, 0.95, 0.999])) AS v FROM events GROUP BY event_type)",
        "missing_audio": f"WITH {_DIST} SELECT file, start_frame FROM d WHERE distance > (SELECT quantile_cont(distance, 0.8) FROM d) AND file NOT IN (SELECT file FROM frames WHERE frame >= 50)",
    }
