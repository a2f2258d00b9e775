"""Toxicity by maximum-scoring segments of token log-odds.

A token is a run of letters (ASCII letters in lower case, and all bytes of longer
characters). Its score is the log-odds of its rate in toxic against clean texts
(repeats within a document add ever less) under Dirichlet priors: the prior of a word comes from the word's leading
characters, the prior of those from the whole vocabulary, so that an unseen form of
a known stem has the stem's score. A small drift is subtracted, hence the expected
score of clean text is negative and the segment theory of Karlin and Altschul holds.

One linear scan finds all maximal-scoring segments of a document. Segments whose
expected number in clean text of the same length, ``K n exp(-lambda S)``, is below
``SIGNIFICANT`` are toxic passages. The document's statistic is the larger of two: the
extreme-value normalised sum of its significant segments (of the best one if there are
none), and the surprise of its r-th best segment for the r that surprises most, as the
number of segments of a score or more is a Poisson variable in clean text. So many
moderate passages tell as much as one strong one; passages that begin with the same word
count once there. lambda and K come from the tail of all segments of clean texts. A
logistic curve fitted on rows that gave no counts turns the statistic into a probability.

Nulls: a null text is an empty one; empty texts get the score of a text without any
segment. Labels with a null id or a null mark are ignored, repeated labels of an id
count as toxic if one is. A null doc_id is never held out and never trained on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm.rows import with_columns
from wavesift.llm.shared import dropped
from wavesift.llm.textops import byte_codes, slices, span_hash, utf8
from wavesift.llm.workers import mapped

#: Labelled rows used for fitting at most: those with the least hash of the id.
MAX_LABELLED = 16_000
STEM = 4
#: Pseudo-mentions of the Dirichlet priors of a word and of a stem.
PRIOR_WORD, PRIOR_STEM = 5.0, 5.0
#: A score is the log-odds' confidence bound nearer to zero, so many standard deviations inside.
DEVIATIONS = 1.5
DRIFT = 0.25
SIGNIFICANT = 0.05
#: Bins of a unit of score in the tail's histogram, and the last bin.
BINS, MAX_BIN = 20, 10_000
THRESHOLD = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass(frozen=True)
class ToxicityModel:
    word_keys: np.ndarray
    word_scores: np.ndarray
    stem_keys: np.ndarray
    stem_scores: np.ndarray
    unseen: float
    lam: float = 1.0
    log_k: float = 0.0
    #: Least score that the fitted tail describes.
    floor: float = 0.0
    slope: float = 1.0
    offset: float = 0.0


def _fold(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    if len(out) > 1:  # capital letters of the Latin-1 block
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[wide] += 32
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Document, word hash and stem hash of every token, and the first token of each document."""
    n = len(data)
    letter = _LETTER[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~letter[:-1]
    after[:-1] = ~letter[1:]
    inner = offsets[1:-1]
    before[inner[inner < n]] = True
    after[inner[inner > 0] - 1] = True
    start = np.flatnonzero(letter & before)
    end = np.flatnonzero(letter & after) + 1
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    nth = np.searchsorted(lead, start)
    cut = np.append(lead, np.full(STEM, n))[np.minimum(nth + STEM, len(lead))]
    codes = byte_codes(_fold(data))
    word = span_hash(codes, start, end)
    stem = span_hash(codes, start, np.minimum(cut, end), 1)
    return word, stem, np.searchsorted(start, offsets)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), np.nan, np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(np.nan))


def _token_scores(model: ToxicityModel, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
    score = _look_up(model.word_keys, model.word_scores, word)
    missing = np.isnan(score)
    by_stem = _look_up(model.stem_keys, model.stem_scores, stem[missing])
    score[missing] = np.where(np.isnan(by_stem), np.float32(model.unseen), by_stem)
    return score.astype(np.float64)


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, sum) in one scan.

    Kept candidates have rising left totals; a new positive item is joined to the
    nearest candidate that starts lower, unless that one already ends as high.
    """
    held: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, left = i, total
        total += s
        right = total
        j = len(held) - 1
        while j >= 0:
            if held[j][2] >= left:
                j -= 1
            elif held[j][3] >= right:
                break
            else:
                start, left = held[j][0], held[j][2]
                del held[j:]
                j = len(held) - 1
        held.append((start, i + 1, left, right))
    return [(a, b, r - q) for a, b, q, r in held]


def _passages(model: ToxicityModel, part: pa.RecordBatch, column: str):
    """Of each document: tokens, best segment sum, sum and number of significant segments, surprise of all, span of the best one; sums of all segments."""
    data, offsets = utf8(part.column(column))
    word, stem, first = _tokens(data, offsets)
    score = _token_scores(model, word, stem)
    docs = len(offsets) - 1
    tokens = np.diff(first)
    best, summed, count = np.zeros(docs), np.zeros(docs), np.zeros(docs, np.int64)
    surprise, every = np.zeros(docs), []
    span = np.zeros((docs, 2), np.int64)
    hits = np.flatnonzero(score > 0)
    running = np.concatenate([[0.0], np.cumsum(score)])
    where = np.searchsorted(hits, first)
    for d in np.flatnonzero(np.diff(where)):
        h = hits[where[d] : where[d + 1]]
        steps = np.empty(2 * len(h) - 1)
        steps[0::2] = score[h]
        steps[1::2] = running[h[1:]] - running[h[:-1] + 1]
        least = (model.log_k + np.log(tokens[d]) - np.log(SIGNIFICANT)) / model.lam
        segments = maximal_segments(steps.tolist())
        begins = word[h[[a // 2 for a, _, _ in segments]]]
        sums = np.array([s for _, _, s in segments])
        every.append(sums)
        order = np.argsort(-sums, kind="stable")
        _, one = np.unique(begins[order], return_index=True)
        ranked = sums[order][np.sort(one)]
        surprise[d] = rank_surprise(np.exp(model.log_k + np.log(tokens[d]) - model.lam * ranked[ranked >= model.floor]))
        for a, b, s in segments:
            if s > best[d]:
                best[d] = s
                span[d] = h[a // 2] - first[d], h[(b - 1) // 2] + 1 - first[d]
            if s >= least:
                summed[d] += s
                count[d] += 1
    return tokens, best, summed, count, surprise, span, np.concatenate([np.empty(0), *every])


def rank_surprise(expected: np.ndarray) -> float:
    """Largest -ln P(N >= r) over r, N Poisson with the expected number for the r-th best score.

    The tail is bounded by its first term over a geometric series; 0 where r or more are expected.
    """
    r = np.arange(1, len(expected) + 1)
    rare = expected < r
    if not rare.any():
        return 0.0
    e, log_factorial = np.maximum(expected[rare], 1e-300), np.cumsum(np.log(r))[rare]
    r = r[rare]
    return float(max(0.0, (e - r * np.log(e) + log_factorial + np.log1p(-e / (r + 1))).max()))


def _statistic(model: ToxicityModel, tokens, best, summed, count, surprise):
    """lambda S - ln(K n) for each significant segment, summed, or the surprise of all if that is more."""
    size = np.log(np.maximum(tokens, 1)) + model.log_k
    x = np.where(count > 0, model.lam * summed - count * size, model.lam * best - size)
    x = np.where(surprise > 0, np.maximum(x, surprise), x)
    return np.where(best > 0, x, -8.0).clip(-8.0, 40.0)


def _in_fit():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows outside the held-out quarter.

    Three quarters of the rows give token counts, the rest calibrate. Only tables
    bounded by ``max_rows`` reach the driver.
    """
    spark = docs.sparkSession
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & _in_fit())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .select(F.col("doc_id").alias("mark_id"), "toxic", (F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % 4 == 0).alias("calibrates"))
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("mark_id")).select("text", "toxic", "calibrates")

    def counts(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                word, stem, first = _tokens(data, offsets)
                toxic = np.repeat(part.column("toxic").to_numpy(zero_copy_only=False) > 0, np.diff(first))
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for h, kind in ((word, 0), (stem, 1)):
                    order = np.lexsort((doc, h))
                    once = np.ones(len(h), bool)
                    once[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                    # the r-th mention in a document adds ever less: 1, 2, 4, 8 ... mentions count 1, 2, 3, 4 ...
                    times = np.floor(np.log2(np.diff(np.append(np.flatnonzero(once), len(h))))).astype(np.int64) + 1
                    keys, at = np.unique(h[order][once], return_inverse=True)
                    bad = np.bincount(at, toxic[order][once] * times, len(keys)).astype(np.int64)
                    both = np.bincount(at, times, len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(bad), pa.array(both - bad), pa.array(stem_of(word, stem, keys, kind))],
                        names=["kind", "key", "bad", "good", "stem"],
                    )

    def stem_of(word, stem, keys, kind):
        if kind:
            return keys.view(np.int64)
        order = np.argsort(word, kind="stable")
        return stem[order][np.searchsorted(word[order], keys)].view(np.int64)

    table = (
        mapped(rows.where(~F.col("calibrates")), counts, "kind int, key long, bad long, good long, stem long")
        .groupBy("kind", "key")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.min("stem").alias("stem"))
    )
    total = table.where("kind = 0").agg(F.sum("bad"), F.sum("good")).first()
    bad_all, good_all = float(total[0] or 0), float(total[1] or 0)
    # a word mentioned once says no more than its stem
    kept = table.where("bad + good > 1").toArrow()
    kind, key, stem = (kept.column(c).to_numpy() for c in ("kind", "key", "stem"))
    bad, good = (kept.column(c).to_numpy().astype(np.float64) for c in ("bad", "good"))
    model = _log_odds(kind, key.view(np.uint64), stem.view(np.uint64), bad, good, bad_all, good_all)

    shared = spark.sparkContext.broadcast(model)

    def segments(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, *_, sums = _passages(shared.value, part, "text")
                bins, n = np.unique(np.minimum(sums * BINS, MAX_BIN).astype(np.int64), return_counts=True)
                bins, n = np.append(bins, [-1, -2]), np.append(n, [tokens.sum(), part.num_rows])
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], names=["bin", "n"])

    # bounded: MAX_BIN rows at most
    clean = rows.where("calibrates and toxic = 0")
    seen = mapped(clean, segments, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    model = _extreme_values(model, {r["bin"]: r["n"] for r in seen})
    # the statistic of a calibration row needs its significant segments
    shared2 = spark.sparkContext.broadcast(model)

    def statistics(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, best, summed, count, surprise, _, _ = _passages(shared2.value, part, "text")
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(_statistic(shared2.value, tokens, best, summed, count, surprise))], names=["toxic", "x"])

    seen = mapped(rows.where("calibrates"), statistics, "toxic int, x double").toArrow()
    dropped(shared, shared2)
    slope, offset = _logistic(seen.column("x").to_numpy(), seen.column("toxic").to_numpy().astype(np.float64))
    return replace(model, slope=slope, offset=offset)


def _log_odds(kind, key, stem, bad, good, bad_all, good_all) -> ToxicityModel:
    """Scores from the damped mentions of a word or stem in toxic and clean documents."""
    part_bad = (bad_all + 1) / (bad_all + good_all + 2)

    def posterior(b, g, mass, odds):
        """Log-odds of the rates with a prior of ``mass`` mentions at these odds."""
        pb = part_bad * odds / (part_bad * odds + 1 - part_bad)
        bad, good = b + mass * pb, g + mass * (1 - pb)
        odds = np.log(bad / part_bad) - np.log(good / (1 - part_bad))
        return np.sign(odds) * np.maximum(np.abs(odds) - DEVIATIONS * np.sqrt(1 / bad + 1 / good), 0)

    is_stem = kind == 1
    order = np.argsort(key[is_stem])
    stem_keys = key[is_stem][order]
    stem_scores = posterior(bad[is_stem][order], good[is_stem][order], PRIOR_STEM, 1.0)
    order = np.argsort(key[~is_stem])
    word_keys = key[~is_stem][order]
    base = np.nan_to_num(_look_up(stem_keys, stem_scores, stem[~is_stem][order]).astype(np.float64))
    word_scores = posterior(bad[~is_stem][order], good[~is_stem][order], PRIOR_WORD, np.exp(base))
    clip = lambda x: (x.clip(-3.0, 8.0) - DRIFT).astype(np.float32)
    return ToxicityModel(word_keys, clip(word_scores), stem_keys, clip(stem_scores), -DRIFT)


def _extreme_values(model: ToxicityModel, seen: dict[int, int]) -> ToxicityModel:
    """lambda and ln K of clean texts: K exp(-lambda S) segments a token with a score of S or more.

    ``seen`` counts segments by score, tokens as -1 and texts as -2. The tail starts
    where a text has one segment in two on average.
    """
    tokens, texts = seen.get(-1, 0), seen.get(-2, 0)
    bins = sorted((b for b in seen if b >= 0), reverse=True)
    above, total = 0, 0.0
    for b in bins:
        above, total = above + seen[b], total + seen[b] * (b + 0.5) / BINS
        if above >= texts / 2:
            break
    if above < 20:
        return model
    floor = b / BINS
    excess = total / above - floor
    lam = float(np.clip(1 / max(excess, 1e-3), 0.2, 4.0))
    return replace(model, lam=lam, log_k=float(np.log(above / tokens) + lam * floor), floor=floor)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a weak prior on the slope."""
    if not len(x) or y.min() == y.max():
        return 1.0, -3.0
    share = y.mean()
    theta = np.array([0.0, np.log(share / (1 - share))])

    def loss(t):
        z = t[0] * x + t[1]
        return (np.logaddexp(0, z) - y * z).sum() + 0.05 * t[0] ** 2

    for _ in range(50):
        p = 1 / (1 + np.exp(-(theta[0] * x + theta[1])))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - 0.1 * theta[0], (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        # halve a step that overshoots
        while loss(theta + step) > loss(theta) and np.abs(step).max() > 1e-8:
            step = step / 2
        theta = theta + step
        if np.abs(step).max() <= 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


FIELDS = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("n_tokens", T.LongType()), ("n_passages", T.LongType()), ("passage_start", T.LongType()), ("passage_end", T.LongType())]


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score, predicted and the best passage (token positions) to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def compute(part):
            tokens, best, summed, count, surprise, span, _ = _passages(model, part, text)
            x = model.slope * _statistic(model, tokens, best, summed, count, surprise) + model.offset
            p = 1 / (1 + np.exp(-x))
            return [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(tokens), pa.array(count), pa.array(span[:, 0]), pa.array(span[:, 1])]

        return compute

    return with_columns(docs, text, FIELDS, make, keep)
