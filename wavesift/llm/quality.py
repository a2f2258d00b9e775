"""Quality rules: a linear-chain CRF labels lines as content or boilerplate.

Each line with a word is one position of the chain. Its features are shares of
symbols, capitals, bars, exclamation marks and digits, word lengths, repetition within
the line and the text, and line form. Viterbi decoding gives each line its label; a
document stays if its content lines hold at least ``CONTENT_SHARE`` of its words and the
base rules (word count, repeated 8-word windows) do not fail it.

The chain is fitted by maximum likelihood on lines of at most ``MAX_LABELLED`` labelled
documents, where every line carries the mark of its document. Marks never change within
such a document, so the chain would learn that they can't: lines of each rejected document,
from one to all, are also put before, behind or into an accepted one, and these chains
are learnt from as well.

Null text: no words, so the base rules fail it. Repeated rows are judged alike. Labels
with a null id or mark are ignored; of repeated labels the least mark counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm.rows import with_columns
from wavesift.llm.textops import byte_codes, covered, in_doc, mix, run_hash, slices, span_hash, utf8, word_hash, words
from wavesift.llm.workers import mapped

#: Labelled documents used for fitting at most: those with the least hash of the id.
MAX_LABELLED = 2_000
CONTENT_SHARE = 0.5
WINDOW = 8
MIN_WORDS = 20
N_FEATURES = 14
L2 = 1.0
STEPS = 80
#: Place of the feature that tells the number of lines.
LINES = 13

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass(frozen=True)
class LineModel:
    """weights: of content against boilerplate; step: log-potential from label to label."""

    weights: np.ndarray
    step: np.ndarray


def _repeated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class _Facts:
    """Word and line statistics of the documents of one slice."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        docs = len(offsets) - 1
        w = words(data, offsets)
        h = word_hash(w)
        n = len(h)
        self.n_words = np.diff(w.first)
        lead = (data & 0xC0) != 0x80
        symbol = _KIND[data] == 1
        self.word_chars = _per(lead, offsets) - _per(lead & _space(data), offsets)
        self.n_symbols = _per(symbol, offsets)

        salt = mix(np.arange(docs, dtype=np.uint64) + np.uint64(7))
        at = in_doc(w.first, WINDOW)
        again = np.zeros(n, bool)
        if len(at):
            twice = _repeated(mix(run_hash(h, WINDOW)[at] ^ salt[w.doc[at]]))
            if twice.any():
                again = covered(n, at[twice], WINDOW)
        self.n_repeat_words = _sum(again, w.first)

        # lines
        breaks = np.flatnonzero(data == 10)
        inner = np.searchsorted(breaks, offsets)
        n_lines = np.diff(inner) + 1
        line_doc = np.repeat(np.arange(docs), n_lines)
        first_line = np.concatenate([[0], np.cumsum(n_lines)])
        start = np.empty(first_line[-1], np.int64)
        is_first = np.zeros(first_line[-1], bool)
        is_first[first_line[:-1]] = True
        start[is_first] = offsets[:-1]
        start[~is_first] = breaks + 1
        end = np.empty(first_line[-1], np.int64)
        is_last = np.zeros(first_line[-1], bool)
        is_last[first_line[1:] - 1] = True
        end[is_last] = offsets[1:]
        end[~is_last] = breaks
        first_word = np.searchsorted(w.start, start)
        last_word = np.searchsorted(w.start, end)
        real = last_word > first_word
        start, end, line_doc, first_word, last_word = (x[real] for x in (start, end, line_doc, first_word, last_word))
        key = mix(span_hash(byte_codes(data), start, end) ^ salt[line_doc])
        _, firsts = np.unique(key, return_index=True)
        dup = np.ones(len(key), bool)
        dup[firsts] = False
        self.n_dup_lines = np.bincount(line_doc, dup, docs).astype(np.int64)

        self.line_doc, self.line_words = line_doc, last_word - first_word
        adjacent = np.zeros(n, bool)
        adjacent[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
        size = np.maximum(end - start, 1)
        count = self.line_words.astype(np.float64)
        letters = np.maximum(_between(_LETTER[data], start, end), 1)
        tail = data[np.maximum(end - 1, 0)] if len(data) else np.empty(0, np.uint8)
        prior = np.bincount(line_doc, minlength=docs)[line_doc]
        self.features = np.stack(
            [
                np.ones(len(start)),
                np.minimum(_between(symbol, start, end) / count, 2),
                _between(_UPPER[data], start, end) / letters,
                np.minimum(_between(data == 33, start, end) / count, 2),
                np.minimum(_between(data == 124, start, end) / count, 1),
                _between(_DIGIT[data], start, end) / size,
                np.minimum(size / count, 20) / 10,
                np.minimum(np.log1p(count), 6) / 3,
                dup.astype(np.float64),
                _between(again, first_word, last_word) / count,
                _between(adjacent, first_word, last_word) / count,
                (tail == 46).astype(np.float64),
                (count < 4).astype(np.float64),
                1.0 / prior if len(start) else np.empty(0),
            ],
            axis=1,
        ).astype(np.float32)


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _totals(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _per(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(_totals(mask)[offsets])


_sum = _per


def _between(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = _totals(mask)
    return total[end] - total[start]


def viterbi(score: np.ndarray, doc: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best label (1 content) of each position; chains are runs of equal ``doc``.

    Chains advance together, longest first, so a step costs one array operation.
    """
    n = len(score)
    if not n:
        return np.empty(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(head, n))
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    back = np.zeros((n, 2), bool)
    best = np.zeros((len(head), 2))
    best[:, 1] = score[head]
    for t in range(1, size[0]):
        live = int(np.searchsorted(-size, -t, "left"))
        at = head[:live] + t
        zero, one = best[:live, :1] + step[0], best[:live, 1:] + step[1]
        from_one = one > zero
        back[at] = from_one
        best[:live] = np.where(from_one, one, zero)
        best[:live, 1] += score[at]
    label = np.zeros(n, np.int64)
    state = (best[:, 1] > best[:, 0]).astype(np.int64)
    last = head + size - 1
    label[last] = state
    for t in range(size[0] - 1, 0, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        at = head[:live] + t
        label[at - 1] = back[at, label[at]]
    return label


def _likelihood(model: LineModel, chains):
    """Gradient of the log-likelihood of the marks of all lines, by forward-backward."""
    g_w, g_s = np.zeros(N_FEATURES), np.zeros((2, 2))
    trans = np.exp(model.step)
    for x, mark, size in chains:  # (docs, lines, features) and (docs, lines), padded
        docs, lines, _ = x.shape
        pot = np.ones((docs, lines, 2))
        pot[:, :, 1] = np.exp(np.clip(x @ model.weights, -30, 30))
        live = np.arange(lines)[None, :] < size[:, None]
        fwd, bwd = np.empty((docs, lines, 2)), np.ones((docs, lines, 2))
        a = pot[:, 0] / pot[:, 0].sum(1, keepdims=True)
        fwd[:, 0] = a
        for t in range(1, lines):
            a = (a @ trans) * pot[:, t]
            a /= a.sum(1, keepdims=True)
            fwd[:, t] = a
        b = np.ones((docs, 2))
        for t in range(lines - 2, -1, -1):
            nxt = (b * pot[:, t + 1]) @ trans.T
            nxt /= nxt.sum(1, keepdims=True)
            b = np.where(live[:, t + 1 : t + 2], nxt, 1.0)
            bwd[:, t] = b
        post = fwd * bwd
        post /= post.sum(2, keepdims=True)
        g_w += np.einsum("dl,dlf->f", (mark - post[:, :, 1]) * live, x)
        if lines > 1:
            pair = fwd[:, :-1, :, None] * trans * (pot[:, 1:] * bwd[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            both = live[:, 1:, None, None]
            g_s -= (pair * both).sum((0, 1))
            np.add.at(g_s, (mark[:, :-1].astype(int)[live[:, 1:]], mark[:, 1:].astype(int)[live[:, 1:]]), 1)
    return g_w, g_s


def joined(features: list[np.ndarray], marks: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Lines and marks of the documents, and of lines of each rejected one before, behind or inside an accepted one."""
    lines, line_marks = list(features), [np.full(len(f), m) for f, m in zip(features, marks, strict=True)]
    good, bad = np.flatnonzero(marks == 1), np.flatnonzero(marks == 0)
    for nth, j in enumerate(bad if len(good) else []):
        i = good[nth % len(good)]
        cut = (0, len(features[i]), len(features[i]) // 2)[nth % 3]
        n = 1 + nth // 3 % len(features[j])
        x = np.concatenate([features[i][:cut], features[j][:n], features[i][cut:]])
        x[:, LINES] = 1 / len(x)
        lines.append(x)
        line_marks.append(np.concatenate([line_marks[i][:cut], line_marks[j][:n], line_marks[i][cut:]]))
    return lines, line_marks


def _train(features: list[np.ndarray], marks: list[np.ndarray]) -> LineModel:
    order = np.argsort([len(f) for f in features], kind="stable")
    chains = []
    for part in np.array_split(order, max(1, len(order) // 250)):
        size = np.array([len(features[i]) for i in part])
        x = np.zeros((len(part), max(size.max(initial=1), 1), N_FEATURES))
        mark = np.zeros(x.shape[:2])
        for row, i in enumerate(part):
            x[row, : len(features[i])] = features[i]
            mark[row, : len(features[i])] = marks[i]
        chains.append((x, mark, size))
    lines = max(1, sum(len(f) for f in features))
    theta, m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for i in range(1, STEPS + 1):
        model = LineModel(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
        g_w, g_s = _likelihood(model, chains)
        g = (np.concatenate([g_w, g_s.ravel()]) - L2 * theta) / lines
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return LineModel(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> LineModel:
    """Fit the chain on lines of at most ``max_rows`` labelled documents."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .withColumnRenamed("doc_id", "mark_id")
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("mark_id")).select("text", "quality")

    def lines(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                facts = _Facts(part.column("text"))
                cut = np.searchsorted(facts.line_doc, np.arange(part.num_rows + 1))
                for i, mark in enumerate(part.column("quality").to_pylist()):
                    x = facts.features[cut[i] : cut[i + 1]]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array([mark], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["quality", "x"])

    # in an order that doesn't depend on the partitions
    got = mapped(rows, lines, "quality int, x binary").toArrow().sort_by([("quality", "ascending"), ("x", "ascending")])
    features = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got.column("x").to_pylist()]
    marks = got.column("quality").to_numpy()
    if not len(features):
        return LineModel(np.eye(1, N_FEATURES)[0], np.zeros((2, 2)))
    return _train(*joined(features, marks))


FIELDS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("content_words", T.LongType()),
    ("kept", T.BooleanType()),
]


def judge(docs: DataFrame, model: LineModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the base statistics, the words in content lines and the verdict to every row."""

    def make():
        def compute(part):
            f = _Facts(part.column(text))
            label = viterbi(f.features.astype(np.float64) @ model.weights, f.line_doc, model.step)
            content = np.bincount(f.line_doc, f.line_words * label, part.num_rows).astype(np.int64)
            failed = (f.n_words < MIN_WORDS) | (100 * f.n_repeat_words > 30 * f.n_words)
            kept = ~failed & (content >= CONTENT_SHARE * f.n_words)
            return [pa.array(x) for x in (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, content, kept)]

        return compute

    return with_columns(docs, text, FIELDS, make, keep)
