"""Secrets in texts: base patterns, and runs of characters that a battery of tests finds random.

One pass over the texts finds the base patterns and every run of 16 or more characters of an
encoding, with three statistics that need no model: pairs of equal symbols (chi-squared
uniformity is an affine function of them), changes between the halves of the alphabet
(runs test) and products of neighbours (serial correlation). The same pass counts which
characters follow each other in shorter runs, the ordinary text of these documents.

For the inferred encoding of a run and its length, each statistic has a mean and a variance
for random symbols and for ordinary text. A run is a candidate if the battery doesn't reject
randomness; its evidence is the logarithm of the likelihood ratio. Candidates of all documents
are counted by encoding, class of lengths and step of evidence. In each class expectation
maximisation gives the share of random ones, hence the chance of each step to be a false
discovery, and the class's steps are taken from the surest one on while their mean chance stays below
``FALSE_DISCOVERIES``. So short runs, and those of a class with few secrets, need more evidence.

Nothing of the size of the input passes through the driver: sums over pairs of 64 symbols and counts of steps.

A null or empty text has no spans. Repeated rows are scanned each, and count each in the
shares. Without ordinary text random and ordinary can't be told apart, and no run is added.
Spans are code points, end exclusive, ordered by start and then kind.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm.rows import renamed, with_columns
from wavesift.llm.shared import written
from wavesift.llm.textops import utf8
from wavesift.llm.workers import mapped

#: Patterns and least lengths of the base kinds. Letters of assign match in either case, so it reads lower-cased bytes.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

#: Characters a run of the method has at least.
RUN_LEAST = 16
FALSE_DISCOVERIES = 0.01
#: Beyond this sum of three squared normal scores a run isn't random (chance 0.001).
BATTERY = 16.27
#: Evidence is counted in steps of a quarter, from -STEPS to STEPS.
STEPS, STEP = 160, 0.25
LENGTHS = (24, 32, 48, 96)

_UPPER, _LOWER, _DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Alphabets in the order of their digits, small ones first: a run is of the first that holds all its characters.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SYMBOLS = _UPPER + _LOWER + _DIGITS + "+/-_"
_SIZE = np.array([len(a) for a in ENCODINGS.values()])

_INDEX = np.full(256, -1, np.int64)
_INDEX[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
_VALUE = np.zeros((len(ENCODINGS), 256), np.int64)
_FITS = np.zeros(256, np.int64)
for _nth, _alphabet in enumerate(ENCODINGS.values()):
    for _digit, _c in enumerate(_alphabet):
        _VALUE[_nth, ord(_c)] = _digit
        _FITS[ord(_c)] |= 1 << _nth
_IS_HEX = np.isin(np.arange(256), [ord(c) for c in ENCODINGS["hex"]])
_IS_LETTER = np.isin(np.arange(256), [ord(c) for c in string.ascii_letters])

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_STATISTICS = ["encoding", "length", "equal", "changes", "products"]
_RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ["start", "end", *_STATISTICS]]))


def _spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of a mask inside each text: first and end byte, and text."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(mask & (edge[:-1] | np.concatenate([[True], ~mask[:-1]])[: len(mask)]))
    end = np.flatnonzero(mask & (edge[1:] | np.concatenate([~mask[1:], [True]])[: len(mask)])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of many spans, one after the other."""
    total = np.concatenate([[0], np.cumsum(size)])
    return np.arange(total[-1]) + np.repeat(start - total[:-1], size)


def _split(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with signs of two encodings fall apart at hyphens and underscores."""
    sign = np.zeros(256, np.int64)
    sign[[ord("+"), ord("/")]], sign[[ord("-"), ord("_")]] = 1, 2
    if not len(start):
        return start, end, doc
    both = np.bitwise_or.reduceat(sign[data[_flat(start, end - start)]], np.concatenate([[0], np.cumsum(end - start)[:-1]])) == 3
    parts = [(start[~both], end[~both], doc[~both])]
    for lo, hi, d in zip(start[both], end[both], doc[both]):
        s, e, _ = _spans_of(sign[data[lo:hi]] != 2, np.array([0, hi - lo]))
        parts.append((s + lo, e + lo, np.full(len(s), d)))
    start, end, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(start, kind="stable")
    return start[order], end[order], doc[order]


def _statistics(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of ``_STATISTICS`` for some runs, and which of them have an encoding and a letter."""
    size = end - start
    if not len(start):
        return np.empty((0, len(_STATISTICS)), np.int64), np.empty(0, bool)
    at, first = _flat(start, size), np.concatenate([[0], np.cumsum(size)[:-1]])
    fits = np.bitwise_and.reduceat(_FITS[data[at]], first)
    good = (fits != 0) & np.logical_or.reduceat(_IS_LETTER[data[at]], first)
    encoding = np.log2(np.where(fits == 0, 1, fits & -fits)).astype(np.int64)
    run = np.repeat(np.arange(len(start)), size)
    value, alphabet = _VALUE[encoding[run], data[at]], _SIZE[encoding][run]
    times = np.bincount(run * 64 + value, minlength=64 * len(start)).reshape(-1, 64)
    equal = (times * (times - 1) // 2).sum(1)
    same_run = run[1:] == run[:-1]
    half = value * 2 >= alphabet
    changes = np.bincount(run[1:][same_run & (half[1:] != half[:-1])], minlength=len(start))
    centred = 2 * value - (alphabet - 1)
    product = np.where(same_run, centred[1:] * centred[:-1], 0)
    products = np.add.reduceat(np.append(product, 0), first)
    return np.stack([encoding, size, equal, changes, products], 1), good


def _patterns(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the base kinds that need a pattern."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(raw.lower()) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    return out + [(1, m.start(), m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LEAST]


def _span_lists(kind, start, end, doc, n: int) -> pa.Array:
    """A list of spans for each text, by start and kind."""
    order = np.lexsort((kind, start, doc))
    kinds = pa.DictionaryArray.from_arrays(pa.array(kind[order], pa.int32()), pa.array(KINDS)).cast(pa.string())
    inner = pa.StructArray.from_arrays([kinds, pa.array(start[order], pa.int64()), pa.array(end[order], pa.int64())], names=["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(n + 1)), pa.int32()), inner)


def _scan(text: str):
    """Row-aligned columns: base spans, runs with their statistics, and in one row of a slice the pairs of neighbours."""

    def make():
        def compute(part):
            data, offsets = utf8(part.column(text))
            n = part.num_rows
            raw = data.tobytes()
            found = [(kind, offsets[d] + s, offsets[d] + e, d) for d in range(n) for kind, s, e in _patterns(raw[offsets[d] : offsets[d + 1]])]
            base = np.array(found, np.int64).reshape(-1, 4)
            start, end, doc = _spans_of(_IS_HEX[data], offsets)
            long = end - start >= HEX_LEAST
            base = np.concatenate([base, np.stack([np.full(long.sum(), 2), start[long], end[long], doc[long]], 1)])

            start, end, doc = _spans_of(_INDEX[data] >= 0, offsets)
            long = end - start >= RUN_LEAST
            ordinary = _flat(start[~long], (end - start)[~long])
            follows = np.flatnonzero(np.diff(ordinary) == 1)
            pair = _INDEX[data[ordinary[follows]]] * len(_SYMBOLS) + _INDEX[data[ordinary[follows + 1]]]
            pairs = np.bincount(pair, minlength=len(_SYMBOLS) ** 2).astype(np.int64).tobytes()

            start, end, doc = _split(data, start[long], end[long], doc[long])
            long = end - start >= RUN_LEAST
            start, end, doc = start[long], end[long], doc[long]
            blocks = [_statistics(data, start[i : i + 4096], end[i : i + 4096]) for i in range(0, max(len(start), 1), 4096)]
            statistics, good = (np.concatenate(x) for x in zip(*blocks))
            start, end, doc, statistics = start[good], end[good], doc[good], statistics[good]

            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            place = lambda at, d: chars[at] - chars[offsets[d]]
            spans = _span_lists(base[:, 0], place(base[:, 1], base[:, 3]), place(base[:, 2], base[:, 3]), base[:, 3], n)
            columns = [place(start, doc), place(end, doc), *statistics.T]
            inner = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.name for f in _RUNS.elementType.fields])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), inner)
            return [spans, runs, pa.array([pairs] + [None] * (n - 1), pa.binary())]

        return compute

    return make


class Null(NamedTuple):
    """What ordinary text does in each encoding: sums of powers of shares, rate of changes, mean and variance of products."""

    squares: np.ndarray
    cubes: np.ndarray
    rate: np.ndarray
    product: np.ndarray
    spread: np.ndarray


def null_of(pairs: np.ndarray) -> Null:
    """From counts of neighbours (symbols by symbols); half a pair of each kind is added.

    In an encoding of one case, text of either case tells what ordinary letters do.
    """
    rows = []
    for alphabet in ENCODINGS.values():
        one_case = alphabet.lower() == alphabet or alphabet.upper() == alphabet
        takes = np.array([[c == x or (one_case and c.lower() == x.lower()) for x in _SYMBOLS] for c in alphabet], float)
        joint = takes @ pairs @ takes.T + 0.5
        joint /= joint.sum()
        share = (joint.sum(0) + joint.sum(1)) / 2
        value = 2 * np.arange(len(alphabet)) - (len(alphabet) - 1)
        high = value > 0
        products = np.outer(value, value)
        mean = (joint * products).sum()
        rows.append(((share**2).sum(), (share**3).sum(), joint[high[:, None] != high].sum(), mean, (joint * products.astype(float) ** 2).sum() - mean**2))
    return Null(*np.array(rows).T)


def evidence(statistics: np.ndarray, null: Null) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood ratio of random against ordinary, and the battery's sum of squared scores for random."""
    e, n, equal, changes, products = statistics.T
    n = n.astype(float)
    two, steps, size = n * (n - 1) / 2, n - 1, _SIZE[e].astype(float)
    square, cube, rate = null.squares[e], null.cubes[e], np.clip(null.rate[e], 0.01, 0.99)
    unit = (size**2 - 1) / 3
    tests = [
        (1.0, equal, two / size, two / size * (1 - 1 / size), two * square, two * (square - square**2) + n * steps * (n - 2) * np.maximum(cube - square**2, 0)),
        (0.5, changes, steps / 2, steps / 4, steps * rate, steps * rate * (1 - rate)),
        (0.5, products, 0 * n, steps * unit**2, steps * null.product[e], steps * null.spread[e]),
    ]
    ratio, battery = np.zeros(len(n)), np.zeros(len(n))
    for weight, x, mean, variance, plain_mean, plain_variance in tests:
        score = (x - mean) ** 2 / variance
        # changes and products follow the same order of symbols, so each counts half
        ratio += weight * ((x - plain_mean) ** 2 / plain_variance - score + np.log(plain_variance / variance)) / 2
        battery += score
    return ratio, battery


def _classes(statistics: np.ndarray, null: Null) -> tuple[np.ndarray, np.ndarray]:
    """Class of encoding and length, and step of evidence; -STEPS also where the battery rejects randomness."""
    ratio, battery = evidence(statistics, null)
    step = np.clip(np.floor(np.where(battery > BATTERY, -np.inf, ratio) / STEP), -STEPS, STEPS).astype(np.int64)
    return statistics[:, 0] * (len(LENGTHS) + 1) + np.searchsorted(LENGTHS, statistics[:, 1], "right"), step


def discoveries(counts: dict[tuple[int, int], int], limit: float = FALSE_DISCOVERIES) -> set[tuple[int, int]]:
    """The (class, step) whose runs are taken for random; each class keeps the limit by itself."""
    taken = set()
    for one in sorted({c for c, _ in counts}):
        steps = sorted((s for c, s in counts if c == one), reverse=True)
        weight = np.array([counts[one, s] for s in steps], float)
        ratio = np.exp(np.array(steps) * STEP)
        share = 0.01
        for _ in range(200):
            random = share * ratio / (share * ratio + 1 - share)
            # one run in a hundred is random before any is seen
            share = ((weight * random).sum() + 1) / (weight.sum() + 100)
        chance = 1 - share * ratio / (share * ratio + 1 - share)
        mean = np.cumsum(chance * weight) / np.cumsum(weight)
        taken |= {(one, s) for s, m in zip(steps, mean) if m <= limit and s > -STEPS}
    return taken


def _table(column: pa.Array) -> np.ndarray:
    """Statistics of the runs of a list column, one row each."""
    inner = column.flatten()
    return np.stack([inner.field(n).to_numpy(zero_copy_only=False) for n in _STATISTICS], 1) if len(inner) else np.empty((0, len(_STATISTICS)), np.int64)


def _pairs(found: DataFrame) -> np.ndarray:
    def run(batches):
        total = np.zeros(len(_SYMBOLS) ** 2, np.int64)
        for batch in batches:
            for one in batch.column(0):
                total += np.frombuffer(one.as_buffer(), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    out = np.zeros(len(_SYMBOLS) ** 2)
    for pair, n in mapped(found.where("__pairs is not null").select("__pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(len(_SYMBOLS), -1)


def _steps(found: DataFrame, null: Null) -> dict[tuple[int, int], int]:
    def run(batches):
        for batch in batches:
            kind, step = _classes(_table(batch.column(0)), null)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(step)], names=["class", "step"])

    rows = mapped(found.where(F.size("__runs") > 0).select("__runs"), run, "class long, step long").groupBy("class", "step").count()
    return {(r[0], r[1]): r[2] for r in rows.collect()}


def scan(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), limit: float = FALSE_DISCOVERIES) -> DataFrame:
    """The kept columns and spans (kind, start, end) of every text.

    A run that the method adds has kind ``random`` and doesn't touch a base span. A kept column named spans is replaced.
    """
    own = renamed(keep, text, [("spans", SPANS)])
    rows = docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in ({text: text} | own).items()])
    kept = list(own.values())
    found = written(with_columns(rows, text, [("__base", SPANS), ("__runs", _RUNS), ("__pairs", T.BinaryType())], _scan(text), kept), "secrets")
    null = null_of(_pairs(found))
    taken = discoveries(_steps(found, null), limit)

    def add(batches):
        for batch in batches:
            base, runs = batch.column("__base"), batch.column("__runs")
            n = batch.num_rows
            kind, step = _classes(_table(runs), null)
            hit = np.array([x in taken for x in zip(kind.tolist(), step.tolist())], bool)
            doc = np.repeat(np.arange(n), runs.value_lengths().to_numpy())[hit]
            start, end = (runs.flatten().field(c).to_numpy()[hit] for c in ("start", "end"))
            owner = np.repeat(np.arange(n), base.value_lengths().to_numpy())
            b = base.flatten()
            b_start, b_end = b.field("start").to_numpy(), b.field("end").to_numpy()
            b_kind = np.array([KINDS.index(k) for k in b.field("kind").to_pylist()], np.int64)
            free = ~_touched(doc, start, end, owner, b_start, b_end)
            lists = _span_lists(*(np.concatenate(x) for x in ((b_kind, np.full(free.sum(), 3)), (b_start, start[free]), (b_end, end[free]), (owner, doc[free]))), n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "spans"])

    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in kept), T.StructField("spans", SPANS)])
    out = mapped(found.select(*kept, "__base", "__runs"), add, schema)
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], "spans")


def _touched(doc, start, end, owner, base_start, base_end) -> np.ndarray:
    """Which spans share a character with a base span of their text; base spans are ordered by text and start."""
    out = np.zeros(len(doc), bool)
    if not len(owner):
        return out
    first, last = np.searchsorted(owner, doc), np.searchsorted(owner, doc, "right")
    for i in np.flatnonzero(last > first):
        some = slice(first[i], last[i])
        out[i] = ((base_start[some] < end[i]) & (base_end[some] > start[i])).any()
    return out


def of_kinds(spans: str, kinds: Sequence[str]) -> Column:
    """The spans of some kinds."""
    return F.filter(spans, lambda s: s["kind"].isin(list(kinds)))


def as_text(spans: str, kinds: Sequence[str] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas."""
    return F.array_join(F.transform(of_kinds(spans, kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
