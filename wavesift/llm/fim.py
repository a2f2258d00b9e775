"""Fill-in-middle forms by a parallel automaton scan.

A text is cut at line ends into prefix, middle and suffix and written with markers. One
automaton follows both the lines (does the next byte begin a unit?) and the markers (has one
been seen?). Texts of up to ``CHUNK`` bytes are one chunk each: a task scans a slice of them and
places their cuts. Longer ones are cut into chunks that are dealt over all tasks; each gives its
function of the start state, the functions of a text are composed in order, each cut is
looked for in the one chunk that holds it, and the places go back to their texts. Texts that
are equal are scanned once. Only longer texts are exchanged, and no text passes through the driver.

A null or empty text has no units and is plain. A null id draws as the empty string. Repeated rows are written
alike. A byte of a longer character never looks like a line end or a marker.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm import automata
from wavesift.llm.rows import renamed, with_columns
from wavesift.llm.shared import written
from wavesift.llm.textops import slices, strings, utf8
from wavesift.llm.workers import mapped

CHUNK = 1 << 16
RATE = 100
SPM = 50
SEED = 7
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Symbols of the automaton
_OTHER, _LINE, _OPEN, _LETTER, _CLOSE, _NOTHING = range(6)
#: How far a marker has been seen, above the bit that says whether a unit has begun
_NONE, _OPENED, _NAMED, _SEEN = range(4)

_FIELDS = [("n", T.LongType()), ("form", T.StringType()), ("output", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
_DRAWS = ["__h1", "__h2", "__h3", "__h4"]


def _automaton() -> automata.Automaton:
    symbols = np.zeros(256, np.int64)
    symbols[10], symbols[ord("<")], symbols[ord(">")] = _LINE, _OPEN, _CLOSE
    for marker in (PREFIX, SUFFIX, MIDDLE):
        symbols[ord(marker[1])] = _LETTER
    table, emits = np.empty((8, 6), np.int64), np.zeros((8, 6), np.int64)
    for state in range(8):
        begun, mark = state & 1, state >> 1
        for symbol in range(5):
            step = {_OPEN: _OPENED, _LETTER: _NAMED if mark == _OPENED else _NONE, _CLOSE: _SEEN if mark == _NAMED else _NONE}.get(symbol, _NONE)
            table[state, symbol] = 2 * (_SEEN if mark == _SEEN else step) + (symbol != _LINE)
            emits[state, symbol] = not begun
        table[state, _NOTHING] = state
    return automata.Automaton(symbols, table, emits)


LINES = _automaton()


def _draws(id_column: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(_DRAWS)]


def _units(draws: Sequence[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units before the middle and before the suffix."""
    a, b = (h % (n + 1) for h in draws[:2])
    return np.minimum(a, b), np.maximum(a, b)


def _write(data, offsets, n, marked, first, second, draws, rate: int, spm: int) -> list[pa.Array]:
    """The columns of ``_FIELDS``; first and second are bytes before the middle and before the suffix."""
    plain = (np.diff(offsets) == 0) | marked | (draws[2] % 100 >= rate)
    suffix_first = draws[3] % 100 < spm
    raw = data.tobytes()
    out = []
    for row, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
        if plain[row]:
            out.append(raw[lo:hi])
            continue
        prefix, middle, suffix = raw[lo : lo + first[row]], raw[lo + first[row] : lo + second[row]], raw[lo + second[row] : hi]
        order = (SUFFIX, suffix, PREFIX, prefix) if suffix_first[row] else (PREFIX, prefix, SUFFIX, suffix)
        out.append(b"".join(x if isinstance(x, bytes) else x.encode() for x in (*order, MIDDLE, middle)))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    start = offsets[:-1]
    n_prefix, n_middle = chars[start + first] - chars[start], chars[start + second] - chars[start + first]
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in out])])
    text = strings(np.frombuffer(b"".join(out), np.uint8), sizes)
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), text, *(pa.array(x, pa.int64(), mask=plain) for x in (n_prefix, n_middle))]


def _columns(part: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [part.column(c).to_numpy(zero_copy_only=False) for c in names]


def _short(text: str, rate: int, spm: int):
    """Texts that are one chunk each."""

    def make():
        def compute(part):
            data, offsets = utf8(part.column(text))
            draws = _columns(part, _DRAWS)
            s = automata.scan(LINES, data, offsets)
            whole = automata.functions(s)
            n = whole.counts[:, 0]
            units = _units(draws, n)
            cuts = []
            for unit in units:
                at = np.diff(offsets)
                # a cut after all units is at the end, any other where the next unit begins
                inner = np.flatnonzero(unit < n)
                at[inner] = automata.select(s, inner, np.zeros(len(inner), np.int64), unit[inner] + 1)
                cuts.append(at)
            return _write(data, offsets, n, whole.ends[:, 0] >> 1 == _SEEN, *cuts, draws, rate, spm)

        return compute

    return make


def _placed(long: DataFrame, text: str, chunk: int) -> DataFrame:
    """For each long text and draw: units, whether a marker was seen, bytes before the middle and before the suffix."""
    key = ["__a", "__b"]

    def cut(batches):
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = utf8(part.column(text))
                for row, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
                    starts = range(lo, hi, chunk)
                    names = [pa.array([part.column(c)[row].as_py()] * len(starts), pa.int64()) for c in key]
                    pieces = pa.array([data[at : min(at + chunk, hi)].tobytes() for at in starts], pa.binary())
                    yield pa.RecordBatch.from_arrays([*names, pa.array(np.arange(len(starts)), pa.int64()), pieces], names=[*key, "no", "piece"])

    pieces = mapped(long.select(*key, text), cut, "__a long, __b long, no long, piece binary").dropDuplicates([*key, "no"])
    pieces = written(pieces, "fim-pieces", **{"parquet.block.size": 16 << 20})

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "piece"):
                data, offsets = utf8(part.column("piece"))
                f = automata.functions(automata.scan(LINES, data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in [*key, "no"]), pa.array(f.ends.tolist(), pa.list_(pa.int64())), pa.array(f.counts.tolist(), pa.list_(pa.int64()))],
                    names=[*key, "no", "ends", "counts"],
                )

    kind = "array<bigint>"
    described = mapped(pieces, describe, f"__a long, __b long, no long, ends {kind}, counts {kind}")
    # a text has as many chunks as fit into a row of Spark
    rows = described.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("no", "ends", "counts"))).alias("parts"))

    def resolve(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                parts = batch.column("parts")[row].as_py()
                f = automata.Functions(np.array([p["ends"] for p in parts]), np.array([p["counts"] for p in parts]))
                states, before = automata.compose(f, 0)
                seen = [bool(states[-1] >> 1 == _SEEN)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, 1) for c in key), pa.array([int(before[-1])]), pa.array(seen), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (states[:-1], before[:-1]))],
                    names=[*key, "n", "marked", "states", "before"],
                )

    texts = mapped(rows, resolve, f"__a long, __b long, n long, marked boolean, states {kind}, before {kind}")
    # cuts by draw: many copies of a text differ in their draws only
    unit = [f"__h{i} % (n + 1)" for i in (1, 2)]
    wanted = long.select(*key, *_DRAWS[:2]).distinct().join(texts, key)
    wanted = written(wanted.select(*key, *_DRAWS[:2], "n", "marked", "states", "before", *[F.expr(f"{f}({', '.join(unit)})").alias(c) for f, c in (("least", "u1"), ("greatest", "u2"))]), "fim-cuts")
    asked = wanted.select(*key, "n", "states", "before", F.explode(F.array("u1", "u2")).alias("unit")).where("unit < n")
    asked = asked.withColumn("no", F.size(F.filter("before", lambda x: x <= F.col("unit"))) - 1).select(
        *key, F.col("no").cast("long"), "unit", F.expr("states[no]").alias("state"), F.expr("unit + 1 - before[no]").alias("kth")
    )
    # as many requests as a chunk has units at most
    asked = asked.groupBy(*key, "no").agg(F.collect_set(F.struct("unit", "state", "kth")).alias("asked"))

    def find(batches):
        for batch in batches:
            for part in slices(batch, "piece"):
                s = automata.scan(LINES, *utf8(part.column("piece")))
                lists = part.column("asked")
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                inner = lists.flatten()
                u, state, kth = (inner.field(i).to_numpy() for i in range(3))
                at = automata.select(s, owner, state, kth) + part.column("no").to_numpy()[owner] * chunk
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(owner)) for c in key), pa.array(u), pa.array(at)], names=[*key, "unit", "at"])

    places = mapped(pieces.join(asked, [*key, "no"]), find, "__a long, __b long, unit long, at long")
    out = wanted.drop("states", "before")
    for i in (1, 2):
        out = out.join(places.select(*key, F.col("unit").alias(f"u{i}"), F.col("at").alias(f"at{i}")), [*key, f"u{i}"], "left")
    return out.select(*key, *_DRAWS[:2], F.col("n").alias("__n"), F.col("marked").alias("__marked"), F.col("at1").alias("__at1"), F.col("at2").alias("__at2"))


def _long(text: str, rate: int, spm: int):
    """Texts whose cuts are known; one without a place is cut at its end."""

    def make():
        def compute(part):
            data, offsets = utf8(part.column(text))
            size = np.diff(offsets)
            cuts = [np.where(np.isnan(x), size, np.nan_to_num(x)).astype(np.int64) for x in (part.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("__at1", "__at2"))]
            n, marked = _columns(part, ["__n", "__marked"])
            return _write(data, offsets, n, marked.astype(bool), *cuts, _columns(part, _DRAWS), rate, spm)

        return compute

    return make


def transform(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    keep: Sequence[str] = ("doc_id",),
    rate: int = RATE,
    spm: int = SPM,
    seed: int = SEED,
    chunk: int = CHUNK,
) -> DataFrame:
    """The kept columns with n (units), form (plain, psm or spm), output, prefix_chars and middle_chars.

    ``rate`` of a hundred texts are cut, ``spm`` of a hundred of those with the suffix first. Kept
    columns with the name of an added one are replaced; both counts are null where the form is plain.
    """
    own = renamed(keep, text, _FIELDS)
    quote = lambda c: F.col(f"`{c.replace('`', '``')}`")
    rows = docs.select(*[quote(c).alias(n) for c, n in ({text: text} | own).items()], *_draws(quote(id_column), seed))
    big = F.coalesce(F.octet_length(text) > chunk, F.lit(False))
    kept = list(own.values())
    short = with_columns(rows.where(~big), text, _FIELDS, _short(text, rate, spm), [*kept, *_DRAWS])
    names = [F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(SEED), text).alias("__b")]
    long = rows.where(big).select("*", *names)
    joined = long.join(_placed(long, text, chunk), ["__a", "__b", *_DRAWS[:2]], "left")
    done = with_columns(joined, text, _FIELDS, _long(text, rate, spm), [*kept, *_DRAWS, "__n", "__marked", "__at1", "__at2"])
    return short.unionByName(done, allowMissingColumns=True).select(*[F.col(n).alias(c) for c, n in own.items()], *(n for n, _ in _FIELDS))


def restored(form: Column | str = "form", output: Column | str = "output") -> Column:
    """The text an output was written from; a marker occurs once in it, since texts that hold one are plain."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    part = lambda x, mark, side: F.substring_index(x, mark, side)
    bare = lambda x: F.substr(x, F.lit(len(PREFIX) + 1))
    psm_head, psm_tail = part(output, SUFFIX, 1), part(output, SUFFIX, -1)
    spm_head, spm_tail = part(output, PREFIX, 1), part(output, PREFIX, -1)
    return (
        F.when(form == "psm", F.concat(bare(psm_head), part(psm_tail, MIDDLE, -1), part(psm_tail, MIDDLE, 1)))
        .when(form == "spm", F.concat(part(spm_tail, MIDDLE, 1), part(spm_tail, MIDDLE, -1), bare(spm_head)))
        .otherwise(output)
    )
