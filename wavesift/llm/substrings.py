"""Substring dedup: words in windows that occur twice are removed.

A window is ``WINDOW`` consecutive words. Its representative gram is the least of its
``WINDOW - GRAM + 1`` grams of GRAM words, a function of the window's content: a
repeated window has a repeated representative. Pass 1 counts representatives in a
count-min sketch of each partition and merges the sketches. Pass 2 emits only windows
whose representative is estimated to repeat, with a 128-bit key, and counts them exactly; the sketch
never underestimates, so no repeated window is lost. Windows that turn out to occur once
are the exceptions, each of one known place; they go back to their document and every
other emitted window is removed. No group of equal windows is ever brought together
beyond a count.

Nulls: a null text has no words. Rows with equal texts count as different places, even
with equal ids. Texts shorter than a window lose nothing. Texts are named by 128 bits of
hashes when exceptions find back to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm import sketch
from wavesift.llm.rows import join_keys, renamed, with_columns
from wavesift.llm.shared import written
from wavesift.llm.textops import covered, in_doc, run_hash, slices, sliding_argmin, strings, utf8, word_hash, words
from wavesift.llm.workers import mapped

WINDOW = 35
GRAM = 18


def _windows(column: pa.Array, window: int, gram: int):
    """Words, their hashes, window starts and the gram hash that represents each window."""
    data, offsets = utf8(column)
    w = words(data, offsets)
    h = word_hash(w)
    at = in_doc(w.first, window)
    if not len(at):
        return w, h, at, np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = run_hash(h, gram)
    place = sliding_argmin(grams, window - gram + 1)[at]
    return w, h, at, place, grams[place]


def _sketch(docs: DataFrame, text: str, window: int, gram: int) -> sketch.Sketch:
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # about six bytes a word, two representatives for each (window - gram + 2) words
    bits = sketch.bits_for(n_bytes / 6 * 2 / (window - gram + 2))

    def make():
        def representatives(part):
            _, _, _, place, gram_hash = _windows(part.column(text), window, gram)
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            return gram_hash[new]

        return representatives

    return sketch.build(docs, text, make, bits)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Add n_words, n_removed and kept (the words left, joined by one space) to every row."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(_sketch(docs, text, window, gram))

    def emit(batches):
        for batch in batches:
            for part in slices(batch, text):
                w, h, at, _, gram_hash = _windows(part.column(text), window, gram)
                hit = counts.value.estimate(gram_hash) > 1 if len(at) else np.empty(0, bool)
                if not hit.any():
                    continue
                at = at[hit]
                doc = w.doc[at]
                names = [pa.array(part.column(c).to_numpy()[doc]) for c in ("text_a", "text_b")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run_hash(h, window)[at].view(np.int64)), pa.array(run_hash(h, window, 1)[at].view(np.int64)), *names, pa.array((at - w.first[doc]).astype(np.int32))],
                    names=["a", "b", "text_a", "text_b", "at"],
                )

    # a window has a byte for each word and for each gap at least
    long = F.octet_length(text) >= 2 * window - 1
    names = [F.when(long, F.xxhash64(text)).alias("text_a"), F.when(long, F.xxhash64(F.lit(7), text)).alias("text_b")]
    emitted = mapped(docs.where(long).select(text, *names), emit, "a long, b long, text_a long, text_b long, at int")
    once = (
        emitted.groupBy("a", "b")
        .agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("text_a", "text_b", "at")])
        .where("n = 1")
        .groupBy(F.col("text_a").alias("__once_a"), F.col("text_b").alias("__once_b"))
        .agg(F.collect_list("at").alias("__once"))
    )
    once = written(once, "substrings")

    fields = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())]
    own = renamed(keep, text, fields)
    joined = (
        docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ({text: text} | own).items()], *join_keys(names))
        .join(once, (F.col("__a") == F.col("__once_a")) & (F.col("__b") == F.col("__once_b")), "left")
        .drop("__a", "__b", "__once_a", "__once_b")
    )

    def make():
        def compute(part):
            w, _, at, _, gram_hash = _windows(part.column(text), window, gram)
            hit = np.zeros(len(w.start) + 1, bool)
            if len(at):
                hit[at] = counts.value.estimate(gram_hash) > 1
            single = part.column("__once")
            sizes = np.diff(single.offsets.to_numpy())
            if len(single.flatten()):
                sizes = np.array([len(x) if x is not None else 0 for x in single.to_pylist()])
                hit[np.repeat(w.first[:-1], sizes) + single.flatten().to_numpy()] = False
            gone = covered(len(w.start), np.flatnonzero(hit), window)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            data, off = _join_words(w, ~gone)
            return [pa.array(np.diff(w.first)), pa.array(removed), strings(data, off)]

        return compute

    out = with_columns(joined, text, fields, make, [*own.values(), "__once"])
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], *(n for n, _ in fields))


def _join_words(w, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each document's staying words, joined by one space."""
    start, end, doc = w.start[stay], w.end[stay], w.doc[stay]
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    size = end - start + ~last
    total = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(total[-1]) + np.repeat(start - total[:-1], size)
    padded = np.append(w.data, np.uint8(32))
    data = padded[np.minimum(source, len(w.data))]
    data[total[1:][~last] - 1] = 32
    count = np.searchsorted(doc, np.arange(len(w.offsets)))
    return data, total[count]


def sha256_hex(column: str):
    """Lower-case hex of the digest of a string column (null counts as empty)."""
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)
