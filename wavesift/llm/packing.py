"""Concatenate-and-cut packing by two passes of prefix sums.

Pass 1 tokenises every document once and writes its ids with the number of ids before
it in its partition. The partitions' totals, one row each, are summed to global
offsets. Pass 2 adds the two and cuts the one long run of ids at every multiple of the
sequence length; each document becomes one row per sequence it touches (the boundary
records), so no sequence is ever gathered.

A document is the ids of its text and one end id; a null or empty text is the end id
alone. Repeated rows are packed once each. Only the last sequence needs padding.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm.memo import IdMemo
from wavesift.llm.rows import with_columns
from wavesift.llm.shared import written
from wavesift.llm.textops import utf8, word_hash, words
from wavesift.llm.workers import held, mapped

SEQUENCE = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers at most.
MEMO_WORDS = 1_000_000

#: Words encoded as one text.
JOINED = 500
#: Text encoded at a time; more of it shares words.
SLICE_BYTES = 1 << 21


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts for a tokenizer that never joins characters across white space.

    Each distinct word is encoded once and remembered.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.memo = IdMemo(kind, [end_id], MEMO_WORDS)

    def _split(self, start: np.ndarray, end: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, encoded as one text, and the number of each word's ids."""
        found = [raw[s:e].decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        got = self.tokenizer.encode(" ".join(found), add_special_tokens=False)
        size = np.fromiter(map(len, found), np.int64, len(found)) + 1
        at = np.fromiter((a for a, _ in got.offsets), np.int64, len(got))
        cut = np.searchsorted(at, np.append(np.cumsum(size) - size, size.sum()))
        return np.array(got.ids, self.memo.kind), np.diff(cut)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in order, and the n+1 offsets of the rows."""
        data, offsets = utf8(column)
        w = words(data, offsets)
        keys, one, inverse = np.unique(word_hash(w), return_index=True, return_inverse=True)
        raw = data.tobytes()

        def make(at):
            found = [self._split(w.start[one[part]], w.end[one[part]], raw) for part in np.array_split(at, -(-len(at) // JOINED))]
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))

        entry = self.memo.entries(keys, make)
        ids, total = self.memo.ids(np.insert(entry[inverse], w.first[1:], 0))
        return ids, total[w.first + np.arange(len(w.first))]


def encoder(path: str, end_id: int) -> WordEncoder:
    return held(_key(path, end_id), lambda: WordEncoder(path, end_id))


def _key(path: str, end_id: int) -> str:
    return f"encoder {path} {end_id}"


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Pass 1: ids of each row, its partition and the ids before it in that partition."""
    path = path or tokenizer_path()
    fields = [("ids", T.BinaryType()), ("part", T.IntegerType()), ("before", T.LongType()), ("n_ids", T.LongType())]

    def make():
        enc = encoder(path, end_id)
        part_id = TaskContext.get().partitionId()
        seen = 0

        def compute(part):
            nonlocal seen
            ids, off = enc.encode(part.column(text))
            size = np.diff(off)
            binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((off * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            before = seen + off[:-1]
            seen += int(off[-1])
            return [binary, pa.array(np.full(len(size), part_id, np.int32)), pa.array(before), pa.array(size)]

        return compute

    return with_columns(docs, text, fields, make, list(keep), SLICE_BYTES, _key(path, end_id))


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32 bits), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    once = written(tokenized(docs, path, end_id, text), "packing")
    totals = once.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("total")).orderBy("part").collect()
    # one number for each partition of the input, so a bounded table
    ahead, sums = 0, []
    for r in totals:
        sums.append((r.part, ahead))
        ahead += r.total
    base = spark.createDataFrame(sums, "part int, base long")
    placed = once.join(F.broadcast(base), "part").select("doc_id", "ids", (F.col("base") + F.col("before")).alias("first"), "n_ids")
    schema = T.StructType([once.schema["doc_id"], *(T.StructField(n, t) for n, t in [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())])])
    wide = once.schema

    def cut(batches):
        for batch in batches:
            data, byte_off = utf8(batch.column("ids"))
            n = batch.column("n_ids").to_numpy()
            first = batch.column("first").to_numpy()
            if not len(n):
                continue
            width = int(len(data) // max(int(n.sum()), 1))
            ids = data.view(np.uint16 if width == 2 else np.uint32).astype("<u4")
            pieces = (first + n - 1) // sequence - first // sequence + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[row] // sequence + nth
            begin = np.maximum(seq * sequence, first[row])
            end = np.minimum((seq + 1) * sequence, first[row] + n[row])
            length = end - begin
            # pieces follow each other without gaps, as the ids do
            off = np.concatenate([[0], np.cumsum(length)])
            for at in range(0, len(row), 20_000):
                to = min(at + 20_000, len(row))
                part = off[at : to + 1]
                binary = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(((part - part[0]) * 4).astype(np.int32)), pa.py_buffer(ids[part[0] : part[-1]])])
                rows = row[at:to]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array((begin - first[row])[at:to]), pa.array(length[at:to]), binary, pa.array(n[rows]), pa.array(seq[at:to]), pa.array((begin - seq * sequence)[at:to])],
                    names=schema.names,
                )

    assert wide["ids"].dataType == T.BinaryType()
    return mapped(placed, cut, schema)
