"""SentencePiece encoding by an Aho-Corasick automaton and Viterbi, and decoding.

The automaton holds all ordinary pieces. One scan of a text reports, at each position,
every piece that ends there (the node's piece and those its output links lead to), and
each relaxes the best score of that end. Of equal scores the one with the longer last piece
wins. A character that is no piece itself may also be spelled in byte pieces, at a score
below that of any piece.

A space is the mark U+2581, a text gets one mark in front (an empty one none). A mark
that stands in a text is spelled in bytes, so decoding gives back every text unchanged.
If no piece goes on after a line feed or from another character into a mark, segments
between such points are independent, and each distinct one is solved once in a worker.

Nulls: a null text is an empty one. Repeated rows are encoded alike.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wavesift.llm.memo import IdMemo
from wavesift.llm.rows import with_columns
from wavesift.llm.textops import byte_codes, span_hash, strings, utf8
from wavesift.llm.workers import held

MODEL = "piece_bpe_32k.model"
MARK = "\u2581"
#: Below the least score of a piece.
UNKNOWN = 10.0
#: Stands for a mark of the text while matching; no piece has it.
_NO_PIECE = "\uffff"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Piece(NamedTuple):
    id: int
    length: int
    score: float


class Vocabulary:
    """Pieces of a model, their automaton, and the bytes each id stands for."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.byte_id = np.zeros(256, np.int64)
        self.single: set[str] = set()
        raw: list[bytes] = []
        lowest, crosses = 0.0, False
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(text[3:5], 16)] = i
                raw.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                score = model.get_score(i)
                lowest = min(lowest, score)
                self.automaton.add_word(text, Piece(i, len(text), score))
                raw.append(text.replace(MARK, " ").encode())
                crosses |= "\n" in text or MARK in text.lstrip(MARK)
                if len(text) == 1:
                    self.single.add(text)
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN
        self.splits = not crosses
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.is_byte = np.zeros(len(raw), bool)
        self.is_byte[self.byte_id] = True
        self.memo = IdMemo(np.uint32, [], 1_000_000)

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose spaces stand for marks."""
        n = len(text)
        shown = text.replace(MARK, _NO_PIECE).replace(" ", MARK)
        best = [0.0] + [float("-inf")] * n
        last: list[Piece | None] = [None] * (n + 1)
        done = 0
        single, unknown = self.single, self.unknown

        def spell(to: int) -> None:
            for q in range(done, to):
                if shown[q] not in single and best[q] + unknown > best[q + 1]:
                    best[q + 1], last[q + 1] = best[q] + unknown, None

        for end, piece in self.automaton.iter(shown):
            if end >= done:
                spell(end + 1)
                done = end + 1
            score = best[end + 1 - piece.length] + piece.score
            now = last[end + 1]
            if score > best[end + 1] or (score == best[end + 1] and (now is None or piece.length > now.length)):
                best[end + 1], last[end + 1] = score, piece
        spell(n)
        out: list[int] = []
        while n:
            piece = last[n]
            if piece is None:
                n -= 1
                out.extend(int(self.byte_id[b]) for b in reversed(text[n].encode()))
            else:
                n -= piece.length
                out.append(piece.id)
        return out[::-1]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the n+1 offsets of the rows."""
        data, offsets = utf8(column)
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[full], 32)
        added = np.zeros(len(offsets), np.int64)
        added[full + 1] = 1
        offsets = offsets + np.cumsum(added)
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        if self.splits and n:
            space, line = data == 32, data == 10
            cut[1:n] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], n) if len(start) else start
        keys, one, inverse = np.unique(span_hash(byte_codes(data), start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()

        def make(at):
            where = one[at]
            runs = [self.segment(raw[s:e].decode()) for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)]
            return np.array([i for run in runs for i in run], np.uint32), np.fromiter(map(len, runs), np.int64, len(runs))

        ids, total = self.memo.ids(self.memo.entries(keys, make)[inverse])
        return ids, total[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and the n+1 offsets; the mark in front of a row goes."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.arange(total[-1]) + np.repeat(self.at[ids] - total[:-1], size)]
        off = total[offsets]
        lead = off[:-1][np.diff(off) > 0]
        stay = np.ones(len(data), bool)
        stay[lead[data[lead] == 32]] = False
        return data[stay], np.concatenate([[0], np.cumsum(stay)])[off]


def vocabulary(path: str) -> Vocabulary:
    return held(f"vocabulary {path}", lambda: Vocabulary(path))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ids (little-endian unsigned 32 bits), n_ids and n_byte_ids to every row."""
    path = path or model_path()

    def make():
        words = vocabulary(path)

        def compute(part):
            ids, off = words.encode(part.column(text))
            spelled = np.concatenate([[0], np.cumsum(words.is_byte[ids])])
            binary = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            return [binary, pa.array(np.diff(off)), pa.array(np.diff(spelled[off]))]

        return compute

    return with_columns(docs, text, [("ids", T.BinaryType()), ("n_ids", T.LongType()), ("n_byte_ids", T.LongType())], make, keep, keeps=f"vocabulary {path}")


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add decoded, the text of the ids; null ids give an empty text."""
    path = path or model_path()

    def make():
        words = vocabulary(path)

        def compute(part):
            data, off = utf8(part.column(ids))
            return [strings(*words.decode(np.frombuffer(data.tobytes(), "<u4"), off // 4))]

        return compute

    return with_columns(rows, ids, [("decoded", T.StringType())], make, keep, keeps=f"vocabulary {path}")
