"""Suffix-array dedup: bytes inside repeated 200-byte strings are removed.

A sparse suffix array is enough. Every 200-byte string has an anchor, the least of its
100-byte grams by hash, at a place that depends on its content alone, so two equal
strings have anchors at the same offset and their anchors' suffixes share 100 bytes.

1. A merged count-min sketch of anchor grams leaves out suffixes that surely share
   their first 100 bytes with no other.
2. Every task sorts the other anchors' suffixes (200 bytes at most, then the bytes before the
   anchor, backwards) into runs, counts equal ones once, and front-codes them: the
   length of the prefix shared with the one before, then the rest.
3. Runs are cut at sampled splitters and exchanged. Each range is merged by a loser tree
   that keeps, with every loser, the prefix it shares with the last winner: unequal
   lengths decide without a look at the bytes, equal ones compare only behind them.
   Splitters are anchor grams, so suffixes that share 100 bytes are in one range; only
   where such a set fills ranges of its own do splitters cut it.
4. A string that starts ``o`` bytes before its anchor is repeated where two anchors share
   ``200 - o`` bytes from there on, which the common prefixes of neighbours in the
   merged order tell, and ``o`` bytes backwards, which those in the sorted order of what
   comes before tell. Strings found nowhere else go back to their one place as
   exceptions. Sets that a splitter cuts or that are larger than ``GROUP_RECORDS`` are
   counted by Spark instead, string by string with 128-bit keys.
5. All strings of step 2's anchors but the exceptions are repeated; bytes they cover go.

Nulls: a null text has no bytes. Matches never cross documents; rows with equal texts
are different places. Texts shorter than 200 bytes lose nothing. Texts are named by 128
bits of hashes when exceptions find back to them.

Inputs beyond ``MAX_RANGES`` ranges are also dealt by a hash of the anchor gram, so that
ranges keep their size and the table of splitters stays bounded.
"""

from __future__ import annotations

import bisect
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm import sketch
from wavesift.llm.rows import join_keys, renamed, with_columns
from wavesift.llm.shared import dropped, written
from wavesift.llm.textops import byte_codes, covered, in_doc, run_hash, slices, sliding_argmin, span_hash, utf8
from wavesift.llm.workers import mapped

LENGTH = 200
GRAM = 100
RUN_RECORDS = 100_000
GROUP_RECORDS = 20_000
RANGE_BYTES = 12_000_000
#: Ranges of one order; more input gets several orders beside each other.
MAX_RANGES = 65_536
PER_RANGE = 16


def _anchors(column: pa.Array):
    """Anchors of all 200-byte strings: gram hash, place, first and last string start, document."""
    data, offsets = utf8(column)
    at = in_doc(offsets, LENGTH)
    if not len(at):
        none = np.empty(0, np.int64)
        return data, offsets, np.empty(0, np.uint64), none, none, none
    grams = run_hash(byte_codes(data), GRAM)
    place = sliding_argmin(grams, LENGTH - GRAM + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = place[1:] != place[:-1]
    head = np.flatnonzero(new)
    return data, offsets, grams[place[head]], place[head], at[head], at[np.append(head[1:], len(at)) - 1]


def _sketch(docs: DataFrame, text: str, n_bytes: int) -> sketch.Sketch:
    def make():
        return lambda part: _anchors(part.column(text))[2]

    return sketch.build(docs, text, make, sketch.bits_for(n_bytes * 2 / (LENGTH - GRAM + 2)))


def _text_keys(text: str) -> list:
    """128 bits that name a text; null where it is too short to matter."""
    long = F.octet_length(text) >= LENGTH
    return [F.when(long, F.xxhash64(text)).alias("text_a"), F.when(long, F.xxhash64(F.lit(7), text)).alias("text_b")]


def _key(raw: bytes, place: int, first: int, last: int) -> bytes:
    """Suffix, the bytes before it backwards, and how far its last string starts before it."""
    return raw[place : last + LENGTH] + raw[first:place][::-1] + bytes((place - last,))


def shared_prefixes(keys: list[bytes]) -> np.ndarray:
    """Length of the prefix each sorted key shares with the one before (0 for the first)."""
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    wide = int(size.max(initial=0))
    rows = np.frombuffer(b"".join(k.ljust(wide, b"\0") for k in keys), np.uint8).reshape(len(keys), wide)
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


_RUN = "part int, shared binary, size binary, times binary, text_a binary, text_b binary, at binary, rest binary"
_RUN_KINDS = (("shared", "<u2"), ("size", "<u2"), ("times", "<u4"), ("text_a", "<i8"), ("text_b", "<i8"), ("at", "<i4"))


def _front_coded(part: int, keys, times, places) -> pa.RecordBatch:
    shared = shared_prefixes(keys)
    rest = zstandard.ZstdCompressor(level=1).compress(b"".join(k[s:] for k, s in zip(keys, shared.tolist(), strict=True)))
    values = {"shared": shared, "size": [len(k) for k in keys], "times": times} | dict(zip(("text_a", "text_b", "at"), zip(*places, strict=True), strict=True))
    cols = [np.asarray(values[n]).astype(kind).tobytes() for n, kind in _RUN_KINDS]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([c], pa.binary()) for c in cols), pa.array([rest], pa.binary())], names=["part", *(n for n, _ in _RUN_KINDS), "rest"])


def _sorted_run(records: list[tuple[int, bytes, tuple[int, int, int]]], splitters: list[bytes]):
    """Sort one run of (order, key, (text, text, at)), count equal keys once, cut it at the splitters."""
    records.sort()
    for order, run in groupby(records, lambda r: r[0]):
        keys, times, places = [], [], []
        for _, key, place in run:
            if keys and keys[-1] == key:
                times[-1] += 1
            else:
                keys.append(key)
                times.append(1)
                places.append(place)
        lo = 0
        while lo < len(keys):
            part = bisect.bisect_right(splitters, keys[lo])
            hi = bisect.bisect_left(keys, splitters[part], lo) if part < len(splitters) else len(keys)
            yield _front_coded(order * (len(splitters) + 1) + part, keys[lo:hi], times[lo:hi], places[lo:hi])
            lo = hi


def _decoded(row: dict):
    """(shared, key, times, text_a, text_b, at) of a front-coded run, in order."""
    cols = [np.frombuffer(row[n], kind).tolist() for n, kind in _RUN_KINDS]
    rest = zstandard.ZstdDecompressor().decompress(row["rest"])
    key, used = b"", 0
    for shared, size, *more in zip(*cols, strict=True):
        key = key[:shared] + rest[used : used + size - shared]
        used += size - shared
        yield shared, key, *more


def _compare(a: bytes, b: bytes, known: int) -> tuple[bool, int]:
    """Whether a comes first, and the prefix the two share, given that ``known`` bytes are equal."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return len(a) <= len(b), n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    same = known + (8 * len(x) - differ.bit_length()) // 8
    return a[same] < b[same], same


def merge_runs(runs):
    """Merge sorted runs of (shared, key, ...) with a loser tree of shared prefixes.

    Yields (prefix shared with the key yielded before, key, ...). ``lcp[i]`` is what run
    i's head shares with the last key yielded (with its winner, for a loser). A head that
    shares more with that key than its rival does comes first; only heads that share equally much are
    compared, from the first byte not yet known.
    """
    runs = [iter(r) for r in runs]
    heads = [next(r, None) for r in runs]
    alive = [i for i, h in enumerate(heads) if h is not None]
    runs, heads = [runs[i] for i in alive], [heads[i] for i in alive]
    n = len(runs)
    if not n:
        return
    lcp = [0] * n
    size = 1 << (n - 1).bit_length()

    def play(w: int, other: int) -> tuple[int, int]:
        """(winner, loser); a missing or ended run always loses."""
        if other < 0 or heads[other] is None:
            return w, other
        if w < 0 or heads[w] is None:
            return other, w
        if lcp[w] != lcp[other]:
            return (w, other) if lcp[w] > lcp[other] else (other, w)
        first, same = _compare(heads[w][1], heads[other][1], lcp[w])
        loser = other if first else w
        lcp[loser] = same
        return (w, other) if first else (other, w)

    winner = [-1] * (2 * size)
    winner[size : size + n] = range(n)
    tree = [-1] * size
    for node in range(size - 1, 0, -1):
        winner[node], tree[node] = play(winner[2 * node], winner[2 * node + 1])
    top = winner[1]
    while heads[top] is not None:
        head = heads[top]
        yield (lcp[top], *head[1:])
        nxt = next(runs[top], None)
        heads[top] = nxt
        lcp[top] = nxt[0] if nxt is not None else 0
        node = (top + size) >> 1
        while node:
            top, tree[node] = play(top, tree[node])
            node >>= 1


_OUT = "kind int, a long, b long, text_a long, text_b long, at int, n int"
_OUT_KINDS = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "text_a": pa.int64(), "text_b": pa.int64(), "at": pa.int32(), "n": pa.int32()}


def _rows(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(values[c]), t) for c, t in _OUT_KINDS.items()], names=list(_OUT_KINDS))


def _strings(records):
    """Bytes of the strings around each anchor, one record after another."""
    texts, firsts, counts = [], [], []
    for _, key, _, _, _, at in records:
        before = key[-1]
        suffix = LENGTH - before
        texts.append(key[suffix:-1][::-1] + key[:suffix])
        firsts.append(at - (len(key) - 1 - suffix))
        counts.append(len(key) - LENGTH)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts = in_doc(offsets, LENGTH)
    count = np.array(counts, np.int64)
    record = np.repeat(np.arange(len(records)), count)
    place = np.array(firsts, np.int64)[record] + np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
    return byte_codes(data), starts, record, place


def _resolve(records):
    """Exceptions among complete sets, in merged order: strings of records seen once that no other record has."""
    m = len(records)
    if not m:
        return
    least = np.fromiter((r[1][-1] for r in records), np.int64, m)
    before = [r[1][LENGTH - r[1][-1] : -1] for r in records]
    most = np.fromiter(map(len, before), np.int64, m)
    onward = np.fromiter((r[0] for r in records), np.int64, m)
    onward[0] = 0
    order = sorted(range(m), key=before.__getitem__)
    backward = shared_prefixes([before[i] for i in order])
    back = np.empty(m, np.int64)
    weight = np.minimum(np.fromiter((r[2] for r in records), np.int64, m), 2)
    # columns are starts from the farthest before the anchor to the anchor itself
    single = np.zeros((m, LENGTH - GRAM + 1), bool)
    for o in range(LENGTH - GRAM + 1):
        has = np.flatnonzero((least <= o) & (o <= most))
        if not len(has):
            continue
        back[order] = np.cumsum(backward < o)
        # alike on both sides, so the same string
        alike = (np.cumsum(onward < LENGTH - o) * (m + 1) + back)[has]
        _, at = np.unique(alike, return_inverse=True)
        single[has, LENGTH - GRAM - o] = np.bincount(at, weight[has])[at] < 2
    edge = np.diff(np.pad(single, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    record, head = np.nonzero(edge == 1)
    if not len(record):
        return
    _, tail = np.nonzero(edge == -1)
    place = np.fromiter((r[5] for r in records), np.int64, m)[record] - (LENGTH - GRAM) + head
    zero = np.zeros(len(record), np.int64)
    names = [np.fromiter((r[i] for r in records), np.int64, m)[record] for i in (3, 4)]
    yield _rows(kind=zero, a=zero, b=zero, text_a=names[0], text_b=names[1], at=place, n=tail - head)


def _deferred(records):
    """Every string of the records with a 128-bit key, for an exact count by Spark."""
    for lo in range(0, len(records), 5_000):
        part = records[lo : lo + 5_000]
        codes, starts, record, place = _strings(part)
        times = np.minimum(np.array([r[2] for r in part]), 2)
        a, b = (run_hash(codes, LENGTH, s)[starts].view(np.int64) for s in (0, 1))
        names = [np.array([r[i] for r in part], np.int64)[record] for i in (3, 4)]
        yield _rows(kind=np.ones(len(a), np.int64), a=a, b=b, text_a=names[0], text_b=names[1], at=place, n=times[record])


def _merged(batches, splitters: list[bytes]):
    """Merge each range and report exceptions and deferred strings."""
    for part, runs in _ranges(batches):
        at = part % (len(splitters) + 1)
        # sets that a splitter longer than an anchor gram cuts
        edges = {s[:GRAM] for s in splitters[max(at - 1, 0) : at + 1] if len(s) > GRAM}
        waiting, waiting_bytes, group, spilled = [], 0, [], False

        def close(group, spilled):
            nonlocal waiting, waiting_bytes
            if spilled or (group and group[0][1][:GRAM] in edges):
                yield from _deferred(group)
            else:
                waiting += group
                waiting_bytes += sum(len(r[1]) for r in group)
                if waiting_bytes > 4_000_000:
                    yield from _resolve(waiting)
                    waiting, waiting_bytes = [], 0

        for record in merge_runs([_decoded(r) for r in runs]):
            shared, key = record[:2]
            if shared == len(key) and group and group[-1][1] == key:
                last = group[-1]
                group[-1] = (*last[:2], last[2] + record[2], *last[3:])
                continue
            if shared < GRAM and group:
                yield from close(group, spilled)
                group, spilled = [], False
            elif len(group) >= GROUP_RECORDS:
                # the last one may still be counted on
                yield from _deferred(group[:-1])
                group, spilled = group[-1:], True
            group.append(record)
        yield from close(group, spilled)
        yield from _resolve(waiting)


def _ranges(batches):
    """Front-coded runs of each range, from rows sorted by range."""
    part, runs = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                if runs:
                    yield part, runs
                part, runs = row["part"], []
            runs.append(row)
    if runs:
        yield part, runs


def _splitters(sampled: dict[bytes, int], ranges: int) -> list[bytes]:
    """Keys that cut the sample into ranges of equal weight: anchor grams, or whole keys inside a set that fills a range."""
    keys = sorted(sampled)
    if len(keys) < 2:
        return []
    total = np.cumsum([sampled[k] for k in keys])
    at = np.searchsorted(total, np.arange(1, ranges) * total[-1] / ranges)
    cut = sorted({keys[i] for i in at.tolist()})
    grams = Counter(k[:GRAM] for k in cut)
    return sorted({k if grams[k[:GRAM]] > 1 else k[:GRAM] for k in cut})


def repeated(docs: DataFrame, text: str = "text", keep=("doc_id",), as_text: bool = False) -> DataFrame:
    """Add n_bytes, n_removed, n_spans and kept (the bytes left) to every row.

    With ``as_text``, kept is a string; parts of a character that a cut left behind go too.
    """
    spark = docs.sparkSession
    n_bytes = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    counts = spark.sparkContext.broadcast(_sketch(docs, text, n_bytes))
    keyed = docs.where(F.octet_length(text) >= LENGTH).select(text, *_text_keys(text))

    def candidates(part):
        data, offsets, gram, place, first, last = _anchors(part.column(text))
        hit = counts.value.estimate(gram) > 1 if len(gram) else np.empty(0, bool)
        return data, offsets, gram[hit], place[hit], first[hit], last[hit]

    needed = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // RANGE_BYTES))
    orders = -(-needed // MAX_RANGES)
    ranges = -(-needed // orders)
    share = min(1.0, PER_RANGE * ranges * (LENGTH - GRAM + 2) / 2 / max(n_bytes, 1))

    def sample(batches):
        limit = np.uint64(min(share / orders, 1 - 2.0**-40) * 2.0**64)
        found: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, text):
                data, _, _, place, first, last = candidates(part)
                if len(place):
                    chosen = np.flatnonzero(span_hash(byte_codes(data), first, last + LENGTH) <= limit)
                    raw = data.tobytes()
                    found |= {_key(raw, *x) for x in zip(place[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist(), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["key"])

    # bounded: about PER_RANGE keys a range, each with the number of tasks that have it
    sampled = mapped(keyed, sample, "key binary").groupBy("key").count().toLocalIterator()
    splitters = _splitters({bytes(r["key"]): r["count"] for r in sampled}, ranges)
    shared = spark.sparkContext.broadcast(splitters)

    def runs(batches):
        held: list[tuple[int, bytes, tuple[int, int, int]]] = []
        for batch in batches:
            for part in slices(batch, text):
                data, offsets, gram, place, first, last = candidates(part)
                if not len(place):
                    continue
                raw = data.tobytes()
                doc = np.searchsorted(offsets, place, "right") - 1
                names = [part.column(c).to_numpy()[doc].tolist() for c in ("text_a", "text_b")]
                within = (place - offsets[doc]).tolist()
                order = (gram % np.uint64(orders)).tolist()
                keys = (_key(raw, *x) for x in zip(place.tolist(), first.tolist(), last.tolist(), strict=True))
                held += zip(order, keys, zip(*names, within, strict=True), strict=True)
                if len(held) >= RUN_RECORDS:
                    yield from _sorted_run(held, shared.value)
                    held = []
        if held:
            yield from _sorted_run(held, shared.value)

    def merged(batches):
        yield from _merged(batches, shared.value)

    exchanged = mapped(keyed, runs, _RUN).repartitionById(orders * (len(splitters) + 1), "part").sortWithinPartitions("part")
    found = written(mapped(exchanged, merged, _OUT), "suffixes-found")
    dropped(shared)
    counted = found.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("times"), F.min(F.struct("text_a", "text_b", "at")).alias("one")).where("times = 1")
    alone = found.where("kind = 0").select("text_a", "text_b", "at", "n").unionByName(counted.select("one.*", F.lit(1).alias("n")))
    # a place and a run length of at most LENGTH in one number
    once = alone.groupBy("text_a", "text_b").agg(F.collect_list(F.col("at").cast("long") * 256 + F.col("n")).alias("__once"))
    once = written(once.withColumnsRenamed({"text_a": "__once_a", "text_b": "__once_b"}), "suffixes-once")
    dropped(found)

    fields = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.StringType() if as_text else T.BinaryType())]
    own = renamed(keep, text, fields)
    joined = (
        docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ({text: text} | own).items()], *join_keys(_text_keys(text)))
        .join(once, (F.col("__a") == F.col("__once_a")) & (F.col("__b") == F.col("__once_b")), "left")
        .drop("__a", "__b", "__once_a", "__once_b")
    )

    def make():
        def compute(part):
            data, offsets, _, _, first, last = candidates(part)
            # covered by strings that start in [first, last]: +1 / -1 steps over starts
            starts = np.zeros(len(data) + 1, np.int32)
            np.add.at(starts, first, 1)
            np.add.at(starts, last + 1, -1)
            hit = np.cumsum(starts[:-1]) > 0
            single = part.column("__once")
            if len(single.flatten()):
                sizes = np.array([len(x) if x is not None else 0 for x in single.to_pylist()])
                both = single.flatten().to_numpy()
                at = (both >> 8) + np.repeat(offsets[:-1], sizes)
                n = both & 255
                hit[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())] = False
            gone = covered(len(data), np.flatnonzero(hit), LENGTH)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = np.diff(total[offsets])
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            head[inner] = gone[inner]
            spans = np.diff(np.concatenate([[0], np.cumsum(head)])[offsets])
            left = offsets - total[offsets]
            if as_text:
                raw = data[~gone].tobytes()
                texts = [raw[a:b].decode("utf-8", "ignore") for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                return [pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(texts, pa.string())]
            binary = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
            return [pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), binary]

        return compute

    out = with_columns(joined, text, fields, make, [*own.values(), "__once"])
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], *(n for n, _ in fields))
