"""N-gram Jaccard join by a blocked sparse product of the document-shingle matrix.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of
distinct five-word shingles. Steps:

1. Rows with the same set are one class, told apart by 128 bits of hashes of the set. 64 of
   them name a class, unless two have the same; then others do.
2. A merged count-min sketch orders shingles, estimated rare ones first. By the size
   bound two linked sets share one of their first ``n - ceil(p n) + 1`` shingles in that
   order, so only those, and none estimated to be in a single class, are exchanged, with
   the band of their size (linked sets have the same band, or the larger one's is within reach).
   The order only has to be the same everywhere, so a loose estimate costs time, not links.
3. Classes that share such a shingle form candidate groups. Each group is cut into
   blocks of bounded rows and bounded non-zeros; a block's incidence matrix times its
   transpose, summed over column strips, gives overlap counts, and pairs that can no
   longer reach their size-derived bound are dropped after every strip.
4. A group of several blocks sends one representative of each found component on to
   the next round, until it fits one block or the blocks find no more.
5. For groups that had several blocks, classes of different components that share a
   shingle of step 2 are candidates if what each has left from that shingle on, in the common order,
   can still reach the pair's bound: the first shingle that linked sets share always passes. They stay
   if they share as many shingles of step 2 as the bound leaves to them.
   Two blocks that hold candidates are multiplied as in step 3, for those pairs only. So no
   link between components is lost, copies are never paired with each other again,
   and a set is exchanged once for each pair of blocks, not for each candidate.

Nulls and texts without words: an empty set, linked with nothing. With fewer than five
words the whole sequence is the one shingle. Rows with equal doc_id are separate rows; a
null doc_id counts as no id, and a component without any id has a null component_id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm import sketch
from wavesift.llm.graph import components
from wavesift.llm.rows import with_columns
from wavesift.llm.shared import dropped, written
from wavesift.llm.textops import in_doc, mix, run_hash, slices, utf8, word_hash, words
from wavesift.llm.workers import mapped

SHINGLE = 5
PERCENT = 80
BLOCK_ROWS = 512
BLOCK_NONZEROS = 400_000
STRIP = 2048


def _sets(column: pa.Array, k: int):
    """Sorted distinct shingle hashes of every document, one after another, and n+1 offsets."""
    data, offsets = utf8(column)
    w = words(data, offsets)
    h = word_hash(w, lower=True)
    docs = len(offsets) - 1
    n_words = np.diff(w.first)
    at = in_doc(w.first, k)
    value = run_hash(h, k)[at]
    doc = w.doc[at]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        whole = np.array([int(mix(h[w.first[d] : w.first[d + 1]] * np.arange(3, 3 + 2 * n_words[d], 2, dtype=np.uint64)).sum(dtype=np.uint64)) for d in short], np.uint64)
        value = np.concatenate([value, whole])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    cut = np.searchsorted(doc, np.arange(docs + 1))
    for d in range(docs):
        value[cut[d] : cut[d + 1]].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value = value[new]
    return value, np.concatenate([[0], np.cumsum(new)])[cut]


def _class_keys(value: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, whatever its order."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(value ^ np.uint64(salt)), out=total[1:])
        out.append(mix((total[cut[1:]] - total[cut[:-1]]) + np.diff(cut).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _first_seen(keys: np.ndarray, sizes: np.ndarray, seen: set) -> np.ndarray:
    """Documents with shingles whose class this task has not met before."""
    fresh = np.zeros(len(keys), bool)
    for i, key in enumerate(keys.tolist()):
        if sizes[i] and key not in seen:
            seen.add(key)
            fresh[i] = True
    return fresh


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any linked set."""
    return -(-n * percent // 100)


class _Find:
    """Union-find over the rows of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def linked_pairs(sets: list[np.ndarray], percent: int, asked: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of linked sets; of the asked pairs only, if there are any given.

    Incidence times transposed incidence, strip by strip of columns; a pair is dropped
    as soon as its count and all columns to come stay below its bound.
    """
    size = np.array([len(s) for s in sets], np.int64)
    value = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    column, row = number[column[shared]], row[shared]
    a, b = size[:, None], size[None, :]
    # 100 * o >= percent * (a + b - o)
    bound = -(-(percent * (a + b)) // (100 + percent))
    possible = np.minimum(a, b) >= bound
    if asked is None:
        possible = np.triu(possible, 1)
    else:
        wanted = np.zeros_like(possible)
        wanted[np.minimum(*asked), np.maximum(*asked)] = True
        possible &= wanted
    overlap = np.zeros(bound.shape, np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, n_columns, STRIP):
        s, e = np.searchsorted(column, [lo, lo + STRIP])
        strip = np.zeros((len(sets), min(STRIP, n_columns - lo)), np.float32)
        strip[row[s:e], column[s:e] - lo] = 1
        overlap += strip @ strip.T
        if lo + STRIP < n_columns:
            left_over = np.bincount(row[e:], minlength=len(sets))
            rest = np.minimum(left_over[:, None], left_over[None, :])
            possible &= overlap + rest >= bound
            if not possible.any():
                break
    return np.nonzero(possible & (overlap >= bound))


def _stream(batches, key_columns, columns):
    """Rows of a sorted partition, one complete key at a time, as lists per column."""
    held_key, held = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in key_columns), strict=True))
        cols = [batch.column(c).to_pylist() for c in columns]
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if keys[start] != held_key:
                if held is not None:
                    yield held_key, held
                held_key, held = keys[start], [[] for _ in columns]
            for h, c in zip(held, cols, strict=True):
                h.extend(c[start:i])
            start = i
    if held is not None:
        yield held_key, held


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Within each (grp, block): every class and the least class it is linked with there."""

    def run(batches):
        for (grp, block), (cls, raw) in _stream(batches, ["grp", "block"], ["cls", "shingles"]):
            i, j = linked_pairs([np.frombuffer(x, np.uint64) for x in raw], percent) if len(cls) > 1 else ((), ())
            find = _Find(len(cls))
            for x, y in zip(i, j, strict=True):
                find.join(int(x), int(y))
            root = [cls[find.root(k)] for k in range(len(cls))]
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(cls), pa.int64()), pa.array(cls, pa.int64()), pa.array(root, pa.int64())], names=["grp", "cls", "root"])

    keyed = members.select("grp", "block", "cls", "shingles")
    return mapped(keyed.repartition("grp", "block").sortWithinPartitions("grp", "block", "cls"), run, "grp long, cls long, root long")


def _between(near: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Labels (u, v) of the candidates that are linked, by products of the pairs of blocks that hold some."""
    cell = ["grp", "low", "high"]
    of = lambda side: held.select("grp", F.col("cls").alias(f"cls_{side}"), F.col("block").alias(f"block_{side}"))
    pairs = near.join(of("u"), "cls_u").join(of("v").drop("grp"), "cls_v")
    pairs = pairs.select("grp", F.least("block_u", "block_v").alias("low"), F.greatest("block_u", "block_v").alias("high"), "cls_u", "cls_v", "label_u", "label_v")
    pairs = written(pairs, "jaccard-cells")
    sides = pairs.select(*cell, F.explode(F.array("cls_u", "cls_v")).alias("cls")).distinct().join(held.select("cls", "shingles"), "cls")
    none = lambda kind: F.lit(None).cast(kind)
    rows = sides.select(*cell, F.col("cls").alias("a"), none("long").alias("b"), none("long").alias("label_a"), none("long").alias("label_b"), "shingles")
    rows = rows.unionByName(pairs.select(*cell, F.col("cls_u").alias("a"), F.col("cls_v").alias("b"), F.col("label_u").alias("label_a"), F.col("label_v").alias("label_b"), none("binary").alias("shingles")))

    def run(batches):
        for _, (a, b, label_a, label_b, raw) in _stream(batches, cell, ["a", "b", "label_a", "label_b", "shingles"]):
            sets = [i for i, x in enumerate(raw) if x is not None]
            place = {a[i]: k for k, i in enumerate(sets)}
            asked = {(min(p), max(p)): i for i in range(len(a)) if raw[i] is None for p in [(place[a[i]], place[b[i]])]}
            u, v = np.array(list(asked), np.int64).reshape(-1, 2).T
            linked = zip(*linked_pairs([np.frombuffer(raw[i], np.uint64) for i in sets], percent, (u, v)))
            at = [asked[int(i), int(j)] for i, j in linked]
            yield pa.RecordBatch.from_arrays([pa.array([label_a[i] for i in at], pa.int64()), pa.array([label_b[i] for i in at], pa.int64())], names=["u", "v"])

    return mapped(rows.repartition(*cell).sortWithinPartitions(*cell), run, "u long, v long").distinct()


def _apart(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with a common gram, another label, and enough left from that gram on for a link.

    A post whose own rest can't do even with the smallest set of its gram goes first. The classes of a gram are
    cut into blocks, and a pair of blocks is a key of the join, so that no gram is the work of one task.
    """
    enough = lambda rest, sizes: (100 + percent) * rest >= percent * sizes
    least = posts.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).where("low < high")
    left = posts.join(least.select("gram", "least"), "gram").where(enough(F.col("n") - F.col("pos"), F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))))
    several = left.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("many")).where("low < high")
    cut = left.join(several.select("gram", F.ceil(F.col("many") / BLOCK_ROWS).cast("int").alias("blocks")), "gram").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    cell = [F.col("gram"), F.col("row"), F.col("col")]
    kept = ("cls", "n", "pos", "label")
    one = cut.withColumns({"row": F.col("block"), "col": F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))}).select(*cell, *[F.col(c).alias(f"{c}_u") for c in kept])
    two = cut.withColumns({"row": F.explode(F.sequence(F.lit(0), F.col("block"))), "col": F.col("block")}).select(*cell, *[F.col(c).alias(f"{c}_v") for c in kept])
    # within a block each pair once; between two blocks each pair is met once anyway
    wanted = F.expr("label_u <> label_v and (row < col or cls_u < cls_v)") & enough(F.expr("least(n_u - pos_u, n_v - pos_v)"), F.expr("n_u + n_v"))
    met = one.join(two, ["gram", "row", "col"]).where(wanted)
    names = [f"{c}_{side}" for c in ("cls", "label", "n") for side in "uv"]
    turned = F.struct(*[F.col(c[:-1] + ("v" if c[-1] == "u" else "u")).alias(c) for c in names])
    order = F.when(F.col("cls_u") < F.col("cls_v"), F.struct(*names)).otherwise(turned)
    pairs = met.select(order.alias("pair")).select("pair.*").dropDuplicates(["cls_u", "cls_v"])
    # what lies behind the prefix of the one that ends first can't give more than its need less one
    mine = posts.groupBy("cls").agg(F.collect_set(F.when(F.col("own"), F.col("gram"))).alias("own"), F.collect_set(F.when(~F.col("own"), F.col("gram"))).alias("also"))
    side = lambda x: mine.select(F.col("cls").alias(f"cls_{x}"), F.col("own").alias(f"own_{x}"), F.col("also").alias(f"also_{x}"))
    shared = F.size(F.array_intersect(F.concat("own_u", "also_u"), "own_v")) + F.size(F.array_intersect("own_u", "also_v"))
    bound = F.ceil((F.col("n_u") + F.col("n_v")) * percent / (100 + percent)) - F.ceil(F.greatest("n_u", "n_v") * percent / 100) + 1
    return pairs.join(side("u"), "cls_u").join(side("v"), "cls_v").where(shared >= bound).select("cls_u", "cls_v", "label_u", "label_v")


def _blocks(members: DataFrame) -> DataFrame:
    """Add ``blocks`` (how many the group needs) and ``block`` (by a hash of the class)."""
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.ceil(F.sum("n") / F.lit(BLOCK_NONZEROS))).cast("long").alias("blocks"))
    return members.drop("blocks", "block").join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("cls", "blocks"), F.col("blocks")))


def similar(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Add n_shingles, component_id (least linked doc_id) and is_representative to every row.

    One row of each component is its representative: the one with the least doc_id, of
    equal ones the first. ``keep`` must hold doc_id.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0

    # 1. classes of equal sets
    def make_sets():
        row = TaskContext.get().partitionId() << 40

        def compute(part):
            nonlocal row
            value, cut = _sets(part.column(text), shingle)
            key, more = _class_keys(value, cut)
            n = np.diff(cut)
            row += len(n)
            return [pa.array(n), pa.array(key, mask=n == 0), pa.array(more, mask=n == 0), pa.array(np.arange(row - len(n), row))]

        return compute

    fields = [("n_shingles", T.LongType()), ("__cls", T.LongType()), ("__more", T.LongType()), ("__row", T.LongType())]
    rows = written(with_columns(docs, text, fields, make_sets, list(keep)), "jaccard-rows")
    # names that two classes have: the square of the classes by 2**65, so hardly any
    both = rows.groupBy("__cls").agg(F.min("__more").alias("low"), F.max("__more").alias("high")).where("low < high").select("__cls").collect()
    twice = np.array(sorted(r[0] for r in both), np.int64)
    if len(twice):
        rows = rows.withColumn("__cls", F.when(F.col("__cls").isin(twice.tolist()), F.col("__cls").bitwiseXOR(F.col("__more"))).otherwise(F.col("__cls")))

    def names(value, cut):
        key, more = _class_keys(value, cut)
        return np.where(np.isin(key, twice), key ^ more, key) if len(twice) else key

    # 2. rare shingles first
    def make_counted():
        seen: set = set()

        def hashes(part):
            value, cut = _sets(part.column(text), shingle)
            fresh = _first_seen(names(value, cut), np.diff(cut), seen)
            return value[np.repeat(fresh, np.diff(cut))]

        return hashes

    bits = sketch.bits_for(n_bytes / 12)
    counts = spark.sparkContext.broadcast(sketch.build(docs, text, make_counted, bits, rows=1, cap=255))

    def prefixes(batches):
        seen: set = set()
        for batch in batches:
            for part in slices(batch, text):
                value, cut = _sets(part.column(text), shingle)
                size = np.diff(cut)
                key = names(value, cut)
                fresh = _first_seen(key, size, seen)
                doc = np.repeat(np.arange(len(size)), size)
                often = counts.value.estimate(value)
                allowed = size - _need(size, percent) + 1
                # documents with more shingles estimated single than the prefix is long emit nothing
                single = np.bincount(doc, often < 2, len(size))
                live = fresh & (single < allowed)
                chosen = live[doc] & (often >= 2)
                value, doc, often = value[chosen], doc[chosen], often[chosen]
                order = np.lexsort((value, often, doc))
                value, doc = value[order], doc[order]
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc) + single[doc]
                inside = rank < allowed[doc]
                value, doc, rank = value[inside], doc[inside], rank[inside]
                # linked sets are of like size: apart from those whose larger partners fall into the next band, one band
                band = np.floor(np.log2(np.maximum(size, 1))).astype(np.uint64)
                reach = np.floor(np.log2(np.maximum(size * 100 // percent, 1))).astype(np.uint64)
                also = np.flatnonzero(reach[doc] > band[doc])
                gram = np.concatenate([mix(value ^ band[doc]), mix(value[also] ^ reach[doc[also]])])
                doc, rank = np.concatenate([doc, doc[also]]), np.concatenate([rank, rank[also]])
                own = pa.array(np.arange(len(doc)) < len(doc) - len(also))
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(key[doc]), pa.array(rank.astype(np.int32)), own], names=["gram", "cls", "pos", "own"])

    grams = written(mapped(docs.select(text), prefixes, "gram long, cls long, pos int, own boolean"), "jaccard-grams")
    dropped(counts)
    least = grams.groupBy("gram").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
    groups = components(grams.join(least, "gram").select(F.col("cls").alias("u"), F.col("low").alias("v")))
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("cls"), F.col("root").alias("grp"))
    sizes = rows.where("__cls is not null").groupBy(F.col("__cls").alias("cls")).agg(F.first("n_shingles").alias("n"), F.xxhash64(F.min("doc_id")).bitwiseXOR(F.first("__cls")).alias("one"))
    members = written(_blocks(members.join(sizes, "cls")), "jaccard-groups")
    dropped(groups)

    # 3. sets of the candidates, from the row with the least doc_id of each class
    wanted = spark.sparkContext.broadcast(sketch.build_set(members, "one"))

    def emit_sets(batches):
        seen: set = set()
        for batch in batches:
            for part in slices(batch, text):
                value, cut = _sets(part.column(text), shingle)
                size = np.diff(cut)
                key = names(value, cut)
                at = np.flatnonzero(wanted.value.holds((key ^ part.column("id_key").to_numpy()).view(np.uint64)))
                at = at[_first_seen(key[at], size[at], seen)]
                raw = [value[cut[d] : cut[d + 1]].tobytes() for d in at]
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(raw, pa.binary())], names=["cls", "shingles"])

    sets = mapped(docs.select(text, F.xxhash64("doc_id").alias("id_key")), emit_sets, "cls long, shingles binary")
    held = sets.join(members, "cls").groupBy("cls").agg(*(F.first(c).alias(c) for c in ("grp", "n", "blocks", "block", "shingles")))
    held = written(held, "jaccard-sets")
    dropped(wanted, members)

    # 4. links inside blocks, until the blocks of a group find no more
    found, rounds = [], []
    active, old = held, None
    for _ in range(20):
        links = written(_block_links(active, percent), "jaccard-links")
        rounds.append(links)
        found.append(links.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v")))
        large = active.where("blocks > 1")
        roots = links.where("cls = root").select("cls")
        survivors = written(_blocks(large.join(roots, "cls", "left_semi")), "jaccard-active")
        now, then = survivors.count(), large.count()
        if old is not None:
            dropped(old)
        active = old = survivors
        if now == 0 or now > 0.9 * then:
            break
    pairs = reduce(DataFrame.unionByName, found)
    merged = components(pairs)

    # 5. links between what blocks have left apart
    split = held.where("blocks > 1").select("cls", "n")
    if not split.isEmpty():
        label = split.join(merged.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", F.coalesce("root", "cls").alias("label"))
        label = written(label, "jaccard-labels")
        # bits of the classes in question, so that no other class's shingles are exchanged
        asked = spark.sparkContext.broadcast(sketch.build_set(label, "cls"))

        def in_question(batches):
            for batch in batches:
                yield batch.filter(pa.array(asked.value.holds(batch.column("cls").to_numpy().view(np.uint64))))

        posts = mapped(grams, in_question, "gram long, cls long, pos int, own boolean").join(label, "cls").distinct()
        near = written(_apart(posts, percent), "jaccard-apart")
        dropped(asked, label)
        more = written(_between(near, held, percent), "jaccard-links")
        dropped(near)
        if not more.isEmpty():
            # labels are roots of what was merged before or single classes, so only they are merged
            again = components(more).select(F.col("node").alias("label"), F.col("root").alias("top"))
            every = merged.unionByName(again.select(F.col("label").alias("node"), F.col("label").alias("root")).join(merged.select("node"), "node", "left_anti"))
            merged, old = written(every.join(again, F.col("root") == F.col("label"), "left").select("node", F.coalesce("top", "root").alias("root")).where("node <> root"), "components"), merged
            dropped(old)
        dropped(more)
    dropped(grams, held, *rounds)

    # back to rows: the least doc_id of each component, and the first row that has it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    root = rows.where("__cls is not null").groupBy("__cls").agg(first).join(merged.withColumnRenamed("node", "__cls"), "__cls", "left").withColumn("root", F.coalesce("root", "__cls"))
    lowest = root.groupBy("root").agg(F.min("first").alias("first"))
    by_class = root.select(F.col("__cls").alias("__of"), "root").join(lowest, "root").select("__of", F.col("first.doc_id").alias("component_id"), F.col("first.__row").alias("__kept"))
    new = ("n_shingles", "component_id", "is_representative")
    empty = F.col("__more").isNull()
    # rows without words get keys of their own, so that they don't meet in one task
    ready = rows.withColumn("__cls", F.coalesce("__cls", F.monotonically_increasing_id()))
    return (
        ready.join(by_class, (F.col("__cls") == F.col("__of")) & ~empty, "left")
        .withColumn("component_id", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")))
        .withColumn("is_representative", empty | (F.col("__row") == F.col("__kept")))
        .select(*[f"`{c}`" for c in keep if c not in new], *new)
    )
