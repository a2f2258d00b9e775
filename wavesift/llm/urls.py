"""URL filter: rules first, then the ratio of two character language models.

Rules name a host (with its subdomains) and a path prefix; the longest that fits
decides. For all other URLs two variable-order Markov models give the probability of
the characters, one of accepted and one of rejected URLs. Each order's estimate is
smoothed towards the next lower one; the counts of all URLs go in. The score is the
difference of the log-likelihoods by length, and a URL is blocked above a cut that a
quarter of the hosts set, whose URLs gave no counts, between the two kinds where they lie apart: at most ``FALSE`` of their accepted
URLs are beyond it, of those without a rule, as the models judge no others (without pages, of all). The share of these
hosts' accepted and of their rejected URLs beyond the cut is measured and goes with every verdict, so that one sees what
the models tell. Without accepted or rejected URLs to learn from they block nothing.

Marks to learn from are no list of words. A URL under a rule has the rule's verdict, and
what the rule names (its host, its path prefix) isn't learnt, only the rest. Another URL
is rejected if its page is poor: fewer than ``MIN_WORDS`` words outside tags, or more than
``SYMBOLS`` of ``#*$%&|<>`` for each of them. URLs without a rule and a page teach nothing.
Digits are alike to the models, so that page numbers don't matter.

Counts are exact: one row for each distinct run of characters up to ``ORDERS`` long, in a
table that grows with the URLs and never reaches the driver. A run's key holds its
characters themselves. URLs are scored in chunks of rows: the distinct runs of a chunk
are joined with the counts, and what was found meets the chunk's rows in an exchange.
A context occurs as often as the shorter run that ends with it, so runs are all that is counted.

Nulls: a null URL, or one without ``://``, has an empty host and path and no characters;
its score is 0 and it is allowed. Repeated URLs count as often as they stand there. Of rules
of equal length the later one counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm.shared import dropped, written
from wavesift.llm.textops import slices, utf8
from wavesift.llm.workers import mapped

#: (verdict, rule): host up to the first slash, then the path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Pages with fewer words, or more symbols a word, mark their URL as rejected.
MIN_WORDS, SYMBOLS = 20, 0.1
#: Share of accepted URLs beyond the cut at most.
FALSE = 0.01
#: Orders of the models; six characters of 9 bits and the order fit a key.
ORDERS = 6
#: Rows of a chunk, as a power of two, and distinct runs that a task counts before it hands them on.
CHUNK_BITS = 14
HELD = 1_000_000
#: Weight of the lower order's estimate, as so many observations.
SMOOTH = 2.0
#: Bins of a nat of score for the calibration.
BINS = 50


@dataclass(frozen=True)
class UrlModel:
    """counts: (gram, accepted, rejected); symbols and texts: how many were counted, accepted and rejected.

    held: shares of accepted and of rejected URLs of held-out hosts beyond the cut, None if there are no such URLs.
    """

    counts: DataFrame
    symbols: tuple[int, int]
    texts: tuple[int, int]
    cut: float = float("inf")
    held: tuple[float | None, float | None] = (None, None)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def poor(html: Column) -> Column:
    """Whether a page has few words outside of tags, or many symbols among them; null for a null page."""
    pieces = F.filter(F.split(F.concat(F.lit(">"), html), "<"), lambda p: ~p.rlike("(?i)^(?:script|style|!)"))
    text = F.array_join(F.transform(pieces, lambda p: F.regexp_replace(p, "^[^>]*>", " ")), "")
    text = F.regexp_replace(text, "&#?[A-Za-z0-9]+;", " ")
    words = F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]", ""))
    return (words < MIN_WORDS) | (symbols > SYMBOLS * words)


def _chars(host: Column, path: Column) -> Column:
    return F.regexp_replace(F.concat(host, path), "[0-9]+", "0")


def marked(pages: DataFrame, url: str = "url", html: str | None = "html", rules=RULES) -> DataFrame:
    """__chars to learn from, whether they are __rejected or __ruled, and whether the host is __held for the calibration."""
    host, path = host_and_path(F.col(f"`{url}`"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    page = F.lit(None).cast("boolean") if html is None else poor(F.col(f"`{html}`"))
    rows = pages.select(host.alias("host"), path.alias("path"), page.alias("page")).withColumns({"rule": rule, "verdict": verdict})
    named = F.substring_index("rule", "/", 1)
    prefix = F.length("rule") - F.length(named)
    rest_host = F.when(F.col("rule").isNull(), F.col("host")).otherwise(F.substring(F.col("host"), F.lit(1), F.length("host") - F.length(named)))
    rest_path = F.when(F.col("rule").isNull(), F.col("path")).otherwise(F.substring(F.col("path"), prefix + 1, F.length("path")))
    rejected = F.coalesce(F.col("verdict") == "block", F.col("page"))
    held = F.crc32(F.col("host")) % 4 == 2
    return rows.select(_chars(rest_host, rest_path).alias("__chars"), rejected.alias("__rejected"), held.alias("__held"), F.col("rule").isNotNull().alias("__ruled")).where("__rejected is not null and __chars <> ''")


def _grams(data: np.ndarray, offsets: np.ndarray):
    """For each order: document and place of every character with its end, and the key of the gram that ends there.

    A key has the last character in its lowest 9 bits, those before it above, and the order on top.
    """
    n_docs = len(offsets) - 1
    # 0: before the beginning, 1: end mark after each text, then the bytes
    text = np.insert(data.astype(np.int64) + 2, offsets[1:], 1)
    doc = np.repeat(np.arange(n_docs), np.diff(offsets) + 1)
    place = np.arange(len(text)) - (offsets[:-1] + np.arange(n_docs))[doc]
    gram = text.copy()
    for order in range(ORDERS):
        if order:
            before = np.zeros(len(text), np.int64)
            before[order:] = text[:-order]
            before[place < order] = 0
            gram |= before << (9 * order)
        yield doc, place, gram | (order << (9 * ORDERS))


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts and the sums of their counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def fit(pages: DataFrame, url: str = "url", html: str | None = "html", rules=RULES) -> UrlModel:
    """Count all marked URLs but those of the calibration hosts, then set the cut on these.

    With ``html=None`` the rules alone give marks.
    """
    rows = marked(pages, url, html, rules)

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = least = 0

        def out():
            keys, n = _tally(held)
            yield from pa.Table.from_arrays([pa.array(keys >> 1), pa.array(n * (1 - (keys & 1))), pa.array(n * (keys & 1))], names=["gram", "accepted", "rejected"]).to_batches(50_000)

        for batch in batches:
            for part in slices(batch, "__chars"):
                kind = part.column("__rejected").to_numpy(zero_copy_only=False).astype(np.int64)
                for doc, _, gram in _grams(*utf8(part.column("__chars"))):
                    held.append(np.unique(gram << 1 | kind[doc], return_counts=True))
                    size += len(held[-1][0])
                if size > least + HELD:
                    held = [_tally(held)]
                    size = least = len(held[0][0])
                if size > HELD:
                    yield from out()
                    held, size, least = [], 0, 0
        if held:
            yield from out()

    got = mapped(rows.where("not __held").select("__chars", "__rejected"), count, "gram long, accepted long, rejected long")
    counts = written(got.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-grams")
    # order 0 has a row for each character, and the end mark is in every text once
    ends, both = F.col("gram") == 1, ("accepted", "rejected")
    sums = counts.where(f"gram < {1 << 9}").agg(*[F.sum(c) for c in both], *[F.sum(F.when(ends, F.col(c))) for c in both]).first()
    total = [int(x or 0) for x in sums]
    model = UrlModel(counts, (total[0], total[1]), (total[2], total[3]))
    if not all(model.texts):
        return model
    judged = rows.where("__held") if html is None else rows.where("__held and not __ruled")
    held, chunked = _scored(judged.select("__chars", "__rejected"), model)
    bins = held.groupBy("__rejected", F.floor(F.col("score") * BINS).alias("bin")).count().collect()
    dropped(chunked)
    cut, shares = _cut([(r["__rejected"], r["bin"], r["count"]) for r in bins])
    return replace(model, cut=cut, held=shares)


def _cut(bins: list[tuple[bool, int, int]]) -> tuple[float, tuple[float | None, float | None]]:
    """A cut with at most FALSE of the accepted beyond it, and the shares of both beyond it.

    It is the least one, or lies halfway to the greatest that leaves at most FALSE of the rejected out, if that is farther.
    """
    total = [sum(n for rejected, _, n in bins if rejected is x) for x in (False, True)]
    beyond = lambda at: [sum(n for rejected, b, n in bins if rejected is x and b >= at) / total[x] if total[x] else None for x in (False, True)]
    if not total[0]:
        return float("inf"), (None, 0.0 if total[1] else None)
    at = next(b for b in sorted({b + 1 for _, b, _ in bins}) if beyond(b)[0] <= FALSE)
    if total[1]:
        far = max(b for b in {b for _, b, _ in bins} | {at} if b == at or beyond(b)[1] >= 1 - FALSE)
        at = max(at, (at + far) // 2)
    return at / BINS, tuple(beyond(at))


def log_ratio(keys: np.ndarray, counts: np.ndarray, symbols, texts, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log-likelihood as rejected less that as accepted, for each character, of every text.

    ``keys`` are sorted grams, ``counts`` (2, their number) how often they are in accepted and rejected URLs.
    """
    keys = np.append(keys, np.iinfo(np.int64).max)
    counts = np.append(counts, np.zeros((2, 1), np.int64), axis=1)
    prob = shorter = None
    for doc, place, gram in _grams(data, offsets):
        at = np.searchsorted(keys, gram)
        found = np.where(keys[at] == gram, counts[:, at], 0)
        if shorter is None:
            context = np.repeat(np.array(symbols)[:, None], len(gram), axis=1)
            prob = np.full((2, len(gram)), 1 / 257)
        else:
            context = np.where(place == 0, np.array(texts)[:, None], np.roll(shorter, 1, axis=1))
        prob = (found + SMOOTH * prob) / (context + SMOOTH)
        shorter = found
    ratio = np.log(prob[1]) - np.log(prob[0])
    size = np.diff(offsets)
    total = np.bincount(doc, ratio, len(size))
    return np.where(size > 0, total / (size + 1), 0.0)


def _runs(columns: list[np.ndarray]):
    """(from, to) of the runs of rows that are alike."""
    if len(columns[0]):
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(columns[0])]])
        yield from zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _scored(rows: DataFrame, model: UrlModel) -> tuple[DataFrame, DataFrame]:
    """The rows with the score of their __chars instead of them, and the written table that this reads."""
    kept = [c for c in rows.columns if c != "__chars"]
    chunked = written(rows.withColumn("__chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)), "url-rows")

    def grams(batches):
        now, held = None, []

        def out():
            if held:
                keys = np.unique(np.concatenate(held))
                yield from pa.Table.from_arrays([pa.array(np.full(len(keys), now, np.int64)), pa.array(keys)], names=["chunk", "gram"]).to_batches(50_000)

        for batch in batches:
            for part in slices(batch, "__chars"):
                chunk = part.column("__chunk").to_numpy()
                for lo, hi in _runs([chunk]):
                    if chunk[lo] != now:
                        yield from out()
                        now, held = chunk[lo], []
                    held.append(np.unique(np.concatenate([g for _, _, g in _grams(*utf8(part.column("__chars").slice(lo, hi - lo)))])))
        yield from out()

    known = mapped(chunked.select("__chars", "__chunk"), grams, "chunk long, gram long").join(model.counts, "gram")
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    both = known.select("chunk", F.lit(0).alias("side"), "gram", "accepted", "rejected").unionByName(
        chunked.select(F.col("__chunk").alias("chunk"), F.lit(1).alias("side"), F.col("__chars").alias("chars"), whole), allowMissingColumns=True
    )
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "side")
    symbols, texts = model.symbols, model.texts

    def score(batches):
        now, held, table = None, [], None
        for batch in batches:
            chunk, side = (batch.column(c).to_numpy() for c in ("chunk", "side"))
            for lo, hi in _runs([chunk, side]):
                part = batch.slice(lo, hi - lo)
                if chunk[lo] != now:
                    now, held, table = chunk[lo], [], None
                if side[lo] == 0:
                    held.append(np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gram", "accepted", "rejected")]))
                    continue
                if table is None:
                    table = np.concatenate([np.empty((3, 0), np.int64), *held], axis=1)
                    table, held = table[:, np.argsort(table[0], kind="stable")], []
                for piece in slices(part, "chars"):
                    ratio = log_ratio(table[0], table[1:], symbols, texts, *utf8(piece.column("chars")))
                    yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(ratio)], names=["row", "score"])

    schema = T.StructType([T.StructField("row", dealt.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    out = mapped(dealt, score, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "score"), chunked


def judge(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Add host, path, rule, score, verdict, and the held-out shares of the model's cut (accepted and rejected URLs beyond it) to every row."""
    new = ("host", "path", "rule", "score", "verdict", "held_accepted", "held_rejected")
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in new]
    # columns of the input have names of their own meanwhile
    own = {c: f"__in{i}" for i, c in enumerate(kept)}
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], host.alias("host"), path.alias("path")).withColumn("__chars", _chars(F.col("host"), F.col("path")))
    out, _ = _scored(rows, model)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    some = (F.col("host") != "") | (F.col("path") != "")
    method = F.when(some & (F.col("score") > model.cut), F.lit("block")).otherwise(F.lit("allow"))
    shares = {name: F.lit(share).cast("double") for name, share in zip(new[-2:], model.held)}
    judged = out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)} | shares)
    return judged.select(*[F.col(n).alias(c) for c, n in own.items()], *new)
