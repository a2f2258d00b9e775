"""Operators over documents against plain Python versions, on awkward rows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavesift.llm import jaccard, packing, pieces, quality, substrings, suffixes, toxicity
from wavesift.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(docs):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())


def covered(n, starts, width):
    gone = [False] * n
    for s in starts:
        gone[s : s + width] = [True] * width
    return gone


def repeats(sequences, width):
    """Starts of windows that occur twice or more anywhere, of each sequence."""
    seen = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    return [[i for i in range(len(s) - width + 1) if seen[tuple(s[i : i + width])] > 1] for s in sequences]


def test_substrings(docs, empty):
    rows = texts(docs)
    seqs = [WORD.findall(t) for _, t in rows]
    want = []
    for (i, _), s, starts in zip(rows, seqs, repeats(seqs, 35), strict=True):
        gone = covered(len(s), starts, 35)
        want.append((i, len(s), sum(gone), " ".join(w for w, g in zip(s, gone, strict=True) if not g)))
    got = substrings.dedup(docs)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == sorted(want)
    assert substrings.dedup(empty).count() == 0


@pytest.mark.parametrize("group", [20_000, 2])
def test_suffixes(docs, empty, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP_RECORDS", group)
    rows = texts(docs)
    seqs = [t.encode() for _, t in rows]
    want = []
    for (i, _), s, starts in zip(rows, seqs, repeats(seqs, 200), strict=True):
        gone = covered(len(s), starts, 200)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        want.append((i, len(s), sum(gone), spans, bytes(b for b, g in zip(s, gone, strict=True) if not g)))
    got = suffixes.repeated(docs)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()) == sorted(want)
    assert suffixes.repeated(empty).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rng = np.random.default_rng(1)
    runs = [sorted(bytes(rng.integers(97, 100, rng.integers(1, 30)).tolist()) for _ in range(rng.integers(0, 60))) for _ in range(7)]
    coded = []
    for keys in runs:
        shared = suffixes.shared_prefixes(keys).tolist()
        coded.append([(s, k, i) for i, (s, k) in enumerate(zip(shared, keys, strict=True))])
    got = list(suffixes.merge_runs(coded))
    want = sorted(k for r in runs for k in r)
    assert [g[1] for g in got] == want
    for a, b in zip(got[1:], want, strict=False):
        n = 0
        while n < min(len(a[1]), len(b)) and a[1][n] == b[n]:
            n += 1
        assert a[0] == n


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("block, same_names", [(512, False), (2, False), (512, True)])
def test_jaccard(spark, docs, empty, monkeypatch, block, same_names):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    if same_names:  # one in four classes has the name of another one
        keys = jaccard._class_keys
        monkeypatch.setattr(jaccard, "_class_keys", lambda *x: ((k := keys(*x))[0] & 3, k[1]))
    rng = np.random.default_rng(2)
    base = [f"v{i}" for i in rng.integers(0, 4000, 400)]
    more = [(100 + i, " ".join(w if rng.random() > 0.01 * (i % 5) else "z" for w in base[: 380 + i])) for i in range(20)]
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()] + more
    sets = [shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}
    want = sorted((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = jaccard.similar(df)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == want
    kept = out.where("is_representative and n_shingles > 0").groupBy("component_id").count()
    assert kept.where("count <> 1").count() == 0
    assert jaccard.similar(empty).count() == 0 and jaccard.similar(docs).count() == docs.count()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 50), (70, 70)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[60] == 50 and 70 not in got


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        by_doc.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append(r)
        assert r["offset"] + r["length"] <= 2048
    for i, t in texts(docs.where("doc_id <> 7")):
        ids = model.encode(t, add_special_tokens=False).ids + [1]
        found = b"".join(bytes(r["ids"]) for r in sorted(by_doc[i, len(ids)], key=lambda r: r["start"]))
        assert np.frombuffer(found, "<u4").tolist() == ids
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert sorted(filled) == list(range(len(filled))) and all(filled[k] == 2048 for k in list(filled) if k < len(filled) - 1)
    assert packing.pack(empty).count() == 0


def test_pieces_like_the_library(docs, empty):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(pieces.model_path(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1  # segment the same pieces by Viterbi
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    words = pieces.vocabulary(pieces.model_path())
    score = lambda ids: sum(library.get_score(i) if not library.is_byte(i) else 0 for i in ids)
    for text in ("hello world", "  two  spaces\n\nand lines\t", "straße 漢字 ok", "a" * 50, "The quick (brown) fox; 12345"):
        ids, off = words.encode(__import__("pyarrow").array([text]))
        assert off.tolist() == [0, len(ids)]
        theirs = library.encode(text)
        assert score(ids.tolist()) == pytest.approx(score(theirs)) and library.decode(ids.tolist()) == library.decode(theirs)
    out = pieces.decode(pieces.encode(docs))
    assert out.where(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert out.where("text is null and n_ids > 0").count() == 0
    assert pieces.decode(pieces.encode(empty)).count() == 0


def test_quality(docs, labels, empty):
    model = quality.fit(docs, labels)
    for r in quality.judge(docs, model).collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        (again,) = repeats([w], 8)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        repeated = sum(covered(len(w), again, 8))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * repeated > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(empty, quality.fit(empty, labels)).count() == 0


def line_features(text):
    """The lines with words of a text, and their features, in plain Python."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    every = WORD.findall(text)
    (starts,) = repeats([every], 8)
    again, at, seen, out = covered(len(every), starts, 8), 0, set(), []
    for line in lines:
        w = WORD.findall(line)
        n, raw = len(w), line.encode()
        letters = max(sum(b >= 128 or chr(b).isalpha() for b in raw), 1)
        out.append([
            1, min(sum(c in "#*$%&|<>" for c in line) / n, 2), sum("A" <= c <= "Z" for c in line) / letters, min(line.count("!") / n, 2), min(line.count("|") / n, 1),
            sum("0" <= c <= "9" for c in line) / len(raw), min(len(raw) / n, 20) / 10, min(np.log1p(n), 6) / 3, line in seen, sum(again[at : at + n]) / n,
            sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, raw[-1:] == b".", n < 4, 1 / len(lines),
        ])
        seen.add(line)
        at += n
    return lines, np.array(out, float).reshape(len(lines), quality.N_FEATURES)


def best_labels(score, step):
    """The best path, by all of its best beginnings."""
    paths = {0: (0.0, []), 1: (0.0, [])}
    for t, s in enumerate(score):
        paths = {b: max((v + (step[a, b] if t else 0) + (s if b else 0), p + [b]) for a, (v, p) in paths.items() if t or a == b) for b in (0, 1)}
    return max(paths.values())[1] if len(score) else []


def test_quality_verdicts_against_plain_python(spark, docs, labels):
    rng = np.random.default_rng(6)
    weights = np.array([0.3, -3, -2, -3, -4, -3, 0.1, 0.5, -0.6, -1, -2, 1.4, -0.1, 1.0])  # some for either label
    model = quality.LineModel(weights, np.array([[0.2, -0.1], [-0.3, 0.1]]))
    menu = ["Home | News | About", "!!! BUY NOW !!! 100% $$$", "a short line.", "the quick brown fox jumps over the lazy dog again and again.", "one one one two two", "#*$ %&|<>"]
    mixed = [(100 + i, "\n".join(rng.choice(menu, rng.integers(1, 30)))) for i in range(60)]
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()] + mixed
    got = {(r["doc_id"], r["text"]): r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()}
    contents = set()
    for key in rows:
        lines, x = line_features(key[1] or "")
        label = best_labels((x.astype(np.float32).astype(float) @ model.weights).tolist(), model.step)
        content = sum(len(WORD.findall(line)) for line, k in zip(lines, label, strict=True) if k)
        r = got[key]
        assert r["content_words"] == content and r["kept"] == (not r["base_failed"] and 2 * content >= r["n_words"])
        contents.add(content / max(r["n_words"], 1))
    assert len(contents) > 15


def test_quality_gradient():
    rng = np.random.default_rng(7)
    x, size = rng.normal(size=(3, 4, quality.N_FEATURES)), np.array([4, 1, 3])
    mark = rng.integers(0, 2, (3, 4)).astype(float)

    def value(theta):
        w, step = theta[: quality.N_FEATURES], theta[quality.N_FEATURES :].reshape(2, 2)
        total = 0.0
        for d in range(3):
            s = x[d, : size[d]] @ w
            path = lambda p, s=s: sum(a * b for a, b in zip(s, p, strict=True)) + sum(step[int(a), int(b)] for a, b in zip(p, p[1:], strict=False))
            every = [path([int(c) for c in f"{k:0{size[d]}b}"]) for k in range(2 ** size[d])]
            total += path(mark[d, : size[d]].tolist()) - np.log(np.exp(every).sum())
        return total

    theta = rng.normal(size=quality.N_FEATURES + 4)
    g_w, g_s = quality._likelihood(quality.LineModel(theta[: quality.N_FEATURES], theta[quality.N_FEATURES :].reshape(2, 2)), [(x, mark, size)])
    steps = np.eye(len(theta)) * 1e-6
    np.testing.assert_allclose(np.r_[g_w, g_s.ravel()], [(value(theta + h) - value(theta - h)) / 2e-6 for h in steps], atol=1e-6)


def test_quality_finds_planted_boilerplate_in_good_texts(spark):
    """Lines of a kind that only whole rejected documents had in training, before, behind and inside good ones."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    good = lambda: " ".join(word() for _ in range(rng.integers(12, 25))).capitalize() + "."
    menu = lambda: " | ".join(word().upper() for _ in range(rng.integers(2, 5)))
    rows = [(i, "\n".join((menu if i % 4 == 0 else good)() for _ in range(rng.integers(3, 12))), int(i % 4 > 0)) for i in range(400)]
    fitted = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(fitted.drop("quality"), fitted.select("doc_id", "quality"))
    planted, want = [], {}
    for i in range(60):
        lines, extra = [good() for _ in range(8)], [menu() for _ in range(1 + i % 6)]
        cut = (0, 4, 8)[i % 3]
        planted.append((i, "\n".join(lines[:cut] + extra + lines[cut:])))
        want[i] = sum(len(x.split()) for x in lines)
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(planted, "doc_id long, text string"), model).collect()}
    assert np.mean([got[i]["content_words"] == n for i, n in want.items()]) >= 0.9 and all(got[i]["kept"] for i in want)


def test_quality_held_out(spark):
    """Labelled rows beyond those of the fit: good ones stay, most bad ones go."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("doc_id is not null and quality is not null")
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    fitted = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(500)
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(marks, "doc_id")
    model = quality.fit(docs, labels, max_rows=500)
    got = quality.judge(docs.join(fitted, "doc_id", "left_anti"), model).where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    shares = {r["quality"]: r["kept"] for r in got.collect()}
    assert shares[1] >= 0.98 and shares[0] <= 0.1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    step = rng.normal(size=(2, 2))
    doc = np.repeat([0, 1, 2], [1, 6, 4])
    score = rng.normal(size=11)
    got = quality.viterbi(score, doc, step)
    for d in range(3):
        s = score[doc == d]
        value = lambda p, s=s: sum(x * y for x, y in zip(s, p, strict=True)) + sum(step[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(value([int(c) for c in f"{k:0{len(s)}b}"]) for k in range(2 ** len(s)))
        assert value(got[doc == d].tolist()) == pytest.approx(best)


def test_maximal_segments():
    rng = np.random.default_rng(4)

    def brute(x, lo=0):
        """The best segment, then those left and right of it."""
        best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return brute(x[:i], lo) + [(lo + i, lo + j, best[0])] + brute(x[j:], lo + j)

    for _ in range(50):
        x = rng.normal(size=rng.integers(0, 14)).tolist()
        got = toxicity.maximal_segments(x)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(x)]


def plain_score(model, text):
    """Score, passages and best passage of a text, one token at a time."""
    import math

    folded = "".join(c.lower() if c.isascii() or "\u00c0" <= c <= "\u00de" and c != "\u00d7" else c for c in text)
    found = re.findall(r"(?:[a-zA-Z]|[^\x00-\x7f])+", folded)
    table = [dict(zip(k.tolist(), v.tolist(), strict=True)) for k, v in ((model.word_keys, model.word_scores), (model.stem_keys, model.stem_scores))]

    def of(token):
        raw = np.frombuffer(token.encode(), np.uint8)
        word, stem, _ = toxicity._tokens(raw, np.array([0, len(raw)]))
        return table[0].get(int(word[0]), table[1].get(int(stem[0]), model.unseen))

    x = [float(np.float32(of(t))) for t in found]
    n = len(x)

    def best_first(lo, hi):
        total, least, best, start = 0.0, 0.0, (0.0, 0, 0), lo
        for i in range(lo, hi):
            total += x[i]
            if total - least > best[0] + 1e-12:
                best = (total - least, start, i + 1)
            if total <= least:
                least, start = total, i + 1
        if best[0] <= 1e-12:
            return []
        return [*best_first(lo, best[1]), best, *best_first(best[2], hi)]

    segments = best_first(0, n)
    if not segments:
        x = -8.0
        return 1 / (1 + math.exp(-(model.slope * x + model.offset))), 0, (0, 0)
    size = math.log(n) + model.log_k
    strong = [s for s in segments if s[0] >= (size - math.log(toxicity.SIGNIFICANT)) / model.lam]
    value = model.lam * sum(s[0] for s in strong) - len(strong) * size if strong else model.lam * max(segments)[0] - size
    ranked, begins = [], set()
    for s in sorted(segments, key=lambda s: -s[0]):
        if found[s[1]] not in begins:
            begins.add(found[s[1]])
            ranked.append(s[0])
    surprise = 0.0
    for r, s in enumerate([s for s in ranked if s >= model.floor], 1):
        expected = math.exp(model.log_k + math.log(n) - model.lam * s)
        if expected < r:
            surprise = max(surprise, expected - r * math.log(max(expected, 1e-300)) + math.lgamma(r + 1) + math.log1p(-expected / (r + 1)))
    value = min(max(max(value, surprise) if surprise > 0 else value, -8.0), 40.0)
    top = max(segments, key=lambda s: (s[0], -s[1]))
    return 1 / (1 + math.exp(-(model.slope * value + model.offset))), len(strong), top[1:]


def test_toxicity_scores_against_plain_python(spark, docs):
    rng = np.random.default_rng(9)
    clean = ["table", "Ärger", "river", "straße", "window", "garden", "stone", "École", "paper", "cloud"]
    bad = ["vile", "VILE", "rotten", "scum", "Ünrat"]
    rows = [(i, " ".join([*rng.choice(clean, rng.integers(5, 60)), *rng.choice(bad, 6 * int(i % 5 == 0)), *rng.choice(clean, 5)]), int(i % 5 == 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    given = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()] + [(1000 + i, t) for i, t, _ in rows[:80]] + [(2000 + i, " ".join(rng.choice(clean + bad, 120))) for i in range(40)]
    got = {(r["doc_id"], r["text"]): r for r in toxicity.score(spark.createDataFrame(given, "doc_id long, text string"), model).collect()}
    some = set()
    for key in given:
        score, n, span = plain_score(model, key[1] or "")
        r = got[key]
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["n_passages"] == n and r["predicted"] == (r["score"] >= 0.3)
        assert (r["passage_start"], r["passage_end"]) == span
        some.add(n)
    assert len(some) > 1


def test_rank_surprise_bounds_the_poisson_tail():
    def tail(r, e):
        term, below = np.exp(-e), 0.0
        for k in range(r):
            below += term
            term *= e / (k + 1)
        return 1 - below

    for expected in ([0.2], [0.01, 0.3, 0.4], [0.5, 0.6, 0.7, 0.9], [2.0, 2.5], [1e-4, 5.0]):
        exact = max(-np.log(tail(r, e)) for r, e in enumerate(expected, 1) if e < r) if any(e < r for r, e in enumerate(expected, 1)) else 0.0
        got = toxicity.rank_surprise(np.array(expected))
        assert got <= exact + 1e-9 and got == pytest.approx(exact, abs=0.5)
    assert toxicity.rank_surprise(np.empty(0)) == 0.0


def test_logistic_fits_the_shares():
    x = np.repeat([-8.0, 0.0, 2.0, 40.0], 100)
    y = np.concatenate([np.arange(100) < k for k in (2, 10, 40, 100)]).astype(float)
    slope, offset = toxicity._logistic(x, y)
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    assert slope > 0 and p.sum() == pytest.approx(y.sum(), abs=0.1)


def test_toxicity_held_out(spark):
    """The quarter no label is learnt from: most toxic texts found, few clean ones flagged."""
    from wavesift.llm import queries

    folder = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = queries.op10_toxicity(spark, folder).where("held_out").join(marks, "doc_id").toPandas()
    toxic = got["toxic"] == 1
    assert got["predicted"][toxic].mean() >= 0.85 and got["predicted"][~toxic].mean() <= 0.05


def test_toxicity(spark, docs, labels, empty):
    rng = np.random.default_rng(5)
    clean = [f"w{i}" for i in range(300)]
    names = [chr(97 + i // 26) + chr(97 + i % 26) + "tone" for i in range(300)]
    rows = [(i, " ".join([*(names[k] for k in rng.integers(0, 300, 60)), *(["badword", "vile"] * 4 if i % 6 == 0 else [])]), int(i % 6 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.score(df, toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))).toPandas()
    assert ((out["score"] >= 0) & (out["score"] <= 1)).all() and (out["predicted"] == out["toxic"]).mean() > 0.98 and clean
    got = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas()
    assert len(got) == docs.count() and got["score"].notna().all()
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_extra_columns_with_clashing_names(spark, docs):
    clash = docs.withColumns({"kept": F.lit("mine"), "n_words": F.lit(1), "component_id": F.lit("c"), "ids": F.lit(2), "a.b": F.lit(3), "__cls": F.lit(4)})
    import corpus_pipeline

    out = corpus_pipeline.jaccard_stage(spark, clash, "")
    assert out.columns == clash.columns and out.where("kept <> 'mine'").count() == 0
    cut = corpus_pipeline.suffix_stage(spark, clash, "")
    assert cut.columns == clash.columns and cut.where("n_chars <> char_length(text)").count() == 0


def test_columns_of_the_input_keep_their_values(spark, docs):
    """Names that operators add are replaced, all others stay, also those that operators use inside."""
    clash = docs.withColumns({c: F.lit("mine") for c in ("kept", "ids", "n_words", "n_ids", "decoded", "__a", "__b", "__once", "__once_a", "text_a", "a.b", "Score", "part")})
    mine = [c for c in clash.columns if c not in docs.columns]
    for out, new in (
        (substrings.dedup(clash, keep=clash.columns), {"n_words", "n_removed", "kept"}),
        (suffixes.repeated(clash, keep=clash.columns), {"n_bytes", "n_removed", "n_spans", "kept"}),
        (pieces.decode(pieces.encode(clash)), {"ids", "n_ids", "n_byte_ids", "decoded"}),
        (quality.judge(clash, quality.LineModel(np.zeros(quality.N_FEATURES), np.zeros((2, 2)))), {n for n, _ in quality.FIELDS}),
    ):
        assert new <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        rows = out.collect()
        assert len(rows) == docs.count() and all(r[c] == "mine" for r in rows for c in mine if c not in new)
