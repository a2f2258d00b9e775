"""Ball-tree clusters, fill-in-middle forms and secret scans against plain Python."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavesift.llm import automata, balls, fim, secret_scan


def plain_kmeans(rows, k, rounds):
    """(vec_id, cluster, distance) by the definition, with Python integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in drawn[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, g in groups.items():
            cents[n] = [sum(x) // len(g) for x in zip(*g)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), cents


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 64))
    rows = [(i, [float(x) for x in middles[i % 6] + rng.normal(size=64) * (0.01 if i % 2 else 0.3)], i) for i in range(400)]
    rows += [(i, rows[0][1], i) for i in range(400, 460)]  # copies
    bad = [None, [], [0.0] * 63, [None] + [0.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    rows += [(500 + i, v, 0) for i, v in enumerate(bad)]
    rows += [(None, [0.5] * 64, 1), (7, [0.25] * 64, 1), (7, [0.25] * 64, 2), (900, [0.0] * 64, 3)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(5)


@pytest.mark.parametrize("block", [16, 50, 4096])
def test_clusters_equal_the_definition_for_any_block(vectors, block):
    rows, df = vectors
    want, cents = plain_kmeans([r[:2] for r in rows], 9, 3)
    out = balls.clusters(df, k=9, rounds=3, block=block, keep=("vec_id", "cluster")).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in out) == want
    assert all(r.centroid == ",".join(map(str, cents[r.cluster])) for r in out)
    assert {r.inertia for r in out} == {sum(d for _, _, d in want)}
    for r in out:
        assert r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster)


def test_more_centroids_than_vectors_and_none(spark, vectors):
    _, df = vectors
    few = df.where("vec_id < 4")
    out = balls.clusters(few, k=40).collect()
    assert sorted(r.cluster for r in out) == [0, 1, 2, 3] and {r.inertia for r in out} == {0}
    nothing = balls.clusters(df.where("vec_id >= 500 and vec_id < 506"))
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_large_components_stay_exact_and_larger_ones_fail(spark):
    rows = [(i, [float((i * 7919 + j * 104729) % 500_000) for j in range(64)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, _ = plain_kmeans(rows, 4, 2)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in balls.clusters(df, k=4, rounds=2).collect()) == want
    with pytest.raises(Exception, match="beyond"):
        balls.clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"), k=1)


def test_whole_balls_skip_most_vectors_of_tight_groups():
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (8, 64))
    points = (middles[rng.integers(0, 8, 4096)] + rng.integers(-20, 20, (4096, 64))).astype(np.int64)
    tree, order = balls.build(points)
    assert (tree.points == points[order]).all() and tree.sums[0].tolist() == points.sum(0).tolist() and tree.counts[0] == 4096
    own = np.full(4096, -1)
    whole = 0
    for lo, hi, one, each, total in balls.descend(tree, middles):
        own[lo:hi] = one if each is None else each
        if each is None:
            whole += hi - lo
            assert total.tolist() == tree.points[lo:hi].sum(0).tolist()
    assert (own == balls.squares(tree.points, middles).argmin(1)).all()
    assert whole > 0.9 * 4096


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [1.0] * 64) for i in range(6)] + [(9, [-1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = balls.clusters(df, k=5, rounds=1).collect()
    one = {r.cluster for r in out if r.vec_id != 9}
    assert len(one) == 1 and {r.distance for r in out} == {0}
    assert out[0].asDict().keys() == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"}
    assert df.select(F.count("*")).first()[0] == 7


def plain_form(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    order = f"<S>{suffix}<P>{prefix}" if h[3] % 100 < spm else f"<P>{prefix}<S>{suffix}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", f"{order}<M>{middle}", len(prefix), len(middle)


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "<P", "a<P>b\n", "<<S>\nx", "x\n<M\n>", "<P <S <M\n", "é<漢\n字>\n", "<M>", "P>S>\n<\n"]
    texts += ["".join(rng.choice(["\n", "<", "P", ">", "é", "x" * rng.randrange(1, 90)]) for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += ["ab\n" * 3000, "z" * 9000, "é" * 4000 + "\n" + "<" * 500]
    rows = [(i, t, "kept", i) for i, t in enumerate(texts)]
    rows += [(100 + i, "ab\n" * 3000, "copy", i) for i in range(30)] + [(None, "q\nr\ns", None, 1), (None, "ab\n" * 3000, None, 2), (5, "one\n", "again", 3), (5, "one\n", "again", 3)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(4)


@pytest.mark.parametrize("chunk", [1, 5, 64, 1 << 16])
def test_forms_equal_the_definition_for_any_chunk(lined, chunk):
    rows, df = lined
    out = fim.transform(df, chunk=chunk, keep=("doc_id", "source", "n")).withColumn("back", fim.restored())
    got = sorted((str(r.doc_id), str(r.source), r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.back) for r in out.collect())
    want = sorted((str(i), str(s), *plain_form(i, t), t or "") for i, t, s, _ in rows)
    assert got == want
    assert out.columns == ["doc_id", "source", "n", "form", "output", "prefix_chars", "middle_chars", "back"]


def test_forms_with_rates_empty_table_and_long_text(spark, lined):
    rows, df = lined
    out = {(r.form) for r in fim.transform(df, rate=0).collect()}
    assert out == {"plain"}
    got = sorted((str(r.doc_id), r.form) for r in fim.transform(df, rate=50, spm=0).collect())
    assert got == sorted((str(i), plain_form(i, t, 50, 0)[1]) for i, t, *_ in rows)
    assert fim.transform(df.where("false")).count() == 0
    text = "".join(f"line {i} with some words\n" for i in range(400_000))  # 10 MB, beyond an Arrow batch
    row = fim.transform(spark.createDataFrame([(3, text)], "doc_id long, text string")).withColumn("back", fim.restored()).first()
    assert (row.n, row.form, row.output, row.prefix_chars, row.middle_chars, row.back) == (*plain_form(3, text), text)


def test_chunk_functions_compose_and_select_like_a_loop():
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"\n<PSM>ab", np.uint8), 3000)
    offsets = np.sort(np.concatenate([[0, 0, 3000, 3000], rng.integers(0, 3000, 9)]))
    s = automata.scan(fim.LINES, data, offsets)
    f = automata.functions(s)
    for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
        for entry in range(8):
            state, places = entry, []
            for at in range(lo, hi):
                symbol = fim.LINES.symbols[data[at]]
                places += [at - lo] * int(fim.LINES.emits[state, symbol])
                state = fim.LINES.table[state, symbol]
            assert (f.ends[i, entry], f.counts[i, entry]) == (state, len(places))
            k = np.arange(1, len(places) + 1)
            assert automata.select(s, np.full(len(k), i), np.full(len(k), entry), k).tolist() == places
    pair = automata.Functions(f.ends[3:4], f.counts[3:4]).then(automata.Functions(f.ends[4:5], f.counts[4:5]))
    both = automata.functions(automata.scan(fim.LINES, data, offsets[[3, 5]]))
    assert (pair.ends == both.ends).all() and (pair.counts == both.counts).all()


BASE = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in BASE.finditer(text) if len(m.group(2)) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [(secret_scan.KINDS[k], s, e) for s, k, e in sorted(spans)]


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(11)
    syllables = ["ta", "ren", "ing", "the", "of", "lo", "qui", "ver", "ment", "s", "an", "Gro", "ti", "É", "on"]
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 6))) for _ in range(n))
    make = {
        "base64": lambda n: base64.b64encode(rng.randbytes(n)).decode().rstrip("="),
        "base64url": lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("="),
        "base32": lambda n: base64.b32encode(rng.randbytes(n)).decode().rstrip("="),
        "hex_upper": lambda n: rng.randbytes(n).hex().upper(),
    }
    rows, planted = [], []
    for i in range(400):
        text = prose(rng.randrange(20, 300))
        if i % 8 == 0:
            value = make[list(make)[i // 8 % 4]](36)
            before = prose(5) + " é "
            text = f"{before}{value} {text}"
            planted.append((i, len(before), len(before) + len(value)))
        rows.append((i, text, "s"))
    odd = [None, "", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789" * 4, "a" * 50, "AKIA" + "B7" * 8 + " AKIAshort AKIAKIA" + "X" * 14, "é token = 'abcdefghijkl.mnop' ſecret: abcdefghijklmnop",
           "password: token = abcdefghijklmnop", "API_KEY=abcdefghijk apikey='ABCDEFGHIJKL'", "x0123456789abcdef0123456789ABCDEFg", "secret:" + "ab" * 40, "path/to/some/where/under-the_hills/of/long/names/and+more", "4f" * 300_000]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd)] + [(None, "TOKEN:" + "z" * 12, "n"), (3, rows[3][1], "again")]
    return rows, planted, spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)


def test_base_spans_equal_plain_patterns_and_random_runs_are_found(leaky):
    rows, planted, df = leaky
    out = secret_scan.scan(df).withColumn("base", secret_scan.as_text("spans", secret_scan.KINDS[:3])).collect()
    got = sorted((str(r.doc_id), r.base) for r in out)
    assert got == sorted((str(i), ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(t))) for i, t, _ in rows)
    added = sorted((r.doc_id, s.start, s.end) for r in out for s in r.spans if s.kind == "random")
    assert len(set(added) & set(planted)) >= 0.9 * len(planted)
    assert len(set(added) - set(planted)) <= 1
    order = [[(s.start, secret_scan.KINDS.index(s.kind)) for s in r.spans] for r in out]
    assert all(o == sorted(o) for o in order)


def test_no_rows_and_no_ordinary_text_add_nothing(spark, leaky):
    assert secret_scan.scan(leaky[2].where("false")).count() == 0
    alone = spark.createDataFrame([(1, "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3ODkw")], "doc_id long, text string")
    assert [len(r.spans) for r in secret_scan.scan(alone).collect()] == [0]


def test_statistics_of_runs_equal_plain_sums():
    texts = [b"Zm9vYmFyIGJheiBxdXV4Cg", b"0123456789abcdef", b"GEZDGNBVGY3TQOJQ", b"a-b_c" * 5, b"AB/+" * 6, b"zz9" * 9]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    table, good = secret_scan._statistics(data, end - [len(t) for t in texts], end)
    assert good.all()
    for row, text in zip(table.tolist(), texts):
        name, alphabet = list(secret_scan.ENCODINGS.items())[row[0]]
        assert next(n for n, a in secret_scan.ENCODINGS.items() if set(text.decode()) <= set(a)) == name
        v, size = [alphabet.index(c) for c in text.decode()], len(alphabet)
        high = [2 * x >= size for x in v]
        centred = [2 * x - size + 1 for x in v]
        equal = sum(a == b for i, a in enumerate(v) for b in v[:i])
        assert row[1:] == [len(v), equal, sum(a != b for a, b in zip(high, high[1:])), sum(a * b for a, b in zip(centred, centred[1:]))]
        chi = sum((v.count(x) - len(v) / size) ** 2 for x in range(size)) * size / len(v)
        assert math.isclose(chi, size / len(v) * (2 * equal + len(v)) - len(v), abs_tol=1e-9)


def test_discoveries_keep_false_ones_below_the_limit():
    rng = np.random.default_rng(9)
    true, false = rng.normal(8, 4, 300), rng.normal(-8, 4, 20_000)
    step = lambda x: (0, int(np.clip(np.floor(x / secret_scan.STEP), -160, 160)))
    counts = {}
    for x in [*true, *false]:
        counts[step(x)] = counts.get(step(x), 0) + 1
    taken = secret_scan.discoveries(counts)
    hits, errors = sum(step(x) in taken for x in true), sum(step(x) in taken for x in false)
    assert hits > 150 and errors <= 0.03 * hits
    assert secret_scan.discoveries({}) == set()
