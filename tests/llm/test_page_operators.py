"""URL filter, layout extraction and vector search."""

import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavesift.llm import ann, layout, urls


def test_url_rules(spark):
    rows = ["http://A.Example.NET/en/x?q=/y", "https://example.net/enx", "http://net/", "http://x.net", "ftp://example.com/de/#t", "http://b.org/fr/", "//b.org/fr/", None, "", "http://notnet/", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("html", F.lit("<p>a"))
    got = {r["page_id"]: r for r in urls.judge(df, urls.fit(df)).collect()}
    want = {0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/enx", "net/", "block"), 2: ("net", "/", "net/", "block"), 4: ("example.com", "/de/", "example.com/de/", "block"), 5: ("b.org", "/fr/", "org/fr/", "allow")}
    for i, w in want.items():
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == w
    assert (got[3]["host"], got[3]["path"], got[3]["rule"]) == ("x.net", "", None)
    for i in (6, 7, 8):
        assert (got[i]["host"], got[i]["path"], got[i]["score"], got[i]["verdict"]) == ("", "", 0.0, "allow")
    assert got[10]["host"] == "b:" and got[9]["rule"] is None
    assert urls.judge(df.limit(0), urls.fit(df.limit(0))).count() == 0


FINE, POOR = "<html><script>x()</script><p>" + "plain words of a page " * 10 + "</p>", "<p>$$$ buy ### now *** here</p>"


def test_url_models_find_unseen_hosts(spark):
    """Names of hosts with poor pages are learnt, no list gives them; hosts of the test are none of the training."""
    rng = np.random.default_rng(1)
    good = ["garden", "music", "river", "school", "travel", "kitchen"]
    bad = ["zlotto", "quickcash", "xxwin"]
    name = lambda i: f"{rng.choice(bad)}{rng.choice(['-win', '-best', 'now'])}{i}" if i % 5 == 0 else f"{rng.choice(good)}{rng.choice(good)}{i}"
    rows = [(i, f"https://{name(i)}.example.com/p/{i}", None if i % 11 == 0 else POOR if i % 5 == 0 else FINE) for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = urls.fit(df)
    assert model.held[0] <= urls.FALSE and model.held[1] >= 0.9
    new = [(i, f"https://{name(i)}.example.com/p/{i}") for i in range(2000, 2400)]
    got = urls.judge(spark.createDataFrame(new, "page_id long, url string"), model).toPandas()
    assert ((got["verdict"] == "block") == (got["page_id"] % 5 == 0)).mean() > 0.98


def test_url_models_without_a_difference_block_few_and_say_so(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"https://h{rng.integers(0, 400)}x.example.com/p", POOR if i % 3 == 0 else FINE) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = urls.fit(df)
    assert model.held[0] <= urls.FALSE and 0 <= model.held[1] < 0.1
    out = urls.judge(df, model).toPandas()
    assert (out["verdict"] == "block").mean() < 0.03 and set(zip(out["held_accepted"], out["held_rejected"])) == {model.held}
    # no rule fits and no page is looked at: nothing to learn from
    assert urls.judge(df, urls.fit(df, html=None)).where("verdict = 'block'").count() == 0


def test_rules_alone_teach(spark):
    """Hosts that rules reject have names of their own; without pages others of such names are blocked too."""
    rng = np.random.default_rng(3)
    name = lambda bad, i: f"{rng.choice(['zlotto', 'quickcash', 'xxwin'] if bad else ['garden', 'music', 'river'])}{i}"
    rows = [(i, f"https://{name(True, i)}.net/p" if i % 2 else f"https://{name(False, i)}.org/fr/p") for i in range(1200)]
    model = urls.fit(spark.createDataFrame(rows, "page_id long, url string"), html=None)
    assert model.held[0] <= urls.FALSE and model.held[1] > 0.9
    new = [(i, f"https://{name(i % 2 == 1, i)}./q") for i in range(3000, 3200)]
    got = urls.judge(spark.createDataFrame(new, "page_id long, url string"), model).toPandas()
    assert ((got["verdict"] == "block") == (got["page_id"] % 2 == 1)).mean() > 0.95


def test_marks_come_from_rules_and_pages(spark):
    rows = [
        ("http://a1.b.net/x/2", FINE, "a0.b.x/0", True), ("http://w.example.net/en/p", POOR, "w.p", False), ("http://q.example.com/de/1", None, "q.0", True), ("http://q.org/fr/z", POOR, "q.z", False),
        ("http://q.com/p", POOR, "q.com/p", True), ("http://q.com/r", FINE, "q.com/r", False), ("http://q.com/s", "", "q.com/s", True), ("http://q.com/t", None, None, None), ("net", FINE, None, None), (None, FINE, None, None), ("http://net/", FINE, None, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "url string, html string")
    got = [(r["__chars"], r["__rejected"]) for r in urls.marked(df).collect()]
    assert sorted(got) == sorted((c, m) for _, _, c, m in rows if c is not None)


@pytest.mark.parametrize("html, want", [(None, None), ("", True), (FINE, False), (POOR, True), ("<style>" + "p{} " * 50 + "</style><p>few", True), ("word " * 30 + "&amp;&nbsp;" * 20, False), ("word " * 30 + "| " * 20, True), ("<a href='x|y|z'>" * 30 + "word " * 30, False)])
def test_poor_pages(spark, html, want):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(urls.poor(F.col("html"))).first()[0] is want


def test_clashing_columns_long_urls_and_ties_of_rules(spark):
    long = "http://x.com/" + "ab/" * 200_000
    df = spark.createDataFrame([("u", long, "mine", 1.5, "m"), ("u", "http://net/", "mine", 1.5, "m")], "`a.b` string, url string, host string, score double, __chars string")
    got = urls.judge(df, urls.fit(df, html=None), keep=["a.b", "url", "__chars"]).collect()
    assert {(r["a.b"], r["__chars"], r["host"]) for r in got} == {("u", "m", "x.com"), ("u", "m", "net")} and {r["url"] for r in got} == {long, "http://net/"}
    assert urls.judge(df, urls.fit(df, html=None)).columns == ["a.b", "url", "__chars", "host", "path", "rule", "score", "verdict", "held_accepted", "held_rejected"]
    tied = (("block", "com/"), ("allow", "com/"))
    assert urls.judge(df, urls.fit(df, html=None, rules=tied), tied).where("rule = 'com/'").first()["verdict"] == "allow"


def test_url_counts_are_exact_at_any_size(spark, monkeypatch):
    """More distinct contexts than any fixed table held, against plain Python."""
    rng = np.random.default_rng(3)
    letters = np.array(list("bcdfghjklmnpqrstvwxyz-"))
    rows = [(i, f"https://{'casino-' if i % 7 == 0 else ''}{''.join(rng.choice(letters, 30))}.org/{''.join(rng.choice(letters, 30))}") for i in range(2500)]
    counts = [Counter(), Counter()]
    for _, url in [*rows, rows[5]]:
        if zlib.crc32(url.split("/")[2].encode()) % 4 != 2:
            text = ["^"] * 5 + list(url.removeprefix("https://")) + ["$"]
            for at in range(5, len(text)):
                for order in range(6):
                    gram, kind = tuple(text[at - order : at + 1]), "casino-" in url
                    counts[kind][gram] += 1
                    counts[kind][gram[:-1], order] += 1
    assert len({g for c in counts for g in c}) > 3 * 2**17

    def plain(url):
        text, total = ["^"] * 5 + list(url.removeprefix("https://")) + ["$"], 0.0
        for at in range(5, len(text)):
            prob = [1 / 257, 1 / 257]
            for order in range(6):
                gram = tuple(text[at - order : at + 1])
                prob = [(c[gram] + 2 * p) / (c[gram[:-1], order] + 2) for c, p in zip(counts, prob, strict=True)]
            total += np.log(prob[1]) - np.log(prob[0])
        return total / (len(text) - 5)

    monkeypatch.setattr(urls, "CHUNK_BITS", 6, raising=False)
    monkeypatch.setattr(urls, "HELD", 50_000, raising=False)
    df = spark.createDataFrame([*rows, rows[5]], "page_id long, url string").repartition(3).withColumn("html", F.when(F.col("url").contains("casino-"), POOR).otherwise(FINE))
    got = urls.judge(df, urls.fit(df), keep=["page_id"]).toPandas()
    assert sorted(got["page_id"]) == sorted([*range(2500), 5])
    got = got.set_index("page_id")["score"]
    np.testing.assert_allclose([got[i] for i in range(100, 300)], [plain(rows[i][1]) for i in range(100, 300)], rtol=1e-9)


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<div>a</div>b<span> c</span>", "a\nb c"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>d", "- a\n- b\n  1. c\n\nd"), ("<ol start=4><li>x<li value=9>y<li>z</ol>", "4. x\n9. y\n10. z"),
    ("<table><tr><th>n<th>v<tr><td>long<td>1</table>", "n     v\nlong  1"), ("<table><td>a<td>b</table>", "a  b"), ("<table><tr><td>a<p>b<td>c</table>", "a  c\n\nb"),
    ("<style>.x{display:none}</style><p class='q x'>no</p>y", "y"), ("<p style='Display : none'>no<p>y", "y"), ("<b hidden>n</b>y", "y"),
    ("<div style='visibility:hidden'>n<i style='visibility:visible'>y</i></div>", "y"), ("<script>'<p>'</script>y", "y"), ("<pre>\na\n  b</pre>", "a\n  b"),
    ("<title>t</title>y", "y"), ("&lt;a&gt; &amp;&nbsp;b", "<a> & b"), ("<a href='>'>x</a>", "x"), ("x<!-- <p> -->y", "xy"), ("<details><summary>s</summary>n</details>", "s"),
    ("<b><p>x</b>y</p>z", "xy\n\nz"), ("a < b", "a < b"), ("<head><title>t</title><p>x", "x"), ("x<p", "x"), ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"),
])
def test_layout(html, want):
    assert layout.text_of(html or "") == want


@pytest.mark.parametrize("css, html, want", [
    ("@media print{.x{display:none}}", "<p class=x>y", "y"), ("@media (max-width:600px){.x{display:none}}", "<p class=x>y", "y"), ("@media print{.q{color:red}.x{display:none}}", "<p class=x>y", "y"),
    ("@media screen and (min-width: 600px){.x{display:none}}", "<p class=x>n</p>y", "y"), ("@media print{.q{color:red}} .x{display:none}", "<p class=x>n</p>y", "y"), ("@import 'a.css'; .x{display:none}", "<p class=x>n</p>y", "y"),
    (".x{display:none} .x{display:block}", "<p class=x>y", "y"), (".x{display:block} .x{display:none}", "<p class=x>n</p>y", "y"), (".x{display:none}", "<p class=x style='display:block'>y", "y"),
    (".x{display:none!important}", "<p class=x style='display:block'>n</p>y", "y"), ("#i{display:block} .x{display:none}", "<p class=x id=i>y", "y"), (".x{display:none}/* } */.x{color:red}", "<p class=x>n</p>y", "y"),
    ("@supports (display:grid){.x{display:none}}", "<p class=x>n</p>y", "y"), ("@media screen{@media print{.x{display:none}}}", "<p class=x>y", "y"), (".x{visibility:hidden} .x{visibility:visible}", "<p class=x>y", "y"), ("@font-face{src:url('}')} .x{display:none}", "<p class=x>n</p>y", "y"),
    ("@media (prefers-color-scheme:dark){.x{display:none}}", "<p class=x>y", "y"), (".x{display:none} @media (width>=600px){.x{display:block}}", "<p class=x>y", "y"), (".x{display:none} @media print{.x{display:block}}", "<p class=x>n</p>y", "y"),
    ("@media(min-width:40em){.x{display:none}}", "<p class=x>n</p>y", "y"), ("@media print and (color), speech{.x{display:none}}", "<p class=x>y", "y"), (".q{content:'/*'} .x{display:none}", "<p class=x>n</p>y", "y"),
])
def test_layout_by_rules(css, html, want):
    assert layout.text_of(f"<style>{css}</style>{html}") == want


@pytest.mark.parametrize("css, html, want", [
    ("p.x{display:none}", "<p class=x>n</p><div class=x>y</div>", "y"), (".x.z{display:none}", "<p class=x>y<p class='z q x'>n", "y"), ("p#i{display:none}", "<p id=i>n</p>y", "y"), ("*{visibility:hidden} b{visibility:visible}", "n<b>y</b>", "y"),
    (".x.z{display:block} .x{display:none}", "<p class='x z'>y", "y"), ("div .x{display:none}", "<div><p class=x>n</div><p class=x>y", "y"), ("ul > .x{display:none}", "<ul><li><b class=x>y</b></ul>", "- y"), ("a + .x, .x:hover, > .x{display:none}", "<a>y</a><b class=x>z</b>", "yz"),
])
def test_layout_by_compound_selectors(css, html, want):
    assert layout.text_of(f"<style>{css}</style>{html}") == want


@pytest.mark.parametrize("html, want", [
    ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>", "a  b  c\n   d  e"), ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
    ("<table><tr><td>" + "x" * 60 + "<td>1<tr><td>y<td>2</table>", "x" * 60 + "  1\ny" + " " * 61 + "2"),
    ("<table><tr><td>" + "word " * 30 + "<td>1<tr><td>y<td>2</table>", "word " * 15 + "word  1\n" + "word " * 13 + "word\ny" + " " * 80 + "2"),
    ("<table><tr><td>" + "x" * 200 + "<td>1<tr><td>y<td>2</table>", "x" * 200 + "  1\ny  2"), ("<table><tr><td>" + "word " * 30 + "</table>", ("word " * 30).strip()),
    ("<table><tr><td colspan=2>a long heading<td>c<tr><td>1<td>2<td>3</table>", "a long heading  c\n1  2            3"), ("<table><tr><td colspan=900>a<td>b<tr><td>1</table>", "a  b\n1"),
])
def test_layout_of_spans_and_wide_cells(html, want):
    assert layout.text_of(html) == want


@pytest.mark.parametrize("html", ["<b>{}</b>", "<i>{}", "<table>{}<td>", "<ul>{}<li>", "<p>{}<div>", "</b>{}<b><div>"])
def test_layout_takes_linear_time(html):
    """Runs of opened, ended and misplaced tags."""
    before, after = html.split("{}")
    for n in (20_000,):
        began = time.process_time()
        layout.text_of(before * n + "<div>" * n + after * n + "</div></b></p>" * n + "end")
        assert time.process_time() - began < 20


INLINE, LINE, PARAGRAPH = ("b", "span", "i", "a"), ("div", "section", "main"), ("p", "blockquote", "h2")


def tree(rng, depth=0, inside=()):
    """A random element: (tag, hidden, children), children being words or elements that HTML allows there."""
    kinds = INLINE if any(t in INLINE + ("p", "h2") for t in inside) else INLINE + LINE + PARAGRAPH
    out = []
    for _ in range(rng.integers(1, 5)):
        if depth > 4 or rng.random() < 0.5:
            out.append(f"w{rng.integers(1 << 40)}")
        else:
            tag = str(rng.choice(kinds))
            out.append((tag, bool(rng.random() < 0.1), tree(rng, depth + 1, (*inside, tag))))
    return out


def as_html(nodes, rng):
    out = []
    for x in nodes:
        if isinstance(x, str):
            out.append(f"{' ' * rng.integers(1, 3)}{x}\n")
        else:
            hide = rng.choice([" hidden", " style='display: none'", " class='q gone'", " id=away"]) if x[1] else rng.choice(["", " class=q", " style='color:red'"])
            out.append(f"<{x[0]}{hide}>{as_html(x[2], rng)}</{x[0]}>")
    return "".join(out)


def as_lines(nodes):
    """Words and the breaks between them: 0 none, 1 a new line, 2 an empty line; in plain recursion."""
    out = []
    for x in nodes:
        if isinstance(x, str):
            out.append(x)
        elif not x[1]:
            size = 2 if x[0] in PARAGRAPH else 1 if x[0] in LINE else 0
            out += [size, *as_lines(x[2]), size]
    return out


def test_layout_against_plain_recursion():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        nodes = tree(rng)
        text, gap = "", 0
        for x in as_lines(nodes):
            if isinstance(x, int):
                gap = max(gap, x)
            else:
                text += ("" if not text else " " if gap == 0 else "\n" * gap) + x
                gap = 0
        assert layout.text_of("<style>.gone{display:none} #away{display:none}</style>" + as_html(nodes, rng)) == text


def plain_grid(rows):
    """First column of each cell, by marking every place of a grid."""
    taken, out = set(), []
    for r, row in enumerate(rows):
        at, line = 0, []
        for span, down in row:
            while (r, at) in taken:
                at += 1
            line.append(at)
            taken |= {(q, c) for q in range(r, r + (down or len(rows))) for c in range(at, at + span)}
            at += span
        out.append(line)
    return out


def test_layout_places_cells_like_a_grid():
    rng = np.random.default_rng(4)
    for _ in range(300):
        rows = [[(int(rng.choice([1, 1, 2, 5])), int(rng.choice([1, 1, 2, 3, 0]))) for _ in range(rng.integers(0, 6))] for _ in range(rng.integers(1, 9))]
        table = layout.Table()
        for row in rows:
            table.rows.append([])
            for span, down in row:
                table.cell("x", span, down)
        assert [[at for at, _, _ in cells] for cells in table._placed()] == plain_grid(rows)


def plain_lines(rows):
    """Lines of a table of one-line cells without spans."""
    wide = lambda x: sum(2 if "\u3000" <= c <= "\u9fff" else 0 if c == "\u0301" else 1 for c in x)
    n = max(map(len, rows))
    width = [max((wide(r[i]) for r in rows if i < len(r)), default=0) for i in range(n)]
    out = []
    for r in rows:
        line, left = "", 0
        for i, x in enumerate(r):
            if x:
                line += " " * (left - wide(line)) + x
            left += width[i] + 2 if width[i] else 0
        out.append(line)
    return out


def test_layout_aligns_by_places_on_the_screen():
    rng = np.random.default_rng(5)
    for _ in range(100):
        rows = [["".join(rng.choice(["a", "漢", "e\u0301", "é", "カ"], rng.integers(0, 6))) for _ in range(rng.integers(1, 5))] for _ in range(rng.integers(1, 6))]
        rows = [r if any(r) else ["z"] for r in rows]
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in r) for r in rows) + "</table>"
        assert layout.text_of(html).split("\n") == plain_lines(rows)


def plain_rules(rules, chain):
    """Declared display of the last element of a chain of (tag, id, classes), by trying every way to fit a selector."""

    def fits(parts, element):
        tag, one, classes = element
        return all(p == "*" or p == tag or p == f"#{one}" or p[1:] in classes and p[0] == "." for p in parts)

    def below(steps, at):
        if not fits(steps[-1][1], chain[at]):
            return False
        if len(steps) == 1:
            return True
        return any(below(steps[:-1], k) for k in ([at - 1] if steps[-1][0] else range(at)) if k >= 0)

    best = None
    for place, (steps, value) in enumerate(rules):
        if below(steps, len(chain) - 1):
            every = [p for _, parts in steps for p in parts]
            rank = (sum(p[0] == "#" for p in every), sum(p[0] == "." for p in every), sum(p != "*" for p in every), place)
            best = max(best or (rank, value), (rank, value))
    return best[1] if best else "block"


def test_layout_cascade_against_all_ways():
    rng = np.random.default_rng(6)
    tags, ids, classes = ["div", "b", "i"], ["x", "y"], ["p", "q", "r"]
    for _ in range(200):
        rules, css = [], ""
        for _ in range(rng.integers(1, 7)):
            steps = []
            for k in range(rng.integers(1, 4)):
                parts = sorted({str(rng.choice(tags))} if rng.random() < 0.4 else set()) + [f".{c}" for c in classes if rng.random() < 0.3] + ([f"#{rng.choice(ids)}"] if rng.random() < 0.15 else [])
                steps.append((bool(k and rng.random() < 0.4), parts or ["*"]))
            value = str(rng.choice(["none", "block"]))
            rules.append((steps, value))
            css += "".join((" > " if child else " ") + "".join(parts) for child, parts in steps) + f"{{display:{value}}}\n"
        chain = [(str(rng.choice(tags)), str(rng.choice(ids)), [c for c in classes if rng.random() < 0.4]) for _ in range(rng.integers(1, 5))]
        page = f"<style>{css}</style>" + "".join(f'<{t} id="{i}" class="{" ".join(c)}">' for t, i, c in chain) + "seen"
        root = ("html", "", [])
        shown = all(plain_rules(rules, [root, *chain[: k + 1]]) != "none" for k in range(-1, len(chain)))
        assert layout.text_of(page) == ("seen" if shown else ""), page


@pytest.mark.parametrize("make", [
    lambda n: "<table><tr>" + "<td rowspan=0>a" * n + "<tr><td>b" * n,
    lambda n: "<table>" + "".join(f"<tr><td rowspan={n - i}>a<td>b" for i in range(n)),
    lambda n: "<table><tr>" + "".join(f"<td rowspan={i + 2}>a" for i in range(n)) + "<tr><td colspan=1000>b" * n,
    lambda n: "<style>" + "".join(f".c.k{i}{{display:none}}" for i in range(n)) + "</style>" + '<b class="c">a</b>' * n,
    lambda n: "<style>" + "".join(f"div .k{i}{{display:none}}" for i in range(n)) + "</style><div>" + '<b class="c">a</b>' * n,
])
def test_layout_of_spans_and_rules_takes_linear_time(make):
    took = []
    for n in (1_000, 4_000):
        page = make(n)
        began = time.perf_counter()
        layout.text_of(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


@pytest.mark.parametrize("html, want", [
    ("<ol start=-2><li>a<li>b<li>c<li>d</ol>", "-2. a\n-1. b\n0. c\n1. d"), ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol reversed start=10><li>a<li value=4>b<li>c</ol>", "10. a\n4. b\n3. c"), ("<ol start=1234567890><li>a<li>b</ol>", "1234567890. a\n1234567891. b"), ("<ol start=x><li value=' +7 '>a</ol>", "7. a"),
])
def test_layout_numbers_lists(html, want):
    assert layout.text_of(html) == want


def test_layout_of_tables_of_pages(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (2, None, "y"), (3, "<div>" * 20_000 + "deep", "z")], "page_id long, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"], r["n_lines"]) for r in layout.extract(df).collect())
    assert got == [(1, "a", 1, 1), (1, "a", 1, 1), (2, "", 0, 0), (3, "deep", 4, 1)]
    assert layout.extract(df.limit(0)).count() == 0


def search(x, ids, k=10):
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[ids == ids[q]] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[q])] = [(int(ids[i]), d[i]) for i in order if np.isfinite(d[i])]
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32).astype(float)
    x[500:1500] = x[500]  # a third of all rows are one vector
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(None, x[0].tolist()), (9000, None), (9100, [0.0] * 16), (9200, [1.0]), (9300, [float("nan")] * 16), (9400, [None] * 16)], "vec_id long, embedding array<float>").repartition(4)
    got = ann.neighbours(df, df.where("vec_id % 100 = 0")).toPandas()
    want = search(x, ids)
    hits = 0
    assert set(got["query_id"]) == set(want)
    for q, rows in got.sort_values("rank").groupby("query_id"):
        assert rows["rank"].tolist() == list(range(1, 11))
        np.testing.assert_allclose(rows["score"], np.sqrt(((x[rows["vec_id"]] - x[q]) ** 2).sum(1)), atol=1e-12)
        hits += len(set(rows["vec_id"]) & {i for i, _ in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert got[got["query_id"] == 600].sort_values("rank")["vec_id"].tolist() == list(range(500, 510))


def test_few_lists_are_read_where_vectors_have_structure():
    """Groups of vectors: under a fifth of all are read, and 95 % and more of the neighbours found."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(150, 64))[rng.integers(0, 150, 12_000)] + 0.15 * rng.normal(size=(12_000, 64))
    index = ann.linked(*ann.centroids(x, ann.lists_for(len(x))))
    ratio = ann.calibrated(index, x, ann.CLOSURE, ann.REPLICAS)
    row, of = ann._closure(index, x, ann.CLOSURE, ann.REPLICAS)
    asked = np.arange(0, len(x), 100)
    dist = ann.search(index, x[asked], ratio, ann.WIDTH)
    read = np.isfinite(dist) & (dist <= ratio * dist.min(1, keepdims=True))
    held = np.zeros((len(index.points), len(x)), bool)
    held[of, row] = True
    away = ((x[asked][:, None] - x) ** 2).sum(2)
    away[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(away, axis=1)[:, :10]
    found = np.array([[held[np.flatnonzero(r), n].any() for n in ns] for r, ns in zip(read, near)])
    seen = (read @ np.bincount(of, minlength=len(index.points))).mean() / len(x)
    assert found.mean() >= 0.95 and seen < 0.2, (found.mean(), seen)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.neighbours(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, round(2**0.5, 6))]
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0
    assert ann.neighbours(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_rows_of_one_id_take_one_place(spark):
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(120, 3)), np.arange(120)
    x, ids = np.repeat(x, 12, axis=0), np.repeat(ids, 12)
    x[6::12] += 1e-3  # half of the versions differ a little
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got = ann.neighbours(df, df.where("vec_id % 10 = 0"), ratio=1e9).toPandas()
    first = spark.createDataFrame(df.groupBy("vec_id").agg({"embedding": "min"}).collect(), "vec_id long, v array<double>").toPandas().set_index("vec_id")["v"]
    for q in range(0, 120, 10):
        d = np.sqrt(((x - np.array(first[q])) ** 2).sum(1))
        least = sorted((d[ids == i].min(), i) for i in range(120) if i != q)[:10]
        rows = got[got["query_id"] == q].sort_values("rank")
        assert rows["vec_id"].tolist() == [i for _, i in least]
        np.testing.assert_allclose(rows["score"], [s for s, _ in least], atol=1e-12)


def test_queries_on_a_centroid_find_enough(spark, monkeypatch):
    """A lone vector and a group of copies are their own centroids, and their lists are too short."""
    rng = np.random.default_rng(6)
    x = np.concatenate([[[90.0, 0.0]], np.tile([0.0, 90.0], (6, 1)), rng.normal(size=(593, 2))])
    ids = np.arange(600) * 100
    centroids = np.concatenate([x[:2], x[100::50]])
    monkeypatch.setattr(ann, "balanced_centroids", lambda *_: centroids)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    want = search(x, ids)
    asked = df.where("vec_id in (0, 100, 300, 5000, 9000)")
    for ratio in (1.0, 1.5, None, float("inf")):
        got = ann.neighbours(df, asked, ratio=ratio).toPandas()
        rows = {q: g.sort_values("rank")["vec_id"].tolist() for q, g in got.groupby("query_id")}
        assert {q: len(r) for q, r in rows.items()} == {q: 10 for q in (0, 100, 300, 5000, 9000)}
        assert rows[100][:5] == [200, 300, 400, 500, 600]
        if ratio == float("inf"):
            assert all(rows[q] == [i for i, _ in want[q]] for q in rows)


def test_far_small_groups(spark):
    """Queries of groups smaller than k, far from all others, get their k nearest from other lists."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(16, 1, 8)) * 20 + rng.normal(size=(16, 120, 8)) * 0.1]).reshape(-1, 8)
    x[100:104] = 500 + rng.normal(size=(4, 8))
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got = ann.neighbours(df, df.where("vec_id % 100 = 0")).toPandas()
    want = search(x, ids)
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys(want, 10)
    recall = [len({i for i, _ in want[q]} & set(got[got["query_id"] == q]["vec_id"])) / 10 for q in want]
    assert np.mean(recall) >= 0.9
    rows = got[got["query_id"] == 100].sort_values("rank")
    assert rows["vec_id"].tolist()[:3] == [i for i, _ in want[100]][:3]


def test_more_lists_than_are_fitted_at_once(spark, monkeypatch):
    """Two levels of centroids, a graph from near cells, all of it reached, and searches in parts."""
    monkeypatch.setattr(ann, "MANY", 32)
    monkeypatch.setattr(ann, "ROWS_PER_LIST", 16)
    monkeypatch.setattr(ann, "HELD_DISTANCES", 4_000)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(60, 1, 12)) * 2 + rng.normal(size=(60, 100, 12))).reshape(-1, 12).astype(np.float32).astype(float)
    assert ann.lists_for(6000) == 109 and ann.lists_for(600) == 34 and ann.lists_for(10**10) > 1000 * ann.lists_for(10**4)
    points, cell = ann.centroids(x, 109)
    index = ann.linked(points, cell)
    assert 100 <= len(points) <= 130 and len(np.unique(cell)) > 5
    assert np.isfinite(ann.search(index, x[:20], np.inf, 1)).all()
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(4)
    got = ann.neighbours(df, df.where("vec_id % 100 = 0")).toPandas()
    want = search(x, ids)
    hits = [len({i for i, _ in want[q]} & set(rows["vec_id"])) for q, rows in got.groupby("query_id")]
    assert len(hits) == 60 and np.mean(hits) >= 9


def test_columns_of_the_input_keep_their_values(spark):
    names = ("score", "rank", "key", "vector", "list", "salt", "side", "query_id", "a.b", "n_chars", "n_lines", "text")
    pages = spark.createDataFrame([(1, "<p>a"), (2, None)], "page_id long, html string").withColumns({c: F.lit("mine") for c in names})
    out = layout.extract(pages)
    assert sorted(out.columns) == sorted(pages.columns) and all(r[c] == "mine" for r in out.collect() for c in names if c not in ("text", "n_chars", "n_lines"))
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))], "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in names})
    assert ann.neighbours(df, df.where("vec_id = 0")).count() == 10
