"""Classifiers on held-out rows, neighbours against brute force, pages, and the pipeline stage by stage."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import quality_gam, toxicity
from tallyhouse.llm.common import crc_fold, stored
from tallyhouse.llm.exact_dedup import exact_dedup
from tallyhouse.llm.html_extraction import CONTAINER, DOUBT, ENOUGH, FAINT, INLINE, SHARE, SURROUNDINGS, WINDOW, Line, _is_remark, _names, extract, main_text, reads_like_surroundings
from tallyhouse.llm.multi_index_hashing import met_first, near_values, search
from tallyhouse.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


# classifiers
def test_quality_on_held_out_rows(spark):
    got = QUERIES["op7_quality_gam"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_toxicity_learns_words(spark):
    r = np.random.default_rng(5)
    plain = ["".join(r.choice(list("aeiourstln"), 5)) for _ in range(400)]
    rows = [(i, " ".join([*r.choice(plain, 60), *(["vileword", "gruxling"] if i % 4 == 0 else []), *r.choice(plain, 40)]), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    held = crc_fold("doc_id", 5) == 0
    model = toxicity.fit(docs, labels, ~held)
    got = toxicity.score(docs, model).withColumn("held", held).where("held").collect()
    assert np.mean([(x.score >= 0.5) == (x.doc_id % 4 == 0) for x in got]) > 0.95
    assert model.evidence("") == 0.0 and 0 < model.score(1e9) <= 1


def spelled_by_hand(texts, words):
    """Value of each word in the toxicity model of (text, y), with every spelling of the sample and of the texts."""
    counts = (Counter(), Counter())
    for text, y in texts:
        for w in text.split():
            counts[y].update(toxicity.spellings(w, toxicity.ORDER))
    tables = [Counter(g for w in {w for text, _ in texts for w in text.split()} for g in toxicity.spellings(w, toxicity.SHARED))]
    while len(tables) < toxicity.SHARED:
        tables.append(Counter(g[1:] for g in tables[-1] if len(g) > 1))
    total, kinds = [Counter() for _ in tables], [Counter() for _ in tables]
    for k, table in enumerate(tables):
        for g, n in table.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
    letters = len({g[-1] for g in tables[0]}) + 1

    def p(g, k):
        if k == len(tables) or len(g) == 1 and k < len(tables) - 1:
            return 1 / letters
        below = p(g[1:] or g, k + 1)
        return (max(tables[k][g] - 0.75, 0) + 0.75 * kinds[k][g[:-1]] * below) / total[k][g[:-1]] if total[k][g[:-1]] else below

    sums, types = (Counter(), Counter()), (Counter(), Counter())
    for y in (0, 1):
        for g, n in counts[y].items():
            sums[y][g[:-1]] += n
            types[y][g[:-1]] += 1

    def value(g):
        h = g[:-1]
        if sums[0][h] + sums[1][h] < toxicity.LEAST:
            return 0.0
        weight = [0.75 * types[y][h] / sums[y][h] if sums[y][h] else 1.0 for y in (0, 1)]
        if counts[0][g] + counts[1][g] < toxicity.LEAST:
            return math.log(weight[1] / weight[0])
        a, b = (max(counts[y][g] - 0.75, 0) / max(sums[y][h], 1) + weight[y] * p(g[-toxicity.SHARED:], 0) for y in (0, 1))
        return math.log(b / a)

    return {w: sum(map(value, toxicity.spellings(w, toxicity.ORDER))) for w in words}


def test_toxicity_keeps_every_spelling(spark):
    r = np.random.default_rng(8)
    plain = ["".join(x) for x in r.choice(list("abcdefghijklmnopqrstuvw\u00e9\u4e2d"), (30_000, 9))]
    rare = ["vileword", "gruxling", "zqxyz", "xx"]
    # thirty thousand words of four uses each, then toxic ones of three
    rows = [(i, " ".join(plain[i % 100 * 300:i % 100 * 300 + 300]), 0) for i in range(500)] + [(500 + i, " ".join(rare), 1) for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    held = {x.doc_id for x in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(toxicity.HELD)) == 0).collect()}
    model = toxicity.fit(docs, labels, F.lit(True))
    words = [*rare, *plain[::3000], "unseen", "vile"]
    texts = [(t, y) for i, t, y in rows if i not in held]
    assert {t for t, _ in texts} == {t for _, t, _ in rows}
    want = spelled_by_hand(texts, words)
    for w in words:
        assert math.isclose(model.word(w), want[w], rel_tol=1e-9, abs_tol=1e-9), w


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    held = crc_fold("doc_id", 3) == 1
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_gam.fit(docs, x, ~held) for x in (labels, other))
    assert all(np.array_equal(p, q) for p, q in zip(a.tables + a.pair_tables, b.tables + b.pair_tables))


@pytest.mark.parametrize("kind, label", [(toxicity, "toxic"), (quality_gam, "quality")])
def test_classifier_awkward(spark, kind, label):
    docs = spark.createDataFrame([(1, "good text here", "x"), (2, None, None), (None, "", "x"), (1, "good text here", "x"), (3, "w " * 50_000, "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], f"doc_id bigint, {label} int")
    model = kind.fit(docs, labels, F.lit(True))
    got = kind.score(docs, model)
    assert got.count() == 5 and got.where("score is null or score > 1 or score < 0").count() == 0 and dict(got.dtypes)["score"] == "double"
    assert kind.score(docs.limit(0), kind.fit(docs.limit(0), labels.limit(0), F.lit(True))).count() == 0
    two = spark.createDataFrame([(1, 1), (3, 0)], f"doc_id bigint, {label} int")
    assert kind.score(docs, kind.fit(docs, two, F.lit(True))).count() == 5


# neighbours
def exact_neighbours(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = unit @ unit[i]
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -np.round(s[others], 12)))][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def test_recall_and_scores(spark):
    got = {}
    for r in QUERIES["op4_multi_index_hashing"](spark, MIDDLE).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()]
    want = exact_neighbours(rows, 50, 5)
    assert set(got) == set(want)
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == [1, 2, 3, 4, 5]
        for _, v, s in found:
            a, b = vectors[q], vectors[v]
            assert math.isclose(s, a @ b / math.sqrt(a @ a) / math.sqrt(b @ b), rel_tol=1e-12)


def test_neighbours_awkward(spark):
    common = [(i, [1.0, 0.0, 0.0], "x", 1) for i in range(100, 130)]
    rows = [(0, [1.0, 2.0, 0.0], "x", 1), (50, [1.0, 2.0, 0.0], "x", 1), (51, [2.0, 4.0, 0.0], "x", 1), (51, [2.0, 4.0, 0.0], "x", 1), (52, [0.0, 0.0, 0.0], "x", 1), (53, None, None, None), (54, [1.0, None, 2.0], "x", 1),
            (55, [float("nan"), 1.0, 1.0], "x", 1), (56, [float("inf"), 1.0, 1.0], "x", 1), (57, [1.0, 2.0], "x", 1), (None, [1.0, 1.0, 1.0], "x", 1), (58, [-1.0, 0.5, 0.25], "x", 1), (59, [1e30, 1e30, 0.0], "x", 1), *common]
    got = {}
    for r in search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, code string, rep int"), every=50, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 6)))
    assert set(got) == {0, 50, 100}
    assert sorted(got[0])[:2] == [(1, 50, 1.0), (2, 51, 1.0)] and sorted(got[100]) == [(1, 101, 1.0), (2, 102, 1.0), (3, 103, 1.0)]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in search(few, every=50, k=5).collect()] == [(0, 1)]
    assert search(few.limit(0), every=50).count() == 0


def test_pigeonhole():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 256, (40, 8), dtype=np.uint8), r.integers(0, 256, (50, 8), dtype=np.uint8)
    far = np.unpackbits(a[:, None] ^ b[None], axis=2).sum(axis=2)
    masks = np.array(near_values(3), np.uint8)
    times = sum((met_first(a, b, j, 3) & np.isin(a[:, None, j] ^ b[None, :, j], masks)).astype(int) for j in range(8))
    assert times.max() == 1 and (times[far <= 31] == 1).all()


# pages
PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; more</h1><p>One\n two<br>three<p>Four <b>five</b></article><footer>foot</footer></body></html>",
     "Head & more\nOne two three\nFour five"),
    ("<body><div id='menu'><ul><li><a href=1>a</a><li><a href=2>b</a></ul></div><div class=content><h1>Title</h1><p>A first long paragraph of text.</p><p>Short.</p></div><div class='reader-comments'>bad</div><form>x</form></body>",
     "Title\nA first long paragraph of text.\nShort."),
    ("<article><p>a</p><div class=\"ad\">buy</div><p>b</p><aside>side</aside><p>c</p><section id=comments><article><p>no</p></article></section></article>", "a\nb\nc"),
    ("<script>if (a<b) document.write('<p>x</p>')</script><main><p>only &lt;this&gt; &#233;</p><!-- <p>no</p> --></main><div class='cookie-notice'>accept</div>", "only <this> é"),
    ("plain <b>text", "plain text"), ("", ""), ("<nav>menu", ""), ("<p", "<p"), ("<article></article>", "")]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert main_text(page) == text


def test_short_sections_beside_a_long_paragraph():
    long = "word " * 2000
    page = f"<body><div><div><h1>Head</h1></div></div><div><div><p>{long}</p></div></div><div><div><ul><li>one</ul></div></div><div><div><a href=x>Home</a></div></div><div><div><p>End.</p></div></div></body>"
    assert main_text(page) == f"Head\n{long.strip()}\none\nEnd."


@pytest.mark.parametrize("page, text", [
    ("<article><a href=x>Card</a> in short</article><div><p>The body in plain divs.</p></div><div><p>Its end.</p></div>", "Card in short\nThe body in plain divs.\nIts end."),
    ("<main><h1><a href=0>Title</a></h1><p>Text.</p><p><a href=4>More</a></p><p>End.</p><div><a href=1>a</a></div><div><a href=2>b</a></div><div><a href=3>c</a></div></main>", "Title\nText.\nMore\nEnd."),
    ("<article class='promo story'><p>Text.</p><p><a href=1>Source</a></p></article>", "Text.\nSource")])
def test_windows_choose_on_every_page(page, text):
    assert main_text(page) == text


BODY = "This is a long paragraph of the article with many words in it, so that it is dense enough to be text."


@pytest.mark.parametrize("page, text", [
    # an element that holds the densest window is no surrounding, nor are others of the same names
    ("<div id='page' class='site has-sidebar'><article><h1>T</h1><p>Body text.</p></article><div class='sidebar'>side</div></div>", "T\nBody text."),
    (f"<div class='elementor-widget text-editor'><p>{BODY}</p></div><div class='elementor-widget'>Second.</div><div class='elementor-widget search'>find</div>", f"{BODY}\nSecond."),
    (f"<form id='all'><nav>menu</nav><div class='content'><p>{BODY}</p></div></form><form>subscribe</form>", BODY),
    # surroundings without any name
    (f"<div>Home</div><div>About us</div><div><h1>T</h1><p>{BODY}</p><p>Short end.</p></div><div>Copyright 2020 Example</div><div>We use cookies to improve your visit.</div>", f"T\n{BODY}\nShort end."),
    (f"<div><a href=1>Home</a> | <a href=2>News</a></div><div><div><p>{BODY}</p></div></div>", BODY),
    # words of notices inside the text stay
    (f"<div><p>{BODY}</p></div><div>Cookies are small files.</div><div><p>{BODY}</p></div>", f"{BODY}\nCookies are small files.\n{BODY}"),
    (f"<article><p>{BODY}</p><p>Copyright law is old.</p></article>", f"{BODY}\nCopyright law is old."),
    # an article's own header, remarks that are articles, and an empty article
    ("<header>Site</header><article><header><h1>Title</h1></header><p>Text</p></article>", "Title\nText"),
    (f"<article><p>Short.</p></article><div id='comments'><article class='comment'><p>{BODY}</p></article></div>", "Short."),
    (f"<nav>{BODY}</nav><article></article>", ""), ("<div class='ad'>Buy now.</div>", "")])
def test_evidence_is_weighed(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000 + "<div><span>" * 20_000, "<div>" * 20_000 + "</p>" * 20_000, "<a " * 100_000, "<a '" * 20_000 + ">", "<div class=ad>" * 20_000 + "x", "<p><div>" * 20_000])
def test_broken_markup_takes_linear_time(page):
    start = time.time()
    main_text(page)
    assert time.time() - start < 5


def random_tree(r, depth=0):
    """A page as nested (tag, class, children)."""
    word = lambda: r.choice(["Home", "We use cookies.", "Copyright 2001", "A text. " * r.randint(1, 40), "word " * r.randint(1, 9)])
    if depth > 4 or r.random() < 0.25:
        return ("p", "", [word() if r.random() < 0.7 else ("a", "", [word()]), *([("b", "", [word()])] if r.random() < 0.3 else [])])
    tag = r.choice(["div"] * 6 + ["section", "ul", "article", "nav", "header", "form"])
    kids = [random_tree(r, depth + 1) if tag != "ul" else ("li", "", [("a", "", [word()])]) for _ in range(r.randint(0, 4))]
    return (tag, r.choice(["", "", "", "ad", "content", "has-sidebar widget", "widget", "comments"]), kids)


def rendered(node):
    if isinstance(node, str):
        return node
    return f"<{node[0]}{f' class="{node[1]}"' if node[1] else ''}>{''.join(map(rendered, node[2]))}</{node[0]}>"


def text_by_hand(tree):
    """The main text straight from the tree, every sum taken anew."""
    grid, path_of, words, article_seen = [], [], [], []

    def flush(path, inside):
        text = " ".join("".join(w for w, _ in words).split())
        if text:
            grid.append(Line(text, sum(len("".join(w.split())) for w, link in words if not link), len(path) - 1, inside))
            path_of.append(path)
        words.clear()

    def gap(n, path, inside):
        for _ in range(n):
            grid.append(Line("", 0, len(path) - 1, inside))
            path_of.append(path)

    def walk(node, path, inside, remark, link):
        if isinstance(node, str):
            words.append((node, link))
            return
        tag, cls, kids = node
        names = _names(tag, f' class="{cls}"' if cls else "")
        remark_here = _is_remark(names)
        if tag in SURROUNDINGS and not (tag == "header" and inside):
            names.append(object())
        article = tag == "article" and not remark and not remark_here
        if article:
            article_seen.append(1)
        block = tag not in INLINE
        if block:
            flush(path, inside)
            gap(tag in CONTAINER and not inside, path, inside)
        gap(WINDOW * (article or bool(names) and not inside), path, inside)
        within, now = (path + (frozenset(names),) if names else path), inside or article
        for kid in kids:
            walk(kid, within, now, remark or remark_here, link or tag == "a")
        if block:
            flush(within, now)
            gap(tag in CONTAINER and not now, within, now)
        gap(WINDOW * article, within, now)
        gap(WINDOW * (bool(names) and not inside), path, inside)

    walk(tree, (), False, False, False)
    told = [reads_like_surroundings(x) for x in grid]
    weight = [x.counted * (FAINT if path_of[i] else 1) * (FAINT if told[i] else 1) / (FAINT if x.article else 1) for i, x in enumerate(grid)]
    ends = range(len(grid) + WINDOW - 1)
    cover = lambda e: [i for i in range(e - WINDOW + 1, e + 1) if 0 <= i < len(grid)]
    wrong = set()
    if any(path_of) and any(weight):
        best = max(ends, key=lambda e: (sum(weight[i] for i in cover(e)), -e))
        at = max(cover(best), key=lambda i: (weight[i], -i))
        if grid[at].article or not article_seen and sum(grid[i].counted for i in cover(best)) >= DOUBT:
            wrong = {n for names in path_of[at] for n in names}
    grid = [x for x, path in zip(grid, path_of) if all(names <= wrong for names in path)]
    told = [reads_like_surroundings(x) for x in grid]
    weight = [x.counted * (FAINT if t else 1) for x, t in zip(grid, told)]
    total = lambda values, a, b: sum(values[max(a, 0):b])
    top = max((total(weight, e - WINDOW + 1, e + 1) for e in range(len(grid))), default=0)
    threshold = min(top * SHARE, ENOUGH)
    runs, i = [], 0
    while i < len(grid):
        j = i
        while j < len(grid) and grid[j].text:
            j += 1
        if j > i:
            runs.append((i, j))
        i = j + 1
    dense = [n for n, (a, b) in enumerate(runs) if grid[a].article or threshold and any(total(weight, k, min(k + WINDOW, b)) >= threshold - 1e-9 for k in range(a, b))]
    gone = set()
    for n, (a, b) in enumerate(runs):
        if dense and not dense[0] <= n <= dense[-1] and 2 * sum(len(grid[i].text) for i in range(a, b) if told[i]) >= sum(len(grid[i].text) for i in range(a, b)):
            gone |= set(range(a, b))
    # a line lies in a stretch if each window between the nearest letters on both sides holds letters
    letters = [i for i, x in enumerate(grid) if x.counted]
    inside = {i for a, b in zip(letters, letters[1:]) if b - a <= WINDOW for i in range(a, b)} | set(letters)
    edge = set()
    for i in inside:
        for step in (-1, 1):
            if i + step not in inside:
                n = 0
                while 0 <= i + step * (n + 1) < len(grid) and grid[i + step * (n + 1)].text and not grid[i + step * (n + 1)].counted:
                    n += 1
                edge |= {i + step * (k + 1) for k in range(n % WINDOW if n < WINDOW else 0)}
    return "\n".join(x.text for i, x in enumerate(grid) if x.text and i in inside | edge and i not in gone)


def test_random_pages_against_brute_force():
    r, changed = random.Random(11), 0
    for _ in range(1500):
        tree = ("div", "", [random_tree(r) for _ in range(r.randint(1, 6))])
        page = rendered(tree)
        assert main_text(page) == text_by_hand(tree), page
        changed += main_text(page) != main_text(page.replace("cookies", "biscuits").replace("Copyright", "Written"))
    assert changed > 50


def test_pages_of_the_sample(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op9_html_extraction"](spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        title = r.html[r.html.index("<h1>") + 4:r.html.index("</h1>")]
        text = got[r.page_id].text
        assert got[r.page_id].n_chars == len(text) and text.split("\n")[0] == " ".join(__import__("html").unescape(title).split())
        assert "track(" not in text and "<p>" not in text


def test_pages_awkward(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>" + "long text " * 50_000, "x"), (1, None, None, "x"), (2, "u", "<div " * 2000, None)], "page_id bigint, url string, html string, text string")
    got = extract(pages).collect()
    assert Counter((r.page_id, len(r.text)) for r in got)[(1, 0)] == 2 and len(got) == 4 and extract(pages.limit(0)).count() == 0


# pipeline
def test_pipeline_stage_by_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = stored(corpus_pipeline.toxicity_stage(spark, docs, small))
    assert kept.columns == columns and 0.8 * docs.count() < kept.count() <= docs.count()
    one = stored(corpus_pipeline.exact_stage(spark, kept, small))
    blank = F.regexp_replace("text", "[\\x20\\x09-\\x0D]", "")
    assert one.columns == columns and one.count() == kept.select(blank).distinct().count() == one.select(blank).distinct().count()
    near = stored(corpus_pipeline.near_stage(spark, one, small))
    from test_llm_text import linked
    groups = linked([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in groups.items() if i == c}
    mixed = stored(corpus_pipeline.mixing_stage(spark, near, small))
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in near.collect()}
    packed = corpus_pipeline.packing_stage(spark, mixed, small)
    assert packed.where("start = 0").count() == mixed.count()
    assert corpus_pipeline.run(spark, small).count() == packed.count()


def test_near_stage_goes_by_id_and_text(spark):
    text = lambda n: " ".join(f"{n}w{i}" for i in range(80))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(1, a), (2, a + " x"), (2, b), (None, c), (None, c + " y"), (None, b + " z"), (3, ""), (4, None), (2, b)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, gone_id int, text_key string")
    got = corpus_pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in got.collect())
    one = [t for i, t in left if i is None]
    assert len(one) == 1 and one[0] in (c, c + " y")
    assert left == Counter([(1, a), (2, b), (2, b), (3, ""), (4, None), (None, one[0])])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_awkward(spark, small, name, stage):
    rows = [(1, "a b c d e f g", None, "s", 3), (None, "x", "en", None, None), (2, None, "en", "s", 0), (2, None, "en", "s", 0), (3, "", None, "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert stage(spark, docs, small).count() >= 3
    assert stage(spark, docs.limit(0), small).count() == 0


def test_exact_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id bigint, text string, group_size int")
    assert exact_dedup(docs).columns == ["doc_id", "text", "text_sha256", "keep_id", "group_size", "kept"]
