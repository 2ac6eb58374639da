"""Exact top-k and main texts of pages against brute force and fixed pages."""

import itertools
import math
import time

import numpy as np

from cadenza.llm import html_extract, topk


def brute(rows, k, every):
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in v:
        if q % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q])))[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(8)]  # ties
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2050, [math.nan] * 6), (2051, [math.inf] * 6), (2100, [1.0, 2.0]), (2101, [3.0, 4.0]), (None, [0.0] * 6), (2200, [])]
    df = spark.createDataFrame([(i, e, 1, 0) for i, e in rows], "vec_id long, embedding array<float>, label int, score int").repartition(5)
    assert {tuple(r) for r in topk.top_k(df, k=5, every=50).collect()} == brute(rows, 5, 50)
    assert topk.top_k(df.limit(0)).count() == 0


def test_block_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(1)
    c = rng.integers(-256, 256, (3000, 4))
    q = c[:20]
    ids = np.arange(3000)
    got = topk.search_block(ids[:20], q, ids, c, 5)
    score = q @ c.T
    for i in range(20):
        order = [j for j in np.lexsort((ids, -score[i])) if j != i][:5]
        assert [(b, s) for a, b, s in got if a == i] == [(j, score[i, j]) for j in order]


def test_bounds_and_thresholds_pass_over_most_of_clustered_vectors():
    """Less than 60 % of the pairs are evaluated, far less here, and the result is that of brute force."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32)) * 256
    c = np.floor(centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 32)) * 40).astype(np.int64)
    ids, queries = np.arange(6000), np.arange(0, 6000, 100)
    drawn = rng.choice(6000, 800, replace=False)
    pivots = topk.far_first(c[drawn].astype(float), 64)
    least = topk.least_scores(queries, c[queries], drawn, c[drawn], 5)
    score = c[queries] @ c.T
    found, seen = {int(q): [] for q in queries}, []
    for b in range(0, 6000, 1000):
        for q, j, s in topk.search_block(queries, c[queries], ids[b : b + 1000], c[b : b + 1000], 5, pivots, least, seen):
            found[q].append((-s, j))
    for i, q in enumerate(queries):
        want = [(-score[i, j], j) for j in np.lexsort((ids, -score[i])) if j != q][:5]
        assert sorted(found[int(q)])[:5] == want and least[i] <= -want[-1][0]
    assert sum(seen) < 0.6 * len(queries) * 6000


def test_bounds_pass_over_vectors_without_clusters():
    """Less than a third of the pairs is evaluated where all directions are equally strong; triangle bounds left nine tenths."""
    rng = np.random.default_rng(4)
    c = rng.normal(size=(8000, 64))
    c = np.floor(256 * c / np.linalg.norm(c, axis=1)[:, None]).astype(np.int64)
    ids, queries, drawn = np.arange(8000), np.arange(0, 8000, 100), rng.choice(8000, 2000, replace=False)
    least, seen = topk.least_scores(queries, c[queries], drawn, c[drawn], 5), []
    score = c[queries] @ c.T
    got = topk.search_block(queries, c[queries], ids, c, 5, topk.far_first(c[drawn].astype(float), topk.PIVOTS), least, seen)
    assert got == [(q, j, score[i, j]) for i, q in enumerate(queries) for j in [j for j in np.lexsort((ids, -score[i])) if j != q][:5]]
    assert sum(seen) < len(queries) * 8000 / 3


def test_top_k_of_many_blocks(spark):
    """Floors that rise from block to block lose nothing: ties, copies, products beyond doubles, a cell for each of several rows."""
    rng = np.random.default_rng(6)
    few, blocks, size = [rng.normal(size=8) for _ in range(30)], topk.BLOCK, topk.QUERY_BLOCK
    for scale, partitions in ((1.0, 5), (2.0**19, 60)):
        rows = [(i, [float(np.float32(x)) * scale for x in (few[i % 30] if i % 3 else rng.normal(size=8))]) for i in range(900)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
        kept = spark.conf.get("spark.sql.shuffle.partitions")
        topk.BLOCK, topk.QUERY_BLOCK = 70, 13
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert {tuple(r) for r in topk.top_k(df, k=5, every=20).collect()} == brute(rows, 5, 20)
        finally:
            topk.BLOCK, topk.QUERY_BLOCK = blocks, size
            spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_grid_sends_candidates_to_few_cells():
    """Cells are as many as partitions; the 50 times rarer queries are the ones that are copied to many."""
    for partitions in (1, 12, 200, 5000):
        rows, columns = topk.grid(partitions, 50)
        assert rows * columns >= partitions and rows**2 <= max(1, partitions / 20)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
<article><h1>Title &amp; more</h1><p>First  <b>bold</b>ly
said.<p>Second<br>line &lt;ok&gt; &copy <a href="y">link</a>.<aside>side</aside><div class="ad">buy</div><form><p>q</p></form><section id="comments"><p>me too</p></section></article>
<div class="sidebar">s</div><footer>f</footer></body></html>"""


def test_page():
    assert html_extract.extract(PAGE) == "Title & more First boldly said. Second line <ok> © link."
    assert html_extract.extract("") == html_extract.extract(None) == ""
    assert html_extract.extract("just text &amp; more") == "just text & more"
    assert html_extract.extract("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert html_extract.extract("<body><article><ul><li><a href=x>Linked</a></li></ul><table><tr><td><a href=y>cell</a></td></tr></table></article></body>") == "Linked cell"
    assert html_extract.extract("<body><h1>Title</h1><article><p>Whole text.</p></article></body>") == "Title Whole text."


def test_names_set_nothing_else_aside():
    """Values are no attribute names, parts of class words no class words; what holds the main text is never set aside."""
    for raw in ('style="overflow:hidden"', 'title="a hidden gem"', 'class="overflow-hidden"', 'class="layout has-sidebar"', 'class="no-comments"', "data-x='class=ad id=ads'"):
        assert html_extract.extract(f"<body><div {raw}><article><h1>T</h1><p>Whole text.</p></article></div></body>") == "T Whole text."
        assert html_extract.extract(f"<body><div {raw}><p>Whole text.</p></div><div><p>More.</p></div></body>") == "Whole text. More."
    for raw in ('class="widget"', 'id="sidebar"', 'class="page hidden"', "role=form", "hidden"):
        assert html_extract.extract(f"<body><div {raw}><article><h1>T</h1><p>Whole text.</p></article></div></body>") == "T Whole text."
        assert html_extract.extract(f"<body><div {raw}><p>All of the long main text.</p></div><div><p>More.</p></div></body>") == "All of the long main text. More."
        assert html_extract.extract(f"<body><article><h1>T</h1><div {raw}><p>Whole text.</p></div></article></body>") == "T Whole text."
        assert html_extract.extract(f"<body><article><p>Whole text.</p><div {raw}><p>x</p></div></article></body>") == "Whole text."
    assert html_extract.extract("<body><form id=f><div><article><p>Whole text.</p></article></div><input></form></body>") == "Whole text."


def test_tree_matching():
    a, b = html_extract.tree("<body><h2>x</h2><p>1<p>2<ul><li>a</ul></body>"), html_extract.tree("<body><p>9<ul><li>b<li>c</ul></body>")
    size, pairs = html_extract.match(a, b)
    assert size == len(pairs) and {x.label for x, _ in pairs} == {"#root", "body", "p", "ul", "li"}


def test_host_template(spark):
    """Without an article element, what stands the same on a host's pages is its template."""
    page = lambda i: f"<body><div class='x1'>Welcome to our host</div><div class='x2'><h2>Story {i}</h2><p>Body number {i} tells of things {i}.</p></div><div class='x3'>Written by nobody</div></body>"
    rows = [(i, f"http://h.example/{i}", page(i), "t", 5) for i in range(8)] + [(50, None, None, "t", 5), (None, "http://h.example/n", page(9), "t", 5), (51, "http://other.example", page(3), "t", 5), (3, "http://h.example/3", page(3), "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extract_pages(df).collect()}
    assert html_extract.extract_pages(df).count() == len(rows)
    for i in range(8):
        text = f"Story {i} Body number {i} tells of things {i}."
        assert got[i, f"http://h.example/{i}"] == (text, len(text))
    assert got[50, None] == ("", 0) and "Welcome" in got[51, "http://other.example"][0]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_varying_slots_outside_articles_stay(spark):
    """An article that is a teaser, or a main with only a heading, does not take the text that stands beside it."""
    teaser = lambda i: f"<body><div class='top'>Welcome to our host</div><div class='content'><p>Story {i} tells of many things {i}.</p></div><article><h2>Read also {i % 2}</h2></article></body>"
    heading = lambda i: f"<body><div class='top'>Welcome to our host</div><main><h1>Heading {i}</h1></main><div class='content'><div>Story {i}</div><p>It tells of many things.</p></div></body>"
    beside = lambda i: f"<body><div class='top'>Welcome to our host</div><div class='date'>Day {i}</div><article><p>Story {i} tells of many things {i}.</p></article></body>"
    kinds = {"teaser": teaser, "heading": heading, "beside": beside}
    rows = [(100 * k + i, f"http://{name}.example/{i}", page(i)) for k, (name, page) in enumerate(kinds.items()) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(8):
        assert got[i] == f"Story {i} tells of many things {i}. Read also {i % 2}"
        assert f"Heading {i}" in got[100 + i] and f"Story {i}" in got[100 + i] and "Welcome" not in got[100 + i]
        assert got[200 + i] == f"Day {i} Story {i} tells of many things {i}."
    assert "Story 1 tells" in html_extract.extract(teaser(1))  # a host of one page
    assert html_extract.extract(beside(1)) == "Story 1 tells of many things 1."


def test_every_layout_has_a_reference(spark):
    """Neither an empty page, an error page nor a page of another layout is what all pages of a host are aligned with."""
    one = lambda i: f"<body><div class='top'>Welcome to our host</div><div class='text'><p>Story {i} tells of many things {i}.</p></div></body>"
    two = lambda i: f"<body><div class='menu-bar'>All that we have</div><div class='note'>Written by nobody</div><section class='body'><h2>Report {i}</h2><p>It is about {i} and more.</p></section></body>"
    for k, empty in enumerate(("", " ", "<html><body></body></html>", "<body><center><h1>404</h1></center></body>")):
        rows = [(1, "http://h.example/", empty)] + [(10 + i, "http://h.example/", one(i)) for i in range(9)] + [(30 + i, "http://h.example/", two(i)) for i in range(8)]
        got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
        assert len(got) == len(rows) and got[1] == ("404" if k == 3 else "")
        assert all(got[10 + i] == f"Story {i} tells of many things {i}." for i in range(9))
        assert all(got[30 + i] == f"Report {i} It is about {i} and more." for i in range(8))


def test_wide_and_deep_pages():
    """Wide levels are matched as narrow ones are; parts are set aside at any depth."""
    rng = np.random.default_rng(2)
    kinds = ["<h2>x</h2>", "<ul><li>a</li></ul>", "<table><tr><td>a</td><th>b</th></tr></table>", "<table><tr><td>a</td></tr></table>", "<p>t</p>", "<div><p>a</p><h3>b</h3></div>"]
    for sizes in ((150, 150), (400, 90), (140, 600)):
        a, b = (html_extract.tree("<body>" + "".join(rng.choice(kinds, n)) + "</body>") for n in sizes)
        wide, html_extract.WIDE = html_extract.WIDE, 1 << 40
        want = html_extract.match(a, b)
        html_extract.WIDE = wide
        got = html_extract.match(a, b)
        assert len(a.slots[0].slots) * len(b.slots[0].slots) > wide
        assert got[0] == len(got[1]) == want[0] and all(x.label == y.label for x, y in got[1])
    # the slot after a thousand blocks that only one page has
    long = "<body>" + "<h2>n</h2><p>n</p>" * 150 + "<div class='x'>end</div></body>"
    some = "<body>" + "<h2>n</h2><p>n</p>" * 10 + "<ul><li>n</li></ul><ol><li>n</li></ol>" * 800 + "<div class='x'>end</div></body>"
    assert "div.x" in {x.label for x, _ in html_extract.match(html_extract.tree(long), html_extract.tree(some))[1]}
    deep = "<div>" * 200 + "<nav><div>menu</div>more</nav><aside>side</aside>text<div>one</div>two" + "</div>" * 200
    assert html_extract.extract(f"<body><div class='a'>{deep}after</div><p>last</p></body>") == "text one two after last"


def brute_match(a, b):
    """The most pairs of simple tree matching, by trying all order-keeping pairings of the children."""
    if a.label != b.label:
        return 0
    most = 0
    for k in range(min(len(a.slots), len(b.slots)) + 1):
        for i in itertools.combinations(range(len(a.slots)), k):
            for j in itertools.combinations(range(len(b.slots)), k):
                most = max(most, sum(brute_match(a.slots[x], b.slots[y]) for x, y in zip(i, j)))
    return 1 + most


def test_tree_matching_against_all_pairings():
    rng = np.random.default_rng(5)

    def some(depth):
        kids = "".join(some(depth - 1) for _ in range(rng.integers(0, 4))) if depth else ""
        kind = rng.choice(["div", "section", "div class=a", "nav"])
        return f"<{kind}>{kids}</{kind.split()[0]}>"

    for _ in range(60):
        a, b = (html_extract.tree(f"<body>{some(2)}{some(2)}</body>") for _ in range(2))
        size, pairs = html_extract.match(a, b)
        assert size == len(pairs) == brute_match(a, b) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == size


def test_broken_pages_take_linear_time():
    """Unclosed tags, quotes, comments and sections, end tags of nothing, deep menus: each well under a second for 60 kB."""
    for part in ("<a <", "<div ", '<a x="', "<a x='>", "<![CDATA[", "<!--", "<script>", "</div>", "<ul><li>", "<div class=ad>", "<form><p>", '<a ">" ', "<p><b>", "<li><dt>", "<nav>"):
        began = time.process_time()
        html_extract.extract("<body><article><p>Text.</p></article>" + part * (60_000 // len(part)))
        assert time.process_time() - began < 2, part
    long = "<body><nav>" + "<ul><li>m" * 20_000 + "</li></ul>" * 20_000 + "</nav><article><p>" + "Some text. " * 100_000 + "</p></article></body>"
    began = time.process_time()
    assert html_extract.extract(long) == ("Some text. " * 100_000).strip()
    assert time.process_time() - began < 10
    assert html_extract.extract("<div>" * 200 + "<nav>menu</nav><form>f</form>text" + "</div>" * 200 + "after") == "text after"
    assert html_extract.extract('<article><p>It is 1 < 2 and <b>so</b>.</p><p title="a > b">Next.</p></article>') == "It is 1 < 2 and so. Next."


def test_the_wrapper_decides(spark):
    """What stands the same on a host's pages goes, inside articles too, whatever it is called; copies of an article stay."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(rng.choice(["one", "two", "tree", "four", "five", "sixth"], n))
    own = [[f"Story {i} {words(9)}.", f"More {i} {words(9 + i)}."] for i in range(10)]
    page = lambda b: "<body><div class=x1><ul><li>Home</li><li>News</li></ul></div><article><h1>%s</h1><p>%s</p><p>Thank you for reading this page.</p></article><div class=x2>All ours</div></body>" % tuple(b)
    rows = [(i, "http://h.example/", page(b)) for i, b in enumerate(own)]
    rows += [(20 + i, "http://copies.example/", page(own[0] if i % 4 else own[i])) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    for i, b in enumerate(own):
        assert got[i] == " ".join(b)
        assert html_extract.extract(page(b)) != got[i]  # without its host
    assert all(" ".join(own[0]) in got[20 + i] for i in range(12) if i % 4)
    # the same by shuffled joins, as where hosts are many
    joined = html_extract.extract_pages(df, small_hosts=0, small_bytes=0)
    assert {r.page_id: r.text for r in joined.collect()} == got
