import random
import tracemalloc

from tidemark.llm import html


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(4000):
        a, b = ([draw.randint(0, 4) for _ in range(draw.randint(0, 9))] for _ in range(2))
        places = html.shared(a, b)
        assert places == sorted(set(places)) and len(places) == longest(a, b)
        picked, rest = [a[i] for i in places], iter(b)
        assert all(x in rest for x in picked)


def test_long_pages_are_aligned_in_halves():
    draw = random.Random(4)
    limit, html._TABLE = html._TABLE, 6
    for _ in range(2000):
        a, b = ([draw.randint(0, 4) for _ in range(draw.randint(0, 12))] for _ in range(2))
        places = html.shared(a, b)
        assert places == sorted(set(places)) and len(places) == longest(a, b)
        picked, rest = [a[i] for i in places], iter(b)
        assert all(x in rest for x in picked)
    html._TABLE = limit
    a, b = ([draw.randint(0, 10**6) for _ in range(40_000)] for _ in range(2))
    tracemalloc.start()
    html.shared(a, b)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def text(page, also=()):
    return html.main_text(html.lines(page), set(also))


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav>
    <div class="ad">Buy</div><article><h1>A &amp; B</h1><p>one <b>two</b>three<br>four
    five<p>six<div class="comment-list"><p>reader</p></div><aside>side</aside><form>f</form><style>s</style><p>seven &copy; &amp;lt;</article>
    <footer>foot</footer></body></html>"""
    assert text(page) == "A & B one twothree four five six seven © &lt;"


def test_page_without_main_element_loses_shared_lines():
    page = "<body><div>Site</div><p>own text</p><div>Imprint</div></body>"
    places = html.shared([x.text for x in html.lines(page)], ["Site", "other", "Imprint"])
    assert text(page, places) == "own text"


def test_odd_pages():
    assert text("") == "" and text("plain") == "plain"
    assert text("a < b <c") == "a < b" and text("<p>x<!-- > --> y</p>") == "x y" and text("<p>5 <script>") == "5"
    assert text("<p title='a>b'>q</p>" * 3) == "q q q"
    assert len(html.lines("<p>" * 20000 + "<" * 20000)) == 1
    assert text("<div" + ' a="' * 5000) == ""
    assert text("<p title=don't>x</p> <a href=\"it's\">y</a> <i a='\"'>z</i>") == "x y z"
    assert len(text("<b>" * 50_000 + "x" + "</i></div>" * 50_000)) == 1


def test_only_a_real_hidden_attribute_hides():
    for shown in ('style="overflow:hidden"', 'data-hidden="false"', 'href="/hidden/"', "title='class=menu hidden'", "data-id=menu"):
        assert text(f"<article><p>one</p><div {shown}>two</div></article>") == "one two"
    for gone in ("hidden", 'hidden=""', 'title="x" HIDDEN', "aria-hidden=true", "class='menu'"):
        assert text(f"<article><p>one</p><div {gone}>two</div></article>") == "one"


def test_copies_do_not_empty_each_other(spark):
    body = "<body><div>Site</div><p>own words</p></body>"
    rows = [(1, "http://a/x", body), (2, "http://a/x", body), (3, "http://b/1", body), (4, "http://b/1", body), (5, "http://b/2", body.replace("own", "new"))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Site own words", 2: "Site own words", 3: "Site own words", 4: "own words", 5: "new words"}


def test_names_inside_an_article_count_only_where_they_say_one_thing():
    kept = """<article><p>plain</p><p class="share price">quote</p><div class="notice-period">months</div>
    <section id="related-work">others</section><h2 id="comment">remark</h2><span class="ad">word</span></article>"""
    assert text(kept) == "plain quote months others remark word"
    gone = """<article><p>plain</p><div class="ad">buy</div><div class="comments open"><p>reader</p></div><ul class="menu"><li>home</li></ul>
    <div id="notice">we use</div><form><input>f</form><aside>x</aside></article>"""
    assert text(gone) == "plain"


def test_blocks_around_the_article_do_not_hide_it():
    assert text("<form id=aspnet><nav>menu</nav><article><p>words</p><form>ask</form></article><div>foot</div></form>") == "words"
    assert text("<div class='with-sidebar'><article><p>words</p><div class=ad>x</div></article></div>") == "words"
    assert text("<article><p>words</p></article><div class=comments><article>reader</article></div>") == "words"
    assert text("<aside><article>teaser</article></aside><main><p>words</p></main>") == "words"


def test_what_a_neighbour_tells():
    page = lambda *xs: [html.hashed_line(html.Line(t, False, False, p)) for t, p in xs]
    own = page(("Site", False), ("a", True), ("quote", True), ("b", True))
    tell = lambda other: html.told(own, html.shared(own, other), other)
    assert tell(page(("Site", False), ("quote", True), ("c", True), ("d", True))) == (True, [0], [2])
    assert tell(page(("Site", False), ("a", True), ("quote", True), ("e", True))) == (True, [0], [])  # a version
    assert tell(own) == (False, [], []) and tell(own[:2]) == (False, [], [])


def test_quotations_stay_and_template_goes(spark):
    """Pages without a main element: a passage that one neighbour quotes stays, a paragraph that all repeat goes."""
    rows = []
    for i in range(8):
        own = "".join(f"<p>own {i} {j}</p>" for j in range(6))
        quote = "<p>the quoted passage</p>" if i in (3, 4) else ""
        rows.append((i, f"http://a/{i}", f"<body><div>Site</div>{own}{quote}<p>All rights reserved</p><div>Imprint</div></body>"))
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        want = " ".join(f"own {i} {j}" for j in range(6)) + " the quoted passage" * (i in (3, 4))
        edge = " All rights reserved" if i in (0, 7) else ""  # only one neighbour
        assert got[i]["text"] == want + edge
        assert got[i]["n_shared"] == (3 if 0 < i < 7 else 2) and got[i]["n_structure"] == 0
    versions = [(i, f"http://v/{i}", "<body>" + "".join(f"<p>part {j}</p>" for j in range(9)) + f"<p>edit {i}</p></body>") for i in range(4)]
    got = html.extract(spark.createDataFrame(versions, "page_id long, url string, html string")).collect()
    assert all(r["text"] == " ".join(f"part {j}" for j in range(9)) + f" edit {r['page_id']}" for r in got)


def test_pairs_decide_outside_the_article(spark):
    head = "<div>Site</div><p>Welcome</p>"
    rows = [(i, f"http://a/{i}", f"<body>{head}<article><p>own {i}</p><p>Site</p></article><span>unshared {i}</span></body>") for i in range(3)]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: f"own {i} Site" for i in range(3)}
    assert (got[1]["n_lines"], got[1]["n_shared"], got[1]["n_structure"]) == (5, 1, 2)
