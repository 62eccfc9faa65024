"""Wrapper induction on small hosts; tree matching against enumeration."""

import random
from functools import lru_cache

from reviewlake.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>t{n}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<div id="top">The Daily Example</div><nav><a href=/>Home {n}</a></nav><div class="ad-box">Buy {n}!</div>
<div class="story"><h1>Title {n}</h1><p>Body&nbsp;of <b>page</b> {n}<br>with a &lt;break&gt;.<p>Second &amp; last {n}</div>
<ul><li><a href=1>More {n}</a><li><a href=2>Links {n}</a></ul><div class="user-comments"><p>Nice {n}</p></div>
<form><p>Name {n}</p></form><div>All rights reserved</div><footer>bye {n}</footer></body></html>"""


def run(spark, rows, schema="page_id long, url string, html string"):
    return {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, schema)).collect()}


def test_template_and_furniture_go_content_stays(spark):
    rows = [(n, f"https://a.example.com/{n}", PAGE.format(n=n)) for n in range(12)]
    rows += [(100, "http://b.example.com/x", "<body><article><p>Only one page.</p></article><footer>f</footer>"), (101, None, None), (102, "nonsense", ""),
             (103, "http://b.example.com/y", "no markup at\n all"), (104, "http://c.example.com", "<p>cut off &am"), (105, "http://c.example.com/2", "<div class='x")]
    got = run(spark, rows)
    for n in range(12):
        assert got[n] == f"Title {n}\n\nBody of page {n} with a <break>.\n\nSecond & last {n}"
    assert (got[100], got[101], got[102], got[103], got[104]) == ("Only one page.", "", "", "no markup at all", "cut off &am")


def test_copies_of_an_article_are_no_template(spark):
    page = "<body><main><h1>Same</h1><p>Words of the same article.</p></main></body>"
    rows = [(n, "http://a.example.com/", page) for n in range(20)] + [(50, "http://a.example.com/o", page.replace("ame", "ome"))]
    got = run(spark, rows)
    assert {got[n] for n in range(20)} == {"Same\n\nWords of the same article."} and got[50].startswith("Some")


def test_lists_and_tables_keep_page_order(spark):
    html = "<article><p>a</p><ul><li>b<li>c</ul><p>d</p><table><tr><td>e<td>f<tr><td>g</table><header>h</header>i <i>j</i><div>k</div> l</article>"
    assert run(spark, [(1, "http://x.example", html)])[1] == "\n\n".join("abcdefgh") + "\n\ni j\n\nk\n\nl"


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    long = "<article>" + "".join(f"<h2>h{i}</h2><p>p{i}" for i in range(5000)) + "</article>"
    got = run(spark, [(1, "http://a.example", deep), (2, "http://a.example", long)])
    assert got[1] == "x" and got[2].count("\n\n") == 9999


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, "http://x.example", "<p>a</p>", "b", "c")], "page_id long, url string, html string, text string, URL string") == {1: "a"}


def test_matching_is_the_largest():
    rng = random.Random(4)

    def tree(depth):
        return [rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randrange(0, 4))] if depth else []]

    def size(a, b):
        if a[0] != b[0]:
            return 0

        @lru_cache(None)
        def rows(i, j):
            if i == len(a[1]) or j == len(b[1]):
                return 0
            both = size(a[1][i], b[1][j])
            return max(rows(i + 1, j), rows(i, j + 1), both + rows(i + 1, j + 1) if both else 0)

        return 1 + rows(0, 0)

    for _ in range(60):
        a, b = tree(3), tree(3)
        b[0] = a[0]
        assert H.match(a, b)[0] == size(a, b)


def test_every_node_finds_its_place():
    shapes = [["#", [["div.a", [["p", []]]], ["ul", []]]], ["#", [["ul", []], ["div.b", []]]], ["#", [["div.a", []], ["div.b", [["p", []]]]]]]
    wrapper = ["#", []]
    for s in shapes:
        H.merge(wrapper, s)
    for s in shapes:
        found = H.place(wrapper, s)
        assert -1 not in found and len(set(found)) == len(found)


def test_large_hosts_are_aligned_in_parts(spark, monkeypatch):
    monkeypatch.setattr(H, "SHAPES_PER_TASK", 2)
    tail = ["<aside><p>x</p></aside>", "<section><p>s {n}</p></section>", "<blockquote>q {n}</blockquote>", "<table><tr><td>c {n}</table>", "<ul><li>l {n}</ul>"]
    rows = [(n, "http://a.example/", f"<div id=x>Banner of the site</div><main><p>Text {n}</p>" + "".join(
        tail[i].format(n=n) for i in range(5) if n >> i & 1) + "</main>") for n in range(32)]
    got = run(spark, rows)
    for n in range(32):
        kept = [f"Text {n}", *(w.format(n=n) for i, w in enumerate(["", "s {n}", "q {n}", "c {n}", "l {n}"]) if i and n >> i & 1)]
        assert got[n] == "\n\n".join(kept)


def test_text_behind_marked_sections_stays():
    for section in ("<![ note ]>", "<![foo[x]]>", "<![endif]>", "<![if gte mso 9]>", "<![CDATA[x]]>", "<![CDATA[x>", "<![foo[x]]><![ bar>"):
        assert [t for _, t, _ in H.parse(f"<p>one</p>{section}<p>two</p><div>three</div>")[1]][-2:] == ["two", "three"], section


def test_the_wrapper_overrules_names(spark):
    bodies = {
        "a": "<form id=aspnetForm><div><p>Text of page {n}.</p><p>More of page {n}.</p></div><fieldset><p>Name {n}</p></fieldset></form>",
        "b": "<div class='content has-sidebar'><p>Text of page {n}.</p><p>More of page {n}.</p></div><div class=sidebar-left><p>Side {n}</p></div>",
        "c": "<article class='post comments-open category-social'><p>Text of page {n}.</p><p>More of page {n}.</p></article><aside><article><p>Teaser {n}</p></article></aside>",
        "d": "<div class=widget><div><article><p>Text of page {n}.</p><p>More of page {n}.</p></article></div></div><div id=comments><p>Comment {n}</p></div>",
        "e": "<div id=related><div><p>Text of page {n}.</p><p>More of page {n}.</p></div></div><nav><p>All of this menu is longer than the text of the page {n}, much longer</p></nav><div class=user-comments>No {n}</div>",
    }
    rows = [(100 * k + n, f"http://{h}.example/{n}", f"<body>{body.format(n=n)}</body>") for k, (h, body) in enumerate(bodies.items()) for n in range(8)]
    got = run(spark, rows)
    # In e the menu holds most of the text, so nothing speaks against the name of the rest.
    assert got == {i: "" if i >= 400 else f"Text of page {i % 100}.\n\nMore of page {i % 100}." for i, _, _ in rows}


def test_whole_names():
    for name in ("comments", "user-comments", "ad-box", "comment-body", "sidebar-left", "AdBox-ad"):
        assert H.named_furniture(name), name
    for name in ("has-sidebar", "comments-open", "category-social", "aspnetForm", "tag-popular", "content", "post"):
        assert not H.named_furniture(name), name
