"""The HTML tree, its selectors and the content of pages, by literal cases."""

import pytest
from tessera.operators import html

PAGE = """<!DOCTYPE html><html><head><title>Clustering — Site 1.2 documentation</title><style>p {}</style></head>
<body class="wide"><nav><h1>Guide  to <em>things</em></h1><a href="/a">Menu</a></nav>
<header class="page-header">Banner</header>
<div class="sidebar note"><p>Side</div>
<div class="document"><div class="body" id="main">
<h2>K-means<a class="headerlink" href="#k">#</a></h2><p>First para<p>Second <b>bold</b>, text
with a line<script>var x = "<p>no</p>";</script>
<ul><li>one<li>two <a class="viewcode-link reference">[source]</a></ul>
<div class="admonition sphx-glr-download-link-note">Download</div><div class="admonition">Kept &amp; shown</div>
<h3>%s</h3><!-- comment --></div></div><footer>Foot <h2>Footer head</h2></footer></body></html>""" % ("long " * 60)


def test_page():
    title, content, sections = html.page(PAGE)
    assert title == "Guide to things"  # also where the first h1 is in what is removed
    assert content.startswith("K-means First para Second bold , text\nwith a line one two Kept & shown long")
    assert sections == ["K-means"]


def test_titles():
    assert html.page("<title>Trees | Site</title><p>x", site="site")[0] == "Trees"
    assert html.page("<title>Trees — Site 1.0</title><p>x", site="Site")[0] == "Trees"
    assert html.page("<title>Trees | Site</title><p>x")[0] == "Trees | Site"
    assert html.page("<p>text") == ("Untitled Document", "text", [])
    assert html.page(None) == html.page("") == ("Untitled Document", "", [])


@pytest.mark.parametrize("selected, texts", [
    ("li", ["1", "2", "3"]), ("ul.a > li", ["1", "2"]), (".a li", ["1", "2", "3"]), ("#x", ["2"]), ("li[data-k]", ["1", "3"]), ("li[data-k=v]", ["1"]),
    ("[data-k^=w]", ["3"]), ("li.b.c, li#x", ["1", "2"]), ("ol > .c", []), ("*[data-k$=v2]", ["3"]),
])
def test_selectors(selected, texts):
    root = html.parse('<ul class="a b"><li class="b c" data-k=v>1<li id=x>2<ol><li data-k="wv2">3</ol></ul>')
    assert [n.text().strip("\n")[:1] for n in html.select(root, selected)] == texts


def test_tolerance():
    root = html.parse("</b><table><tr><td>a<td>b<tr><th>c</table><p>x<div>y</p>z</div><br/><img src=q>w")
    assert len(html.select(root, "tr")) == 2 and len(html.select(root, "td")) == 2 and html.first(root, "th").text() == "c"
    assert html.first(root, "div").parent.tag == "" and root.text(" ", strip=True) == "a b c x y z w"
    deep = html.parse("<div>" * 5000 + "x")
    assert deep.text() == "x" and html.page("<div>" * 5000 + "x")[1] == "x"
    for wrong in ("", "> a", "a >", "a:hover", "a,,b"):
        with pytest.raises(ValueError):
            html.selector(wrong)


def test_content_selectors_in_order():
    both = "<body><article>art</article><main>main</main><div class='x document'>doc</div></body>"
    assert html.page(both)[1] == "doc"
    assert html.page(both.replace("document", "other"))[1] == "main"
    assert html.page("<body><article>art</article>rest</body>")[1] == "art"
    assert html.page("<body>all <i>of</i> it</body>")[1] == "all of it"
