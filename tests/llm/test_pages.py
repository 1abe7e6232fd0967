import pytest

from souklens.llm import pages as p


def text(html, template=frozenset()):
    return p.Page(html).main_text(template)


ARTICLE = """<!DOCTYPE html><html><head><title>No &amp; title</title><style>p{}</style><script>var t="</p><article>x";</script></head>
<body class="sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy</div>
<article><h1>Head  &eacute;&#x21;</h1><p><b>One.<br><p>Two
 &nbsp; <i>three</i>four</p><ul><li>item<li>next <b>bold</b></ul><div id="comments"><p>Me too</p></div>
<form><label>Name</label><input></form><aside>side</aside><p>a &lt;b&gt; &amp;amp; c &copy 5</p>last</article>
<section class="comments"><article class="comment"><p>reader</p></article></section><footer>&copy; host</footer></body></html>"""


def test_article_without_the_rest():
    assert text(ARTICLE) == "Head é!\nOne.\nTwo threefour\nitem\nnext bold\na <b> &amp; c © 5\nlast"


@pytest.mark.parametrize("html,want", [
    ("", ""), ("plain", "plain"), ("<p>open <b>bold", "open bold"), ("a < b <3 c", "a < b <3 c"), ("<!-- never ends <p>x</p>", ""),
    ("<article></article><p>body</p>", "body"), ("<main><p>m</p></main><p>not</p>", "m"),
    ("<div role=main>r</div>out", "r"), ("<p>one<div>two</div>three", "one\ntwo\nthree"), ("</p></div>x", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p hidden>h</p><p style='display: none'>n</p><p>v</p>", "v"),
    ("<p title='a > b'>t</p>", "t"), ("<p title='open>t</p>", "t"), ("<ul><li><a href=x>link</a></li></ul><p>text <a>l</a></p>", "text l"),
    ("<article><p>x</p><article class=comment>no</article></article>", "x"), ("<textarea><p>no</textarea>yes", "yes"),
    ("<script>never ends", ""), ("<P>Up</P><ARTICLE>case</ARTICLE>", "case"), ("<p>a \n b</p>", "a b"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\nd\nu"), ("<article><header><h2>t</h2></header>x<footer>f</footer></article>", "t\nx")])
def test_markup(html, want):
    assert text(html) == want


@pytest.mark.parametrize("html,want", [
    ('<div class="has-sidebar"><article><p>x</p></article></div>', "x"), ('<article class="post comments-open"><p>x</p></article>', "x"),
    ('<main class="with-sidebar"><p>x</p></main>', "x"), ('<main id="search"><p>x</p></main>', "x"),
    ('<div class="widget"><article><p>x</p><div class="ad">buy</div></article></div>', "x"),
    ('<article class="sponsored post"><p>x</p></article>', "x"), ('<div class="social"><main><p>x</p></main></div>', "x"),
    ('<article><h2 id="search-algorithms">h</h2><section id="related-work"><p>x</p></section></article>', "h\nx"),
    ('<article><h2 id="search">h</h2><section id="related"><p>x</p></section></article>', "h\nx"),
    ('<div class="overlay"><p>the only text</p></div>', "the only text"),
    ('<p>story</p><div class="comments"><article class="comment">reader</article></div>', "story"),
    ('<article><div class="ad"><p>buy</p></div><p>x</p></article>', "x"), ('<div class="big ad">buy</div><p>x</p>', "x")])
def test_names_take_no_article(html, want):
    assert text(html) == want


def test_long_and_deep_pages():
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<p>" + "w " * 300_000) == ("w " * 300_000).strip()
    assert len(text("<" * 20_000)) == 20_000


def test_template_of_a_host_goes(spark):
    def page(k, host, notice="Read our house rules before you write."):
        return (k, f"https://{host}/{k}", f"<body><div><p>Menu of {host}</p></div><p>Story {k} of a day.</p>"
                f"<p>{notice}</p><article><p>{'Shared line.' if k % 3 == 0 else f'Own {k}.'}</p><section>{notice}</section></article></body>"
                if k % 4 else f"<body><div><p>Menu of {host}</p></div><p>Story {k} of a day.</p><p>{notice}</p></body>")
    rows = [page(k, "big.example") for k in range(40)] + [page(100 + k, "small.example") for k in range(4)]
    rows += [(900, None, "<p>no url</p>"), (901, "not a url", None), (902, "https://big.example/x", ""), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, template int")
    got = {r["page_id"]: r["text"] for r in p.main_texts(frame).collect()}
    assert p.main_texts(frame).count() == len(rows)
    for k in range(40):
        # The notice is on every page and goes, inside the article too; the line that a quarter of the pages share stays.
        assert got[k] == ((f"Own {k}." if k % 3 else "Shared line.") if k % 4 else f"Story {k} of a day.")
    assert got[100] == "Menu of small.example\nStory 100 of a day.\nRead our house rules before you write."
    assert (got[900], got[901], got[902]) == ("no url", "", "")
    assert p.main_texts(frame.limit(0)).collect() == []


def test_articles_stay_whole_however_often_they_recur(spark):
    def page(k, article):
        return (k, f"http://copies.example/{k}", f"<body><div><p>Menu</p></div>{article}<div><p>Imprint</p></div></body>")
    copy = "<article><h2>News</h2><p>The same story.</p></article>"
    rows = [page(k, copy) for k in range(30)]
    rows += [page(k, f"<div><article><h2>News</h2><p>Story {k}.</p><ul><li>Share it</ul></article></div>") for k in range(30, 45)]
    rows += [page(k, f"<p>Plain {k}.</p>") for k in range(45, 50)] + [page(50, "<main><p>Menu</p><p>In main.</p></main>")]
    # A body without an article that most of a host's rows repeat is one page, not a template.
    rows += [(100 + k, "http://body.example/", "<p>Only text.</p>") for k in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in p.main_texts(frame).collect()}
    assert all(got[k] == "News\nThe same story." for k in range(30))
    assert all(got[k] == f"News\nStory {k}.\nShare it" for k in range(30, 45))
    assert all(got[k] == f"Plain {k}." for k in range(45, 50))
    assert got[50] == "Menu\nIn main."
    assert all(got[100 + k] == "Only text." for k in range(30))


def test_the_method_alone_cleans_pages_without_semantic_tags(spark):
    """No tag, class or word of these pages is known to the lists: menus with other entries on every page go by their
    skeleton, the notice by its text, inside the main element too; what belongs to a page stays."""
    words = "amber basil cedar delta ember fjord grove haven inlet jetty".split()

    def links(k, n):
        return "".join(f'<span class="q"><a href="/{k}/{j}">{words[(k * 7 + j * 3) % 10]} {k}</a></span>' for j in range(n))

    def page(k, host="h.example"):
        return (k, f"http://{host}/{k}", f'<body><div class="x1"><p>Story {k} begins here.</p><div class="x2">{links(k, 3 + k % 4)}</div>'
                f'<p>It has <a href="/{k}">one link {k}</a> in its text.</p><div>All rights belong to nobody at all.</div><p>End {k}.</p></div></body>')
    inside = [(k, u, h.replace('<div class="x1">', '<div role="main">')) for k, u, h in (page(100 + k, "m.example") for k in range(20))]
    rows = [page(k) for k in range(20)] + inside + [page(200, "lone.example")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in p.main_texts(frame).collect()}
    for k in [*range(20), *range(100, 120)]:
        assert got[k] == f"Story {k} begins here.\nIt has one link {k} in its text.\nEnd {k}."
    assert "All rights" in got[200]  # a host of one page has no template


def brute_templates(rows, share=0.5, least=10):
    """Subtrees counted by host over the different pages, page by page."""
    seen = {}
    for url, html in rows:
        if host := p.host_of(url):
            page = p.Page(html or "")
            seen.setdefault(host, {}).setdefault(page.identity(), set()).update(page.subtrees())
    out = {}
    for host, pages in seen.items():
        for s in set().union(*pages.values()):
            n = sum(s in have for have in pages.values())
            if n >= least and n >= share * len(pages):
                out.setdefault(host, set()).add(s)
    return out


@pytest.mark.parametrize("share,least", [(0.5, 10), (0.02, 2)])
def test_templates_of_the_test_table(spark, share, least):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r["host"]: set(r["template"]) for r in p.site_templates(pages, share, least).collect()}
    assert got and got == brute_templates([(r["url"], r["html"]) for r in pages.select("url", "html").collect()], share, least)


@pytest.mark.parametrize("url,host", [("http://A.b.C:80/x", "a.b.c"), ("https://u:p@h.x?q", "h.x"), ("//h.y/z", "h.y"), ("", ""),
                                      (None, ""), ("mailto:a@b", ""), ("http://dot./", "dot"), ("HTTP://Q#f", "q")])
def test_hosts_are_the_same_in_both_places(spark, url, host):
    assert p.host_of(url) == host
    got = p.main_texts(spark.createDataFrame([(1, url, "<p>x</p>")], "page_id long, url string, html string")).collect()
    assert got[0]["text"] == "x"


def test_query_on_the_test_table(spark):
    sf = "/root/testdata/sf0.001"
    got = p.op5_template_removal(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"] for r in got)
    assert all(not line.startswith("©") for r in got for line in r["text"].split("\n"))
