import html
import re

from grovecast.llm import htmltext

LONG = "This sentence stands for a paragraph of the article and is long enough to look like one, as it should. "


def test_pages_of_the_tables(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = htmltext.op10_html(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_without_article_element():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><div class='header'><a href='/'>Home</a> <a href='/b'>News</a></div>"
        "<div id='cookie-notice'><p>" + LONG + "We use cookies.</p></div><div class='sidebar'><ul><li><a href='x'>One</a><li><a href='y'>Two</a></ul></div>"
        "<div class='content'><h2>Head &amp; tail</h2><p>" + LONG * 2 + "<p>First\n  <i>second</i>&nbsp;third<br>fourth<p>" + LONG + "<div class='ad'>Buy</div><p>" + LONG + "</div>"
        "<div class='comments'><p>" + LONG + "says a reader</p></div><form><p>" + LONG + "</p><input></form><script>var x = '<p>no</p>'</script><div class='footer'>end</div></body></html>"
    )
    assert htmltext.main_text(page).split("\n\n") == ["Head & tail", (LONG * 2).strip(), "First second third fourth", LONG.strip(), LONG.strip()]


def test_article_with_extras():
    page = "<body><header>Site</header><article><header><h1>T</h1></header><p>a</p><aside>b</aside><section class=comments><p>" + LONG * 3 + "</p></section><p>c &lt; d</p></article><footer>f</footer>"
    assert htmltext.main_text(page) == "T\n\na\n\nc < d"


def test_broken():
    assert htmltext.main_text("plain text, no tags at all") == "plain text, no tags at all"
    for x in (None, "", "<", "<!", "<![", "<p", "<nav>only a menu</nav>", "<script>x", "<!-- no end"):
        assert "only" not in htmltext.main_text(x) and isinstance(htmltext.main_text(x), str)
    assert htmltext.main_text("<article>" + "<div>" * 3000 + "<p>deep</p>") == "deep"


def test_marked_sections_and_unclosed_tags():
    assert htmltext.main_text("<p>hi there</p><![foo[bar]]><p>and on</p>") == "hi there\n\nand on"
    for x in ("<![foo[", "<![foo[bar", "<!]>", "<![CDATA[x]]>", "<!doctype [", "<!ELEMENT br EMPTY>", "<?php", "</", "</>", "<a<b>c", "&#xFFFFFFF;", "<!--" * 1000):
        assert htmltext.main_text("<article><p>one</p>" + x).startswith("one")
        htmltext.main_text(x)
    assert htmltext.main_text("<article><p>" + "<b>" * 100_000 + "deep</p><p>next" + "</i>" * 100_000) == "deep\n\nnext"
    assert htmltext.main_text("<article><i>" + ("<div>x" + "</i>") * 50_000).count("x") == 50_000
    for x in ("<!--", "<a ", "<p a='", "<!", "<![foo["):
        assert htmltext.main_text("<p>one</p>" + x * 100_000) == "one"


def test_ratios_select_inside_an_article():
    links = "".join(f"<li><a href='{k}'>Other story {k}</a></li>" for k in range(8))
    page = f"<article><h1>Title</h1><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p><p>Short end.</p><ul><li>one</li><li>two</li></ul></article>"
    assert htmltext.main_text(page).split("\n\n") == ["Title", LONG.strip(), LONG.strip(), "Short end.", "one", "two"]
    assert htmltext.main_text("<article><p>Let <math><mi>x</mi></math> be</p></article>") == "Let x be"


def test_edges(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "v", "<article><p>x</p></article>", 3), (3, "v", "<article><p>x</p></article>", 3), (None, "w", "<p>" + LONG * 20000, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = [(r.page_id, r.url, r.n_chars) for r in htmltext.extract(df).collect()]
    assert got == [(1, "u", 0), (2, None, 0), (3, "v", 1), (3, "v", 1), (None, "w", len(LONG) * 20000 - 1)]
    assert htmltext.extract(df.limit(0)).count() == 0
