import html
import re
import time

import pytest

from certalog.llm import html as pages

TREE = pages.fit_tree()


def article(page):
    """The article of the pages in the given tables, by their one template."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "")).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in pages.extract(rows).collect()}
    assert len(got) == rows.count()
    for r in rows.collect():
        assert got[r.page_id] == article(r.html)


def test_tree_fits_its_table():
    assert all(pages.label(TREE, r[:-1]) == r[-1] for r in pages.LABELLED)


def used(tree):
    return set() if isinstance(tree, int) else {pages.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def test_tree_splits_on_words_and_neighbours():
    assert {"words", "links", "words_before", "words_after", "links_before", "away", "place"} <= used(TREE)


PROSE = [
    "The harbour was quiet when the first boats came in, and nobody on the quay had yet heard what the crews would tell them later.",
    "Short one.",
    "It took the town a full week to agree on what had been seen out there, as each of the crews told the story in its own way and order.",
    "By spring most people had stopped asking, and the charts that the mate had drawn were put away in the attic of the customs house.",
]
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/about>About us</a></li></ul>"
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in PROSE)


@pytest.mark.parametrize(
    "page",
    [
        # layout classes on the page, the article or around it
        "<html><body class='single right-sidebar'><div class=menu>%(menu)s</div><article>%(text)s</article></body></html>",
        "<body>%(menu)s<article class='post type-post category-news tag-foo'>%(text)s</article><footer>Imprint</footer></body>",
        "<body>%(menu)s<article class='post has-comments'>%(text)s</article></body>",
        "<body>%(menu)s<div class=page-search><article>%(text)s</article></div></body>",
        "<body class=search><main class='no-comments header'>%(text)s</main><div class=sidebar>About this site and its many friends</div></body>",
        # a form around the whole page
        "<body><form id=aspnet action=/>%(menu)s<article>%(text)s</article><input type=submit></form></body>",
        # no article element: words and links decide
        "<body><div id=top>%(menu)s</div><div id=content>%(text)s</div><div>%(menu)s</div></body>",
        "<table><tr><td>%(menu)s</td><td>%(text)s</td></tr></table>",
        "<div class=wrap><div class='ad'>Buy our fine goods today, they are cheaper than ever before and go fast.</div>%(text)s</div>",
        # readers' comments as articles of their own, related pages, a cookie notice
        "<article>%(text)s<ul class=related><li><a href=/1>One more</a></li></ul></article><section id=comments><article>%(text)s</article></section>",
        "<div class='cookie-banner top'>We use cookies and so on, for many reasons that are long to tell.</div><article>%(text)s</article>",
        "<main>%(text)s<h3>Related</h3><aside>%(menu)s</aside></main>".replace("<h3>Related</h3>", ""),
        # broken markup
        "<nav>%(menu)s<article><svg width=1/>%(text)s</article>",
        "<article>%(text)s</article><div title=\"never closed>",
        "<article><img alt='it\"s' src=x>%(text)s<!-- open",
    ],
)
def test_templates(page):
    assert pages.main_text(page % {"menu": MENU, "text": PARAGRAPHS}, TREE) == "\n".join(PROSE)


@pytest.mark.parametrize("unit", ['<a b="', '<a b=">', "<a b='\">", "</div>", "<div>", "<nav>x", "<!", "<!--", "<", "&amp", "<script>", "<p class=ad>x", "<a b=x' "])
def test_hostile_markup_takes_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    start = time.process_time()
    pages.main_text(page, TREE)
    assert time.process_time() - start < 10


def test_text_kept_in_an_article():
    page = "<article><header><h1>Title here</h1></header><noscript>Scripts are off.</noscript><object>Fallback</object><p>End</p></article>"
    assert pages.main_text(page, TREE) == "Title here\nScripts are off.\nFallback\nEnd"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=/>Home</a></nav><p>Tyger Tyger, burning bright,</p><p>In the forests of the night;</p><div class=footer>Imprint</div>", "Tyger Tyger, burning bright,\nIn the forests of the night;"),
        ("<nav><a href=/>Home</a></nav><h1>News today</h1><p>The shop is closed.</p>", "News today\nThe shop is closed."),
        ("<body><form id=aspnetForm><ul class=menu><li>Home</li></ul><p>The shop is closed until the end of the week, for all who ask.</p><input></form>", "The shop is closed until the end of the week, for all who ask."),
        ("<p>The shop is closed until the end of the week, for all who ask.</p><form>Your name <input></form>", "The shop is closed until the end of the week, for all who ask."),
        ("   ", ""),
        ("<p>Plain words stand here.</p>", "Plain words stand here."),
        ("<article><p>a &amp; b &lt;c&gt; &eacute;&#33;&#x3f;</p></article>", "a & b <c> é!?"),
        ("<article><p>one\n\t two<br>three <b>fo</b>ur</p><p> </p></article>", "one two three four"),
        ("<article><h2>Head</h2><ul><li>x<li>y</ul></article><p>After the article there is more.</p>", "Head\nx\ny"),
        ("<nav><a href=/>Home</a></nav><main><p>Body text</p></main><aside>Side text goes here</aside>", "Body text"),
        ("<article>Before<script>if (a < b) { x = '</p>' }</script> after</article>", "Before\nafter"),
        ("<article>Text <!-- <p>no</p> --> goes on</article>", "Text goes on"),
        ("<article>cut off <b>here", "cut off here"),
        ("<article>cut off in &am", "cut off in &am"),
        ("<article><p>Kept</p><div class='comments'><p>Nice post!</p></div><form>Name <input></form></article>", "Kept"),
        ("<article><p>Kept</p><section id=\"reader-comments\"><article><p>Nice!</p></article></section></article>", "Kept"),
        ("<div class=cookie-notice>We use cookies on this site.</div><article>Kept</article>", "Kept"),
        ("<article><p title=\"a > b\">Kept</p></article>", "Kept"),
        ("<div><a href=/1>One</a></div><div><a href=/2>Two</a></div><div>A long paragraph with many words and no link at all in it.</div>", "A long paragraph with many words and no link at all in it."),
    ],
)
def test_small_pages(page, text):
    assert pages.main_text(page, TREE) == text


def test_long_pages_and_columns(spark):
    long = "<article>" + "<p>word word</p>" * 100_000 + "</article>"
    df = spark.createDataFrame([(1, "u", long, "x"), (1, None, None, "y"), (None, "v", "<", "z")], "page_id long, url string, html string, text string")
    got = pages.extract(df).collect()
    assert [len(r.text.split("\n")) for r in got if r.url == "u"] == [100_000]
    assert [r.text for r in got if r.url is None] == [""]
    assert pages.extract(df.limit(0)).collect() == []
