"""Wrappers and main texts, on written pages and against a plain reading of the tables' articles."""

import html
import re

import pytest
from pyspark.sql import functions as F

from cohortlink.llm import wrappers as w
from cohortlink.llm.queries import page_text


def text_of(*pages):
    wrapper = w.expression(w.parse(pages[0]))
    for page in pages[1:]:
        wrapper = w.merge(wrapper, w.expression(w.parse(page)))
    return w.main_text(pages[0], w.main_part(wrapper))


BODY = "<p>First  paragraph&nbsp;of &lt;it&gt;.</p>\n<p>Second <b>bold</b><i>er</i> one<br>line</p>"
PAGES = [
    (f"<body><nav>menu</nav><article><h1>T&amp;T</h1>{BODY}</article><footer>f</footer>",
     "T&T\nFirst paragraph of <it>.\nSecond bolder one line"),
    (f"<body><header>site</header><main>{BODY}<aside>side</aside><form>x<input></form></main><div class='cookie-notice'>ok</div>",
     "First paragraph of <it>.\nSecond bolder one line"),
    (f"<div id=menu><ul><li><a href=x>a</a><li><a>b</a></ul></div><div class='c1'><div>{BODY}</div></div><div>short</div>",
     "First paragraph of <it>.\nSecond bolder one line"),
    (f"<article>{BODY}<section class='comments'><article>Great post</article></section></article>",
     "First paragraph of <it>.\nSecond bolder one line"),
    ("<article><header class='entry-header'><h1>Title</h1></header><ul><li>one<li>two <em>2</em></ul><table><tr><td>a<td>b</table>"
     "<pre>x\n  y</pre></article>", "Title\none\ntwo 2\na\nb\nx y"),
    ("<article><p>open <b>bold<br><p>next</p>tail<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --></article>",
     "open bold\nnext\ntail"),
    ("<article><p>cut of", "cut of"), ("<article><p>ref &am", "ref &am"), ("<article>a < b &amp b<p", "a < b & b"),
    ("plain text\n\n only", "plain text only"), ("", ""), (None, ""), ("<p>", ""), ("</div></p>x", "x"),
    ("<article><div role=navigation>n</div><div hidden>h</div><div aria-hidden=true>h</div>t</article>", "t"),
    ("<div class=ad>ad</div>" + "<div>" * 3000 + "deep", "deep"),
    ("<article>" + "<p>word</p>" * 30_000 + "</article>", "\n".join(["word"] * 30_000)),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize("n", [150, 300, 5000])
def test_deep_elements_end_where_they_end(n):
    page = "<div><article><p>first</p>" + "<div>" * n + "<nav>menu</nav><p>deep</p><p>er</p>" + "</div>" * n + "<p>last</p></article></div>"
    assert text_of(page) == "first\ndeep\ner\nlast"
    assert text_of(page.replace("article", "main")) == "first\ndeep\ner\nlast"


@pytest.mark.parametrize("holder", ["div class='layout has-sidebar'", "div class=no-sidebar", "div class=content-with-menu", "div class=share-enabled",
                                    "div class='ad-free'", "form id=aspnetForm", "div class='sidebar'"])
def test_names_around_the_main_part_drop_nothing(holder):
    tag = holder.split()[0]
    page = f"<body><div class='cookie-notice'>ok</div><{holder}><article>{BODY}</article><div class='site-footer'>foot</div></{tag}></body>"
    assert text_of(page) == "First paragraph of <it>.\nSecond bolder one line"
    small = f"<body><article>{BODY}<form>name</form></article><div class=sidebar><article>x</article></div></body>"
    assert text_of(small) == "First paragraph of <it>.\nSecond bolder one line"
    if tag == "form":
        assert text_of(page.replace("article", "div")) == "First paragraph of <it>.\nSecond bolder one line"


def test_expressions():
    pages = ["<ul><li>a</li><li>b</li></ul><p>same</p>", "<ul><li>c</li></ul><h2>new</h2><p>same</p>", "<p>same</p>"]
    items = [w.expression(w.parse(p)) for p in pages]
    assert w.written(items[0]) == "<><ul>(<li>#</li>)+</ul> <p>#</p></>"
    both = w.merge(items[0], items[1])
    assert w.written(both) == "<><ul>(<li>#</li>)+</ul> (<h2>#</h2>)? <p>#</p></>"
    every = w.merge(both, items[2])
    assert w.written(every) == "<>(<ul>(<li>#</li>)+</ul>)? (<h2>#</h2>)? <p>#</p></>"
    ul, h2, p = every[4]
    assert p[4][0][4] and h2[4][0][4] and not ul[4][0][4][0][4]  # constant texts, and a slot
    pairs = w.expression(w.parse("<dl>" + "<dt>a<dd>b" * 5 + "</dl>"))
    assert w.written(pairs) == "<><dl>(<dt>#</dt>)+ (<dd>#</dd>)+</dl></>"
    many = w.expression(w.parse("".join(f"<x{i}>t</x{i}>" for i in range(500))))
    assert len(many[4]) <= w.MOST_KINDS and many[3] == 500


def test_other_pages_of_the_host_show_the_main_part():
    page = "<div><div class='x1'>Home News Sport Weather</div><div class='x2'><p>{}</p></div></div>"
    first, second = page.format("Short text."), page.format("A very long text about something. " * 30)
    assert text_of(first, second) == "Short text."


def test_columns(spark):
    rows = [(i, f"http://{'A' if i % 3 else 'b'}.example.com/x", p) for i, (p, _) in enumerate(PAGES[:2] * 5)]
    rows += [(90, None, "<article>no host</article>"), (91, "nonsense", None), (91, "nonsense", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).repartition(4)
    found = w.infer(pages)
    assert sorted(r.host for r in found.collect()) == ["", "a.example.com", "b.example.com"]
    got = w.extract(pages, found).collect()
    assert len(got) == len(rows)
    assert all(r.text == PAGES[r.page_id % 2][1] for r in got if r.page_id < 90)
    assert sorted(r.text for r in got if r.page_id >= 90) == ["", "", "no host"]
    assert w.infer(pages.limit(0)).count() == 0 and w.extract(pages.limit(0), found).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = page_text(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|section|table|tr|td)\b[^>]*>", article)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"</?(?:b|i|a|em)\b[^>]*>", "", b)))).strip()
                  for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))
