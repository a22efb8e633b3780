"""Pages of many shapes with the text that a reader would call the article."""

import html
import re

import pytest

from lodeseek.llm import htmltext
from lodeseek.llm.queries import op11_main_text

LONG = "The river had risen over night, and nobody in the village had slept; they carried sacks to the bridge, one after the other, until dawn."
MORE = "By noon the water stood still. The miller counted his losses, shook his head, and began to write down what he would need for the winter."
SHORT = "Nobody spoke."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li><li><a href="/c">Contact</a></li></ul>'
BODY = f"<p>{LONG}</p><p>{SHORT}</p><p>{MORE}</p>"
TEXT = f"{LONG} {SHORT} {MORE}"

PAGES = {
    "article": (f"<html><body><nav>{MENU}</nav><article><h1>Flood</h1>{BODY}</article><footer>All rights reserved.</footer></body></html>", f"Flood {TEXT}"),
    "divs alone": (f"<body><div id='a'>{MENU}</div><div id='b'><h1>Flood</h1>{BODY}</div><div id='c'>(c) 2020 Mill Press</div></body>", f"Flood {TEXT}"),
    "flat body": (f"<body><h1>Flood</h1>{BODY}<div>(c) 2020</div></body>", f"Flood {TEXT}"),
    "reader comments": (f"<article>{BODY}<section class='comments'><p>{LONG} I was there, too!</p></section></article>", TEXT),
    "comments as articles": (f"<main>{BODY}</main><div id='comments'><article><p>{MORE} So sad, really, so very sad.</p></article></div>", TEXT),
    "sidebar and notice": (f"<div class='cookie-notice'><p>{MORE}</p></div><div class='main-col'>{BODY}</div><div class='sidebar'><p>{LONG}</p></div>", TEXT),
    "aside, form, header": (f"<header><h1>The Mill Press</h1>{MENU}</header><article><header><h1>Flood</h1></header><p>{LONG}</p><aside>{MORE}</aside><form><p>{MORE}</p><input></form><p>{MORE}</p></article>", f"Flood {LONG} {MORE}"),
    "advert within": (f"<article><p>{LONG}</p><div class='ad'>{MORE}</div><p>{MORE}</p></article>", f"{LONG} {MORE}"),
    "class of the whole page": (f"<body class='has-sidebar no-ads'><article class='post'>{BODY}</article></body>", TEXT),
    "list and table": (f"<article><p>{LONG}</p><ul><li>flour<li>salt</ul><table><tr><td>one<td>two<tr><td>three</table><p>{MORE}</p></article>", f"{LONG} flour salt one two three {MORE}"),
    "unclosed, upper case": (f"<ARTICLE><P>{LONG}<P><B>{SHORT}<BR><P>{MORE}</ARTICLE><FOOTER>{LONG}", TEXT),
    "references": (f"<article><p>{LONG}</p><p>caf&eacute; &amp;amp; &#8364;5 &lt;b&gt; &nosuch; a&nbsp;b &#x41;.</p></article>", f"{LONG} café &amp; €5 <b> &nosuch; a b A."),
    "scripts and comments": (f"<article><script>var t='</p><p>no';</script><!-- <p>no</p> --><style>p{{}}</style><p>{LONG}</p><noscript><p>no</p></noscript></article>", LONG),
    "inline and white space": (f"<article><p>{LONG}</p><p> a\n <b>b</b>c <i>d\t</i><a href=x>e</a><br>f </p></article>", f"{LONG} a bc d e f"),
    "quoted mark": (f"<article><p title='a > b' data-x=\"<p>\">{LONG}</p></article>", LONG),
    "less than": (f"<article><p>{LONG} 1 < 2 and 3 <4.</p></article>", f"{LONG} 1 < 2 and 3 <4."),
    "hidden": (f"<article><p>{LONG}</p><p hidden>no</p><div style='display: none'>no</div></article>", LONG),
    "no article": (f"<nav>{MENU}</nav><footer>(c) 2020</footer>", ""),
    "menu alone": (f"<div>{MENU}</div>", ""),
    "plain text": ("just words", "just words"),
    "open comment": (f"<article><p>{LONG}</p><!-- <p>{MORE}</p>", LONG),
    "open script": (f"<article><p>{LONG}</p><script>x()<p>{MORE}</p>", LONG),
    "cut tag": (f"<article><p>{LONG}</p><p class='x", LONG),
    "menu in article": (f"<article>{MENU}<p>{LONG}</p><p>See <a href='/x'>the map</a>.</p></article>", f"{LONG} See the map."),
    "deep": ("<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000, LONG),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert htmltext.main_text(page) == text


def test_paths_share_their_figures():
    """A short paragraph counts as the long ones of its path, a line of like length elsewhere doesn't."""
    page = htmltext.Page(f"<div>{BODY}</div><div><span>Nobody asked.</span></div>")
    score, content = htmltext.path_scores(page)
    assert [t for _, t, _ in page.blocks] == [LONG, SHORT, MORE, "Nobody asked."]
    assert content.tolist() == [True, True, True, False]
    assert score[0] == score[1] == score[2]


def test_long_page_in_time():
    import time

    begin = time.time()
    text = htmltext.main_text(f"<article>{BODY * 8000}<p>{'word ' * 400_000}</article>" + "<a \"<b" * 20_000)
    assert text.count(LONG) == 8000 and text.count("word") == 400_000
    assert time.time() - begin < 60


def test_extract_keeps_columns(spark):
    rows = [(1, "u", PAGES["article"][0], "old", 7), (1, "u", PAGES["article"][0], "old", 7), (None, None, None, None, None)]
    found = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    want = PAGES["article"][1]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "u", want, len(want))] * 2 + [(None, None, "", 0)], key=str)
    assert htmltext.extract(spark.createDataFrame([], "html string")).collect() == []


def test_query_against_the_article_element(spark):
    """The tables' pages have one article element each."""
    sf = "/root/testdata/sf0.001"
    found = {r.page_id: r for r in op11_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = " ".join(filter(None, blocks))
        row = found[page.page_id]
        assert (row.url, row.text, row.n_chars) == (page.url, want, len(want))
