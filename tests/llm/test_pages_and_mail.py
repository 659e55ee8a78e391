"""Main text of pages, and conversations from quotes."""

from __future__ import annotations

import html
import re

import pytest

from goldweave.llm import html_blocks, quotes

PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div id="sidebar"><p>Links and the other
stuff that you would like to read about the site and so on and more</p></div><main><h1>Title &eacute;</h1><p>Short.
<p>This is the long paragraph with a lot of the words that you would find in it, and <a href="x>y">a link</a>.<br><br>After it.</p>
<div class="comments"><p>I think that this is the best of all the articles on the web, and I will read more</p></div>
<aside>the other</aside><ul><li>one<li>two</ul><table><tr><td>a<td>b</tr></table><pre> x
 y</pre><p hidden>unseen</p></main><form><p>sub</p></form><!-- <p>no</p> --><script>if(a<b){"</p>"}</script><footer>f</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html_blocks.main_text(PAGE).split("\n") == [
        "Title é", "Short.", "This is the long paragraph with a lot of the words that you would find in it, and a link.",
        "After it.", "one", "two", "a b", "x y"]


def test_density_rules_without_markup():
    body = "It was the best of times and it was the worst of times, and we had all of it before us as well as nothing. " * 3
    page = f"<div><a href=a>Home</a> <a href=b>About</a></div><div><p>{body}<p>Yes.<p>{body}</div><div><p>Buy now!!! $$$ 999 XXL TV</div><div><a href=x>More</a></div>"
    assert html_blocks.main_text(page) == "\n".join([body.strip(), "Yes.", body.strip(), "Buy now!!! $$$ 999 XXL TV"]) or \
        html_blocks.main_text(page) == "\n".join([body.strip(), "Yes.", body.strip()])


EN = ("It was the best of times and it was the worst of times, and we had all of it before us as well as nothing at all. "
      "They were there with us for most of the day, and what we had in our hands was not what they would have.")
EN2 = ("When the rain had gone we went down to the river, because it was the only way to the town that was still open to us. "
       "The bridge was not as it had been, so we took the boat of my brother and were on the other side by night.")
PL = ("Wczoraj wieczorem mieszkańcy miasta spotkali się przed ratuszem, żeby wspólnie obejrzeć pokaz światła przygotowany przez młodych "
      "artystów. Organizatorzy zapowiadają kolejne wydarzenia jeszcze przed końcem lata, jeśli tylko pogoda dopisze.")
ZH = "昨天晚上市民们聚集在市政厅前观看年轻艺术家准备的灯光表演主办方表示如果天气允许夏天结束前还会举办更多活动欢迎大家参加并带上家人和朋友一起度过愉快的夜晚。" * 2
TEASER = "This is what you would read if you had the time for it, and it is not of this page."


@pytest.mark.parametrize("page, text", {
    "teaser article in an aside": (f"<body><aside><article><p>{TEASER}</p></article></aside><div><h1>Head</h1><p>{EN}</p><p>{EN2}</p></div>", ["Head", EN, EN2]),
    "teaser articles in plain elements": (f"<body><div><h1>Head</h1><p>{EN}</p><p>{EN2}</p><p>{EN}</p></div><div><a href=x><article><h3>One</h3></article></a>"
                                          "<article><a href=y>Two of them all</a></article></div>", ["Head", EN, EN2, EN]),
    "wrapper that has a sidebar": (f"<body><div class='layout has-sidebar'><div><p>{EN}</p><p>{EN2}</p></div><div class=sidebar><p>{TEASER}</p></div></div>", [EN, EN2]),
    "page with comments": (f"<body><div id=page-with-comments><p>{EN}</p><p>{EN2}</p><div id=comments><p>{TEASER}</p></div></div>", [EN, EN2]),
    "post in a text widget": (f"<body><div class='post text-widget'><p>{EN}</p><p>{EN2}</p></div><div class='widget'><p>{TEASER}</p></div>", [EN, EN2]),
    "Polish body": (f"<body><div class=menu><a href=a>Start</a></div><div><p>{PL}</p><p>Tak.</p><p>{PL}</p></div><div class=footer>{TEASER}</div>", [PL, "Tak.", PL]),
    "Chinese body": (f"<body><ul><li><a href=a>首页</a></ul><div><p>{ZH}</p><p>{ZH}</p></div>", [ZH, ZH]),
    "comments as articles inside main": (f"<main><article><p>{EN}</p><section class=comments><article><p>{TEASER}</p></article></section></article></main>", [EN]),
    "comment named on the article": (f"<main><article><p>{EN}</p></article><article class='comment'><p>{TEASER}</p></article></main>", [EN]),
    "articles inside an article": (f"<article><p>{EN}</p><article><p>{TEASER}</p></article><article><p>{EN2}</p></article></article>", [EN]),
    "a feed of articles": (f"<article><article><p>{EN}</p></article><article><p>{EN2}</p></article></article>", [EN, EN2]),
    "more comments than article": (f"<body><div class=post><p>{EN}</p></div><div class=comment-list>" + f"<div id=comment-1><p>{EN2}</p></div>" * 9 + "</div>", [EN]),
    "page inside a form": (f"<body><form id=aspnet><div><p>{EN}</p><p>{EN2}</p><label>Name</label><button>Go</button></div></form>", [EN, EN2]),
    "small form": (f"<body><div><p>{EN}</p><form><p>{TEASER}</p></form><p>{EN2}</p></div>", [EN, EN2]),
    "name and copyright around": (f"<body><div>My site</div><div><h1>Head</h1><p>{EN}</p><p>The end.</p></div><div>(c) 2020 us</div>", ["Head", EN, "The end."]),
    "notice and advert": (f"<body><div class=cookie-notice><p>{TEASER}</p></div><article><p>{EN}</p><div class='ad ad-inline'>Buy</div><p>{EN2}</p></article>", [EN, EN2]),
    "notice outside the article": (f"<body><div><p>{TEASER}</p></div><article><h1>Head</h1><p>{EN}</p></article>", ["Head", EN]),
    "header of the post": (f"<body><header>{TEASER}</header><div class=post><header><h1>Head</h1></header><p>{EN}</p><p>{EN2}</p></div>", ["Head", EN, EN2]),
    "roles": (f"<body><div role=navigation>{TEASER}</div><div role=main><p>{EN}</p><p>Yes.</p></div><div role=contentinfo>{TEASER}</div>", [EN, "Yes."]),
    "everything is called an advert": (f"<body><div class=ad><p>{EN}</p><p>{EN2}</p>", [EN, EN2]),
    "list of links between": (f"<body><div><p>{EN}</p><ul><li><a href=a>{TEASER}</a></ul><p>{EN2}</p></div>", [EN, EN2]),
}.values())
def test_pages_of_other_builds(page, text):
    assert html_blocks.main_text(page).split("\n") == [" ".join(t.split()) for t in text]


def test_many_names_and_blocks_stay_fast():
    page = "<main>" + f"<p>{EN}</p>" * 3000 + "</main>" + "".join(f"<div id=comment-{i} class='reply-{i} widget-{i}'><p>{TEASER}</p></div>" for i in range(3000))
    assert html_blocks.main_text(page) == "\n".join([EN] * 3000)


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>&amp;&#x41;&bogus", "</p></div>", "<div class=\"ad\"><article><p>in", "<!-- open", "<a " * 2000,
                                  "<script>never closed", "<p>" * 5000 + "deep", "text only"])
def test_broken_pages(page):
    assert isinstance(html_blocks.main_text(page), str)


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_blocks.extract(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_pages_with_nulls(spark):
    df = spark.createDataFrame([(1, None, None, 5), (None, "u", "", 6), (2, "v", "<p>x", 7), (2, "v", "<p>x", 7)],
                               "page_id long, url string, html string, n_chars int")
    rows = html_blocks.extract(df).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert html_blocks.extract(df.limit(0)).count() == 0


MAIL = [(1, 1, "Hello there, how are you?\nI am fine."), (2, 2, "> Hello there, how are you?\n\nGood thanks!"),
        (3, 3, "On Mon, Bob wrote:\n>> Hello there,  how are you?\n> Good thanks!\nGreat to hear."), (4, 4, "unrelated"),
        (5, 5, "> Great to HEAR\nindeed"), (6, 6, None), (None, None, ""), (7, 7, "> nothing known\nx"), (4, 4, "unrelated")]


def test_threads_from_quotes(spark):
    df = spark.createDataFrame(MAIL, "msg_id long, sent long, text string").selectExpr("*", "1 AS node", "2 AS level")
    rows = {r.msg_id: r for r in quotes.link(df).collect()}
    assert len(rows) == 8
    assert {i: (r.thread_id, r.position, r.depth, r.parent_id) for i, r in rows.items() if i in (1, 2, 3, 5)} == {
        1: (1, 0, 0, None), 2: (1, 1, 1, 1), 3: (1, 2, 2, 2), 5: (1, 3, 3, 3)}
    assert [rows[i].text for i in (2, 3, 5, 7)] == ["Good thanks!", "Great to hear.", "indeed", "x"]
    assert (rows[3].n_quoted, rows[3].n_linked, rows[7].n_quoted, rows[7].n_linked, rows[7].thread_id) == (2, 2, 1, 0, 7)
    assert quotes.link(df.limit(0)).count() == 0


SAID = ("We looked at the plan for the new bridge. It is longer than the old one\nand it will cost more! Who is to pay for it?\n\n"
        "The town has no money left this year. Ask again in spring.")
WRAPPED = "\n".join("> " + " ".join(SAID.split()[i:i + 7]) for i in range(0, len(SAID.split()), 7))


@pytest.mark.parametrize("quote, linked, quoted", [
    (WRAPPED, 1, 1),  # wrapped elsewhere
    (WRAPPED.replace("> ", "> > "), 1, 1),  # a deeper level names no parent
    ("> It is longer than the old one", 1, 1),  # a line that ends inside a sentence
    ("> We looked at the plan for the new bridge.\nwe did\n> Ask again in spring.", 2, 2),  # answered in between
    ("> The town has no money left this year. Ask again in autumn, or in winter, or never.", 0, 1),  # mostly changed
    (">\n> \n>", 0, 0),  # nothing quoted
    (f"Am Montag, dem ersten {'x' * 400} schrieb:\n{WRAPPED}", 1, 1),  # a long announcing line
])
def test_quoted_passages(spark, quote, linked, quoted):
    rows = [(1, 1, SAID), (2, 2, "Something else altogether. Nothing to see here."), (3, 3, f"{quote}\n\nmine"), (4, 4, None), (5, 5, "")]
    got = {r.msg_id: r for r in quotes.link(spark.createDataFrame(rows, "msg_id long, sent long, text string")).collect()}
    assert (got[3].n_linked, got[3].n_quoted) == (linked, quoted)
    assert got[3].parent_id == (1 if linked and not quote.startswith("> >") else None)
    assert got[3].text in ("mine", "we did\n\nmine") and got[1].text == SAID


def test_a_very_long_quote(spark):
    said = "\n".join(f"line {i} of it. And {i} more" for i in range(20000))
    rows = [(1, 1, said), (2, 2, "".join(f"> {line}\n" for line in said.replace(" And", "\nAnd").split("\n")) + "so")]
    got = {r.msg_id: r for r in quotes.link(spark.createDataFrame(rows, "msg_id long, sent long, text string")).collect()}
    assert (got[2].parent_id, got[2].n_linked, got[2].text) == (1, 1, "so")


def test_a_passage_everyone_quotes(spark):
    """A line that all messages hold: every quote goes to the latest earlier message, without pairs."""
    rows = [(i, i, "> same words here\nsame words here") for i in range(1, 400)]
    rows[0] = (1, 1, "same words here")
    got = {r.msg_id: (r.parent_id, r.depth) for r in quotes.link(spark.createDataFrame(rows, "msg_id long, sent long, text string")).collect()}
    assert got == {i: (i - 1 if i > 1 else None, i - 1) for i in range(1, 400)}


def test_long_threads_keep_their_order(spark):
    rows = [(1, 10, "start of it")] + [(i, 10 * i, f"> {'start of it' if i == 2 else f'reply {i - 1}'}\nreply {i}") for i in range(2, 60)]
    got = quotes.link(spark.createDataFrame(rows, "msg_id long, sent long, text string")).collect()
    assert {(r.thread_id, r.position, r.depth) for r in got} == {(1, i, i) for i in range(59)}
