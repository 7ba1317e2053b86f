"""Main texts of pages whose markup misleads."""

import math

import pytest

from inquest.llm import style_tree
from inquest.llm.style_tree import main_text

STORY = "<h1>Title</h1><p>" + "The story goes on and on. " * 20 + "</p>"
TEXT = "Title\n" + ("The story goes on and on. " * 20).strip()


def _page(body):
    return f"<html><body><nav>Menu</nav>{body}<footer>end</footer></body></html>"


def test_a_name_in_the_markup_does_not_drop_the_story():
    aside = '<div class="sidebar"><p>Buy this</p></div>'
    for body in (
        f'<div class="content has-sidebar"><article>{STORY}</article>{aside}</div>', f'<div id="social-history">{STORY}{aside}</div>',
        f'<article class="discussion">{STORY}{aside}</article>', f'<main><div class="content has-sidebar">{STORY}</div>{aside}</main>',
    ):
        assert main_text(_page(body), set(), False) == TEXT, body


def test_the_root_has_most_of_the_text():
    card = "<article><p>Teaser</p></article>"
    assert main_text(_page(f"<main>{STORY}{card}</main>"), set(), False) == TEXT + "\nTeaser"
    assert TEXT in main_text(_page(f"<div>{STORY}</div>{card}"), set(), False)
    body = STORY.replace("<h1>Title</h1>", "")
    assert main_text(_page(f"<main><h1>Title</h1><article>{body}</article><h2>More</h2></main>"), set(), False) == TEXT


def test_comments_and_adverts_go():
    for side in ('<div id="comments"><p>me too</p><article><p>and me</p></article></div>', '<div class="ad"><p>Buy</p></div>', '<div class="promo"><div class="x">Buy</div></div>'):
        assert main_text(_page(f"<article>{STORY}{side}</article>"), set(), False) == TEXT
        assert main_text(_page(f"<article>{STORY}</article>{side}"), set(), False) == TEXT


def _host_pages(spark):
    """Six pages of a host: an article each, and a block of links without any name that all pages share, with a rare text in it."""
    rows = []
    for i in range(6):
        links = "<p>One link</p><p>Two links</p><p>Three links</p>" + ("<p class='rare'>Seen once</p>" if i == 3 else "")
        rows.append((i, f"http://h.org/{i}", f"<html><body><div class='x'>{links}</div><div class='y'><p>Text {i} of this page, a long one</p><p>More of text {i}</p></div></body></html>"))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_branches_of_low_importance_go_with_rare_texts_in_them(spark):
    made = {r.page_id: r.text for r in style_tree.main_texts(_host_pages(spark)).collect()}
    assert made == {i: f"Text {i} of this page, a long one\nMore of text {i}" for i in range(6)}


def test_importances_by_hand(spark):
    pages = _host_pages(spark).selectExpr("'h' AS host", "html")
    nodes, branches = style_tree.style_nodes(pages)
    by_path = {b.text: b.path for b in style_tree.blocks(pages.first().html)}
    links, story = by_path["One link"], by_path["More of text 0"]
    of_node = {r.node: r.importance for r in nodes.collect()}
    assert of_node[links[-1]] == pytest.approx(0) and of_node[story[-1]] == pytest.approx(1)
    of_branch = {r.branch: r.importance for r in branches.collect()}
    # Contents below: 18 on all pages and one unique. Presentations: five pages with three paragraphs, one with four.
    look = 1 - (5 * math.log(5)) / 6 / math.log(6)
    assert of_branch[links[-2]] == pytest.approx(0.1 * look + 0.9 * 1 / 19)
    assert of_branch[story[-2]] == pytest.approx(0.1 * 0 + 0.9 * 1)


def test_odd_pages(spark):
    empty = _host_pages(spark).where("false")
    assert style_tree.main_texts(empty).collect() == []
    rows = [(1, None, None), (2, "no url", ""), (2, "no url", ""), (3, "http://h.org", "<p>" + "word " * 300_000)]
    odd = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "page_id long, url string, html string, text string, _host string, _cut string")
    made = style_tree.extract(odd)
    assert made.columns == ["page_id", "url", "html", "text"]
    assert sorted((r.page_id, len(r.text)) for r in made.collect()) == [(1, 0), (2, 0), (2, 0), (3, 1_499_999)]
