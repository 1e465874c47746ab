"""What may and what may not take a page's article away."""

from __future__ import annotations

import time
import tracemalloc

import pytest
from hypothesis import given
from hypothesis import strategies as st

from touchline.llm import pages

TEXT = "First paragraph with quite a few words of the text"


def found(page):
    return pages.extract(pages.parse(page), {})


@pytest.mark.parametrize(
    "begin",
    [
        '<div style="overflow:hidden">',
        '<div aria-hidden="false">',
        "<div data-x=hidden title='hidden id=footer'>",
        '<body class="has-sidebar">',
        '<body class="sidebar">',
        '<html class="no-banner"><body>',
        '<div class="layout no-banner">',
        '<section id="social-policy">',
        '<div class="sidebar"><article>',
        '<form id="page"><main>',
        '<div class="widget"><div role="main">',
    ],
)
def test_wrappers_keep_the_text(begin):
    assert TEXT in found(f"{begin}<p>{TEXT}</p>")


def test_headings_and_links_stay():
    page = f'<h2 id="related">Related work</h2><p>{TEXT} <a class="share" href="/hidden-costs?id=footer">costs</a></p>'
    assert found(page) == f"Related work\n\n{TEXT} costs"


@pytest.mark.parametrize("begin", ['<div class="x sidebar">', "<div id=footer>", "<p hidden>", "<nav>", '<div ROLE="Banner">', "<form>"])
def test_furniture_goes(begin):
    assert found(f"<article><p>{TEXT}</p></article>{begin}Something else of no use") == TEXT


def test_teasers_stay_furniture():
    page = f'<main><p>{TEXT}</p></main><div class="related"><article>One teaser</article><article>Another</article></div>'
    assert found(page) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        f'<form id="aspnetForm"><div><p>{TEXT}</p></div></form>',
        f'<div class="notice"><p>{TEXT}</p></div><p>Imprint</p>',
        f'<div class="elementor widget"><p>{TEXT}</p></div>',
        f'<section class="post social"><p>{TEXT}</p></section>',
        f"<form><article><p>{TEXT}</p></article><article><p>Second</p></article></form>",
        f'<div class="widget"><div class="widget"><p>{TEXT}</p></div><div class="ad">Buy this now</div></div>',
    ],
)
@pytest.mark.parametrize("learned", [{}, {("word", "form p"): -3.0, ("word", "div.notice p"): -3.0}], ids=["no weights", "weights"])
def test_names_give_way_to_what_they_hold(page, learned):
    text = pages.extract(pages.parse(page), learned)
    assert TEXT in text
    assert "Buy" not in text


@pytest.mark.parametrize("name", ["ad-slot", "ad-slot-1", "top-banner", "sidebar-left", "comments-area", "site_footer", "x related-posts"])
@pytest.mark.parametrize("body", ["<article><p>{0}</p></article>", "<div><p>{0}</p></div>"])
def test_compound_names(name, body):
    assert found(body.format(TEXT) + f'<div class="{name}"><p>Something else of no use</p></div>') == TEXT


def test_adverts_and_comments_are_no_content_however_long():
    long = "<p>Many words that readers wrote below the text</p>" * 5
    assert found(f'<div><p>{TEXT}</p></div><div class="comments">{long}</div>') == TEXT
    assert found(f'<article><p>{TEXT}</p></article><article class="comment">{long}</article>') == TEXT
    assert found(f'<div class="comments">{long}<div class="widget">{long}</div></div>') == ""


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 20_000 + "</span>" * 20_000,
        '<div class="ad">' * 20_000 + "x" + "</div>" * 20_000,
        '<div class="widget">' * 20_000 + "x y" + "</div>" * 20_000,
        "<b>" * 20_000 + "<hr>" * 20_000,
        "<b>" * 20_000 + "<td/>" * 20_000,
        "<" + "a" * 200_000,
        "<p>" * 20_000 + "</p>" * 20_000,
        "< " * 100_000,
    ],
    ids=["stray ends", "adverts", "wrappers", "rules", "cells", "name", "paragraphs", "signs"],
)
def test_time_and_memory_are_linear(page):
    tracemalloc.start()
    begin = time.process_time()
    found(page)
    assert time.process_time() - begin < 5
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


@given(st.lists(st.integers(-9, 9).map(lambda x: x / 4), max_size=30))
def test_the_best_region_of_all(scores):
    low, high = pages.best_region(scores)
    sums = {(a, b): sum(scores[a:b]) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1)}
    assert sum(scores[low:high]) == max(sums.values())
