import html as entities
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from syncplan.llm.html_text import extract, main_text, op5_html_text

LONG = "A long paragraph of the article, with many words, so that its block stands out from all menus around it."


def test_marked_article():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><header>Site</header>"
        "<nav><ul><li><a href=/a>A</a><li>B</ul></nav><div class='cookie-notice'>We use cookies</div><article class='post'>"
        "<h1>Head &amp; line</h1><p><b>Bold<br><p>One\n  two&nbsp;&eacute;</p><div class='ad'>Buy</div><ul><li>x<li>y</ul>"
        "<form><label>Mail</label><input></form><section id='comments'><p>Reader says</p></section><p>.</p></article>"
        "<aside>Side</aside><footer>&copy; foot</footer>"
    )
    assert main_text(page) == "Head & line\n\nBold\n\nOne two é\n\nx\n\ny\n\n."


def test_without_marks():
    menu = "".join(f"<div><a href=/{i}>Menu entry number {i}</a></div>" for i in range(20))
    page = f"<body>{menu}<div>{LONG}</div><div>Short.</div><div>{LONG}</div>{menu}<div id=footer>{LONG}</div></body>"
    assert main_text(page) == f"{LONG}\n\nShort.\n\n{LONG}"


def test_interrupted_text_stays_whole():
    links = "".join(f"<p><a href=/{i}>Related entry number {i}</a></p>" for i in range(5))
    apart = "<form><p>One</p><p>Two</p><p>Three</p><p>Four</p></form>"
    for between in (links, apart, links + apart):
        assert main_text(f"<body><p>{LONG}</p><p>{LONG} Two.</p>{between}<p>{LONG} Three.</p>") == f"{LONG}\n\n{LONG} Two.\n\n{LONG} Three."
    # after a form, a short last line belongs to what stands before it
    assert main_text(f"<body><p>{LONG}</p>{apart}<p>The end.</p>{links}") == f"{LONG}\n\nThe end."


def test_short_lines_only():
    assert main_text("<body><nav><p>Menu</p></nav><p><a href=/>Home</a></p><p>Roses are red,</p><p>violets blue.</p>") == "Roses are red,\n\nviolets blue."


def test_all_sibling_articles():
    page = "<body><p>Outside.</p><article><p>First part.</p></article><article hidden><p>Buy</p></article><main><p>Second</p><article>part, longer.</article></main><article><p><a href=/>Third</a></p></article>"
    assert main_text(page) == "First part.\n\nSecond\n\npart, longer.\n\nThird"


def test_link_lists_within_articles():
    links = "".join(f"<li><a href=/{i}>Related entry number {i}</a></li>" for i in range(30))
    page = f"<article><h1><a href=/>Head</a></h1><h2><a href=/>Deck</a></h2><p>{LONG}</p><ul>{links}</ul><p>Two.</p><p><a href=/>One link</a></p><p>End.</p></article>"
    assert main_text(page) == f"Head\n\nDeck\n\n{LONG}\n\nTwo.\n\nOne link\n\nEnd."


def test_names_that_contain_a_listed_word():
    for name in ("related-story", "notice-of-appeal", "menuPlanning", "header-hero-story"):
        assert main_text(f"<body><div class='{name}'><p>{LONG}</p></div>") == LONG
    for name in ("site-footer", "adSlot2", "post comments-area", "cookie-notice", "sidebar right"):
        assert main_text(f"<body><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div>") == LONG


BODY = "".join(f"<p>{LONG} Paragraph {i}.</p>" for i in range(6))
TEXT = "\n\n".join(f"{LONG} Paragraph {i}." for i in range(6))
JUNK = "share-buttons related-posts newsletter-signup disqus_thread sidebar-first footer-widgets google-ads post-footer cookie-law-info-bar article-comments user-comments".split()
LINKS = "".join(f"<li><a href=/{i}>Another story of this site, number {i}</a></li>" for i in range(40))
SOURCES = "".join(f"<li><a href=/{i}>Source {i}, a book</a></li>" for i in range(3))
LISTED = "\n\n".join(f"Source {i}, a book" for i in range(3))

#: Pages made by hand, and the text that a reader would call the article's.
PAGES = {
    **{f"junk {name}": (f"<article>{BODY}<div class='{name}'><p>Junk that a reader would skip.</p><ul>{LINKS[:200]}</ul></div></article>", TEXT) for name in JUNK},
    **{f"unmarked {name}": (f"<body><div>{BODY}</div><section id='{name}'><p>{LONG}</p><p>{LONG}</p></section></body>", TEXT) for name in JUNK},
    "advert as paragraph": (f"<article>{BODY}<p class='advert'>Buy</p><p>End.</p></article>", f"{TEXT}\n\nEnd."),
    "advert as list item": (f"<article>{BODY}<ul><li class='ad'>Buy<li>Kept one<li>Kept two</ul></article>", f"{TEXT}\n\nKept one\n\nKept two"),
    "advert item with blocks": (f"<article>{BODY}<ul><li class='ad'><p>Buy</p><div>Now</div></li><li>Kept</li></ul></article>", f"{TEXT}\n\nKept"),
    "advert in a line": (f"<article><p>One <span class='advert'>Buy <b>now</b></span>two <a class='ad' href=/>here</a>three.</p>{BODY}</article>", f"One two three.\n\n{TEXT}"),
    "advert that isn't closed": (f"<article><p>One <span class='advert'>Buy<p>Two.</p>{BODY}</article>", f"One\n\nTwo.\n\n{TEXT}"),
    "comment article": (f"<body><article><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article>", LONG),
    "hidden": (f"<article>{BODY}<div style='color:red; display : none'><p>No</p></div><p style='visibility:hidden'>No</p><p hidden>No</p><div aria-hidden=true>No</div></article>", TEXT),
    "labels of main": (f"<main><div>Sign in</div><h1>Head</h1>{BODY}<p>Most read stories of today</p><ul>{LINKS}</ul><span>Load more</span></main>", f"Head\n\n{TEXT}"),
    "references": (f"<article>{BODY}<h2>Sources</h2><ul>{SOURCES}</ul><p>Thanks.</p></article>", f"{TEXT}\n\nSources\n\n{LISTED}\n\nThanks."),
    "link list with its title": (f"<article>{BODY}<h2>More</h2><ul>{LINKS}</ul><p>The end.</p></article>", f"{TEXT}\n\nThe end."),
    "sentence after links": (f"<body><div>{BODY}<p><a href=/1>Some story</a></p><p><a href=/2>Some other</a></p><p><a href=/3>And a third</a></p><p>So it ends.</p></div><p>Log in</p>", f"{TEXT}\n\nSo it ends."),
    "related story": (f"<body><div class='related-story'>{BODY}</div><div class='menu'>{LONG}</div>", TEXT),
    "appeal": (f"<article><div class='notice-of-appeal'>{BODY}</div><p>{LONG}</p></article>", f"{TEXT}\n\n{LONG}"),
    "names of the body": (f"<body class='has-sidebar cookie-consent'><main id='main-sidebar'>{BODY}</main></body>", TEXT),
    "cells": (f"<article>{BODY}<table><tr><td>a<td class='ad'>Buy<td>b<tr><td>c</table></article>", f"{TEXT}\n\na\n\nb\n\nc"),
    "terms": (f"<article>{BODY}<dl><dt>a<dd class='ad'>Buy<dt>b<dd>c</dl></article>", f"{TEXT}\n\na\n\nb\n\nc"),
    "stray ends": (f"<article></li></span></p>{BODY}</div></section><p>End.</p></article>", f"{TEXT}\n\nEnd."),
    "nothing but junk": ("<body><nav><p>Menu</p></nav><div class='comments'><p>First!</p></div></body>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_made_by_hand(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def _windows(lengths, window, surge):
    """Kept lines of a page without marks, straight from the definition of surge and dive."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    kept, inside = [], False
    for i, n in enumerate(lengths):
        if not inside and sums[i] >= surge and n:
            inside = True
        if inside and not sums[i]:
            inside = False
        kept.append(inside)
    for i in range(len(lengths) - 1, -1, -1):  # what has no text before a dive isn't part of it
        if kept[i] and not lengths[i] and (i + 1 == len(lengths) or not kept[i + 1]):
            kept[i] = False
    return kept


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 120)), max_size=40))
def test_windows_against_brute_force(blocks):
    texts = [f"{i:03d}" + "x" * (n + 2) for i, (_, n) in enumerate(blocks)]
    page = "".join(f"<p><a href=/>{t}</a></p>" if link else f"<p>{t}</p>" for (link, _), t in zip(blocks, texts, strict=True))
    lengths = [0 if link else len(t) for (link, _), t in zip(blocks, texts, strict=True)]
    kept = _windows(lengths, 3, 80)
    if not any(kept):
        kept = _windows(lengths, 3, 1)
    assert main_text(f"<body>{page}") == "\n\n".join(t for t, k in zip(texts, kept, strict=True) if k)


def test_odd_pages(spark):
    pages = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "<article>cut off &am"), (None, "u", f"<p>{LONG}"), (4, "u", "<article>cut off &am"),
             (5, "u", "<article>" + "<p>w</p>" * 30000), (6, "u", "<script>never closed <p>text"), (7, "u", "</div></article>< p>" + LONG)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in extract(df).collect()}
    assert extract(df).count() == len(pages) and extract(df.limit(0)).count() == 0
    assert [rows[i]["text"] for i in (1, 2, 3, 4, 6)] == ["", "", "", "cut off &am", ""]
    assert rows[None]["text"] == LONG and rows[5]["n_chars"] == 30000 * 3 - 2


def test_whole_table_against_the_template(spark, sf_dir):
    """The tables' pages hold their article in one element: its blocks, by patterns."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op5_html_text(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1|h2|ul|li|div)>", inner)]
        assert r["text"] == "\n\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])
