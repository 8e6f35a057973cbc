"""Extraction from pages written by hand, in layouts that the training generator doesn't copy."""

import pytest

from procura.llm import html_extract

P1 = "The council met on Tuesday to discuss the new bridge across the river, which has been planned for more than ten years and is now expected to open in spring."
P2 = "Residents of the old town had asked for a quieter surface and for more trees along the northern bank, and both wishes were written into the final plan."
P3 = "Work begins in March. The contractor will close one lane at a time, so that buses can pass, and expects to finish before the first frost."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/about">About us</a></li></ul>'
FOOT = "<p>&copy; 2024 Example Media. All rights reserved.</p>"
BODY = f"<h1>New bridge to open in spring</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
WANT = f"New bridge to open in spring {P1} {P2} {P3}"
SECTIONS = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(60))
PAGES = {
    'div main after menu': f'<html><body><div class="menu">{MENU}</div><div class="main">{BODY}</div><div class="footer">{FOOT}</div></body></html>',
    'role main after menu': f'<html><body><div class="menu">{MENU}</div><div role="main">{BODY}</div><div class="footer">{FOOT}</div></body></html>',
    'role main after nav': f'<html><body><nav>{MENU}</nav><div role="main">{BODY}</div><footer>{FOOT}</footer></body></html>',
    'div main after nav': f'<html><body><nav>{MENU}</nav><div class="main">{BODY}</div><footer>{FOOT}</footer></body></html>',
    'id main': f'<html><body><div id="header"><div id="nav">{MENU}</div></div><div id="main">{BODY}</div><div id="footer">{FOOT}</div></body></html>',
    'neutral': f'<html><body><div class="css-1ab2c3">{MENU}</div><div class="css-9zz8yy">{BODY}</div><div class="css-aaa111"><footer>{FOOT}</footer></div></body></html>',
    'plain article': f'<html><body><header><a href="/">Example</a><nav>{MENU}</nav></header><article>{BODY}</article><aside><h3>Related</h3>{MENU}</aside><footer>{FOOT}</footer></body></html>',
    'table': f'<html><body><table width="100%"><tr><td width="150">{MENU}</td><td>{BODY}</td></tr></table><div class="footer">{FOOT}</div></body></html>',
    'table nav cell': f'<html><body><table><tr><td class="nav"><a href="/">Home</a><br><a href="/a">News</a><br><a href="/b">Sport</a></td><td class="body">{BODY}</td></tr></table></body></html>',
    'comments': f'<html><body><main><article>{BODY}</article><section id="comments"><h2>2 comments</h2><div class="comment"><p>I cross the river every day and can hardly wait.</p></div><div class="comment"><p>Too expensive if you ask me.</p></div></section></main></body></html>',
    'cookie and newsletter': f'<html><body><div id="cookie-banner"><p>We use cookies to improve your experience.</p><button>Accept</button></div><div class="container"><div class="row"><div class="col-8">{BODY}<div class="newsletter"><form><label>Sign up for our newsletter</label><input><button>Subscribe</button></form></div></div><div class="col-4 sidebar"><h3>Most read</h3>{MENU}</div></div></div><footer>{FOOT}</footer></body></html>',
    'bare body': f'<html><body>{BODY}</body></html>',
    'bare with nav, foot': f'<html><body><nav>{MENU}</nav>{BODY}<footer>{FOOT}</footer></body></html>',
    'blog': f'<html><body class="home"><div id="wrapper"><div id="header"><h2><a href="/">My blog</a></h2></div><div id="content"><div class="post"><h1>New bridge to open in spring</h1><div class="entry"><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></div></div><div id="sidebar"><h4>Archive</h4>{MENU}</div><div id="footer"><p>Powered by nothing</p></div></div></body></html>',
    'breadcrumb byline share': f'<html><body><nav class="breadcrumb"><a href="/">Home</a> &gt; <a href="/n">News</a></nav><article><h1>New bridge to open in spring</h1><div class="byline">By Ann Example, 3 May</div><p>{P1}</p><div class="ad">Buy two, get one free at the garden centre.</div><p>{P2}</p><p>{P3}</p><div class="share">Share this story</div></article><footer>{FOOT}</footer></body></html>',
    'div paragraphs': f'<html><body><div class="nav">{MENU}</div><div class="content"><h1>New bridge to open in spring</h1><div>{P1}</div><div>{P2}</div><div>{P3}</div></div><div class="copyright">{FOOT}</div></body></html>',
    'br paragraphs': f'<html><body><div id="menu">{MENU}</div><div id="text"><h1>New bridge to open in spring</h1>{P1}<br><br>{P2}<br><br>{P3}</div></body></html>',
    'upper case table': f'<HTML><BODY><TABLE><TR><TD WIDTH=120><A HREF="/">Home</A><BR><A HREF="/a">News</A></TD><TD><H1>New bridge to open in spring</H1><P>{P1}<P>{P2}<P>{P3}</TD></TR></TABLE></BODY></HTML>',
    'related inside main': f'<html><body><header>{MENU}</header><main>{BODY}<section class="related"><h3>Related stories</h3>{MENU}</section></main><footer>{FOOT}</footer></body></html>',
    'long nav': f'<html><body><nav><ul>{SECTIONS}</ul></nav><article>{BODY}</article><footer>{FOOT}</footer></body></html>',
    'aside in article': f'<html><body><article><h1>New bridge to open in spring</h1><p>{P1}</p><aside><p>Subscribe for more.</p></aside><p>{P2}</p><p>{P3}</p></article></body></html>',
}
LISTED = f'<html><body><nav>{MENU}</nav><div role="main"><h1>New bridge to open in spring</h1><p>{P1}<p>{P2}<ul><li>One lane stays open<li>Buses can pass<li>Trees along the bank</ul><p>{P3}</div><footer>{FOOT}</footer></body></html>'


@pytest.mark.parametrize("name", PAGES)
def test_the_article_and_nothing_else(name):
    assert html_extract.extract([PAGES[name]], html_extract.trained_labeller(), {}, {}) == [WANT]


def test_unclosed_paragraphs_and_a_list():
    want = f"New bridge to open in spring {P1} {P2} One lane stays open Buses can pass Trees along the bank {P3}"
    assert html_extract.extract([LISTED], html_extract.trained_labeller(), {}, {}) == [want]


SITE = f'<div class="sc-abc"><header class="sc-1"><a href="/">Home</a><a href="/n">News</a></header><div class="sc-2">{BODY}</div><footer class="sc-3">{FOOT}</footer></div>'
MORE = {
    "made-up classes": (SITE, WANT),
    "an app's root": (f'<div id="app"><nav><a href="/">Home</a> <a href="/n">News</a></nav><div class="view">{BODY}</div></div>', WANT),
    "header of text": (f'<header>My site</header><div class="abcd">{BODY}</div><div id="comments"><h3>2 comments</h3><div class="comment"><p>{P2}</p></div></div>', WANT),
    "recipe": (
        '<header><a href="/">Home</a></header><article><h1>Soup for four</h1><p>Take this from the cellar:</p><ul><li>two onions</li><li>one carrot</li><li>salt</li></ul><p>Serve hot.</p></article><footer>© 2024</footer>',
        "Soup for four Take this from the cellar: two onions one carrot salt Serve hot.",
    ),
    "verse": (
        '<nav><a href="/">Home</a><a href="/p">Poems</a></nav><main><h1>Rain</h1><p>The rain came down<br>upon the town<br>and no one heard<br>a single bird<br></p><p>until the sun<br>said it was done</p></main><footer>Imprint</footer>',
        "Rain The rain came down upon the town and no one heard a single bird until the sun said it was done",
    ),
    "opening hours": (
        '<div class="wrap"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/x">Shop</a></li></ul><div class="content"><h2>Opening hours</h2><p>Monday to Friday: 9 to 5</p><p>Saturday: closed</p><p>Ring twice.</p></div><div class="footer">Contact us</div></div>',
        "Opening hours Monday to Friday: 9 to 5 Saturday: closed Ring twice.",
    ),
}


@pytest.mark.parametrize("name", MORE)
def test_short_articles_verse_and_names_that_say_nothing(name):
    page, want = MORE[name]
    assert html_extract.extract([f"<html><body>{page}</body></html>"], html_extract.trained_labeller(), {}, {}) == [want]


def test_long_pages_in_stretches():
    """The states go on from stretch to stretch, so the cut makes no difference."""
    net = html_extract.trained_labeller()
    long = f"<html><body><nav>{MENU}</nav><article>" + BODY * 40 + f"</article><aside>{MENU * 5}</aside><footer>{FOOT}</footer></body></html>"
    pages = [None, PAGES["blog"], long, "", PAGES["comments"], long, LISTED]
    whole = html_extract.extract(pages, net, {}, {})
    assert whole[2].count(P1) == 40 and whole[0] == ""
    for stretch in (1, 7, 64):
        assert html_extract.extract(pages, net, {}, {}, stretch) == whole
        assert html_extract.extract([], net, {}, {}, stretch) == []


def test_vectors_of_a_long_page_are_bounded():
    import tracemalloc

    net = html_extract.BlockLabeller()  # weights don't matter here
    page = "<html><body>" + "".join(f"<p>word {i}" for i in range(20_000))
    found = html_extract.blocks(page)
    tracemalloc.start()
    net.label_long(found, {}, {}, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 20_000 and peak < 12_000_000  # all vectors together would be 15 MB, with gates and states 29 MB
