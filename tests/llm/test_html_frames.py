"""Page frames whose classes tell of sidebars, and a plain line-block program beside ``main_text``."""

import re
from html import unescape
from html.parser import HTMLParser

import duckdb
import pytest

from geostrata.llm import html_extract as H

PAGES = "/root/testdata/sf0.01/pages.parquet"
CLASSES = ["has-sidebar", "layout-with-sidebar", "page-header-fixed", "site has-menu", "no-ads", "search-results", "notice-board", "social-science"]


@pytest.fixture(scope="module")
def pages():
    return [r[0] for r in duckdb.sql(f"SELECT html FROM read_parquet('{PAGES}')").fetchall()]


def renamed(page):
    return page.replace("<article>", "<div>").replace("</article>", "</div>")


@pytest.mark.parametrize("wrapper", [*[f'<div class="{c}">' for c in CLASSES], '<form action="/x">'])
def test_a_frame_takes_no_text(pages, wrapper):
    end = "</form>" if "form" in wrapper else "</div>"
    for page in pages[::5]:
        text = H.main_text(page)
        for form in (page, renamed(page)):
            assert H.main_text(form.replace("<body>", f"<body>{wrapper}").replace("</body>", f"{end}</body>")) == text


def test_comments_and_teasers_that_are_articles_stay_away():
    body = "".join(f"<p>{'word ' * 30}{i}.</p>" for i in range(6))
    want = "\n".join(f"{'word ' * 30}{i}." for i in range(6))
    comments = "<div id='comments'>" + f"<article class='comment'><p>{'reply ' * 200}</p></article>" * 9 + "</div>"
    teaser = "<aside><article><p>Read this too, it is short.</p></article></aside>"
    assert H.main_text(f"<div class='has-sidebar'>{teaser}<article>{body}</article>{comments}</div>") == want
    assert H.main_text(f"{teaser}<article>{body}</article>{comments}") == want
    assert H.main_text(f"<div class='notice-board'>{body}</div><div class='sidebar'>{'aside ' * 60}</div>") == want


class Lines(HTMLParser):
    """(text, characters in links, away) of blocks: the plain way to strip markup."""

    AWAY = {"nav", "header", "footer", "aside", "form"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.lines, self.text, self.links, self.depth, self.quiet, self.a, self.away = [], "", 0, [], 0, 0, 0

    def flush(self):
        if text := " ".join(unescape(self.text).split()):
            self.lines.append((text, self.links, self.away > 0))
        self.text, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.quiet += 1
        if tag == "a":
            self.a += 1
        if tag == "br":
            self.text += " "
        if tag in H.BLOCK:
            self.flush()
        if tag in H.BLOCK and tag not in ("p", "li") or tag in self.AWAY:
            own = tag in self.AWAY or bool({"ad", "comments", "sidebar", "cookie-notice"} & set((dict(attrs).get("class") or "").split()))
            self.depth.append((tag, own))
            self.away += own

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.quiet -= 1
        if tag == "a":
            self.a -= 1
        if tag in H.BLOCK:
            self.flush()
        if any(t == tag for t, _ in self.depth):
            while True:
                t, own = self.depth.pop()
                self.away -= own
                if t == tag:
                    break

    def put(self, data):
        if not self.quiet:
            self.text += data
            self.links += len(data.strip()) * (self.a > 0)

    def handle_data(self, data):
        self.put(data)

    def handle_entityref(self, name):
        self.put(f"&{name};")

    def handle_charref(self, name):
        self.put(f"&#{name};")


def plain(page):
    """Lines from the first window of three that is loud to the last, with the short ones before and after that no silence parts from them."""
    p = Lines()
    p.feed(page)
    p.flush()
    weights = [0 if away else min(400, max(0, len(t) - links)) for t, links, away in p.lines]
    sums = [sum(weights[i : i + 3]) for i in range(len(weights))]
    loud = [i for i, s in enumerate(sums) if s >= max(60, max(sums) / 12)]
    first, last = loud[0], loud[-1]
    while weights[first] == 0:
        first += 1
    while first and weights[first - 1]:
        first -= 1
    while last + 1 < len(weights) and weights[last + 1]:
        last += 1
    return "\n".join(t for t, _, away in p.lines[first : last + 1] if not away)


def test_against_a_plain_line_block_program(pages):
    for page in pages:
        assert re.search("<article>", page)
        assert plain(page) == H.main_text(page) == H.main_text(renamed(page))


def test_a_long_text_outside_can_pass_a_short_article():
    long = [f"Part {i} of " + "a text that goes on for quite a while, " * 9 for i in range(4)]
    got = H.main_text("<article><p>Brief, but marked.</p></article>" + "".join(f"<p>{x}</p>" for x in long))
    assert got.split("\n") == ["Brief, but marked.", *[x.strip() for x in long]]
