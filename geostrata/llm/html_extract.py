"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line weighs what its text is
long, up to a bound; a line in a menu, header, footer, sidebar, notice, advert, form or
comment weighs nothing, text of links weighs nothing outside of an article, and a line that
the page marks as its article weighs some more. What looks like a sidebar or a form but
holds the page's article, or most of its text, is the page's frame and takes no weight. A sliding window sums the weights of
neighbouring lines: it surges where the sum rises above a share of the page's loudest
window and dives where it falls below. All text between the first surge and the last dive
is kept, but for lines without weight of their own, with the headings and paragraphs that
lead to a surge and the quiet lines that end a text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import chunks, table

#: Lines that a window sums, and the sum from which it is loud: the larger of a number and a share of the page's loudest window.
WINDOW, LOUD, SHARE = 3, 60, 1 / 12
#: Longest text that a line weighs; in a marked article each line weighs so much more, and so many times that.
LONG, EXTRA, MARKED = 400, 150, 3
#: Deepest nesting that is told apart: elements beyond it become neighbours.
DEPTH = 512

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: What ends a tag or begins a quoted value in it.
STOP = re.compile(r"""[>"']""")
#: Elements whose contents are no text of the page.
SILENT = frozenset(("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title"))
#: Elements with raw contents: markup inside them isn't parsed.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title", "noscript", "iframe", "template")}
#: Elements that hold no main text.
ASIDE = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "fieldset", "label", "input"))
#: Attributes one by one, so that neither a data-class nor what a quoted value holds is taken for a class.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TELLING = frozenset(("class", "id", "role", "aria-label"))
#: Words in class, id or role that say the same.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements sponsored sponsor promo promos promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login menu menus nav navbar navigation navbox breadcrumb breadcrumbs sidebar sidebars aside widget widgets header masthead footer foot toolbar share sharing social comment comments commentlist respond reply replies disqus discussion related recommended recommendations pagination pager search form skip contentinfo complementary".split()
)
#: Those that say so inside an article as well, where the others are also subjects; words that only tell their place or shape.
SURE = frozenset(
    "ad ads advert adverts advertisement advertisements sponsored promo promos cookie cookies consent popup modal newsletter subscribe navbar navbox breadcrumb breadcrumbs sidebar sidebars masthead toolbar comment comments commentlist disqus pagination pager contentinfo complementary".split()
)
#: With one of these, a word tells what a page has or lacks, not what an element is.
STATE = frozenset("has no not with without is hide hides show shows".split())
PLACE = frozenset("area bar block bottom box container content inner left list outer right section slot top unit wrap wrapper".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


#: Elements that open a text, and lists and tables, in which menus stand.
OPENING, LISTED = HEADINGS | {"p"}, frozenset("li dd dt option td th tr ul ol dl table".split())


class Away:
    """An element that by its tag, class or id holds no main text; ``sure`` if by its tag or a whole word."""

    __slots__ = ("chars", "frame", "sure")

    def __init__(self, sure: bool):
        self.sure, self.chars, self.frame = sure, 0, False  # chars: of text in it; frame: it turned out to be the frame of the page


class Line:
    __slots__ = ("aside", "aways", "block", "inside", "links", "text")

    def __init__(self, text: str, aways: tuple[Away, ...] = (), inside: int = 0, block: str = "", links: int = 0):
        self.text, self.aways, self.inside, self.block, self.links = text, aways, inside, block, links  # inside: number of the outermost article, 0 outside of any; block: innermost block element; links: characters inside of links
        self.aside = False

    def weight(self) -> int:
        if self.aside:
            return 0
        return MARKED * (min(len(self.text), LONG) + EXTRA) if self.inside else min(max(0, len(self.text) - self.links), LONG)


def hinted(tag: str, attributes: str, inside: bool) -> str:
    """How class, id or role tell of no main text: by a "whole" word, by a "part" of one, or not at all.

    A heading's id is an anchor and tells nothing, and a section's id only as a whole. Inside an article only what is no
    subject of a text counts: a sure word, sure words with others of their kind or with a place, and roles.
    """
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name not in TELLING or (name == "id" and tag in HEADINGS):
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        for word in [value.strip()] if name == "aria-label" and inside else value.split():
            parts = set(re.split(r"[_-]+", word)) - {""}
            if word in SURE or (name == "role" and word in HINTS):
                return "whole"
            if parts & STATE or (name == "id" and tag == "section"):
                continue
            if not inside:
                told = bool(parts & HINTS)
            else:
                told = name not in ("aria-label", "role") and len(parts) > 1 and bool(parts & SURE) and parts <= HINTS | PLACE
            if told:
                found = "part"
    return found


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of each tag, name empty for comments and declarations, in time linear in the page.

    The caller may send a place to go on from. A quoted value may hold what ends a tag; where quotes stay open to the end
    of the page, none of the page counts from there on.
    """
    at, last, quoted = 0, html.rfind(">"), True
    while True:
        start = html.find("<", at)
        if start < 0:
            return
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            end = len(html) if end < 0 else end + 3
            at = (yield start, end, False, "", "") or end
            continue
        if start > last:  # no tag ends after this place
            return
        if html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start) + 1
            at = (yield start, end, False, "", "") or end
            continue
        name = NAME.match(html, start + 1)
        if not name:
            at = start + 1
            continue
        end = name.end()
        while quoted:
            stop = STOP.search(html, end)
            if not stop:
                quoted = False
            elif stop[0] == ">":
                end = stop.end()
                break
            else:
                close = html.find(stop[0], stop.end())
                quoted, end = close >= 0, close + 1
        if not quoted:
            end = html.find(">", name.end()) + 1
        closes = name[0][0] == "/"
        at = (yield start, end, closes, name[0][closes:].lower(), html[name.end() : end - 1]) or end


def lines(html: str) -> list[Line]:
    """Blocks of text in page order, white space made single, references decoded."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, tuple[Away, ...], int]] = []  # tag; silent, what is away and article at it
    held: Counter[str] = Counter()  # tags on the stack
    articles: list[tuple[tuple[Away, ...], list[int]]] = []  # what is away at each article, characters in it
    every: list[Away] = []
    silent, aways = False, ()
    inside = links = 0

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Line(text, aways, inside, next((s[0] for s in reversed(stack) if s[0] in BLOCK), ""), links))
                for a in aways:
                    a.chars += len(text)
                if inside:
                    articles[inside - 1][1][0] += len(text)
        links = 0

    def cut(i: int) -> None:
        held.subtract(s[0] for s in stack[i:])
        del stack[i:]

    def say(piece: str) -> None:
        nonlocal links
        if piece and not silent:
            parts.append(unescape(piece) if "&" in piece else piece)
            if held["a"] > 0:
                links += len(piece.strip())

    at, found, go_on = 0, tags(html), None
    while True:
        try:
            start, end, closes, tag, attributes = found.send(go_on)
        except StopIteration:
            break
        say(html[at:start])
        at, go_on = end, None
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK
        if closes:
            if held[tag] <= 0:
                if block:
                    close()
                continue
            popped = len(stack) - 1
            while stack[popped][0] != tag:
                popped -= 1
            # a stray end tag doesn't close containers that hold it, as </b> must not end an article
            if not block and any(s[0] in BLOCK for s in stack[popped + 1 :]):
                held[tag] -= 1
                del stack[popped]
                continue
            if block or any(s[0] in BLOCK for s in stack[popped:]):
                close()
            cut(popped)
            silent, aways, inside = stack[-1][1:] if stack else (False, (), 0)
            continue
        if block:
            close()
            if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):
                cut(_end_open(stack, tag))
                silent, aways, inside = stack[-1][1:] if stack else (False, (), 0)
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        quiet = silent or tag in SILENT
        away, told = aways, ""
        if tag in ASIDE and not (tag == "header" and inside):
            told = "part" if tag == "form" else "whole"
        elif tag not in ("html", "body", "article", "main") and attributes:
            told = hinted(tag, attributes, inside > 0)
        if told:
            every.append(Away(told == "whole"))
            away = (*aways, every[-1])
        within = inside
        if not inside and (tag in ("article", "main") or 'role="main"' in attributes):
            articles.append((away, [0]))
            within = len(articles)
        if tag in RAW:
            raw_end = RAW[tag].search(html, at)
            at = go_on = raw_end.end() if raw_end else len(html)
            continue
        if quiet != silent or away is not aways or within != inside:
            close()
        if len(stack) >= DEPTH:
            cut(DEPTH - 1)
        stack.append((tag, quiet, away, within))
        held[tag] += 1
        silent, aways, inside = quiet, away, within
    say(html[at:])
    close()
    framed(articles, every, sum(len(x.text) for x in out))
    for x in out:
        x.aside = any(not a.frame for a in x.aways)
    return out


def framed(articles: list[tuple[tuple[Away, ...], list[int]]], every: list[Away], total: int) -> None:
    """Tell which elements are the frame of the page: those around its article (the longest of those in the fewest of them), else, without any article, unsure ones with half of its text."""
    spoken = [(len(aways), -chars[0], aways) for aways, chars in articles if chars[0]]
    around = min(spoken, key=lambda x: x[:2])[2] if spoken else [a for a in every if not a.sure and 2 * a.chars >= total]
    for a in around:
        a.frame = True


def _end_open(stack: list[tuple[str, bool, tuple[Away, ...], int]], tag: str) -> int:
    """Place on the stack from which a paragraph, item or cell that begins ends what is open: one of its kind with only inline elements in it."""
    i = len(stack) - 1
    while i >= 0 and stack[i][0] not in BLOCK:
        i -= 1
    return i if i >= 0 and (stack[i][0] == tag or stack[i][0] == "p") else len(stack)


def spans(weights: list[int], window: int = WINDOW, least: int = LOUD, share: float = SHARE) -> list[tuple[int, int]]:
    """(surge, dive) points: lines from where the sum over a window gets loud to where it is no longer."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    loud = max(least, share * max(sums, default=0))
    found, i = [], 0
    while i < n:
        if sums[i] < loud:
            i += 1
            continue
        start = i
        while 2 * weights[start] < max(weights[start : start + window]):  # the window looks ahead: the surge is at its first line that is no mere whisper before the noise
            start += 1
        end = start + 1
        while end < n and sums[end] >= loud:
            end += 1
        found.append((start, end))
        i = end
    return found


def main_text(html: str | None) -> str:
    """Blocks of the main text joined by line feeds; empty if there is none. A page without any surge is kept whole but for lines without weight of their own."""
    if not html:
        return ""
    page = lines(html)
    found = spans([x.weight() for x in page])
    first, end = (opening(page, found[0][0]), ending(page, found[-1][1])) if found else (0, len(page))
    return "\n".join(x.text for x in page[first:end] if not x.aside)


def opening(page: list[Line], surge: int) -> int:
    """Place where the text of the surge begins: its marked article's first line, else the first heading or paragraph that leads to it with no list or table between."""
    first = surge
    for i in range(surge - 1, -1, -1):
        if page[i].aside:
            continue
        if page[i].inside != page[surge].inside or (not page[i].inside and page[i].block in LISTED):
            break
        if page[i].inside or page[i].block in OPENING:
            first = i
    return first


def ending(page: list[Line], dive: int, window: int = WINDOW) -> int:
    """Place after the quiet lines that end the text before the dive: all of its marked article, else up to a whole window without weight."""
    last, silence = dive, 0
    for i in range(dive, len(page)):
        if page[i].aside:
            silence += 1
        elif page[i].inside == page[dive - 1].inside and (page[i].inside or silence < window):
            last, silence = i + 1, 0
        else:
            break
    return last


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row's whole html.

    Null or empty html: empty text. A null id or url stays null. Repeated rows give repeated results; of equally loud
    spans all are kept. Other columns, whatever their names, don't matter. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(F.col(id_column).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: nulls, empty pages, ties, repeats and empty tables as in ``extract``."""
    return extract(table(spark, sf_dir, "pages"))
