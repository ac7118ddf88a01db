"""One page of HTML to the nested records the plans work on.

The only Python stage: an Arrow UDF that receives nothing but the ``html``
column, so no other column leaves the JVM, and that returns one struct per
page.  Everything after it is native.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------

# elements removed with all they hold
BOILERPLATE = ["script", "style", "svg", "noscript", "header", "footer", "nav", "iframe", "button", "aside", "form",
               "meta", "link"]

# where the main content is looked for: by this order, then document order
MAIN_SELECTORS = ["main", "article", "#content", "#main", ".job-description",
                  ".post-content", '[role="main"]', ".description", "#job-details",
                  ".show-more-less-html__markup", ".jobs-description"]

# cards of a listing: .job-search-card, .base-search-card, li
CARD_CLASSES = {"job-search-card", "base-search-card"}
# cards whose text is taken: the two classes, li.jobs-search-results__list-item,
# div[class*="job-card"]
TEXT_CARD_ITEM_CLASS = "jobs-search-results__list-item"
TEXT_CARD_DIV_PART = "job-card"

# links to adverts: a.base-card__full-link, a.job-search-card__link,
# a[href*="/job/"], a[href*="/vaga/"]
LINK_CLASSES = {"base-card__full-link", "job-search-card__link"}
LINK_PARTS = ("/job/", "/vaga/")

# HTML: elements without content, and elements whose text is not page text
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = {"script", "style", "template"}
# elements that stand on their own lines
BLOCKS = set("address article aside blockquote body br caption center dd details dialog "
             "div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
             "hgroup hr html li main menu nav ol option p pre section summary table tbody td "
             "tfoot th thead title tr ul".split())
# an open element of the first kind ends where one of the second begins
IMPLIED_END = {
    "p": set("address article aside blockquote details div dl fieldset figure footer form h1 h2 "
             "h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
    "head": {"body"},
}
ENDS = {tag: {open_tag for open_tag, closers in IMPLIED_END.items() if tag in closers}
        for closers in IMPLIED_END.values() for tag in closers}
# ... but never across one of these
SCOPE = {"ul", "ol", "menu", "dl", "table", "select", "html", "body", "div", "article", "section", "main"}

# Markdown of the elements that are not just unwrapped
INLINE_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~",
                "code": "`", "kbd": "`", "samp": "`"}
LITERAL = ("pre", "code", "kbd", "samp")

NO_CLASSES = frozenset()

PAGE_TYPE = ("struct<cards: array<struct<pos: int, href: string, has_time: boolean, "
             "datetime_attr: string, time_text: string>>, anchors: array<string>, "
             "card_texts: array<string>, body: string, main_selector: string, parse_error: string>")

_CARD = pa.struct([("pos", pa.int32()), ("href", pa.string()), ("has_time", pa.bool_()),
                   ("datetime_attr", pa.string()), ("time_text", pa.string())])
_PAGE = pa.struct([("cards", pa.list_(_CARD)), ("anchors", pa.list_(pa.string())),
                   ("card_texts", pa.list_(pa.string())), ("body", pa.string()),
                   ("main_selector", pa.string()), ("parse_error", pa.string())])


# one way to say a selector per kind of test
_BY_TAG = {s: rank for rank, s in enumerate(MAIN_SELECTORS) if s[0].isalpha()}
_BY_ID = {s[1:]: rank for rank, s in enumerate(MAIN_SELECTORS) if s[0] == "#"}
_BY_CLASS = {s[1:]: rank for rank, s in enumerate(MAIN_SELECTORS) if s[0] == "."}
_BY_ROLE = {s.split('"')[1]: rank for rank, s in enumerate(MAIN_SELECTORS) if s.startswith("[role=")}


def main_rank(tag: str, attrs: dict, classes: set) -> int | None:
    """Index of the best main-content selector an element meets."""
    ranks = [_BY_TAG.get(tag), _BY_ID.get(attrs.get("id")), _BY_ROLE.get(attrs.get("role")),
             *[_BY_CLASS.get(name) for name in classes]]
    return min((rank for rank in ranks if rank is not None), default=None)


class PageReader(HTMLParser):
    """Reads a page once; keeps its cards, its links and the pieces of its clean view."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []          # (tag, list of what to do when it ends)
        self.opened = defaultdict(int)  # how many of each tag are open
        self.hidden = 0         # depth inside removed elements
        self.muted = 0          # depth inside elements whose text is no page text
        self.text = []          # the text node being read, in parts
        self.pieces = []        # clean view: ("open"|"close"|"text", value)
        self.main = {}          # selector rank -> [first piece, end piece]
        self.text_cards = []    # [first piece, end piece]
        self.cards, self.open_cards = [], []
        self.anchors, self.open_times = [], []

    # -- elements

    def handle_starttag(self, tag, attrs):
        self._end_text()
        named = {}
        for name, value in attrs:
            named.setdefault(name, value or "")
        if tag in ENDS:
            self._end_implied(tag)
        at_end = []
        classes = set(named["class"].split()) if "class" in named else NO_CLASSES
        if tag == "a" and self._is_link(named.get("href", ""), classes):
            self._link(named.get("href"))
        if tag == "time":
            self._time(named.get("datetime"), at_end)
        if tag == "li" or classes & CARD_CLASSES:
            self._open_card(at_end)
        if tag in BOILERPLATE:
            self.hidden += 1
            at_end.append(self._show)
        if tag in HIDDEN_TEXT:
            self.muted += 1
            at_end.append(self._unmute)
        if not self.hidden:
            self._select(tag, named, classes, at_end)
            self.pieces.append(("open", tag))
        self.open.append((tag, at_end))
        self.opened[tag] += 1
        if tag in VOID:
            self._end_top()

    def handle_startendtag(self, tag, attrs):
        # "<div/>" opens a div in HTML; only foreign and void elements end at once
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.opened["svg"]:
            self._end_top()

    def handle_endtag(self, tag):
        self._end_text()
        if self.opened[tag]:
            while self._end_top() != tag:
                pass

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self._end_text()    # text on both sides of a comment is two nodes

    def _end_text(self):
        if not self.text:
            return
        text, self.text = "".join(self.text), []
        if self.muted:
            return
        for card in self.open_times:
            card["time_text"] += text.strip()
        if not self.hidden:
            self.pieces.append(("text", text))

    def updatepos(self, i, j):
        return j    # nobody asks for line numbers

    def parse_marked_section(self, i, report=1):
        # "<![anything" is no error in HTML but a comment up to the next ">"
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def finish(self):
        self.close()
        self._end_text()
        while self.open:
            self._end_top()

    def _end_implied(self, tag):
        for name in ENDS[tag]:
            if self.opened[name]:
                break
        else:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth][0]
            if tag in IMPLIED_END.get(name, ()):
                while len(self.open) > depth:
                    self._end_top()
                if name in ("p", "head"):
                    return
            elif name in SCOPE:
                return

    def _end_top(self):
        tag, at_end = self.open.pop()
        self.opened[tag] -= 1
        if not self.hidden:
            self.pieces.append(("close", tag))
        while at_end:
            at_end.pop()()
        return tag

    def _show(self):
        self.hidden -= 1

    def _unmute(self):
        self.muted -= 1

    # -- listing view: sees the whole page

    @staticmethod
    def _is_link(href, classes):
        return classes & LINK_CLASSES or LINK_PARTS[0] in href or LINK_PARTS[1] in href

    def _open_card(self, at_end):
        card = {"pos": len(self.cards), "href": None, "has_time": False,
                "datetime_attr": None, "time_text": None, "linked": False}
        self.cards.append(card)
        self.open_cards.append(card)
        at_end.append(lambda: self.open_cards.remove(card))

    def _link(self, href):
        self.anchors.append(href)
        for card in self.open_cards:
            if not card["linked"]:      # only the first link of a card is tried
                card["linked"], card["href"] = True, href

    def _time(self, moment, at_end):
        fresh = [card for card in self.open_cards if not card["has_time"]]
        for card in fresh:
            card.update(has_time=True, datetime_attr=moment, time_text="")
        self.open_times.extend(fresh)
        at_end.append(lambda: [self.open_times.remove(card) for card in fresh])

    # -- clean view: sees what is left after the removals

    def _select(self, tag, named, classes, at_end):
        if not named and tag not in MAIN_SELECTORS:
            return
        rank = main_rank(tag, named, classes)
        if rank is not None and rank not in self.main:
            self._range(self.main.setdefault(rank, []), at_end)
        if not classes:
            return
        if (classes & CARD_CLASSES or (tag == "li" and TEXT_CARD_ITEM_CLASS in classes)
                or (tag == "div" and TEXT_CARD_DIV_PART in " ".join(named.get("class", "").split()))):
            self.text_cards.append([])
            self._range(self.text_cards[-1], at_end)

    def _range(self, bounds, at_end):
        bounds.append(len(self.pieces))
        at_end.append(lambda: bounds.append(len(self.pieces)))


def plain_text(pieces):
    """Text with a line break at every block element."""
    return "".join(value if kind == "text" else "\n" if value in BLOCKS else ""
                   for kind, value in pieces)


def markdown_text(pieces):
    """Markdown with ATX headings; links, images, div, span, ul and li are unwrapped."""
    stack, opened = [("", [])], defaultdict(int)
    for kind, value in pieces:
        if kind == "open":
            stack.append((value, []))
            opened[value] += 1
        elif kind == "close":
            tag, parts = stack.pop()
            opened[tag] -= 1
            stack[-1][1].append(_mark_up(tag, "".join(parts), opened))
        else:
            literal = any(opened[name] for name in LITERAL)
            stack[-1][1].append(value if literal else value.replace("*", r"\*").replace("_", r"\_"))
    return "".join(stack[0][1])


def _mark_up(tag, text, around):
    if tag in INLINE_MARKS and not around["pre"]:
        core = text.strip()
        mark = INLINE_MARKS[tag]
        if not core:
            return text
        # a mark stays inside one paragraph
        marked = "\n".join(f"{mark}{line.strip()}{mark}" if line.strip() else "" for line in core.splitlines())
        return text[:len(text) - len(text.lstrip())] + marked + text[len(text.rstrip()):]
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        line = " ".join(text.split())
        return f"\n\n{'#' * int(tag[1])} {line}\n\n" if line else ""
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "blockquote":
        lines = [line.strip() for line in text.splitlines() if line.strip()]
        return "\n\n" + "\n".join("> " + line for line in lines) + "\n\n"
    if tag == "pre":
        return f"\n\n```\n{text}\n```\n\n" if text.strip() else ""
    if tag in ("td", "th"):
        return " " + " ".join(text.split()) + " |"
    if tag == "tr":
        row = text.strip()
        rule = "\n" + "|" + " --- |" * row.count(" |") if around["thead"] else ""
        return f"\n| {row}{rule}\n" if row else ""
    if tag == "q":
        return f'"{text}"'
    if tag in BLOCKS:
        return f"\n{text}\n"
    return text


def read_page(html: str | None, markdown: bool) -> dict:
    """The record of one page; a page that fails is told in ``parse_error``, the rest go on."""
    empty = {"cards": [], "anchors": [], "card_texts": [], "body": None,
             "main_selector": None, "parse_error": None}
    if html is None:
        return empty | {"parse_error": "no content"}
    try:
        reader = PageReader()
        reader.feed(html)
        reader.finish()
        record = dict(empty)
        record["cards"] = [{k: v for k, v in card.items() if k != "linked"} for card in reader.cards]
        record["anchors"] = [href for href in reader.anchors if href is not None]
        if len(reader.text_cards) > 1:
            record["card_texts"] = [
                " ".join(filter(None, (v.strip() for k, v in reader.pieces[first:end] if k == "text")))
                for first, end in reader.text_cards]
        else:
            rank = min(reader.main, default=None)
            first, end = reader.main[rank] if rank is not None else (0, len(reader.pieces))
            pieces = reader.pieces[first:end]
            record["body"] = markdown_text(pieces) if markdown else plain_text(pieces)
            record["main_selector"] = MAIN_SELECTORS[rank] if rank is not None else None
        return record
    except Exception as failure:
        return empty | {"parse_error": f"{type(failure).__name__}: {failure}"}


def page_extract(html: Column, format: str = "markdown") -> Column:
    """``html`` to a struct of cards, anchors, card texts and main body (``PAGE_TYPE``)."""
    if format not in ("markdown", "text"):
        raise ValueError(f"unknown format {format!r}")
    markdown = format == "markdown"

    @F.arrow_udf(PAGE_TYPE)
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([read_page(page.as_py(), markdown) for page in pages], type=_PAGE)

    # not "nondeterministic" in truth: it keeps the optimizer from copying the
    # call into a filter below it and reading every page twice
    return extract.asNondeterministic()(html)


# Ship this module's code with the plan, so that executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
