"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block.  A line's length is that of its text outside links, and nothing where
its elements mark it as a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment, or hide it.
Lines of such elements are left out first.  Lengths of the others are summed over sliding windows of ``window`` lines; the
text surges where a window reaches ``surge`` characters and dives where windows fall to nothing; all that stands between
a surge and its dive is kept, and so are sentences beside it in the same element.  Where nothing surges, as in verse, any
text outside links is a surge.  Where a page marks its articles or main parts, they are the bounds: there every line belongs
to the text, however short; a dive of ``window`` lines or more that are links alone is left out, with the title before it,
if its links outweigh all text of the part outside links, as lists of other pages do and references don't.

Names of classes and ids are votes.  Where all parts of a name are listed words or say where or how large something is
(``site-footer``, ``adSlot2``), the element is apart.  Where only some are (``related-posts``, ``disqus_thread``,
``notice-of-appeal``), its text decides: it is apart if it has less than half of the text outside links of what it stands
in, so the one block that is the text stays whatever its name.

Character references are decoded, white space inside a block becomes one space, and blocks are joined by a blank line.

Nulls and odd input: a null html, or one without text, gives an empty text; null ids and urls are carried; repeated rows
each get a row; markup that is cut off or badly nested is read as far as it goes; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import positional, read_table

# Elements of HTML by what they are here.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
_NESTED = frozenset(
    "article aside body blockquote button dialog details div dl fieldset figure footer form head header iframe main menu nav"
    " noscript object ol section select svg table template textarea title ul".split()
)
_APART = frozenset(
    "aside button dialog fieldset footer form head iframe menu nav noscript object select svg template textarea title".split()
)
_APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog".split())
_APART_WORDS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices"
    " popup related reply replies respond share sharing sidebar social subscribe toolbar widget".split()
)
#: Parts of names that say where or how large something is, not what.
_PLACE_WORDS = frozenset(
    "area bar block bottom box column container content entries entry group inner item left link links list main outer page panel"
    " primary right row secondary section site slot space title top unit wrap wrapper".split()
)
_MAIN = frozenset(["article", "main"])
_UNNAMED = frozenset(["body", "html", "main"])  # their names say how a page is laid out
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end without a tag: what begins closes them, up to the element that holds them.
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_HOLDS = frozenset("ul ol menu dl table div section article main aside body blockquote".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WHITE = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SENTENCE = re.compile(r"[.!?…:;。！？]['\"”’»)\]]*$")


@lru_cache(10_000)
def _vote(names: str) -> int:
    """What the names of an element say: 2 that it isn't part of the text, 1 that it may not be, 0 nothing."""
    vote = 0
    for name in names.split():
        parts = [x.lower() for x in _NAME_PARTS.split(name) if x]
        if any(x in _APART_WORDS for x in parts):
            vote = max(vote, 2 if all(x in _APART_WORDS or x in _PLACE_WORDS for x in parts) else 1)
    return vote


@dataclass
class Line:
    text: str
    length: int  # outside links
    apart: bool
    part: int  # which article or main part, 0 for none
    doubts: tuple[int, ...]  # elements around it whose names may say that it is apart
    box: int  # the element that holds it
    heading: bool


@dataclass
class _Open:
    tag: str
    apart: bool = False
    part: int = 0
    doubts: tuple[int, ...] = ()
    box: int = 0
    inline: bool = False


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.linked = 0
        self.links = 0
        self.kinds = [""]  # of parts: article or main
        self.doubted: list[int] = []  # parts of the elements in doubt
        self.boxes = 0
        self.heading = False
        self.open = [_Open("")]

    def _block(self) -> _Open:
        return next(x for x in reversed(self.open) if not x.inline)

    def _end_line(self) -> None:
        text = _WHITE.sub(" ", "".join(self.text)).strip()
        if text:
            at = self._block()
            linked = 0 if self.heading and at.part else self.linked
            self.lines.append(Line(text, max(0, len(text) - linked), at.apart, at.part, at.doubts, at.box, self.heading))
        self.text, self.linked = [], 0

    def _close(self, tags: tuple[str, ...], within: frozenset[str]) -> None:
        """Ends the innermost of the elements, unless one of ``within`` stands between."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                if not self.open[i].inline:
                    self.links = 0
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in _BLOCKS or tag in _NESTED
        if block:
            self._end_line()
            self.heading = tag in _HEADINGS
            if tag in _ENDS_P:
                self._close(("p",), _NESTED)
            if tag in _ENDED_BY:
                self._close(_ENDED_BY[tag], _HOLDS)
        if tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.links += 1
        if tag in _VOID:
            return
        above, named = self.open[-1], dict(attrs)
        vote = 0 if tag in _UNNAMED else max(_vote(named.get(key) or "") for key in ("class", "id"))
        apart = (
            tag in _APART
            or tag == "header" and above.part == 0
            or (named.get("role") or "").lower() in _APART_ROLES
            or vote == 2
            or "hidden" in named
            or (named.get("aria-hidden") or "").lower() == "true"
            or bool(_HIDDEN.search(named.get("style") or ""))
        )
        if not block and not apart:
            return
        new = _Open(tag, above.apart or apart, above.part, above.doubts, above.box, not block)
        if vote == 1 and block and tag not in _MAIN:
            new.doubts = (*above.doubts, len(self.doubted))
            self.doubted.append(above.part)
        if tag in _MAIN and not above.part and not new.apart:
            self.kinds.append(tag)
            new.part = len(self.kinds) - 1
        if tag in _NESTED:
            self.boxes += 1
            new.box = self.boxes
        self.open.append(new)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS or tag in _NESTED:
            self._end_line()
            self.heading = False
        if tag == "a":
            self.links = max(0, self.links - 1)
        self._close((tag,), frozenset() if tag in _NESTED else _NESTED)

    def handle_data(self, data: str) -> None:
        if self.cdata_elem is None and not (self.open[-1].inline and self.open[-1].apart):
            self.text.append(data)
            if self.links:
                self.linked += len(_WHITE.sub(" ", data))


def lines_of(html: str) -> tuple[list[Line], list[str]]:
    """Lines that aren't apart, and the kinds of their parts."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    lines = [x for x in parser.lines if not x.apart]
    of_doubt, of_part = Counter(), Counter()
    for x in lines:
        of_part[x.part] += x.length
        for d in x.doubts:
            of_doubt[d] += x.length
    whole = sum(of_part.values())
    apart = {d for d, part in enumerate(parser.doubted) if 2 * of_doubt[d] < (of_part[part] if part else whole)}
    return [x for x in lines if not apart.intersection(x.doubts)], parser.kinds


def _surges(lengths: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """First and last + 1 line of every surge-to-dive stretch."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    found, i = [], 0
    while i < len(sums):
        if sums[i] < surge or not lengths[i]:
            i += 1
            continue
        end = i
        while end < len(sums) and sums[end]:
            end += 1
        last = end
        while last > i and not lengths[last - 1]:
            last -= 1
        found.append((i, last))
        i = end + 1
    return found


def _dense(lines: list[Line], window: int) -> list[Line]:
    """The lines of a part without dives of ``window`` lines or more whose links outweigh all its text outside links."""
    out, i, whole = [], 0, sum(x.length for x in lines)
    while i < len(lines):
        end = i
        while end < len(lines) and not lines[end].length:
            end += 1
        if end - i >= window and sum(len(x.text) for x in lines[i:end]) > whole:
            if out and (out[-1].heading or not _SENTENCE.search(out[-1].text)) and len(out[-1].text) < 80 and len(out) > 1:
                out.pop()  # the title of what is left out
            i = end
        else:
            out += lines[i : end + 1]
            i = end + 1
    return out


def _trimmed(lines: list[Line]) -> list[Line]:
    """The lines of a main part without labels at its ends, such as those of buttons: short, no heading and no sentence.

    A part without much text, which may be all labels, stays as it is.
    """
    label = lambda x: len(x.text) < 25 and not x.heading and not _SENTENCE.search(x.text)
    if sum(x.length for x in lines if not label(x)) < 200:
        return lines
    begin = next(i for i, x in enumerate(lines) if not label(x))
    end = next(i for i, x in enumerate(reversed(lines)) if not label(x))
    return lines[begin : len(lines) - end]


def main_text(html: str | None, window: int = 3, surge: int = 80) -> str:
    lines, kinds = lines_of(html or "")
    kept: list[Line] = []
    for _, part in groupby((x for x in lines if x.part), lambda x: x.part):
        own = list(part)
        dense = _dense(own, window)
        kept += _trimmed(dense) if kinds[own[0].part] == "main" else dense
    if not any(x.part for x in lines):
        lengths = [x.length for x in lines]
        found = _surges(lengths, window, surge) or _surges(lengths, window, 1)
        inside = {i for begin, end in found for i in range(begin, end)}
        boxes = {lines[i].box for i in inside if lines[i].length}
        kept = [x for i, x in enumerate(lines) if i in inside or x.length and x.box in boxes and _SENTENCE.search(x.text)]
    return "\n\n".join(x.text for x in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row."""
    pages, (page_id, url, html) = positional(pages, page_id, url, html)
    slim = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    return slim.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
