"""HTML main text by the distribution of text over line blocks.

The page is cut into lines at block elements. Mark-up, scripts, styles and comments are stripped. What is known of a line
sets its length: zero inside boilerplate (menus, headers, footers, sidebars, forms, notices, adverts, reader comments, by
tag, role or class), where most of it is links, and, on pages that mark an article or main element, outside of those; else
the number of its characters, and a paragraph's or heading's at least that of prose, if it stands in a marked article or
reads like a sentence. A block without text is no line; one of length zero stays in its place.

Over a window of WINDOW lines the lengths are summed. A stretch reaches from where the sums surge from zero to where they
dive to zero. It is strong if its largest sum is a fair share of the page's largest or as much as prose. All stretches
from the first strong one to the last are kept, without their lines of length zero.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

WINDOW = 3
SHARE = 0.25  # a stretch is strong if its largest window holds this share of the page's largest
PROSE = 86  # or this many characters

# fixed values: names of HTML elements
BLOCK = set(
    "address article aside blockquote body br canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul video audio".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
STRIPPED = set(
    "head nav footer aside form header menu button select option textarea input label fieldset dialog noscript template iframe object svg canvas audio video map math".split()
)
# fixed values: elements that end an open paragraph, those that end an open one of their own kind, and what bounds these
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH = set("p blockquote pre h1 h2 h3 h4 h5 h6".split())
# fixed values: words in class, id or role that mark boilerplate
MARKS = set(
    "ad ads advert advertisement advertising adverts adv sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead "
    "comment comments disqus respond responses reply replies cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related "
    "recommended widget widgets toolbar pager pagination search login signup skip complementary contentinfo form".split()
)
# words that may stand beside one of them, and those that may only beside some: an article's own header is text
BESIDE = set("main page site top bottom left right box container wrapper block list section bar link links item items inner outer area wrap holder group module unit slot panel thread the js is has".split())
OF_TEXT = set("post posts user reader blog article entry story content".split())
NOT_OF_TEXT = MARKS - set("header footer banner masthead notice alert aside form search menu".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|xmp|noembed|noframes)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")
SENTENCE = re.compile(r"\w\W+\w+\W+\w.*[.!?\u2026\u3002][\"'\u201d\u2019\u00bb)\]]*$", re.S)  # three words and a stop
RIGHTS = re.compile(r"(?:\W|copyright\b)*\u00a9|copyright\b", re.I)


def _marks(token: str) -> bool:
    """Whether a class, id or role, as a whole, names boilerplate: `cookie-notice` does, `article-header` does not."""
    words = [w for w in NAME.findall(token) if len(w) > 1]
    marks = [w for w in words if w in MARKS]
    return bool(marks) and all(w in MARKS or w in BESIDE or (w in OF_TEXT and marks[0] in NOT_OF_TEXT) for w in words)


def _boilerplate(tag: str, rest: str) -> bool:
    if tag in STRIPPED:
        return True
    if not rest or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name in ("class", "id", "role") and any(map(_marks, value.split())):
            return True
    return False


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    stripped: bool  # inside boilerplate
    marked: bool  # inside an article or main element
    paragraph: bool  # of a paragraph or heading


def lines(page: str) -> list[Line]:
    """The page's lines in order, those of boilerplate too."""
    out: list[Line] = []
    stack: list[tuple[str, bool]] = []
    parts: list[str] = []
    linked = bad = main = inside = prose = 0

    def flush() -> None:
        nonlocal linked
        text = BLANK.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Line(text, linked, bad > 0, main > 0, prose > 0))
        parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal bad, main, inside, prose
        tag, was = stack.pop()
        bad -= was
        main -= tag in ("article", "main")
        inside -= tag == "a"
        prose -= tag in PARAGRAPH

    def close(tags: set[str], within: bool) -> None:
        """Closes the last open one of the tags and what it holds; `within`: unless a block element lies between."""
        for depth in range(len(stack) - 1, -1, -1):
            tag = stack[depth][0]
            if tag in tags:
                while len(stack) > depth:
                    pop()
                return
            if within and tag in BLOCK and tag != "p":
                return

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text = html.unescape(page[at : m.start()])
            parts.append(text)
            linked += len(text) * (inside > 0)
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if m[2]:
            close({tag}, tag not in BLOCK)
        elif tag not in VOID and not m[4].endswith("/"):
            if tag in ENDS_P:
                close({"p"}, True)
            if tag in SAME:
                close(SAME[tag], True)
            if tag == "a":
                close({"a"}, True)
            was = _boilerplate(tag, m[4])
            stack.append((tag, was))
            bad += was
            main += tag in ("article", "main")
            inside += tag == "a"
            prose += tag in PARAGRAPH
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    flush()
    return out


def lengths(found: list[Line]) -> np.ndarray:
    """What each line counts in the sums."""
    marked = any(x.marked and not x.stripped for x in found)

    def of(x: Line) -> int:
        if x.stripped or 2 * x.linked > len(x.text) or (marked and not x.marked):
            return 0
        if x.paragraph and (marked or (SENTENCE.search(x.text) and not RIGHTS.match(x.text))):
            return max(len(x.text), PROSE)
        return len(x.text)

    return np.array([of(x) for x in found], int)


def kept(size: np.ndarray) -> slice:
    """The lines from the first strong stretch's surge to the last one's dive."""
    if not size.any():
        return slice(0, 0)
    sums = np.convolve(size, np.ones(WINDOW, int))[: len(size)]  # of a line and those before it
    ahead = np.convolve(size[::-1], np.ones(WINDOW, int))[: len(size)][::-1]  # of a line and those after it
    alive = (sums > 0) | (ahead > 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], alive.astype(int), [0]))))
    least = min(SHARE * sums.max(), PROSE)
    strong = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if sums[a:b].max() >= least]
    return slice(strong[0][0], strong[-1][1])


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by one space; empty for a null, blank or textless page."""
    if not page:
        return ""
    found = lines(page)
    size = lengths(found)
    part = kept(size)
    return " ".join(x.text for x, n in zip(found[part], size[part]) if n)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages, repeated rows each. Other columns are not read.

    A null or empty page has an empty text; an empty table gives no rows; pages of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        T.tidily(run), "page_id long, url string, text string, n_chars long"
    )
