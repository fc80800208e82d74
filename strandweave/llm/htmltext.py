"""Main text of web pages by streamed parser events and text-to-tag ratios.

The standard library's parser streams events; block-level tags cut the page into lines.
A line's text-to-tag ratio is its characters outside of links over its tags.  The ratios
are smoothed by a Gaussian kernel and clustered by a threshold, the standard deviation of
the smoothed ratios: lines above it are content, and their characters are votes.

Elements are features of lines, no more.  Scripts, styles, menus, page headers, footers,
asides and forms are left out by tag or role.  Class and id names are of two kinds: what
NAMES marks (adverts, comments, cookie notices and so on) is left out, unless hardly any text
is left without it; what DOUBTFUL marks is left out outside of articles, and in an article only
if its own text-to-tag ratio lies under the threshold; a doubtful element that holds
over half of the page's text is a wrapper and its name says nothing.  Names that start with
has, with, no or is tell of other elements.

Regions: each outermost article element is one, and all other lines are one.  An article is
kept if its votes are at least FAIR of the largest region's.  The other lines are kept if
they have at least half of all votes: those of sections that hold a content line, short ones
too, since a paragraph of two words belongs to its article.

White space in a line becomes one space; lines are joined in page order by one space.
Character references are decoded.  Work and memory are in proportion to the page, whatever
its nesting.

Defined results: a null or empty page, or one without text, gives an empty text; a tag
that is cut off at the page's end is dropped; rows that repeat a page id are extracted
each; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_table

# Element and attribute names of HTML and of common page templates.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SECTIONS = frozenset("article body div html main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that leave their whole content out.
SKIPPED = frozenset(
    "applet aside audio button canvas datalist dialog fieldset footer form frameset head iframe math menu nav noframes noscript object optgroup "
    "option script select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words of class and id names that mark what is not the article.
NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies "
    "disqus gdpr masthead menu nav navbar navigation navi newsletter outbrain overlay pager paginate pagination paywall popup promo promoted promotion recommended "
    "related share sharing sidebar sidebox signup sponsor sponsored subscribe subscription taboola topbar widget widgets".split()
)
#: Words that articles and their parts have in their names too.
DOUBTFUL = frozenset("byline card copyright dialog discussion feedback footer form hidden legal login modal notice notification replies reply respond search skip social teaser toast toolbar".split())
#: First words of names that tell of other elements.
OTHERS = frozenset("has is no with without".split())
#: Names that excuse "header" in the same attribute.
OWN_HEADER = frozenset("article content entry post story".split())
#: Start of a tag to the tags that it ends, and where to stop looking for them.
ENDS = {
    "p": ({"p"}, SECTIONS), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"table", "tr"}), "th": ({"td", "th", "p"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
SIGMA = 1.0
#: Least votes of a kept article, of the largest region's; least text that must be left without named elements.
FAIR, LEFT = 0.1, 0.1
PLAIN, WEAK, STRONG, OUT = 0, 1, 2, 3
CUT_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


def _standing(tag: str, attrs: list, in_article: bool) -> int:
    """What tag and attributes say of an element: PLAIN, WEAK or STRONG (named), or OUT."""
    if tag in SKIPPED:
        return OUT
    if tag in ("html", "body"):
        return PLAIN
    if tag == "header":
        return PLAIN if in_article else OUT
    found = PLAIN
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return OUT
        if name == "style" and "display:none" in value.replace(" ", ""):
            return OUT
        if name in ("class", "id"):
            named = [w for one in value.split() if (w := [x for x in re.split(r"[^a-z0-9]+", one) if x]) and w[0] not in OTHERS]
            words = {x for w in named for x in w}
            if words & NAMES or ("header" in words or "head" in words) and not (in_article or words & OWN_HEADER):
                found = STRONG
            elif words & DOUBTFUL:
                found = max(found, WEAK)
    return found


class Lines(HTMLParser):
    """Streams a page into lines: (text, characters in links, tags, number of the innermost element that is kept track of).

    Elements are numbered; of each the outermost article around it, the innermost section and the innermost named element are known.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.article, self.section, self.named = [-1], [0], [-1]  # by element; 0 is the page
        self.around: dict[int, tuple[int, int]] = {}  # named element: (the one around it, its standing)
        self.open: list[tuple[str, bool, int]] = []  # tag, whether it is left out, element
        self.at: dict[str, list[int]] = {}  # tag: its places in open
        self.blocks: list[int] = []  # places of block-level elements in open
        self.out = self.inside = self.links = self.tags = self.linked = 0
        self.text: list[str] = []

    def here(self) -> int:
        return self.open[-1][2] if self.open else 0

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.linked, self.tags, self.here()))
        self.text, self.tags, self.linked = [], 0, 0

    def last(self, tags) -> int:
        """The innermost place of any of the tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def pop(self, k: int) -> None:
        """Closes the open elements from the k-th."""
        if self.blocks and self.blocks[-1] >= k:
            self.cut()
        while len(self.open) > k:
            tag, out, _ = self.open.pop()
            self.at[tag].pop()
            self.out -= out
            self.inside -= tag in ("article", "main")
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def push(self, tag: str, standing: int) -> None:
        up, n = self.here(), len(self.article)
        around = self.named[up]
        if standing in (WEAK, STRONG):
            self.around[n] = (around, standing)
        self.article.append(n if tag == "article" and self.article[up] < 0 else self.article[up])
        self.section.append(n if tag in SECTIONS else self.section[up])
        self.named.append(n if standing in (WEAK, STRONG) else around)
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, standing == OUT, n))
        self.out += standing == OUT
        self.inside += tag in ("article", "main")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID and tag != "hr":
            return
        if tag == "hr":
            self.cut()
            return
        if tag == "a":
            self.links += 1
        standing = _standing(tag, attrs, self.inside > 0)
        if tag not in BLOCKS and standing == PLAIN and not (self.open and self.open[-1][0] == tag):
            return
        if tag in ENDS:
            ended, stop = ENDS[tag]
            while (k := self.last(ended)) > self.last(stop):
                self.pop(k)
        elif tag in BLOCKS and self.open and self.open[-1][0] == "p":
            self.pop(len(self.open) - 1)
        if tag in BLOCKS or standing in (WEAK, STRONG):
            self.cut()
            self.tags = 1
        self.push(tag, standing)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        k = self.last((tag,))
        if k < 0 or tag not in BLOCKS and tag not in SKIPPED and self.blocks and self.blocks[-1] > k:  # an inline element ends before a block around it
            return
        if tag not in BLOCKS and self.around.get(self.open[k][2]):
            self.cut()
        self.pop(k)

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def ratios(lines: list[tuple]) -> np.ndarray:
    """Smoothed text-to-tag ratios."""
    r = np.array([max(0, len(t) - linked) / max(1, tags) for t, linked, tags, _ in lines], float)
    reach = int(3 * SIGMA)
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(r)), kernel)[reach : reach + len(r)]
    return np.convolve(r, kernel)[reach : reach + len(r)] / weight


def verdicts(parser: Lines, bar: float, strict: bool) -> dict[int, bool]:
    """Of each named element, whether it is left out.  strict: what is named strongly always is, else only if it holds at most half of the text."""
    around, sums = parser.around, {n: [0, 0, 0] for n in parser.around}  # characters, of them outside of links, tags
    for text, linked, tags, node in parser.lines:
        if (n := parser.named[node]) >= 0:
            for k, x in enumerate((len(text), max(0, len(text) - linked), tags)):
                sums[n][k] += x
    for n in sorted(around, reverse=True):  # an element's number is larger than that of any around it
        if (up := around[n][0]) >= 0:
            for k in range(3):
                sums[up][k] += sums[n][k]
    total = sum(len(t) for t, *_ in parser.lines)
    out: dict[int, bool] = {}
    for n in sorted(around):
        up, standing = around[n]
        size, free, tags = sums[n]
        wraps = 2 * size > total
        in_article = parser.article[n] >= 0 and parser.article[n] != n
        own = (strict or not wraps) if standing == STRONG else not wraps and (free < bar * max(1, tags) or not in_article)
        out[n] = own or out.get(up, False)
    return out


def chosen(parser: Lines, content: np.ndarray, bar: float, strict: bool) -> list[str]:
    """The lines of the kept regions."""
    left_out = verdicts(parser, bar, strict)
    held = [(k, text, node) for k, (text, _, _, node) in enumerate(parser.lines) if not left_out.get(parser.named[node], False)]
    votes: dict[int, int] = {}
    for k, text, node in held:
        if content[k]:
            votes[parser.article[node]] = votes.get(parser.article[node], 0) + len(text)
    if not votes:
        return [text for _, text, _ in held]
    rest = 2 * votes.get(-1, 0) >= sum(votes.values())
    kept = {a for a, v in votes.items() if a >= 0 and v >= FAIR * max(votes.values())}
    sections = {parser.section[node] for k, _, node in held if content[k] and parser.article[node] < 0}
    return [text for _, text, node in held if (parser.article[node] in kept if parser.article[node] >= 0 else rest and parser.section[node] in sections)]


def extract(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(CUT_TAG.sub("", html))
    parser.close()
    parser.cut()
    lines = parser.lines
    if not lines:
        return ""
    r = ratios(lines)
    bar = float(min(r.std(), r.max()))
    content = r >= bar
    found = chosen(parser, content, bar, True)
    if parser.around and sum(map(len, found)) < LEFT * sum(len(t) for t, *_ in lines):
        found = chosen(parser, content, bar, False)
    return " ".join(found)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return python_table(rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint"), "page-texts")
