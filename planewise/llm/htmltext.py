"""Main text of HTML pages by text density.

The standard library's streaming parser turns a page into lines, one a block, with the
length of its text, how much of it is links and the number of tags that made it.  Ratios
of unlinked text to tags are smoothed with a Gaussian over neighbouring lines and
clustered into two about a threshold.  Dense lines select the content regions: the
innermost container that holds nearly all dense text is content as a whole, its short
lines and headings too; beyond it a line is content that is dense or, not being mostly
links, follows dense lines without a gap in the smoothed density.

Elements and class or id words only weigh.  Menus, footers, asides, reader comments and
what is plainly called boilerplate have no density.  Doubtful marks rule an element out
unless most of the page's dense text stands inside and hardly any beyond (a form around
the page, an article called ``has-sidebar``); a class or id that would rule out for sure
counts as doubtful on a page that has no sentence elsewhere.  All work is linear in the
page: no walk up or down the open elements, and what no bracket ends is text before the
parser looks for its end.  Marked sections are comments up to the next bracket, as
browsers take them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import by_batch, spread

SIGMA = 1.0
#: Share of the dense text that the innermost container holds at least to be a region.
REGION_SHARE = 0.9
#: A mark is void if more of the dense text stands inside than the first, and less beyond than the second.
VOID_INSIDE, VOID_BEYOND = 0.5, 0.25
#: Share of the threshold below which the smoothed density has a gap.
GAP = 0.1
#: Characters beyond links of a line that may be a sentence.
SENTENCE = 80

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template iframe object svg canvas head title textarea select button option".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
SOFT_BOILERPLATE = frozenset("header form".split())
CONTAINERS = frozenset("article main section div body td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their classes tell what a page has, not what they are.
WHOLE_PAGE = frozenset("html body main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent footer header masthead menu nav navbar navigation newsletter notice popup popular promo promoted recommended related share sharing sidebar social sponsor sponsored subscribe teaser teasers toolbar trending widget".split())
CONTENT_WORDS = frozenset("article content entry post story".split())
#: Words that may stand beside a word of boilerplate without making it doubtful.
NEUTRAL_WORDS = frozenset("area block box container inner item items left list main right section site top bottom wrap wrapper".split())

#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())

_WORDS = re.compile(r"[a-z]+")
_COMMENT_END = re.compile(r"--!?\s*>")
#: More digits than Python reads as a number; no such character exists.
_ENDLESS_REFERENCE = re.compile(r"&#[0-9]{4000,};?")
_CLOSES_P = BLOCKS - {"body", "html"}
NONE, SOFT, HARD = range(3)


def mark_of(tag: str, attrs: list[tuple[str, str | None]], sure: bool = True) -> int:
    """Whether an element's name, role, class and id mark it as boilerplate for sure, perhaps or not; without ``sure`` class and id don't tell for sure."""
    if tag in BOILERPLATE:
        return HARD
    found = SOFT if tag in SOFT_BOILERPLATE else NONE
    if tag in WHOLE_PAGE:
        return found
    content = comment = plain = False
    for name, value in attrs:
        if name == "role" and value and value.lower() in BOILERPLATE_ROLES:
            return HARD
        if name in ("class", "id") and value:
            for token in value.lower().split():
                words = set(_WORDS.findall(token))
                if words & COMMENT_WORDS:
                    comment = True
                elif words & BOILERPLATE_WORDS:
                    found = SOFT
                    plain |= words <= BOILERPLATE_WORDS | NEUTRAL_WORDS
                elif words & CONTENT_WORDS:
                    content = True
    if comment or plain:
        return HARD if sure and not content else SOFT
    return NONE if content and tag not in SOFT_BOILERPLATE else found


@dataclass(slots=True)
class Line:
    """A block of a page: ``mark`` is the innermost perhaps-mark around it, ``out`` says that a sure one is."""

    text: str
    tags: int
    linked: int
    container: int
    mark: int
    out: bool
    heading: bool

    @property
    def links(self) -> bool:
        return 2 * self.linked > len(self.text) and not self.heading


class _Lines(HTMLParser):
    """Blocks of a page in order, its containers and its perhaps-marks, both numbered as they open and with their parents."""

    def __init__(self, sure: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.sure = sure
        self.open: list[tuple[str, int, int, int]] = []  # element, mark kind, container and mark outside
        self.at: dict[str, list[int]] = {}  # places of the open elements of each name
        self.blocks: list[int] = []  # places of the open blocks
        self.out_depth = self.skip_depth = self.link_depth = self.heading_depth = 0
        self.containers: list[tuple[str, int]] = [("page", -1)]
        self.marks: list[int] = [-1]
        self.here = self.mark = 0
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        """End a line; tags of blocks without text count to the next that has some."""
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.here, self.mark, self.out_depth > 0, self.heading_depth > 0))
            self.tags = 0
        self.parts, self.linked = [], 0

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i):  # the standard parser ends at sections it doesn't know
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def end_head(self, always: bool) -> None:
        """The end tag of a head may be left out."""
        places = self.at.get("head")
        if places and (always or places[-1] == len(self.open) - 1):
            self.close_to(places[-1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self.end_head(tag == "body")
        if tag in BLOCKS:
            self.flush()
            # A block ends a paragraph that is open in the same container.
            if tag in _CLOSES_P and self.blocks and self.open[self.blocks[-1]][0] == "p":
                self.close_to(self.blocks[-1])
        elif tag == "br":
            self.parts.append("\n")
        self.tags += 1
        if tag in VOID:
            return
        kind = mark_of(tag, attrs, self.sure)
        self.open.append((tag, kind, self.here, self.mark))
        self.at.setdefault(tag, []).append(len(self.open) - 1)
        if tag in BLOCKS:
            self.blocks.append(len(self.open) - 1)
        if tag in CONTAINERS:
            self.containers.append((tag, self.here))
            self.here = len(self.containers) - 1
        if kind == SOFT:
            self.marks.append(self.mark)
            self.mark = len(self.marks) - 1
        self.count(tag, kind, 1)

    def count(self, tag: str, kind: int, by: int) -> None:
        self.out_depth += by * (kind == HARD)
        self.skip_depth += by * (tag in SKIPPED)
        self.link_depth += by * (tag == "a")
        self.heading_depth += by * (tag in HEADINGS)

    def close_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, kind, self.here, self.mark = self.open.pop()
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.count(tag, kind, -1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        places = self.at.get(tag)
        # An inline element isn't ended across a block.
        if places and (tag in BLOCKS or not self.blocks or places[-1] > self.blocks[-1]):
            self.close_to(places[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.at.get("head") and not data.isspace():
            self.end_head(False)
        if not self.skip_depth:
            self.parts.append(data)
            self.linked += len(data.strip()) if self.link_depth else 0


def mended(html: str) -> str:
    """The page with what nothing ends written as text, so that the parser doesn't look for its end again and again.

    Behind the last bracket no tag ends; behind the last end of a comment none does, so
    such a comment goes up to a bracket.
    """
    html = _ENDLESS_REFERENCE.sub("\ufffd", html)
    last = html.rfind(">") + 1
    html = html[:last] + html[last:].replace("<", "&lt;")
    ends = 0
    for m in _COMMENT_END.finditer(html):
        ends = m.end()
    return html[:ends] + html[ends:].replace("<!--", "<! ")


def parsed(html: str, sure: bool = True) -> _Lines:
    p = _Lines(sure)
    p.feed(mended(html))
    p.close()
    p.flush()
    return p


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel / kernel.sum())[reach : reach + len(ratios)]


def two_means(values: np.ndarray) -> float:
    """The threshold between two clusters of values."""
    t = float(values.mean())
    for _ in range(50):
        above = values > t
        if not above.any() or above.all():
            return t
        moved = (float(values[above].mean()) + float(values[~above].mean())) / 2
        if abs(moved - t) < 1e-9:
            break
        t = moved
    return t


def _below(parents: list[int], own: np.ndarray) -> np.ndarray:
    """Sums of ``own`` over each node and all below it; parents come before their children."""
    out = own.copy()
    for c in range(len(parents) - 1, 0, -1):
        out[parents[c]] += out[c]
    return out


def _ruled_out(page: _Lines, dense: np.ndarray) -> np.ndarray:
    """Whether the marks around each line rule it out; ``dense`` is the dense text of each line."""
    own = np.zeros(len(page.marks))
    for k, line in enumerate(page.lines):
        own[line.mark] += dense[k]
    inside, total = _below(page.marks, own), max(float(dense.sum()), 1e-9)
    beyond = own[0] / total  # under no mark at all
    out = [False] * len(page.marks)
    for m in range(1, len(page.marks)):
        void = inside[m] > VOID_INSIDE * total and beyond < VOID_BEYOND
        out[m] = out[page.marks[m]] or not void
    return np.array([line.out or out[line.mark] for line in page.lines])


def extract(html: str | None) -> str:
    """The main text of a page, blocks joined by a space; empty if there is none."""
    if not html:
        return ""
    page = parsed(html)
    sentence = lambda x: len(x.text) - x.linked >= SENTENCE
    if not any(sentence(x) for x in page.lines if not x.out) and any(map(sentence, page.lines)):
        page = parsed(html, sure=False)
    lines = page.lines
    texts = np.array([len(x.text) for x in lines])
    judged = np.array([not x.out for x in lines], bool)
    if not judged.any():
        return ""
    density = smoothed(np.array([0.0 if x.out else max(len(x.text) - x.linked, 0) / max(x.tags, 1) for x in lines]))
    threshold = two_means(density[judged])
    dense = judged & (density >= threshold)
    allowed = judged & ~_ruled_out(page, texts * dense)
    mass = texts * (dense & allowed)
    if not mass.any():
        mass = texts * allowed
    parents = [p for _, p in page.containers]
    own = np.zeros(len(parents))
    np.add.at(own, [x.container for x in lines], mass)
    held = _below(parents, own)
    # Containers that hold so much lie within one another, and the last to open is the innermost.
    region = int(np.flatnonzero(held >= REGION_SHARE * held[0]).max()) if held[0] else 0
    last = list(range(len(parents)))  # the last container inside each
    for c in range(len(parents) - 1, 0, -1):
        last[parents[c]] = max(last[parents[c]], last[c])
    whole = page.containers[region][0] not in ("page", "body")
    inside = np.array([whole and region <= x.container <= last[region] for x in lines], bool)
    return " ".join(lines[k].text for k in np.flatnonzero(_selected(lines, allowed, inside, dense, density, threshold)))


def _selected(lines: list[Line], allowed: np.ndarray, inside: np.ndarray, dense: np.ndarray, density: np.ndarray, threshold: float) -> np.ndarray:
    """Content lines: those of the region, and beyond it the dense ones with what joins them and their headings."""
    sure = allowed & (inside | dense & np.array([not x.links for x in lines]))
    kept = sure.copy()
    order = [k for k in np.flatnonzero(allowed).tolist()]
    for way in (order, order[::-1]):
        joined = False
        for k in way:
            weak = density[k] >= GAP * threshold and not lines[k].links
            joined = bool(sure[k]) or joined and (weak or lines[k].heading and way is not order)
            kept[k] |= joined and not lines[k].links
    return kept


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty html has an empty text; a page may be as long and as deep as a value
    can be.  Rows are independent: repeated rows give equal rows, null ids and urls are
    kept, an empty table gives none, further columns aren't read.
    """

    def make(c: dict) -> dict:
        texts = [extract(x.as_py()) for x in c["html"]]
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return by_batch(spread(read), "page_id long, url string, text string, n_chars long", make)
