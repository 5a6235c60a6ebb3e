"""Operator 4: main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines, one per block
element.  A line's ratio is its characters over its tags; the ratios are smoothed
with a Gaussian over neighbouring lines, and two-means clustering of the
smoothed ratios gives a threshold.  Lines of one container form a region, and a
region is content if its smoothed ratio reaches the threshold and it is not
mostly links.  Where a page marks an article (or main part) with text, only its
regions are candidates.  There the ratio decides on sections (articles and
divisions, with the lists, tables and quotes in them) by their characters' mean,
and only if the upper cluster's mean is at least ``APART`` times the lower one's:
an article of text alone is one cluster.  A section with a first-level heading
stays.

Elements that are never content are left out first: menus, headers (but not the
headings of an article's own header), footers, sidebars, forms, scripts, styles
and hidden parts, and by their class, id or role adverts, notices and comments
(names count as wholes: ``cookie-notice`` is one, ``notice-period`` isn't).

Edge cases: null, empty and textless pages give an empty text; broken markup is
read as far as it goes, with open elements closed at the end; repeated pages are
each extracted; an empty table gives an empty result; other columns are passed
on, but columns named ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import table

# Fixed sets of element names.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = set("article aside body dialog div footer form header main menu nav section table ul ol dl blockquote figure".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style title noscript template svg math iframe object canvas video audio head".split())
BOILERPLATE = set("nav header footer aside form menu dialog button select textarea fieldset label".split())
#: Fixed list of words in a class or id that mark a part as not being content.
MARKS = set(
    "ad ads adv advert adverts advertisement advertisements alert alerts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply "
    "share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
OUTER_MARKS = {"header", "masthead", "topbar"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ARTICLE = {"article", "main"}
SECTIONS = ARTICLE | {"body", "dialog", "div", "section"}
SIGMA = 1.5
APART = 2.0
OPEN_TAG = re.compile(r"<[a-zA-Z/!?]")
#: Fixed list of words that may stand beside them in one name (``site-header``, but neither ``has-sidebar`` nor ``share-price``).
BESIDE = set("a area bar block bottom box btn button buttons container content global group inner items left link links list main outer page panel primary right secondary section site slot top unit wrap wrapper".split())
#: Fixed list of further words that may stand beside the marks of adverts, notices and comments (``reader-comments``, ``article-footer``), but not beside the names of headers.
#: A widget is named by its owner in front of it (``text-widget``); behind it stands what is named by the widget (``widget-entry``).
OWNERS = set("article blog entry google info law message post reader readers responsive signup size story tag text trail unit user users visitor warning x".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def marked(names: str, marks: set[str], beside: set[str] = BESIDE) -> bool:
    """Is one of the class names or ids made of these words, numbers and words that may stand beside them alone?"""
    for name in names.split():
        words = [x.lower() for x in WORDS.findall(name)]
        owned = "widget" in words and words[-1] in OWNERS
        if not owned and any(x in marks for x in words) and all(x in marks or x in beside or x.isdigit() for x in words):
            return True
    return False


class Line:
    __slots__ = ("text", "tags", "links", "region", "article", "section", "title")

    def __init__(self, text: str, tags: int, links: int, region: int, article: bool, section: int, title: bool):
        self.text, self.tags, self.links, self.region, self.article, self.section, self.title = text, tags, links, region, article, section, title


class Reader(HTMLParser):
    """Collects the lines of a page that may be content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, str, int]] = []  # tag, role, region
        self.regions = 0
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.hidden = self.outside = self.article = self.in_link = self.own_header = self.heading = 0

    # roles: skip (no text at all), drop (not content), header (an article's own), article, link, heading, or none
    def _role(self, tag: str, attrs: list) -> str:
        if tag in SKIPPED:
            return "" if tag == "head" else "skip"
        given = dict(attrs)
        if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style") or ""):
            return "skip"
        if tag in ("body", "html"):
            return ""
        names = f"{given.get('class') or ''} {given.get('id') or ''}"
        if marked(names, MARKS, BESIDE | OWNERS) or (given.get("role") or "").lower() in ROLES:
            return "drop"
        if tag == "header" or marked(names, OUTER_MARKS):
            return "header" if self.article and tag not in HEADINGS else "" if tag in HEADINGS else "drop"
        if tag in BOILERPLATE:
            return "drop"
        if tag in ARTICLE or (given.get("role") or "").lower() in ARTICLE:
            return "article"
        return "link" if tag == "a" else "heading" if tag in HEADINGS else ""

    def _count(self, role: str, by: int) -> None:
        if role == "skip":
            self.hidden += by
        elif role == "drop":
            self.outside += by
        elif role == "article":
            self.article += by
        elif role == "link":
            self.in_link += by
        elif role == "header":
            self.own_header += by
        elif role == "heading":
            self.heading += by

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                region = next((r for _, _, r in reversed(self.open) if r), 0)
                section = next((r for t, _, r in reversed(self.open) if t in SECTIONS), 0)
                title = any(t == "h1" for t, _, _ in self.open)
                self.lines.append(Line(text, self.tags, self.links, region, self.article > 0, section, title))
            self.parts.clear()
            self.tags = self.links = 0

    def _close_to(self, at: int) -> None:
        """Closes the open elements from position ``at`` on."""
        if any(t in BLOCKS for t, _, _ in self.open[at:]):
            self._end_line()
        for _, role, _ in self.open[at:]:
            self._count(role, -1)
        del self.open[at:]

    def _last(self, tag: str, stop: set[str]) -> int | None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                return i
            if self.open[i][0] in stop:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            for own in ("p", tag) if tag in ("li", "dd", "dt", "tr") else ("p",):
                if (at := self._last(own, CONTAINERS)) is not None:
                    self._close_to(at)
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        role = self._role(tag, attrs)
        if tag in BLOCKS or role:
            region = 0
            if tag in CONTAINERS:
                self.regions += 1
                region = self.regions
            if role in ("skip", "drop") and tag not in BLOCKS and tag not in SKIPPED and not self.hidden:
                self.parts.append(" ")
            self.open.append((tag, role, region))
            self._count(role, 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if (at := self._last(tag, set() if tag in BLOCKS else CONTAINERS)) is not None:
            self._close_to(at)

    def handle_data(self, data: str) -> None:
        if self.hidden or self.outside or (self.own_header and not self.heading):
            return
        self.parts.append(data)
        if self.in_link:
            self.links += len(data.strip())


def without_open_tag(html: str) -> str:
    """The page without a tag or comment that its end cuts off (the parser would try it again from every ``<`` in it)."""
    cut = OPEN_TAG.search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


def read(html: str) -> list[Line]:
    html = without_open_tag(html)
    reader = Reader()
    try:
        reader.feed(html)
        reader.close()
    except AssertionError:  # the parser gives up on an unknown marked section
        if "<![" not in html:
            raise
        return read(html.replace("<![", "&lt;!["))
    reader._end_line()
    return reader.lines


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that fall outside are left out."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def two_means(values: np.ndarray) -> float:
    """The threshold between two clusters of the values (the least value if they are all equal)."""
    low, high = values.min(), values.max()
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        if not len(below):
            return float(values.min())
        if (new := (below.mean(), above.mean())) == (low, high):
            break
        low, high = new
    return float((low + high) / 2)


def main_text(html: str | None) -> str:
    """The content lines of a page, joined by newlines."""
    lines = read(html) if html else []
    if any(x.article for x in lines):
        lines = [x for x in lines if x.article]
    if not lines:
        return ""
    ratio = smooth(np.array([len(x.text) / (x.tags + 1) for x in lines]))
    threshold = two_means(ratio)
    low, high = ratio[ratio < threshold], ratio[ratio >= threshold]
    one_cluster = not len(low) or high.mean() < APART * low.mean()
    regions: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        regions.setdefault(x.region, []).append(i)
    sections: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        sections.setdefault(x.section, []).append(i)
    # by its characters' mean: a section's first line is smoothed with the one before it
    size = np.array([len(x.text) for x in lines])
    full = {s for s, own in sections.items() if one_cluster or any(lines[i].title for i in own) or np.average(ratio[own], weights=size[own]) >= threshold}
    kept = set()
    for region, own in regions.items():
        mostly_links = 2 * sum(lines[i].links for i in own) > sum(len(lines[i].text) for i in own)
        first = lines[own[0]]
        if not mostly_links and (first.section in full if first.article else ratio[own].max() >= threshold):
            kept.add(region)
    if not kept:
        kept = {r for r, own in regions.items() if ratio[own].max() >= threshold}
    return "\n".join(x.text for x in lines if x.region in kept)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all others by default) with text and n_chars (code points)."""
    keep = keep or [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(x).encode("utf-8", "replace").decode() for x in batch.column("__html").to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(run, schema)


def op4_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
