"""Main text of web pages from streamed parser events and text-to-tag ratios.

The standard library's parser feeds events; each block of text between block-level tags is a line, with the tags that
occurred in and before it. Text-to-tag ratios per line are smoothed by a Gaussian, and a threshold at the smoothed ratios'
deviation clusters lines: a line over it, whose own ratio is over EDGE of it, is a core (if there is none, the lines of the largest ratio are). Regions are every article and main and,
outside of those, every element that holds lines itself, such as the div around paragraphs; lists, tables and quotations belong to the region around them where
that holds other lines too. An article or main with a core is content as a whole, as is each one around it: its heading may
be all that stands beside an inner article. Of any other region the cores are content, what stands between its first and its last, and beyond these the lines that
follow on, while their smoothed ratios stay over EDGE of the threshold. So a short paragraph between long ones isn't lost, and a row of links at a region's end is.
Structure can only veto: lines inside menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
count as ratio 0 and are never given, told by tag, role, or a class or id: a word of the list, or several of which one is in the list and the others only say where or what part.

Defined results: null and empty html give an empty text; broken markup is parsed as far as events go, and what the parser can't read as a
declaration is a comment up to the next ``>``; a comment that never ends goes to the page's end; pages of any length and any number of lines take time in proportion; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared
# Tags by the part that they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("nav footer aside form script style noscript template svg math iframe object button select textarea head title dialog menu canvas audio video".split())
#: Blocks whose lines belong to the element around them.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr address details summary".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
SKIPPED_WORDS = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup share sharing social comment comments disqus replies reply respond related recommended widget pagination pager toolbar".split())
#: Words that only say where or which part, beside one of the above in a class or id.
PLACE_WORDS = frozenset("area bar block body bottom box container content footer fixed global group header holder inner item items js left link links list main outer page panel post posts primary right row secondary section site slot sticky top unit user wrap wrapper".split())
#: Share of the threshold that a core has before smoothing, and down to which a region's lines go on beyond its cores.
EDGE = 0.5
#: An open p ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLANK = re.compile(r"\s+")
WORDS = re.compile(r"[a-z0-9]+")


def _names_skipped(name: str) -> bool:
    words = [w for w in WORDS.findall(name) if not w.isdigit()]
    return not SKIPPED_WORDS.isdisjoint(words) and all(w in SKIPPED_WORDS or w in PLACE_WORDS for w in words)


class Lines(HTMLParser):
    """Collects (text, tags, region, skipped) for each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, inside something skipped, region
        self.open: Counter = Counter()
        self.lines: list[tuple[str, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.regions: list[tuple[str, int]] = [("", 0)]  # tag, region around it
        self.at = (False, 0)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # such sections, like CDATA, mean nothing in HTML

    def parse_comment(self, i, report=True):
        end = self.rawdata.find("-->", i + 2)  # "<!-->" is a whole comment
        return len(self.rawdata) if end < 0 else end + 3

    def parse_starttag(self, i):
        return super().parse_starttag(i) if self.rawdata.rfind(">") > i else -1  # a tag that never ends is not searched again and again

    def end_line(self):
        text = BLANK.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.at[1], self.at[0]))
            self.tags = 0
        self.parts = []

    def _skips(self, tag: str, attrs) -> bool:
        if tag in SKIPPED:
            return True
        if tag == "header":
            return not (self.open["article"] or self.open["main"] or self.open["section"])
        if tag in ("html", "body", "article", "main"):
            return False
        for key, value in attrs:
            if key in ("class", "id") and value and any(_names_skipped(name) for name in value.lower().split()):
                return True
            if key == "role" and value and value.lower() in SKIPPED_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                return True
        return False

    def _pop(self, k: int):
        self.open.subtract(tag for tag, _, _ in self.stack[k:])
        del self.stack[k:]
        self.at = self.stack[-1][1:] if self.stack else (False, 0)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        ends = SAME_ENDS.get(tag) or ({"p"} if tag in ENDS_P else ())
        if any(self.open[x] for x in ends):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in ends:
                    self._pop(k)
                    break
                if self.stack[k][0] not in INLINE:
                    break
        skipped, region = self.at
        if tag not in INLINE and tag not in PARTS:
            self.regions.append((tag, region))
            region = len(self.regions) - 1
        self.at = (skipped or self._skips(tag, attrs), region)
        self.stack.append((tag, *self.at))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag not in ("svg", "path"):  # elsewhere the slash means nothing
            self.handle_starttag(tag, attrs)
        else:
            self.tags += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                break
            if tag in INLINE and self.stack[k][0] not in INLINE:
                break

    def handle_data(self, data):
        self.parts.append(data)


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing over neighbouring lines."""
    if sigma <= 0:
        return list(values)
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(values[i + k], w) for k, w in zip(range(-reach, reach + 1), kernel, strict=True) if 0 <= i + k < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def raw_ratios(lines: list[tuple[str, int, int, bool]]) -> list[float]:
    return [0.0 if skipped else len(text) / max(1, tags) for text, tags, _, skipped in lines]


def line_ratios(lines: list[tuple[str, int, int, bool]], sigma: float = 1.0) -> tuple[list[float], float]:
    """The smoothed ratio of each line, and the threshold: their deviation, or the largest where that is less."""
    ratios = smoothed(raw_ratios(lines), sigma)
    mean = sum(ratios) / len(ratios)
    return ratios, min(math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(ratios))


def chosen(lines: list[tuple[str, int, int, bool]], regions: list[tuple[str, int]], sigma: float = 1.0) -> list[int]:
    """Places of the content lines."""
    ratios, threshold = line_ratios(lines, sigma)
    whole = [tag in ("article", "main") for tag, _ in regions]
    holder = list(range(len(regions)))  # the article or main around a region, or else itself
    for r, (_, outer) in enumerate(regions):
        if not whole[r] and outer and whole[holder[outer]]:
            holder[r] = holder[outer]
    members: dict[int, list[int]] = {}
    for i, (_, _, region, skipped) in enumerate(lines):
        if not skipped:
            members.setdefault(holder[region], []).append(i)
    raw = raw_ratios(lines)
    core = {i for own in members.values() for i in own if ratios[i] >= threshold and raw[i] >= EDGE * threshold}
    if not core:
        best = max((raw[i] for own in members.values() for i in own), default=0.0)
        core = {i for own in members.values() for i in own if raw[i] == best}
    cores = {r: [k for k, i in enumerate(own) if i in core] for r, own in members.items()}
    kept = {r for r in members if cores[r]}
    for region in list(kept):
        outer = regions[region][1]
        while outer:
            if whole[outer]:
                kept.add(outer)
            outer = regions[outer][1]
    out = []
    for r in kept & members.keys():
        own = members[r]
        if whole[r]:
            out += own
            continue
        first, last = cores[r][0], cores[r][-1]
        while first and ratios[own[first - 1]] >= EDGE * threshold:
            first -= 1
        while last + 1 < len(own) and ratios[own[last + 1]] >= EDGE * threshold:
            last += 1
        out += own[first : last + 1]
    return sorted(out)


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Content lines of the page in page order, joined by blank lines."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    return "\n\n".join(parser.lines[i][0] for i in chosen(parser.lines, parser.regions, sigma))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with the columns text and n_chars in place of any of those names."""

    shared.bound_batches(pages.sparkSession)

    def run(htmls: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py()) for h in htmls], pa.string())

    out = pages.withColumn("text", F.arrow_udf(run, "string")(F.coalesce(F.col(html_col), F.lit(""))))
    return out.withColumn("n_chars", F.length("text").cast("long"))
