"""Main text of web pages: standard-library parser events, text-to-tag ratios, smoothing and a threshold.

The parser's events are folded into lines, one for each block of text, with the number of characters, tags and link
characters seen in it and the elements around it; neither a tree nor the page's markup is kept. Ratios of text to tags
are smoothed with a Gaussian; lines above one standard deviation are the content cluster. They vote, by characters, for
the element that holds the article, and select inside it: runs of lines that consist of links and lie outside the
cluster go, and so do lines inside menus, forms, notices, adverts, comments and the like.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template head title svg annotation annotation-xml iframe object canvas audio video select textarea button datalist map".split())
ASIDE = frozenset("nav aside footer form menu dialog header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_MARKS = re.compile(
    r"(?i)(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side|aside|footer|foot|masthead|topbar|header|ads?|advert\w*|banner|sponsor\w*|promo\w*|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|"
    r"reply|respond|widget|pagination|pager|copyright|legal|disclaimer|toolbar|search|paywall)(?:$|[\s_-]|\d)"
)
_TAG = re.compile(r"<[A-Za-z/!?]")
_HOME = re.compile(r"(?i)(?:^|[\s_-])(?:article|main|content|post|entry|story|body)(?:$|[\s_-])")
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_STOPS = frozenset("table td th div section article main aside nav form li blockquote body button object".split())
LIST_STOPS = frozenset("ul ol dl table select menu".split())
KEEP_P = frozenset("a abbr audio b bdi bdo br button canvas cite code data del dfn em embed font i iframe img input ins kbd label link map mark meta noscript object output picture q s samp script select small source span strong sub sup svg template textarea time u var video wbr".split())


class Lines(HTMLParser):
    """Folds events into lines: (text, tags, link characters, innermost element, container of its block, boilerplate).

    Elements are numbers; parent[k] is the one around k, so a line needs no path of its own and deep or unclosed markup
    costs one entry an element. The open elements of each tag are kept by place, so an end tag never searches the stack.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.stack: list[tuple[str, int, bool, bool, bool, bool]] = []  # tag, number, boiler, silent, in an article, in a link
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.open_blocks: list[int] = []
        self.homes: list[int] = []  # elements that name themselves as the article
        self.parent = [0]
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.where = (0, 0)
        self.boiler = False

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections such as <![if x]> or <![foo[bar]]> are comments up to the next >, as in browsers."""
        return self.parse_bogus_comment(i, 0)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.links, *self.where, self.boiler))
            self.parts = []
        self.tags = self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.tags += 1
            if tag == "hr":
                self.flush()
            elif tag == "br" and self.parts:
                self.parts.append(" ")
            return
        block = tag in BLOCK
        if block:
            self.flush()
            if tag not in KEEP_P:
                self.close_tags({"p"}, stop=P_STOPS)
            if tag in CLOSED_BY:
                self.close_tags(CLOSED_BY[tag], stop=LIST_STOPS)
        self.tags += 1
        silent = tag in SILENT
        top = self.stack[-1] if self.stack else ("", 0, False, False, False, False)
        inside = top[4] or tag in ("article", "main")
        boiler = tag in ASIDE and not (tag == "header" and inside)
        home = tag in ("article", "main")
        if attrs:
            a = {k: v or "" for k, v in attrs}
            names = f"{a.get('class', '')} {a.get('id', '')}"
            role = a.get("role", "").lower()
            if tag not in ("html", "body", "article", "main") and (role in ROLES or (len(names) > 1 and _MARKS.search(names) and not _HOME.search(names))):
                boiler = True
            if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
                silent = True
            if role == "main" or "articlebody" in a.get("itemprop", "").lower():
                home = True
        boiler |= top[2]
        silent |= top[3]
        self.parent.append(top[1])
        number = len(self.parent) - 1
        if home and not boiler:
            self.homes.append(number)
        self.open.setdefault(tag, []).append(len(self.stack))
        if block:
            self.open_blocks.append(len(self.stack))
        self.stack.append((tag, number, boiler, silent, inside, top[5] or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg"):
            self.handle_endtag(tag)

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, or -1."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def pop_to(self, place: int) -> None:
        for tag, *_ in self.stack[place:]:
            self.open[tag].pop()
        del self.stack[place:]
        while self.open_blocks and self.open_blocks[-1] >= place:
            self.open_blocks.pop()

    def close_tags(self, tags: set[str], stop: frozenset) -> None:
        place = self.last(tags)
        if place > self.last(stop):
            self.pop_to(place)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        place = self.last((tag,))
        if place >= 0 and (tag in BLOCK or not self.open_blocks or place > self.open_blocks[-1]):
            self.pop_to(place)

    def begin(self, top: tuple) -> None:
        block = self.stack[self.open_blocks[-1]][1] if self.open_blocks else 0
        self.where, self.boiler = (top[1], self.parent[block]), top[2]

    def handle_data(self, data: str) -> None:
        top = self.stack[-1] if self.stack else ("", 0, False, False, False, False)
        if top[3]:
            return
        if not self.parts:
            if data.isspace():
                return
            self.begin(top)
        elif top[2] != self.boiler:  # inline boilerplate inside a block, or text after it
            self.flush()
            self.begin(top)
        if top[5]:
            self.links += len(data)
        self.parts.append(data)


def smooth(ratios: list[float], radius: int = 2) -> list[float]:
    weights = [math.exp(-(d * d) / (2.0 * (radius / 2) ** 2)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(ratios)):
        total = sums = 0.0
        for d, w in zip(range(-radius, radius + 1), weights, strict=True):
            if 0 <= i + d < len(ratios):
                total += w * ratios[i + d]
                sums += w
        out.append(total / sums)
    return out


def regions(lines: list[tuple], content: list[bool]) -> list[bool]:
    """Which lines belong to content regions: runs of lines of one container that the ratios do not reject.

    A run is rejected if links make up more than half of it and most of its lines are outside the content cluster, so
    lists of links go wherever they stand, and short paragraphs and headings stay.
    """
    out: list[bool] = []
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end][4:] == lines[at][4:]:
            end += 1
        run = lines[at:end]
        linked = 2 * sum(min(x[2], len(x[0])) for x in run) > sum(len(x[0]) for x in run)
        out += [not (linked and 2 * sum(content[at:end]) < end - at)] * (end - at)
        at = end
    return out


def whole_markup(html: str) -> str:
    """The page without a comment or tag that its end cuts off: browsers drop them, the parser would scan them again and again."""
    comment = html.find("<!--", html.rfind("-->") + 1)
    if comment >= 0:
        html = html[:comment]
    ended = html.rfind(">") + 1
    open_tag = _TAG.search(html, ended)
    return html[: open_tag.start()] if open_tag else html


def main_text(html: str | None) -> str:
    """Blocks of the article joined by empty lines; empty if there are none."""
    if not html:
        return ""
    parser = Lines()
    try:
        parser.feed(whole_markup(html))
        parser.close()
    except AssertionError:  # the parser's own answer to declarations it can't read: what was read stays
        pass
    parser.flush()
    lines = parser.lines
    if all(x[5] for x in lines):
        return ""
    ratios = smooth([(len(t) - min(links, len(t))) / max(1, tags) for t, tags, links, *_ in lines])
    mean = sum(ratios) / len(ratios)
    cut = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    content = [r >= cut for r in ratios]
    weight = [len(x[0]) if c and not x[5] else 0 for x, c in zip(lines, content, strict=True)]
    if not any(weight):  # the cluster is boilerplate only: all other lines vote
        weight = [0 if x[5] else len(x[0]) for x in lines]
    total = sum(weight)
    votes, used = [0] * len(parser.parent), bytearray(len(parser.parent))
    for x, w in zip(lines, weight, strict=True):
        used[x[3]] = 1
        votes[x[3]] += w
    depth = [0] * len(votes)
    for e in range(1, len(votes)):
        depth[e] = depth[parser.parent[e]] + 1
    for e in range(len(votes) - 1, 0, -1):  # an element comes after the one around it
        votes[parser.parent[e]] += votes[e]
        used[parser.parent[e]] |= used[e]
    homes = [e for e in parser.homes if votes[e] * 2 >= total and used[e]]
    if homes:
        best = max(homes, key=lambda e: (depth[e], votes[e]))
    else:
        best = max((e for e in range(1, len(votes)) if votes[e] * 10 >= total * 8 and used[e]), key=lambda e: (depth[e], -e), default=0)
    stays = regions(lines, content) if best else content
    held = bytearray(len(votes))  # elements inside the best one
    held[best] = 1
    for e in range(best + 1, len(votes)):
        held[e] = held[parser.parent[e]]
    return "\n\n".join(x[0] for x, s in zip(lines, stays, strict=True) if s and not x[5] and held[x[3]])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    A null or empty page, and one without an article, has an empty text of 0 characters. Whole pages are parsed. Broken
    markup is read as far as browsers do: open paragraphs and list items end where the next begins. Repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty table.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
