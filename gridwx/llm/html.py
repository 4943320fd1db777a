"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's tags and text. A line is the text between two block borders, since pages
often stand on one physical line; its ratio is its characters outside links over its tags. Lines in parts that name
themselves as no article (navigation, footers, forms, adverts, comments, by tag, role, class or id) have ratio 0. The
ratios are smoothed with a Gaussian over their neighbours, and lines at or over the standard deviation of the smoothed
ratios form the content cluster. The cluster selects the region: the article elements of the page, or else the smallest
element that holds nearly all of the cluster, from its first to its last line. Everything in the region is kept but the
parts named above, however short a line is.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Standard deviation, in lines, of the Gaussian, and how many of them it reaches.
SIGMA, REACH = 1.0, 3
#: Part of a page's cluster that an element must hold for the search to go into it.
MOST = 0.9
#: An article element with less than the first part of the cluster is passed over if the rest has more characters than the second.
SLIGHT, AMPLE = 0.05, 500
#: Rows of pages parsed at a time.
BATCH = 64

# Elements of HTML by their role in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: Never article text.
NO_TEXT = frozenset("applet audio button canvas datalist embed frameset head iframe map noframes noscript object script select style svg template textarea title video".split())
#: No article text unless the page's main part is inside.
ASIDE = frozenset("aside dialog footer form header menu nav".split())
LEAF = frozenset("address blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre table tbody td tfoot th thead tr ul".split())
BLOCKS = frozenset("article aside body center details div dialog fieldset footer form frameset header hr html legend main menu nav optgroup option search section summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in a class or id that name a part which is no article text.
NOTICES = frozenset(
    """ad ads adbox adcontainer adsbygoogle adsense adslot adunit adv advert adverts advertisement advertisements advertising sponsor sponsored
    sponsors promo promos promotion promotions banner banners nav navbar navigation navlinks navmenu menu menubar menus submenu breadcrumb
    breadcrumbs sidebar sidebars sidenav aside rail header masthead topbar footer footnav colophon bottombar cookie cookies cookiebar consent
    gdpr notice notices notification notifications alert alerts disclaimer copyright popup popups popover modal overlay lightbox newsletter
    subscribe subscription signup signin login paywall share sharebar sharing social related recommended recommendations trending outbrain
    taboola comment comments commentlist respond replies reply disqus guestbook search searchbox searchform form widget widgets pagination
    pager toolbar""".split()
)
#: On an article element itself, a heading and inline elements only these count.
ON_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended".split())
#: A class that begins so tells what a page has, not what the element is.
ABOUT = frozenset("has with no without is not hide show".split())
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

#: By start tag: the open tags it ends, and those that keep it from looking further out.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "article", "section"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "article", "section"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "article", "section"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPE = ("table", "td", "th", "caption", "object", "template")


def _named(names: str, found: frozenset[str]) -> bool:
    for name in names.split():
        parts = [p.lower() for p in _NAME_PARTS.findall(name)]
        if parts and parts[0] not in ABOUT and not found.isdisjoint(parts):
            return True
    return False


class Page(HTMLParser):
    """The elements of a page that hold lines, and its lines in order.

    Element 0 is the page itself; an element's parent has a smaller number. Per element: tag, parent, and why it may be no
    article text: 0 not at all, 1 its class, id or role, 2 its tag, 3 always.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.reasons = ["html"], [-1], [0]
        #: Lines: text, element, tags since the line before, characters in links.
        self.texts: list[str] = []
        self.owners: list[int] = []
        self.tag_counts: list[int] = []
        self.link_chars: list[int] = []
        self._stack = [("html", 0)]
        self._open: dict[str, list[int]] = defaultdict(list)
        self._parts: list[str] = []
        self._seen, self._linked, self._links, self._mute = 0, 0, 0, 0

    def read(self, html: str) -> Page:
        """All events of a page. A tag or comment that does not end is dropped with what follows, as browsers do; so is a
        page's last character if it begins a tag."""
        self.feed(html)
        if not re.match(r"<([a-zA-Z/!?]|$)", self.rawdata) or self.cdata_elem:
            self.close()
        self._flush()
        return self

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections are comments in pages, whatever their keyword."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self._seen += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._seen += 1
        if tag in ("html", "body"):
            self._leave_head()
            return
        if tag == "br":
            self._parts.append(" ")
            return
        if tag not in HEAD_ONLY:
            self._leave_head()
        reason = self._reason(tag, attrs)
        if tag not in LEAF and tag not in BLOCKS and tag not in NO_TEXT:
            # an inline or unknown element
            if tag == "a":
                self._links = 1
            if reason and tag not in VOID:
                self._push(tag, 3)
            return
        if tag in ("td", "th"):
            self._parts.append(" ")
        elif tag not in NO_TEXT:
            self._flush()
        top = len(self._stack) - 1
        while self._stack[top][0] in INLINE:
            top -= 1
        if self._stack[top][0] == "p" and tag not in NO_TEXT:
            self._pop(top)
        if tag in _ENDS:
            ended, borders = _ENDS[tag]
            at = max(self._at(t) for t in ended)
            if at > max(self._at(t) for t in borders):
                self._pop(min(p for p in (self._at(t) for t in ended) if p > max(self._at(t) for t in borders)))
        if tag in VOID:
            return
        if tag in ("td", "th") and not reason:
            # cells of a row make one line: they only count for end tags
            self._stack.append((tag, self._stack[-1][1]))
            self._open[tag].append(len(self._stack) - 1)
        else:
            self._push(tag, reason)

    def handle_endtag(self, tag: str) -> None:
        self._seen += 1
        if tag == "a":
            self._links = 0
        if tag == "head":
            self._leave_head()
            return
        if tag in LEAF or tag in BLOCKS:
            if tag in ("td", "th"):
                self._parts.append(" ")
            else:
                self._flush()
        at = self._at(tag)
        if at <= 0:
            return
        if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
            border = self._at("table")
        elif tag == "table":
            border = self._at("template")
        else:
            border = max(self._at(t) for t in _SCOPE if t != tag)
        if tag == "p":
            border = max(border, len(self._stack) - 2 - (self._stack[-1][0] in INLINE))
        if at > border:
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if self._mute:
            return
        if self._stack[-1][0] == "head":
            if data.isspace():
                return
            self._leave_head()
            if self._mute:
                return
        self._parts.append(data)
        if self._links:
            self._linked += len(data)

    def _reason(self, tag: str, attrs: list) -> int:
        if tag in NO_TEXT:
            return 3
        for key, value in attrs:
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and _UNSEEN.search(value)):
                return 3
        names = ON_ARTICLES if tag == "article" or tag in HEADINGS or tag in INLINE else NOTICES
        for key, value in attrs:
            if value and (key in ("class", "id") and _named(value, names) or key == "role" and value.lower() in ROLES):
                return 0 if tag == "main" else 1
        return 2 if tag in ASIDE else 0

    def _at(self, tag: str) -> int:
        places = self._open.get(tag)
        return places[-1] if places else -1

    def _push(self, tag: str, reason: int) -> None:
        self.tags.append(tag)
        self.parents.append(self._stack[-1][1])
        self.reasons.append(reason)
        self._stack.append((tag, len(self.tags) - 1))
        self._open[tag].append(len(self._stack) - 1)
        self._mute += reason == 3

    def _pop(self, at: int) -> None:
        """End the open elements from this place on."""
        while len(self._stack) > at:
            tag, element = self._stack.pop()
            self._open[tag].pop()
            if self.reasons[element] == 3 and self.tags[element] == tag:
                self._mute -= 1

    def _leave_head(self) -> None:
        at = self._at("head")
        if at > 0:
            self._pop(at)

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.texts.append(text)
            self.owners.append(self._stack[-1][1])
            self.tag_counts.append(self._seen)
            self.link_chars.append(self._linked)
            self._seen = 0
        self._parts.clear()
        self._linked = 0


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means over neighbours; at the ends the weights that exist add up to one."""
    reach = int(REACH * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def _left_out(page: Page) -> np.ndarray:
    """Which elements are no article text."""
    n = len(page.tags)
    holds = {t: [False] * n for t in ("main", "article", "h1")}
    for e in range(n - 1, 0, -1):
        for tag, held in holds.items():
            if held[e] or page.tags[e] == tag:
                held[page.parents[e]] = True
    out, within = np.zeros(n, bool), [False] * n

    def fill(strict: bool) -> None:
        for e in range(1, n):
            tag, parent, reason = page.tags[e], page.parents[e], page.reasons[e]
            within[e] = within[parent] or tag in ("article", "main")
            if tag == "header" and reason == 2:
                own = not within[parent]
            elif reason == 2:
                own = not (holds["main"][e] or (tag == "form" and (holds["article"][e] or holds["h1"][e])))
            else:
                own = reason == 3 or (reason == 1 and not (holds["main"][e] or holds["h1"][e] or (not strict and holds["article"][e])))
            out[e] = out[parent] or own

    fill(strict=True)
    if "article" in page.tags and all(out[e] for e in range(n) if page.tags[e] == "article"):
        fill(strict=False)
    return out


def main_lines(page: Page) -> list[str]:
    """The lines of the page's main text."""
    if not page.texts:
        return []
    left_out = _left_out(page)
    owners = np.array(page.owners)
    chars = np.array([len(t) for t in page.texts], float)
    plain = np.maximum(chars - np.array(page.link_chars), 0)
    kept = ~left_out[owners]
    ratios = np.where(kept, plain / np.maximum(page.tag_counts, 1), 0.0)
    smooth = smoothed(ratios)
    cluster = kept & (smooth >= smooth.std())
    if not kept.any():
        return []
    if not cluster.any():
        cluster = kept
    mass = np.zeros(len(page.tags))
    np.add.at(mass, owners[cluster], chars[cluster])
    held = mass.copy()
    filled = np.zeros(len(page.tags), bool)
    filled[owners[kept]] = True
    for e in range(len(page.tags) - 1, 0, -1):
        held[page.parents[e]] += held[e]
        filled[page.parents[e]] |= filled[e]
    explicit = [e for e, tag in enumerate(page.tags) if tag in ("main", "article") and filled[e] and not left_out[e]]
    chosen = _articles(page, explicit, held)
    if chosen and (held[chosen].sum() >= SLIGHT * held[0] or held[0] - held[chosen].sum() <= AMPLE):
        inside = _inside(page, chosen)[owners] & kept
        if not any(page.tags[o] == "h1" for o in owners[inside]):
            before = [i for i in range(np.argmax(inside)) if kept[i] and page.tags[owners[i]] == "h1"]
            inside[before[-1:]] = True
        return [page.texts[i] for i in np.flatnonzero(inside)]
    return [page.texts[i] for i in _by_cluster(page, owners, kept, cluster, plain / chars, held)]


def _articles(page: Page, explicit: list[int], held: np.ndarray) -> list[int]:
    """The outermost article elements; a main element in place of those in it where they hold less than half of it."""
    marked = set(explicit)
    #: By element: the outermost and the innermost marked element around it, or -1.
    outer, inner = [-1] * len(page.tags), [-1] * len(page.tags)
    articles = defaultdict(list)
    for e in range(1, len(page.tags)):
        above = page.parents[e]
        inner[e] = above if above in marked else inner[above]
        outer[e] = outer[above] if outer[above] >= 0 else above if above in marked else -1
        if e in marked and page.tags[e] == "article" and inner[e] == outer[e] >= 0:
            articles[outer[e]].append(e)
    chosen = []
    for e in explicit:
        if outer[e] < 0:
            within = articles[e] if page.tags[e] == "main" else []
            chosen += within if 2 * held[within].sum() >= held[e] > 0 else [e]
    return chosen


def _inside(page: Page, roots: list[int]) -> np.ndarray:
    inside = np.zeros(len(page.tags), bool)
    inside[roots] = True
    for e in range(1, len(page.tags)):
        inside[e] |= page.parents[e] >= 0 and inside[page.parents[e]]
    return inside


def _by_cluster(page: Page, owners: np.ndarray, kept: np.ndarray, cluster: np.ndarray, plain: np.ndarray, held: np.ndarray) -> list[int]:
    """Lines of the smallest element that holds nearly all of the cluster, from the cluster's first to its last line."""
    children = defaultdict(list)
    for e in range(1, len(page.tags)):
        if page.tags[e] not in LEAF:
            children[page.parents[e]].append(e)
    root = 0
    while into := [c for c in children[root] if held[c] >= MOST * held[0] > 0]:
        root = into[0]
    inside = _inside(page, [root])[owners] & kept
    # the part of the region that a line belongs to: a child element of its root, or the root itself for flowing text
    part = np.arange(len(page.tags))
    for e in range(root + 1, len(page.tags)):
        above = page.parents[e]
        part[e] = root if above == root and page.tags[e] in LEAF else e if above == root else part[above]
    part_of = part[owners]
    with_cluster = set(part_of[cluster & inside].tolist())
    at = np.flatnonzero(inside & cluster)
    if not len(at):
        return np.flatnonzero(inside).tolist()
    first, last = at[0], at[-1]

    def flowing(i: int) -> bool:
        return bool(inside[i]) and part_of[i] == root and plain[i] > 0.5

    while first > 0 and flowing(first - 1):
        first -= 1
    while last + 1 < len(owners) and flowing(last + 1):
        last += 1
    return [i for i in range(first, last + 1) if inside[i] and (part_of[i] == root or part_of[i] in with_cluster or plain[i] > 0.5)]


def main_text(html: str | None) -> str:
    """Main text of one page: a line per block, white space as one space; empty if the page is null or has none."""
    return "\n".join(main_lines(Page().read(html))) if html else ""


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The columns of pages but html, and `text` (never null) and `n_chars` (long), its code points.

    A row per row of pages, whatever the other columns hold; a null or empty page, and one without article text, has the
    empty text. Columns of pages that are named like the two new ones are replaced by them. One page at a time is in
    memory beside its batch.
    """
    kept = [c for c in pages.columns if c not in (html, text, "n_chars")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [main_text(h.as_buffer().to_pybytes().decode("utf-8", "replace") if h.is_valid else None) for h in part.column(part.num_columns - 1)]
                columns = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, text, "n_chars"])

    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").cast("binary").alias(html))
    schema = rows.drop(html).schema.add(text, "string", False).add("n_chars", "long", False)
    return rows.mapInArrow(parse, schema)
