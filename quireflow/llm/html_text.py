"""Main text of web pages from flat text blocks and a decision tree.

A page's markup is read as a stream of tags and text; block-level tags end a block. A block's features are its words
and link density, those of the blocks before and behind it, what its open elements say (a heading, a part that HTML or
a whole class name gives as navigation, notice, advert and the like, a part that they give as the article and how much of
the page's plain text that holds). A classification tree grown on a small table of pages, labelled block
by block, decides which blocks are article text.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

# Element names of the HTML standard by what they do to text blocks.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "select", "button", "canvas", "audio", "video", "head", "datalist"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SPACED = {"br", "td", "th", "dt", "dd", "img"}
# Elements, and words in class, id and role, that name a part other than the article.
ASIDE = {"nav", "footer", "aside", "form", "menu", "header", "dialog", "search"}
ASIDE_WORDS = {
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disclaimer", "disqus", "dropdown", "feedback",
    "foot", "footer", "form", "gdpr", "header", "links", "login", "masthead", "menu", "menubar", "meta", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended",
    "related", "replies", "reply", "respond", "rail", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "adbox", "adslot", "adunit", "advertorial", "aside", "discussion", "lightbox", "reactions", "responses", "sidenav", "subnav", "topnav",
    "subscribe", "taboola", "tags", "toolbar", "topbar", "warning", "widget", "widgets",
}
ARTICLE_WORDS = {"article", "articlebody", "content", "entry", "main", "post", "story"}
# Words beside which one of the above still names the whole part.
FILLERS = {
    "area", "bar", "block", "body", "bottom", "box", "buttons", "column", "container", "footer", "global", "group", "inner", "item", "items", "left", "list",
    "page", "panel", "primary", "right", "row", "secondary", "section", "site", "slot", "top", "wrap", "wrapper",
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_behind", "link_density_behind", "part", "article", "article_elsewhere", "heading")
#: The labelled table: pages as their blocks in order. Of each block its words, its link density, what it is in or is
#: (p a part other than the article, a an article part, b another one, h a heading), and 1 for article text. The neighbours' features and
#: the article's share of the plain words follow from the order.
PAGES = (
    # news: menu, advert, article with a box for sharing and an advert inside, comments, footer
    ((1, 1.0, "p", 0), (1, 1.0, "p", 0), (12, 0.0, "p", 0), (9, 0.0, "ah", 1), (6, 0.0, "pa", 0), (55, 0.0, "a", 1), (70, 0.1, "a", 1), (3, 0.7, "pa", 0),
     (4, 0.0, "ah", 1), (2, 0.0, "a", 1), (3, 0.5, "a", 1), (38, 0.0, "a", 1), (25, 0.0, "pa", 0), (48, 0.0, "p", 0), (9, 0.2, "p", 0)),
    # a short piece of single lines, and one that is links in the main
    ((2, 1.0, "p", 0), (5, 0.0, "ah", 1), (3, 0.0, "a", 1), (7, 0.0, "a", 1), (1, 0.0, "a", 1), (4, 0.0, "p", 0)),
    ((2, 1.0, "p", 0), (6, 0.0, "ah", 1), (14, 0.0, "a", 1), (4, 1.0, "a", 1), (60, 0.05, "a", 1), (12, 0.9, "a", 1), (30, 0.0, "a", 1), (8, 0.3, "p", 0)),
    ((5, 0.0, "ah", 1), (3, 1.0, "a", 1), (30, 0.0, "a", 1), (2, 1.0, "a", 1), (12, 0.0, "a", 1), (4, 0.95, "a", 1), (48, 0.0, "a", 1), (6, 1.0, "a", 1), (9, 0.0, "a", 1),
     (80, 0.0, "a", 1), (1, 0.0, "a", 1), (15, 1.0, "a", 1), (2, 0.0, "a", 1), (33, 0.7, "a", 1), (8, 0.8, "a", 1), (25, 0.4, "a", 1), (1, 1.0, "a", 1), (20, 0.0, "a", 1), (2, 1.0, "", 0)),
    # a weblog without any marked part: menu, title, date, text, tags, other posts, imprint
    ((1, 1.0, "", 0), (2, 1.0, "", 0), (1, 1.0, "", 0), (7, 0.0, "h", 1), (3, 1.0, "", 0), (62, 0.0, "", 1), (40, 0.1, "", 1), (5, 0.0, "", 1), (35, 0.25, "", 1),
     (90, 0.0, "", 1), (4, 1.0, "", 0), (6, 1.0, "", 0), (5, 1.0, "", 0), (4, 1.0, "", 0), (7, 0.4, "", 0)),
    # documentation: a list of links beside it, headings, a list, short lines
    ((3, 1.0, "", 0), (2, 1.0, "", 0), (4, 0.9, "", 0), (3, 1.0, "", 0), (2, 1.0, "", 0), (2, 1.0, "", 0), (3, 0.0, "h", 1), (22, 0.0, "", 1), (6, 0.0, "h", 1),
     (18, 0.1, "", 1), (8, 0.0, "", 1), (9, 0.0, "", 1), (5, 0.0, "", 1), (45, 0.05, "", 1), (3, 0.0, "h", 1), (16, 0.4, "", 1), (30, 0.0, "", 1), (2, 1.0, "", 0), (2, 1.0, "", 0)),
    # a start page of links with headings over them
    ((1, 1.0, "", 0), (3, 1.0, "", 0), (4, 0.0, "h", 0), (6, 1.0, "", 0), (8, 1.0, "", 0), (3, 0.0, "h", 0), (7, 1.0, "", 0), (70, 0.8, "", 0), (30, 0.9, "", 0), (2, 1.0, "", 0)),
    # text alone, long and short, with a heading or without
    ((200, 0.0, "", 1),), ((8, 0.0, "", 1), (8, 0.0, "", 1), (8, 0.0, "", 1)), ((3, 0.0, "h", 1), (40, 0.0, "", 1), (6, 0.0, "", 1)), ((2, 0.0, "", 1), (4, 0.0, "", 1), (2, 0.0, "", 1)),
    ((11, 0.0, "", 1), (7, 0.0, "", 1), (6, 0.1, "", 1), (2, 0.0, "", 1)), ((1, 0.0, "h", 1), (8, 0.0, "", 1), (5, 0.0, "", 1)), ((4, 0.0, "h", 1), (14, 0.0, "", 1)),
    # a menu, one paragraph, a menu
    ((2, 1.0, "", 0), (1, 1.0, "", 0), (90, 0.0, "", 1), (2, 1.0, "", 0), (1, 1.0, "", 0)), ((4, 1.0, "", 0), (15, 0.0, "", 1), (1, 1.0, "", 0), (1, 1.0, "", 0)),
    # the article elements are teasers of other pages and the text stands outside of them
    ((2, 1.0, "p", 0), (9, 0.0, "h", 1), (80, 0.0, "", 1), (60, 0.1, "", 1), (12, 0.0, "", 1), (95, 0.0, "", 1), (5, 1.0, "ah", 0), (18, 0.0, "a", 0), (4, 1.0, "ah", 0), (30, 0.0, "a", 0), (9, 0.0, "p", 0)),
    ((22, 0.0, "a", 0), (6, 0.0, "ah", 0), (7, 0.0, "h", 1), (110, 0.0, "", 1), (45, 0.0, "", 1), (50, 0.0, "", 1), (3, 0.0, "", 1), (70, 0.0, "", 1)),
    ((2, 1.0, "p", 0), (8, 0.0, "ah", 1), (70, 0.0, "a", 1), (90, 0.1, "a", 1), (55, 0.0, "a", 1), (5, 1.0, "bh", 0), (16, 0.0, "b", 0), (25, 0.2, "b", 0), (9, 0.0, "p", 0)),
    ((8, 0.0, "h", 1), (150, 0.0, "", 1), (90, 0.0, "", 1), (160, 0.05, "", 1), (2, 1.0, "ah", 0), (12, 0.0, "a", 0), (3, 1.0, "bh", 0), (9, 0.0, "b", 0), (1, 1.0, "b", 0)),
    ((7, 0.0, "ah", 1), (140, 0.0, "a", 1), (100, 0.0, "a", 1), (85, 0.0, "a", 1), (4, 0.0, "bh", 0), (10, 0.0, "b", 0), (2, 1.0, "", 0)),
    ((6, 0.0, "h", 1), (20, 0.0, "", 1), (30, 0.0, "", 1), (3, 0.0, "ah", 0), (4, 0.0, "a", 0), (2, 0.0, "", 0), (1, 1.0, "p", 0)),
    # lines of prose around the article: an unmarked advert, an unmarked note at the end
    ((14, 0.0, "", 0), (2, 1.0, "", 0), (8, 0.0, "ah", 1), (60, 0.0, "a", 1), (75, 0.0, "a", 1), (40, 0.0, "a", 1), (90, 0.1, "a", 1), (30, 0.0, "", 0), (25, 0.0, "p", 0)),
    ((6, 0.0, "h", 0), (50, 0.0, "", 0), (7, 0.0, "ah", 1), (120, 0.0, "a", 1), (85, 0.0, "a", 1), (3, 0.0, "h", 0), (10, 0.0, "", 0), (60, 1.0, "", 0)),
    # parts that are named, as long as the text; a page with nothing else
    ((5, 0.0, "h", 1), (50, 0.0, "", 1), (80, 0.0, "p", 0), (60, 0.0, "", 1), (3, 0.0, "ph", 0), (120, 0.0, "p", 0), (90, 0.0, "p", 0)), ((30, 0.0, "p", 0), (2, 1.0, "p", 0)),
    # text interrupted by a line of links, and links that are part of the text
    ((40, 0.0, "", 1), (5, 1.0, "", 0), (30, 0.0, "", 1), (2, 0.9, "", 0), (25, 0.6, "", 1), (60, 0.0, "", 1), (1, 1.0, "", 0), (8, 0.0, "", 1)),
)


def with_neighbours(found: list[tuple]) -> np.ndarray:
    """FEATURES of a page's blocks, given as words, link density, part, number of the article part (0 for none) and heading.

    Neighbours are sought past blocks of other parts. For a block in an article part, article has the plain words of that
    part over those of the largest, or over all that is outside of them where that is more. For a block outside,
    article_elsewhere has the plain words of all article parts over the page's.
    """
    x = np.zeros((len(found), len(FEATURES)))
    own = np.array([b[:2] for b in found], float)
    x[:, 0:2] = own
    article = np.array([b[3] for b in found], np.int64)
    x[:, 6], x[:, 9] = np.array([(b[2], b[4]) for b in found], float).T
    open_ = x[:, 6] == 0
    near = np.flatnonzero(open_)
    before, behind = np.searchsorted(near, np.arange(len(found))) - 1, np.searchsorted(near, np.arange(len(found)), "right")
    x[before >= 0, 2:4] = own[near[before[before >= 0]]]
    x[behind < len(near), 4:6] = own[near[behind[behind < len(near)]]]
    plain = own[:, 0] * (1 - own[:, 1]) * open_
    held = np.bincount(article, weights=plain, minlength=2)
    held[0] = 0
    largest = max(1.0, held.max(), plain.sum() - held.sum())
    x[:, 7] = held[article] / largest
    x[:, 8] = np.where(article > 0, 0.0, held.sum() / max(1.0, plain.sum()))
    return x


def labelled_table(pages=PAGES) -> np.ndarray:
    """A row a block: FEATURES, and 1 for article text."""
    tables = [with_neighbours([(w, d, "p" in marks, 1 if "a" in marks else 2 * ("b" in marks), "h" in marks) for w, d, marks, _ in page]) for page in pages]
    return np.hstack([np.vstack(tables), [[float(b[3])] for page in pages for b in page]])


class Tree:
    """A binary classification tree: Gini impurity, splits halfway between values, grown until pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9):
        self.share = float(y.mean())
        self.feature = None
        best = self._split(x, y) if depth and 0 < self.share < 1 else None
        if best:
            self.feature, self.cut = best
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    @staticmethod
    def _split(x, y):
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                impurity = sum(part.size * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, cut
        return best and best[1:]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.share >= 0.5)
        out = np.empty(len(x), bool)
        low = x[:, self.feature] <= self.cut
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def grown_tree(pages=PAGES) -> Tree:
    rows = labelled_table(pages)
    return Tree(rows[:, :-1], rows[:, -1])


def _attributes(text: str) -> tuple[bool, bool, bool, bool]:
    """Whether a class, id or role names a part other than the article, whether it is a header, whether one names the
    article, and whether the element is hidden.

    A name counts as a whole: each of its words is one of the listed or a filler, as in related-items, while has-sidebar
    and search-rescue name nothing. An element that is called by an article word alone, as in class="post promo", is no
    other part.
    """
    asides, own, named, hidden = set(), False, False, False
    if "=" in text or "hidden" in text:
        for name, a, b, c in _ATTRIBUTE.findall(text):
            value = a or b or c
            if (name := name.lower()) in ("class", "id", "role", "itemprop"):
                for one in value.split():
                    words = {w.lower() for w in _NAME.findall(one)}
                    if words & ASIDE_WORDS and not words - ASIDE_WORDS - FILLERS - ARTICLE_WORDS:
                        asides |= words & ASIDE_WORDS
                    elif words & ARTICLE_WORDS and not words - ARTICLE_WORDS - FILLERS:
                        named = True
                    own |= one.lower() in ARTICLE_WORDS
            elif name == "style":
                hidden |= bool(_HIDDEN.search(value))
            else:
                hidden |= value.lower() != "false"
    if own:
        asides = set()
    return bool(asides - {"header"}), "header" in asides, named, hidden


def blocks(page: str) -> list[tuple]:
    """(text, words, link density, part, number of the article part, heading) of each text block of a page, in order."""
    found: list[tuple] = []
    text: list[str] = []
    linked: list[str] = []
    #: name, part, article, hidden, whether it is a part as a header only, whether it may turn out to be around the article, and whether as a form only
    stack: list[tuple] = []
    in_link = n_parts = 0
    read: set = set()  # of article and main, those that have given text

    def flush():
        words = html.unescape("".join(text)).split()
        if words:
            n_linked = len(html.unescape(" ".join(linked)).split())
            names = {s[0] for s in stack}
            heading = bool(names & HEADINGS)
            inner = max((k for k, s in enumerate(stack) if s[0] in ("article", "main")), default=0)
            own = max((k for k, s in enumerate(stack) if s[2]), default=0)  # a form may be wrapped around the whole page
            parts = [s for k, s in enumerate(stack) if s[1] and not (s[5] and k < inner or s[6] and k < own)]
            aside, article = bool(parts), next((s[2] for s in stack if s[2]), 0)
            if heading and article and aside:  # the article's own header has its title
                aside = any(not s[4] for s in parts)
            if not aside:
                read.update(names & {"article", "main"})
            if not any(s[3] for s in stack):
                found.append((" ".join(words), len(words), min(1.0, n_linked / len(words)), aside, article, heading))
        text.clear()
        linked.clear()

    def close(name):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                return

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            text.append(chunk)
            if in_link:
                linked.append(chunk)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in BLOCK:
                flush()
                close(name)
            elif name in SPACED:
                text.append(" ")
            continue
        closed = m[3].endswith("/")
        if name in RAW and not closed:
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else (at if name == "head" else end)
            continue
        if name == "a":
            in_link = 0 if closed else 1
        if name in SPACED:
            text.append(" ")
        if name not in BLOCK:
            continue
        flush()
        in_link = 0
        if any(s[0] == "p" for s in stack[-3:]):  # a block ends an open paragraph, a heading ends a heading
            close("p")
        if name == "li" and stack and stack[-1][0] == "li" or name in HEADINGS and stack and stack[-1][0] in HEADINGS:
            stack.pop()
        if name in VOID or closed:
            continue
        named, head, article, hidden = _attributes(m[3])
        head |= name == "header"
        whole = name in ("html", "body", "main", "article")
        aside = (named or head or name in ASIDE) and not whole
        # behind an article or a whole main part, what an aside word names are other pages' articles
        around = name not in ASIDE and "article" not in read and ("main" not in read or any(s[0] == "main" for s in stack))
        n_parts += 1
        stack.append((name, aside, n_parts if name in ("article", "main") or article else 0, hidden, aside and head and not named, around, name == "form" and not named))
    flush()
    return found


def main_text(page: str | None, tree: Tree) -> tuple[str, int, int]:
    """The article's blocks joined by two newlines, the number of blocks and of those kept."""
    found = blocks(page or "")
    if not found:
        return "", 0, 0
    kept = [b[0] for b, good in zip(found, tree.predict(with_neighbours([b[1:] for b in found])), strict=True) if good]
    return "\n\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, *, html_col: str = "html", labelled=PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept for every row of pages.

    A null or empty page has an empty text. Only page_id, url and the html are read, so other columns do not clash;
    repeated rows stay. A very long page is read whole, in one pass, as one row of a batch of bounded size.
    """
    tree = grown_tree(labelled)

    def read(parts):
        for pdf in parts:
            out = [main_text(h, tree) for h in pdf.pop("html")]
            pdf["text"], pdf["n_blocks"], pdf["n_kept"] = zip(*out, strict=True) if out else ((), (), ())
            pdf["n_chars"] = [len(t) for t in pdf["text"]]
            yield pdf[["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"]].astype({"page_id": "Int64"})

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return in_batches(narrow).mapInPandas(read, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
