"""HTML extraction: flat text blocks classified by a decision tree.

A page is read once as a flat list of text blocks. Each block has its number of
words and its link density, those of the blocks before and after it, and the
zone in which it stands: inside an article, inside something whose element,
role or class name (every part of it) says navigation, header, footer, sidebar,
notice, advert or form, or any part of it comments, inside something of which a part of a class name hints
at that, or none of these. A decision tree, grown on the small labelled table
below, keeps or drops each block: hints and unmarked parts are decided by words
and link density, as are lists of links within articles.

Pages are worked on one by one in Arrow batches; nothing is shuffled. Reading
is linear in the page: no pattern goes back, and what follows a tag that never
ends is read as text once.

Cases. Null or empty html, or a page without kept blocks: empty text. Unclosed
and stray tags are tolerated, as are unclosed comments, scripts and styles
(they run to the end of the page). Quotes count only after an equals sign.
Character references are decoded within a text node: one that markup cuts in
two stays as it is. Very long pages are read whole. Repeated rows each give a
row; null ids are passed on. Only the named columns are read, so further columns
never clash; a column of ``keep`` must not be called ``text`` or ``n_chars``.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""", re.S)
_OPEN = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is no text of the page.
SKIP = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "select", "title", "head"}
_ENDS = {x: re.compile(rf"</{x}\b[^>]*+(?:>|\Z)", re.I) for x in SKIP}
#: Elements that end a block and begin one.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PLAIN, ARTICLE, HINT, OTHER, COMMENTS = 0, 1, 2, 3, 4
_ZONES = {"article": ARTICLE, "main": ARTICLE} | dict.fromkeys("nav header footer aside form menu dialog button fieldset".split(), OTHER)
_ROLES = {"main": ARTICLE, "article": ARTICLE} | dict.fromkeys("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split(), OTHER)
_OTHER_WORDS = set("ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs cookie cookies consent dialog disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay paywall popup promo promotion promoted recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split())
_COMMENT_WORDS = set("comment comments commentlist disqus discussion replies reply respond responses".split())


def _zone(tag: str, attrs: str) -> int:
    """What an element says about its content."""
    hint = PLAIN
    if attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            value, name = value.strip("\"'").lower(), name.lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return COMMENTS
            if name == "role" and value in _ROLES and tag != "article":
                return _ROLES[value]
            if name == "itemprop" and value == "articlebody":
                return ARTICLE
            if name in ("class", "id") and tag not in ("html", "body"):
                if set(re.split(r"[^a-z]+", value)) & _COMMENT_WORDS:
                    return COMMENTS
                if tag not in ("article", "main"):
                    if any(set(re.findall(r"[a-z]+", x)) <= _OTHER_WORDS for x in value.split() if re.search("[a-z]", x)):
                        return OTHER  # every part of a name says so
                    if set(re.split(r"[^a-z]+", value)) & _OTHER_WORDS:
                        hint = HINT
    return _ZONES.get(tag, hint)


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, zone, words, words in links) of the page's text blocks."""
    out: list[tuple[str, int, int, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone before each
    opened: Counter = Counter()
    zone, at, links, skip = PLAIN, 0, 0, ""

    def end():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            n = len(text.split())
            out.append((text, zone, n, min(n, len(" ".join(linked).split()))))
        parts.clear()
        linked.clear()

    n = len(page)
    while at < n:
        if skip:
            m = _ENDS[skip].search(page, at)
            at, skip = (m.end() if m else n), ""
            continue
        m = _OPEN.search(page, at)
        begin = m.start() if m else n
        if m and not (m := _TAG.match(page, begin)):
            begin = n  # a tag that never ends: no markup can follow
        text = entities.unescape(page[at:begin])
        if text:
            parts.append(text)
            if links:
                linked.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in BLOCKS:
            end()
            links = links if tag == "br" else 0
        if closing:
            if tag in ("head", "title"):
                continue
            if opened[tag]:
                end()
                while True:
                    name, zone = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
            continue
        if tag in SKIP and not m[3].endswith("/"):
            if tag == "head":
                continue  # its own text elements are skipped one by one
            skip = tag
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        says = _zone(tag, m[3])
        if says != PLAIN or tag in ("div", "section", "ul", "ol", "li", "table", "span"):
            if says != PLAIN and says != zone:
                end()
            stack.append((tag, zone))
            opened[tag] += 1
            # comments stay comments, and a hint is no more than that; otherwise the nearest element decides
            if says != PLAIN and zone != COMMENTS and not (says == HINT and zone == OTHER):
                zone = says
    end()
    return out


def features(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Zone, words and link density of each block, and words and density of the blocks before and after."""
    w = np.array([b[2] for b in found], float)
    d = np.array([b[3] for b in found], float) / np.maximum(w, 1)
    z = np.minimum([b[1] for b in found], OTHER).astype(float)
    pad = lambda x, s: np.append(0, x)[:-1] if s < 0 else np.append(x, 0)[1:]
    return np.column_stack([z, w, d, pad(w, -1), pad(d, -1), pad(w, 1), pad(d, 1)])


# The labelled table: zone, words, link density, words and density before, after; 1 keeps.
LABELLED = np.array([
    (1, 8, 0, 0, 0, 60, 0, 1), (1, 60, 0, 8, 0, 45, 0.02, 1), (1, 45, 0.02, 60, 0, 2, 0, 1), (1, 2, 0, 45, 0, 80, 0, 1),
    (1, 80, 0.1, 2, 0, 30, 0, 1), (1, 1, 0, 0, 0, 1, 0, 1), (1, 1, 0, 1, 0, 0, 0, 1), (1, 3, 0, 6, 1, 5, 0, 1), (1, 200, 0, 4, 0, 0, 0, 1),
    (1, 12, 0.5, 40, 0, 40, 0, 1), (1, 4, 1, 50, 0, 60, 0, 1), (1, 6, 1, 0, 0, 70, 0, 1), (1, 2, 1, 30, 0.1, 0, 0, 1), (1, 25, 0.3, 1, 1, 90, 0, 1),
    (1, 1, 1, 2, 1, 1, 1, 0), (1, 2, 1, 1, 1, 2, 1, 0), (1, 3, 1, 2, 1, 3, 1, 0), (1, 1, 1, 3, 1, 1, 1, 0),
    (1, 50, 0, 40, 0, 2, 1, 1), (1, 5, 0, 30, 0, 4, 1, 1), (1, 90, 0, 0, 0, 1, 1, 1), (1, 1, 0, 1, 1, 1, 1, 1), (1, 7, 0, 3, 1, 2, 1, 1), (1, 2, 0, 2, 1, 3, 1, 1),
    (1, 3, 0.3, 1, 1, 2, 1, 1), (1, 1, 1, 40, 0, 60, 0, 1), (1, 30, 0.6, 20, 0.7, 40, 0.6, 1), (1, 9, 1, 30, 0, 12, 0, 1),
    (3, 1, 1, 0, 0, 1, 1, 0), (3, 1, 1, 1, 1, 1, 1, 0), (3, 12, 0, 5, 1, 60, 0, 0), (3, 40, 0, 90, 0, 0, 0, 0), (3, 6, 0, 80, 0, 0, 0, 0),
    (3, 120, 0, 60, 0, 20, 0, 0), (3, 15, 0, 1, 1, 8, 0, 0), (3, 9, 0.4, 50, 0, 3, 1, 0), (3, 300, 0, 0, 0, 0, 0, 0), (3, 2, 0, 30, 0, 30, 0, 0),
    (0, 70, 0, 10, 0, 80, 0, 1), (0, 40, 0.05, 70, 0, 50, 0, 1), (0, 25, 0, 40, 0.05, 3, 0, 1), (0, 30, 0.1, 4, 0, 25, 0, 1), (0, 150, 0, 1, 1, 0, 0, 1),
    (0, 6, 0, 70, 0, 90, 0, 1), (0, 4, 0, 40, 0, 35, 0, 1), (0, 9, 0, 2, 1, 60, 0, 1), (0, 22, 0.2, 30, 0, 30, 0, 1),
    (0, 60, 0, 60, 0, 1, 1, 1), (0, 45, 0, 30, 0, 3, 1, 1), (0, 30, 0.1, 2, 1, 2, 1, 1), (0, 80, 0.2, 1, 1, 1, 1, 1),
    (0, 3, 1, 2, 1, 4, 1, 0), (0, 2, 1, 0, 0, 2, 1, 0), (0, 5, 0.8, 2, 1, 30, 0, 0), (0, 4, 0, 3, 1, 2, 1, 0), (0, 7, 0, 3, 0, 0, 0, 0),
    (0, 1, 1, 60, 0, 0, 0, 0), (0, 1, 1, 0, 0, 60, 0, 0), (0, 14, 0.9, 20, 0, 12, 0.9, 0), (0, 40, 0.9, 30, 0.9, 20, 0.8, 0), (0, 3, 0, 0, 0, 2, 1, 0), (0, 8, 0.6, 60, 0, 3, 1, 0), (0, 2, 0, 5, 1, 0, 0, 0),
    (2, 60, 0, 60, 0, 60, 0, 1), (2, 60, 0, 0, 0, 60, 0, 1), (2, 60, 0, 60, 0, 0, 0, 1), (2, 80, 0.05, 10, 0, 45, 0, 1), (2, 40, 0.1, 90, 0, 30, 0, 1), (2, 150, 0, 0, 0, 0, 0, 1),
    (2, 7, 0, 0, 0, 70, 0, 1), (2, 30, 0, 50, 0, 40, 0, 1),
    (2, 3, 1, 2, 1, 3, 1, 0), (2, 1, 1, 60, 0, 1, 1, 0), (2, 5, 0, 2, 1, 2, 1, 0), (2, 12, 0, 0, 0, 2, 1, 0), (2, 9, 0.5, 60, 0, 2, 1, 0), (2, 20, 0.8, 3, 1, 3, 1, 0), (2, 40, 0.8, 4, 1, 2, 1, 0),
    (2, 12, 0, 60, 0, 1, 1, 0), (2, 14, 0, 3, 1, 1, 0, 0), (2, 8, 0, 0, 0, 0, 0, 0),
])


def grow(rows: np.ndarray, depth: int = 10):
    """A decision tree by Gini impurity: a label, or (column, threshold, tree of <=, tree of >)."""
    y = rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0
    best = None
    for c in range(rows.shape[1] - 1):
        values = np.unique(rows[:, c])
        for t in (values[:-1] + values[1:]) / 2:
            left = rows[:, c] <= t
            cost = gini(y[left]) + gini(y[~left])
            if best is None or cost < best[0] - 1e-12:
                best = cost, c, t
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, c, t = best
    left = rows[:, c] <= t
    return c, float(t), grow(rows[left], depth - 1), grow(rows[~left], depth - 1)


def classify(tree, x: np.ndarray) -> np.ndarray:
    """The tree's label of each row."""
    if isinstance(tree, int):
        return np.full(len(x), tree)
    c, t, low, high = tree
    left = x[:, c] <= t
    out = np.empty(len(x), int)
    out[left], out[~left] = classify(low, x[left]), classify(high, x[~left])
    return out


_TREE: list = []


def main_text(page: str) -> str:
    """The kept blocks, joined by line ends."""
    if not _TREE:
        _TREE.append(grow(LABELLED))
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b[0] for b, k in zip(found, classify(_TREE[0], features(found)), strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (code points) of every page."""
    ship(pages.sparkSession)
    d = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html_col}`").cast("string").alias("__html"))
    names = [*keep, "text", "n_chars"]

    def run(batches):
        for b in batches:
            t = [main_text(x.as_py() or "") for x in b.column(b.num_columns - 1)]
            yield pa.record_batch([*b.columns[:-1], pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64())], names=names)

    return d.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]), "text string, n_chars long"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: main text of every one of the ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
