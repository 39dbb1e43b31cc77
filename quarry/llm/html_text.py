"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser is fed the page piece by piece; its events cut the
page into lines, one for each block of text. A line knows its text, how much of it
is links, its tags and the elements it stands in. What HTML itself says is no
content (menus, footers, forms, scripts, hidden elements, ...) is passed over, and
so is what is named as reader comments or adverts.

Of the other lines the ratio of text outside links to tags is smoothed with a
Gaussian kernel. Lines that reach the threshold, the standard deviation of the
smoothed ratios, are the seeds of content. They are clustered by the region they
stand in: every article among them is content, or else the region around all of
them. In a region that HTML doesn't call an article the ratios go on to decide:
a part of it without seeds stays if it lies between seeds or heads them, and goes
if it is a list of links or stands before or after the content.

Other names (sidebar, share, newsletter, ...) are hints: an element with one goes
if it has less than half of the page's text and, within an article, no seeds.
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

from quarry.llm.common import tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are no content wherever they stand.
NEVER = frozenset("aside button canvas datalist dialog embed footer form head iframe input menu nav noscript object script select style svg template textarea title video audio".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id by which reader comments and adverts are known; no ratio tells them from an article.
STRONG = frozenset("comment comments commentlist respond replies disqus ad ads adv advert adverts advertisement advertising sponsor sponsored".split())
#: Words in a class or id that hint at an element that is no content.
HINTS = frozenset(
    "promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar footer masthead reply share sharing social related recommended recommendations widget widgets pagination pager copyright toolbar login search skip".split()
)
HEADER_WORDS = frozenset({"header", "topbar", "head"})
#: Elements that have blocks in them; names of others (paragraphs, headings, ...) say nothing.
CONTAINER = frozenset("div section ul ol dl table tbody td article center details fieldset figure span".split())
REGION = frozenset("article main section div td body html blockquote center".split())
BLANKS = {ord(c): None for c in " \t\n\r\f\v\xa0"}
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Lines(HTMLParser):
    """Of each line its text, tags (their number), links (characters in links), whether it is a heading, path (the regions that it
    stands in, from outside in, as (number, name)) and hint (the number of the outermost element around it that has one)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.links: list[int] = []
        self.headings: list[bool] = []
        self.paths: list[tuple] = []
        self.hints: list[int] = []
        self.stack: list[tuple[str, bool, tuple, int]] = []  # name, whether no content, regions, hint
        self.passed = self.anchors = self.linked = 0  # open elements that are no content, open links, characters in links
        self.buffer: list[str] = []
        self.n = self.regions = 0

    def _end_line(self) -> None:
        if self.buffer:
            t = " ".join("".join(self.buffer).split())
            if t:
                self.texts.append(t)
                self.tags.append(self.n)
                self.links.append(self.linked)
                self.headings.append(any(name in HEADINGS for name, *_ in self.stack[-3:]))
                self.paths.append(self.stack[-1][2] if self.stack else ())
                self.hints.append(self.stack[-1][3] if self.stack else 0)
            self.buffer = []
            self.n = self.linked = 0

    def _judged(self, tag: str, attrs: list) -> tuple[bool, bool]:
        """Whether an element is no content, and whether its name hints at that."""
        inside = any(name in ("article", "main") for name, *_ in self.stack)
        if tag in NEVER or tag == "header" and not inside:
            return True, False
        if not attrs:
            return False, False
        a = dict(attrs)
        if (a.get("role") or "").lower() in ROLES or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower():
            return True, False
        if tag not in CONTAINER:
            return False, False
        words = {w.lower() for k in ("class", "id") for w in PART.findall(a.get(k) or "")}
        if words & STRONG:
            return True, False
        return False, tag != "article" and bool(words & HINTS or not inside and words & HEADER_WORDS)

    def _pop(self, k: int) -> None:
        """Closes the elements from k on."""
        for name, passed, *_ in self.stack[k:]:
            self.passed -= passed
            self.anchors -= name == "a"
        del self.stack[k:]

    def _close(self, names, until) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in names:
                self._pop(k)
                return
            if name in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._end_line()
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                self._close((tag,) if tag not in ("dd", "dt") else ("dd", "dt"), ("ul", "ol", "dl", "table", "select", "menu", "article", "main"))
            else:
                self._close(("p",), REGION)
        elif tag == "br":
            self.buffer.append(" ")
        self.n += 1
        if tag in VOID:
            return
        regions, hint = self.stack[-1][2:] if self.stack else ((), 0)
        passed, hinted = self._judged(tag, attrs)
        if tag in REGION or tag in LISTS or hinted:
            self.regions += 1
            regions = (*regions, (self.regions, tag))
        self.passed += passed
        self.anchors += tag == "a"
        self.stack.append((tag, passed, regions, hint or hinted * self.regions))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._end_line()
        self.n += 1
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                self._pop(k)
                break
            if tag not in BLOCK and name in BLOCK:  # inline elements end with their block
                break

    def handle_data(self, data):
        if not self.passed:
            self.buffer.append(data)
            if self.anchors:
                self.linked += len(data.translate(BLANKS))

    def finish(self) -> None:
        self.close()
        self._end_line()


def smoothed(ratio: np.ndarray, sigma: float = 1.0, radius: int = 2) -> np.ndarray:
    """With a Gaussian kernel, whose weights are those of the lines that exist."""
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    n = len(ratio)
    return np.convolve(ratio, k, "full")[radius : radius + n] / np.convolve(np.ones(n), k, "full")[radius : radius + n]


def content(lines: Lines) -> list[int]:
    """The lines that are content."""
    if not lines.texts:
        return []
    size = np.array([len(t) - t.count(" ") for t in lines.texts], float)
    links = np.minimum(np.array(lines.links, float), size)
    own = (size - links) / np.maximum(1, lines.tags)
    whole, hinted = float((size - links).sum()), defaultdict(float)
    for k, h in enumerate(lines.hints):
        hinted[h] += size[k] - links[k]
    doubtful = np.array([h > 0 and 2 * hinted[h] < whole for h in lines.hints])
    ratio = smoothed(np.where(doubtful, 0.0, own))
    level = min(ratio.std(), ratio.max())
    # a line that owes the level to its neighbours alone is no seed
    seed = (ratio >= level) & (own >= level / 2)
    mass: dict = defaultdict(float)
    for k in np.flatnonzero(seed & ~doubtful):
        for r in lines.paths[k]:
            mass[r] += size[k]
    named = [r for r in mass if r[1] in ("article", "main")]
    if named:
        chosen = {max(named, key=lambda r: (mass[r], r[0])), *(r for r in named if r[1] == "article")}
        inside = [k for k, path in enumerate(lines.paths) if not chosen.isdisjoint(path)]
        seeds_of: dict = defaultdict(int)
        for k in inside:
            seeds_of[lines.hints[k]] += bool(seed[k]) and 2 * links[k] < size[k]
        return [k for k in inside if not doubtful[k] or seeds_of[lines.hints[k]]]
    rest = np.flatnonzero(~doubtful)
    total = sum(size[k] for k in rest if seed[k])
    around = [r for r in mass if mass[r] == total and r[1] in REGION]
    root = _widened(lines, rest, links, size, max(around)) if around else None
    return _parts(lines, [k for k in rest if root is None or root in lines.paths[k]], root, seed, links, size)


def _widened(lines: Lines, rest: np.ndarray, links: np.ndarray, size: np.ndarray, root: tuple) -> tuple:
    """The outermost region around root of which each one on the way has lines of its own, outside links, and isn't the page."""
    path = next(p for p in (lines.paths[k] for k in rest) if root in p)
    for r in reversed(path[: path.index(root)]):
        if r[1] in ("body", "html") or not any(r == lines.paths[k][-1] and 2 * links[k] < size[k] for k in rest if lines.paths[k]):
            break
        root = r
    return root


def _parts(lines: Lines, inside: list[int], root: tuple | None, seed: np.ndarray, links: np.ndarray, size: np.ndarray) -> list[int]:
    """Of a region's lines those that stay: the ones that stand in it directly, and of each part in it all or, if it has seeds, those that
    stay of its own."""
    parts: list[tuple[tuple | None, list[int]]] = []
    for k in inside:
        path = lines.paths[k]
        at = path.index(root) + 1 if root is not None else 0
        part = path[at] if at < len(path) else None
        if parts and part is not None and parts[-1][0] == part:
            parts[-1][1].append(k)
        else:
            parts.append((part, [k]))
    alive = [bool(seed[own].any()) for _, own in parts]
    if not any(alive):
        return inside
    first, last = alive.index(True), len(alive) - 1 - alive[::-1].index(True)
    out = []
    for n, (part, own) in enumerate(parts):
        linked = links[own].sum() * 2 > size[own].sum()
        if part is None or part[1] in LISTS and not linked:  # a list of text is text, wherever it stands
            if not linked or alive[n] or first < n < last:
                out += own
        elif alive[n]:
            out += _parts(lines, own, part, seed, links, size)
        elif first < n < last:
            if not linked or len(own) < 2:
                out += own
        elif n < first and not linked and any(lines.headings[k] for k in own) and all(p is None or any(lines.headings[k] for k in o) for p, o in parts[n + 1 : first]):
            out += own
    return out


def main_text(html: str | None, step: int = 1 << 20) -> str:
    """The article's blocks in page order, one a line."""
    p = Lines()
    html = (html or "").replace("<![", "<!-[")  # marked sections, which the parser may refuse, become comments
    for at in range(0, len(html), step):
        p.feed(html[at : at + step])
    p.finish()
    return "\n".join(p.texts[k] for k in content(p))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    A null or empty page, and one without content, has the empty text. Pages are
    read whole; nothing of the content is cut short. Repeated rows and null
    identifiers each appear, and other columns are ignored. An empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long"
    return pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(tidy(run), schema)
