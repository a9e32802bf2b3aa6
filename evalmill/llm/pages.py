"""Main text of web pages from the standard library's parser events.

Blocks (the text between block-level tags) stand for lines. A block's ratio is its text over its tags; ratios are
smoothed with a Gaussian along the page, and a threshold on the smoothed values marks content. The marked text
chooses the content region: the element around it. Forms and names of boilerplate are judged by what they hold. Every block of the region that is no boilerplate is returned,
short ones too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
DROP_TAGS = frozenset(
    "aside button canvas datalist dialog fieldset footer form frameset head iframe input label math menu nav noframes noscript object "
    "option script search select style svg template textarea title".split()
)
#: Words that name boilerplate when a class or id begins or ends with them.
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup "
    "promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
#: Of these, names that a wrapper of the article may have for its layout; the others tell what the text itself is.
LAYOUT_NAMES = frozenset("hidden masthead menu nav navbar navigation search sidebar toolbar topbar widget widgets".split())
OWN_NAMES = DROP_NAMES - LAYOUT_NAMES
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Elements that close an open element of the same kind when they begin, up to the given borders.
CLOSES = {
    "p": ("p",),
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
BORDERS = frozenset("article aside body div footer form header html main nav ol section table td th ul dl blockquote".split())
PARTS = re.compile("[A-Z]?[a-z0-9]+|[A-Z]+")


class Element:
    """``hard``: it or an element around it never holds main text. ``soft``: it is a form or its names say boilerplate,
    which what it holds can refute (see ``pardon``), but not if it is ``own``: then its names tell what its text is.
    ``drops`` counts both kinds from the root on."""

    __slots__ = ("tag", "parent", "hard", "soft", "own", "drops", "core", "inside", "text", "marked")

    def __init__(self, tag: str, parent: Element | None, hard: bool = False, soft: bool = False, own: bool = False, core: bool = False):
        self.tag, self.parent, self.soft, self.own = tag, parent, soft, own
        self.hard = hard or (parent is not None and parent.hard)
        self.drops = (parent.drops if parent is not None else 0) + (hard or soft)
        self.core = core and not self.hard
        self.inside = self.core or (parent is not None and parent.inside)
        self.text = self.marked = 0

    def chain(self) -> list[Element]:
        """From the root to this element."""
        out, element = [], self
        while element is not None:
            out.append(element)
            element = element.parent
        return out[::-1]


class Block:
    __slots__ = ("parts", "tags", "linked", "owner", "text")

    def __init__(self, owner: Element):
        self.parts, self.tags, self.linked, self.owner, self.text = [], 1, 0, owner, ""


def names_boilerplate(value: str, words: frozenset = DROP_NAMES) -> bool:
    for name in value.split():
        parts = [p.lower() for p in PARTS.findall(name)]
        if parts and not {"has", "no", "with", "without"} & set(parts) and (parts[0] in words or parts[-1] in words):
            return True
    return False


class Blocks(HTMLParser):
    """Collects the blocks of a page while it is parsed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", None)
        self.stack = [self.root]
        self.blocks: list[Block] = []
        self.open: Block | None = None
        self.links = 0

    def end_block(self) -> None:
        if self.open is not None:
            self.open.text = " ".join("".join(self.open.parts).split())
            if self.open.text and not self.open.owner.hard:
                self.blocks.append(self.open)
            self.open = None

    def boilerplate(self, tag: str, attrs: dict[str, str | None]) -> bool:
        """Never main text, whatever it holds; a form is judged by what it holds."""
        role = (attrs.get("role") or "").lower()
        if tag in DROP_TAGS - {"form"} or role in DROP_ROLES - {"form"} or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if tag == "header" or "header" in {n.lower().split("-")[-1].split("_")[-1] for n in names.split()}:
            return not self.stack[-1].inside  # the head of a page, not of its article
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
        elif self.open is not None:
            self.open.tags += 1
        for old in CLOSES.get(tag, ("p",) if tag in BLOCK_TAGS else ()):
            self.leave(old, BORDERS - {old})
        if tag == "br" and self.open is not None:
            self.open.parts.append(" ")
        if tag in VOID_TAGS:
            return
        held, parent = dict(attrs), self.stack[-1]
        names, role = f"{held.get('class') or ''} {held.get('id') or ''}", (held.get("role") or "").lower()
        head = tag == "header" or "header" in {n.lower().split("-")[-1].split("_")[-1] for n in names.split()}
        named = not head and tag not in ("html", "body", "main")
        soft = "form" in (tag, role) or (named and names_boilerplate(names))
        own = named and names_boilerplate(names, OWN_NAMES)
        self.stack.append(Element(tag, parent, self.boilerplate(tag, held), soft, own, tag in ("article", "main") or role in ("main", "article")))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
        self.leave(tag, frozenset())

    def leave(self, tag: str, borders: frozenset) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if any(e.tag in BLOCK_TAGS for e in self.stack[i:]):
                    self.end_block()
                self.links -= sum(e.tag == "a" for e in self.stack[i:])
                del self.stack[i:]
                return
            if self.stack[i].tag in borders:
                return

    def handle_data(self, data: str) -> None:
        if self.open is None:
            if not data.strip():
                return
            self.open = Block(next(e for e in reversed(self.stack) if e.tag in BLOCK_TAGS or e.parent is None or e.drops > e.parent.drops))
        elif self.stack[-1].drops > self.open.owner.drops:
            return  # an advert or button inside a sentence
        self.open.parts.append(data)
        self.open.linked += len(data) if self.links else 0


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing, with the weights inside the page summing to one."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def split_at(values: list[float]) -> float:
    """Threshold between two clusters: the middle of their means, moved until it stays (at most 50 times)."""
    cut = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high:
            return min(values)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def mark(blocks: list[Block], sigma: float) -> list[bool]:
    """Which blocks are content by their smoothed ratio; elements get the sums of their text and marked text."""
    ratios = smooth([len(b.text) / b.tags for b in blocks], sigma)
    cut = split_at(ratios)
    marked = [r >= cut for r in ratios]
    chains = [b.owner.chain() for b in blocks]
    for element in (e for chain in chains for e in chain):
        element.text = element.marked = 0
    for block, chain, is_content in zip(blocks, chains, marked):
        for element in chain:
            element.text += len(block.text)
            element.marked += len(block.text) if is_content else 0
    return marked


def pardon(blocks: list[Block]) -> None:
    """A form or an element named for its layout is no boilerplate if the page's articles and mains are all inside such
    elements and one is inside this one, or if it holds most of the marked text and no article or main stands beside it."""
    chains = [b.owner.chain() for b in blocks]
    total = chains[0][0].marked
    cores = {id(e): e.chain() for chain in chains for e in chain if e.core}
    clear = {id(e) for b in blocks for e in b.owner.chain() if e.core and not any(x.soft for x in b.owner.chain())}
    around = set() if clear else {id(e) for chain in cores.values() for e in chain[:-1]}
    for element in {id(e): e for chain in chains for e in chain if e.soft and not e.own}.values():
        beside = clear - {id(e) for e in element.chain()}
        if id(element) in around or (2 * element.marked > total and not beside):
            element.soft = False


def main_text(html: str, sigma: float = 1.0) -> str:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    blocks = parser.blocks
    if any(b.owner.drops for b in blocks):
        mark(blocks, sigma)
        pardon(blocks)
        blocks = [b for b in blocks if not any(e.soft for e in b.owner.chain())]
    if not blocks:
        return ""
    marked = mark(blocks, sigma)
    region = content_region(blocks)
    if not region.core:  # nothing says where the article ends: link lists around the marked blocks go
        inside = [i for i, m in enumerate(marked) if m]
        blocks = [b for i, b in enumerate(blocks) if inside[0] <= i <= inside[-1] or 2 * b.linked <= len(b.text)]
    return "\n".join(b.text for b in blocks if within(b.owner, region))


def within(element: Element | None, region: Element) -> bool:
    while element is not None:
        if element is region:
            return True
        element = element.parent
    return False


def content_region(blocks: list[Block]) -> Element:
    """The article or main element with the most marked text if that is most of the page's, else the smallest element
    with all marked text and the headings of the page."""
    chains = [b.owner.chain() for b in blocks]
    root = chains[0][0]
    cores = [e for chain in chains for e in chain if e.core and 2 * e.marked > root.marked]
    if cores:
        most = max(e.marked for e in cores)
        near = [e for e in cores if e.marked == most]
        articles = [e for e in near if e.tag == "article"]
        return (articles or near)[0]
    heads = [chain for b, chain in zip(blocks, chains) if b.owner.tag == "h1" and 2 * b.linked <= len(b.text)]
    region, found = root, True
    while found:
        found = False
        for chain in chains:
            depth = chain.index(region) if region in chain else -1
            if 0 <= depth < len(chain) - 1:
                child = chain[depth + 1]
                whole = child.marked == root.marked and all(child in head for head in heads)
                if whole and child.tag in ("html", "body", "div", "section", "center", "form", "td", "table", "tbody", "tr"):
                    region, found = child, True
                    break
    return region


def extract_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (empty if none) of every row; null or empty html gives an empty text.

    Repeated rows come out each; other columns are not carried. A page is worked on alone, so memory is bounded by
    the longest page and a batch.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h) if h else "" for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id bigint, url string, text string")
