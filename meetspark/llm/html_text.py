"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their path of block-level tags from the root. For each path of a page the length of its text, its
punctuation, its link text and its nodes are summed; the ratios of text and of punctuation to nodes are smoothed over
neighbouring paths in page order, fused into one score and thresholded, which selects the paths whose nodes are content. An
article or main element raises the score of the paths in it. The deepest element that holds nearly all selected text is the
content with all its blocks, so that short headings and list items stay. Declared page furniture (nav, footer and the like) scores zero; elements named like
furniture (advert classes and the like) score less, unless they hold the article itself, and stay if the rest suffices.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_MARK = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = frozenset("script style noscript template textarea title iframe object svg canvas select option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_FURNITURE_TAGS = frozenset("head nav footer aside form menu dialog".split())
_FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related respond replies share sharing sidebar sidenav signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget widgets contentinfo complementary search alert".split()
)
# Words that often name parts of the content too, and first parts that say what an element has or is about, not what it is.
_WEAK_WORDS = frozenset("header related search tags".split())
_STATES = frozenset("has no not is with without category cat tag type format status page single hentry js".split())
_TITLES = frozenset("article content entry post section story title".split())  # whose header is the content's
STRONG, WEAK = 0.05, 0.5
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}
_SCOPE = frozenset("html body article section main div table ul ol dl blockquote td th aside nav footer header form figure".split())
_ROOTS = frozenset(["article", "main"])
_HOLDERS = frozenset("html body article main section div td center fieldset".split())
# How much a path's score gains in an article or main element; the share of the selected text that the chosen element holds.
ROOT_GAIN, SHARE = 4.0, 0.9
_RAW_END = {tag: re.compile(rf"</{tag}(?![a-zA-Z0-9:-])", re.I) for tag in _RAW}
_PARAGRAPH = frozenset(["p"])  # any other block ends an open paragraph


def _penalty(tag: str, attributes: str, in_root: bool) -> float:
    """What an element's names leave of its score: a name counts if it, its first or its last part is a furniture word."""
    least = 1.0
    if tag in ("html", "body"):
        return least
    for kind, *values in _ATTRIBUTE.findall(attributes):
        for name in "".join(values).split():
            parts = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
            if len(parts) > 1 and parts[0] in _STATES:
                continue
            found = {"".join(parts), parts[0], parts[-1]} & _FURNITURE_WORDS
            if in_root or parts[0] in _TITLES:
                found -= {"header"}
            if found:
                least = min(least, WEAK if found <= _WEAK_WORDS else STRONG)
    return least


@dataclass
class Page:
    """Elements in the order they open, from 1 (0 is the page), and text blocks in page order."""

    tag: list[str]
    parent: list[int]
    last: list[int]  # the last element opened inside
    root: list[int]  # the outermost article or main element around, or 0
    furniture: list[bool]
    penalty: list[float]  # of the element's own names
    text: list[str]
    element: list[int]  # innermost around the block
    path: list[int]  # number of its path of block-level tags
    linked: list[int]  # characters inside links


def tag_end(page: str, start: int, first: int, dead: set[int]) -> int:
    """Place of the ``>`` outside quotes that ends the tag whose name ends at ``start`` and whose first ``>`` is at ``first``; -1 if its
    quotes never close. ``dead`` holds quotes that are known to open what never ends, so none is followed twice."""
    if _ATTRIBUTES.match(page, start, first + 1):
        return first
    at, opened = start, []
    while m := _MARK.search(page, at):
        if m[0] == ">":
            return m.start()
        opened.append(m.start())
        close = page.find(m[0], m.end()) if m.start() not in dead else -1
        if close < 0:
            break
        at = close + 1
    dead.update(opened)
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``("text", text, "")``, ``("open", tag, attributes)`` and ``("close", tag, "")`` in page order, in time linear in its length.

    A tag whose quotes never close ends at its first ``>``. Without any ``>`` the rest of the page is text, as is a ``<`` before
    anything but a tag.
    """
    at, dead = 0, set()
    while at < len(page):
        i = page.find("<", at)
        if i < 0:
            yield "text", page[at:], ""
            return
        closing = page.startswith("/", i + 1)
        name = _NAME.match(page, i + 1 + closing)
        if not name and not page.startswith(("!", "?"), i + 1):
            yield "text", page[at : i + 1], ""
            at = i + 1
            continue
        if i > at:
            yield "text", page[at:i], ""
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        end = page.find(">", i)
        if end < 0:
            yield "text", page[i:], ""
            return
        at = end + 1
        if not name:
            continue
        quoted = tag_end(page, name.end(), end, dead)
        if quoted >= 0:
            at = quoted + 1
        tag = name[0].lower()
        yield ("close", tag, "") if closing else ("open", tag, page[name.end() : at - 1])
        if not closing and tag in _RAW:
            m = _RAW_END[tag].search(page, at)
            end = page.find(">", m.end()) if m else -1
            at = end + 1 if end >= 0 else len(page)


def parse(page: str) -> Page:
    """The elements and text blocks of a page, at any depth."""
    out = Page([""], [0], [0], [0], [False], [1.0], [], [], [], [])
    paths: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, element, path
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack
    scopes = [0]  # places of the open elements that bound implied ends
    text: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            _, element, path = stack[-1]
            out.text.append(joined)
            out.element.append(element)
            out.path.append(path)
            out.linked.append(linked)
        text.clear()
        linked = 0

    def pop() -> str:
        tag, element, _ = stack.pop()
        out.last[element] = len(out.tag) - 1
        opened[tag].pop()
        if scopes[-1] == len(stack):
            scopes.pop()
        return tag

    def close_open(these: frozenset[str]) -> None:
        """Ends the nearest open element of these in scope, and all inside it."""
        place = max((opened[t][-1] for t in these if opened[t]), default=-1)
        if place >= scopes[-1]:
            while len(stack) > place:
                pop()

    for kind, value, attributes in tokens(page):
        if kind == "text":
            plain = html.unescape(value)
            text.append(plain)
            if in_link:
                linked += len(plain.strip())
        elif kind == "close":
            if opened[value]:
                if value in _BLOCK:
                    flush()
                while pop() != value:
                    pass
            if value == "a":
                in_link = max(0, in_link - 1)
        elif value == "br":
            text.append(" ")
        else:
            if value in _BLOCK:
                flush()
                in_link = 0
                close_open(_CLOSES.get(value, _PARAGRAPH))
            if value in _VOID or value in _RAW or attributes.endswith("/"):
                continue
            if value == "a":
                in_link += 1
            element, (_, above, path) = len(out.tag), stack[-1]
            root = out.root[above] or (element if value in _ROOTS else 0)
            out.tag.append(value)
            out.parent.append(above)
            out.last.append(element)
            out.root.append(root)
            out.furniture.append(out.furniture[above] or value in _FURNITURE_TAGS or value == "header" and not out.root[above])
            out.penalty.append(_penalty(value, attributes, root > 0))
            opened[value].append(len(stack))
            if value in _SCOPE:
                scopes.append(len(stack))
            stack.append((value, element, paths.setdefault((path, value), len(paths) + 1) if value in _BLOCK else path))
    flush()
    while len(stack) > 1:
        pop()
    out.last[0] = len(out.tag) - 1
    return out


_STOPS = re.compile(r"[.,;:!?…。、¿¡\"'()-]")


def path_scores(keys: list[tuple], size: np.ndarray, link: np.ndarray, stops: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each block, and whether its path is mostly links, from the sums over all blocks of its path (``keys``).

    A path's ratios are unlinked characters and unlinked punctuation to blocks; they are smoothed over the paths before and after it in
    page order and fused as ``sqrt(characters * (1 + punctuation))``; a block's ``gain`` multiplies it. Link paths score zero.
    """
    paths = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    own, n = np.array([paths[k] for k in keys]), len(paths)
    count = np.bincount(own)
    length, marks = np.bincount(own, size - link, n) / count, np.bincount(own, stops * (1 - link / size), n) / count
    if n > 2:
        kernel = np.array([0.1, 0.8, 0.1])
        length, marks = (np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid") for x in (length, marks))
    linkish = np.bincount(own, link, n)[own] > 0.5 * np.bincount(own, size, n)[own]
    return np.where(linkish, 0.0, np.sqrt(length * (1 + marks))[own] * gain), linkish


def content(page: str | None, threshold: float = 0.25) -> str:
    """The blocks of the subtree that the path scores select, joined by one line feed."""
    tree = parse(page or "")
    use = [i for i, e in enumerate(tree.element) if not tree.furniture[e]]
    if not use:
        return ""
    texts = [tree.text[i] for i in use]
    element = np.array([tree.element[i] for i in use])
    size = np.array([len(t) for t in texts], dtype=float)
    link = np.minimum(np.array([tree.linked[i] for i in use], dtype=float), size)
    stops = np.array([len(_STOPS.findall(t)) for t in texts], dtype=float)
    n, last = len(tree.tag), np.array(tree.last)
    root = np.array(tree.root)[element]
    at = np.arange(n)

    def inner(values: np.ndarray) -> np.ndarray:
        """Sum of the blocks' values inside each element."""
        total = np.concatenate([[0.0], np.cumsum(np.bincount(element, values, n))])
        return total[last + 1] - total[at]

    # names say nothing of an element that is or holds one of the page's main roots
    of_roots = np.bincount(root, size - link, n)
    of_roots[0] = 0
    exempt: set[int] = set()
    if of_roots.any():
        for r in np.flatnonzero(of_roots >= threshold * of_roots.max()).tolist():
            while r and r not in exempt:
                exempt.add(r)
                r = tree.parent[r]
    named = np.array([p < 1 and e not in exempt for e, p in enumerate(tree.penalty)])
    least = [1.0] * n
    for e in range(1, n):
        above = least[tree.parent[e]]
        least[e] = min(above, tree.penalty[e]) if named[e] else above
    penalty = np.array(least)
    gain = np.where(root > 0, ROOT_GAIN, 1.0) * penalty[element]
    score, linkish = path_scores(list(zip((tree.path[i] for i in use), (root > 0).tolist(), penalty[element].tolist(), strict=True)), size, link, stops, gain)
    # an element named like furniture is judged whole, by the mean score of its text
    poor = named & (inner(score * size) < threshold * score.max() * inner(size))
    if poor.any():
        below = poor.tolist()
        for e in range(1, n):
            below[e] = below[e] or below[tree.parent[e]]
        poor = np.array(below)
    plain = ~poor[element]
    seed = (score >= threshold * score.max()) & ~linkish & plain
    if not seed.any():  # nothing but links: those of an article are its content
        return "\n".join(t for t, r, p in zip(texts, root, penalty[element], strict=True) if r and p == 1)
    holder = np.array([t in _HOLDERS for t in tree.tag])
    holder[0] = True
    around, heading = [0] * n, [False] * n  # nearest holder around an element; whether it is in a heading
    for e in range(1, n):
        above, tag = tree.parent[e], tree.tag[e]
        around[e] = e if tag in _HOLDERS else around[above]
        heading[e] = heading[above] or tag in ("h1", "h2", "h3")
    held_by, titled_in = np.array(around), np.array(heading)
    mass = inner(np.where(seed, (size - link) * gain, 0.0))
    seeded = inner(seed.astype(float)) > 0
    chosen = int(np.flatnonzero(holder & seeded & (mass >= SHARE * mass[0] * (1 - 1e-12))).max())  # elements are numbered as they open
    within = lambda e: (element >= e) & (element <= last[e])
    of_root = tree.root[chosen]
    chosen = of_root or chosen
    whole = {0} | {e for e, t in enumerate(tree.tag) if t in ("html", "body")}
    inside = within(chosen)
    while not of_root and chosen not in whole:  # a wrapper that adds little but the heading
        parent = int(held_by[tree.parent[chosen]])
        wider = within(parent)
        more, first = wider & ~inside, int(np.argmax(inside))
        titled = titled_in[element[:first][more[:first]]].any()
        if parent in whole or not titled or size[more].sum() > 0.2 * size[inside].sum() or link[more].sum() > 0.5 * size[more].sum():
            break
        chosen, inside = parent, wider
    if chosen in whole:  # no element of its own: what stands beside selected paths, and articles that have any
        inside &= seeded[held_by[element]] | (root > 0) & seeded[root]
    inside &= plain
    return "\n".join(t for t, keep, r, links in zip(texts, inside, root, linkish, strict=True) if keep and (r or not links))


def _extract(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [content(x.as_py(), threshold) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Main text of each row of ``pages(page_id, url, html)``: ``page_id, url, text, n_chars``.

    A page's ratios come from that page alone, so no shuffle is needed. ``threshold`` is the share of the best fused path
    score that a path needs to be selected. A null or empty page has text ``''``; unclosed tags and
    cut-off pages are read as far as they go; pages of any length are read whole, in time linear in it; paths that tie are all
    selected; null ids and urls pass through; repeated rows are judged each; an empty table gives an empty result; extra columns
    are ignored.
    """
    return pages.select(F.col("page_id"), F.col("url"), F.col("html")).mapInArrow(_extract(threshold), "page_id long, url string, text string, n_chars long")
