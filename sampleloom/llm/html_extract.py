"""Main text of web pages by tag-path ratios.

A page becomes blocks, each with the path of block elements from the root to it. For every path the
text length, the punctuation, the text inside links and the number of blocks are added up; text per
block, punctuation per block and the share of links make the path's ratio, between 0 and 1. The
ratios, taken in page order, are smoothed by a Gaussian and brought back to their paths as means. Three
things are then fused to a path's score:

* its smoothed ratio;
* the content near it in the tree: each path spreads its mass (ratio times text) to the containers around,
  DECAY of it for each step, so short list items beside long paragraphs gain and far-off boxes don't;
* a weight for what its element names, classes and roles suggest. What a class or id suggests counts by how much of the page is
  elsewhere: with OUTSIDE of the mass outside the element (itself weighed by its hints) it counts in full, with less as a power of less than one, and around a whole
  page not at all; so a wrapper called content-sidebar is no sidebar. On a paragraph, item or cell it counts half, and never decides alone.

Paths whose score reaches THRESHOLD of the page's best (of 1, if that is greater) are content, and the
text is all of their blocks, nothing else. An `article` is no exception: its blocks stand or fall by their paths.

Defined results: null and empty pages, and pages without content, give an empty text; character
references are decoded, unknown ones stay as they are; broken markup is read as far as it goes
(implied ends of p, li and table cells; unclosed elements end with the page; an element without text
of its own, such as svg, that is never closed is its tag alone); repeated rows stay; columns named text
or n_chars are replaced. Nothing is capped: the work of a page is linear in its length.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sampleloom.llm.common import map_text, table

#: Share of the best path's score that makes a path content.
THRESHOLD = 0.3
#: What is left of a path's mass one container further.
DECAY = 0.3
#: Characters and marks a block needs for half of what length and punctuation can give.
HALF_LENGTH, HALF_MARKS = 60.0, 1.0
#: What a path keeps of its ratio without length, without punctuation, and inside links only.
NO_LENGTH, NO_MARKS, ALL_LINKS = 0.3, 0.5, 0.3
#: Weights of the smoothing window: a Gaussian of deviation 1 over one block to each side.
_KERNEL = np.array([math.exp(-0.5), 1.0, math.exp(-0.5)]) / (1 + 2 * math.exp(-0.5))

# Element names by their role, and what names and classes weigh.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template textarea svg iframe object select title canvas audio video annotation annotation-xml".split())
TO_THE_END = {"script", "style", "textarea", "title"}
#: These hold content of the container around them; they are no containers of their own.
WRAPPERS = set("ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption section details summary center p h1 h2 h3 h4 h5 h6 hgroup address".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ELEMENTS = {"nav": 0.1, "menu": 0.1, "form": 0.1, "dialog": 0.1, "button": 0.1, "head": 0.1, "fieldset": 0.2, "footer": 0.2, "aside": 0.2, "header": 0.2}
ROLES = {"navigation": 0.1, "menu": 0.1, "form": 0.1, "search": 0.1, "dialog": 0.1, "alert": 0.1, "contentinfo": 0.2, "complementary": 0.2, "banner": 0.2}
CONTENT, CONTENT_ROLES = {"article", "main"}, {"article", "main"}
#: The outermost content element on a path, and any inside it.
CONTENT_WEIGHT, NESTED_WEIGHT = 3.0, 1.5
STRONG = set(
    "ad ads adv advert adverts advertisement advertising advertorial banner banners sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "signup login nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager footer header masthead sidebar rail share sharing social comment comments disqus toolbar".split()
)
WEAK = set("related recommend recommended recommendation recommendations widget widgets respond replies reply discussion copyright legal search tag tags meta".split())
#: Parts of a class name that say nothing: `share-bar` is a share, `share-price` is not.
NEUTRAL = set("bar box list wrap wrapper wrapped container inner outer section block area main primary secondary top bottom left right side global site page post posts link links button buttons btn icon icons item items content text title label form head body group row col column unit slot area module component holder panel the a my js".split())
STRONG_WEIGHT, WEAK_WEIGHT = 0.2, 0.45
#: The share of the page's mass outside an element with which its classes count in full.
OUTSIDE = 0.1
#: Elements that hold text rather than areas: of what their classes say the square root counts.
LEAVES = {"p", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption", "h1", "h2", "h3", "h4", "h5", "h6"}
#: A form that holds this share of a page's text, in blocks of this mean length, is the page itself.
PAGE_FORM, FORM_LENGTH = 0.5, 100.0
#: A cell with this share of a page's mass is a column of the page, and so are those of its row.
PAGE_CELL = 1 / 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z!?/][^>]*+\Z",
    re.S,
)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden)(?=[\s=/]|\Z)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،।]")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in SKIPPED}


@dataclass
class Path:
    """A node of the tree of paths: the sums over the blocks right on it, and its weight."""

    parent: int
    container: int  # the node whose element holds its content
    weight: float  # of elements and roles
    hint: float  # what the class or id of this element takes from it
    content: bool  # an article or main element is on it
    form: int  # the outermost form on it, or 0
    table: int  # for a cell, the path of its row, else -1
    text: int = 0
    marks: int = 0
    links: int = 0
    blocks: int = 0


@dataclass
class Page:
    paths: list[Path] = field(default_factory=lambda: [Path(0, 0, 1.0, 1.0, False, 0, -1)])
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (path, text)


def hint(value: str) -> float:
    """What a class or id weighs: a name counts if all of its parts are hints or neutral."""
    weight = 1.0
    for name in value.split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts & STRONG and parts <= STRONG | WEAK | NEUTRAL:
            weight = min(weight, STRONG_WEIGHT)
        elif parts & WEAK and parts <= WEAK | NEUTRAL:
            weight = min(weight, WEAK_WEIGHT)
    return weight


def read_page(page: str) -> Page:
    """The blocks with text, in page order, and the tree of their paths."""
    got = Page()
    paths, known = got.paths, {}
    stack: list[tuple[str, int]] = [("", 0)]  # open elements: name, path
    texts: list[str] = []
    where = links = at = 0
    in_link, unclosed = False, set()
    cells: dict[int, int] = {}  # cells so far of the row that is open on a path

    def flush() -> None:
        nonlocal links
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                got.blocks.append((where, text))
                own = paths[where]
                own.text += len(text)
                own.marks += len(_PUNCTUATION.findall(text))
                own.links += min(links, len(text))
                own.blocks += 1
            texts.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links, where
        if piece:
            bare = len(piece.strip())
            if bare and not any(map(str.strip, texts)):
                where = stack[-1][1]
            texts.append(piece)
            if in_link:
                links += bare

    def opened(name: str, attrs: str) -> int:
        top = stack[-1][1]
        label, own, hinted, content = name, 1.0, 1.0, name in CONTENT
        if name in ("td", "th"):  # the cells of a row may be the columns of a page
            cells[top] = cells.get(top, 0) + 1
            label += str(cells[top])
        if attrs:
            for key, *values in _ATTR.findall(attrs):
                value, key = next(filter(None, values), ""), key.lower()
                if key == "class":
                    label += "." + ".".join(value.lower().split())
                if key in ("class", "id") and name not in ("html", "body"):
                    hinted = min(hinted, hint(value))
                elif key == "role":
                    own = min(own, ROLES.get(value.lower(), 1.0))
                    content |= value.lower() in CONTENT_ROLES
                elif key == "itemprop":
                    content |= value.lower() == "articlebody"
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    own = 0.0
                if key != "class" and (own != 1.0 or hinted != 1.0 or content):
                    label += f"#{own}{hinted}{content}"
        if name == "tr" and (top, label) in known:
            cells[known[top, label]] = 0
        if (top, label) not in known:
            up = paths[top]
            if name in HEADINGS and up.content and stack[-1][0] == "header":
                weight = paths[up.parent].weight  # the title of an article is not its site's header
            else:
                weight = up.weight
            own = min(own, ELEMENTS.get(name, 1.0))
            weight *= own
            if content:
                weight *= NESTED_WEIGHT if up.content else CONTENT_WEIGHT
            known[top, label] = len(paths)
            held = up.container if name in WRAPPERS else len(paths)
            taken = min(1.0, hinted / own) if own else 1.0
            paths.append(Path(top, held, weight, math.sqrt(taken) if name in LEAVES else taken, up.content or content, up.form or (len(paths) if name == "form" else 0), top if name in ("td", "th") else -1))
        return known[top, label]

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        custom = "-" in name and name not in SKIPPED
        if m["end"] or m["end2"]:
            if name == "a":
                in_link = False
            elif name not in INLINE:
                if not custom:
                    flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        in_link = in_link and custom
                        break
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in SKIPPED:
            flush()
            if not attrs.endswith("/") and name not in unclosed:
                if end := _ENDS[name].search(page, at):
                    at = end.end()
                elif name in TO_THE_END:
                    at = len(page)
                else:
                    unclosed.add(name)
            continue
        if name in INLINE:
            if name == "a":
                in_link = True
            elif name == "br":
                texts.append(" ")
            continue
        if custom:  # an element of the page's own is inline unless it holds blocks
            if not attrs.endswith("/"):
                stack.append((name, opened(name, attrs)))
            continue
        flush()
        in_link = False
        closes = CLOSED_BY.get(name)
        if stack[-1][0] == "p":  # any block ends an open paragraph
            stack.pop()
        if closes and stack[-1][0] in closes:
            stack.pop()
            if name == "tr" and stack[-1][0] == "tr":
                stack.pop()
        if name not in VOID:
            stack.append((name, opened(name, attrs)))
    add(page[at:])
    flush()
    return got


def scores(page: Page) -> np.ndarray:
    """The score of each path of a page with blocks; paths without blocks of their own score 0."""
    paths, n = page.paths, len(page.paths)
    column = lambda name: np.array([getattr(p, name) for p in paths], float)
    text, blocks, weight = column("text"), np.maximum(column("blocks"), 1), column("weight")
    length, marks = text / blocks, column("marks") / blocks
    ratio = (NO_LENGTH + (1 - NO_LENGTH) * length / (length + HALF_LENGTH)) * (NO_MARKS + (1 - NO_MARKS) * marks / (marks + HALF_MARKS)) * (1 - (1 - ALL_LINKS) * column("links") / np.maximum(text, 1))
    weight /= _forms(page, text, blocks)
    weight *= _hinted(page, weight**2 * ratio * text)
    order = np.array([b[0] for b in page.blocks])
    smooth = np.bincount(order, np.convolve(np.pad(ratio[order], 1, mode="edge"), _KERNEL, mode="valid"), n) / blocks
    # each container's mass, summed up the tree, then handed down: the decayed sum over all containers, in two passes
    mass = np.where(text > 0, weight**2 * ratio * text, 0.0)
    inner = {p.parent for p in paths[1:]}
    columns, hold = _columns(page, mass), [0] * n
    for i in range(1, n):
        hold[i] = i if paths[i].container == i or i in columns else hold[paths[i].parent]
    # an element of text only, as a div for a paragraph, holds nothing: its content is its parent's
    container = [hold[i] if hold[i] != i or i in inner or i in columns else hold[p.parent] for i, p in enumerate(paths)]
    holds = [i for i in range(1, n) if container[i] == i]
    up = np.bincount(container, mass, n)
    for i in reversed(holds):  # parents come before their children
        up[container[paths[i].parent]] += DECAY * up[i]
    near = up.copy()
    for i in holds:
        near[i] = up[i] + DECAY * (near[container[paths[i].parent]] - DECAY * up[i])
    around = near[container] / (mass.sum() or 1.0)
    return np.where(text > 0, weight * np.sqrt(smooth * np.minimum(around, 1.0)), 0.0)


def _columns(page: Page, mass: np.ndarray) -> set[int]:
    """The cells of rows that lay out the page."""
    inside, cells = mass.copy(), [i for i, p in enumerate(page.paths) if p.table >= 0]
    if not cells:
        return set()
    for i in range(len(inside) - 1, 0, -1):
        inside[page.paths[i].parent] += inside[i]
    rows = {page.paths[i].table for i in cells if inside[i] >= PAGE_CELL * inside[0] > 0}
    return {i for i in cells if page.paths[i].table in rows}


def _hinted(page: Page, mass: np.ndarray) -> np.ndarray:
    """What the classes on each path take from its weight, given the mass that paths have without them."""
    paths, n = page.paths, len(page.paths)
    named = np.ones(n)
    for i in range(1, n):  # parents come before their children
        named[i] = named[paths[i].parent] * paths[i].hint
    inside, inside_named = mass.copy(), mass * named**2
    for i in range(n - 1, 0, -1):
        inside[paths[i].parent] += inside[i]
        inside_named[paths[i].parent] += inside_named[i]
    out = np.ones(n)
    for i in range(1, n):
        own = paths[i].hint
        if own < 1:
            elsewhere = inside_named[0] - inside_named[i]
            own **= min(1.0, elsewhere / (elsewhere + inside[i]) / OUTSIDE) if elsewhere > 0 else 0.0
        out[i] = out[paths[i].parent] * own
    return out


def _forms(page: Page, text: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """What to divide the weights of paths in a form by, where the form holds the whole page."""
    out, inside, n = np.ones(len(text)), {}, page.paths
    for i, p in enumerate(n):
        if p.form and text[i]:
            held = inside.setdefault(p.form, [0.0, 0.0])
            held[0] += text[i]
            held[1] += blocks[i]
    whole = {f for f, (t, k) in inside.items() if t >= PAGE_FORM * text.sum() and t / k >= FORM_LENGTH}
    for i, p in enumerate(n):
        if p.form in whole:
            out[i] = ELEMENTS["form"]
    return out


def content_of(page: str | None) -> list[str]:
    """The content blocks of a page, in page order."""
    found = read_page(page) if page else Page()
    if not found.blocks:
        return []
    score = scores(found)
    least = THRESHOLD * max(1.0, float(score.max()))
    return [text for path, text in found.blocks if score[path] >= least]


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds text, the content blocks joined by an empty line, and n_chars, its code points."""

    def make():
        def run(pages):
            texts = ["\n\n".join(content_of(p)) for p in pages]
            return [texts, np.array([len(t) for t in texts], np.int64)]

        return run

    return map_text(df, html_col, "text string, n_chars long", make, keep)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
