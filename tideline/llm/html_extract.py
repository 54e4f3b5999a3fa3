"""HTML extraction by tag-path ratios.

A page becomes blocks of text, each with its path of block elements from the root. Text length and punctuation are
added up per path; a path's ratios are its unlinked text and its punctuation per node. Along the page the ratios of
the blocks' paths are smoothed with those of their neighbours - text elements with text elements, containers with
containers, so that a box between paragraphs isn't lifted by them - then fused by their geometric mean. Paths whose
fused ratio passes a threshold (a share of the ratio that the middle of the page's text has) hold content.

The element that most of their text shares is the root; where headings or paragraphs stand right beside it, it is the
`article`, `main` or other element around these. Within, a block stays if its path passed, or if no container parts it
from an element that holds such text (short items of a list, a lead); titles stay that come before it. Elements that
are menus, notices, adverts, forms or comments by tag or name, or hidden, never count.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import slices

#: HTML elements by how they lay out text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements that text stands in; the other block elements are containers.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption tbody thead tfoot tr td th blockquote pre figure figcaption address center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never content, wherever they stand, and words of class, id or role names that say so.
OUTSIDE = frozenset("aside button dialog fieldset footer form head header label menu nav option select".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment\w*|consent|contentinfo|cookies?|disqus|footer|form|header|login|"
    r"masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|recommend\w*|related|replies|search|"
    r"share|sharing|sidebar|side-?bar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.DOTALL)
#: Elements that hold whole pages or articles: the names they bear tell of their parts (with-sidebar, comments-open).
WHOLE = frozenset("html body main article".split())
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")

#: A path holds content from this share of the ratio that the middle of the page's text has, and from ENOUGH anyway.
SHARE, ENOUGH = 0.5, 20.0


class Tree:
    """The block elements of a page: parent, tag, and path of each, numbered in the order they open; 0 stands above all.

    A path is a number, too: that of the path before it and the element's name. What holds of all elements around one is
    passed down from number to number, so that depth costs nothing.
    """

    def __init__(self):
        self.parent, self.tag, self.path, self.paths = [0], [""], [0], {}

    def open(self, parent: int, tag: str, name: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[parent], name), len(self.paths) + 1))
        return len(self.parent) - 1

    def line(self, element: int) -> list[int]:
        """The elements from the root down to this one."""
        out = []
        while element:
            out.append(element)
            element = self.parent[element]
        return out[::-1]

    def since(self, held) -> tuple[list[int], list[bool]]:
        """For each element: the innermost of `held` that it is or lies in (or 0), and whether only text elements part it
        from there."""
        inner, plain = [0] * len(self.parent), [True] * len(self.parent)
        for n in range(1, len(self.parent)):
            if n in held:
                inner[n] = n
            else:
                inner[n], plain[n] = inner[self.parent[n]], plain[self.parent[n]] and self.tag[n] in TEXTUAL
        return inner, plain


def blocks_of(page: str) -> tuple[list[tuple[str, int, int, bool, int]], Tree]:
    """((text, path, element, whether it is outside of content, characters of link text) of each block, elements)."""
    tree = Tree()
    stack: list[tuple[str, int, bool, bool]] = []  # tag, innermost block element, whether within outside, is a block
    opened: dict[str, int] = {}
    out, held, linked, links, at, place = [], [], 0, 0, 0, (0, False)

    def add(raw: str):
        nonlocal linked, place
        if raw and (held or not raw.isspace()):
            if not held:
                place = stack[-1][1:3] if stack else (0, False)
            held.append(raw)
            if links:
                linked += len(raw)

    def end():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, tree.path[place[0]], *place, linked))
            held.clear()
            linked = 0

    def close(i: int):
        nonlocal links
        for s in stack[i:]:
            opened[s[0]] -= 1
            links -= s[0] == "a"
        del stack[i:]

    while True:
        m = TOKEN.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not opened.get(tag):
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(s[3] for s in stack[i:]):
                        end()
                    close(i)
                    break
                if stack[i][3] and tag not in BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag in RAW or tag == "xmp":
            done = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            if tag == "xmp":  # text as it stands, markup and references too
                end()
                add(html.escape(page[at : done.start() if done else len(page)]))
                end()
            at = page.find(">", done.start()) + 1 or len(page) if done else len(page)
            continue
        if tag == "br" or tag == "hr":
            end()
        if tag in VOID:
            continue
        block = tag in BLOCK
        if block:
            end()
            for i in range(len(stack) - 1, -1, -1):  # a block ends the paragraph, or the item of its kind, that is open
                if stack[i][0] == "p" or (stack[i][0] == tag and tag in ("li", "td", "tr", "dt", "dd", "option")):
                    close(i)
                    break
                if stack[i][3]:
                    break
        if m[3].endswith("/") and not block:
            continue
        attributes = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(m[3])} if m[3] else {}
        names = " ".join(v for k, v in attributes.items() if k in ("class", "id", "role"))
        inner = bool(opened.get("article"))  # an article in an article is a comment, where its name says so
        outside = tag in OUTSIDE and not (tag == "header" and inner)
        outside = outside or bool(names and (tag not in WHOLE or (tag == "article" and inner)) and NAMED.search(names))
        outside = outside or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(attributes.get("style", "")))
        parent, within = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        element = tree.open(parent, tag, f"{tag}.{names.split()[0].replace('/', '_')}" if names.strip() else tag) if block else parent
        stack.append((tag, element, within or outside, block))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
    end()
    return out, tree


def smoothed(x: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Weighted mean with the neighbours of the same kind, which count half."""
    total, weight = x.astype(float), np.ones(len(x))
    same = np.flatnonzero(kind[1:] == kind[:-1])
    np.add.at(total, same, 0.5 * x[same + 1])
    np.add.at(total, same + 1, 0.5 * x[same])
    np.add.at(weight, same, 0.5)
    np.add.at(weight, same + 1, 0.5)
    return total / weight


def path_ratios(found: list, tree: Tree) -> tuple[dict[int, float], float]:
    """(fused ratio of each path, threshold) of a page's blocks."""
    sums: dict[int, list[float]] = {}
    for text, path, _, _, linked in found:
        s = sums.setdefault(path, [0.0, 0.0, 0.0])
        s[0] += max(0, len(text) - linked)
        s[1] += len(PUNCTUATION.findall(text)) + 1
        s[2] += 1
    kind = np.array([tree.tag[b[2]] in TEXTUAL for b in found])
    length = smoothed(np.array([sums[b[1]][0] / sums[b[1]][2] for b in found]), kind)
    marks = smoothed(np.array([sums[b[1]][1] / sums[b[1]][2] for b in found]), kind)
    fused = np.sqrt(length * marks)
    of: dict[int, list[float]] = {}
    for b, x in zip(found, fused.tolist(), strict=True):
        of.setdefault(b[1], []).append(x)
    order = np.argsort(fused, kind="stable")
    weight = np.cumsum(np.array([len(b[0]) for b in found])[order])
    middle = float(fused[order][np.searchsorted(weight, weight[-1] / 2)])
    return {p: sum(x) / len(x) for p, x in of.items()}, min(SHARE * middle, ENOUGH)


def _article(found: list, tree: Tree, line: list[int], depth: int) -> int:
    """Depth in `line`, at most `depth`, of the article around the element at `depth`: the outermost `article`, or else
    `main`, or else the highest element in which unlinked text stands outside of containers."""
    for tag in ("article", "main"):
        for at, n in enumerate(line[:depth]):
            if tree.tag[n] == tag:
                return at + 1
    place = {n: at + 1 for at, n in enumerate(line[:depth])}
    inner, plain = tree.since(place)
    return min((place[inner[n]] for text, _, n, _, linked in found if inner[n] and plain[n] and 2 * linked <= len(text)), default=depth)


def main_text(page: str | None) -> str:
    """Content blocks of a page, one per line."""
    blocks, tree = blocks_of(page or "")
    found = [b for b in blocks if not b[3]]
    if not found:
        return ""
    ratio, least = path_ratios(found, tree)
    chosen = {p for p, x in ratio.items() if x >= least and x > 0} or {max(ratio, key=ratio.get)}
    # Down from the root, as long as one child holds most of the chosen text.
    weight = [0] * len(tree.parent)
    for text, path, n, _, _ in found:
        if path in chosen:
            weight[n] += len(text)
    for n in range(len(weight) - 1, 0, -1):
        weight[tree.parent[n]] += weight[n]
    lead = max((b for b in found if b[1] in chosen), key=lambda b: len(b[0]))
    line = tree.line(lead[2])
    depth = sum(5 * weight[n] >= 4 * weight[0] for n in line)
    while depth and tree.tag[line[depth - 1]] in TEXTUAL:
        depth -= 1  # a single paragraph is not the whole article
    top = _article(found, tree, line, depth)
    outer = line[top - 1] if top else 0
    inside = tree.since({outer})[0] if outer else [0] * len(tree.parent)
    _, plain = tree.since({n for n, w in enumerate(weight) if n and w})  # elements around it that hold chosen text
    within = [outer == inside[b[2]] for b in found]
    first = next(i for i, b in enumerate(found) if b[1] in chosen and within[i])
    kept = []
    for i, (text, path, n, _, linked) in enumerate(found):
        if not within[i]:
            continue
        loose = plain[n] and 2 * linked <= len(text)
        title = tree.tag[n] in HEADINGS and i < first
        if path in chosen or loose or title:
            kept.append(text)
    return "\n".join(kept)


def _extracted(batches):
    for batch in slices(batches, 1):
        found = [main_text(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["row", "text", "n_chars"]
        )


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, text and n_chars (code points) per row of `pages`; the text is empty if there is none.

    Null and empty pages give empty texts, and so does markup without content. Unclosed and stray tags are read as a
    browser would in the main. Pages of any length and depth are read whole, each by itself, in time linear in both, as are
    rows that repeat; an empty table gives no rows. Formulas, `noscript` and `xmp` are text like any other. Other columns are ignored; of a kept column named text or n_chars the result's stands last.
    """
    base = pages.select(F.struct(*keep).alias("row"), F.col(html_col).alias("html"))
    shape = f"row {base.schema['row'].dataType.simpleString()}, text string, n_chars long"
    return base.mapInArrow(_extracted, shape).select("row.*", "text", "n_chars")
