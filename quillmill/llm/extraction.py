"""Main text of web pages: boosted trees over DOM nodes, decoded so that the tree agrees."""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.tables import batches_mapped

PAGES = 240  # pages, picked by a hash of their ids, that the model is fitted on
LONGEST = 60_000  # characters of a page in that sample at most
LONG_PAGES = 8  # longer ones that it takes where no others are
LEAST_TEXT = 40  # characters of a block that is taken for a paragraph where no page marks any
LAYOUTS = 3
TOKENS = 160
TREES, DEPTH, RATE, BINS, LEAST = 48, 4, 0.25, 24, 8
TOGETHER = 64

BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("template svg object math canvas".split())
RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+>?", re.I) for x in "script style noscript textarea title iframe".split()}
FOREIGN = {"svg", "math"}  # where these elements are not raw text
IN_HEAD = set("head base basefont bgsound link meta".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
         "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}
IN_P = BLOCKS - set("body button caption html iframe legend option select summary tbody td tfoot th thead tr frameset".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")  # of a tag, behind its name
MARKUP = re.compile("<[!?]")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|type|data-main|data-cut)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ARTICLE = re.compile(r"<[aA][rR][tT][iI][cC][lL][eE](?=[\s/>])")
MARKS = re.compile(r"[.!?;:,]")


class TagEnds:
    """Where the tags of a page end: at the first ``>`` outside quotes, or, where an open quote
    leaves none, at the first at all.

    The first time that quotes leave none, the ends from all quotes on are worked out from the
    back, so that no page is searched to its end more than once.
    """

    def __init__(self, html: str):
        self.html, self.places, self.ends = html, None, []

    def find(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``; -1 if the rest holds no ``>``."""
        if self.places is None:
            match = REST.match(self.html, at)
            if match:
                return match.end()
            self.places = [m.start() for m in re.finditer("[>\"']", self.html)]
            self.ends = [-1] * (len(self.places) + 1)
            later: dict[str, int] = {}
            for i in range(len(self.places) - 1, -1, -1):
                mark = self.html[self.places[i]]
                if mark == ">":
                    self.ends[i] = self.places[i] + 1
                    continue
                if mark in later:
                    self.ends[i] = self.ends[later[mark] + 1]
                later[mark] = i
        end = self.ends[bisect_left(self.places, at)]
        return end if end >= 0 else self.html.find(">", at) + 1 or -1


class Page(NamedTuple):
    """A page as lists over its block elements, in page order: parent, tag, tokens, and the
    text, link text, marks and numbers of tags of each alone; and its runs of text."""

    parent: list[int]
    tag: list[str]
    tokens: list[tuple[str, ...]]
    chars: list[int]
    linked: list[int]
    marks: list[int]
    tags: list[int]
    label: list[int]
    runs: list[tuple[int, int, str]]


def parsed(html: str) -> Page:
    """Block elements and text runs of a page.

    Inline elements only tell which text is linked. What the standard lets open elements
    end implicitly, ends: a paragraph at the next block, an item at the next item. End tags
    without an open element and unknown markup are passed over; text of scripts, styles and
    the like is left out, and reaches to their own end tag whatever stands in them. The head
    has no text of its own: it ends where text or an element of the body begins. A run is (element, block number, text); texts of one block number
    stand in one block, unbroken by any block border.
    """
    page = Page([-1], ["html"], [()], [0], [0], [0], [0], [0], [])
    open_at: list[int] = [0]
    depths: defaultdict[str, list[int]] = defaultdict(list)  # places in open_at, by name
    tag_ends = TagEnds(html)
    block, link, at, silent = 0, False, 0, None

    def say(text: str) -> None:
        node = open_at[-1]
        text = entities.unescape(text) if "&" in text else text
        size = len("".join(text.split()))
        page.runs.append((node, block, text))
        if size:
            page.chars[node] += size
            page.marks[node] += len(MARKS.findall(text))
            if link:
                page.linked[node] += size

    def close(depth: int) -> None:
        while len(open_at) > depth:
            depths[page.tag[open_at.pop()]].pop()

    def deepest(names: set[str]) -> int:
        return max((depths[x][-1] for x in names if depths[x]), default=0)

    while match := TAG.search(html, at):
        start, name = at, match[2]
        at = match.end() if name is None else tag_ends.find(match.end())
        if at < 0:  # no tag ends from here on: all is text up to the next mark-up of another kind
            at, match = start, MARKUP.search(html, match.start() + 1)
            if match and silent is None:
                say(html[start : match.start()])
            at = len(html) if match else start
            break
        if silent is None and match.start() > start:
            say(html[start : match.start()])
        if name is None:
            continue
        rest = html[match.end() : at]
        name = name.lower()
        if name in RAW and not match[1] and not rest.endswith("/>") and silent not in FOREIGN:
            end = RAW[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if silent is not None:
            if match[1] and name == silent:
                silent = None
            continue
        if match[1]:
            if name == "a":
                link = False
            elif name in BLOCKS:
                block += 1
                if depths[name]:
                    close(depths[name][-1])
            continue
        if name in RAW:
            continue
        if name in SILENT:
            if not rest.endswith("/>"):
                silent = name
            continue
        if name not in BLOCKS:
            page.tags[open_at[-1]] += name not in IN_HEAD or open_at[-1] > 0
            if name == "a":
                link = True
            elif name == "br":
                page.runs.append((open_at[-1], block, " "))
            continue
        block += 1
        if name in IN_P and page.tag[open_at[-1]] == "p":
            close(len(open_at) - 1)
        if name in CLOSES and deepest(CLOSES[name]) > deepest(HOLDS[name]):
            close(deepest(CLOSES[name]))
        if name in VOID:
            continue
        tokens, label = [name], -1
        for key, *values in ATTRIBUTE.findall(rest) if "=" in rest else ():
            key, value = key.lower(), "".join(values)
            if key.startswith("data-"):
                label = int(key == "data-main")
            else:
                tokens += [x.lower() for x in PARTS.findall(value)[:12]]
        parent = open_at[-1]
        page.parent.append(parent)
        page.tag.append(name)
        page.tokens.append(tuple(tokens))
        for column in (page.chars, page.linked, page.marks, page.tags):
            column.append(0)
        page.label.append(page.label[parent] if label < 0 else label)
        depths[name].append(len(open_at))
        open_at.append(len(page.tag) - 1)
    if silent is None and at < len(html):
        say(html[at:])
    return page


FACTS = 30


def facts(page: Page) -> np.ndarray:
    """Numbers about each block element: subtree sizes and densities, depth, siblings, place."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.array([page.chars, page.linked, page.marks, page.tags], np.float64)
    own = np.vstack([own, np.ones(n), [t == "p" for t in page.tag], [t == "li" for t in page.tag]])
    whole = own.T.copy()
    depth, order, siblings = np.zeros(n), np.zeros(n), np.zeros(n)
    alike: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        order[i] = siblings[p]
        siblings[p] += 1
        key = p, page.tag[i]
        alike[key] = alike.get(key, 0) + 1
    for i in range(n - 1, 0, -1):
        whole[page.parent[i]] += whole[i]
    up = np.maximum(parent, 0)
    before = np.concatenate([[0], np.cumsum(own[0])[:-1]])
    chars, linked, marks, tags, nodes, ps, lis = whole.T
    total = max(chars[0], 1)
    safe = np.maximum(chars, 1)
    above = np.maximum(chars[up], 1)
    same = np.array([alike.get((p, t), 1) for p, t in zip(page.parent, page.tag, strict=True)], float)
    grand = up[up]
    columns = [
        np.log1p(chars), np.log1p(own[0]), linked / safe, own[1] / np.maximum(own[0], 1), marks / safe * 100,
        chars / (nodes + tags), np.log1p(nodes), np.log1p(ps), np.log1p(lis), ps / nodes, lis / nodes,
        depth, order, siblings, siblings[up], order / np.maximum(siblings[up], 1), same, same / np.maximum(siblings[up], 1),
        chars / total, chars / above, before / total, (before + chars) / total, linked[up] / above,
        marks[up] / above * 100, np.log1p(chars[up]), np.log1p(ps[up]), np.log1p(chars[grand]),
        linked[grand] / np.maximum(chars[grand], 1), chars / np.maximum(nodes - lis, 1), np.full(n, np.log1p(total)),
    ]
    return np.column_stack(columns)


class Tree(NamedTuple):
    """A binary tree in an array: feature and border of each inner place, value of each place."""

    feature: np.ndarray
    border: np.ndarray
    value: np.ndarray


class Forest:
    """Gradient boosted trees for a yes or no, on the log odds; splits by binned values."""

    def __init__(self, rows: np.ndarray, yes: np.ndarray, weight: np.ndarray):
        self.start = float(np.log((yes @ weight + 1) / ((1 - yes) @ weight + 1)))
        numbers, marks = rows[:, :FACTS], rows[:, FACTS:]
        borders = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in numbers.T]
        binned = np.column_stack([np.searchsorted(b, c, "left") for b, c in zip(borders, numbers.T, strict=True)])
        odds = np.full(len(rows), self.start)
        self.trees: list[Tree] = []
        for _ in range(TREES):
            chance = 1 / (1 + np.exp(-odds))
            tree, place = self.grown(binned, borders, marks, weight * (yes - chance), weight * chance * (1 - chance))
            odds += tree.value[place]
            self.trees.append(tree)

    def grown(self, binned, borders, marks, slope, curve) -> tuple[Tree, np.ndarray]:
        """One tree, and the leaf of each row; ``marks`` are the columns of zeros and ones."""
        size = 2 ** (DEPTH + 1) - 1
        feature, border, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        place = np.zeros(len(binned), int)
        for node in range(size):
            rows = np.flatnonzero(place == node)
            if not len(rows):
                continue
            g, h = slope[rows].sum(), curve[rows].sum()
            value[node] = RATE * g / (h + 1)
            if node >= size // 2 or len(rows) < 2 * LEAST:
                continue

            def gain(left_g, left_h, left_n, g=g, h=h, n=len(rows)):
                found = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                return np.where((left_n < LEAST) | (n - left_n < LEAST), 0, found)

            best = (1e-6, -1, 0)
            for f, edges in enumerate(borders):
                bins = binned[rows, f]
                sums = [np.cumsum(np.bincount(bins, x, len(edges) + 1))[:-1] for x in (slope[rows], curve[rows], None)]
                if len(edges):
                    gains = gain(*sums)
                    at = int(np.argmax(gains))
                    if gains[at] > best[0]:
                        best = gains[at], f, at
            own = marks[rows]
            gains = gain(g - slope[rows] @ own, h - curve[rows] @ own, len(rows) - own.sum(axis=0))
            at = int(np.argmax(gains))
            if gains[at] > best[0]:
                best = gains[at], FACTS + at, 0
            if best[1] >= FACTS:
                feature[node], border[node] = best[1], 0.5
                place[rows] = 2 * node + 1 + (own[:, best[1] - FACTS] > 0.5)
            elif best[1] >= 0:
                feature[node], border[node] = best[1], borders[best[1]][best[2]]
                place[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
        return Tree(feature, border, value), place

    def odds(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        total = np.full(len(rows), self.start)
        for tree in self.trees:
            place = np.zeros(len(rows), int)
            for _ in range(DEPTH):
                f = tree.feature[place]
                inner = f >= 0
                right = rows[np.arange(len(rows)), np.maximum(f, 0)] > tree.border[place]
                place = np.where(inner, 2 * place + 1 + right, place)
            total += tree.value[place]
        return total


class Extractor:
    """A fitted model with the attribute tokens it knows."""

    def __init__(self, pages: list[Page], importance: list[float]):
        counts: dict[str, int] = {}
        for page in pages:
            for token in {t for tokens in page.tokens for t in tokens}:
                counts[token] = counts.get(token, 0) + 1
        common = sorted(counts, key=lambda t: (-counts[t], t))[:TOKENS]
        self.tokens = {t: FACTS + i for i, t in enumerate(common)}
        rows = self.rows(pages)
        yes = np.array([x for p in pages for x in p.label], float)
        weight = np.concatenate([weights(p) * x for p, x in zip(pages, importance, strict=True)])
        self.forest = Forest(rows, yes, weight)

    def rows(self, pages: list[Page]) -> np.ndarray:
        """Facts of all elements of the pages, their tokens, and those of the elements around them."""
        numbers = [facts(p) for p in pages]
        known = len(self.tokens)
        rows = np.zeros((sum(map(len, numbers)), FACTS + 2 * known), np.float32)
        rows[:, :FACTS] = np.concatenate(numbers)
        at = 0
        for page in pages:
            first = at
            for parent, tokens in zip(page.parent, page.tokens, strict=True):
                if parent >= 0:
                    above = rows[first + parent]
                    rows[at, FACTS + known :] = np.maximum(above[FACTS : FACTS + known], above[FACTS + known :])
                for token in tokens:
                    column = self.tokens.get(token)
                    if column is not None:
                        rows[at, column] = 1
                at += 1
        return rows

    def texts(self, htmls: list[str]) -> list[str]:
        """The main text of each page."""
        pages = [parsed(h) for h in htmls]
        if not pages:
            return []
        odds = self.forest.odds(self.rows(pages))
        edges = np.cumsum([0, *(len(p.tag) for p in pages)])
        return [kept_text(p, decoded(p, odds[a:b])) for p, a, b in zip(pages, edges, edges[1:], strict=False)]


def weights(page: Page) -> np.ndarray:
    """How much an element counts: by the root of its own text."""
    return 1 + np.sqrt(np.array(page.chars, float))


def decoded(page: Page, odds: np.ndarray) -> list[bool]:
    """Which elements are main text, the likeliest choice for the whole tree.

    From the root down a path is outside the main text, then inside, then cut out of it
    again, and never returns. Each element adds the log chance of its state to the choice.
    """
    weight = weights(page)
    inside = (-weight * np.logaddexp(0, -odds)).tolist()
    outside = (-weight * np.logaddexp(0, odds)).tolist()
    n = len(page.tag)
    out, into, cut = outside.copy(), inside, outside.copy()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        out[p] += max(out[i], into[i])
        into[p] += max(into[i], cut[i])
        cut[p] += cut[i]
    state = [""] * n
    state[0] = "in" if into[0] > out[0] else "out"
    for i in range(1, n):
        above = state[page.parent[i]]
        if above == "out":
            state[i] = "in" if into[i] > out[i] else "out"
        else:
            state[i] = "in" if above == "in" and into[i] >= cut[i] else "cut"
    return [s == "in" for s in state]


def kept_text(page: Page, kept: list[bool]) -> str:
    """The blocks of the kept elements, in page order, parted by an empty line."""
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.runs:
        if kept[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(line for line in lines if line)


# --- learning from the pages themselves ----------------------------------------------
SIDE = "side"
ASIDE = set("nav header footer aside form menu button dialog".split())
MAIN_NAMES = (
    "content post entry article story main body text page single news blog copy prose document post-content entry-content "
    "article-body story-body main-content post-body page-content content-area articleBody"
).split()
SIDE_NAMES = {
    "menu": "nav menu navbar navigation topnav main-menu site-nav breadcrumbs breadcrumb toolbar tabs links".split(),
    "header": "header site-header masthead banner top topbar page-header branding logo".split(),
    "footer": "footer site-footer bottom colophon copyright legal foot page-footer".split(),
    "side": "sidebar aside widget side rail related recommended popular trending more-stories tags archive teaser".split(),
    "notice": "cookie notice consent gdpr banner-notice alert popup modal overlay cookie-banner newsletter-popup message".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense partner".split(),
    "form": "search subscribe newsletter login signup contact form search-form".split(),
    "comments": "comments comment reply replies discussion responses comment-list disqus commentlist thread reader-comments".split(),
    "share": "share social sharing share-buttons byline meta author-box follow".split(),
}
TAGS_OF = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"),
           "notice": ("div", "section", "aside"), "advert": ("div", "aside", "section"), "form": ("form", "div"),
           "comments": ("section", "div"), "share": ("div", "ul", "p")}


def example(html: str) -> tuple[str, list[str], list[str]]:
    """(title, paragraphs, other texts) of a page that marks its article, as far as it does."""
    page = parsed(html)
    inside = [False] * len(page.tag)
    for i, tag in enumerate(page.tag):
        inside[i] = tag == "article" or (i > 0 and inside[page.parent[i]])
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.runs:
        blocks.setdefault((block, inside[node], page.tag[node]), []).append(text)
    texts = [(" ".join("".join(parts).split()), main, tag) for (_, main, tag), parts in blocks.items()]
    title = next((t for t, _, tag in texts if t and tag == "h1"), "")
    return title, [t for t, main, tag in texts if t and main and tag != "h1"], [t for t, main, _ in texts if t and not main]


def relaid(title: str, paragraphs: list[str], others: list[str], dice: random.Random) -> str:
    """A page of these texts in a layout of usual elements and names, its main text marked."""
    words = " ".join([*others, *paragraphs]).split() or ["text"]

    def some(low: int, high: int) -> str:
        at = dice.randrange(len(words))
        return entities.escape(" ".join((words[at:] + words)[: dice.randint(low, high)]))

    def named(names: list[str]) -> str:
        kind = dice.random()
        name = " ".join(dice.sample(names, min(len(names), dice.randint(1, 2))))
        return "" if kind < 0.15 else f' id="{name.split()[0]}"' if kind < 0.35 else f' class="{name}"'

    def links(low: int, high: int) -> str:
        item = (lambda x: f"<li>{x}</li>") if dice.random() < 0.7 else (lambda x: x)
        return "".join(item(f'<a href="/{i}">{some(1, 5)}</a> ') for i in range(dice.randint(low, high)))

    def around(kind: str) -> str:
        tag = dice.choice(TAGS_OF[kind])
        names = SIDE_NAMES[kind] if tag in ("div", "section", "ul", "p") or dice.random() < 0.5 else []
        mark = named(names) if names else ""
        if kind == "menu":
            inner = links(3, 9) if tag == "ul" else f"<ul>{links(3, 9)}</ul>" if dice.random() < 0.7 else links(3, 9)
        elif kind == "side":
            rest = f"<ul>{links(2, 7)}</ul>" if dice.random() < 0.6 else "".join(f"<p>{some(4, 30)}</p>" for _ in range(dice.randint(1, 4)))
            inner = f"<h3>{some(1, 3)}</h3>{rest}"
        elif kind == "form":
            inner = f"<label>{some(1, 4)}</label><input type=text><p>{some(3, 16)}</p><button>{some(1, 2)}</button>"
        elif kind == "comments":
            inner = f"<h3>{some(1, 3)}</h3>" + "".join(
                f"<div{named(['comment', 'reply', 'comment-body'])}><b>{some(1, 2)}</b><p>{some(4, 60)}</p></div>"
                if dice.random() < 0.6 else f"<li><p>{some(4, 60)}</p></li>" for _ in range(dice.randint(1, 6))
            )
        elif kind == "share":
            inner = links(2, 5)
        elif kind == "header":
            inner = f"<h2>{some(1, 4)}</h2>" if dice.random() < 0.5 else f"<p>{some(1, 10)}</p>" + links(0, 3)
        elif kind == "footer":
            inner = f"&copy; {some(1, 20)}" if dice.random() < 0.5 else f"<p>&copy; {some(2, 25)}</p>{links(0, 5)}"
        else:
            inner = some(3, 40) if dice.random() < 0.5 else f"<p>{some(3, 40)}</p>"
        return f"<{tag}{mark} data-cut=1>{inner}</{tag}>"

    lines = [f"<p>{entities.escape(t)}</p>" for t in paragraphs]
    if dice.random() < 0.3:
        lines = [x if dice.random() < 0.8 else f"<h2>{some(2, 7)}</h2>{x}" for x in lines]
    if dice.random() < 0.2 and lines:
        at = dice.randrange(len(lines))
        lines[at] += dice.choice([f"<ul><li>{some(4, 20)}</li><li>{some(4, 20)}</li></ul>", f"<blockquote>{some(8, 40)}</blockquote>"])
    for kind in dice.sample(["advert", "share", "side", "form", "notice"], dice.choice([0, 0, 1, 2])):
        lines.insert(dice.randint(0, len(lines)), around(kind))
    heading = f"<h1>{entities.escape(title)}</h1>" if title and dice.random() < 0.85 else ""
    if heading and dice.random() < 0.2:
        heading = f"<header>{heading}</header>"
    tag = dice.choice(["article", "article", "div", "div", "main", "section", "td"])
    mark = named(MAIN_NAMES) if tag in ("div", "section", "td") or dice.random() < 0.4 else ""
    main = f"<{tag}{mark} data-main=1>{heading}{''.join(lines)}"
    if dice.random() < 0.2:
        main += around("comments")
    main += f"</{tag}>"
    if tag == "td":
        main = f"<table><tr>{main}{f'<td data-cut=1>{around(SIDE)}</td>'}</tr></table>"
    elif dice.random() < 0.4:
        main = f"<div{named(['wrapper', 'container', 'row', 'site', 'layout'])}>{main}{around('side') if dice.random() < 0.4 else ''}</div>"
    front = [around(k) for k in ("header", "menu", "notice", "advert", "form", "share", "side") if dice.random() < 0.4]
    back = [around(k) for k in ("comments", "side", "advert", "share", "form", "notice", "menu") if dice.random() < 0.35]
    foot = around("footer") if dice.random() < 0.85 else ""
    page = "".join([*front, main, *back, foot])
    return f"<html><head><title>{entities.escape(title)}</title></head><body>{page}</body></html>"


def guessed(html: str) -> tuple[str, list[str], list[str]]:
    """(title, paragraphs, other texts) of a page without marks: paragraphs are its longer blocks of little linked text.

    They only lend their words to layouts; a page without such a block lends its longest.
    """
    page = parsed(html)
    side = [False] * len(page.tag)
    for i, tag in enumerate(page.tag):
        side[i] = tag in ASIDE or (i > 0 and side[page.parent[i]])
    blocks: dict[tuple[int, int], list[str]] = {}
    for node, block, text in page.runs:
        blocks.setdefault((block, node), []).append(text)
    texts = [(" ".join("".join(parts).split()), node) for (_, node), parts in blocks.items()]
    texts = [(text, node) for text, node in texts if text]
    title = next((t for t, node in texts if page.tag[node] == "h1"), "")
    texts = [(t, node) for t, node in texts if page.tag[node] != "h1"]
    main = [len(t) >= LEAST_TEXT and not side[n] and page.linked[n] < 0.3 * page.chars[n] for t, n in texts]
    if texts and not any(main):
        longest = max(range(len(texts)), key=lambda i: len(texts[i][0]))
        main[longest] = True
    kept = [t for (t, _), m in zip(texts, main, strict=True) if m]
    return title, kept or [title] * bool(title), [t for (t, _), m in zip(texts, main, strict=True) if not m]


def picked(pages: DataFrame, sample: int) -> list[str]:
    """The different htmls with the lowest hashes, sorted."""
    spread = F.xxhash64("html")
    number = pages.select(F.countDistinct(spread)).first()[0]
    share = min(1.0, 1.5 * sample / max(1, number))
    rows = pages.where(spread / F.lit(float(1 << 64)) + 0.5 <= share).select("html").distinct()
    return sorted(r["html"] for r in rows.orderBy(F.xxhash64("html"), "html").limit(sample).collect())


def shortest(pages: DataFrame) -> list[str]:
    """A few of the shortest different htmls that are not empty."""
    rows = pages.where("html != ''").select("html").distinct().orderBy(F.length("html"), "html").limit(LONG_PAGES)
    return sorted(r["html"] for r in rows.collect())


def fitted(pages: DataFrame, sample: int = PAGES) -> Extractor | None:
    """A model from about ``sample`` pages that mark their article, and layouts of their texts.

    Pages are taken as they are, where the article element says what is main text, and laid
    out anew with the same texts in random usual layouts, so that the model does not hang
    on one. If no page marks an article, only layouts of the texts of any pages are learnt
    from, and if only long pages are there, some of the shortest. None if there is no text.
    """
    marked = F.col("html").rlike(ARTICLE.pattern)
    short = F.length("html") <= LONGEST
    dice = random.Random(11)
    htmls = picked(pages.where(marked & short), sample) or shortest(pages.where(marked))
    examples: list[Page] = []
    importance: list[float] = []
    for html in dice.sample(htmls, min(sample, len(htmls))):
        examples.append(parsed(ARTICLE.sub("<article data-main=1", html)))
        importance.append(LAYOUTS)
        texts = example(html)
        if texts[1]:
            examples += [parsed(relaid(*texts, dice)) for _ in range(LAYOUTS)]
            importance += [1.0] * LAYOUTS
    if not examples:
        for html in picked(pages.where(short), sample) or shortest(pages):
            texts = guessed(html)
            if texts[1]:
                examples += [parsed(relaid(*texts, dice)) for _ in range(LAYOUTS)]
                importance += [1.0] * LAYOUTS
    return Extractor(examples, importance) if examples else None


def extract_text(pages: DataFrame, sample: int = PAGES) -> DataFrame:
    """``pages`` (html, any others) with ``text`` and ``n_chars`` in place of the html.

    No shuffle: pages are parsed, scored and decoded where they are read, some at a time. A
    null or empty page, one without any main text, and every page if there was nothing to
    learn from, give an empty text. Columns named like a new one are replaced. Rows may
    repeat.
    """
    model = pages.sparkSession.sparkContext.broadcast(fitted(pages, sample))
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                htmls = [h or "" for h in part.column("html").to_pylist()]
                texts = model.value.texts(htmls) if model.value else [""] * len(htmls)
                found = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *found], [*kept, "text", "n_chars"])

    return batches_mapped(pages.select(*kept, "html"), run, schema)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    return extract_text(pages.select("page_id", "url", "html"))
