"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .boosting import Trees, fit

#: Generated pages that the trees are fitted on.
TRAIN_PAGES = 400
#: Nodes that are scored at once.
SCORED = 20_000
#: Elements nested deeper become siblings, as browsers have it; a close tag looks no further up.
DEEPEST = 5_000

# HTML element names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
# Start tags whose end tag may be left out: (elements that they close, elements beyond which they close nothing).
_CELLS, _ROWS = {"td", "th"}, {"tbody", "thead", "tfoot"}
_ITEM_BOUNDS = CLOSES_P - {"p", "div", "address"} | _CELLS | {"caption", "menu", "select", "button", "dialog", "details", "figure"}
IMPLIED = (
    {"li": ({"li"}, _ITEM_BOUNDS | {"dt", "dd"}), "tr": (_CELLS | {"tr", "caption"}, _ROWS | {"table"})}
    | dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, _ITEM_BOUNDS | {"li"}))
    | dict.fromkeys(_CELLS, (_CELLS, {"tr", "table"} | _ROWS))
    | dict.fromkeys(_ROWS, (_CELLS | _ROWS | {"tr", "caption", "colgroup"}, {"table"}))
    | {"option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"})}
)
_NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)")
# what follows a start tag's name; quotes count after = only
_ATTRIBUTES = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。](?=\s|$)")

FEATURES = (
    "own_least", "own_most", "own_sum", "above_least", "above_most", "inside_main", "main_elsewhere", "depth", "chars", "share", "density", "link_share",
    "tags", "paragraphs", "sentences", "siblings", "index", "sibling_chars", "largest_sibling", "heading", "heading_inside", "list", "named", "before_heading",
)


class Node:
    __slots__ = ("tag", "parent", "children", "words", "parts", "chars", "linked", "tags", "index", "depth", "own", "paragraphs", "sentences", "headings", "mark")

    def __init__(self, tag: str, parent: Node | None, words: frozenset[str], mark: bool = False):
        self.tag, self.parent, self.words, self.mark = tag, parent, words, mark
        self.children: list[Node] = []
        self.parts: list = []  # strings, child blocks and breaks, in page order
        self.chars = self.linked = self.tags = self.own = self.sentences = 0
        self.paragraphs, self.headings = int(tag == "p"), int(tag in HEADINGS)
        self.index = len(parent.children) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)
            parent.parts.append(self)


def parsed(page: str) -> Node:
    """The page's block elements as a tree; inline markup stays with its block's text.

    Every character is looked at a bounded number of times, whatever tags, quotes
    and comments are left open: what has no end runs to the end of the page, a tag
    without a > is text, and after one attribute without its closing quote quotes
    count no more.
    """
    root = Node("body", None, frozenset())
    here, at, size, quoted = root, 0, len(page), True
    inline: dict[str, int] = {}  # open elements by tag

    def text(a: int, b: int) -> None:
        if a < b:
            t = html.unescape(page[a:b])
            here.parts.append(t)
            n = len(t.strip())
            here.chars += n
            here.own += n
            here.sentences += len(_SENTENCE.findall(t))
            if inline.get("a"):
                here.linked += n

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(at, size)
            break
        found = _NAME.match(page, lt)
        if not found:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                text(at, lt)
                at = end + 3 if end >= 0 else size
            elif page.startswith(("<!", "<?", "</"), lt) and (end := page.find(">", lt)) >= 0:
                text(at, lt)
                at = end + 1
            elif page.find(">", lt) < 0:
                text(at, size)
                break
            else:
                text(at, lt + 1)
                at = lt + 1
            continue
        attributes = ""
        whole = _ATTRIBUTES.match(page, found.end()) if quoted and not found[1] else None
        if whole:
            attributes, end = whole[1], whole.end() - 1
        else:
            end = page.find(">", found.end())
            if end < 0:
                text(at, size)
                break
            if not found[1]:
                quoted, attributes = False, page[found.end() : end]
        text(at, lt)
        at, tag = end + 1, found[2].lower()
        if found[1]:
            if tag in INLINE:
                if inline.get(tag):
                    inline[tag] -= 1
                continue
            node = here
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                here = node.parent
                inline.clear()
            continue
        if tag in RAW:
            last = _RAW_END[tag].search(page, at)
            end = page.find(">", last.end()) if last else -1
            at = end + 1 if end >= 0 else size
            here.parts.append(" ")
            continue
        here.tags += 1
        if tag in INLINE:
            if tag == "br":
                here.parts.append(" ")
            elif tag not in VOID and not attributes.endswith("/"):
                inline[tag] = inline.get(tag, 0) + 1
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in CLOSES_P and here.tag == "p":
            here = here.parent
            inline.clear()
        if tag in IMPLIED and (ended := _ended(here, *IMPLIED[tag])):
            here = ended.parent
            inline.clear()
        if here.depth >= DEEPEST:
            here = here.parent
        node = Node(tag, here, _words(attributes), "data-main" in attributes)
        if tag not in VOID and not attributes.endswith("/"):
            here = node
    return root


def _ended(here: Node, closes: set[str], bounds: set[str]) -> Node | None:
    """The outermost open element of ``closes`` within the next of ``bounds``."""
    found = None
    while here.parent and here.tag not in bounds:
        if here.tag in closes:
            found = here
        here = here.parent
    return found


def _words(attributes: str) -> frozenset[str]:
    """The attributes' names of things: each whole, and its parts."""
    if not attributes or attributes.isspace():
        return frozenset()
    out = set()
    for _, *values in _ATTRIBUTE.findall(attributes):
        for name in "".join(values).split():
            out.add(name.lower())
            out.update("." + part.lower() for part in _PART.findall(name))
    return frozenset(out)


def nodes_of(root: Node) -> list[Node]:
    """All nodes, ancestors first, with sums over their subtrees."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(out):
        for c in node.children:
            node.chars += c.chars
            node.linked += c.linked
            node.tags += c.tags + 1
            node.paragraphs += c.paragraphs
            node.sentences += c.sentences
            node.headings += c.headings
    return out


def tokens_of(node: Node) -> Iterator[str]:
    """What says something of a node: its element and its attributes' names."""
    yield f"<{node.tag}>"
    yield from node.words


def features_of(nodes: list[Node], beliefs: dict[str, float]) -> list[tuple]:
    """The features of a page's nodes, a row each as in ``FEATURES``; ``beliefs`` are the tokens' learnt log-odds."""
    rows, above = [], {}
    page = nodes[0].chars or 1
    main = any(n.tag in ("article", "main") for n in nodes)
    first_heading = next((k for k, n in enumerate(nodes) if n.tag == "h1"), -1)
    holds = set()
    for n in reversed(nodes):
        if n.parent and (n.tag in ("article", "main") or id(n) in holds):
            holds.add(id(n.parent))
    for k, n in enumerate(nodes):
        up = above.get(id(n.parent), (0.0, 0.0, 0))
        own = [beliefs.get(t, 0.0) for t in tokens_of(n)]
        least, most = min(own), max(own)
        inside = up[2] or n.tag in ("article", "main")
        above[id(n)] = (min(up[0], least), max(up[1], most), inside) if n.parent else up
        brothers = n.parent.children if n.parent else [n]
        around = (n.parent.chars if n.parent else n.chars) - n.chars
        largest = above.get((id(n.parent), "largest")) if n.parent else n.chars
        if largest is None:
            largest = above[(id(n.parent), "largest")] = max(c.chars for c in brothers)
        rows.append((
            least, most, sum(own), up[0], up[1], bool(inside), main and not inside and id(n) not in holds, n.depth, n.chars, n.chars / page, n.chars / (n.tags + 1), n.linked / (n.chars or 1),
            n.tags, n.paragraphs, n.sentences / (n.chars + 20) * 100, len(brothers), n.index / len(brothers), around / len(brothers), largest / page, n.tag in HEADINGS, n.headings,
            n.tag in ("ul", "ol", "li", "menu"), len(n.words), k < first_heading,
        ))
    return rows


def decoded(nodes: list[Node], score: np.ndarray) -> set[int]:
    """Ids of the nodes that are kept.

    A node is kept or cut; what is cut takes its whole subtree along, so no
    descendant of a cut node is kept. Of all such choices the one with the
    largest sum of weighted log-odds over the kept nodes is taken: a node with text
    of its own weighs by its length, one that only holds others by theirs.
    """
    score = np.clip(score, -6, 6).tolist()
    total: dict[int, float] = {}
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        weight = 1 + math.log1p(n.own) if n.own else 0.5 * (1 + math.log1p(n.chars)) if n.chars else 0.0
        total[id(n)] = score[k] * weight + sum(t for c in n.children if (t := total[id(c)]) > 0)
    kept: set[int] = set()
    for n in nodes:
        if n.parent is None or (id(n.parent) in kept and total[id(n)] > 0):
            kept.add(id(n))
    return kept


def text_from(root: Node, kept: set[int]) -> str:
    blocks: list[str] = []

    def close(line: list[str]) -> None:
        block = _SPACE.sub(" ", "".join(line)).strip()
        if block:
            blocks.append(block)
        line.clear()

    # a stack of our own: pages may nest deeper than calls can
    todo: list[tuple[Iterator, list[str]]] = [(iter(root.parts), [])]
    while todo:
        parts, line = todo[-1]
        for part in parts:
            if isinstance(part, str):
                line.append(part)
                continue
            close(line)
            if id(part) in kept:
                todo.append((iter(part.parts), []))
                break
        else:
            close(line)
            todo.pop()
    return "\n".join(blocks)


# -- labelled pages ------------------------------------------------------------

# What authors call the parts of their pages; only the generator of labelled pages reads these.
_SIDE_NAMES = "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus follow foot footer form gdpr head header legal login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
_MAIN_NAMES = "article articleBody body content entry main page post story text prose read section block".split()
_PLAIN_NAMES = "wrap wrapper container inner outer row col grid box left right top unit module item cell panel layer clearfix".split()
_TWISTS = ("{m} {s}-less", "{m} no-{s}", "{m} has-{s}", "{m} with-{s}", "{m}-of-{s}", "story {s}-of-{m}", "{m} without{S}")


def generated_pages(count: int = TRAIN_PAGES, seed: int = 3) -> Iterator[str]:
    """Pages of varied layouts; what is main text bears ``data-main``.

    What a part is was decided before it is named or marked up: main text may
    stand in plain boxes or in ones with misleading names, and menus, notices,
    adverts, forms and comments in boxes without a name.
    """
    rng = np.random.default_rng(seed)
    letters = np.array(list("aaabcdeeefghiiijklmnooopqrstuuvwxyz"))
    vocabulary = ["".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(400)]
    pick = lambda x: x[rng.integers(len(x))]

    def words(a: int, b: int) -> str:
        return " ".join(pick(vocabulary) for _ in range(rng.integers(a, b)))

    def prose(a: int, b: int) -> str:
        return " ".join(words(4, 22).capitalize() + pick([".", ".", ".", "!", "?"]) for _ in range(rng.integers(a, b)))

    def links(a: int = 1, b: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(rng.integers(a, b))) + "</ul>"

    def named(name: str) -> str:
        form = pick([name, name, f"{name} x", f"site-{name}", f"{name}-box", f"main{name.capitalize()}", f"c{rng.integers(99)} {name}"])
        return f' {pick(["class", "class", "id"])}="{form}"'

    def side(inside: bool) -> str:
        kind = pick(["menu", "notice", "advert", "form", "links", "foot", "comments"])
        name = pick(_SIDE_NAMES)
        bodies = {
            "menu": links(), "links": f"<h3>{words(1, 4)}</h3>{links()}", "notice": pick([words(3, 30), f"<p>{prose(1, 3)}</p>"]), "advert": pick([prose(1, 4), f"<p>{prose(1, 3)}</p>", words(2, 25)]),
            "form": f'<label>{words(1, 4)}</label><input name="q"><button>{words(1, 3)}</button>', "foot": f"&copy; {words(1, 8)} {pick([links(), prose(1, 3)])}",
            "comments": "".join(f"<div>{words(1, 3)}<p>{prose(1, 4)}</p></div>" for _ in range(rng.integers(1, 5))),
        }
        element = {"menu": ["nav", "div", "ul", "header", "menu"], "links": ["aside", "div", "section"], "notice": ["div", "p", "section", "aside"], "advert": ["div", "div", "section", "aside", "p"], "form": ["form", "form", "div"], "foot": ["footer", "footer", "div"], "comments": ["section", "div"]}
        tag = pick(element[kind])
        # a part without a telling element or name inside the article could not be told from it
        bare = tag not in ("div", "p", "section", "ul") and rng.random() < 0.6 or not inside and kind != "comments" and rng.random() < 0.25
        attribute = "" if bare else named("comments" if kind == "comments" else name)
        if bare and tag in ("div", "section") and rng.random() < 0.6:
            attribute = named(pick(_PLAIN_NAMES))
        return f"<{tag}{attribute}>{bodies[kind]}</{tag}>"

    def heading() -> str:
        h = f"<h1 data-main>{words(2, 12)}</h1>"
        return pick([h, h, f"<header>{h}</header>", f'<div class="{pick(_PLAIN_NAMES)}">{h}</div>', f"<header>{h}<p data-main>{prose(1, 2)}</p></header>"])

    def block() -> str:
        return pick([
            f"<p data-main>{prose(1, 6)}</p>", f"<p data-main>{prose(2, 9)}</p>", f"<p data-main><b>{words(1, 4)}</b> {prose(1, 4)}<br>{words(2, 9)}", f"<h2 data-main>{words(1, 6)}</h2><p data-main>{prose(1, 5)}</p>",
            "<ul>" + "".join(f"<li data-main>{words(2, 20)}</li>" for _ in range(rng.integers(1, 6))) + "</ul>", f"<blockquote><p data-main>{prose(1, 3)}</p></blockquote>", f"<div data-main>{prose(1, 5)}</div>",
            f"<p data-main>{words(1, 9)}</p>", f'<table><tr><td data-main>{words(1, 4)}</td><td data-main>{words(1, 4)}</td></tr></table>', f'<figure><img src="x"><figcaption data-main>{words(2, 12)}</figcaption></figure>', f'<p data-main>{prose(1, 3)} <a href="/y">{words(1, 3)}</a> {prose(1, 3)}</p>',
        ])

    for _ in range(count):
        body = [heading()] if rng.random() < 0.9 else []
        for _ in range(rng.integers(1, 10) if rng.random() < 0.8 else 1):
            body.append(block())
            if rng.random() < 0.12:
                body.append(side(True))
        if rng.random() < 0.35:
            tag = pick(["div", "section"])
            body.append(f"<{tag}{named('comments')}>" + "".join(pick([f"<p>{prose(1, 4)}</p>", f"<p>{words(1, 9)}</p>"]) for _ in range(rng.integers(1, 5))) + f"</{tag}>")
        main, other = pick(_MAIN_NAMES), pick(_SIDE_NAMES)
        twist = pick(_TWISTS).format(m=main, s=other, S=other.capitalize())
        shell = pick([
            "<article>%s</article>", "<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", f"<div{named(main)}>%s</div>", f'<div class="{pick(_PLAIN_NAMES)}">%s</div>', "<div>%s</div>", "%s",
            f'<article class="{twist}">%s</article>', f'<div class="{twist}">%s</div>', f'<main><section class="{twist}">%s</section></main>', f'<div id="{pick(_PLAIN_NAMES)}"><div class="{main}">%s</div></div>',
        ])
        page = "".join(side(False) for _ in range(rng.integers(0, 4))) + shell.replace("%s", "".join(body)) + "".join(side(False) for _ in range(rng.integers(0, 4)))
        yield page if rng.random() < 0.7 else f'<div class="{pick(_PLAIN_NAMES)}">{page}</div>'


def labels_of(nodes: list[Node]) -> np.ndarray:
    """Whether a node is, or holds, something that bears ``data-main``."""
    main: set[int] = set()
    for n in reversed(nodes):
        if n.mark or id(n) in main:
            main.add(id(n))
            if n.parent:
                main.add(id(n.parent))
    return np.array([id(n) in main for n in nodes], float)


def _beliefs(pages: list[tuple[list[Node], np.ndarray]]) -> dict[str, float]:
    """Log-odds that a node with the token is main text, drawn to 0 where few nodes have it."""
    seen: dict[str, list[float]] = {}
    for nodes, labels in pages:
        for n, y in zip(nodes, labels, strict=True):
            for t in tokens_of(n):
                c = seen.setdefault(t, [0.0, 0.0])
                c[int(y)] += 1
    return {t: math.log((c[1] + 2) / (c[0] + 2)) for t, c in seen.items() if c[0] + c[1] >= 3}


@functools.cache
def fitted(train_pages: int = TRAIN_PAGES, seed: int = 3) -> tuple[Trees, dict[str, float]]:
    """The trees and the tokens' log-odds, from generated pages.

    The trees see each half of the pages through log-odds learnt on the other
    half, so they learn how far to trust names that are new.
    """
    pages = [(nodes, labels_of(nodes)) for page in generated_pages(train_pages, seed) for nodes in [nodes_of(parsed(page))]]
    halves = pages[::2], pages[1::2]
    xs, ys = [], []
    for one, two in (halves, halves[::-1]):
        beliefs = _beliefs(two)
        for nodes, labels in one:
            if nodes[1:]:
                xs.append(np.array(features_of(nodes, beliefs)[1:], float))
                ys.append(labels[1:])
    return fit(np.concatenate(xs), np.concatenate(ys), rounds=40, depth=5, rate=0.25), _beliefs(pages)


def main_texts(pages: list[str | None], trees: Trees, beliefs: dict[str, float]) -> Iterator[str]:
    """The main text of each page, in order; nodes of many pages are scored at once."""
    held: list[tuple[Node, list[Node]]] = []
    rows: list[tuple] = []

    def told() -> Iterator[str]:
        score = trees.score(np.array(rows, float))
        at = 0
        for root, nodes in held:
            yield text_from(root, decoded(nodes, score[at : at + len(nodes)]))
            at += len(nodes)
        held.clear()
        rows.clear()

    for page in pages:
        root = parsed(page or "")
        nodes = nodes_of(root)
        held.append((root, nodes))
        rows += features_of(nodes, beliefs)
        if len(rows) >= SCORED:
            yield from told()
    if held:
        yield from told()


def extracted(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    ``text`` is the whole main text: a block per line, white space inside a
    block as one space, character references decoded; empty where a page has
    none or its html is null or empty. ``n_chars`` counts code points. Repeated
    pages give repeated rows, an empty table none; other columns are not read.
    The trees and the tokens' log-odds are sent to the tasks; their size does not
    depend on the pages.
    """
    trees, beliefs = fitted(train_pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(main_texts(b["html"], trees, beliefs))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
