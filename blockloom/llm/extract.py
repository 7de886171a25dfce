"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A linear classifier gives each block evidence for content or for boilerplate: 
its sign and size are the capacity to one of two terminals.  Neighbours in the page are tied to each other,
more strongly the closer they are in the tree, and so are the nearest blocks of one container with others between.  The maximum flow between the terminals is the cheapest
labelling; blocks on the content side, in page order, are the text.

Blocks next to each other with one container and the same sign are one node, so a page has about as many
nodes as it has regions.  Null and empty pages, and pages without content, give an empty text.
Unclosed and stray tags are taken as browsers do: a block tag ends an open paragraph, an end tag closes
all that is open inside it.  A tag without a `>` after it is text.  Whole pages of any length are read, in time
about linear in their length.  Rows repeat as they come; other columns are not looked at.
"""

from __future__ import annotations

import collections
import html
import math
import re
from collections import deque
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noembed noframes svg select".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
BOILER_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
gdpr notice notices alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar
toolbar pager pagination comment comments respond reply replies discussion disqus share sharing social related recommended
newsletter subscribe subscription signup login search widget widgets toc tags copyright legal disclaimer skip""".split())
CONTENT_WORDS = frozenset("article articles post entry story content main body text".split())
#: Weights of the classifier, in log-odds for content.
WEIGHTS = {"bias": -0.6, "article": 4.0, "content_name": 1.5, "boiler": -8.0, "header": -5.0, "length": 0.45, "links": -3.0, "stop": 0.7, "heading": 0.8}
ADJACENT, NEARER = 0.3, 0.6  # capacity between neighbours, and on top where they have one container
APART = 0.3                  # capacity between the nearest two of one container that are not neighbours
LEAST = 1e-9                 # capacities below are none
# a quote that nothing closes is part of its tag, which ends at the next > then
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+(?=>)|[^>]*)>""", re.S)
UNCLOSED = re.compile(r"<[!?].*", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=\s|/|$))""", re.I)
NAME = re.compile(r"[a-z]+")


def _boiler_name(value: str, tag: str) -> bool:
    """Whether a class or id names boilerplate.

    `article-footer` does.  Beside a name of content (`post tag-social`, or the tag itself) only a name
    that is nothing else does (`comment-7`): the rest tell of topics and layout.
    """
    names = [set(NAME.findall(name)) for name in value.split()]
    if tag in ("article", "main") or any(n and n <= CONTENT_WORDS for n in names):
        return any(n and n <= BOILER_WORDS for n in names)
    return any(n & BOILER_WORDS and not (n & CONTENT_WORDS and n & {"with", "has", "no", "left", "right"}) for n in names)


class Element:
    __slots__ = ("tag", "parent", "depth", "boiler", "article", "named", "header")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        # `main` can't be part of a menu or sidebar, whatever the names around it
        self.boiler = bool(parent and parent.boiler and tag != "main") or tag in BOILER_TAGS
        self.article = bool(parent and parent.article) or tag in ("article", "main")
        self.header = (bool(parent and parent.header) or tag == "header") and not (tag in ("article", "main"))
        self.named = bool(parent and parent.named)
        if attributes and tag not in ("html", "body"):
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id"):
                    own = _boiler_name(value, tag)
                    self.boiler |= own
                    self.named |= bool(set(NAME.findall(value)) & CONTENT_WORDS) and not own
                elif name == "role":
                    self.boiler |= value in BOILER_ROLES
                    self.article |= value in ("main", "article")
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    self.boiler = True


class Block:
    __slots__ = ("text", "element", "links")

    def __init__(self, text: str, element: Element, links: float):
        self.text, self.element, self.links = text, element, links


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    top = Element("#", "", None)
    stack = [top]
    opened: collections.Counter = collections.Counter()
    parts: list[str] = []
    linked = [0, False]  # characters inside links of this block, and whether a link is open

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1], min(1.0, linked[0] / len(text))))
        parts.clear()
        linked[0], linked[1] = 0, False

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if linked[1]:
                linked[0] += len(text)

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        found = (TOKEN if at <= last else UNCLOSED).search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at: found.start()])
        at = found.end()
        if found.re is UNCLOSED or not found[2]:
            continue
        slash, tag = found[1], found[2].lower()
        if tag in RAW and not slash:
            # what is inside isn't text of the page; without an end tag the rest is inside
            if found[3].endswith("/") and tag in ("svg", "math", "object"):
                continue
            shut = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = shut.end() if shut else end
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            linked[1] = not slash
        elif tag in BLOCK:
            close()
            if slash:
                shut = not opened[tag]
                while not shut:
                    shut = stack[-1].tag == tag
                    opened[stack.pop().tag] -= 1
            else:
                if stack[-1].tag == "p" or (stack[-1].tag == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th")):
                    opened[stack.pop().tag] -= 1
                if tag not in VOID:
                    stack.append(Element(tag, found[3], stack[-1]))
                    opened[tag] += 1
    close()
    return out


def evidence(block: Block) -> float:
    """Log-odds for content."""
    w, e, text = WEIGHTS, block.element, block.text
    z = w["bias"] + w["length"] * math.log1p(len(text) / 20) + w["links"] * block.links
    z += w["article"] * e.article + w["content_name"] * e.named + w["boiler"] * e.boiler
    z += w["header"] * (e.header and not e.article)
    z += w["stop"] * (text[-1] in ".!?:;\"'”’)…") + w["heading"] * (e.tag in ("h1", "h2"))
    return z


def _container(e: Element) -> Element:
    return e.parent if e.parent is not None and e.tag != "#" else e


def _apart(a: Element, b: Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        steps += 1
    return steps


def source_side(capacity: list[dict[int, float]], source: int, sink: int) -> set[int]:
    """Nodes on the source's side of a minimum cut: a blocking flow over shortest paths, level graph by level graph."""
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in capacity[u].items():
                if c > LEAST and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level)
        onward = {u: [v for v in capacity[u] if level.get(v) == level[u] + 1] for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(capacity[a][b] for a, b in pairwise(path))
                full = len(path)
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    capacity[a][b] -= flow
                    capacity[b][a] = capacity[b].get(a, 0.0) + flow
                    if capacity[a][b] <= LEAST:
                        full = k
                del path[full + 1:]
            elif not onward[u]:
                path.pop()
                if path:
                    onward[path[-1]].pop()
            elif capacity[u][onward[u][-1]] > LEAST:
                path.append(onward[u][-1])
            else:
                onward[u].pop()


def graph(found: list[Block]) -> tuple[list[int], list[dict[int, float]]]:
    """The node of each block, and the capacities; the last two nodes are the terminals, content first."""
    score = [evidence(b) for b in found]
    node, nodes, place = [0], [score[0]], [found[0].element]
    for i in range(1, len(found)):
        if _container(found[i].element) is _container(found[i - 1].element) and (score[i] > 0) == (score[i - 1] > 0):
            nodes[-1] += score[i]
        else:
            nodes.append(score[i])
            place.append(found[i].element)
        node.append(len(nodes) - 1)
    n = len(nodes)
    capacity: list[dict[int, float]] = [{} for _ in range(n + 2)]
    nearest: dict[Element, int] = {}
    for i, z in enumerate(nodes):
        if z > 0:
            capacity[n][i], capacity[i][n] = z, 0.0
        else:
            capacity[i][n + 1], capacity[n + 1][i] = -z, 0.0
        if i:
            same = _container(place[i]) is _container(place[i - 1])
            tie = ADJACENT + (NEARER if same else NEARER / (2 + _apart(place[i], place[i - 1])))
            capacity[i][i - 1] = capacity[i - 1][i] = tie
        before = nearest.get(_container(place[i]), i)
        if before < i - 1:
            capacity[i][before] = capacity[before][i] = APART
        nearest[_container(place[i])] = i
    return node, capacity


def label(found: list[Block]) -> list[bool]:
    """Which blocks are content."""
    if not found:
        return []
    node, capacity = graph(found)
    content = source_side(capacity, len(capacity) - 2, len(capacity) - 1)
    return [k in content for k in node]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, kept in zip(found, label(found)) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every whole page."""

    @F.pandas_udf("text string, n_chars long")
    def run(pages: pd.Series) -> pd.DataFrame:
        texts = [main_text(p) for p in pages]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", run(F.col("html").cast("string")).alias("m")).select("page_id", "url", "m.text", "m.n_chars")
