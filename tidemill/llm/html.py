"""Main text of web pages by a tree-structured graphical model.

Each element of a page is a node with a hidden label, content or not. A node's label depends on its parent's label (the
parent-child potential, by the kind of the child) and gives rise to what is seen of the node: its tag, the cue words of
its class, id and role, the amount of its text and the share of it that stands in links. One pass of sum-product
messages from the leaves to the root and one back give every node's exact marginal. The potentials are relative
frequencies in labelled pages, which may be the ones below or the caller's own.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import words

# Fixed values of HTML: elements without content, with raw text, that are blocks, and that end an open one of their like.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol menu dl table tbody thead tfoot select html body".split())  # an open element is not ended across these
# Cue words of class, id and role, as they stand between separators.
FOR = frozenset("article articlebody blog body content copy entry hentry main page post prose story text".split())
AGAINST = frozenset(
    "ad ads adv advert advertisement alert aside banner breadcrumb breadcrumbs button byline comment comments complementary consent contentinfo cookie cookies "
    "disqus foot footer form gdpr head header hidden login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup print promo "
    "promoted recommended related reply response responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar top widget".split()
)
CONTAINERS = frozenset("article aside body div footer form header html main nav section table".split())
TEXTS = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_CLOSES = {tag: re.compile(rf"</{tag}(?![^\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")
_CUED = re.compile(r"class|id=|role", re.IGNORECASE)
MARK = "data-content"

#: Labelled pages: data-content says what an element and all below it are, until an inner one says otherwise.
LABELLED = (
    """<html><head><title>t</title></head><body><header><a href=x>Site</a></header><nav><ul><li><a href=x>Home</a></li><li><a href=x>News</a></li></ul></nav>
    <article data-content=1><h1>A heading of the story</h1><p>A first paragraph with a good number of words, long enough to read like one.</p><p>Short one.</p>
    <blockquote><p>Words that somebody else has said and that are quoted here.</p></blockquote><h2>More</h2><ul><li>one point of a list</li><li>another point</li></ul></article>
    <aside><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></aside><footer><p>All rights reserved by the site.</p><a href=x>Imprint</a></footer></body></html>""",
    """<html><body><div class=navbar><a href=x>Start</a> <a href=x>Blog</a></div><div class=cookie-notice><p>We use cookies to make this site work better for you.</p><button>OK</button></div>
    <div id=content data-content=1><h1>Title of a post</h1><div class=post-body><p>The text of the post goes on for a while, with <a href=x>a link</a> and <b>bold words</b> in it.</p>
    <p>Then it ends.</p><div class=share-buttons data-content=0><a href=x>Share</a><a href=x>Tweet</a></div></div></div>
    <div class=sidebar><p>About the author, who writes for this site every now and then.</p></div>
    <div class=comments><h3>Comments</h3><div class=comment><p>I liked this very much and want to say so at some length here.</p></div><form><textarea></textarea><input></form></div>
    <div class=footer>Copyright by us, with a line of text that is not short at all.</div></body></html>""",
    """<html><body><div class=ad>Buy this now, it is cheap and it is good for you.</div><main data-content=1><section><h2>Part</h2><p>Body text of a part, which has several words more than a menu.</p>
    <table><tr><th>Name</th><td>value in a table</td></tr></table><figure><img src=x><figcaption>What the picture shows.</figcaption></figure><pre>code lines stand here</pre></section></main>
    <form class=newsletter><p>Subscribe to our letter and never miss a story again.</p><input><button>Send</button></form><section class=comments><ol><li><p>First! What a story this was.</p></li></ol></section></body></html>""",
    """<html><body><div id=header><h1><a href=x>The Site</a></h1></div><div id=menu><ul><li><a href=x>A</a></li><li><a href=x>B</a></li><li><a href=x>C</a></li></ul></div>
    <div class=entry data-content=1><p>Only paragraphs make up this entry, and each of them is of a fair length, as you see.</p><p>It has <i>two</i> of them, of which the second is also long enough.</p></div>
    <div class=related><p><a href=x>Something else to read</a></p></div><div id=footer><p>Contact and imprint of the site stand here as ever.</p></div></body></html>""",
    """<html><body><nav><a href=x>one</a><a href=x>two</a></nav><div class=ad>Some sponsored words of another kind.</div><article data-content=1><h1>Heading</h1><p><b>Bold start of a text<br></p>
    <p>A text that goes on after it, with enough words to be one of its own.</p><div class=ad data-content=0>Sponsored words inside of the story.</div><p>End.</p></article><footer>&copy; site and more words on it.</footer></body></html>""",
    """<html><body><header class=top><p>The daily words of a site, read by many since long ago.</p></header><main class=story data-content=1><p>A story of one paragraph that is long enough to be read as such by all.</p></main>
    <section id=comments><h2>Responses</h2><ol><li class=comment><p>What a fine story this was, and I have read a lot of them.</p></li><li class=comment><p>Agreed.</p><ol><li class=reply><p>And so do I, for what it is worth to you.</p></li></ol></li></ol></section>
    <section class=promo><h3>Offer</h3><p>Get three months for the price of one, but only for a while.</p><ul><li>cheap</li></ul></section></body></html>""",
    """<html><body><article data-content=1><p>One.</p></article><footer>&copy; site.</footer></body></html>""",
    """<html><body><nav><ul><li><a href=x>a</a></li></ul></nav><article data-content=1><h1>Short</h1><p>Short.</p></article><aside class=sidebar><p>Much longer words than the story itself has, all of them beside it.</p></aside><footer>f</footer></body></html>""",
    """<html><body><div><div data-content=1><h1>Plain heading</h1><p>A page without any names for its parts still has paragraphs of a fair length.</p><p>They follow each other as text does.</p></div>
    <div><a href=x>x</a> <a href=x>y</a> <a href=x>z</a></div></div></body></html>""",
)


class Node:
    """An element: its tag, parent (index, -1 for none), cue (-1, 0, 1), characters of text below it and in links, mark."""

    __slots__ = ("cue", "links", "mark", "parent", "size", "tag")

    def __init__(self, tag: str, parent: int, cue: int, mark: str) -> None:
        self.tag, self.parent, self.cue, self.mark, self.size, self.links = tag, parent, cue, mark, 0, 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """Elements in page order, and the page's text as (element, block number, text): pieces of one block run on."""
    nodes, texts, stack, block, end = [Node("html", -1, 0, "")], [], [0], 0, 0
    while match := _TOKEN.search(page, end):
        if match.start() > end:
            texts.append((stack[-1], block, page[end : match.start()]))
        end = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            block += tag in BLOCK
            continue
        if tag in RAW:
            if not match[3].endswith("/"):
                close = _CLOSES[tag].search(page, end)  # no tags or comments are read before it
                end = close.end() if close else len(page)
            continue
        if tag in VOID:
            block += tag == "hr"
            if tag == "br":
                texts.append((stack[-1], block, " "))
            continue
        if tag in BLOCK:
            block += 1
            likes = ENDS_LIKE.get(tag, ("p",) if tag not in ("html", "body") else ())
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag in likes or open_tag == "p":
                    del stack[k:]
                    break
                if open_tag in HOLDS or open_tag in CONTAINERS:
                    break
        cue, mark = 0, ""
        if match[3] and (MARK in match[3] or _CUED.search(match[3])):
            for name, *value in _ATTRIBUTE.findall(match[3]):
                value, name = "".join(value), name.lower()
                if name in ("class", "id", "role"):
                    for word in _WORD.findall(value.lower()):
                        cue = -1 if cue < 0 or word in AGAINST else 1 if word in FOR else cue
                elif name == MARK:
                    mark = value
        nodes.append(Node(tag, stack[-1], cue, mark))
        if not match[3].endswith("/") or tag in BLOCK:
            stack.append(len(nodes) - 1)
    if end < len(page):
        texts.append((stack[-1], block, page[end:]))
    for at, _, text in texts:
        nodes[at].size += len(text.strip())
    for i in range(len(nodes) - 1, 0, -1):
        node = nodes[i]
        if node.tag == "a":
            node.links = node.size
        nodes[node.parent].size += node.size
        nodes[node.parent].links += node.links
    return nodes, texts


def _kind(tag: str) -> str:
    return "container" if tag in CONTAINERS else "text" if tag in TEXTS else "other" if tag in BLOCK else "inline"


def _seen(node: Node) -> tuple[tuple[str, object], ...]:
    share = node.links / node.size if node.size else 0.0
    return ("tag", node.tag), ("cue", node.cue), ("size", (node.size > 0) + (node.size > 25) + (node.size > 80)), ("links", (share > 0) + (share > 0.3) + (share > 0.7))


#: Distinct values that each observation is smoothed over.
_VALUES = {"tag": 60, "cue": 3, "size": 4, "links": 4}


class Model:
    """Counts of labelled pages: seen[name, value, label], labels[label], steps[kind, parent's label, label]."""

    def __init__(self, pages: tuple[str, ...] = LABELLED) -> None:
        self.seen, self.labels, self.steps = Counter(), Counter(), Counter()
        for page in pages:
            nodes, _ = parse(page)
            labels: list[int] = []
            for node in nodes:
                labels.append(int(node.mark) if node.mark else labels[node.parent] if node.parent >= 0 else 0)
                self.labels[labels[-1]] += 1
                for name, value in _seen(node):
                    self.seen[name, value, labels[-1]] += 1
                if node.parent >= 0:
                    self.steps[_kind(node.tag), labels[node.parent], labels[-1]] += 1
        self._local: dict[tuple, tuple[float, float]] = {}

    def local(self, node: Node) -> tuple[float, float]:
        """Likelihoods of what is seen of a node under either label, the greater being 1."""
        key = _seen(node)
        if key not in self._local:
            logs = [sum(log((self.seen[name, value, y] + 0.3) / (self.labels[y] + 0.3 * _VALUES[name])) for name, value in key) for y in (0, 1)]
            self._local[key] = tuple(exp(x - max(logs)) for x in logs)
        return self._local[key]

    def step(self, kind: str, parent: int, label: int) -> float:
        """Probability of a child's label, given its kind and its parent's label."""
        n = [self.steps[kind, parent, y] + 0.5 for y in (0, 1)]
        return n[label] / sum(n)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of being content, by sum-product; the root is not content."""
        steps = {k: [[self.step(k, p, y) for y in (0, 1)] for p in (0, 1)] for k in ("container", "text", "other", "inline")}
        kinds = [steps[_kind(x.tag)] for x in nodes]
        below = [list(self.local(x)) for x in nodes]  # local evidence times the messages of the children
        up: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            (a, b), s = below[i], kinds[i]
            m0, m1 = s[0][0] * a + s[0][1] * b, s[1][0] * a + s[1][1] * b
            up[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
            parent = below[nodes[i].parent]
            p0, p1 = parent[0] * up[i][0], parent[1] * up[i][1]
            parent[0], parent[1] = p0 / (p0 + p1), p1 / (p0 + p1)
        out, down = [0.0] * len(nodes), [(1.0, 0.0)] * len(nodes)
        for i in range(1, len(nodes)):
            at, s = nodes[i].parent, kinds[i]
            c0, c1 = (down[at][y] * below[at][y] / up[i][y] for y in (0, 1))  # the parent without this child
            d0, d1 = c0 * s[0][0] + c1 * s[1][0], c0 * s[0][1] + c1 * s[1][1]
            down[i] = (d0 / (d0 + d1), d1 / (d0 + d1))
            b0, b1 = down[i][0] * below[i][0], down[i][1] * below[i][1]
            out[i] = b1 / (b0 + b1)
        return out

    def extract(self, page: str | None) -> str:
        """The blocks of main text, joined by line feeds; white space inside a block is one space."""
        if not page:
            return ""
        nodes, texts = parse(page)
        content = self.marginals(nodes)
        holder = list(range(len(nodes)))  # the nearest block element
        for i in range(1, len(nodes)):
            if nodes[i].tag not in BLOCK:
                holder[i] = holder[nodes[i].parent]
        blocks: dict[int, list[str]] = {}
        for at, block, text in texts:
            if content[holder[at]] >= 0.5:
                blocks.setdefault(block, []).append(text)
        found = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
        return "\n".join(x for x in found if x)


def extract(pages: DataFrame, labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) of every row of pages.

    Null or empty html, and pages without content, give the empty text. Broken markup is read as far as it goes: unclosed
    elements end with the one around them, stray end tags are passed over, a comment or script that doesn't end takes the
    rest. Equal pages give equal texts; other columns are not read.
    """
    model = Model(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches, "html"):
            texts = [model.extract(x) for x in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
