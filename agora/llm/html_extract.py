"""Main text of web pages by tree scoring.

A page is read once into a small tree: containers, and blocks of running text
in them. What can hold no article text is left out while reading: scripts,
styles, forms, navigation, page headers and footers, asides, and containers
whose class, id or role names an advert, notice, menu, sidebar or reader
comments (word lists below). Every block then passes points to its ancestors:
its length and commas, whole to its container, half to the next, less further
up; an article element starts with a bonus, and every container's points are
discounted by the share of its text inside links. The best container is kept,
and with it those siblings that score a fifth of it or are plain prose. Their
blocks, in page order, are the text: character references decoded, white space
inside a block made one space, blocks joined by a line feed.

Broken markup does no harm: unclosed paragraphs and cells end at the next
block, stray end tags are ignored, a page may end anywhere. A page without
markup is one block. Null or empty html: empty text. Repeated rows give one
row each; null ids and urls stay null; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import map_batches, strings

# HTML's element kinds, and the words that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select button "
                "canvas audio video noframes".split())
NOT_ARTICLE = frozenset("nav footer aside form dialog menu fieldset".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt "
                  "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
                  "legend li main menu nav ol optgroup option p pre search section summary table tbody td "
                  "tfoot th thead tr ul".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd td th caption figcaption summary".split())
KEEP = frozenset("html body head main".split())
NOISE = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb "
                  "breadcrumbs comment comments commentlist consent cookie cookies copyright discussion "
                  "disqus footer gdpr header hidden login masthead menu modal nav navbar navigation notice "
                  "notices newsletter overlay pager pagination popup popover promo promotion promoted "
                  "related recommended reply replies respond share sharing sidebar signup social sponsor "
                  "sponsored subscribe toolbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu "
                  "menubar toolbar".split())
#: Noise words of reader comments: such an element is never spared for its size.
TALK = frozenset("comment comments commentlist discussion disqus reply replies respond".split())
GOOD = frozenset("article content entry main post story text".split())

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)",
                   re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                   re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMA = re.compile("[,،、，;]")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "named", "talk", "score", "chars", "linked", "size")

    def __init__(self, tag: str, parent, noise: bool, bonus: float = 0.0, named: bool = False, talk: bool = False):
        self.tag, self.parent, self.noise, self.score = tag, parent, noise, bonus
        self.named, self.talk = named, talk  # noise by its class or id (or a form); by a word of reader comments
        self.children: list = []
        self.chars = self.linked = self.size = 0
        if parent is not None:
            parent.children.append(self)


def judge(tag: str, attributes: str, inside_article: bool) -> tuple[bool, float, bool, bool]:
    """Of a container: surely no article text in here, starting points, noise by name, and by one of comments."""
    bonus = {"article": 25.0, "main": 10.0, "section": 1.0}.get(tag, 0.0)
    if tag == "form":
        return False, 0.0, True, False
    if tag in NOT_ARTICLE or tag == "header" and not inside_article:
        return True, 0.0, False, False
    if tag in KEEP or not attributes:
        return False, bonus, False, False
    words: set[str] = set()
    for name, *values in _ATTR.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            words.update(_TOKEN.findall(_CAMEL.sub(" ", value).lower()))
        elif name == "role" and value.lower() in ROLES or name == "hidden" and tag not in LEAF:
            return True, 0.0, False, False
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and _INVISIBLE.search(value):
            return True, 0.0, False, False
    noise = words & NOISE
    if inside_article or tag == "article":  # an article's own heading block is part of it
        noise -= {"header", "banner", "hidden"}
        if len(words) > 1 and not noise - {"discussion"}:  # a section on the discussion of something
            noise -= {"discussion"}
    return False, bonus + 5.0 * bool(words & GOOD), bool(noise), bool(noise & TALK)


def spare(root: Node) -> None:
    """Settle which named containers are noise: not those that hold ``main``, an article with a quarter of the
    page's text, or half of the text themselves (a paragraph at least), unless they are reader comments; all, if nothing is left."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and not c.noise)
    holds: dict[int, tuple[bool, int]] = {}  # main inside; size of the largest article inside
    for node in reversed(order):
        main, largest = False, 0
        for child in node.children:
            if not isinstance(child, Node):
                node.size += len(child[0])
            elif not child.noise:
                node.size += child.size
                inner = holds[id(child)]
                main, largest = main or inner[0], max(largest, inner[1])
        holds[id(node)] = (main or node.tag == "main", max(largest, node.size if node.tag == "article" else 0))
    total = root.size
    for node in order:
        if node.named and not node.talk:
            main, largest = holds[id(node)]
            node.named = not (main or 4 * largest >= total or 2 * node.size >= max(total, 100))
    left, todo = 0, [root]
    while todo and not left:
        node = todo.pop()
        left += sum(not isinstance(c, Node) for c in node.children)
        todo.extend(c for c in node.children if isinstance(c, Node) and not c.noise and not c.named)
    if left:
        for node in order:
            node.noise = node.noise or node.named


def parse(page: str) -> Node:
    """The page's containers; a child that is a (text, linked characters) pair is a block."""
    root = node = Node("html", None, False)
    stack: list[tuple[str, Node]] = []  # open elements and the container outside each
    parts: list[str] = []
    links = linked = at = articles = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            if not node.noise and (text := " ".join(html_lib.unescape("".join(parts)).split())):
                node.children.append((text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal node, links, articles
        while len(stack) > depth:
            name, outside = stack.pop()
            links -= name == "a"
            articles -= name in ("article", "main")
            node = outside

    end, find = len(page), _MARK.search
    while at < end:
        mark = find(page, at)
        text = page[at:mark.start() if mark else end]
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if not mark:
            break
        at = mark.end()
        if not mark[2]:
            continue
        tag, closing = mark[2].lower(), bool(mark[1])
        if tag in RAW:
            if not closing and not mark[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK:
                    break  # an inline end tag does not close blocks
            continue
        if tag in BLOCK:
            for depth in range(len(stack) - 1, -1, -1):  # an open paragraph ends here, with what is in it
                if stack[depth][0] == "p":
                    close(depth)
                if stack[depth:] and stack[depth][0] in BLOCK:
                    break
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                peers = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                if stack and stack[-1][0] in peers:
                    close(len(stack) - 1)
        stack.append((tag, node))
        links += tag == "a"
        if tag in BLOCK and tag not in ("html", "head"):
            noise, bonus, named, talk = judge(tag, mark[3], articles > 0)
            if tag not in LEAF or noise or named:
                node = Node(tag, node, node.noise or noise, bonus, named, talk)
        articles += tag in ("article", "main")
    flush()
    spare(root)
    return root


def walk(node: Node):
    """Blocks of a container in page order, without recursion."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if not x.noise:
                todo.extend(reversed(x.children))
        else:
            yield x[0]


def best_containers(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and not c.noise)
    for node in order:
        for child in node.children:
            if isinstance(child, Node):
                continue
            text, linked = child
            points = min(len(text) / 50.0, 6.0) + len(_COMMA.findall(text)) + (len(text) >= 25)
            up, share = node, 1.0
            while up is not None:
                up.score += points * share
                up.chars += len(text)
                up.linked += linked
                level = 1 if share == 1.0 else level + 1
                up, share = up.parent, (0.5 if level == 1 else 1.0 / (3 * level))
    scored = [(n.score * (1.0 - n.linked / n.chars), -i, n) for i, n in enumerate(order) if n.chars]
    if not scored:
        return []
    top, _, best = max(scored, key=lambda x: x[:2])
    whole = best
    while whole is not None and whole.tag != "article":
        whole = whole.parent
    if whole is not None:  # an article is read whole, its short sections too
        best = whole
    if best.parent is None:
        return [best]
    value = {id(n): s for s, _, n in scored}
    kept = []
    for child in best.parent.children:
        if child is best:
            kept.append(child)
        elif isinstance(child, Node):
            if not child.noise and value.get(id(child), 0.0) >= max(10.0, 0.2 * top):
                kept.append(child)
        elif len(child[0]) >= 80 and child[1] * 4 < len(child[0]):
            kept.append(child)
    return kept


def main_text(page: str | None) -> str:
    """The page's article, one block per line; '' if there is none."""
    if not page:
        return ""
    kept = best_containers(parse(page))
    return "\n".join(t for k in kept for t in (walk(k) if isinstance(k, Node) else [k[0]]))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``df``."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                      F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("text"))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) for h in strings(batch.column("text"))]
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
        return run
    return map_batches(pages, make, SCHEMA)
