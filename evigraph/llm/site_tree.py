"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree whose elements are boxes (div, section, article, ..., and lists of links only), told apart by
their path of tags with class and id and, where these say nothing, by their place among their siblings, counted from the first and
from the last. Paragraphs, headings, lists and tables are no boxes: they are the contents of the box that they stand in. So a paragraph
that many articles of a host share stays at any size, as it is a part of a box whose contents differ.

A box's importance is an entropy of its presentations (the tags in it, in order) or of its contents (its blocks of text), whichever is
higher. Over n_i pages with item i out of m pages with the box and T occurrences, it is the lower of 1 - sum(n_i ln n_i) / (T ln m), which is the
entropy to the base of the pages, and of D / T, the share that the entropy of order 0 leaves distinct: a box that repeats one
text has neither, and a pool of rotating adverts has a low second one. Both are shares, alike for 2,000 and for 20,000 pages of the same kind.
Pages of a host with the same text count as one, so copies of an article are no evidence against it; a box that one page alone has
counts as important.

On each page the box with the most text, weighed by importance unless markup declares the article, is its main one, and boxes under THRESHOLD times the main one's importance
are removed; so no page loses all its text. What markup declares to be no content (scripts, forms, menus, asides, hidden parts) is
removed before; a declared article or main element bounds the page, and its own blocks always stay. Class and id words that name
something beside the article multiply the importance of a box by MARKED: reader comments differ on every page, so only their names tell.

Counts are deduplicated and summed before and after one shuffle by box and item, so a host with a third of all pages costs no more than its
distinct items. Importances are written as sorted arrays into the shared folder, and tasks map those files: nothing is broadcast and no
page is moved.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import keyed, keyed_at, tidy

#: Boxes under this share of the importance of their page's main box are removed.
THRESHOLD = 0.3
#: Factor of importance for boxes that are named as something beside the article.
MARKED = 0.1
#: Importances from here on count as 1 and are not kept.
HIGH = 0.9
COUNTS = "node long, kind byte, item long, page long"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
#: Never part of an article.
_DROP = frozenset("script style noscript iframe template head title nav header footer aside form button select option input textarea label menu dialog svg canvas object".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSED_BY = {
    **{t: frozenset({"p"}) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
#: Elements that may be boxes of the style tree; lists are where all their text is in links.
_BOXES = frozenset("#root html body div section article main center".split())
_LISTS = frozenset("ul ol".split())
_SCOPE = {"li": frozenset({"ul", "ol"}), "tr": frozenset({"table"}), "td": frozenset({"tr", "table"}), "th": frozenset({"tr", "table"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"})}
#: Words of a class, id or role that name something beside the article.
_BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar\w*|aside|widget\w*|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|reply|related|recommended|pagination|pager|toolbar|search|copyright|legal|disclaimer|skip|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_MARK = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)


class Node:
    """An element with its children and texts in order; ``beside`` is what markup declares as no content, ``marked`` what names suggest."""

    __slots__ = ("tag", "name", "beside", "marked", "children")

    def __init__(self, tag: str, name: str, beside: bool, marked: bool):
        self.tag, self.name, self.beside, self.marked, self.children = tag, name, beside, marked, []


def _element(tag: str, attributes: str) -> Node:
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _MARK.finditer(attributes)} if attributes.strip() else {}
    marks = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    names = re.sub(r"[0-9]+", "#", marks)
    return Node(tag, f"{tag}.{names}" if names and tag not in ("html", "body") else tag, hidden or tag in _DROP, tag not in ("html", "body", "article", "main") and bool(_BESIDE.search(marks)))


def tree(page: str | None) -> Node:
    """The elements and texts of a page; end tags that are missing are put where HTML implies them."""
    root = Node("#root", "#root", False, False)
    stack, at, page = [root], 0, page or ""
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m.group().startswith("<![CDATA["):
                stack[-1].children.append(entities.escape(m.group()[9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _CLOSED_BY:
            _close(stack, _CLOSED_BY[tag], _SCOPE.get(tag, frozenset()))
        node = _element(tag, m[3])
        if tag == "header" and not node.marked and any(n.tag in ("article", "main") for n in stack):
            node.beside = False  # the article's own heading
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            if end:
                close = page.find(">", end.start())
                at = len(page) if close < 0 else close + 1
            else:
                at = len(page)
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tags: frozenset, scope: frozenset) -> None:
    """Close the innermost open element of ``tags`` with what formatting stands open in it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            if scope:
                _close(stack, tags, scope)
            return
        if stack[k].tag in scope or stack[k].tag not in _INLINE and not (scope and stack[k].tag in ("p", "div", "span")):
            return


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Box:
    """A box of one page: its numbers in the style tree by places from the first and from the last, and what stands in it itself."""

    __slots__ = ("from_first", "from_last", "fixed", "marked", "kinds", "size")

    def __init__(self, from_first: str, from_last: str, fixed: bool, marked: bool):
        self.from_first, self.from_last, self.fixed, self.marked, self.kinds, self.size = from_first, from_last, fixed, marked, [], 0

    def numbers(self, host: str) -> tuple[int, ...]:
        if self.fixed:
            return (0,)
        a = _hash(host, self.from_first)
        return (a,) if self.from_first == self.from_last else (a, _hash(host, self.from_last))


def _links_only(node: Node) -> bool:
    """Whether all text under a list is in links."""
    todo = list(node.children)
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            if c.strip():
                return False
        elif c.tag != "a":
            todo += c.children
    return True


def _flat(node: Node) -> bool:
    """Whether an element holds text and inline elements only."""
    todo = list(node.children)
    while todo:
        c = todo.pop()
        if not isinstance(c, str):
            if c.tag not in _INLINE:
                return False
            todo += c.children
    return True


def _is_box(node: Node, inside: bool) -> bool:
    """Inside a declared article a plain div that holds text only is a paragraph."""
    if node.tag in _LISTS:
        return _links_only(node)
    return node.tag in _BOXES and not (inside and node.name == "div" and _flat(node))


def _tops(root: Node) -> list[Node]:
    """The declared articles and main elements, of a main with articles these, in page order; none if nothing is declared."""
    tops: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main") and not node.beside:
            inner = [n for n in _below(node) if n.tag == "article"] if node.tag == "main" else []
            tops += inner or [node]
        else:
            todo += [c for c in reversed(node.children) if not isinstance(c, str) and not c.beside]
    return tops


def outline(page: str | None) -> tuple[list[Box], list[tuple[int, str]]]:
    """The boxes of a page and its blocks of text (number of the box, text) in page order."""
    root = tree(page)
    tops = _tops(root)
    boxes: list[Box] = []
    blocks: list[tuple[int, str]] = []
    run: list[str] = []

    def flush(box: int) -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                boxes[box].size += len(text)
                blocks.append((box, text))

    def places(node: Node, inside: bool) -> dict[int, tuple[str, str]]:
        """For each child that is a box its names by the place among its like."""
        own = [c for c in node.children if not isinstance(c, str) and not c.beside and c.tag not in _INLINE and _is_box(c, inside)]
        total: dict[str, int] = {}
        for c in own:
            total[c.name] = total.get(c.name, 0) + 1
        seen: dict[str, int] = {}
        out = {}
        for c in own:
            k = seen[c.name] = seen.get(c.name, 0) + 1
            out[id(c)] = (f"{c.name}+{k}", f"{c.name}-{total[c.name] + 1 - k}") if c.name == c.tag else (c.name, c.name)
        return out

    for top in tops or [root]:
        boxes.append(Box(f"/{top.name}", f"/{top.name}", bool(tops), False))
        inside = bool(tops)
        stack = [(iter(top.children), len(boxes) - 1, True, places(top, inside))]
        while stack:
            children, at, block, named = stack[-1]
            c = next(children, None)
            if c is None:
                stack.pop()
                if block:
                    flush(at)
            elif isinstance(c, str):
                run.append(c)
            elif c.tag in ("br", "wbr"):
                run.append(" " if c.tag == "br" else "")
            elif c.tag in _INLINE:
                if not c.beside and not c.marked:
                    stack.append((iter(c.children), at, False, places(c, inside)))
            else:
                flush(at)
                if c.beside:
                    continue
                own = boxes[at]
                if not own.kinds or own.kinds[-1] != c.tag:
                    own.kinds.append(c.tag)
                if names := named.get(id(c)):
                    boxes.append(Box(f"{own.from_first}/{names[0]}", f"{own.from_last}/{names[1]}", False, own.marked or c.marked))
                    stack.append((iter(c.children), len(boxes) - 1, True, places(c, inside)))
                elif c.marked:  # a paragraph or table that is named as something else is a box, too
                    boxes.append(Box(f"{own.from_first}/{c.name}", f"{own.from_last}/{c.name}", False, True))
                    stack.append((iter(c.children), len(boxes) - 1, True, places(c, inside)))
                else:
                    stack.append((iter(c.children), at, True, places(c, inside)))
        flush(len(boxes) - 1)
    return boxes, blocks


def kept(boxes: list[Box], importance: list[float], threshold: float = THRESHOLD) -> list[bool]:
    """Which boxes of a page stay."""
    weights = [x * (MARKED if b.marked else 1.0) for b, x in zip(boxes, importance, strict=True)]
    able = [k for k, b in enumerate(boxes) if b.size and not b.marked] or [k for k, b in enumerate(boxes) if b.size]
    if not able:
        return [True] * len(boxes)
    declared = any(b.fixed for b in boxes)
    cut = threshold * weights[max(able, key=lambda k: (1.0 if declared else weights[k]) * boxes[k].size)]
    return [b.fixed or x >= cut for b, x in zip(boxes, weights, strict=True)]


def extract(page: str | None, importance_of=None) -> str:
    """The text of a page: blocks of the boxes that stay, joined by two line breaks. Without importances all boxes count as 1."""
    boxes, blocks = outline(page)
    stay = kept(boxes, [1.0] * len(boxes) if importance_of is None else [importance_of(b) for b in boxes])
    return "\n\n".join(t for k, t in blocks if stay[k])


def _below(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        for c in reversed(n.children):
            if not isinstance(c, str) and not c.beside:
                if c.tag == "article":
                    out.append(c)
                else:
                    todo.append(c)
    return out


def host_of(column: str):
    """The lower-case host of a URL column; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(column, "://([^/?#]*)", 1)), F.lit(""))


def tally(pages: DataFrame) -> DataFrame:
    """What stands in the boxes of ``pages(host, html)``: node, kind (0 the page, 1 a presentation, 2 a content), item and page.

    ``page`` is the digest of the page's text, so copies are the same page; rows may repeat.
    """
    import pyarrow as pa

    def run(batches):
        names = [c.split()[0] for c in COUNTS.split(", ")]
        for batch in batches:
            rows: set[tuple[int, int, int, int]] = set()
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                host = host.as_py()
                boxes, blocks = outline(html.as_py())
                page = _hash(*(t for _, t in blocks))
                items: list[list[int]] = [[] for _ in boxes]
                for k, t in blocks:
                    if not boxes[k].fixed:
                        items[k].append(_hash(t))
                for b, own in zip(boxes, items, strict=True):
                    if b.size and not b.fixed:
                        style = _hash(*b.kinds)
                        for number in b.numbers(host):
                            rows.add((number, 0, 0, page))
                            rows.add((number, 1, style, page))
                            rows.update((number, 2, x, page) for x in own)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.int64(), pa.int8(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return pages.mapInArrow(tidy(run), COUNTS)


def importances(pages: DataFrame) -> DataFrame:
    """(node, pages, importance) of the boxes that more than one page of a host has."""
    counts = tally(pages).distinct().groupBy("node", "kind", "item").agg(F.count("*").alias("n"))
    sums = counts.groupBy("node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        *(f(F.when(F.col("kind") == k, x)).alias(f"{name}{k}") for k in (1, 2) for name, f, x in (("t", F.sum, F.col("n")), ("l", F.sum, F.col("n") * F.log("n")), ("d", F.count, F.col("n")))),
    )

    def entropy(k: int):
        t = F.col(f"t{k}")
        return F.coalesce(F.least(1 - F.col(f"l{k}") / (t * F.log("pages")), F.col(f"d{k}") / t), F.lit(0.0))

    return sums.where("pages > 1").select("node", "pages", F.greatest(entropy(1), entropy(2)).alias("importance"))


def main_text(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages(page_id, url, html)``.

    Null html counts as empty and gives an empty text; a null or hostless url belongs to one nameless host. Repeated rows are the same
    page to the tree and are all kept; other columns are ignored; no rows give no rows.
    """
    import pyarrow as pa

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("host", host_of("url"))
    low = importances(rows.select("host", "html")).where(F.col("importance") < HIGH)
    store = keyed_at(low.select(F.col("node").alias("key"), F.col("importance").alias("value")), "sitetree")

    def run(batches):
        found = keyed(*store)
        for batch in batches:
            out = []
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                parsed = [outline(page.as_py()) for page in part.column(2)]
                numbers = [b.numbers(host.as_py()) for host, (boxes, _) in zip(part.column(3), parsed, strict=True) for b in boxes]
                scores = found.of(np.array([x for own in numbers for x in own], np.int64), 1.0) if numbers else np.empty(0)
                at = np.cumsum([0] + [len(own) for own in numbers])
                least = np.minimum.reduceat(scores, at[:-1]).tolist() if numbers else []
                k = 0
                for boxes, blocks in parsed:
                    stay = kept(boxes, least[k : k + len(boxes)], threshold)
                    k += len(boxes)
                    out.append("\n\n".join(t for b, t in blocks if stay[b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
