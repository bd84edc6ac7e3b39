"""Main text of web pages by wrapper induction.

* A page's markup becomes a tree of block elements. Blocks of text hang on its nodes, in page order.
* The page's shape is that tree with same-named siblings folded together, a short text. The shape most pages of a host
  have is the host's template; every other shape of the host is aligned to it by simple tree matching (the largest
  order-preserving match of nodes with equal names, by dynamic programming over the children). So all blocks of a host
  fall into slots: template nodes, or, where a node has no match, the node's own path.
* Over the distinct pages of a host (copies count once) each text of a slot is counted. A text that is on most pages
  that have the slot is template, and so are the often repeated ones where the slot's other texts hardly vary. All
  other texts of the slot are content.
* What markup itself calls navigation, header, footer, aside, form, notice, advert or comment, what is hidden, and
  outside articles blocks that are mostly links, is weighed by the text of the page that is no template: it is content if
  it holds more than half of that text, else it is left out, unless nothing else is there.
  Where pages have an article or main element, only blocks inside it are content, and there a text has to be
  on nearly all of many pages to count as template.

Only counts per slot and text are gathered per host; no task sees the pages of a host together. Null html or a page without
content: empty text. A null or odd url: the host is empty. Broken markup is read as browsers read it in the common
cases (unclosed paragraphs, list items and inline tags, stray end tags, unclosed comments). Repeated rows are returned
each. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import cut

#: With so many pages a slot's text is template if it is on that share of them, or if the slot's other texts differ too little.
COMMON, VARIED, PAGES = 0.5, 0.2, 4
#: The same inside an article.
COMMON_INSIDE, PAGES_INSIDE = 0.8, 20

# Names of HTML elements and words of class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table"
    " tbody td tfoot th thead tr ul".split()
)
#: Elements that are no content, block elements unless they hold most of the page.
OUT = frozenset(
    "script style noscript template nav footer aside form iframe object embed svg math canvas button select option"
    " textarea input label dialog menu head title search fieldset".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
#: Elements that an element of the same group ends, up to the listed ancestors.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HINTS = frozenset(
    "nav navbar navigation menu sidebar aside footer header masthead topbar ad ads advert adverts advertisement"
    " advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription signup login search breadcrumb breadcrumbs share sharing"
    " social related recommended recommendations comment comments commentlist discussion disqus reply replies respond"
    " form pagination pager toolbar copyright widget".split()
)
#: Class words of articles that are not the page's own.
OTHER_ARTICLE = frozenset("comment comments reply replies related recommended teaser ad ads advert promo sponsored".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("tag", "name", "parent", "kids", "out", "hint", "items")

    def __init__(self, tag: str, name: str, parent: Node | None, out: bool, hint: int) -> None:
        self.tag, self.name, self.parent, self.out, self.hint = tag, name, parent, out, hint
        self.kids: list[Node] = []
        self.items: list[Node | tuple[str, bool]] = []  # blocks and pieces of text (with: inside a link), in order


@lru_cache(100_000)
def _described(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Name in the shape, whether the element itself hints at no content, and whether its class does (2: a header)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    words = " ".join((found.get("class", ""), found.get("id", "")))
    parts = {p.lower() for p in _PARTS.findall(words)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None
    out = tag in OUT or hidden or found.get("role", "").lower() in ROLES
    name = re.sub(r"[^\w-]+", ".", re.sub(r"\d+", "0", f"{tag} {words}".strip().lower()))
    if tag in ("html", "body"):
        return name, out, 0
    words_of = parts & (OTHER_ARTICLE if tag in ("article", "main") else HINTS)
    return name, out, 0 if not words_of else 2 if words_of == {"header"} else 1


def parse(markup: str) -> Node:
    """The tree of block elements, with inline text where it stands."""
    root = Node("#", "#", None, False, 0)
    here, inline, at, size = root, [], 0, len(markup)
    muted = 0  # depth of inline elements that are no content

    def text(part: str) -> None:
        if part and not muted:
            here.items.append((html.unescape(part) if "&" in part else part, "a" in inline))

    def close(node: Node) -> None:
        nonlocal here, inline, muted
        here, inline, muted = node.parent or root, [], 0

    last_tag = max(markup.rfind(">"), markup.rfind("<!--"))
    while at < size:
        m = _TAG.search(markup, at) if at <= last_tag else None
        if m is None:
            text(markup[at:])
            break
        text(markup[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag in BLOCK:
                node = here
                while node is not root and node.tag != tag:
                    node = node.parent
                if node is not root:
                    close(node)
            elif tag in inline:
                while inline:
                    last = inline.pop()
                    muted -= last in OUT
                    if last == tag:
                        break
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}[\s/>]", re.I).search(markup, at)
            at = size if found is None else markup.find(">", found.start()) + 1 or size
            continue
        if tag in VOID and tag != "hr":
            if tag == "br":
                text(" ")
            continue
        if tag not in BLOCK:
            if not attributes.endswith("/"):
                inline.append(tag)
                muted += tag in OUT
            continue
        if tag in ENDS:
            same, until = ENDS[tag]
            node = here
            while node is not root and node.tag not in until:
                if node.tag in same:
                    close(node)
                node = node.parent
        elif tag in CLOSES_P:
            node = here
            while node is not root and node.tag == "p":
                close(node)
                node = here
        name, out, hint = _described(tag, attributes)
        node = Node(tag, name, here, out, hint)
        here.kids.append(node)
        here.items.append(node)
        if tag != "hr":
            here, inline, muted = node, [], 0
    return root


def _holding_article(root: Node) -> set[int]:
    """The nodes (by id) that are or hold an article or main element."""
    nodes = [root]
    for node in nodes:
        nodes.extend(node.kids)
    holding: set[int] = set()
    for node in reversed(nodes):
        if (node.tag in ("article", "main") and not node.hint) or any(id(kid) in holding for kid in node.kids):
            holding.add(id(node))
    return holding


def _folded(root: Node) -> tuple[str, dict[int, int]]:
    """The shape of the tree, and the number of every node (by id): nodes that fold into one have one, in shape order."""
    number: dict[int, int] = {}
    shape: list[str] = []
    todo: list[str | list[Node]] = [[root]]
    count = 0
    while todo:
        same = todo.pop()
        if isinstance(same, str):
            shape.append(same)
            continue
        for n in same:
            number[id(n)] = count
        count += 1
        shape.append(same[0].name)
        folded: dict[str, list[Node]] = {}
        for n in same:
            for kid in n.kids:
                folded.setdefault(kid.name, []).append(kid)
        if folded:
            todo.append(")")
            for k, kids in reversed(list(enumerate(folded.values()))):
                todo.append(kids)
                todo.append(" " if k else "(")
    return "".join(shape), number


def blocks(markup: str) -> tuple[str, bool, list[tuple[int, bool, int, str]], list[int]]:
    """Shape, whether there is an article, the blocks: (node of the shape, inside the article, group, text), and groups.

    A group is what markup itself calls no content: a hinted node of the shape, or outside articles the blocks of a node
    that are mostly links. A block has the innermost group it is in (-1: none), a group the group around it, which comes
    before it.
    """
    root = parse(markup)
    shape, number = _folded(root)
    holding = _holding_article(root)
    groups: dict[tuple[int, int], int] = {}
    found: list[tuple[Node, Node | None, int, str]] = []
    size: dict[int, list[int]] = {}  # characters of an article without and with a group
    pieces: list[str] = []
    linked = 0

    def flush(node: Node, article: Node | None, group: int) -> None:
        nonlocal linked
        line = " ".join("".join(pieces).split())
        if line:
            if article is not None:
                size.setdefault(id(article), [0, 0])[group >= 0] += len(line)
            elif linked >= 0.6 * len(line):
                group = groups.setdefault((-1 - number[id(node)], group), len(groups))
            found.append((node, article, group, line))
        pieces.clear()
        linked = 0

    stack = [(root, iter(root.items), None, -1)]
    while stack:
        node, items, article, group = stack[-1]
        for item in items:
            if not isinstance(item, Node):
                pieces.append(item[0])
                linked += len(item[0]) * item[1]
                continue
            flush(node, article, group)
            header = item.tag == "header" or item.hint == 2
            hinted = item.out or item.hint == 1 or (header and article is None)
            inner, own = group, article
            if hinted and (article is not None or id(item) not in holding):
                inner = groups.setdefault((number[id(item)], group), len(groups))
            if not item.hint and (item.tag == "main" or (item.tag == "article" and article is None)):
                own = item
            stack.append((item, iter(item.items), own, inner))
            break
        else:
            flush(node, article, group)
            stack.pop()

    # what is in a group makes an article large only if it is most of it
    weight = {k: plain if plain >= hinted else plain + hinted for k, (plain, hinted) in size.items()}
    main = max(weight, key=lambda k: weight[k], default=None)
    rows = [(number[id(n)], a is not None and id(a) == main, g, line) for n, a, g, line in found]
    return shape, main is not None, rows, [around for _, around in groups]


def tree(shape: str) -> list[tuple[str, list[int], int]]:
    """(name, children, parent) of the nodes of a shape, in its order."""
    nodes: list[tuple[str, list[int], int]] = []
    stack, last = [-1], -1
    for part in re.findall(r"[()]|[^() ]+", shape):
        if part == "(":
            stack.append(last)
        elif part == ")":
            last = stack.pop()
        else:
            last = len(nodes)
            nodes.append((part, [], stack[-1]))
            if stack[-1] >= 0:
                nodes[stack[-1]][1].append(last)
    return nodes


def aligned(shape: str, template: str) -> list[int]:
    """For every node of ``shape`` the node of ``template`` that simple tree matching gives it, or -1."""
    one, two = tree(shape), tree(template)
    out = [-1] * len(one)
    if not one or not two or one[0][0] != two[0][0]:
        return out
    # pairs of nodes that can match, parents before children
    pairs = [(0, 0)]
    for a, b in pairs:
        named: dict[str, list[int]] = {}
        for j in two[b][1]:
            named.setdefault(two[j][0], []).append(j)
        pairs.extend((i, j) for i in one[a][1] for j in named.get(one[i][0], ()))
    size: dict[tuple[int, int], int] = {}
    # sizes of the best matches of the first i children of a and j children of b
    tables: dict[tuple[int, int], list[list[int]]] = {}
    for a, b in reversed(pairs):
        x, y = one[a][1], two[b][1]
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                t[i][j] = max(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1] + size.get((x[i - 1], y[j - 1]), 0))
        tables[a, b], size[a, b] = t, t[-1][-1] + 1
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        out[a] = b
        t, x, y = tables[a, b], one[a][1], two[b][1]
        i, j = len(x), len(y)
        while i and j:
            if t[i][j] == t[i - 1][j]:
                i -= 1
            elif t[i][j] == t[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x[i], y[j]))
    return out


def slots(shape: str, template: str) -> list[int]:
    """A slot for every node of the shape: its template node, or a number below 0 that stands for its path."""
    nodes, match = tree(shape), aligned(shape, template)
    paths: list[int] = []  # hashes, each of the parent's and the name
    for name, _, parent in nodes:
        paths.append(xxhash.xxh3_64_intdigest(f"{paths[parent]}/{name}" if parent >= 0 else name))
    return [m if m >= 0 else -1 - (p >> 1) for m, p in zip(match, paths, strict=True)]


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, shape, blocks (node, inside, group, text) and groups of every page."""
    kind = pa.list_(pa.struct([("node", pa.int32()), ("inside", pa.bool_()), ("group", pa.int32()), ("text", pa.string())]))
    numbers = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                hosts = [(_HOST.match(u or "") or [None, ""])[1].lower() for u in batch.column("url").to_pylist()]
                shapes, rows, around = [], [], []
                for markup in batch.column("html").to_pylist():
                    shape, article, found, groups = blocks(markup or "")
                    shapes.append(shape)
                    rows.append([{"node": n, "inside": i, "group": g, "text": t} for n, i, g, t in found if i or not article])
                    around.append(groups)
                arrays = [batch.column("page_id"), batch.column("url"), pa.array(hosts), pa.array(shapes), pa.array(rows, kind), pa.array(around, numbers)]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "shape", "blocks", "groups"])

    schema = "page_id long, url string, host string, shape string, blocks array<struct<node:int,inside:boolean,group:int,text:string>>, groups array<int>"
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)


def _slots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [slots(s, t) for s, t in zip(b["shape"], b["template"], strict=True)]
        yield pd.DataFrame({"host": b["host"], "shape": b["shape"], "pages": b["pages"], "slots": found})


#: What a page is known by: its host, and hashes of its shape and of its texts.
_PAGE = ["host", "s", "page"]


def hashed(read: DataFrame) -> DataFrame:
    """``read`` with the hashes ``s`` and ``page``."""
    return read.withColumns({"s": F.xxhash64("shape"), "page": F.xxhash64(F.transform("blocks", lambda b: b["text"]))})


def slotted(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (host, s, page, is_first: no copy of an earlier row, blocks: slot, inside, a hash of the text); pages of every slot.

    ``whole``: row, host, shape, s, page and blocks with a hash in place of the text.
    """
    # copies of a page are one page, its first row
    copied = whole.groupBy("host", "page").agg(F.min("row").alias("first"), F.count("*").alias("times")).where("times > 1")
    copied = cut(copied.drop("times"), "wrapper-copied")
    single = whole.join(copied, ["host", "page"], "left").where("first is null or row = first")
    pages = single.groupBy("host", "s").agg(F.count("*").alias("pages"))
    shapes = whole.groupBy("host", "shape", "s").agg(F.count("*").alias("rows")).join(pages, ["host", "s"], "left")
    shapes = cut(shapes.fillna(0, ["pages"]).drop("s", "rows"), "wrapper-shapes")
    commonest = shapes.groupBy("host").agg(F.max_by("shape", F.struct("pages", "shape")).alias("template"))
    placed = shapes.join(commonest, "host").select("host", "shape", "template", "pages")
    placed = placed.mapInPandas(_slots_of, "host string, shape string, pages long, slots array<long>")
    placed = cut(placed, "wrapper-slots")
    found = F.transform(
        "blocks", lambda b: F.struct(F.element_at("slots", b["node"] + 1).alias("slot"), b["inside"].alias("inside"), b["text"].alias("text"))
    )
    placed_blocks = whole.join(placed.drop("pages"), ["host", "shape"]).join(copied, ["host", "page"], "left")
    is_first = F.col("first").isNull() | (F.col("row") == F.col("first"))
    placed_blocks = placed_blocks.select(*_PAGE, is_first.alias("is_first"), found.alias("blocks"))
    having = placed.select("host", "pages", F.explode(F.array_distinct("slots")).alias("slot"))
    having = having.groupBy("host", "slot").agg(F.sum("pages").alias("pages"))
    return placed_blocks, cut(having, "wrapper-having")


def templates(placed: DataFrame, having: DataFrame) -> DataFrame:
    """host, slot, text (a hash): the texts that are template in their slot."""
    texts = placed.where("is_first").select("host", F.explode(F.array_distinct("blocks")).alias("f")).select("host", "f.*")
    counted = texts.groupBy("host", "slot", "text").agg(F.count("*").alias("n"), F.max("inside").alias("inside"))
    # a text of one page is never template: those of a slot are one row
    often = F.when(F.col("n") > 1, F.col("text")).alias("text")
    counted = counted.groupBy("host", "slot", often).agg(
        F.max("n").alias("n"), F.count("*").alias("times"), F.max("inside").alias("inside")
    )
    counted = cut(counted, "wrapper-texts").join(having, ["host", "slot"])
    common = F.col("n") >= COMMON * F.col("pages")
    # what is left in a slot without the texts of most pages
    stats = counted.groupBy("host", "slot").agg(
        F.max("inside").alias("any_inside"),
        F.coalesce(F.sum(F.when(~common, F.col("n") * F.col("times"))), F.lit(0)).alias("texts"),
        F.coalesce(F.sum(F.when(~common, F.col("times"))), F.lit(0)).alias("different"),
    )
    rotating = (F.col("different") < VARIED * F.col("texts")) & (VARIED * F.col("n") >= 1)
    fixed = F.when(
        F.col("any_inside"), (F.col("pages") >= PAGES_INSIDE) & (F.col("n") >= COMMON_INSIDE * F.col("pages"))
    ).otherwise((F.col("pages") >= PAGES) & (common | rotating))
    judged = cut(counted.join(stats, ["host", "slot"]).select("host", "slot", "text", fixed.alias("fixed")), "wrapper-judged")
    # where nothing varies there is nothing to tell content by, and all of it stays
    varying = judged.where("not fixed").select("host").distinct()
    return cut(judged.where("fixed").join(varying, "host", "left_semi").drop("fixed"), "wrapper-templates")


def content(blocks: list[dict], groups: list[int], gone: list[int]) -> str:
    """The text of a page without the blocks ``gone``, and without the groups that don't hold most of what is left."""
    template = set(gone)
    left = [b for at, b in enumerate(blocks) if at not in template]
    held = [0] * len(groups)
    for b in left:
        if b["group"] >= 0:
            held[b["group"]] += len(b["text"])
    for g in range(len(groups) - 1, -1, -1):
        if groups[g] >= 0:
            held[groups[g]] += held[g]
    whole = sum(len(b["text"]) for b in left)
    kept = [b["text"] for b in left if b["group"] < 0 or 2 * held[b["group"]] > whole]
    # hints that leave nothing tell nothing apart
    return "\n".join(kept or [b["text"] for b in left])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            batch = whole.slice(lo, 500)
            columns = [batch.column(c).to_pylist() for c in ("blocks", "groups", "gone")]
            texts = [content(b, g, gone or []) for b, g, gone in zip(*columns, strict=True)]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for every row of ``pages``.

    Pages are parsed twice: what is written in between are hashes, and texts move once, to the blocks that go.
    """
    lean = F.transform(
        "blocks", lambda b: F.struct(b["node"].alias("node"), b["inside"].alias("inside"), F.xxhash64(b["text"]).alias("text"))
    )
    whole = hashed(read_pages(pages)).select(*_PAGE, "shape", lean.alias("blocks"), F.monotonically_increasing_id().alias("row"))
    placed, having = slotted(cut(whole, "wrapper-pages"))
    blocks = placed.select(*_PAGE, F.posexplode("blocks").alias("at", "b")).select(*_PAGE, "at", "b.slot", "b.text")
    # copies of a page have the same blocks, and lose the same
    gone = blocks.join(templates(placed, having), ["host", "slot", "text"]).groupBy(*_PAGE).agg(F.collect_set("at").alias("gone"))
    again = hashed(read_pages(pages)).select(*_PAGE, "page_id", "url", "blocks", "groups")
    joined = again.join(cut(gone, "wrapper-gone"), _PAGE, "left").select("page_id", "url", "blocks", "groups", "gone")
    text = joined.mapInArrow(_contents, "page_id long, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))
