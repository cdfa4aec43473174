"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every node (elements and texts) has a hidden label, content or not. Potentials: one for each parent-child edge, by
the child's kind, and one for each node from its features (tag, names, parent's tag, length, link share, depth, standing inside what is named as something else).
Sum-product messages go upward from the leaves and downward from the root, exact on a tree, and give each text node's
content marginal; texts of at least 1/2 are kept.

The potentials are counted from labelled pages: pages whose markup names the article (article or main); its nodes are
content unless an element inside is named as something else. Each is counted a second time with the article's own
element turned into a div, so that pages without one are read by what else they show. Where little or nothing was counted,
the potentials are those of a prior (PRIOR: what elements, names, lengths, links and punctuation say of any page). The fit takes a sample of about `sample` labelled pages
(a documented bound, drawn by hash); counts are added up by Spark and at most 2 * CELLS + 8 numbers reach the driver.
Extraction is one narrow stage over all pages.

Text: blocks end at block-level tags; a br is white space; character references are decoded; white space inside a
block becomes one blank; blocks without text vanish; the rest is joined by line breaks in page order.

Defined cases: null or empty html gives an empty text; broken markup is read as it comes (unclosed tags end with
their parent, stray end tags are ignored, an unclosed comment or script runs to the end); without labelled pages
the prior's potentials decide alone; repeated rows are extracted each; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, prepare, table

CELLS = 4096
_OPEN = re.compile(r"</?[a-zA-Z]")
_NAME_END = re.compile(r"[\s/>]")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|type)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements by their part in HTML. Fixed values.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_ENDS = {t: ({"p"} if t in CLOSES_P else set()) | SAME.get(t, set()) for t in CLOSES_P | set(SAME)}
_QUOTE_OR_END = re.compile("[>\"']")
#: What labels a page: elements that name the article, and what is not the article even inside it.
ARTICLE = {"article", "main"}
OTHER = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog"} | RAW
OTHER_NAMES = {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "nav", "navbar", "menu", "sidebar", "footer", "comment", "comments", "cookie", "consent", "notice", "banner", "newsletter", "subscribe", "share", "social", "related", "breadcrumb", "breadcrumbs", "popup", "modal", "widget", "login", "search", "disclaimer", "copyright"}


#: What a feature says for content before any page is counted (log-odds), and pseudo-counts of edges by the parent's and the child's label.
PRIOR = {
    **{f"t:{t}": 0.5 for t in ("p", "h1", "h2", "h3", "blockquote", "pre", "article", "main", "figcaption")},
    **{f"t:{t}": -6.0 for t in OTHER | {"header", "input", "label", "option", "iframe"}},
    **{f"t:{t}": -0.5 for t in ("ul", "ol", "li", "a")},
    **{f"n:{w}": -9.0 for w in OTHER_NAMES | {"header", "masthead"}},
    **{f"n:{w}": 2.0 for w in ("article", "content", "post", "entry", "story", "body", "main")},
    **{f"l:{k}": 0.8 - 0.4 * k for k in range(11)},
    **{f"s:False:{k}": 0.4 * (k - 5) for k in range(1, 12)},
    "i:True": -4.0, "p:0": -1.0, **{f"p:{k}": 0.3 * k for k in range(1, 9)},
}
PRIOR_EDGES = (((60, 2), (1, 40)), ((200, 1), (1, 200)))
#: Nodes with a feature that weigh as much as its prior.
PRIOR_NODES = 5

_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}


class Tags:
    """Pieces of a page in order: (text before, closing?, name, attributes); the last has no name. Linear in the page.

    A tag ends at its first > outside quotes; once the quotes of a tag never close, tags end at their first >. A < that no >
    follows is text, and so is one that no name, ! or ? follows.
    """

    def __init__(self, html: str):
        self.html, self.at, self.quoted = html, 0, True
        self.last = html.rfind(">")

    def __iter__(self) -> Iterator[tuple[str, bool, str, str]]:
        html, begin, at = self.html, 0, 0
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                stop, found = (len(html) if end < 0 else end + 3), (False, "", "")
            elif at > self.last:
                at = html.find("<!--", at)
                if at < 0:
                    break
                continue
            elif html.startswith(("<!", "<?"), at):
                stop, found = html.find(">", at) + 1, (False, "", "")
            elif m := _OPEN.match(html, at):
                stop = self._tag_end(m.end())
                cut = _NAME_END.search(html, m.end(), stop).start()
                found = (html[at + 1] == "/", html[m.end() - 1 : cut].lower(), html[cut : stop - 1])
            else:
                at += 1
                continue
            text, self.at = html[begin:at], stop
            yield text, *found
            begin = at = self.at  # whoever reads may have gone on
        yield html[begin:], False, "", ""

    def _tag_end(self, at: int) -> int:
        html, here = self.html, at
        while self.quoted:
            m = _QUOTE_OR_END.search(html, here)
            if m and m[0] == ">":
                return m.end()
            here = html.find(m[0], m.end()) + 1 if m else 0
            if not here:
                self.quoted = False
        return html.index(">", at) + 1


class Open:
    """The elements that are open, with where each name stands among them: all questions are answered without a walk."""

    def __init__(self):
        self.nodes, self.names = [0], [""]
        self.where: dict[str, list[int]] = {}
        self.blocks = [0]  # places of block elements but p

    def push(self, node: int, tag: str) -> None:
        self.where.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK and tag != "p":
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(tag)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.nodes.pop()
            self.where[self.names.pop()].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def end(self, tag: str) -> None:
        """An end tag: its element and all inside it; nothing if none of that name is open."""
        if places := self.where.get(tag):
            self.cut(places[-1])

    def imply_ends(self, tag: str) -> None:
        """What a start tag ends: the elements it cannot stand in, from the innermost outward, up to a block that lies between."""
        ends = _ENDS.get(tag, ())
        while (place := max((self.where[t][-1] for t in ends if self.where.get(t)), default=0)) and self.blocks[-1] <= place:
            self.cut(place)


class Page:
    """Nodes in page order: parent, tag ("#text" for texts), names from attributes, text and block number."""

    def __init__(self, html: str):
        self.parent, self.tag, self.names, self.text, self.block = [-1], ["#root"], [()], [""], [0]
        self.blocks = 0
        open_, tags = Open(), Tags(html)
        for text, close, tag, attrs in tags:
            self._add_text(text, open_.nodes[-1])
            if not tag:
                continue
            if tag in BLOCK:
                self.blocks += 1
            if close:
                open_.end(tag)
                continue
            open_.imply_ends(tag)
            node = self._add(open_.nodes[-1], tag, self._names(attrs), "")
            if tag in RAW and not attrs.endswith("/"):
                end = _RAW_END[tag].search(html, tags.at)
                self._add_text(html[tags.at : end.start() if end else len(html)], node)
                stop = html.find(">", end.end()) if end else -1
                tags.at = len(html) if stop < 0 else stop + 1
            elif tag not in VOID:
                open_.push(node, tag)

    @staticmethod
    def _names(attrs: str) -> tuple[str, ...]:
        return tuple(w for _, v in _ATTR.findall(attrs) for w in _NAME.findall(v.lower())) if attrs and "=" in attrs else ()

    def _add(self, parent: int, tag: str, names: tuple, text: str) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.names, names), (self.text, text), (self.block, self.blocks)):
            column.append(value)
        return len(self.tag) - 1

    def _add_text(self, raw: str, parent: int) -> None:
        if raw:
            self._add(parent, "#text", (), entities.unescape(raw))

    def labels(self) -> list[int] | None:
        """1 for content; None when the page does not name its article."""
        if not ARTICLE & set(self.tag):
            return None
        out = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            out[i] = int((out[self.parent[i]] or self.tag[i] in ARTICLE) and self.tag[i] not in OTHER and not OTHER_NAMES.intersection(self.names[i]))
        return out

    def features(self) -> list[list[int]]:
        n = len(self.tag)
        length, linked, depth, inside = [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + 1
            inside[i] = inside[self.parent[i]] or self.tag[i] in OTHER or not OTHER_NAMES.isdisjoint(self.names[i])
        for i in range(n - 1, 0, -1):
            if self.tag[i] == "#text":
                length[i] = len(self.text[i].strip())
            elif self.tag[i] == "a":
                linked[i] = length[i]
            p = self.parent[i]
            length[p] += length[i]
            linked[p] += linked[i]
        out = []
        for i in range(n):
            tag, up = self.tag[i], self.tag[self.parent[i]] if i else ""
            share = 10 * linked[i] // length[i] if length[i] else -1
            size = length[i].bit_length()
            named = [f"n:{x}" for x in self.names[i]]
            stops = sum(map(self.text[i].count, ".!?,")) if tag == "#text" else -1
            out.append([_cell(x) for x in (f"t:{tag}", f"u:{up}>{tag}", f"s:{tag in BLOCK}:{size}", f"l:{share}", f"d:{min(depth[i], 12)}", f"p:{min(stops, 8)}", f"i:{inside[i]}", *named)])
        return out


def _cell(name: str, known: dict[str, int] = {}) -> int:  # noqa: B006  the dictionary is the memory
    got = known.get(name)
    if got is None:
        got = zlib.crc32(name.encode()) % CELLS
        if len(known) < 100_000:
            known[name] = got
    return got


def _edge(child: str) -> int:
    return int(child == "#text")


def count_page(page: Page, labels: list[int], nodes: np.ndarray, edges: np.ndarray) -> None:
    """Adds a labelled page to nodes[label, cell] and edges[kind of child, parent's label, child's label]."""
    for i, cells in enumerate(page.features()):
        np.add.at(nodes[labels[i]], cells, 1)
        if i:
            edges[_edge(page.tag[i]), labels[page.parent[i]], labels[i]] += 1


class TreeModel:
    def __init__(self, nodes: np.ndarray, edges: np.ndarray):
        logs = np.log((nodes + 0.5) / (nodes.sum(1, keepdims=True) + 0.5 * CELLS))
        prior = np.zeros(CELLS)
        for name, odds in PRIOR.items():
            prior[_cell(name)] = odds
        seen = nodes.sum(0)
        # log-potential of content against other: what was counted, drawn towards the prior where little was
        self.gain = ((seen * (logs[1] - logs[0]) + PRIOR_NODES * prior) / (seen + PRIOR_NODES)).tolist()
        edges = edges + np.array(PRIOR_EDGES, dtype=float)
        share = (edges + 1) / (edges + 1).sum(2, keepdims=True)
        self.edge = share.tolist()

    def marginals(self, page: Page) -> list[float]:
        """Content marginal of every node, by sum-product upward, then downward."""
        n = len(page.tag)
        gain, parent = self.gain, page.parent
        own = []
        for cells in page.features():
            x = max(-30.0, min(30.0, sum(gain[c] for c in cells)))
            p = 1 / (1 + math.exp(-x))
            own.append((1 - p, p))
        up0, up1 = [o[0] for o in own], [o[1] for o in own]
        to = [(1.0, 1.0)] * n  # message of a node to its parent
        for i in range(n - 1, 0, -1):
            e = self.edge[_edge(page.tag[i])]
            z = up0[i] + up1[i]
            a, b = up0[i] / z, up1[i] / z
            m0, m1 = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
            to[i] = (m0, m1)
            p = parent[i]
            x, y = up0[p] * m0, up1[p] * m1
            z = x + y
            up0[p], up1[p] = x / z, y / z
        out = [0.0] * n
        down = [(0.5, 0.5)] * n  # what a node gets from above
        z = up0[0] + up1[0]
        out[0] = up1[0] / z
        for i in range(1, n):
            p = parent[i]
            # the parent's belief without what this node told it
            x, y = down[p][0] * up0[p] / to[i][0], down[p][1] * up1[p] / to[i][1]
            z = x + y
            x, y = x / z, y / z
            e = self.edge[_edge(page.tag[i])]
            down[i] = (e[0][0] * x + e[1][0] * y, e[0][1] * x + e[1][1] * y)
            a, b = down[i][0] * up0[i], down[i][1] * up1[i]
            out[i] = b / (a + b)
        return out

    def text(self, page: Page) -> str:
        blocks: dict[int, list[str]] = {}
        for i, p in enumerate(self.marginals(page)):
            if page.tag[i] == "#text" and p >= 0.5 and page.tag[page.parent[i]] not in RAW:
                blocks.setdefault(page.block[i], []).append(page.text[i])
            elif page.tag[i] == "br" and page.block[i] in blocks:
                blocks[page.block[i]].append(" ")
        joined = (" ".join("".join(x).split()) for _, x in sorted(blocks.items()))
        return "\n".join(x for x in joined if x)


def fit(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", sample: int = 3000) -> TreeModel:
    """Potentials from about `sample` labelled pages, drawn by the hash of page_id and html."""
    prepare(pages.sparkSession)
    named = pages.filter(F.col(html).rlike("(?i)<(?:article|main)[ >]"))
    total = named.count()
    drawn = named if total <= sample else named.filter(F.pmod(F.xxhash64(page_id, html), F.lit(1 << 30)) < int((1 << 30) * sample / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, edges = np.zeros((2, CELLS), np.int64), np.zeros((2, 2, 2), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                page = Page((raw or b"").decode("utf-8", "replace"))
                if (labels := page.labels()) is not None:
                    count_page(page, labels, nodes, edges)
                    page.tag = ["div" if t in ARTICLE else t for t in page.tag]
                    count_page(page, labels, nodes, edges)
        flat = np.concatenate([nodes.ravel(), edges.ravel()])
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["i", "n"])

    counts = drawn.select(F.col(html).cast("binary")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(2 * CELLS + 8)
    for i, n in counts:
        flat[i] = n
    return TreeModel(flat[: 2 * CELLS].reshape(2, CELLS), flat[2 * CELLS :].reshape(2, 2, 2))


def extract(pages: DataFrame, model: TreeModel, *, html: str = "html", keep=None) -> DataFrame:
    """`keep` (default: all columns) with the main text and n_chars."""

    def make():
        def f(htmls: list[bytes | None]) -> list:
            texts = [model.text(Page(h.decode("utf-8", "replace"))) if h else "" for h in htmls]
            return [texts, [len(t) for t in texts]]

        return f

    return map_texts(pages, html, make, "main_text string, n_chars long", keep=keep)


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    got = extract(pages, fit(pages), keep=[F.col("page_id"), F.col("url")])
    return got.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


#: What the model must find on pages that name their article and hold nothing else in it.
OP2_SQL = r"""
WITH b AS (SELECT page_id, url, string_split_regex(coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''), '</?(?:p|h1)>') AS parts FROM pages),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(blocks, chr(10)), '')) AS BIGINT) AS n_chars FROM c
"""
