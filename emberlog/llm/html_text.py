"""HTML extraction by minimum-cut labelling: which blocks of a page are its main text."""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- blocks: runs of text between the borders of block elements, with the element that holds them

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements (fixed values): those whose content is no text, void ones, inline ones, and those that end an open paragraph.
RAW = frozenset("script style template iframe noframes noembed textarea title xmp noscript".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# ---- the classifier's evidence (fixed values)

AGAINST_TAGS = frozenset("nav aside footer menu dialog button select option label search".split())
FOR_TAGS = frozenset(("article", "main"))
AGAINST_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended trending comment comments commentlist disqus reply replies respond discussion responses widget toolbar pagination pager copyright legal disclaimer skip search paywall".split()
)
FOR_WORDS = frozenset("article articlebody content post entry story main".split())
_ENDS = re.compile(r"[.!?…:;。！？][\"'”’»)]*$")
_RIGHTS = re.compile(r"©|\(c\) ?\d{4}|all rights reserved", re.I)


def _evidence(tag: str, attributes: str, so_far: float) -> float:
    """What an element says about the text in it, on top of so_far from the elements around it."""
    words: set[str] = set()
    hidden = role = False
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "itemprop"):
                words.update(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().replace("-", " ").replace("_", " ").split())
                words.add(value.lower())
            elif name == "role":
                role = value.lower()
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                hidden |= name == "hidden" or value.lower() == "true"
    if hidden or tag in AGAINST_TAGS or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
        return so_far - 8
    if tag in ("header", "hgroup"):  # an article's own header holds its title
        return so_far - (2 if so_far > 0 else 8)
    if words & AGAINST_WORDS and tag not in _HEADINGS and tag not in FOR_TAGS or "comment" in words or "comments" in words:
        return so_far - 8
    if tag in ("form", "fieldset"):  # some pages are one form, so it says less around everything
        return so_far - (8 if so_far > 0 else 3.5)
    if tag in FOR_TAGS or role in ("main", "article") or words & FOR_WORDS:
        return max(so_far, min(so_far + 4, 5))
    return so_far


class Page:
    """Blocks (text, element, characters in links, its tag) in page order, and of each element parent and evidence."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int, str]] = []
        self.parent, self.says, self.tag = [0], [0.0], ["html"]
        stack, open_, pieces, linked, in_link = [0], {}, [], 0, 0

        def flush():
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((text, stack[-1], min(linked, len(text)), self.tag[stack[-1]]))
                pieces.clear()
                linked = 0

        def text(s: str):
            nonlocal linked
            s = unescape(s) if "&" in s else s
            pieces.append(s)
            if in_link:
                linked += len(s.strip())

        def close(name: str):
            while len(stack) > 1:
                top = self.tag[stack.pop()]
                open_[top] -= 1
                if top == name:
                    break

        at, lower = 0, None
        while m := _TAG.search(html, at):
            if m.start() > at:
                text(html[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            ends = bool(m[1] or m[4])
            if not name:
                continue
            if name in RAW:
                if not ends and not (m[3] or m[6] or "").endswith("/"):
                    lower = html.lower() if lower is None else lower
                    if len(lower) != len(html):  # rare letters change length
                        lower = re.sub("[A-Z]", lambda c: c[0].lower(), html)
                    stop = lower.find(f"</{name}", at)
                    if stop < 0:
                        at = len(html)
                        break
                    at = html.find(">", stop) + 1 or len(html)
                continue
            if name == "br":
                pieces.append(" ")
            elif name == "a":
                in_link = 0 if ends else 1
            elif name in BLOCK:
                flush()
                if name == "hr":
                    continue
                if ends:
                    if open_.get(name):
                        close(name)
                    continue
                if open_.get("p") and self.tag[stack[-1]] == "p":
                    close("p")
                for other in _CLOSED_BY_SAME.get(name, ()):
                    if open_.get(other):
                        for k in reversed(stack):  # only up to the list or table around it
                            if self.tag[k] in _SCOPE[name] or self.tag[k] == other:
                                break
                        if self.tag[k] == other:
                            close(other)
                self.parent.append(stack[-1])
                self.says.append(_evidence(name, m[3] or m[6] or "", self.says[stack[-1]]))
                self.tag.append(name)
                stack.append(len(self.tag) - 1)
                open_[name] = open_.get(name, 0) + 1
        text(html[at:])
        flush()


def content_odds(text: str, linked: int, tag: str, says: float) -> float:
    """The classifier: log odds that a block is main text."""
    z = says + min(math.log1p(text.count(" ") + 1), 4.0) - 2.2 - 5.0 * linked / len(text)
    z += 0.8 * bool(_ENDS.search(text)) + 0.8 * (tag in ("p", "blockquote", "pre")) + 1.0 * (tag in _HEADINGS) - 0.5 * (tag == "li")
    return z - 3.0 * bool(len(text) < 200 and _RIGHTS.search(text))


def source_side(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes a minimum cut leaves with the source, by blocking flows along shortest paths. terminal: a node's
    capacity from the source, or if negative to the sink; edges: (node, node, capacity both ways)."""
    n = len(terminal)
    near, to, cap = [[] for _ in range(n)], [], []
    for i, j, c in edges:
        near[i].append(len(to))
        near[j].append(len(to) + 1)
        to += (j, i)
        cap += (c, c)
    left = terminal[:]
    while True:
        level = [-1] * n
        sources = [i for i in range(n) if left[i] > 0]
        for i in sources:
            level[i] = 0
        queue, found = sources[:], False
        for u in queue:
            found |= left[u] < 0
            for e in near[u]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if not found:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in sources:
            path, u = [], s
            while left[s] > 0:
                if left[u] < 0:
                    flow = min([left[s], -left[u], *(cap[e] for e in path)])
                    left[s] -= flow
                    left[u] += flow
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    path, u = [], s
                    continue
                while turn[u] < len(near[u]):
                    e = near[u][turn[u]]
                    if cap[e] > 0 and level[to[e]] == level[u] + 1:
                        break
                    turn[u] += 1
                if turn[u] < len(near[u]):
                    path.append(near[u][turn[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    turn[u] += 1
                else:
                    break


#: Smoothness, in log odds: between neighbours, between a block and its element, between an element and the one around
#: it; and the share of it that remains where the evidence changes.
NEXT, HOLDS, AROUND, BORDER = 0.6, 1.0, 0.5, 0.1
_UNIT = 1000


def main_blocks(html: str) -> list[str]:
    """The page's main text, block by block."""
    page = Page(html)
    blocks = page.blocks
    if not blocks:
        return []
    n = len(blocks)
    node, terminal, edges = {}, [], []
    for text, element, linked, tag in blocks:
        terminal.append(round(_UNIT * content_odds(text, linked, tag, page.says[element])) or 1)
    for i, (_, element, _, _) in enumerate(blocks):
        if i:
            same = page.says[element] == page.says[blocks[i - 1][1]]
            edges.append((i - 1, i, round(_UNIT * NEXT * (1 if same else BORDER))))
        below, weight = i, HOLDS
        while True:  # up to an element that is in the graph already
            known = element in node
            if not known:
                node[element] = n + len(node)
                terminal.append(0)
            edges.append((below, node[element], round(_UNIT * weight)))
            if known or element == 0:
                break
            up = page.parent[element]
            below, weight = node[element], AROUND * (1 if page.says[element] == page.says[up] else BORDER)
            element = up
    side = source_side(terminal, edges)
    return [text for (text, *_), content in zip(blocks, side) if content]


def _extracted(batches):
    import pyarrow as pa

    for b in batches:
        texts = ["\n".join(main_blocks(h.as_py() or "")) for h in b.column(b.schema.get_field_index("html"))]
        yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Every page is cut into blocks: runs of text between the borders of block elements, character references decoded,
    white space (of Unicode) turned into one space and trimmed. A linear classifier turns each block's elements, their
    names and roles, link density, length and end into log odds; these are the capacities from the source (main text)
    or to the sink. Neighbours, a block and its element, and elements inside each other are joined by smoothness
    edges, weaker where the evidence changes. The blocks that a minimum cut leaves with the source, in page order and
    joined by one line feed, are the text. Scripts, styles, comments of the markup and raw-text elements hold no blocks.

    A null or empty html has an empty text; null ids and urls stay; repeated rows each have their result. A page's
    cost grows with its length. Other columns are ignored. An empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
#: The expected text of pages whose one article element holds headings and paragraphs only, as the test pages do.
ORACLES = {
    "op7_html_extraction": r"""
with a as (select page_id, url, coalesce(regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's'), '') as a from pages),
b as (select page_id, url, list_filter(list_transform(string_split_regex(a, '</?(?:p|h[1-6]|div)(?: [^>]*)?>'), lambda x:
  trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '[\x09-\x0D ]+', ' ', 'g'))), lambda x: x <> '') as b from a),
t as (select page_id, url, coalesce(array_to_string(b, chr(10)), '') as text from b)
select page_id, url, text, length(text) as n_chars from t"""
}
