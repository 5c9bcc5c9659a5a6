"""Main text of web pages by consensus of their hosts.

Pages of one host share a template. Each page scores its containers by the text they hold outside links and boilerplate;
a container is named by its generalised path (tags with class names, digits removed). In Spark the scores are summed per
host and path, and the path with most votes is the host's; all pages are then extracted by it. A page on which that path
does not occur, or holds nothing, uses its own best container, so no page is lost to another template.

Nulls and edge cases: null or empty html gives an empty text; pages without a host vote together under the empty host;
markup may be broken or cut off anywhere; a page without any container is taken whole; rows that repeat are extracted one
by one; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values of HTML: elements that begin a block, that have no content, whose content is no text.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
             "h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()) - {"br"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg iframe object canvas audio video textarea title math".split())
OUTSIDE = set("head nav header footer aside form button select dialog menu".split())
CONTAINERS = set("article main section div body td".split())
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"},
             "option": {"option"}, "head": {"body"}}
# Words in class and id names that mark what is not the article.
NOISE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar\w*|side|menu\w*|nav\w*|breadcrumb\w*|footer\w*|header\w*|"
                   r"masthead|cookie\w*|consent|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|comment\w*|disqus\w*|respond|"
                   r"repl(?:y|ies)|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|toolbar|pagination|pager|tags?|skip\w*)(?=$|[\s_-])", re.I)
# Beginnings of names that tell what an element has or lacks, not what it is.
_HAS = re.compile(r"(?:^|\s)(?:has|no|with|without|hide|show|is)[-_]\S*", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")


DEEP = 64                 # levels whose names a path spells out; below them it is a running hash, so its length is bounded


def _path(up: str, name: str) -> str:
    if up.count("/") < DEEP:
        return f"{up}/{name}"
    head, _, tail = up.partition("#")
    return f"{head}#{zlib.crc32(name.encode('utf-8', 'replace'), int(tail or '0', 16)):08x}{len(name) % 16:x}"


class Node:
    __slots__ = ("tag", "path", "out", "parent", "size", "linked")

    def __init__(self, tag, path, out, parent):
        self.tag, self.path, self.out, self.parent = tag, path, out, parent
        self.size = self.linked = 0


def _name(tag: str, attrs: str) -> tuple[str, bool]:
    """Generalised name of an element, and whether its names mark it as no part of an article."""
    if not attrs:
        return tag, False
    told = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(attrs)}
    names = f"{told.get('class', '')} {told.get('id', '')}"
    noise = bool(NOISE.search(_HAS.sub(" ", names))) or told.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search") or "hidden" in told
    plain = sorted({x for x in _DIGITS.sub("", told.get("class", "")).split() if x})
    return ".".join([tag, *plain]), noise


def parse(page: str):
    """Pieces of text outside boilerplate, as (node, text, breaks before), in page order, and all container nodes."""
    root = Node("", "", False, None)
    node, pieces, containers, at, fresh = root, [], [root], 0, True
    links, nodes, opened = 0, [], Counter()

    def put(raw: str):
        nonlocal fresh
        if raw and not node.out:
            pieces.append((node, raw, fresh))
            fresh = False
            n = len(raw) - raw.count(" ")
            if not raw.isspace():
                node.size += n
                node.linked += n if links else 0

    def leave():
        nonlocal node, links
        links -= node.tag == "a"
        opened[node.tag] -= 1
        node = node.parent

    while True:
        m = _TOKEN.search(page, at)
        put(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            fresh = True
        if m.group(1):
            if not opened[tag]:
                continue
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is root:
                continue
            # An end tag of an inline element does not close the blocks inside which it is misplaced.
            if tag not in BLOCKS and node is not up and _crosses(node, up):
                continue
            while node is not up.parent:
                leave()
            continue
        if tag in RAW:
            if not m.group(3).rstrip().endswith("/"):
                end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            put("\n")
            continue
        if tag in VOID:
            continue
        # A block ends an open paragraph, also one with inline elements left open in it; cells and items end their like.
        up = node
        while up is not root and up.tag not in CONTAINERS:
            if up.tag in CLOSED_BY and tag in CLOSED_BY[up.tag]:
                while node is not up.parent:
                    leave()
                break
            up = up.parent
        name, noise = _name(tag, m.group(3))
        node = Node(tag, _path(node.path, name) if tag in BLOCKS or tag in OUTSIDE else node.path,
                    node.out or noise and tag not in ("html", "body", "article", "main") or tag in OUTSIDE, node)
        links += tag == "a"
        opened[tag] += 1
        nodes.append(node)
        if tag in CONTAINERS and not node.out:
            containers.append(node)
    # What elements hold themselves becomes what they hold in all: later ones lie in earlier ones.
    for n in reversed(nodes):
        n.parent.size += n.size
        n.parent.linked += n.linked
    return pieces, containers


def _crosses(node: Node, up: Node) -> bool:
    while node is not up:
        if node.tag in BLOCKS:
            return True
        node = node.parent
    return False


def texts_of(pieces, keep: list[Node]) -> list[str]:
    """Text of each of the elements ``keep``, none of which lies in another: blocks, white space collapsed, joined by two line
    breaks. One walk over the pieces; an element's owner is looked up once."""
    owner: dict[Node, Node | None] = {k: k for k in keep}
    blocks: dict[Node, list[list[str]]] = {k: [[]] for k in keep}
    current = None
    for node, raw, fresh in pieces:
        if fresh and current is not None and blocks[current][-1]:
            blocks[current].append([])
        walk, up = [], node
        while up is not None and up not in owner:
            walk.append(up)
            up = up.parent
        own = owner[up] if up is not None else None
        owner.update(dict.fromkeys(walk, own))
        if own is not None:
            current = own
            blocks[own][-1].append(raw)
    told = [(" ".join(entities.unescape("".join(b)).split()) for b in blocks[k]) for k in keep]
    return ["\n\n".join(t for t in parts if t) for parts in told]


def text_of(pieces, keep: Node) -> str:
    return texts_of(pieces, [keep])[0]


def scores(containers) -> list[tuple[Node, float]]:
    """Text outside links, in favour of articles and of the innermost container that still holds it."""
    out = []
    for n in containers:
        plain = n.size - 2 * n.linked
        if plain > 0:
            depth = n.path.count("/")
            out.append((n, plain * (1 + 0.02 * min(depth, 20)) * (1.5 if n.tag in ("article", "main") else 1.0)))
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _votes(batches):
    for b in batches:
        rows = []
        for url, page in zip(b["url"], b["html"], strict=True):
            best: dict[str, float] = {}
            for n, s in scores(parse(page)[1]) if page else ():
                best[n.path] = max(s, best.get(n.path, 0.0))
            whole = max(best.values(), default=1.0)
            rows += [(host_of(url), p, s / whole) for p, s in best.items()]
        out = pd.DataFrame(rows, columns=["host", "path", "votes"])
        yield out.groupby(["host", "path"], as_index=False)["votes"].sum()


def _extract(batches):
    for b in batches:
        out = []
        for page, path in zip(b["html"], b["path"], strict=True):
            if not page:
                out.append("")
                continue
            pieces, containers = parse(page)
            told = [t for t in texts_of(pieces, [n for n in containers if path is not None and n.path == path]) if t]
            if not told:
                ranked = sorted(scores(containers), key=lambda x: -x[1])
                told = [text_of(pieces, ranked[0][0] if ranked else containers[0])]
            out.append("\n\n".join(told))
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(t) for t in out]})


def host_paths(pages: DataFrame) -> DataFrame:
    """Rows (host, path): the container path with most votes per host; ties go to the path that sorts first."""
    votes = (pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
             .mapInPandas(_votes, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes")))
    best = votes.groupBy("host").agg(F.max(F.struct(F.round("votes", 6), "votes")).alias("top"))
    return (votes.join(best, "host").where("votes = top.votes").groupBy("host").agg(F.min("path").alias("path")))


def extract(pages: DataFrame, *, id: str = "page_id") -> DataFrame:
    """Rows (id, url, text, n_chars), one per page."""
    paths = written(host_paths(pages), "paths")

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # The written table's size is known, so a few hosts are broadcast and many are joined by sorting, skew split.
    with_path = rows.withColumn("host", host("url")).join(paths, "host", "left").select("page_id", "url", "html", "path")
    return (with_path.mapInPandas(_extract, "page_id long, url string, text string, n_chars long").withColumnRenamed("page_id", id))
